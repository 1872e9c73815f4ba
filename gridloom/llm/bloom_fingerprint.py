"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs are its lines, long ones cut at the ends of sentences or of some words, finer at the start of a text
than further on, whatever its length, so that versions share their paragraphs whatever was put in or taken out.
A piece that comes again counts again. Each is hashed to a digest of 56 bits that ends in 8 bits of its length, so that recovered digests can be
weighed by their characters. A sketch has cells in three rows; each digest is added to one cell of each row, where a cell holds how many there are, the XOR of the digests and
the XOR of their checksums. The sketches of two versions are subtracted cell by cell. What both have vanishes. A cell with one digest left
gives it away; taking it out of its other cells uncovers more ("peeling"), until the differing digests are recovered.

If the first sketch is too small for that, a larger one is used, of a single row with 16 cells for each digest. Its cells are made for
all pairs of versions by one grouping, already subtracted, as adding and taking out are the same XOR; those that hold nothing
don't exist. What lies alone in its cell is given away at once. The few digests of the other cells are dealt to buckets with
a sketch of three rows each, about a bucket for 16 of them; a bucket that still fails gets larger sketches, by other hashes,
until one succeeds.

What happens in each case: null text counts as the empty text, which has no paragraph; two texts without a paragraph
are alike (1), and one with and one without are not (0); equal texts have equal fingerprints and likeness 1; rows with
the same id and text count as one document, and each of them is returned; rows with a null id come last in the order;
one document alone is its own next; an empty table gives an empty result; further columns are ignored, whatever their
names. Texts are handled whole, and a long one in time n * sqrt(n) of its paragraphs at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import cut

#: Cells in each of a sketch's three rows, as a power of two of at most 8.
FIRST = 3
#: The same of a bucket's sketches as powers of two, each tried if the one before failed. From the second on digests are
#: hashed anew.
RETRIES = (3, 5, 8, 8, 8, 8)
ROUNDS = 6
PER_BUCKET = 16
#: Cells for each digest in the single row of the larger sketch, and how many of them may hold several digests until all digests of
#: the pair are dealt to buckets instead of those cells' alone: finding out theirs takes the product of both numbers.
SPARSE, MIXED = 16, 500
LENGTH_BITS = 8
#: (code points, pattern of a piece) of a text's first parts, which are cut off where they end.
HEAD = ((8, r"[^\n]{1,2}"), (24, r"[^\n]{1,4}"), (64, r"[^\n]{6,16}?(?=\s)|[^\n]{1,16}"))
_END, _WORD_END = r"[.!?…。！？](?=\s)", r"[dto](?=\s)"
#: The same of what follows; each part goes on to a bound of the text itself, so that what is put in before moves no later
#: piece. Pieces end with a line, a sentence, or a word with one of some letters; they have at most 8 bits' length.
PARTS = ((416, r"[^\n]{24,32}?(?=\s)|[^\n]{1,32}"), (960, rf"[^\n]{{40,95}}?{_END}|[^\n]{{60,95}}?{_WORD_END}|[^\n]{{1,96}}"), (None, rf"[^\n]{{60,199}}?{_END}|[^\n]{{110,199}}?{_WORD_END}|[^\n]{{1,200}}"))
#: What a part of so many code points holds: on to the next bound, if one is near.
REACH = rf"(?s)\A.{{0,%d}}(?:[^\n]{{0,150}}?(?:{_END}|\n))?"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def numbered(digests: Column) -> Column:
    """The digests, with those that come again told apart by how often they came before; the length stays."""
    low = (1 << LENGTH_BITS) - 1
    again = lambda d, j: F.when(j == 0, d).otherwise(F.xxhash64(d, j).bitwiseAND(F.lit(~low)).bitwiseOR(d.bitwiseAND(F.lit(low))))

    def runs(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i) != F.get(x, i - 1)))
        run = lambda all_of, at, k: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(all_of, k + 1), F.size(x)) - at - 1), lambda j: again(F.get(x, at), j))
        return _let(starts, lambda all_of: F.flatten(F.transform(all_of, lambda at, k: run(all_of, at, k))))

    return _let(digests, lambda d: F.when(F.size(F.array_distinct(d)) == F.size(d), d).otherwise(F.array_distinct(_let(F.array_sort(d), runs))))


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs."""
    found, at = [], 1
    for size, piece in HEAD:
        found.append(F.regexp_extract_all(F.substring(text, F.lit(at), F.lit(size)), F.lit(piece), F.lit(0)))
        at += size
    reach = lambda x, n: F.regexp_extract(F.substring(x, 1, n + 152), REACH % n, 0)
    behind = lambda x, part: F.substring(x, F.char_length(part) + 1, F.char_length(x))
    pieces = lambda x, k: F.regexp_extract_all(x, F.lit(PARTS[k][1]), F.lit(0))

    def follow(x: Column, k: int) -> Column:
        if PARTS[k][0] is None:
            return pieces(x, k)
        return _let(x, lambda x: _let(reach(x, PARTS[k][0]), lambda part: F.concat(pieces(part, k), follow(behind(x, part), k + 1))))

    # What follows begins at the first end of a sentence behind the head.
    rest = lambda x: _let(reach(x, 0), lambda first: F.concat(pieces(first, 0), follow(behind(x, first), 0)))
    tail = F.substring(text, F.lit(at), F.char_length(text))
    found.append(F.when(F.char_length(text) < at, F.array().cast("array<string>")).otherwise(_let(tail, rest)))
    low = (1 << LENGTH_BITS) - 1
    return numbered(F.transform(F.concat(*found), lambda p: F.xxhash64(p).bitwiseAND(F.lit(~low)).bitwiseOR(F.char_length(p).cast("long"))))


def characters(digests: Column) -> Column:
    """The characters of the paragraphs of some digests."""
    return F.aggregate(digests, F.lit(0).cast("long"), lambda n, d: n + d.bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)))


def _places(digest: Column, salt: Column | None) -> Column:
    """The bits of a digest that say where it lies: 8 for each row."""
    own = F.shiftright(digest, LENGTH_BITS)
    return own if salt is None else F.when(salt == 0, own).otherwise(F.xxhash64(digest, salt))


def _cell(n: Column, k: Column, h: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("long").alias("k"), h.cast("long").alias("h"))


def sketch(digests: Column, width: Column | None = None, salt: Column | None = None) -> Column:
    """The cells (n, k, h) of a set of digests: three rows of 2^width cells."""
    width = F.lit(FIRST) if width is None else width
    add = lambda c, y: _cell(c["n"] + 1, c["k"].bitwiseXOR(y["d"]), c["h"].bitwiseXOR(y["h"]))
    nothing = _cell(F.lit(0), F.lit(0), F.lit(0))
    last = (F.call_function("shiftleft", F.lit(1), width) - 1).cast("long")
    item = lambda d, at: F.struct(*(F.shiftright(at, 8 * r).bitwiseAND(last).alias(f"at{r}") for r in range(3)), d.alias("d"), F.xxhash64(d).alias("h"))
    row = lambda items, r: F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.aggregate(F.filter(items, lambda y: y[f"at{r}"] == i), nothing, add))
    items = F.transform(digests, lambda d: item(d, _places(d, salt)) if salt is None else _let(_places(d, salt), lambda at: item(d, at)))
    return _let(items, lambda x: F.concat(*(row(x, r) for r in range(3))))


def subtract(a: Column, b: Column) -> Column:
    """The cells of a without those of b."""
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def peel(cells: Column, width: Column | None = None, salt: Column | None = None) -> Column:
    """(done, here, there): whether the subtracted cells gave away all, and the digests of either side."""
    width = F.lit(FIRST) if width is None else width
    longs = F.array().cast("array<long>")
    pure = lambda c: (F.abs(c["n"]) == 1) & (c["h"] == F.xxhash64(c["k"]))

    side = F.call_function("shiftleft", F.lit(1), width)

    def placed(c: Column) -> Column:
        """A pure cell with the numbers of the cells that its digest lies in."""
        return _let(_places(c["k"], salt), lambda at: F.struct(
            c["n"].alias("n"), c["k"].alias("k"), c["h"].alias("h"),
            *((F.shiftright(at, 8 * r).bitwiseAND(side.cast("long") - 1).cast("int") + r * side).alias(f"c{r}") for r in range(3)),
        ))

    def without(cell: Column, i: Column, items: Column) -> Column:
        out = lambda c, x: _cell(c["n"] - x["n"], c["k"].bitwiseXOR(x["k"]), c["h"].bitwiseXOR(x["h"]))
        return F.aggregate(F.filter(items, lambda x: (x["c0"] == i) | (x["c1"] == i) | (x["c2"] == i)), cell, out)

    def state(c: Column, here: Column, there: Column) -> Column:
        return F.struct(c.alias("cells"), here.alias("here"), there.alias("there"))

    def step(s: Column, _: Column) -> Column:
        of = lambda items, n: F.transform(F.filter(items, lambda x: x["n"] == n), lambda x: x["k"])
        return _let(
            F.transform(F.array_distinct(F.filter(s["cells"], pure)), placed),
            lambda items: F.when(F.size(items) == 0, s).otherwise(
                state(
                    F.transform(s["cells"], lambda c, i: without(c, i, items)),
                    F.concat(s["here"], of(items, 1)), F.concat(s["there"], of(items, -1)),
                )
            ),
        )

    empty = lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), state(cells, longs, longs), step,
        lambda s: F.struct(F.forall(s["cells"], empty).alias("done"), s["here"].alias("here"), s["there"].alias("there")),
    )


def _certain(a: Column, b: Column) -> Column:
    """(done, here, there) of a bucket, by sketches that are larger or hashed anew each time one fails.

    That all fail is out of the question: each of the last four fails for about one of 10^5 buckets, whatever the others do.
    """
    longs = F.array().cast("array<long>")
    start = F.struct(F.lit(False).alias("done"), longs.alias("here"), longs.alias("there"))
    tries = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(k).alias("salt")) for k, w in enumerate(RETRIES)])
    by_sketch = lambda t: peel(subtract(sketch(a, t["width"], t["salt"]), sketch(b, t["width"], t["salt"])), t["width"], t["salt"])
    found = F.aggregate(tries, start, lambda s, t: F.when(s["done"], s).otherwise(by_sketch(t)))
    return _let(found, lambda r: F.struct(F.when(r["done"], F.lit(True)).otherwise(F.raise_error(F.lit("no sketch gives the differing digests")).cast("boolean")).alias("done"), r["here"].alias("here"), r["there"].alias("there")))


def _by_buckets(a: Column, b: Column) -> Column:
    """(done, here, there) of two sets of digests by the sketches of buckets."""
    groups = F.greatest(F.lit(1), F.ceil(F.sqrt((F.size(a) + F.size(b)) / F.lit(PER_BUCKET)))).cast("long")
    each = lambda n, f: F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), f))

    def bucketed(n: Column) -> Column:
        of = lambda x, g, fold: F.filter(x, lambda d: F.pmod(fold(F.shiftrightunsigned(d, LENGTH_BITS + 24)), n) == g)
        flat, high = (lambda v: v), (lambda v: F.shiftrightunsigned(v, 20))
        found = each(n, lambda g: _let(
            F.struct(of(a, g, flat).alias("a"), of(b, g, flat).alias("b")),
            lambda ab: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda h: _let(F.struct(of(ab["a"], h, high).alias("a"), of(ab["b"], h, high).alias("b")), lambda x: _certain(x["a"], x["b"]))),
        ))
        side = lambda r, name: F.flatten(F.transform(r, lambda x: x[name]))
        return _let(found, lambda r: F.struct(F.lit(True).alias("done"), side(r, "here").alias("here"), side(r, "there").alias("there")))

    return _let(groups, bucketed)


def differences(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """(done, here, there) of two sets of digests with their first sketches."""
    return _let(peel(subtract(sketch_a, sketch_b)), lambda r: F.when(r["done"], r).otherwise(_by_buckets(a, b)))


def _cell_of(digest: Column, cells: Column) -> Column:
    """The cell of the larger sketch's single row."""
    return F.pmod(F.xxhash64(digest), cells)


def _sparse(rows: DataFrame) -> DataFrame:
    """Of every `next_row` of rows (next_row, cells, a, e, b): what the single rows of a - e and of a - b give away, as
    e_here, e_there, b_here and b_there, and their cells with several digests, as e_mixed and b_mixed."""
    sizes = rows.select("next_row", "cells", F.size("a").alias("na"), F.size("e").alias("ne"), F.posexplode(F.concat("a", "e", "b")).alias("at", "d"))
    before, edited = F.col("at") < F.col("na"), F.col("at") < F.col("na") + F.col("ne")
    signs = {"e": F.when(before, 1).when(edited, -1).otherwise(0), "b": F.when(before, 1).when(edited, 0).otherwise(-1)}
    items = sizes.select("next_row", "d", _cell_of(F.col("d"), F.col("cells")).alias("cell"), F.xxhash64("d").alias("hash"), *(s.alias(f"{k}_sign") for k, s in signs.items()))
    once = lambda k, x: F.bit_xor(F.when(F.col(f"{k}_sign") == 0, F.lit(0).cast("long")).otherwise(F.col(x)))
    cells = items.groupBy("next_row", "cell").agg(*(c for k in signs for c in (F.sum(f"{k}_sign").alias(f"{k}_n"), once(k, "d").alias(f"{k}_k"), once(k, "hash").alias(f"{k}_h"))))

    def given(k: str) -> list[Column]:
        n, x, h = F.col(f"{k}_n"), F.col(f"{k}_k"), F.col(f"{k}_h")
        alone = h == F.xxhash64(x)
        mixed = ((n != 0) | (x != 0) | (h != 0)) & ~((F.abs(n) == 1) & alone)
        found = {"here": (n == 1) & alone, "there": (n == -1) & alone}
        return [*(F.collect_list(F.when(c, x)).alias(f"{k}_{name}") for name, c in found.items()), F.collect_list(F.when(mixed, F.col("cell"))).alias(f"{k}_mixed")]

    return cells.groupBy("next_row").agg(*(c for k in signs for c in given(k)))


def _completed(a: Column, b: Column, first: Column, here: Column, there: Column, mixed: Column, cells: Column) -> Column:
    """(done, here, there) of two sets of digests by their subtracted first sketches or, if these don't do, by what _sparse found."""
    found = lambda x, y: F.struct(F.lit(True).alias("done"), x.alias("here"), y.alias("there"))
    few = F.size(mixed) <= MIXED
    known = lambda x: F.when(few, x).otherwise(F.array().cast("array<long>"))
    rest = lambda x: F.when(few, F.filter(x, lambda d: F.array_contains(mixed, _cell_of(d, cells)))).otherwise(x)
    buckets = _let(F.struct(rest(a).alias("a"), rest(b).alias("b")), lambda x: _by_buckets(x["a"], x["b"]))
    larger = _let(buckets, lambda r: found(F.concat(known(here), r["here"]), F.concat(known(there), r["there"])))
    return _let(peel(first), lambda r: F.when(r["done"], r).when(F.size(mixed) == 0, found(here, there)).otherwise(larger))


def likeness(a: Column, b: Column, diff: Column) -> Column:
    """Twice the characters of shared paragraphs over those of both, from 0 to 1."""
    of_a, of_b = characters(a), characters(b)
    return F.when(of_a + of_b == 0, F.lit(1.0)).otherwise(2.0 * (of_a - characters(diff["here"])) / (of_a + of_b))


def shown(cells: Column) -> Column:
    """A sketch as text: of each cell the number of digests and their XOR."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.lower(F.hex(c["n"])), F.lit(":"), F.lower(F.hex(c["k"])))), ",")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, fingerprint) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), paragraphs(F.coalesce(F.col(text_col), F.lit(""))).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n_paragraphs"), shown(sketch(F.col("p"))).alias("fingerprint"))


def _with_next(keys: DataFrame) -> DataFrame:
    """keys (doc_id, th, ...) with a number `row` and the next row's next_id, next_th and next_row by descending doc_id, the first
    after the last.

    Rows are dealt by ranges of doc_id, each range finds the next row inside, and the first rows of the ranges, one a
    range, give the rest.
    """
    order = [F.desc_nulls_last("doc_id"), F.asc("th")]
    dealt = cut(keys.repartitionByRange(*order).withColumns({"range": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))
    inside = Window.partitionBy("range").orderBy(*order)
    own = dealt.withColumn("next", F.lead(F.struct("doc_id", "th", "row")).over(inside)).withColumn("at", F.row_number().over(inside))
    firsts = own.where("at = 1").select("range", F.struct("doc_id", "th", "row").alias("head"))
    by_range = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a range
    after = firsts.select("range", F.coalesce(F.lead("head").over(Window.orderBy("range")), F.first("head").over(by_range)).alias("after"))
    out = own.join(F.broadcast(after), "range").withColumn("next", F.coalesce("next", "after"))
    return out.withColumns({"next_id": F.col("next.doc_id"), "next_th": F.col("next.th"), "next_row": F.col("next.row")}).drop("range", "at", "next", "after")


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    only_before and only_edited (the digests that the edit took out and put in).

    The edited text is the text with its last third replaced by as much of the start of the next document's.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    keys = cut(base.select("doc_id", "th", F.char_length("text").cast("long").alias("n_chars")).groupBy("doc_id", "th").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("copies")))
    if not keys.where("copies > 1").isEmpty():
        base = base.dropDuplicates(["doc_id", "th"])
    pairs = cut(_with_next(keys))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    after = base.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("text").alias("next_text"))
    heads = pairs.join(after, F.col("next_id").eqNullSafe(F.col("d")) & (F.col("next_th") == F.col("t"))).select("doc_id", "th", "n_chars", "copies", "row", "next_row", F.substring("next_text", F.lit(1), third).alias("head"))
    own = base.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "text")
    both = heads.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.col("head")))
    digests = cut(both.select(
        "doc_id", "n_chars", "copies", "row", "next_row", F.sha2("edited", 256).alias("edited_sha256"),
        paragraphs(F.col("text")).alias("a"), paragraphs(F.col("edited")).alias("e"),
    ))
    others = digests.select(F.col("row").alias("other"), F.col("a").alias("b"))
    rows = digests.drop("row").join(others, F.col("next_row") == F.col("other")).drop("other")
    rows = rows.withColumn("cells", SPARSE * (F.size("a") + F.greatest(F.size("e"), F.size("b"), F.lit(1))).cast("long"))
    # Both sides lie by next_row already, so the sketches and this join shuffle nothing further.
    rows = rows.join(_sparse(rows.select("next_row", "cells", "a", "e", "b")), "next_row", "left")
    # Both comparisons go by one expression, as these are long.
    rows = rows.withColumn("s", F.transform(F.array("a", "e", "b"), lambda x: sketch(x)))
    given = lambda k: (F.coalesce(F.col(f"{k}_{x}"), F.array().cast("array<long>")).alias(x) for x in ("here", "there", "mixed"))
    others = F.array(*(F.struct(F.col(k).alias("digests"), F.get("s", i).alias("s"), *given(k)) for k, i in (("e", F.lit(1)), ("b", F.lit(2)))))
    sa, se, de, db = F.get("s", F.lit(0)), F.get("s", F.lit(1)), F.get("d", F.lit(0)), F.get("d", F.lit(1))
    rows = rows.withColumn("d", F.transform(others, lambda x: _completed(F.col("a"), x["digests"], subtract(sa, x["s"]), x["here"], x["there"], x["mixed"], F.col("cells"))))
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256", shown(sa).alias("fingerprint"), shown(se).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e"), de).alias("near_edited"), likeness(F.col("a"), F.col("b"), db).alias("near_next"),
        de["here"].alias("only_before"), de["there"].alias("only_edited"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    )
    return rows.drop("copy")
