"""Each operator against brute force or the library it must equal, and the odd cases its docstring names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import best_fit_packing, bloom_fingerprint, bpe_dynamic, exact_topk, html_extraction, language_id, license_lookup, quality_gam, queries, simhash_dedup, token_counts
from gridloom.llm.common import held_out, table

SCHEMA = "doc_id long, text string, lang string, part int, rank string, id string, length long"


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["the", "der", "naïve", "word,", "x|y", "日本", "İΣ", "don't", "12", "…", "😀", "a" * 300]
    made = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 50, 400)]
    return [None, "", " ", "\n\n", "  a  b\t\nc  ", "<|endoftext|> x <|startoftext|>", *made, "same text here twice", "same text here twice", "long " * 20_000, "z" * 30_000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, 1, "r", "i", 2) for i, t in enumerate(odd_texts())]
    return spark.createDataFrame([*rows, (None, "no id", "en", 1, "r", "i", 2), rows[6], rows[6]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_simhash(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "").encode())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_fingerprints_and_components(odd):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect() if r["text"] is None or len(r["text"]) < 9000]
    found = simhash_dedup.near_duplicates(odd.where("text is null or length(text) < 9000")).collect()
    prints = {k: brute_simhash(t) for k, t in docs}
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in found) == sorted((k or -1, f"{prints[k]:016x}") for k, _ in docs)
    for r in found:
        reach, todo = set(), [r["doc_id"]]
        while todo:
            k = todo.pop()
            reach.add(k)
            todo += [j for j in prints if j not in reach and (prints[j] ^ prints[k]).bit_count() <= 3]
        assert r["component_id"] == min((k for k in reach if k is not None), default=None)


def test_simhash_links_find_every_pair(spark):
    rng = random.Random(3)
    centre = [rng.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centre for _ in range(12)} | {0, (1 << 64) - 1, 1 << 63, 7}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    got = simhash_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_simhash_bound_is_the_manhattan_distance(spark):
    rng = random.Random(9)
    pairs = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(50)]
    counts = lambda v: [(v >> 2 * i & 1) + (v >> 2 * i + 1 & 1) for i in range(32)]
    bound = F.bit_count(simhash_dedup._steps(F.col("a")).bitwiseXOR(simhash_dedup._steps(F.col("b"))))
    for r in spark.createDataFrame(pairs, "a long, b long").withColumn("n", bound).collect():
        assert r["n"] == sum(abs(x - y) for x, y in zip(counts(r["a"]), counts(r["b"]), strict=True))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1002), (1002, 1001)]
    found = {r["node"]: r["root"] for r in simhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000, 1002: 1000}


def test_keep_one_keeps_one_of_each_group(odd):
    kept = simhash_dedup.keep_one(odd.where("text is null or length(text) < 9000"))
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(6) == 1 and ids.count(None) == 1 and len(set(ids) & {0, 1, 2, 3}) == 1


def test_bpe_equals_the_library(odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    found = bpe_dynamic.encode_documents(odd, path, with_ids=True).collect()
    assert len(found) == odd.count()
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_on_random_words():
    from tokenizers import Tokenizer

    path, rng = queries.tokenizer_file("word_bpe_49k.json"), random.Random(1)
    library, own = Tokenizer.from_file(path), bpe_dynamic.encoder(path)
    texts = ["".join(rng.choice("abeht ñé'") for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["ha" * 999, "a" * 999]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_token_counts_equal_the_library(odd):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = queries.tokenizer_file("piece_bpe_32k.model")
    library = Tokenizer(models.Unigram(token_counts.vocabulary(path), 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in token_counts.count_tokens(odd, path).collect():
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]]).ids) and r["n_chars"] == len(texts[r["doc_id"]])


def test_token_counts_of_random_texts_equal_the_library():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab, rng = token_counts.vocabulary(queries.tokenizer_file("piece_bpe_32k.model")), random.Random(8)
    library = Tokenizer(models.Unigram(vocab, 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    parts = ["a", "dt", "ß", "<unk>", "<s>", "</s>", "<0x41>", "▁", "▁▁", " ", "\n", "日", "😀", "the", "ﬀ", "<0x", "<unk", "unk>", "word ", "🏽", "\u200d", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    assert token_counts.CountingViterbi(vocab).count(texts) == [len(e.ids) for e in library.encode_batch(texts)]


def test_token_count_ties_go_to_the_longer_piece():
    vocab = [("<unk>", -9.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁ab", -4.0)]
    assert token_counts.CountingViterbi(vocab).count(["ab", "", "abab"]) == [2, 0, 3]


def check_packing(rows, capacity, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}
    filled = {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        assert r["length"] == capacity or r["piece"] == 0
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_places_every_piece_once(odd):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    rows = best_fit_packing.pack(odd, queries.byte_bpe(), 256).collect()
    used, least = check_packing(rows, 256, texts)
    assert used <= least + 1 and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(r["piece"] == 0 for r in rows) == odd.count()


def test_packing_many_copies_of_one_row(spark):
    rows = spark.createDataFrame([(1, "the same text", "x", 5)] * 500, "doc_id long, text string, sequence_id string, length int").repartition(5)
    found = best_fit_packing.pack(rows, queries.byte_bpe(), 64).collect()
    used, least = check_packing(found, 64, {1: "the same text"})
    assert len({(r["sequence_id"], r["offset"]) for r in found}) == 500 and used <= -(-500 // (64 // found[0]["length"]))


def test_packing_plan_is_whole_and_tight():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([7, 64, 2048])
        histogram = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
        runs = best_fit_packing.plan(histogram, capacity)
        left = dict(histogram)
        for count, lengths in runs:
            assert count > 0 and sum(lengths) <= capacity
            for n in lengths:
                left[n] -= count
        assert not any(left.values())


def test_language_codewords_differ():
    for n in (2, 3, 4, 5, 12, 60):
        codes = language_id.codewords(n)
        assert min((codes[i] != codes[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


def test_language_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_id.fit(docs, F.col("lang"), ~held_out(), per_language=100)
    found = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97


def test_language_odd_cases(odd, empty):
    model = language_id.fit(empty, F.col("lang"), ~held_out())
    assert {r["lang_pred"] for r in language_id.predict(odd, model).collect()} == {"und"}
    rows = odd.withColumn("lang", F.lit("xx"))
    found = {r["doc_id"]: r for r in language_id.predict(rows, language_id.fit(rows, F.col("lang"), ~held_out())).collect()}
    assert found[0]["lang_pred"] == found[1]["lang_pred"] == found[2]["lang_pred"] == "und" and found[0]["score"] == 0 and found[8]["lang_pred"] == "xx"
    assert language_id.predict(empty, model).count() == 0 and language_id.keep_certain(odd, model).count() == 0


def test_language_stage_rejects_texts_of_no_known_language(spark):
    import corpus_pipeline

    rng = random.Random(3)
    letters = lambda abc, n: "".join(rng.choice(abc) for _ in range(n))
    junk = [
        "今天天气很好我们去公园散步然后回家吃饭看电视。" * 10, "Сегодня хорошая погода, мы пойдем гулять в парк, а потом домой. " * 6,
        "Tänään on kaunis sää, menemme kävelylle puistoon ja sitten palaamme kotiin syömään päivällistä. " * 5,
        "Bugün hava çok güzel, parka yürüyüşe çıkacağız, sonra eve dönüp akşam yemeği yiyeceğiz. " * 5,
        letters("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 600), letters("0123456789abcdef", 600), "zq 1234 xj5678 " * 40,
        " ".join(letters("abcdefghijklmnopqrstuvwxyz", rng.randint(2, 9)) for _ in range(80)), "12 34",
    ]
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    planted = spark.createDataFrame([(-1 - i, t, None, "junk", len(t)) for i, t in enumerate(junk)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(planted), "/root/testdata/sf0.01").select("doc_id").collect()}
    long = {r["doc_id"] for r in docs.where("n_chars >= 100").select("doc_id").collect()}
    assert min(kept) >= 0 and len(kept & long) >= 0.99 * len(long)


def test_quality_held_out(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    rows = quality_gam.score(docs, quality_gam.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93


def test_quality_odd_cases(odd, empty, spark):
    labels = spark.createDataFrame([(7, 1), (8, None), (None, 0), (9, 0), (9, 0)], "doc_id long, quality int")
    for model in (quality_gam.fit(odd, labels), quality_gam.fit(odd, labels.limit(0)), quality_gam.fit(empty, labels)):
        rows = quality_gam.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
        assert quality_gam.score(empty, model).count() == 0 and quality_gam.keep_good(odd, model, 0.0).count() == odd.count()


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.boost(x, y, pairs=1)
    assert model.pairs == [(0, 1)] and ((model.scores(x) > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize(("a", "b"), [(range(40), range(20, 60)), (range(5), range(5)), ((), (1,)), ((), ()), (range(400), range(100, 700)), (range(3), (1,))])
def test_bloom_differences_are_exact(spark, a, b):
    rows = spark.createDataFrame([([str(x) for x in a], [str(x) for x in b])], "a array<string>, b array<string>")
    rows = rows.select(*(F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in "ab"))
    cells = {c: bloom_fingerprint.sketch(F.col(c)) for c in "ab"}
    r = rows.select("a", "b", bloom_fingerprint.differences(F.col("a"), F.col("b"), cells["a"], cells["b"]).alias("d")).first()
    assert sorted(r["d"]["here"]) == sorted(set(r["a"]) - set(r["b"])) and sorted(r["d"]["there"]) == sorted(set(r["b"]) - set(r["a"]))


def test_bloom_versions(odd, empty):
    rows = bloom_fingerprint.compare_versions(odd).collect()
    assert len(rows) == odd.count() and bloom_fingerprint.compare_versions(empty).count() == 0
    docs = sorted({(r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in odd.collect()}, reverse=True)
    for i, (k, text) in enumerate(docs):
        after, n = docs[(i + 1) % len(docs)][1], len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        for r in rows:
            if (r["doc_id"] if r["doc_id"] is not None else -1) == k:
                assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
                assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and (edited != text or r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"])
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (12, 13)}) == 1


@pytest.mark.parametrize("n", [390, 500, 1700, 6000])
def test_bloom_likeness_weighs_characters(spark, n):
    """A cut version keeps about its share of characters, whichever lengths the two have."""
    rng = random.Random(n)
    words = " ".join(str(rng.random()) for _ in range(n))[:n]
    rows = spark.createDataFrame([(2, words), (1, words[: 2 * n // 3]), (0, "other")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in bloom_fingerprint.compare_versions(rows).collect()}
    # A cut inside a piece loses that piece: of at most 32, 96 or 200 characters, by where the cut falls.
    lost = lambda at: 32 if at < 192 else 96 if at < 768 else 200
    third = n // 3
    # What the edit brings in is of the same text, so it may repeat pieces, which count once.
    assert found[2]["near_edited"] >= (n - third - lost(n - third)) / n
    assert abs(found[2]["near_next"] - 0.8) <= 2 * lost(2 * third) / (n + 2 * third)
    assert abs(found[1]["near_edited"] - 0.8) <= 2 * lost(n - 5 * n // 9) / n and found[1]["near_next"] == 0


@pytest.mark.parametrize("n", [3, 5, 9, 20, 33, 47, 90, 390, 500, 1700, 6000])
def test_bloom_likeness_of_cut_versions_of_any_length(spark, n):
    """Two thirds of a text stay, so about that likeness must: within 0.08, or half of it for texts of a few words."""
    rng = random.Random(n)
    words = " ".join(str(rng.random()) for _ in range(n))[:n]
    rows = spark.createDataFrame([(2, words), (1, "other " * n)], "doc_id long, text string")
    near = {r["doc_id"]: r["near_edited"] for r in bloom_fingerprint.compare_versions(rows).collect()}[2]
    assert abs(near - 0.66) < 0.08 if n >= 390 else near > 0.4


def test_bloom_likeness_after_a_word_in_front(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    text = " ".join(" ".join(word() for _ in range(rng.randint(6, 16))) + "." for _ in range(60))[:2500]
    rows = spark.createDataFrame([(2, text), (1, "Before " + text), (0, text[:900] + " put in " + text[900:])], "doc_id long, text string")
    near = {r["doc_id"]: r["near_next"] for r in bloom_fingerprint.compare_versions(rows).collect()}
    assert near[2] > 0.9 and near[1] > 0.8 and near[0] > 0.85


def test_bloom_likeness_by_brute_force(spark, odd):
    """The likeness that peeling gives is that of the sets of digests, counted in Python."""
    rows = {r["doc_id"]: r for r in bloom_fingerprint.compare_versions(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    sets = odd.select("doc_id", bloom_fingerprint.paragraphs(F.coalesce("text", F.lit(""))).alias("p")).where("doc_id is not null").collect()
    sets = {r["doc_id"]: set(r["p"]) for r in sets}
    ids, size = sorted(sets, reverse=True), lambda s: sum(d & 255 for d in s)
    for i, k in enumerate(ids):
        a, b = sets[k], sets[ids[(i + 1) % len(ids)]]
        want = 2 * size(a & b) / (size(a) + size(b)) if a or b else 1
        assert abs(rows[k]["near_next"] - want) < 1e-9 and set(rows[k]["only_before"]) <= a


def test_bloom_sketches_grow_until_all_is_given_away(spark):
    """Sets whose differing digests share the places of the first sketches are told apart by other hashes."""
    same = [(k << 48) | 0x010203_00 | k for k in range(1, 40)]
    rows = spark.createDataFrame([(same, []), (same[:20], same[20:])], "a array<long>, b array<long>")
    found = rows.select("a", "b", bloom_fingerprint._certain(F.col("a"), F.col("b")).alias("d")).collect()
    for r in found:
        assert r["d"]["done"] and sorted(r["d"]["here"]) == sorted(r["a"]) and sorted(r["d"]["there"]) == sorted(r["b"])


@pytest.mark.parametrize(("cells", "mixed"), [(16, 500), (1, 500), (1, 3)])
def test_bloom_larger_sketches_come_of_one_grouping(spark, monkeypatch, cells, mixed):
    """Pairs that the first sketch can't tell apart are told apart by cells that are grouped, without shuffling the pairs again,
    whether few, many or too many cells hold several digests."""
    monkeypatch.setattr(bloom_fingerprint, "SPARSE", cells)
    monkeypatch.setattr(bloom_fingerprint, "MIXED", mixed)
    rng = random.Random(8)
    rows = [(k, " ".join(str(rng.random()) for _ in range(n))) for k, n in enumerate((150, 150, 1, 30, 300))] + [(5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = bloom_fingerprint.compare_versions(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"HashAggregate\(keys=\[next_row#\d+L, cell#\d+L\]", plan) and not re.search(r"Exchange hashpartitioning\([^)]*cell#", plan)
    found = {r["doc_id"]: r for r in found.collect()}
    texts = {k: t or "" for k, t in rows}
    edited = {k: t[: len(t) - len(t) // 3] + texts[(k - 1) % len(rows)][: len(t) // 3] for k, t in texts.items()}
    both = spark.createDataFrame([(k, t, edited[k]) for k, t in texts.items()], "k long, t string, e string")
    sets = {r["k"]: (set(r["a"]), set(r["e"])) for r in both.select("k", bloom_fingerprint.paragraphs(F.col("t")).alias("a"), bloom_fingerprint.paragraphs(F.col("e")).alias("e")).collect()}
    size = lambda s: sum(d & 255 for d in s)
    for k, (a, e) in sets.items():
        b, r = sets[(k - 1) % len(rows)][0], found[k]
        assert sorted(r["only_before"]) == sorted(a - e) and sorted(r["only_edited"]) == sorted(e - a)
        for x, near in ((e, r["near_edited"]), (b, r["near_next"])):
            assert abs(near - (2 * size(a & x) / (size(a) + size(x)) if a or x else 1)) < 1e-9


def test_bloom_pieces_that_come_again_count_again(spark):
    rows = spark.createDataFrame([(1, "same line\n" * 50), (0, "same line\n" * 500), (2, "ab" * 4)], "doc_id long, text string")
    found = rows.select("doc_id", "text", bloom_fingerprint.paragraphs(F.col("text")).alias("p")).withColumn("n", bloom_fingerprint.characters(F.col("p"))).collect()
    assert all(r["n"] == len(r["text"].replace("\n", "")) and len(set(r["p"])) == len(r["p"]) for r in found)


def test_numerals_are_no_letters():
    assert not any(map(language_id.LETTER.search, ("½ ² Ⅷ 12 _ 😀", "", " ."))) and all(map(language_id.LETTER.search, ("é", "日", "ª1")))


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in np.round(rng.normal(size=8), 1)], "c") for i in range(120)]
    rows += [(200, None, "c"), (250, [float("nan")] * 8, "c"), (300, [1.0, None] * 4, "c"), (None, [1.0] * 8, "c"), (350, [1.0] * 3, "c"), rows[7], rows[7], rows[50], (7, [v + 1e-4 for v in rows[7][1]], "c"), (400, rows[0][1], "c")]
    found = exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), F.col("id") % 50 == 0, k=5, segments=3, block=50).collect()
    own = [(k, np.floor(256 * np.array(v)).astype(int)) for k, v, _ in rows if k is not None and v and None not in v and len(v) == 8 and not np.isnan(v).any()]
    want = []
    for q in (0, 50, 100, 400):
        best = sorted((-int(dict(own)[q] @ v), k) for k, v in own if k != q)[:5]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == want
    assert exact_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 50 == 0).count() == 0


@pytest.mark.parametrize("size", [1, 1 << 17])
def test_topk_prunes_most_products(size):
    """With lengths that differ, and lie in a few segments, the bounds spare most products, and lose nothing."""
    rng = np.random.default_rng(5)
    v = np.floor(256 * rng.normal(size=(6000, 64)) * np.exp(-np.arange(64) / 6) * rng.exponential(1, (6000, 1))).astype(np.int64) * size
    exact = v[:300] @ v.T  # with the larger size of over 53 bits, which doubles don't hold
    ids = np.arange(6000)
    block = exact_topk.Block(ids[:300], v[:300], ids, v, 5, 8)
    at, _, score = block.leaders(0)
    cutoff = np.full(300, -np.inf)
    for q in range(300):
        cutoff[q] = score[at == q].min() if (at == q).sum() == 5 else -np.inf
    at, who, score = block.reaching(cutoff)
    for q in range(300):
        assert list(zip((-score[at == q]).tolist(), who[at == q].tolist(), strict=True)) == sorted((-int(exact[q, c]), c) for c in range(6000) if c != q)[:5]
    assert block.products < 0.5 * 300 * 6000 * 64


def test_topk_of_long_vectors(spark):
    rows = spark.createDataFrame([(i, [float(i % 7 - j % 3) for j in range(20_000)], "x") for i in range(4)], "vec_id long, embedding array<double>, rank string")
    found = exact_topk.top_k(rows, F.col("id") == 0, k=2).collect()
    v = {i: np.array([256 * (i % 7 - j % 3) for j in range(20_000)]) for i in range(4)}
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found] == [(i + 1, k, -s) for i, (s, k) in enumerate(sorted((-int(v[0] @ v[k]), k) for k in (1, 2, 3))[:2])]


def test_license_texts_are_found_in_other_dress(spark, empty):
    name, text = license_lookup.KNOWN[0]
    dressed = "Copyright (c) 2020 Somebody\n\n" + text.upper().replace(" ", "\n * ").replace("SUBLICENSE", "sub-licence")
    docs = spark.createDataFrame([(1, dressed), (2, text + " and more"), (3, None), (4, "Some words\nReleased under the MIT Licence!\nmore")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_lookup.scan(docs).collect()}
    assert found[1]["license"] == name and found[2]["license"] is None and found[3]["license"] is None and found[3]["notices"] == []
    assert found[4]["notices"] == ["MIT-notice"] and found[4]["license"] is None
    assert license_lookup.scan(empty).count() == 0


def test_license_spellings_and_lines(spark):
    """A word that comes again is spelled anew each time; a line of any words is found; rows may repeat and lack an id."""
    known = spark.createDataFrame([("L", "license license sublicense sublicense"), ("W", "All wrongs reversed.")], "license string, text string")
    rows = [(1, "licence licence sub-licence sub licence", 5, "x"), (2, "a\nall WRONGS reversed", 5, "x"), (2, "a\nall WRONGS reversed", 5, "x"), (None, "all wrongs reversed", 5, "x"), (3, "word " * 200_000, 5, "x")]
    found = license_lookup.scan(spark.createDataFrame(rows, "doc_id long, text string, digest int, license string"), known).collect()
    assert sorted((str(r["doc_id"]), str(r["license"]), r["notices"]) for r in found) == [("1", "L", ["L"]), ("2", "None", ["W"]), ("2", "None", ["W"]), ("3", "None", []), ("None", "W", ["W"])]


def test_licenses_are_found_in_their_usual_form(spark):
    """With a title, whole texts of the long licences, and lines of a caller's table that name no licence, for any size of table."""
    from importlib import resources

    known = dict(license_lookup.KNOWN[:6])
    docs = {
        1: ("MIT", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + known["MIT"]), 2: ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2021, X\nAll rights reserved.\n\n" + known["BSD-3-Clause"]),
        **{i: (n, resources.files("gridloom.llm").joinpath("licenses", f"{n}.txt").read_text("utf-8")) for i, n in enumerate(license_lookup.FILES, 3)},
    }
    docs[50] = ("Apache-2.0", docs[3][1].split("APPENDIX")[0])
    rows = spark.createDataFrame([(k, t) for k, (_, t) in docs.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in license_lookup.scan(rows).collect()} == {k: n for k, (n, _) in docs.items()}
    own = spark.createDataFrame([("WTFPL", "Do what you want to."), ("B", "As you like it")], "license string, text string")
    lines = spark.createDataFrame([(1, "x\nDo what you want to\nas you LIKE it!"), (1, "x\nDo what you want to\nas you LIKE it!"), (None, "y"), (2, None)], "doc_id long, text string")
    for table_of in (own, own.repartition(3)):
        found = license_lookup.scan(lines, table_of).collect()
        assert sorted((str(r["doc_id"]), r["notices"]) for r in found) == [("1", ["B", "WTFPL"])] * 2 + [("2", []), ("None", [])]


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=1>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy, now!</div><div id=wrap><article><h1>A   title</h1><p>First &amp; <b>bold</b>, long enough text.<br>Next
line.<p>Short<script>var x="</p>";</script></article><aside>Related, things.</aside><section class="comments"><p>Nice, very nice article, I say.</p></section></div>
<form><label>Mail</label></form><footer>&copy; all</footer>"""


def test_html_extraction(spark):
    want = "A title\n\nFirst & bold, long enough text. Next line.\n\nShort"
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "plain  text"), (5, "u", "<div><p>cut off &eacute;<b"), (1, "u", PAGE), (6, "u", "<p>x " + "y, " * 50_000)]
    found = html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    texts = [(r["page_id"], r["text"], r["n_chars"]) for r in found]
    assert texts[:6] == [(1, want, len(want)), (2, "", 0), (3, "", 0), (None, "plain text", 10), (5, "cut off é", 9), (1, want, len(want))]
    assert texts[6][2] == 2 + 3 * 50_000 - 1


def test_html_extraction_without_hints():
    long = "A sentence of some length, with commas, and more of it. " * 3
    page = f"<body><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div><div><h2>Head</h2><p>{long}</p><p>{long}</p><p>Hm.</p></div></div><div><span>x</span></div>"
    assert html_extraction.main_text(page) == "\n\n".join(["Head", long.strip(), long.strip(), "Hm."])


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "site-content no-sidebar", "layout has-sidebar", "sidebar", "share-page"])
def test_html_names_of_layout_keep_the_article(name):
    long = "A sentence of some length, with commas, and more of it. " * 3
    inside = f"<div class='article-header'><h1>Head</h1></div><p>{long}</p><p>{long}</p><div class='share'>Share this, now.</div>"
    want = "\n\n".join(["Head", long.strip(), long.strip()])
    assert html_extraction.main_text(f"<body><div class='{name}'><main>{inside}</main><div class='sidebar'><p>Other, things.</p></div></div></body>") == want
    assert html_extraction.main_text(f"<body><div class='{name}'><div>{inside}</div></div><div class='menu'><p>Other, things.</p></div></body>") == want
    assert html_extraction.main_text(f"<body><div>{inside}</div><div class='related'><article><p>Other, things.</p></article></div></body>") == want


LONG = "A sentence of some length, with commas, and more of it. " * 3
PARAGRAPHS, PLAIN = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>", "\n\n".join(["Head", LONG.strip(), LONG.strip()])


@pytest.mark.parametrize("name", ["class='content with-sidebar'", "class='legal-analysis'", "id='search-results-study'"])
def test_html_names_never_drop_most_of_the_content(name):
    assert html_extraction.main_text(f"<body><nav><a>x</a></nav><div {name}>{PARAGRAPHS}</div><footer>c</footer></body>") == PLAIN


def test_html_attributes_and_inline_names():
    page = f"<article><h1>Head</h1><p title=it's>{LONG}</p><p>Don't <span class='notice'>stop</span> here.</p><p class=x>{LONG}</p><ul><li><a href=1>Ref one</a><li><a href=2>Ref two</a></ul><p><span class=share>Share it</span></p></article>"
    assert html_extraction.main_text(page) == "\n\n".join(["Head", LONG.strip(), "Don't stop here.", LONG.strip(), "Ref one", "Ref two"])
    assert html_extraction.main_text(f"<div><p>{LONG}</p><p>Seen <span style='display: none'>not</span> here</p></div>") == f"{LONG.strip()}\n\nSeen here"


def test_html_ratios_decide(monkeypatch):
    """The article is where the paths of long, punctuated blocks are: the same page with flat ratios gives another text."""
    entries = "".join(f"<td>entry {i} of the table of all places and names</td>" for i in range(40))
    page = f"<body><table><tr>{entries}</tr></table><div><div>{PARAGRAPHS}</div></div></body>"
    assert html_extraction.main_text(page) == PLAIN
    monkeypatch.setattr(html_extraction, "ratios", lambda page: {page.nodes[b.node].path: 1.0 for b in page.blocks})
    assert html_extraction.main_text(page) != PLAIN


def test_html_keeps_all_parts_of_an_article():
    parts = f"<div>{PARAGRAPHS}<p>{LONG * 2}</p></div><div><p>{LONG}</p></div>"
    assert html_extraction.main_text(f"<body><div><ul><li><a>One</a><li><a>Two</a></ul></div><div>{parts}</div><div><p>Short line.</p></div></body>") == f"{PLAIN}\n\n{(LONG * 2).strip()}\n\n{LONG.strip()}"
    assert html_extraction.main_text(f"<body><div><p>{LONG * 5}</p><p>Short.</p></div></body>") == f"{(LONG * 5).strip()}\n\nShort."


@pytest.mark.parametrize("piece", ['<span class="ad">x', "<div>x", "<td>x", "<ul><li>x", '<a href="x', "<p a='", "<b =", "<table><tr><td></td>", "</p>", "<!--", "<p>x</p><li>"])
def test_html_takes_time_in_proportion(piece):
    import time

    began = time.process_time()
    html_extraction.main_text(piece * 20_000)
    assert time.process_time() - began < 3


@pytest.mark.parametrize("name", ["subscribe-rates", "share-price", "popular", "legal", "tags follow"])
def test_html_words_of_the_article_stay(name):
    for tag in ("p", "div", "section"):
        kept = f"<{tag} class='{name}'>{'' if tag == 'p' else '<p>'}{LONG}</{tag}>"
        assert html_extraction.main_text(f"<body><article>{PARAGRAPHS}{kept}</article></body>") == f"{PLAIN}\n\n{LONG.strip()}"
    for gone in ("ad", "ad-slot", "comments", "newsletter", "related-posts"):
        assert html_extraction.main_text(f"<body><article>{PARAGRAPHS}<div class='{gone}'><p>{LONG}</p></div></article></body>") == PLAIN


@pytest.mark.parametrize("depth", [400, 600, 30_000])
def test_html_depth_changes_nothing(depth):
    page = "<div>" * depth + f"<article>{PARAGRAPHS}</article><nav><p>Menu one two, three.</p></nav><footer><p>Made by us, all.</p></footer>" + "</div>" * depth
    assert html_extraction.main_text(page) == PLAIN


def test_html_without_names_on_the_pages_of_the_tables():
    """Where nothing is named and all is a div, nearly all blocks are found by their paths' ratios."""
    import pyarrow.parquet as pq

    found = extra = lost = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        bare = re.sub(r"<(/?)(article|main|header|footer|nav|aside|section|figure)\b", r"<\1div", re.sub(r"\s(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page))
        want, got = (html_extraction.main_text(x).split("\n\n") for x in (page, bare))
        found, extra, lost = found + len(want), extra + len(set(got) - set(want)), lost + len(set(want) - set(got))
    assert found > 2000 and extra < 0.01 * found and lost < 0.003 * found


def test_language_of_very_many_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, (letters[i % 26] + letters[i // 26 % 26]) * 40, f"l{i % 600:03}") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.col("lang"), F.lit(True), buckets=256, rounds=20, most_rows=400)
    assert len(model.languages) == 20 and language_id.predict(docs, model).count() == 1800


def test_topk_scores_fit(spark):
    rows = [(50, [1.0, 2.0]), (1, [1e300, 1.0]), (2, [3.0, 1.0]), (3, [-1e30, 0.0]), (4, [2.0**20, -(2.0**20)])]
    found = exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0, k=5).collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(2, 256 * 256 * 5), (4, -(256 * 256 << 20))]


def test_html_tables(spark, empty):
    pages = spark.createDataFrame([(1, "u", PAGE, "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    row = html_extraction.extract(pages).first()
    assert row["n_chars"] == len(row["text"]) and html_extraction.extract(pages.limit(0)).count() == 0


def test_pages_of_the_test_tables(spark):
    for r in queries.op1_tag_path_extraction(spark, "/root/testdata/sf0.001").collect():
        assert r["text"] and "&amp;" not in r["text"] and r["n_chars"] == len(r["text"])


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    kept, frame = dict(docs), table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, sf_dir)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        now = {r["doc_id"]: r["text"] for r in frame.collect()}
        assert now.items() <= kept.items()
        if name == "near_duplicates":
            prints = {k: brute_simhash(t) for k, t in kept.items()}
            left = set(prints)
            groups = 0
            while left:
                todo, groups = [left.pop()], groups + 1
                while todo:
                    k = todo.pop()
                    near = {j for j in left if (prints[j] ^ prints[k]).bit_count() <= 3}
                    left -= near
                    todo += near
            assert len(now) == groups
        kept = now
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    used, least = check_packing(rows, 2048, kept)
    assert {r["doc_id"] for r in rows} == set(kept) and used <= least + 1


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


def written(spark, folder, docs, labels):
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    folder = written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, folder, "documents"), folder).count() == 0


def test_pipeline_of_odd_rows_without_labels(spark, tmp_path):
    """Null ids and texts, repeated rows, no labels: all with a letter are one language and stay, but near-duplicates."""
    import corpus_pipeline

    texts = [t for t in odd_texts() if t is None or len(t) < 9000]
    docs = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, "no id at all here", "en", "s", 1), (5, texts[5], "en", "s", 1), (5, texts[5], "en", "s", 1)]
    folder, frame = written(spark, tmp_path, docs, []), None
    frame = table(spark, folder, "documents")
    assert corpus_pipeline.quality(spark, frame, folder).count() == len(docs)
    kept = corpus_pipeline.language(spark, frame, folder)
    assert {r["doc_id"] for r in kept.collect()} <= {d[0] for d in docs if d[1] and language_id.LETTER.search(d[1])}
    once = corpus_pipeline.near_duplicates(spark, frame, folder).collect()
    assert [r["doc_id"] for r in once].count(5) == 1 and [r["doc_id"] for r in once].count(None) == 1
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_language_decoding_by_brute_force(spark):
    """n-grams, losses and scores of a model, counted one by one in plain Python."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = language_id.fit(docs, F.col("lang"), ~held_out(), per_language=30, buckets=1024)
    mask, texts = (1 << 64) - 1, ["The rest of it.", "und die", "é", "x" * 500, "日本 12"]
    lang, score, unsure = model.predict(texts)
    for i, t in enumerate(texts):
        counts, code = [0] * 1024, [32, *map(ord, t.lower()), 32]
        for n in (1, 2, 3):
            for k in range(len(code) - n + 1):
                h = 0
                for c in code[k : k + n]:
                    h = (h * 0x100000001B3 + c + 1) * 0x9E3779B97F4A7C15 & mask
                counts[h >> 54] += 1
        share = [(c / sum(counts)) ** 0.5 for c in counts]
        margin = [sum(s * w for s, w in zip(share, model.weights[:, b], strict=True)) + model.bias[b] for b in range(model.codes.shape[1])]
        loss = [sum(np.log1p(np.exp(-m * c)) * w for m, c, w in zip(margin, code_, model.trust, strict=True)) for code_ in model.codes]
        p = sorted((np.exp(min(loss) - x) / sum(np.exp(min(loss) - y) for y in loss) for x in loss), reverse=True)
        assert lang[i] == model.languages[int(np.argmin(loss))] and score[i] == pytest.approx(p[0], abs=1e-4)
        assert unsure[i] == (p[0] - p[1] < 0.2) or abs(p[0] - p[1] - 0.2) < 1e-3


def test_quality_scores_by_brute_force():
    """A score is the sum of looked-up numbers, through the logistic function."""
    rng = np.random.default_rng(1)
    x = rng.random((400, 4))
    model = quality_gam.boost(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), bins=6, rounds=10, pairs=2, pair_rounds=5)
    found = model.scores(x)
    for i in range(0, 400, 7):
        at = [sum(e <= v for e in edges) for v, edges in zip(x[i], model.edges, strict=True)]
        total = model.base + sum(t[k] for t, k in zip(model.tables, at, strict=True)) + sum(t[at[a]][at[b]] for t, (a, b) in zip(model.pair_tables, model.pairs, strict=True))
        assert found[i] == pytest.approx(1 / (1 + np.exp(-total)))


def test_language_ties_go_to_the_first(spark):
    text = "the same words in both of them"
    rows = spark.createDataFrame([(i, text, ("bb", "aa")[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.fit(rows, F.col("lang"), F.lit(True), buckets=256)
    found = language_id.predict(rows, model).collect()
    assert {r["lang_pred"] for r in found} == {"aa"} and {r["ambiguous"] for r in found} == {True} and len(found) == 40


def test_empty_tables(empty):
    assert simhash_dedup.near_duplicates(empty).count() == 0 and simhash_dedup.keep_one(empty).count() == 0
    assert best_fit_packing.pack(empty, queries.byte_bpe()).count() == 0
    assert bpe_dynamic.encode_documents(empty, queries.tokenizer_file("word_bpe_49k.json")).count() == 0
    assert token_counts.count_tokens(empty, queries.tokenizer_file("piece_bpe_32k.model")).count() == 0
