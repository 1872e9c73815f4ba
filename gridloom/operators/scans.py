"""Ordered columns without one task that sees a whole column or a whole key.

Rows are dealt by ranges of (partition, order), computed once, and kept sorted; Spark's range partitioning cuts through hot
keys. What runs along the rows is found in each range by itself and then joined to what comes before it, its carry. Only
a key that goes on from one range into the next needs one, so there are fewer carries than ranges, and they are broadcast. Frames of
a few rows get the last rows of the ranges before (and the first of those after) as a halo.

The order should be unique; nulls come first in it. Partitions may be null, which is a partition of its own; without one the
whole table is one column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from gridloom.operators.running import checkpointed, numbered, totals_before

_plus = lambda a, b: F.coalesce(a + b, a, b)
_times = lambda a, b: F.coalesce(a * b, a, b)
#: How a part is found among rows, how the parts of ranges are put together, and how a carry is added.
KINDS = {
    "sum": (F.sum, F.sum, _plus),
    "count": (F.count, F.sum, _plus),
    "product": (F.product, F.product, _times),
    "max": (F.max, F.max, F.greatest),
    "min": (F.min, F.min, F.least),
    "last": (None, lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


class Ranges:
    """Rows dealt by ranges; `rows` has them with __range, and its n-th partition is the n-th range, sorted."""

    def __init__(self, df: DataFrame, partition: list[str], order: list[str]):
        self.keys, self.order = list(partition), list(order)
        by = [*self.keys, *self.order]
        dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
        self.rows = checkpointed(dealt.withColumn("__range", F.spark_partition_id()))
        self.columns = df.columns

    @cached_property
    def sizes(self) -> dict[int, int]:
        """The number of rows of each range that has any."""
        return {r["__range"]: r["n"] for r in self.rows.groupBy("__range").agg(F.count("*").alias("n")).collect()}

    @cached_property
    def count(self) -> int:
        return max(self.sizes, default=0) + 1

    def _same(self, other: DataFrame) -> tuple[DataFrame, Column]:
        """other with its keys and range renamed, and the condition that they are a row's."""
        names = [*self.keys, "__range"]
        renamed = other.withColumnsRenamed({k: f"__c_{i}" for i, k in enumerate(names)})
        return renamed, self._all([F.col(k).eqNullSafe(F.col(f"__c_{i}")) if k != "__range" else F.col(k) == F.col(f"__c_{i}") for i, k in enumerate(names)])

    @staticmethod
    def _all(conditions: list[Column]) -> Column:
        out = conditions[0]
        for c in conditions[1:]:
            out &= c
        return out

    def placed(self) -> DataFrame:
        """The rows, each range in one partition, so that windows by range need no shuffle of their own."""
        return self.rows.repartitionById(self.count, "__range")

    def _window(self, backward: bool = False) -> WindowSpec:
        order = [F.col(c).desc_nulls_last() if backward else F.col(c).asc_nulls_first() for c in self.order]
        return Window.partitionBy("__range", *self.keys).orderBy(*order)

    def accumulated(self, parts: dict[str, tuple[str, str]], backward: bool = False, rows: DataFrame | None = None) -> DataFrame:
        """The rows with, for each name: (kind, column) in parts, the sum, count, product, greatest, least or last known value
        from the first row of the key up to this one (backward: from the last down to this one)."""
        source = self.rows if rows is None else rows
        rows = self.placed() if rows is None else rows
        key = F.struct(*self.order)
        pick = F.min_by if backward else F.max_by
        whole = {n: pick(F.col(c), F.when(F.col(c).isNotNull(), key)) if kind == "last" else KINDS[kind][0](c) for n, (kind, c) in parts.items()}
        segments = source.groupBy(*self.keys, "__range").agg(*(v.alias(f"__p_{n}") for n, v in whole.items()))
        along = Window.partitionBy(*self.keys).orderBy(F.desc("__range") if backward else F.asc("__range"))
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        carries = segments.withColumn("__at", F.row_number().over(along)).withColumns({f"__p_{n}": KINDS[kind][1](F.col(f"__p_{n}")).over(before) for n, (kind, _) in parts.items()}).where("__at > 1").drop("__at")
        carries, same = self._same(carries)
        inside = self._window(backward).rowsBetween(Window.unboundedPreceding, 0)
        here = {n: (F.last(c, ignorenulls=True) if kind == "last" else KINDS[kind][0](c)).over(inside) for n, (kind, c) in parts.items()}
        both = rows.withColumns({f"__h_{n}": v for n, v in here.items()}).join(F.broadcast(carries), same, "left")
        made = {n: KINDS[kind][2](F.col(f"__p_{n}"), F.col(f"__h_{n}")) for n, (kind, _) in parts.items()}
        return both.withColumns(made).drop(*carries.columns, *(f"__h_{n}" for n in parts))

    def framed(self, made: dict[str, Callable[[WindowSpec], Column]], before: int = 0, after: int = 0) -> DataFrame:
        """The rows with columns made over a window of each key whose frames reach so many rows back and ahead."""
        order, copies = sorted(self.sizes), []
        for i, to in enumerate(order):
            for rows, ranges in ((before, reversed(order[:i])), (after, order[i + 1 :])):
                for r in ranges:
                    if rows <= 0:
                        break
                    n = min(rows, self.sizes[r])
                    copies.append((r, to, self.sizes[r] - n + 1 if r < to else 1, self.sizes[r] if r < to else n))
                    rows -= n
        rows = self.placed().withColumn("__halo", F.lit(False))
        if copies:
            which = F.broadcast(self.rows.sparkSession.createDataFrame(copies, "__from int, __to int, __a int, __b int"))
            at = F.row_number().over(Window.partitionBy("__range").orderBy(*(F.col(c).asc_nulls_first() for c in (*self.keys, *self.order))))
            halo = self.placed().withColumn("__at", at).join(which, F.col("__range") == F.col("__from")).where("__at between __a and __b")
            halo = halo.withColumns({"__range": F.col("__to"), "__halo": F.lit(True)}).select(*rows.columns)
            rows = rows.unionByName(halo).repartitionById(self.count, "__range")
        w = self._window()
        return rows.withColumns({n: f(w) for n, f in made.items()}).where("not __halo").drop("__halo")

    def followed(self, c: str, out: str, model: Model, always: bool = False) -> DataFrame:
        """The rows with the state of a model after each: null before its first known value, and unless `always` where c is null.

        A first pass gives what the first and the last key of each range do to a state; they are followed up over the ranges
        here, two rows a range; a second pass starts each range with the state that its first key brings.
        """
        key = "__key"
        rows = self.rows.withColumn(key, F.xxhash64(*self.keys) if self.keys else F.lit(0).cast("long"))
        width, size = model.width, model.size

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first = last = None
            at = None
            for b in batches:
                for k, run in b.groupby(key, sort=False):
                    at = int(run["__range"].iloc[0])
                    new = model.summary(run[c].to_numpy(dtype=float, na_value=np.nan))
                    if last is not None and last[0] == k:
                        last = (k, model.joined(last[1], new))
                    else:
                        first, last = first or last, (k, new)
            if last is not None:
                for kind, s in ((0, first), (1, last)):
                    if s is not None:
                        whole, own = s[1]
                        yield pd.DataFrame([[at, kind, s[0], own is not None, *whole, *(own if own is not None else [np.nan] * size)]], columns=names)

        names = ["__range", "kind", key, "known", *(f"e{i}" for i in range(width)), *(f"s{i}" for i in range(size))]
        schema = f"__range int, kind int, {key} long, known boolean, " + ", ".join(f"{n} double" for n in names[4:])
        ends = rows.select("__range", key, F.col(c).cast("double").alias(c)).mapInPandas(sums, schema).orderBy("__range", "kind").collect()
        carries, held, who = {}, None, None
        for r in ends:  # a range has one row, of the key that fills it, or two
            own = np.array(r[4 + width :]) if r["known"] else None
            goes_on = who == r[key] and held is not None
            if goes_on and r["__range"] not in carries:
                carries[r["__range"]] = (r[key], held)
            held = model.applied(np.array(r[4 : 4 + width])[None], held)[0] if goes_on else own
            who = r[key]
        dtypes = [(n, t) for n, t in rows.dtypes if n not in ("__range", key)]
        targets = model.names(out)

        def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            who = state = None
            for b in batches:
                if len(b) and who is None:
                    who, state = carries.get(int(b["__range"].iloc[0]), (None, None))
                made = np.full((len(b), len(targets)), np.nan)
                for k, at in b.groupby(key, sort=False).indices.items():
                    x = b[c].to_numpy(dtype=float, na_value=np.nan)[at]
                    made[at], state = model.run(x, state if k == who else None)
                    if not always:
                        made[at[np.isnan(x)]] = np.nan
                    who = k
                yield b.drop(columns=["__range", key]).assign(**{n: pd.Series(made[:, i], b.index) for i, n in enumerate(targets)})

        found = rows.mapInPandas(follow, ", ".join(f"`{n}` {t}" for n, t in [*dtypes, *((n, "double") for n in targets)]))
        return found.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in targets})


class Model:
    """A state that each known value moves. A row's step is a few numbers; steps can be joined in any grouping, so a run of rows is
    taken together, by doubling, and ranges can be summed up apart."""

    width = size = 1

    def names(self, out: str) -> list[str]:
        return [out]

    def steps(self, x: np.ndarray) -> np.ndarray:
        """(rows, width): the step of each value, NaN being unknown."""
        raise NotImplementedError

    def combined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Steps a, then b."""
        raise NotImplementedError

    def applied(self, steps: np.ndarray, state: np.ndarray) -> np.ndarray:
        """(rows, size): where each step leads from one state."""
        raise NotImplementedError

    def start(self, x: float) -> np.ndarray:
        raise NotImplementedError

    def prefixes(self, steps: np.ndarray) -> np.ndarray:
        out, far = steps.copy(), 1
        while far < len(out):
            out[far:] = self.combined(out[:-far], out[far:])
            far *= 2
        return out

    def run(self, x: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """The states after each value, and the last."""
        made, at = np.full((len(x), self.size), np.nan), 0
        if state is None:
            known = np.flatnonzero(~np.isnan(x))
            if not len(known):
                return made, None
            at, state = int(known[0]) + 1, self.start(float(x[known[0]]))
            made[at - 1] = state
        for i in range(at, len(x), 4096):
            made[i : i + 4096] = self.applied(self.prefixes(self.steps(x[i : i + 4096])), state)
            state = made[min(i + 4096, len(x)) - 1]
        return made, state

    def summary(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """All steps as one, and the state they lead to when none came before."""
        whole = None
        for i in range(0, len(x), 4096):
            part = self.prefixes(self.steps(x[i : i + 4096]))[-1]
            whole = part if whole is None else self.combined(whole[None], part[None])[0]
        return whole, self.run(x, None)[1]

    def joined(self, a: tuple, b: tuple) -> tuple:
        return self.combined(a[0][None], b[0][None])[0], (b[1] if a[1] is None else self.applied(b[0][None], a[1])[0])


class Smoothing(Model):
    """Exponential smoothing: a known value moves the mean by the share alpha of its distance."""

    width, size = 2, 1

    def __init__(self, alpha: float):
        self.alpha = alpha

    def steps(self, x):
        known = ~np.isnan(x)
        return np.stack([np.where(known, 1 - self.alpha, 1.0), np.where(known, self.alpha * np.where(known, x, 0), 0.0)], axis=1)

    def combined(self, a, b):
        return np.stack([a[:, 0] * b[:, 0], a[:, 1] * b[:, 0] + b[:, 1]], axis=1)

    def applied(self, steps, state):
        return (steps[:, 0] * state[0] + steps[:, 1])[:, None]

    def start(self, x):
        return np.array([x])


class LocalLevel(Model):
    """A Kalman filter of one hidden value that drifts and is seen with noise; the state is (mean, variance). A step is that of
    the filter given any earlier state: how the mean is taken along (a, b), what variance comes in (c), and what its values
    tell of the state before (e, j)."""

    width, size = 5, 2

    def __init__(self, drift: float, noise: float):
        self.drift, self.noise = drift, noise

    def names(self, out):
        return [out, f"{out}_variance"]

    def steps(self, x):
        known, all_ = ~np.isnan(x), self.drift + self.noise
        gain = np.where(known, self.drift / all_, 0.0)
        z = np.where(known, x, 0.0)
        return np.stack([1 - gain, gain * z, (1 - gain) * self.drift, z / all_, np.where(known, 1 / all_, 0.0)], axis=1)

    def combined(self, a, b):
        a1, b1, c1, e1, j1 = a.T
        a2, b2, c2, e2, j2 = b.T
        d = 1 + c1 * j2
        return np.stack([a1 * a2 / d, a2 * (b1 + c1 * e2) / d + b2, a2 * a2 * c1 / d + c2, a1 * (e2 - j2 * b1) / d + e1, a1 * a1 * j2 / d + j1], axis=1)

    def applied(self, steps, state):
        mean, var = state
        a, b, c, e, j = steps.T
        d = 1 + var * j
        return np.stack([a * (mean + var * e) / d + b, a * a * var / d + c], axis=1)

    def start(self, x):
        return np.array([x, self.noise])


def _kept(ranges: Ranges, rows: DataFrame, *out: str) -> DataFrame:
    return rows.select(*ranges.columns, *out)


def _known(c: str, value: Column) -> Column:
    return F.when(F.col(c).isNotNull(), value)


def cumulative(df: DataFrame, op: str, c: str, out: str, partition: list[str], order: list[str]) -> DataFrame:
    """Running sum, product, max, min, mean or var (of the sample); null where c is. log_product is the logarithm of the running
    product of values above 0, however large or small that gets; from a value of 0 or less on it is null."""
    if op == "log_product":
        return _log_product(df, c, out, partition, order)
    ranges = Ranges(df, partition, order)
    if op in KINDS:
        rows = ranges.accumulated({"__a": (op, c)})
        return _kept(ranges, rows.withColumn(out, _known(c, F.col("__a"))), out)
    # About the middle of all values the squares don't cancel.
    middle = F.broadcast(ranges.rows.agg(F.avg(c).alias("__m")))
    shifted = ranges.placed().join(middle).withColumn("__d", F.col(c) - F.col("__m")).withColumn("__q", F.col("__d") * F.col("__d"))
    rows = ranges.accumulated({"__n": ("count", c), "__s": ("sum", "__d"), "__t": ("sum", "__q")}, rows=shifted)
    n, s, t = F.col("__n"), F.col("__s"), F.col("__t")
    made = {"mean": F.col("__m") + s / n, "var": F.when(n > 1, (t - s * s / n) / F.nullif(n - 1, F.lit(0)))}[op]
    return _kept(ranges, rows.withColumn(out, _known(c, made)), out)


def _log_product(df: DataFrame, c: str, out: str, partition: list[str], order: list[str]) -> DataFrame:
    """Logarithms are summed in two parts: multiples of 2^-32, whose sums are exact up to 2^20, and what is left of them."""
    log = F.ln(F.col(c).cast("double"))
    high = F.round(log * F.lit(2.0**32)) / F.lit(2.0**32)
    logs = df.withColumns({"__h": high, "__l": log - high, "__bad": F.when(F.col(c) <= 0, F.lit(1))})
    rows = Ranges(logs, partition, order).accumulated({"__a": ("sum", "__h"), "__b": ("sum", "__l"), "__n": ("count", "__bad")})
    made = F.when((F.col("__n") == 0) & F.col(c).isNotNull(), F.col("__a") + F.col("__b"))
    return rows.withColumn(out, made).select(*df.columns, out)


def drawdown(df: DataFrame, c: str, out: str, partition: list[str], order: list[str]) -> DataFrame:
    """How far a value lies below the highest so far, in per cent."""
    ranges = Ranges(df, partition, order)
    rows = ranges.accumulated({"__a": ("max", c)})
    return _kept(ranges, rows.withColumn(out, F.try_divide(F.col("__a") - F.col(c), F.col("__a")) * 100), out)


def framed(df: DataFrame, made: dict[str, Callable[[WindowSpec], Column]], partition: list[str], order: list[str], before: int = 0, after: int = 0) -> DataFrame:
    """Any columns of `windows` or `signals` whose frames reach a known number of rows back and ahead: rolling values, differences,
    shifts, moving averages, filters, peaks, sign changes."""
    ranges = Ranges(df, partition, order)
    return _kept(ranges, ranges.framed(made, before, after), *made)


def filled(df: DataFrame, c: str, out: str, partition: list[str], order: list[str], method: str = "forward") -> DataFrame:
    """The last known value before (forward), the next after (backward), or between both by the number of rows (linear), which
    beyond the known values is the nearest."""
    ranges = Ranges(df, partition, order)
    if method != "linear":
        return _kept(ranges, ranges.accumulated({"__a": ("last", c)}, backward=method == "backward").withColumn(out, F.col("__a")), out)
    rows = ranges.accumulated({"__i": ("count", "__one")}, rows=ranges.placed().withColumn("__one", F.lit(1)))
    rows = rows.withColumn("__v", _known(c, F.struct(F.col(c).cast("double").alias("v"), F.col("__i").alias("i"))))
    rows = ranges.accumulated({"__a": ("last", "__v")}, rows=rows)
    rows = ranges.accumulated({"__b": ("last", "__v")}, backward=True, rows=rows)
    a, b = F.col("__a"), F.col("__b")
    between = a["v"] + (b["v"] - a["v"]) * (F.col("__i") - a["i"]) / F.nullif(b["i"] - a["i"], F.lit(0))
    return _kept(ranges, rows.withColumn(out, F.coalesce(F.col(c).cast("double"), between, a["v"], b["v"])), out)


def ewm_mean(df: DataFrame, c: str, span: int, out: str, partition: list[str], order: list[str]) -> DataFrame:
    """Exponentially weighted mean, recursive: the first known value, then alpha = 2 / (span + 1) of each known one."""
    ranges = Ranges(df, partition, order)
    return ranges.followed(c, out, Smoothing(2 / (span + 1)))


def local_level(df: DataFrame, c: str, out: str, partition: list[str], order: list[str], drift: float, noise: float) -> DataFrame:
    """A Kalman filter's estimate (out) and {out}_variance after each row; its first known value starts it."""
    return Ranges(df, partition, order).followed(c, out, LocalLevel(drift, noise), always=True)


def beside_value(df: DataFrame, found: DataFrame, names: list[str], made: Column, out: str, share: int = 1000) -> DataFrame:
    """df with a column from one row for each value, n of which stand in df; the values with over 1/share of the rows, fewer than
    `share`, are joined by broadcast, the rest by shuffle."""
    told = checkpointed(found.withColumn("__out", made).select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(names)), "n", "__out"))
    limit = (told.agg(F.sum("n")).first()[0] or 0) / share
    same = Ranges._all([F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)])
    hot, rest = F.broadcast(told.where(F.col("n") > limit)), told.where(F.col("n") <= limit)
    columns = [*df.columns, F.col("__out").alias(out)]
    rows = df.join(hot, same, "left_anti").join(rest, same, "left").select(*columns)
    return rows.unionByName(df.join(hot, same).select(*columns))


def rank(df: DataFrame, c: str, out: str, partition: list[str] = (), method: str = "average") -> DataFrame:
    """average, min, max or dense rank of each value among those of its partition, from 1; null has none.

    Values are counted before they are ranked, so a frequent one is one row then."""
    keys = list(partition)
    counted = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("one"))
    placed = checkpointed(totals_before(counted, [*keys, c], ["n", "one"]))
    first = placed.groupBy(*keys).agg(F.min("before_n").alias("__n0"), F.min("before_one").alias("__o0"))
    starts = first.withColumnsRenamed({k: f"__g{i}" for i, k in enumerate(keys)})
    placed = placed.join(starts, Ranges._all([F.col(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)])) if keys else placed.join(F.broadcast(starts))
    low = F.col("before_n") - F.col("__n0")
    made = {"min": low + 1, "max": low + F.col("n"), "average": low + (F.col("n") + 1) / 2, "dense": F.col("before_one") - F.col("__o0") + 1}[method]
    return beside_value(df, placed, [*keys, c], made.cast("double"), out)


def qcut(df: DataFrame, c: str, q: int, out: str, order: list[str]) -> DataFrame:
    """floor(rank * q / n) over a whole column, with ranks from 0 and ties by the order; null has none."""
    known = df.where(F.col(c).isNotNull())
    placed = numbered(known, [c, *order], "__at").join(F.broadcast(known.agg(F.count("*").alias("__n"))))
    made = placed.withColumn(out, F.floor(F.col("__at") * q / F.col("__n")).cast("int")).select(*df.columns, out)
    return made.unionByName(df.where(F.col(c).isNull()).withColumn(out, F.lit(None).cast("int")))


def hot_keys(df: DataFrame, keys: list[str], share: int = 100) -> DataFrame | None:
    """The keys with over 1/share of all rows, fewer than `share`; None if there aren't any."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    return counts.where(F.col("__n") > total / share).drop("__n") if total and most > total / share else None
