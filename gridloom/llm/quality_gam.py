"""A quality classifier: a generalised additive model with pairwise interactions.

Each text is described by a few numbers (lengths, repetition, capitals, symbols). A number falls into one of up to
`bins` bins, cut at quantiles of the training rows. Boosting goes round the features in turn: a tree of three leaves on
one feature's bins is fitted to what is left to explain, and a small share of it is added to that feature's lookup
table. Then the pairs of features whose joint bins explain most of the rest get tables of their own, boosted by
trees of four leaves. A score is the sum of the looked-up numbers, through the logistic function.

Fitted on at most about `most_rows` labelled rows, taken by a hash of the id. Every text is scored whole.

What happens in each case: null text counts as the empty text, and empty texts get a score like others; rows with null
label or id don't teach; of an id with both labels, 0 counts; with no row to learn from every score is 0.5; with one label only, the scores are near that
label; repeated rows are scored each for itself; an empty table gives an empty result; further columns are ignored by
`score`, and kept as they are by `keep_good`, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import blocks, held_out, workers_can_import

#: Names of what `describe` gives, in its order.
FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "capitals", "capital_words", "symbols", "odd_words", "digits",
    "stops", "distinct_words", "commonest_word", "doubled_words", "bare_bars", "line_words", "repeated_lines", "repeated_triples",
)
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SYMBOL = re.compile(r"[^\w\s.,;:'’\"?()-]")
DIGIT = re.compile(r"\d")
STOP = re.compile(r"[.?]")


def describe(text: str | None) -> list[float]:
    """The numbers of one text, in time proportional to its length."""
    text = text or ""
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    capital_words = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    odd = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,")
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / m, max(map(len, counts), default=0), len(CAPITAL.findall(text)) / n, capital_words / m, len(SYMBOL.findall(text)) / n, odd / m, len(DIGIT.findall(text)) / n,
        len(STOP.findall(text)) / m, len(counts) / m, max(counts.values(), default=0) / m, sum(map(str.__eq__, words, words[1:])) / m, (counts["|"] + counts["-"]) / m, len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), 1 - triples / max(1, len(words) - 2) if len(words) > 2 else 0.0,
    ]


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins in two, by sums of gradients and weights."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree of three leaves over the bins."""
    parts = [(0, len(g))]
    for _ in range(2):
        cuts = [(*_best_cut(g[a:b], h[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(cuts)
        if gain <= 1e-9:
            break
        parts = [p for p in parts if p != (a, b)] + [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the tree of four leaves that cuts both features of a pair once, at one of a few places each."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    rows, cols = np.arange(g.shape[0] - 1), np.arange(g.shape[1] - 1)
    if not len(rows) or not len(cols):
        return 0.0, np.zeros_like(g)

    def quarters(S: np.ndarray) -> list[np.ndarray]:
        a, top, left, total = S[np.ix_(rows, cols)], S[rows, -1][:, None], S[-1, cols][None], S[-1, -1]
        return [a, top - a, left - a, total - top - left + a]

    gain = sum(x**2 / (y + 1) for x, y in zip(quarters(G), quarters(H), strict=True))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    for a in (slice(0, i + 1), slice(i + 1, None)):
        for b in (slice(0, j + 1), slice(j + 1, None)):
            out[a, b] = g[a, b].sum() / (h[a, b].sum() + 1)
    return float(gain.max()), out


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]
        out = np.full(len(x), self.base)
        for b, t in zip(bins, self.tables, strict=True):
            out += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[bins[i], bins[j]]
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, rate: float = 0.15, pairs: int = 6, pair_rounds: int = 40) -> AdditiveModel:
    """The model of features x and labels y (0 or 1)."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)]
    sizes = [len(e) + 1 for e in edges]
    tables, f = [np.zeros(s) for s in sizes], np.full(len(y), base)
    prob = lambda: 1 / (1 + np.exp(-f))
    for _ in range(rounds if len(y) else 0):
        for k, (b, s) in enumerate(zip(at, sizes, strict=True)):
            p = prob()
            step = rate * _tree(np.bincount(b, y - p, s), np.bincount(b, p * (1 - p), s))
            tables[k] += step
            f += step[b]

    def joint(i: int, j: int) -> tuple[float, np.ndarray]:
        p, cell, shape = prob(), at[i] * sizes[j] + at[j], (sizes[i], sizes[j])
        return _pair_tree(*(np.bincount(cell, v, sizes[i] * sizes[j]).reshape(shape) for v in (y - p, p * (1 - p))))

    chosen = sorted(combinations(range(x.shape[1]), 2), key=lambda ij: -joint(*ij)[0])[:pairs] if len(y) else []
    pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in chosen]
    for _ in range(pair_rounds):
        for t, (i, j) in zip(pair_tables, chosen, strict=True):
            step = rate * joint(i, j)[1]
            t += step
            f += step[at[i], at[j]]
    return AdditiveModel(base, edges, tables, chosen, pair_tables)


def _described(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in blocks(batches, column):
        yield b, np.array([describe(t) for t in b.column(column).to_pylist()], float).reshape(b.num_rows, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AdditiveModel:
    """The model of the labelled rows that aren't held out; labels: (id, label) rows."""
    workers_can_import(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(~held_out("id") & F.col("y").isin(0, 1)).where("id is not null").groupBy("id").agg(F.min("y").alias("y"))
    share = min(1.0, most_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))
    # No more than about most_rows ids of 12 bytes, whatever the size of the tables.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _described(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "y", "x"])

    found = rows.select("id", "text", "y").mapInArrow(of, "id long, y int, x binary").orderBy("id", "x").limit(2 * most_rows).collect()
    x = np.array([np.frombuffer(r["x"]) for r in found]).reshape(len(found), len(FEATURES))
    return boost(x, np.array([r["y"] for r in found], float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    workers_can_import(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size set by its parameters

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _described(batches, 2):
            p = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least the threshold; all columns as they are."""
    workers_can_import(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _described(batches, at):
            yield b.filter(pa.array(shared.value.scores(x) >= threshold))

    return docs.mapInArrow(of, docs.schema)
