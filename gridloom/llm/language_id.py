"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier on hashed character n-grams (1 to 3) learns to
tell the languages whose bit is 1 from the others. A text gets the language whose codeword costs least: the sum over
the bits of the classifier's logistic loss against the codeword's bit, weighted by how well that classifier did in
training. If the two cheapest codewords are close, the text is flagged as ambiguous. If even the cheapest codeword costs
much, the text is like no learned language: `fit` can learn how much the rows it learns from cost when they are left out
of the fitting, and `keep_certain` leaves out what costs more than nearly all of them.

The classifiers are fitted on a bounded sample: `per_language` rows of each language, taken by a hash of the id. Every
text is scored whole, in blocks, so that a very long one needs little memory.

What happens in each case: null text, empty text and text without a letter are `und` with score 0 and not ambiguous;
rows with null lang or id don't teach, and are scored like others; with no row to learn from every text is `und`; with
one language all texts with a letter get it; ties go to the language that sorts first; repeated rows are scored each
for itself; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import blocks, held_out, workers_can_import

#: A letter of any script; numerals such as "½" are none.
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Code points that are looked at at a time.
BLOCK = 1 << 18
#: Codewords whose costs differ by no more tie.
TIE = 1e-6
#: Of as many languages as get so many rows of the sample each, those with the most rows are learned.
LEAST_ROWS = 20


def ngram_counts(text: str, buckets: int) -> np.ndarray:
    """Hashed counts of the character n-grams of the lower-cased text, as root of their share in it."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    code = np.concatenate([[32], code, [32]]).astype(np.uint64)
    out = np.zeros(buckets)
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    for at in range(0, len(code), BLOCK):
        some = code[at : at + BLOCK + 2]
        h = np.zeros(len(some), np.uint64)
        for n in range(3):
            h = (h[: len(some) - n] * np.uint64(0x100000001B3) + some[n:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            own = h[:BLOCK]
            out += np.bincount((own >> shift).astype(np.int64), minlength=buckets)
    return np.sqrt(out / max(1.0, out.sum())).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1: all columns that tell some languages apart while n is small, else the best of random codes."""
    if n <= 5:
        return np.array([(1, *bits) for bits in product((1, -1), repeat=n - 1)][1:], float).T.reshape(n, -1) if n > 1 else np.ones((1, 1))
    rng, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    tries = (np.where(rng.random((n, length)) < 0.5, -1.0, 1.0) for _ in range(200))
    return max(tries, key=lambda c: min(((c[i] != c).sum(1) + length * (np.arange(n) == i)).min() for i in range(n)))


@dataclass
class CodeModel:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit
    buckets: int
    most_loss: float = np.inf  # a text whose cheapest codeword costs more is like no language of the model

    def losses(self, x: np.ndarray) -> np.ndarray:
        margin = (x @ self.weights + self.bias)[:, None, :] * self.codes[None]
        return (np.logaddexp(0, -margin) * self.trust).sum(2)

    def predict(self, texts: list[str | None], ambiguous_below: float = 0.2) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous, of each text."""
        return self.judge(texts, ambiguous_below)[:3]

    def judge(self, texts: list[str | None], ambiguous_below: float = 0.2) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, whether it is ambiguous, and what its codeword costs, of each text."""
        with_letter = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        lang, score, unsure, cost = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool), np.full(len(texts), np.inf)
        for at in range(0, len(with_letter), 256):
            rows = with_letter[at : at + 256]
            loss = self.losses(np.stack([ngram_counts(texts[i], self.buckets) for i in rows]).astype(float))
            best, cost[rows] = (loss <= loss.min(1, keepdims=True) + TIE).argmax(1), loss.min(1)
            p = np.exp(loss.min(1, keepdims=True) - loss)
            p /= p.sum(1, keepdims=True)
            top = np.sort(p, axis=1)
            score[rows] = top[:, -1]
            if p.shape[1] > 1:
                unsure[rows] = top[:, -1] - top[:, -2] < ambiguous_below
            for i, k in zip(rows, best.tolist(), strict=True):
                lang[i] = self.languages[k]
        return lang, score, unsure, cost


def _learn(names: list[str], x: np.ndarray, y: np.ndarray, rounds: int) -> CodeModel:
    """The model of features x of the languages that y numbers."""
    buckets, codes = x.shape[1], codewords(len(names))
    target = codes[y]
    weigh = (len(y) / len(names) / np.bincount(y, minlength=len(names)).clip(1))[y][:, None]
    w, bias = np.zeros((buckets, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    step, vw, vb = 6.0, np.zeros_like(w), np.zeros_like(bias)
    # Gradient descent with momentum on the logistic loss, at a step below 7.6, where it would swing ever wider on texts that are all alike.
    for _ in range(rounds):
        g = (-target * weigh / (1 + np.exp(np.clip(target * (x @ w + bias), -30, 30)))).astype(np.float32) / len(y)
        vw, vb = 0.9 * vw - step * (x.T @ g + 1e-5 * w), 0.9 * vb - step * g.sum(0)
        w, bias = w + vw, bias + vb
    right = ((x @ w + bias) * target > 0).mean(0)
    trust = np.log(np.clip(right, 0.51, 0.999) / (1 - np.clip(right, 0.51, 0.999)))
    return CodeModel(names, codes, w.astype(float), bias.astype(float), trust / trust.mean(), buckets)


def _most_loss(names: list[str], x: np.ndarray, y: np.ndarray, rounds: int, share: float, folds: int = 4) -> float:
    """What all but `share` of the rows cost at most, each by a model that is fitted without its fold."""
    fold, loss = np.arange(len(y)) % folds, np.full(len(y), np.inf)
    for k in range(folds):
        out = fold == k
        if out.any() and not out.all():
            loss[out] = _learn(names, x[~out], y[~out], rounds).losses(x[out].astype(float)).min(1)
    return float(np.quantile(loss, 1 - share, method="higher"))


def fit(docs: DataFrame, lang: Column, teaches: Column, per_language: int = 500, buckets: int = 4096, rounds: int = 300, id_col: str = "doc_id", text_col: str = "text", lose: float | None = None, most_rows: int = 10_000) -> CodeModel:
    """The model of the rows where `teaches` holds and `lang` isn't null, about per_language of each language, and most_rows in all:
    with many languages each gets fewer, down to 20, and of more than most_rows / 20 languages the most frequent are learned.

    lose: the share of such rows that `keep_certain` may take for no language of the model; None to learn no such bound.
    """
    workers_can_import(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"), lang.alias("lang"), teaches.alias("on")).where("on and lang is not null and key is not null and text is not null")
    frequent = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max(1, most_rows // LEAST_ROWS))
    counts = {r["lang"]: r["n"] for r in frequent.collect()}
    per_language = max(1, min(per_language, most_rows // max(1, len(counts))))
    names = sorted(counts)
    if not names:
        return CodeModel([], np.ones((0, 1)), np.zeros((buckets, 1)), np.zeros(1), np.ones(1), buckets)
    share = F.element_at(F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, per_language / counts[k]))]), F.col("lang"))
    sample = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "key", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 2):
            for i in range(0, b.num_rows, 100):
                some = b.slice(i, 100)
                packed = [ngram_counts(t, buckets).astype("<f2").tobytes() for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(packed, pa.binary())], ["lang", "key", "x"])

    found = sample.mapInArrow(features, "lang string, key string, x binary").orderBy("key").limit(2 * per_language * len(names)).collect()
    x = np.stack([np.frombuffer(r["x"], "<f2") for r in found]).astype(np.float32)
    y = np.array([names.index(r["lang"]) for r in found])
    model = _learn(names, x, y, rounds)
    if lose is not None:
        model.most_loss = _most_loss(names, x, y, rounds, lose)
    return model


def predict(docs: DataFrame, model: CodeModel, id_col: str = "doc_id", text_col: str = "text", ambiguous_below: float = 0.2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row."""
    workers_can_import(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size set by its parameters

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, 2):
            lang, score, unsure = shared.value.predict(b.column(2).to_pylist(), ambiguous_below)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(of, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_certain(docs: DataFrame, model: CodeModel, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of docs whose text has a known language, not an ambiguous one, at a score of `least` or more and at no more
    loss than the model's bound; all columns as they are.

    The columns may have any names and types; they are passed through as Arrow arrays.
    """
    workers_can_import(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, at):
            lang, score, unsure, cost = shared.value.judge(b.column(at).to_pylist())
            yield b.filter(pa.array((np.array(lang, object) != UNKNOWN) & (score >= least) & ~unsure & (cost <= shared.value.most_loss), pa.bool_()))

    return docs.mapInArrow(of, docs.schema)
