"""Token counts of a unigram tokenizer by a Viterbi pass that carries counts only.

An Aho-Corasick automaton lists the vocabulary's pieces that end at each position of a chunk. Dynamic programming
carries, for each position, the best score and the number of pieces on the best way there; no piece and no way is
stored. Ties go as in the tokenizers library: ways are tried from the earliest start on, and only a strictly higher
score replaces one. A character that is no piece costs the lowest score less 10 and counts as its bytes (byte
fallback); if the unknown piece itself is written in a text, it counts as its bytes beside such characters, and as one
piece alone. Chunks are the text cut before each blank, which is written as U+2581, as that library's Metaspace step,
so that a U+2581 in a text is a blank.

What happens in each case: null and empty texts have 0 tokens; a text of blanks only has one chunk a blank; repeated
rows are counted each for itself; an empty table gives an empty result; a null doc_id is kept; further columns are
ignored, whatever their names. Texts are handled whole, in time proportional to their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import blocks, workers_can_import
from gridloom.llm.lockstep import Automaton, by_length

BLANK = "▁"
#: Fixed value of the unigram model: how much an unknown character scores below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Positions times chunks that are stepped through together; chunks kept with their counts, and the longest of them.
CELLS = 1 << 20
MOST_KEPT = 600_000
LONGEST_KEPT = 48


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class CountingViterbi:
    def __init__(self, vocab: list[tuple[str, float]], unknown_id: int = 0):
        pieces: dict[str, float] = {}
        for piece, score in vocab:
            pieces.setdefault(piece, score)
        self.unknown = min(score for _, score in vocab) - UNKNOWN_PENALTY
        #: code point -> symbol of the automaton; 0 if no piece has it
        self.symbol = np.zeros(0x110000, np.int32)
        alphabet = sorted(set("".join(pieces)))
        self.symbol[list(map(ord, alphabet))] = np.arange(1, len(alphabet) + 1)
        self.ends = Automaton([tuple(self.symbol[list(map(ord, p))].tolist()) for p in pieces], len(alphabet) + 1)
        self.scores = np.array(list(pieces.values()))
        #: The unknown piece's number and bytes: written out in a text, it is one more unknown part.
        self.unknown_piece, self.unknown_bytes = list(pieces).index(vocab[unknown_id][0]), len(vocab[unknown_id][0].encode())
        self.counts: dict[str, int] = {}

    def count_chunks(self, chunks: list[str]) -> list[int]:
        """The number of pieces of each chunk; blocks of chunks of like lengths are stepped through together."""
        out = np.zeros(len(chunks), np.int64)
        order = sorted(range(len(chunks)), key=lambda i: len(chunks[i]))
        while order:
            n = max(1, min(len(order), CELLS // len(chunks[order[-1]])))
            block, order = order[-n:], order[:-n]
            out[block] = self._block([chunks[i] for i in block])
        return out.tolist()

    def _block(self, chunks: list[str]) -> np.ndarray:
        codes = [np.frombuffer(c.encode("utf-32-le", "surrogatepass"), "<u4") for c in chunks]
        rank, lengths, code = by_length(codes)
        symbol = self.symbol[code]
        width = (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int64)
        shape = (len(code) + 1, len(chunks))
        #: By prefix: the best score; the pieces before the unknown parts at its end; the bytes of those, which the library
        #: takes together; the pieces with those, where the unknown piece on its own is one.
        score, before, run, count = np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        state = np.zeros(len(chunks), np.int32)
        for end in range(1, len(code) + 1):
            k = np.searchsorted(-lengths, -end, side="right")  # the chunks that reach so far
            state = self.ends.step(state[:k], symbol[end - 1, :k])
            best, pieces, single, written = np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros(k, bool), np.zeros(k, bool)
            for rows, tokens in self.ends.ends(state):  # the earliest start first
                size = self.ends.length[tokens]
                way = self.scores[tokens] + score[end - size, rows]
                single[rows[size == 1]] = True
                better = way > best[rows]
                rows, at, tokens = rows[better], (end - size)[better], tokens[better]
                best[rows], pieces[rows], written[rows] = way[better], count[at, rows] + 1, tokens == self.unknown_piece
            way = self.unknown + score[end - 1, :k]
            better = ~single & (way > best)
            score[end, :k] = np.where(better, way, best)
            before[end, :k] = np.where(better, before[end - 1, :k], pieces)
            run[end, :k] = np.where(better, run[end - 1, :k] + width[end - 1, :k], 0)
            count[end, :k] = before[end, :k] + run[end, :k]
            rows = np.flatnonzero(written & ~better)
            if len(rows):
                at = end - int(self.ends.length[self.unknown_piece])
                before[end, rows], run[end, rows] = before[at, rows], run[at, rows] + self.unknown_bytes
                count[end, rows] = before[at, rows] + np.where(run[at, rows] > 0, run[end, rows], 1)
        out = np.zeros(len(chunks), np.int64)
        out[rank] = count[lengths, np.arange(len(chunks))]
        return out

    def count(self, texts: list[str]) -> list[int]:
        """The number of pieces of each text."""
        texts = [t.replace(BLANK, " ") for t in texts]
        split = [[BLANK + c for c in (t[1:] if t.startswith(" ") else t).split(" ")] if t else [] for t in texts]
        new = list({c for chunks in split for c in chunks}.difference(self.counts))
        if len(self.counts) + len(new) > MOST_KEPT:
            self.counts = {}
            new = list({c for chunks in split for c in chunks})
        found = dict(zip(new, self.count_chunks(new), strict=True))
        self.counts |= {c: n for c, n in found.items() if len(c) <= LONGEST_KEPT}
        get = found.__getitem__ if not self.counts else lambda c: self.counts[c] if c in self.counts else found[c]
        if not any(len(c) > LONGEST_KEPT for c in new):
            get = self.counts.__getitem__
        return [sum(map(get, chunks)) for chunks in split]


@cache
def counter(model_path: str) -> CountingViterbi:
    return CountingViterbi(vocabulary(model_path))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens) of every row."""
    workers_can_import(docs.sparkSession)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = counter(model_path)
        for b in blocks(batches, 1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(viterbi.count(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "n_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(of, "doc_id long, n_chars long, n_tokens long")
