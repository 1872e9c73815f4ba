"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be the last one of the prefix's own encoding. The suffix automaton of
the vocabulary gives all tokens that end at a position, along its suffix links; of these the last token of the prefix is the
one that starts the word or that is compatible with the last token of the prefix before it. Two tokens are compatible
if merging their joined text would never cross the boundary between them. Following the stored tokens back from the
end of the word gives its ids, and no merge loop runs on the text.

A word's characters are held as single symbols: byte b as chr(b), and the last byte of a word, which the vocabulary
marks by an end-of-word suffix, as chr(256 + b).

What happens in each case: null and empty texts have no token and decode to the empty text; special tokens in a text
become their single id; repeated rows are encoded each for itself; an empty table gives an empty result; a null
doc_id is kept; further columns are ignored, whatever their names. Texts are handled whole, and a word of any length
takes time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm.common import blocks, workers_can_import
from gridloom.llm.lockstep import IntTable, SuffixAutomaton, by_length

#: How the tokenizer file of this kind writes the 256 bytes as visible characters.
VISIBLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
WHITE = "\\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs of white space other than one blank.
SPACE = re.compile(f"(?:[{WHITE}]| (?=[ {WHITE}]))[ {WHITE}]*")
FOREVER = 1 << 62
#: Characters below this one have had the same properties in all Unicode versions since long.
PLAIN = "\u0250"
#: Positions times words that are stepped through together; what is kept of earlier texts, and the longest of it.
CELLS = 1 << 20
MOST_PAIRS, MOST_WORDS, MOST_CHUNKS, LONGEST_KEPT = 1_000_000, 450_000, 450_000, 48
PAIR = 1 << 20


class DynamicBpe:
    """Encoder of one tokenizer file of the kind: NFC, white space to one blank, lower case, split by a pattern, byte
    BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        others = [b for b in range(256) if b not in set(VISIBLE)]
        self.shown = {**{b: chr(b) for b in VISIBLE}, **{b: chr(256 + i) for i, b in enumerate(others)}}
        byte_of = {c: b for b, c in self.shown.items()}

        def symbols(token: str) -> str:
            last = token.endswith(self.suffix)
            bs = [byte_of[c] for c in (token[: -len(self.suffix)] if last else token)]
            return "".join(map(chr, bs[:-1])) + chr(bs[-1] + 256 * last)

        self.library = Tokenizer.from_file(path)
        self.text = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
        ids = {symbols(t): i for t, i in model["vocab"].items() if t != self.suffix}
        self.symbols = {i: s for s, i in ids.items()}
        #: (left id, right id) -> (rank of the merge, id that it makes)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right = symbols(a), symbols(b)
            self.merges.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        self.ids = ids
        tokens = list(ids.items())
        self.ends = SuffixAutomaton([tuple(ord(c) + 1 for c in t) for t, _ in tokens], 513)
        self.id_of = np.array([i for _, i in tokens], np.int64)  # by the automaton's numbers
        self.spines = cache(self._spines)
        self.reachable = np.array([self.spines(i) is not None for _, i in tokens])
        self.pairs = IntTable(20)  # (left id, right id) as one long -> 1 if compatible, else 0
        self.token_text = np.array([self.text.get(i, "") for i in range(max(self.text) + 1)], object)
        #: Ids of words and of chunks met before.
        self.word_ids: dict[str, bytes] = {}
        self.chunk_ids: dict[str, bytes] = {}

    def _spines(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
        """The tokens down the left and the right edge of the token's merge tree, each with the rank of the merge that
        takes it up; None if merging the token's own text doesn't lead to it."""
        text = self.symbols[token]
        if len(text) == 1:
            return [(token, FOREVER)], [(token, FOREVER)]
        best = None
        for at in range(1, len(text)):
            head, t = self.ids.get(text[:at]), self.ids.get(text[at:])
            if t is None or head is None or (head, t) not in self.merges:
                continue
            if self.spines(head) and self.spines(t) and self.compatible_but(head, t, self.merges[head, t][0]):
                best = (self.merges[head, t][0], head, t)
        if best is None:
            return None
        rank, head, tail = best
        grow = lambda edge: [(token, FOREVER), *((x, min(r, rank) if r == FOREVER else r) for x, r in edge)]
        return grow(self.spines(head)[0]), grow(self.spines(tail)[1])

    def compatible_but(self, a: int, b: int, rank: int) -> bool:
        """No merge crosses the boundary between a and b before the merge of the given rank does."""
        for x, x_until in self.spines(a)[1]:
            for y, y_until in self.spines(b)[0]:
                found = self.merges.get((x, y))
                # Equal merges run from left to right: one inside a comes before one across, and that before one in b.
                if found and found[0] < x_until and found[0] <= y_until and found[0] < rank:
                    return False
        return True

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of ids whether merging their joined text leaves the two as they are."""
        keys = left * PAIR + right
        found = self.pairs.get(keys, -1)
        if (found < 0).any():
            new = np.unique(keys[found < 0])
            if self.pairs.size + len(new) > MOST_PAIRS:
                self.pairs, new = IntTable(20), np.unique(keys)
            self.pairs.put(new, np.array([self.compatible_but(k // PAIR, k % PAIR, FOREVER) for k in new.tolist()], np.int32))
            found = self.pairs.get(keys, -1)
        return found == 1

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word; blocks of words of like lengths are stepped through together."""
        out: list = [None] * len(words)
        data = [np.frombuffer(w.encode("utf-8"), np.uint8).astype(np.int32) + 1 for w in words]
        order = sorted(range(len(words)), key=lambda i: len(data[i]))
        while order:
            n = max(1, min(len(order), CELLS // len(data[order[-1]])))
            block, order = order[-n:], order[:-n]
            for d in (data[i] for i in block):
                d[-1] += 256
            for i, ids in zip(block, self._block([data[i] for i in block]), strict=True):
                out[i] = ids
        return out

    def _block(self, data: list[np.ndarray]) -> list[np.ndarray]:
        rank, lengths, symbol = by_length(data)
        last = np.full((len(symbol) + 1, len(data)), -1, np.int64)  # by prefix: its last token, and where that begins
        back = np.zeros((len(symbol) + 1, len(data)), np.int32)
        state = length = np.zeros(len(data), np.int32)
        for end in range(1, len(symbol) + 1):
            k = np.searchsorted(-lengths, -end, side="right")  # the words that reach so far
            state, length = self.ends.step(state[:k], length[:k], symbol[end - 1, :k])
            matches = self.ends.ends(state, length)
            found = next(matches, None)
            while found is not None:
                rows, tokens = found
                at, ids = end - self.ends.length[tokens], self.id_of[tokens]
                before = last[at, rows]
                fits = self.reachable[tokens] & (at == 0)
                test = np.flatnonzero(self.reachable[tokens] & (before >= 0))
                fits[test] = self.compatible(before[test], ids[test])
                last[end, rows[fits]], back[end, rows[fits]] = ids[fits], at[fits]
                try:
                    found = matches.send(~fits)
                except StopIteration:
                    break
        # Back from the ends: step s holds the s-th last token of each word.
        at, rows, steps = lengths.copy(), np.arange(len(data)), []
        counts = np.zeros(len(data), np.int64)
        while len(rows):
            steps.append((rows, last[at, rows]))
            counts[rows] += 1
            at = back[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]), "<u4")
        for s, (rows, ids) in enumerate(steps):
            flat[ends[rows] - 1 - s] = ids
        out: list = [None] * len(data)
        for i, ids in zip(rank.tolist(), np.split(flat, ends[:-1]), strict=True):
            out[i] = ids
        return out

    def _learn(self, words: list[str]) -> None:
        for w, ids in zip(words, self.encode_words(words), strict=True):
            self.word_ids[w] = ids.tobytes()

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk in scripts where libraries may know different Unicode versions: by the library's own."""
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def normal(self, text: str) -> str:
        if text and max(text) >= PLAIN:
            return self.library.normalizer.normalize_str(text)
        text = SPACE.sub(" ", unicodedata.normalize("NFC", text))
        return text.lower()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.special_at.split(t) if self.special_at and "<|" in t else [t] for t in texts]
        split = [[self.normal(p).split(" ") if k % 2 == 0 else p for k, p in enumerate(ps)] for ps in parts]
        seen = set()
        for ps in split:
            for p in ps[::2]:
                seen.update(p)
        if len(self.chunk_ids) + len(seen) > MOST_CHUNKS:
            self.chunk_ids = {}
        words = {c: self.words(c) if c.isascii() or max(c) < PLAIN else self.split(c) for c in seen.difference(self.chunk_ids)}
        new = set()
        for ws in words.values():
            new.update(ws)
        if len(self.word_ids) + len(new) > MOST_WORDS:
            self.word_ids = {}
        self._learn(list(new.difference(self.word_ids)))
        word_ids = self.word_ids.__getitem__
        for c, ws in words.items():
            self.chunk_ids[c] = word_ids(ws[0]) if len(ws) == 1 else b"".join(map(word_ids, ws))
        chunk_ids = self.chunk_ids.__getitem__
        special = lambda p: np.array([self.special[p]], "<u4").tobytes()
        out = [b"".join(special(p) if k % 2 else b"".join(map(chunk_ids, p)) for k, p in enumerate(ps)) for ps in split]
        for w in (w for w in (*words, *new) if len(w) > LONGEST_KEPT):
            self.chunk_ids.pop(w, None)
            self.word_ids.pop(w, None)
        return out

    def decode(self, ids: bytes) -> str:
        """The text that ids stand for: the file names no decoder, so tokens are joined by blanks."""
        return " ".join(self.token_text[np.frombuffer(ids, "<u4")].tolist())


@cache
def encoder(path: str) -> DynamicBpe:
    return DynamicBpe(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and the ids as binary on demand."""
    workers_can_import(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in blocks(batches, 1):
            counts, id_hashes, text_hashes, all_ids = [], [], [], []
            for ids in bpe.encode([t or "" for t in b.column(1).to_pylist()]):
                counts.append(len(ids) // 4)
                id_hashes.append(hashlib.sha256(ids).hexdigest())
                text_hashes.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            cols = [b.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(text_hashes, pa.string()), *([pa.array(all_ids, pa.binary())] * with_ids)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(of, schema)
