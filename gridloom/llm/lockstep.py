"""Automata that numpy steps over many short strings at once, one position at a time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np

FREE = -1
MIX = np.uint64(0x9E3779B97F4A7C15)


class IntTable:
    """A hash table from non-negative longs to ints, whose keys are looked up and put in whole arrays at a time."""

    def __init__(self, bits: int = 12):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, FREE, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        out, slots = np.full(len(keys), default, np.int32), self._slots(keys)
        rest = None
        while True:
            found = self.keys[slots]
            hit = found == keys
            at = np.flatnonzero(hit) if rest is None else rest[hit]
            out[at] = self.values[slots[hit]]
            go_on = ~hit & (found != FREE)
            if not go_on.any():
                return out
            rest = np.flatnonzero(go_on) if rest is None else rest[go_on]
            keys, slots = keys[go_on], (slots[go_on] + 1) & ((1 << self.bits) - 1)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct, and none of them in the table."""
        while 2 * (self.size + len(keys)) > 1 << self.bits:
            old = self.keys != FREE
            kept = self.keys[old], self.values[old]
            self.__init__(self.bits + 1)
            self.put(*kept)
        self.size += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == FREE
            self.keys[slots[free]] = keys[free]  # of several for one slot the last stays
            self.values[slots[free]] = values[free]
            rest = self.keys[slots] != keys
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)


class Automaton:
    """Aho-Corasick over patterns (sequences of small ints): pattern k has the number k. Symbol 0 occurs in none."""

    def __init__(self, patterns: list[tuple[int, ...]], symbols: int):
        self.symbols = symbols
        goto: list[dict[int, int]] = [{}]
        token = [FREE]
        for k, p in enumerate(patterns):
            s = 0
            for c in p:
                t = goto[s].get(c)
                if t is None:
                    t = goto[s][c] = len(goto)
                    goto.append({})
                    token.append(FREE)
                s = t
            if token[s] == FREE:
                token[s] = k
        fail, out = [0] * len(goto), [0] * len(goto)
        todo = deque(goto[0].values())
        while todo:
            s = todo.popleft()
            for c, t in goto[s].items():
                f = fail[s]
                while f and c not in goto[f]:
                    f = fail[f]
                fail[t] = goto[f].get(c, 0)
                todo.append(t)
            out[s] = fail[s] if token[fail[s]] != FREE else out[fail[s]]
        self.fail, self.out, self.token = (np.array(x, np.int32) for x in (fail, out, token))
        self.length = np.array([len(p) for p in patterns], np.int32)
        edges = [(s * symbols + c, t) for s, row in enumerate(goto) for c, t in row.items()]
        self.goto = IntTable(int(len(edges)).bit_length() + 2)
        self.goto.put(np.array([e[0] for e in edges], np.int64), np.array([e[1] for e in edges], np.int32))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = self.goto.get(state.astype(np.int64) * self.symbols + symbol, FREE)
        rest = np.flatnonzero(out == FREE)
        up = state[rest]
        while len(rest):
            at_root = up == 0
            out[rest[at_root]] = 0
            rest, up = rest[~at_root], self.fail[up[~at_root]]
            to = self.goto.get(up.astype(np.int64) * self.symbols + symbol[rest], FREE)
            out[rest] = to
            missed = to == FREE
            rest, up = rest[missed], up[missed]
        return out

    def ends(self, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, tokens) again and again: of each row the patterns that end there, longest first. Rows may be left out
        of further ones by send()ing a mask of those to go on with."""
        return _ends(np.where(self.token[state] != FREE, state, self.out[state]), self.token, self.out)


def _ends(at: np.ndarray, token: np.ndarray, out: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows = np.flatnonzero(at)
    at = at[rows]
    while len(rows):
        go_on = yield rows, token[at]
        at = out[at]
        on = at != 0 if go_on is None else (at != 0) & go_on
        rows, at = rows[on], at[on]


class SuffixAutomaton:
    """The suffix automaton of a set of distinct patterns (sequences of small ints): pattern k has the number k. Symbol 0
    occurs in none.

    Each string's place is the longest suffix read so far that occurs anywhere in a pattern: a state and that suffix's
    length. A state stands for strings that end at the same places of the patterns, each a suffix of the longest one, and its
    link leads to the longest suffix that ends at more places. A whole pattern is the longest string of its state, as nothing
    longer ends where the pattern does; so the patterns that end at a place are those of the states along the links.
    """

    def __init__(self, patterns: list[tuple[int, ...]], symbols: int):
        self.symbols = symbols
        self.length = np.array([len(p) for p in patterns], np.int32)
        goto: list[dict[int, int]] = [{}]
        link, longest, token = [FREE], [0], [FREE]

        def state(length: int, to: dict[int, int], suffix: int) -> int:
            goto.append(to)
            link.append(suffix)
            longest.append(length)
            token.append(FREE)
            return len(goto) - 1

        def apart(p: int, c: int, q: int) -> int:
            """The state of the longest string of p with c behind it, which is in q but may not be q's longest."""
            if longest[q] == longest[p] + 1:
                return q
            own = state(longest[p] + 1, dict(goto[q]), link[q])
            link[q] = own
            while p != FREE and goto[p].get(c) == q:
                goto[p][c] = own
                p = link[p]
            return own

        for k, pattern in enumerate(patterns):
            at = 0
            for c in pattern:
                q = goto[at].get(c)
                if q is not None:
                    at = apart(at, c, q)
                    continue
                new, p = state(longest[at] + 1, {}, 0), at
                while p != FREE and c not in goto[p]:
                    goto[p][c] = new
                    p = link[p]
                if p != FREE:
                    link[new] = apart(p, c, goto[p][c])
                at = new
            token[at] = k
        out = [0] * len(goto)
        for s in sorted(range(1, len(goto)), key=longest.__getitem__):
            out[s] = link[s] if token[link[s]] != FREE else out[link[s]]
        self.link, self.longest, self.token, self.out = (np.array(x, np.int32) for x in (link, longest, token, out))
        edges = np.array([(s * symbols + c, t) for s, row in enumerate(goto) for c, t in row.items()], np.int64).reshape(-1, 2)
        self.goto = IntTable(int(len(edges)).bit_length() + 2)
        self.goto.put(edges[:, 0].copy(), edges[:, 1].astype(np.int32))

    def step(self, state: np.ndarray, length: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places after one more symbol of each string."""
        out, length = self.goto.get(state.astype(np.int64) * self.symbols + symbol, FREE), length + 1
        rest = np.flatnonzero(out == FREE)
        up = state[rest]
        while len(rest):
            at_root = up == 0
            out[rest[at_root]] = length[rest[at_root]] = 0
            rest, up = rest[~at_root], self.link[up[~at_root]]
            to = self.goto.get(up.astype(np.int64) * self.symbols + symbol[rest], FREE)
            out[rest], length[rest] = to, self.longest[up] + 1
            missed = to == FREE
            rest, up = rest[missed], up[missed]
        return out, length

    def ends(self, state: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As Automaton.ends."""
        whole = (self.token[state] != FREE) & (length == self.longest[state])
        return _ends(np.where(whole, state, self.out[state]), self.token, self.out)


def by_length(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, lengths, symbols): strings from the longest to the shortest, as the columns of one matrix of positions."""
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    matrix = np.zeros((int(lengths[0]) if len(lengths) else 0, len(strings)), np.int32)
    flat = np.concatenate([strings[i] for i in order]) if len(strings) else np.zeros(0, np.int32)
    starts = np.cumsum(lengths) - lengths
    matrix[np.arange(len(flat)) - np.repeat(starts, lengths), np.repeat(np.arange(len(strings)), lengths)] = flat
    return order, lengths, matrix
