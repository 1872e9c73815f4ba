"""The suffix automaton against a search of every pattern at every place."""

import random

import numpy as np
import pytest

from gridloom.llm.lockstep import FREE, SuffixAutomaton


def found_by(automaton, text):
    state = length = np.zeros(1, np.int32)
    out, known = [], []
    for c in text:
        state, length = automaton.step(state, length, np.array([c], np.int32))
        known.append(int(length[0]))
        out.append([int(tokens[0]) for _, tokens in automaton.ends(state, length)])
    return out, known


@pytest.mark.parametrize("seed", range(6))
def test_matches_are_all_and_longest_first(seed):
    rng = random.Random(seed)
    make = lambda most: tuple(rng.randint(1, 3) for _ in range(rng.randint(1, most)))
    patterns = sorted({make(7) for _ in range(rng.choice([1, 5, 60]))}, key=lambda _: rng.random())
    automaton = SuffixAutomaton(patterns, 5)
    pieces = {p[i:j] for p in patterns for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    for _ in range(30):
        text = [rng.randint(1, 4) for _ in range(rng.randint(0, 40))]
        out, known = found_by(automaton, text)
        for end in range(1, len(text) + 1):
            want = [patterns.index(tuple(text[at:end])) for at in range(end) if tuple(text[at:end]) in patterns]
            assert out[end - 1] == want
            assert known[end - 1] == max((end - at for at in range(end) if tuple(text[at:end]) in pieces), default=0)


def test_states_are_as_few_as_ends_differ():
    patterns = [(1, 2, 1, 2, 3), (2, 1, 2), (3, 3), (2, 3, 3)]
    automaton = SuffixAutomaton(patterns, 5)
    pieces = {p[i:j] for p in patterns for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
    ends = {s: frozenset((k, j) for k, p in enumerate(patterns) for j in range(len(s), len(p) + 1) if p[j - len(s) : j] == s) for s in pieces}
    assert len(automaton.link) == 1 + len(set(ends.values()))
    assert sorted(automaton.token[automaton.token != FREE].tolist()) == [0, 1, 2, 3]


def test_no_patterns():
    assert found_by(SuffixAutomaton([], 5), [1, 2]) == ([[], []], [0, 0])
