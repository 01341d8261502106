"""Matching blocks against the standard library's matcher, on random, repetitive and edited rows of words."""

from __future__ import annotations

import difflib
import random
import time

import pytest

from collatio.operators import blocks, overlap


def plain(a, b, run):
    return [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= run]


def rows(seed: int):
    r = random.Random(seed)
    for _ in range(250):
        words = "abcdefghij"[: r.randint(1, 10)]
        a = [r.choice(words) for _ in range(r.randrange(60))]
        b = list(a) if r.random() < 0.5 else [r.choice(words) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(6)):
            i, j = sorted((r.randrange(len(b) + 1), r.randrange(len(b) + 1)))
            b[i:j] = r.choice(([], b[: r.randrange(len(b) + 1)], [r.choice(words)], b[i:j] * 2))
        yield a, b
    line = "one line that is said again and again".split()
    yield line * 30, line * 20 + ["x"] + line * 9
    yield ["a"] * 300, ["a"] * 200
    yield [], []
    yield ["a"], []


@pytest.mark.parametrize("run", [1, 2, 4, 8])
def test_blocks_equal_the_standard_matcher(run):
    for a, b in rows(run):
        want = plain(a, b, run)
        assert blocks.by_automaton(a, b, run) == want
        assert blocks.matching_blocks(a, b, run) == want
        found = blocks.diagonals(a, b, run)
        assert found is None or blocks.by_diagonals(found, run) == want


def test_both_ways_are_taken():
    assert blocks.diagonals(["a"] * 3000, ["a"] * 3000, 4) is None and blocks.diagonals(["a", "b"] * 3, ["a", "b"] * 3, 4) is not None


def test_longest_run_comes_first_in_a_then_in_b():
    a, b = "x y z q x y z".split(), "x y z x y z".split()
    assert blocks.SuffixAutomaton(b).longest(a) == (0, 0, 3)
    assert blocks.SuffixAutomaton("k x y x y".split()).longest("m x y".split()) == (1, 1, 2)
    assert blocks.SuffixAutomaton([]).longest(a) == (0, 0, 0)


def test_shares_equal_the_standard_matcher():
    for a, b in rows(9):
        x, y = " ".join(a), " ".join(b)
        want = sum(n for _, _, n in plain(a, b, 4)) / max(1, len(b))
        assert overlap.share_of(x, y, 4) == want
        low = overlap.share_of(x, y, 4, 0.5)
        assert low == want if low is not None else want < 0.5


def test_repeated_texts_take_about_linear_time():
    line = "one line that is said again and again".split()
    took = []
    for n in (400, 1600):
        began = time.perf_counter()
        assert blocks.matching_blocks(line * n, [*line * (n // 2), "x", *line * (n // 2)], 8)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.2
