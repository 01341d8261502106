"""Matching blocks of two rows of words: the longest common run, then the same to its left and to its right.

Of runs of equal length the first in a counts, then the first in b. Only runs of `run` words or more are wanted. Where the longest run of
a stretch is shorter, everything in it is, so that the recursion ends there.

All such runs are clipped parts of maximal ones, which a pass over b finds by the places of each row of `run` words in a: equal rows on one
diagonal (place in a less place in b) continue one another. Where texts repeat themselves so often that there are many more pairs of places than
words, a suffix automaton finds the longest run of each stretch instead, in time linear in it.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

#: Pairs of equal places for each word up to which diagonals are used.
PAIRS = 40
Run = tuple[int, int, int]


class SuffixAutomaton:
    """All substrings of a row: states by length, suffix link, transitions, and where their strings end first."""

    def __init__(self, row: Sequence[Hashable]):
        self.length, self.link, self.first = [0], [-1], [-1]
        self.next: list[dict[Hashable, int]] = [{}]
        last = 0
        for at, item in enumerate(row):
            last = self.extend(last, item, at)

    def state(self, length: int, link: int, first: int, to: dict[Hashable, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        self.next.append(to)
        return len(self.length) - 1

    def extend(self, last: int, item: Hashable, at: int) -> int:
        """The state of the row up to its item `at`, made from that of the row before it."""
        new, p = self.state(at + 1, 0, at, {}), last
        while p >= 0 and item not in self.next[p]:
            self.next[p][item] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.next[p][item]
        if self.length[q] > self.length[p] + 1:  # the shorter strings of q end here too, the longer ones don't
            short = self.state(self.length[p] + 1, self.link[q], self.first[q], dict(self.next[q]))
            self.link[q] = short
            while p >= 0 and self.next[p].get(item) == q:
                self.next[p][item] = short
                p = self.link[p]
            q = short
        self.link[new] = q
        return new

    def longest(self, row: Sequence[Hashable]) -> Run:
        """(place in row, place in the automaton's row, length) of the longest common run."""
        state = length = 0
        best = (0, 0, 0)
        for at, item in enumerate(row):
            while state and item not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if item in self.next[state]:
                state, length = self.next[state][item], length + 1
                if length > best[2]:
                    best = at - length + 1, self.first[state] - length + 1, length
            else:
                length = 0
        return best


def by_automaton(a: Sequence[Hashable], b: Sequence[Hashable], run: int) -> list[Run]:
    """The blocks, by a suffix automaton for each stretch."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        if min(ah - al, bh - bl) < run:
            continue
        i, j, n = SuffixAutomaton(b[bl:bh]).longest(a[al:ah])
        if n >= run:
            i, j = i + al, j + bl
            out.append((i, j, n))
            todo += [(al, i, bl, j), (i + n, ah, j + n, bh)]
    return sorted(out)


def diagonals(a: Sequence[Hashable], b: Sequence[Hashable], run: int) -> list[Run] | None:
    """All maximal common runs of `run` words or more; None if there are too many pairs of equal places."""
    places: dict[tuple, list[int]] = {}
    for i, gram in enumerate(zip(*[a[k:] for k in range(run)])):
        places.setdefault(gram, []).append(i)
    left = PAIRS * (len(a) + len(b))
    begun: dict[int, tuple[int, int]] = {}  # by diagonal: first and last place in b
    out = []
    for j, gram in enumerate(zip(*[b[k:] for k in range(run)])):
        found = places.get(gram, ())
        left -= len(found)
        if left < 0:
            return None
        for i in found:
            d = i - j
            first, last = begun.get(d, (j, j))
            if last < j - 1:
                out.append((first + d, first, last - first + run))
                first = j
            begun[d] = first, j
    return sorted(out + [(first + d, first, last - first + run) for d, (first, last) in begun.items()])


def by_diagonals(runs: list[Run], run: int) -> list[Run]:
    """The blocks, of sorted maximal runs."""
    if all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(runs, runs[1:])):
        return runs  # in one order in both texts, and apart
    out, big = [], 1 << 60
    todo = [(runs, 0, big, 0, big)]
    while todo:
        listed, al, ah, bl, bh = todo.pop()
        inside = []
        for i, j, n in listed:
            cut = max(al - i, bl - j, 0)
            size = min(n, ah - i, bh - j) - cut
            if size >= run:
                inside.append((i + cut, j + cut, size))
        if inside:
            i, j, n = min(inside, key=lambda x: (-x[2], x[0], x[1]))
            out.append((i, j, n))
            todo += [(inside, al, i, bl, j), (inside, i + n, ah, j + n, bh)]
    return sorted(out)


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable], run: int) -> list[Run]:
    """(place in a, place in b, length) of the matching blocks of `run` words or more, in order."""
    runs = diagonals(a, b, run)
    return by_automaton(a, b, run) if runs is None else by_diagonals(runs, run)
