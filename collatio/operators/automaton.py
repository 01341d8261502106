"""Many concepts in one pass: all variants of a list in one automaton over words, walked by all places of many texts at once.

A folded text is a row of atoms: runs of word characters, other characters one by one, and runs of blanks as one blank. A variant is a row
of atoms too, and matches as `concepts.concept_pattern` says: it begins outside a word and its last word may have a plural end (s, es) or,
with *, any end. `goto` leads from a node over an atom to the next; outputs of a node are the concepts that end there, with a
condition for those that end in a mark (no word may follow); `prefixes` are outputs over the beginning of an atom. Each place of a text is a cursor at
the root, and all cursors of a batch take a step together, by lookups in sorted arrays; as every place has its own cursor,
there are no failure links. Nearly all cursors end at their first step, so that time hardly depends on the number of concepts.

The list comes to the driver in blocks of a bounded size; each block is one broadcast and one pass. One block holds some 10^6 variants.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.session import ship

ATOMS = re.compile(r"\w+|\s+|[^\w\s]")
#: Characters of a block's variants.
BLOCK = 32_000_000
#: Characters of the texts whose places are walked together. A place takes some hundred bytes on the way, so that this bounds a worker's memory.
PART = 1 << 18
PLURALS = ("", "s", "es")


def atoms_of(text: str) -> list[str]:
    return [" " if a.isspace() else a for a in ATOMS.findall(text)]


def is_word(atom: str) -> bool:
    return bool(re.match(r"\w", atom))


class Table:
    """Lists of numbers by key, in sorted arrays."""

    def __init__(self, rows: list[tuple[int, int]]):
        pairs = np.array(sorted(set(rows)), np.int64).reshape(-1, 2)
        self.keys, self.first = np.unique(pairs[:, 0], return_index=True)
        self.values, self.stop = pairs[:, 1], np.append(self.first[1:], len(pairs))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys, values) of all lists."""
        if not len(self.keys) or not len(keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        n = (self.stop - self.first)[at[hit]]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(hit, n), self.values[np.repeat(self.first[at[hit]], n) + inside]


class Automaton:
    """Of (name, variants), variants folded and stripped. Concepts are numbered in the order given."""

    def __init__(self, concepts: list[tuple[str, list[str]]]):
        self.names = [n for n, _ in concepts]
        self.atoms: dict[str, int] = {}
        self.beginnings: dict[str, int] = {}
        self.odd: list[tuple[re.Pattern[str], int]] = []  # variants without an atom
        trie: dict[tuple[int, int], int] = {}
        ends: list[tuple[int, int]] = []
        shut: list[tuple[int, int]] = []
        begun: list[tuple[tuple[int, int], int]] = []

        def step(node: int, atom: str) -> int:
            return trie.setdefault((node, self.atoms.setdefault(atom, len(self.atoms))), len(trie) + 1)

        for c, (_, variants) in enumerate(concepts):
            for v in variants:
                row = atoms_of(v.rstrip("*").strip())
                if not row:
                    self.odd.append((re.compile(r"(?<!\w)" if v.endswith("*") else r"(?<!\w)(?:e?s)?(?!\w)"), c))
                    continue
                node = 0
                for a in row[:-1]:
                    node = step(node, a)
                last = row[-1]
                if v.endswith("*"):
                    if is_word(last):
                        begun.append(((node, self.beginnings.setdefault(last, len(self.beginnings))), c))
                    else:
                        ends.append((step(node, last), c))
                elif is_word(last):
                    ends += [(step(node, last + end), c) for end in PLURALS]
                else:
                    node = step(node, last)
                    shut.append((node, c))
                    ends += [(step(node, end), c) for end in PLURALS if end]
        self.wide = max(1, len(self.atoms))
        self.goto = Table([(n * self.wide + a, to) for (n, a), to in trie.items()])
        self.ends, self.shut = Table(ends), Table(shut)
        self.prefixes = Table([(n * max(1, len(self.beginnings)) + p, c) for (n, p), c in begun])
        self.lengths = sorted({len(p) for p in self.beginnings})

    def numbered(self, atoms: list[str]) -> tuple[np.ndarray, np.ndarray, Table]:
        """(number of each atom among the distinct ones, the automaton's number of a distinct atom or -1, its beginnings that some variant has)."""
        index = {a: i for i, a in enumerate(dict.fromkeys(atoms))}
        known = np.fromiter((self.atoms.get(a, -1) for a in index), np.int64, len(index))
        starts = [(i, p) for a, i in index.items() for n in self.lengths if n <= len(a) and (p := self.beginnings.get(a[:n])) is not None]
        return np.fromiter(map(index.__getitem__, atoms), np.int64, len(atoms)), known, Table(starts)

    def scan(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The numbers of the concepts that each folded text has, sorted; None for None."""
        rows = [atoms_of(t or "") for t in texts]
        flat = [a for r in rows for a in (*r, "\n")]  # an atom of its own between texts: blanks in them are spaces
        owner = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
        local, known, starts = self.numbered(flat)
        atom = known[local]
        word = np.fromiter(map(is_word, dict.fromkeys(flat)), bool, len(known))[local]
        at = np.flatnonzero(word | ~np.append(False, word[:-1]))
        node = np.zeros(len(at), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(at):
            who, p = starts.find(local[at])
            hit, c = self.prefixes.find(node[who] * max(1, len(self.beginnings)) + p)
            found.append((owner[at[who[hit]]], c))
            live = np.flatnonzero(atom[at] >= 0)
            hit, to = self.goto.find(node[live] * self.wide + atom[at[live]])
            at, node = at[live[hit]], to
            for outputs, good in ((self.ends, slice(None)), (self.shut, ~word[np.minimum(at + 1, len(word) - 1)])):
                hit, c = outputs.find(node[good])
                found.append((owner[at[good][hit]], c))
            at += 1
        pairs = np.unique(np.concatenate([np.stack(f, 1) for f in found]), axis=0) if found else np.empty((0, 2), np.int64)
        cuts = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        out = [pairs[cuts[i] : cuts[i + 1], 1] for i in range(len(rows))]
        for pattern, c in self.odd:
            out = [np.union1d(o, [c]).astype(np.int64) if t is not None and pattern.search(t) else o for o, t in zip(out, texts)]
        return [None if t is None else o for o, t in zip(out, texts)]


def parts(texts: list[str | None], size: int | None = None) -> Iterator[list[str | None]]:
    """Texts in a row, of `size` characters together at most; a longer one is a part of its own."""
    part: list[str | None] = []
    n = 0
    for t in texts:
        if part and n + len(t or "") > (size or PART):
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t or "")
    if part:
        yield part


def blocks(concepts: DataFrame, size: int = BLOCK) -> Iterator[list[tuple[str, list[str]]]]:
    """(name, variants) by name, folded, in lists whose variants have about `size` characters at most."""
    rows = concepts.select("name", F.transform("variants", lambda v: T.strip(T.fold(v))).alias("variants"))
    total = rows.select(F.sum(F.aggregate("variants", F.lit(0).cast("long"), lambda n, v: n + F.length(v) + 16)).alias("n")).first()["n"] or 0
    parts = int(total // size) + 1
    if parts > 1:
        rows = rows.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)))
    for k in range(parts):
        own = rows.where(F.col("part") == k) if parts > 1 else rows
        yield sorted((r["name"], r["variants"]) for r in own.select("name", "variants").collect())


def built(spark, concepts: DataFrame, size: int = BLOCK) -> list:
    """A broadcast automaton for each block of a list."""
    ship(spark)
    return [spark.sparkContext.broadcast(Automaton(b)) for b in blocks(concepts, size)]


def found_names(folded: Column, automaton) -> Column:
    """The names of a broadcast automaton's concepts that a folded text has, by name; null for null."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = np.array(automaton.value.names, object)
        for texts in batches:
            for part in parts(texts.tolist()):
                yield pd.Series([None if f is None else names[f] for f in automaton.value.scan(part)], dtype=object)

    return run.asNondeterministic()(folded)


def hits_of(folded: Column, automaton) -> Column:
    """(name, hit) of every concept of a broadcast automaton in a folded text, by name; hit is null where the text is."""

    @F.pandas_udf("array<struct<name: string, hit: boolean>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = automaton.value.names
        for texts in batches:
            for part in parts(texts.tolist()):
                out = []
                for f in automaton.value.scan(part):
                    hit = [None] * len(names) if f is None else [False] * len(names)
                    for i in [] if f is None else f.tolist():
                        hit[i] = True
                    out.append([{"name": n, "hit": h} for n, h in zip(names, hit)])
                yield pd.Series(out, dtype=object)

    return run.asNondeterministic()(folded)


def with_found_concepts(texts: DataFrame, concepts: DataFrame, text: str = "text", into: str = "found", size: int = BLOCK) -> DataFrame:
    """texts and an array of the names of all concepts that each has, by name. Texts are folded once and not shuffled; one pass a block."""
    automata = built(texts.sparkSession, concepts, size)
    folded = T.fold(F.col(text))
    found = [found_names(folded, a) for a in automata]
    return texts.withColumn(into, found[0] if len(found) == 1 else F.array_sort(F.concat(*found)))
