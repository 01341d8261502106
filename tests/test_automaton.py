"""The concept automaton against the patterns that define concepts."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.operators import automaton, concepts
from collatio.plans.report import fidelity_report

PIECES = ["man", "mans", "manes", "es", "s", "maní", "MAN", "c++", "c+", "u.s.", "u.s", "a-b", "(x)", "x", "_a", "1", "2ª", "日本", "日", "of", "the", "ß", "'s"]
GAPS = [" ", "  ", "\n", "\t  ", "-", ".", ", ", "", "(", "'"]


def texts(rng: random.Random, n: int) -> list[str | None]:
    out = ["".join(rng.choice(PIECES) + rng.choice(GAPS) for _ in range(rng.randrange(12))) for _ in range(n)]
    return [*out, None, "", " ", "s", "es", "the man", "man" * 5000, "of the " * 20_000]


def terms(rng: random.Random, n: int) -> list[tuple[str, list[str]]]:
    def one() -> str:
        t = "".join(rng.choice(PIECES) + rng.choice(GAPS[:5] if rng.random() < 0.7 else GAPS) for _ in range(rng.randint(1, 3))).strip()
        return t + "*" * (rng.random() < 0.3)

    return [(f"c{i:03d}", [one() for _ in range(rng.randint(1, 3))]) for i in range(n)] + [("y1", ["*"]), ("y2", ["the  man", "of the*"]), ("y3", ["s"]), ("y4", ["́"])]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    return spark.createDataFrame(list(enumerate(texts(rng, 150))), "k int, text string"), spark.createDataFrame(terms(rng, 120), "name string, variants array<string>")


@pytest.mark.parametrize("block", [automaton.BLOCK, 300])
def test_hits_equal_patterns(data, block, monkeypatch):
    """In one automaton and in several blocks."""
    rows, listed = data
    want = concepts.concept_hits(rows, listed, ["k"])
    monkeypatch.setattr(concepts, "IN_PLAN", 0)
    monkeypatch.setattr(automaton.blocks, "__defaults__", (block,))
    monkeypatch.setattr(automaton.built, "__defaults__", (block,))
    got = concepts.concept_hits(rows, listed, ["k"])
    have = got.collect()
    assert sorted(map(str, have)) == sorted(map(str, want.collect()))
    names = {r["k"]: None if r["text"] is None else [] for r in rows.collect()}
    for r in have:
        if r["hit"]:
            names[r["k"]].append(r["name"])
    found = automaton.with_found_concepts(rows, listed, size=block)
    assert {r["k"]: r["found"] for r in found.collect()} == {k: None if v is None else sorted(v) for k, v in names.items()}


def test_atoms_are_java_words(spark):
    """Words are cut in Python as the patterns cut them in the JVM."""
    chars = [chr(c) for c in [*range(1, 0x3000), 0x3042, 0x4E00, 0xAC00, 0x1F600, 0x1D7D8]]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    odd = [r["c"] for r in df.select("c", F.col("c").rlike(f"[{T.WORD}]").alias("w"), F.col("c").rlike(f"[{T.BLANK}]").alias("b")).collect() if (r["w"], r["b"]) != (automaton.is_word(r["c"]), r["c"].isspace())]
    assert len(odd) <= 40, odd  # letters that only the newer of the two knows


def test_a_report_with_a_long_list(spark):
    """More concepts than fit a plan: the same report as by patterns."""
    pairs = spark.createDataFrame([(1, "word17 and word18", "word17 alone"), (2, "nothing", None), (3, None, "word3")], "pair_id int, original string, version string")
    listed = spark.createDataFrame([(f"word{i}", [f"word{i}", f"term{i}*"]) for i in range(1500)], "name string, variants array<string>")
    got = {r["pair_id"]: r for r in fidelity_report(pairs, listed).collect()}
    assert got[1]["n_kept"] == 1 and got[1]["n_concepts"] == 1500 and "word18" in got[1]["lost"] and "word17" not in got[1]["lost"] and not got[1]["source_complete"]
    assert got[3]["n_kept"] == 1


def test_a_hundred_thousand_concepts_take_one_pass(spark):
    """Time hardly grows with the list."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60_000)]
    body = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(300)]
    took = []
    for n in (1000, 100_000):
        a = automaton.Automaton([(f"{i}", [words[i % len(words)] + (f" {words[i * 7 % len(words)]}" if i >= len(words) else "")]) for i in range(n)])
        began = time.perf_counter()
        found = a.scan(body)
        took.append(time.perf_counter() - began)
        assert [set(f.tolist()) >= {i for i in range(min(n, len(words))) if words[i] in set(b.split())} for f, b in zip(found[:5], body)] == [True] * 5
    assert took[1] < 12 * took[0] + 1


def test_places_of_few_texts_are_walked_together():
    """A batch of many texts is scanned in parts of bounded size, and the hits are those of the whole batch."""
    rng = random.Random(8)
    rows = texts(rng, 400) + [None, ""]
    listed = terms(rng, 60)
    scanner = automaton.Automaton(sorted((n, [T.fold_text(v).strip() for v in vs]) for n, vs in listed))
    folded = [None if t is None else T.fold_text(t) for t in rows]
    parts = list(automaton.parts(folded, 500))
    assert [t for part in parts for t in part] == folded and len(parts) > 10
    assert all(len(part) == 1 or sum(len(t or "") for t in part) <= 500 for part in parts) and list(automaton.parts([])) == []
    whole, cut = scanner.scan(folded), [f for part in parts for f in scanner.scan(part)]
    assert [None if f is None else f.tolist() for f in whole] == [None if f is None else f.tolist() for f in cut]
    many = ["a word or two of a longer text " * 20] * 5000
    assert sum(map(len, many)) > 10 * automaton.PART and max(sum(map(len, part)) for part in automaton.parts(many)) <= automaton.PART
