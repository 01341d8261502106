"""The manifest against trees built whole in plain Python: unaligned chunks, short runs, many trees, awkward rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from collatio.llm import merkle_manifest as mm

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf string, key string, rank int, `a.b` string"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row: tuple) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def grown(nodes: list[str], fanout: int) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def way(levels: list[list[str]], i: int, fanout: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for nodes in levels[:-1]:
        run = nodes[i // fanout * fanout :][:fanout]
        out.append((run[: i % fanout], run[i % fanout + 1 :]))
        i //= fanout
    return out


def plain(rows: list[tuple], fanout: int) -> list[tuple]:
    def tampered(row):
        low = row[4] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        return (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])) if low else row

    names = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in names}
    levels = {x: grown([leaf(r) for r in own], fanout) for x, own in trees.items()}
    top = grown([levels[x][-1][0] for x in names], fanout)
    out = []
    for k, x in enumerate(names):
        for i, r in enumerate(trees[x]):
            path = way(levels[x], i, fanout) + way(top, k, fanout)
            h = leaf(tampered(r))
            for a, b in path:
                h = sha("".join([*a, h, *b]))
            out.append((r[0], leaf(r), levels[x][-1][0], top[-1][0], sha("".join(d for a, b in path for d in a + b)), h, h == top[-1][0]))
    return out


def documents(n: int, langs: int) -> list[tuple]:
    rng = random.Random(n)
    rows = [(rng.randrange(3 * n), f"src{rng.randrange(3)}", None if (k := rng.randrange(langs)) == 0 else f"l{k}" if k > 1 else "ünï", rng.randrange(9), rng.choice(("Some Text", "some text", "ÀB日本", "")) + str(rng.randrange(5))) for _ in range(n)]
    rows += [(None, None, None, None, None), (None, "x", "en", 1, "A" * 50_000), (7, "", "", 0, ""), (7, "", "", 0, ""), (7, "s", "", 0, "Q")]
    return rows + rows[:4]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "l", "k", 1, "b") for r in rows], SCHEMA)


def held():
    return {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", mm.UPPER, mm.LOWER)).otherwise(F.col("text"))}


@pytest.mark.parametrize("n, langs, fanout, chunk, meet", [(700, 3, 8, 13, 2), (300, 60, 8, 16, 64), (40, 2, 2, 3, 3), (0, 1, 8, 5, 64), (260, 1, 3, 1, 4), (900, 2, 8, 16_384, 64)])
def test_rows_equal_whole_trees(spark, monkeypatch, n, langs, fanout, chunk, meet):
    monkeypatch.setattr(mm, "MERGED", meet)
    rows = documents(n, langs)
    f = mm.manifest(frame(spark, rows), held=held(), fanout=fanout, chunk=chunk)
    got = mm.proofs(f)
    assert got.columns == ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain(rows, fanout)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {w[-1] for w in want} == ({True, False} if n else {w[-1] for w in want})
    nodes = sum(len(level) for x in {r[2] for r in rows} for level in grown(["" for r in rows if r[2] == x], fanout))
    assert mm.node_records(f).select(F.sum(F.length("digests"))).first()[0] == 32 * nodes


@pytest.mark.parametrize("fanout", [2, 8])
def test_mountains_in_pieces_equal_a_whole_tree(fanout):
    """Any cuts into chunks and pushes: what chunks complete and what their peaks fill together is the whole tree."""
    rng = random.Random(fanout)
    for total in [*range(1, 40), 64, 65, 513, 1000]:
        nodes = [sha(str(i)) for i in range(total)]
        levels, peaks, made = grown(nodes, fanout), [], {}
        cuts = sorted({0, total, *(rng.randrange(total) for _ in range(rng.randrange(5)))})
        for a, b in zip(cuts, cuts[1:]):
            m = mm.Mountains(a, total, fanout)
            at = a
            while at < b:
                step = rng.randint(1, b - at)
                m.push("".join(nodes[at : at + step]).encode())
                at += step
            peaks += m.close()
            for k, (first, digests) in enumerate(m.records()):
                made |= {(k, first + i): digests[64 * i : 64 * i + 64].decode() for i in range(len(digests) // 64)}
        runs, rest = mm.filled(total, fanout, peaks)
        made |= {(k + 1, j): sha(children.decode()) for k, j, children in runs}
        assert made == {(k, i): d for k, level in enumerate(levels) for i, d in enumerate(level)}
        assert [d.decode() for _, _, d in rest] == levels[-1]


def test_hot_runs_are_split(spark, monkeypatch):
    rows = documents(200, 2)
    whole = sorted(map(str, mm.proofs(mm.manifest(frame(spark, rows), held=held(), chunk=5)).collect()))
    from collatio.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 3)
    assert sorted(map(str, mm.proofs(mm.manifest(frame(spark, rows), held=held(), chunk=5)).collect())) == whole


def test_empty_table_and_other_keys(spark):
    rows = frame(spark, documents(20, 2))
    assert mm.proofs(mm.manifest(rows.limit(0))).count() == 0
    named = mm.proofs(mm.manifest(rows, key="source", tree="n_chars", fields=("text",)))
    assert named.schema["key"].dataType.simpleString() == "string" and named.where("not verified").count() == 0 and named.count() == rows.count()
