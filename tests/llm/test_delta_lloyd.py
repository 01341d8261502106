"""Delta Lloyd against Lloyd's rounds in plain Python, on awkward vectors."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from collatio.llm import delta_lloyd as dl

SIZE = 4
SCHEMA = "vec_id long, embedding array<float>, row string, v string, owner string, was int, distance string, found string"


def vectors(n: int) -> list[tuple]:
    rng = random.Random(n)
    rows = [(i, [rng.choice((-3.0, -0.51, 0.0, 1.25, 2.0)) + rng.random() / 3 for _ in range(SIZE)]) for i in range(n)]
    rows += [(n + i, [0.25] * SIZE) for i in range(n // 3)]  # a hot vector
    odd = [None, [], [1.0] * (SIZE + 1), [1.0] * (SIZE - 1), [1.0, None, 1.0, 1.0], [float("nan")] * SIZE, [1.0, 1.0, float("inf"), 1.0], [-float("inf"), 0.0, 0.0, 0.0]]
    rows += [(5000 + i, x) for i, x in enumerate(odd)] + [(None, [0.5] * SIZE), *rows[:3]]
    return rows


def lloyd(rows: list[tuple], k: int, rounds: int) -> list[tuple]:
    good = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == SIZE and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(good, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own = [[v for _, v in good if near(v) == c] for c in range(len(centroids))]
        centroids = [tuple(sum(x) // len(x) for x in zip(*o)) if o else c for o, c in zip(own, centroids)]
    out = [(i, near(v), far(v, centroids[near(v)])) for i, v in good]
    total = lambda c: sum(d for _, x, d in out if c in (None, x))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, total(c), total(None), sha[c]) for i, c, d in out]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "r", "v", "o", 1, "d", "f") for i, v in rows], SCHEMA)


@pytest.mark.parametrize("n, k, rounds", [(60, 5, 3), (60, 16, 1), (7, 16, 3), (0, 4, 2), (90, 3, 0), (40, 4, 12)])
def test_clusters_equal_plain_rounds(spark, n, k, rounds):
    rows = vectors(n)
    got = dl.with_clusters(frame(spark, rows), k=k, rounds=rounds, size=SIZE)
    assert got.columns == ["vec_id", "row", "v", "owner", "was", "distance", "found"]
    assert {(r["row"], r["v"], r["owner"], r["was"], r["distance"]) for r in got.collect()} <= {("r", "v", "o", 1, "d")}
    names = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    have = [tuple(r) for r in got.select("vec_id", *[F.col(f"found.{c}") for c in names]).collect()]
    assert sorted(map(repr, have)) == sorted(map(repr, lloyd(rows, k, rounds)))


def test_no_vector_is_kept(spark):
    assert dl.with_clusters(frame(spark, [(1, None), (2, [1.0])]), size=SIZE).count() == 0
    assert dl.with_clusters(frame(spark, vectors(9)).limit(0), size=SIZE).count() == 0
    assert dl.with_clusters(frame(spark, vectors(9)).select("embedding", F.lit(1).alias("vec_id")), size=SIZE).columns == ["vec_id", "found"]


@pytest.mark.parametrize("most", [50, 1 << 26])
def test_a_round_after_changes_equals_full_comparison(most):
    """Rows of unchanged owners see changed centroids only and still end at the nearest; large components are exact too."""
    rng = np.random.default_rng(most)
    x, old = rng.integers(-most, most, (400, SIZE)), rng.integers(-most, most, (6, SIZE))
    full = lambda c: dl.assigned(x, np.full(len(x), -1), np.zeros(len(x), np.int64), c, np.ones(6, bool))
    exact = lambda c: [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)), i) for i, w in enumerate(c)) for v in x]
    owner, distance = full(old)
    for hit in ([], [2], [0, 5], range(6)):
        new = old.copy()
        new[list(hit)] += rng.integers(-most // 3, most // 3, (len(hit), SIZE))
        changed = (new != old).any(1)
        got = dl.assigned(x, owner, distance, new, changed)
        assert [(d, o) for o, d in zip(*(a.tolist() for a in got))] == exact(new)


def test_order_of_packed_rows():
    rows = np.array([[-5, 3], [-5, -7], [0, 0], [2, -1], [-300, 9]])
    assert sorted(map(tuple, rows.tolist())) == [tuple(np.frombuffer(b, ">u4").astype(int) - (1 << 31)) for b in sorted(r.tobytes() for r in dl.packed(rows))]


def test_components_that_are_too_large(spark):
    with pytest.raises(Exception, match="would not be exact"):
        dl.with_clusters(frame(spark, [(1, [1e30] * SIZE)]), size=SIZE).collect()
