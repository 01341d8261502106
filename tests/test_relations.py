"""As-of joins, frames, stretches, levels, sketches, samples and multisets against plain statements, on hot keys, ties and nulls."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from collatio.operators import levels, order, spans


def moments(seed: int, n: int):
    """(key, at) rows: a hot key, nulls, ties, moments on the edges of buckets."""
    r = random.Random(seed)
    return [(r.choice(("hot", "hot", "hot", "a", "b", None)), r.choice((None, r.randrange(-50, 400), 10 * r.randrange(40)))) for _ in range(n)]


@pytest.mark.parametrize("bucket", [10, 64, 10_000])
def test_as_of_equals_a_plain_statement(spark, bucket):
    asked = [(i, *x, "r") for i, x in enumerate(moments(1, 150))]
    saved = [(*x, i % 7) for i, x in enumerate(moments(2, 120))]
    left = spark.createDataFrame(asked, "i int, key string, at int, row string")
    right = spark.createDataFrame(saved, "key string, at int, t int")
    got = order.as_of(left, right, ["key"], "at", ["t"], "last", bucket)
    assert got.columns == ["i", "key", "at", "row", "last"]
    for x in got.collect():
        before = [(t, v) for k, t, v in saved if x["key"] is not None and x["at"] is not None and k == x["key"] and t is not None and t <= x["at"]]
        assert (tuple(x["last"]) if x["last"] else None) == max(before, default=None)
    assert got.count() == len(asked) and order.as_of(left, right.limit(0), ["key"], "at", ["t"], "last").where("last IS NOT NULL").count() == 0


def test_last_saved_versions(spark):
    """Of a paragraph, the version that was saved last when a reader asked."""
    saved = spark.sql("SELECT * FROM VALUES (1, 1, timestamp'2024-01-01 10:00:00', 'one'), (1, 1, timestamp'2024-01-03 10:00:00', 'two'), (1, 2, timestamp'2024-01-01 10:00:00', 'x') AS s(doc_id, para_no, at, text)")
    asked = spark.sql("SELECT * FROM VALUES (1, 1, timestamp'2024-01-01 09:59:59'), (1, 1, timestamp'2024-01-01 10:00:00'), (1, 1, timestamp'2024-01-02 12:00:00'), (1, 1, timestamp'2024-02-01 00:00:00'), (2, 1, timestamp'2024-02-01 00:00:00') AS s(doc_id, para_no, at)")
    got = order.as_of(asked, saved, ["doc_id", "para_no"], "at", ["text"], "saved").orderBy("doc_id", "at").select("saved.text").collect()
    assert [r[0] for r in got] == [None, "one", "one", "two", None]


@pytest.mark.parametrize("before, after, bucket", [(0, 0, 1), (30, 0, 30), (10, 25, 64), (0, 40, 10_000)])
def test_frames_equal_a_plain_statement(spark, before, after, bucket):
    rows = [(i, k, t, i % 5) for i, (k, t) in enumerate(moments(3, 160))]
    df = spark.createDataFrame(rows, "i int, key string, at int, v int")
    got = order.near_rows(df, ["key"], "at", before, after, {"n": F.count("*"), "most": F.max("v")}, bucket)
    assert got.columns == ["i", "key", "at", "v", "n", "most"] and got.count() == len(rows)
    for x in got.collect():
        near = [v for _, k, t, v in rows if x["at"] is not None and k == x["key"] and t is not None and x["at"] - before <= t <= x["at"] + after]
        assert (x["n"], x["most"]) == ((len(near), max(near)) if near else (None, None))
    with pytest.raises(ValueError):
        order.near_rows(df, ["key"], "at", 30, 0, {"n": F.count("*")}, 10)


@pytest.mark.parametrize("size", [3, 1024])
def test_stretches_inside_stretches(spark, size):
    r = random.Random(size)
    make = lambda n, wide: [(r.choice((1, 1, 2, None)), "k", s := r.randrange(60), s + r.randrange(wide)) for _ in range(n)]
    inner, outer = make(80, 6), make(40, 30)
    schema = "doc int, kind string, start int, stop int"
    got = spans.within(spark.createDataFrame(inner, schema), spark.createDataFrame(outer, schema), ["doc"], size)
    want = Counter((d, "k", a, b, "k", c, e) for d, _, a, b in inner for f, _, c, e in outer if d is not None and d == f and c <= a and b <= e)
    assert Counter(map(tuple, got.collect())) == want


def test_spans_of_a_text(spark):
    text = 'He said “never say: twelve words” and "...   ..................". No, 3 nuncas; jamás nunca.'
    version = "one two three four five six seven eight nine x one two three four five six seven eight"
    df = spark.createDataFrame([(1, text, "One two three four five six seven eight nine ten", version), (2, None, None, None)], "k int, text string, a string, b string")
    got = df.select("k", spans.quotation_spans(F.col("text")).alias("q"), spans.flagged_spans(F.col("text")).alias("f"), spans.copied_spans(F.col("a"), F.col("b")).alias("c")).orderBy("k").collect()
    cut = lambda t, xs: [t[x["start"] : x["stop"]] for x in xs]
    assert cut(text, got[0]["q"]) == ["never say: twelve words"]
    assert [w.lower() for w in cut(text, got[0]["f"])] == ["never", "no", "3", "jamás", "nunca"]
    assert cut(version, got[0]["c"]) == ["one two three four five six seven eight nine", "one two three four five six seven eight"]
    assert got[1]["q"] is got[1]["f"] is got[1]["c"] is None


def test_levels_and_their_bits(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), ("b", "x", 4)], "k string, s string, v int")
    got = {(r["k"], r["s"], r["level"]): r["t"] for r in levels.by_levels(df, [["k", "s"], ["k"], []], [F.sum("v").alias("t")]).collect()}
    assert got == {("a", None, 0): 1, ("a", "x", 0): 2, ("b", "x", 0): 4, ("a", None, 1): 3, ("b", None, 1): 4, (None, None, 3): 7}


def test_sketches_merge_within_their_error(spark):
    """Sketches stored by day and merged estimate what exact counts give, within four standard errors, alone and shared."""
    df = spark.range(200_000).select((F.col("id") % 9).alias("day"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.when(F.col("id") < 120_000, F.col("id") % 40_000).otherwise(F.col("id")).cast("string").alias("v"))
    df = df.unionAll(df.where("g = 'a' AND v < '5'").withColumn("g", F.lit("b")))
    merged = levels.merged_sketches(levels.stored_sketches(df, ["g", "day"], "v"), ["g"])
    exact = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.countDistinct("v").alias("n")).collect()}
    for r in levels.estimates(merged, ["g"]).collect():
        assert abs(r["n_distinct"] / exact[r["g"]] - 1) < 4 * 1.04 / 2 ** (levels.DISTINCT_BITS / 2)
    shared = df.where("g = 'a'").select("v").distinct().join(df.where("g = 'b'").select("v").distinct(), "v").count()
    (pair,) = levels.shared_estimates(merged, "g", spark.createDataFrame([("a", "b")], "a string, b string")).collect()
    assert (pair["a"], pair["b"]) == ("a", "b") and abs(pair["n_shared"] - shared) < 4 * (exact["a"] + exact["b"]) / 2 ** (levels.SHARED_BITS / 2)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise((F.col("id") % 3).cast("string")).alias("s"), (F.col("id") % 4).alias("w"))
    for weight in (None, F.col("w")):
        got = [sorted(map(tuple, levels.sampled(df.repartition(n), ["s"], "id", 7, "x", weight).collect())) for n in (1, 5, 13)]
        assert got[0] == got[1] == got[2] and Counter(r[1] for r in got[0]) == {"hot": 7, "0": 7, "1": 7, "2": 7}
    assert all(r["w"] > 0 for r in levels.sampled(df, ["s"], "id", 900, "x", F.col("w")).collect())
    heavy = Counter(r["w"] for k in range(40) for r in levels.sampled(df.where("s = 'hot'"), ["s"], "id", 5, str(k), F.col("w")).collect())
    assert heavy[3] > heavy[1]
    assert levels.sampled(df.where("id < 3"), ["s"], "id", 7).count() == 3


def test_multisets(spark):
    df = spark.createDataFrame([(1, "a b c d a b c d", "a b c d a b c d a b c d"), (2, None, "x y z w"), (3, "x y z w", None)], "k int, original string, version string")
    assert {(r["k"], r["gram"]): r["n_more"] for r in levels.said_more_often(df, ["k"]).collect()} == {(1, "a b c d"): 1, (1, "b c d a"): 1, (1, "c d a b"): 1, (1, "d a b c"): 1, (2, "x y z w"): 1}
    assert [tuple(r) for r in levels.said_in_both(df, ["k"]).collect()] == [(1, 5)]


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_multisets_of_keys_of_one_row_are_not_shuffled(spark):
    rows = [(1, "a b c d a b c d", "a b c d a b c d a b c d"), (None, "", "x y z w x y z w x"), (4, None, None)]
    df = spark.createDataFrame(rows, "k int, original string, version string")
    for made in (levels.said_more_often(df, ["k"]), levels.said_in_both(df, ["k"]), levels.said_repeatedly(df, ["k"], "version", 4)):
        assert "Exchange" not in planned(made)


def test_multisets_equal_plain_statements_whatever_keys_repeat(spark):
    r = random.Random(7)
    text = lambda: r.choice((None, "", " ".join(r.choice("abc") for _ in range(r.randrange(30)))))
    rows = [(r.choice((None, k, 1, k)), text(), text()) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, original string, version string")

    def grams(i: int, n: int) -> Counter:
        return Counter((row[0], " ".join(w[j : j + n])) for row in rows if row[i] is not None for w in [row[i].split()] for j in range(len(w) - n + 1))

    got = lambda made: Counter(map(tuple, made.collect()))
    had, have = grams(1, 4), grams(2, 4)
    assert got(levels.said_more_often(df, ["k"])) == Counter((*g, n) for g, n in (have - had).items())
    both = Counter()
    for (k, _), n in (have & had).items():
        both[k] += n
    assert got(levels.said_in_both(df, ["k"])) == Counter(both.items())
    assert got(levels.said_repeatedly(df, ["k"], "version", 3)) == Counter((*g, n) for g, n in grams(2, 3).items() if n > 1)


@pytest.mark.parametrize("groups", [0, 1, 5, 62, 70])
def test_values_in_common_equal_a_plain_statement(spark, groups):
    """Groups as bits of a number and, beyond it, as sets; a value is shuffled once as bits."""
    r = random.Random(groups)
    rows = [(None if k % 9 == 0 else f"s{k % groups}", None if k % 11 == 0 else r.randrange(40)) for k in range(400 if groups else 0)]
    df = spark.createDataFrame(rows, "s string, v long")
    made = levels.values_in_common(df, "s", "v")
    own = {}
    for s, v in rows:
        if s is not None and v is not None:
            own.setdefault(s, set()).add(v)
    want = {(a, b, n) for a in own for b in own if a < b and (n := len(own[a] & own[b]))}
    assert Counter(map(tuple, made.collect())) == Counter(want)
    if groups == 5:
        assert planned(levels.values_in_common(df, "s", "v")).count("hashpartitioning(v") == 1
