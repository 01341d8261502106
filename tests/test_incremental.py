"""Keyed state on streams, sessions, and reports and progress that are stored once."""

from __future__ import annotations

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from collatio.plans.incremental import incremental_report, stored
from collatio.plans.report import fidelity_report
from collatio.sources import texts
from collatio.streaming import tries as stream

SCHEMA = "doc int, para int, at timestamp, round int, try int, problem string, share double, text string"
START = datetime.datetime(2024, 1, 1, 12)


def tries(seed: int, n: int):
    """Tries of a few paragraphs in two stretches of activity; each (round, try) once."""
    r = random.Random(seed)
    out = []
    for doc in range(4):
        for k in range(n):
            minute = r.randrange(0, 40) + (120 if k >= n // 2 else 0)
            problem = r.choice((None, "(copied)", "(accents lost)", "(copied)"))
            out.append((doc, doc % 2, START + datetime.timedelta(minutes=minute, seconds=k), k // 3, k % 3, problem, round(r.random(), 3), f"{doc}-{k}"))
    return out


def parts(spark, folder, rows, names):
    """Rows as files, one after another."""
    for k, name in enumerate(names):
        spark.createDataFrame(rows[k :: len(names)], SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, source, out, checkpoint):
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    stream.chosen_stream(rows, ["doc", "para"], late="6 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_late_repeated_and_restarted_input_gives_the_batch_result(spark, tmp_path):
    rows = tries(1, 12)
    random.Random(2).shuffle(rows)
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    parts(spark, source, rows[: len(rows) // 2] + rows[:7], ["a", "b"])
    run(spark, source, out, mark)
    # the rest comes later, some of it again, after a restart; rows far ahead move the watermark past all sessions
    later = [(9, 9, START + datetime.timedelta(days=d), 0, d, None, 0.0, "end") for d in (3, 5)]
    parts(spark, source, rows[len(rows) // 2 :] + rows[3:9], ["c", "d"])
    run(spark, source, out, mark)
    for k, row in enumerate(later):
        parts(spark, source, [row], [f"e{k}"])
        run(spark, source, out, mark)
    got = spark.read.parquet(out).where("doc < 9")
    want = stream.chosen_by_session(spark.createDataFrame(rows, SCHEMA), ["doc", "para"])
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert want.count() > 8 and {r["status"] for r in want.collect()} >= {"accepted", "copied"}


def test_rows_behind_the_watermark_do_not_count(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    first = (1, 1, START, 0, 0, "(copied)", 0.5, "copied")
    for name, row in (("a", first), ("b", (2, 1, START + datetime.timedelta(days=2), 0, 0, None, 0.1, "x")), ("c", (1, 1, START + datetime.timedelta(minutes=1), 0, 1, None, 0.1, "late")), ("d", (2, 1, START + datetime.timedelta(days=4), 0, 1, None, 0.1, "y"))):
        parts(spark, source, [row], [name])
        run(spark, source, out, mark)
    assert [(r["status"], r["text"], r["n_tries"]) for r in spark.read.parquet(out).where("doc = 1").collect()] == [("copied", "copied", 1)]


def test_choices_natively_and_one_by_one(spark):
    rows = tries(3, 15)
    want = []
    for doc in range(4):
        own = [(int(t[2].replace(tzinfo=datetime.timezone.utc).timestamp() * 1000), *t[3:]) for t in rows if t[0] == doc]
        want += [(doc, doc % 2, *stream.choice(s)) for s in stream.sessions_of(own, 600_000)]
    assert Counter(map(tuple, stream.chosen_by_session(spark.createDataFrame(rows, SCHEMA), ["doc", "para"]).collect())) == Counter(want)


def test_sessions_of_events(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = stream.user_sessions(events).collect()
    assert sum(r["n_events"] for r in got) == events.count()
    n = 0
    for user, rows in {r["user_id"]: r["m"] for r in events.groupBy("user_id").agg(F.sort_array(F.collect_list("ts")).alias("m")).collect()}.items():
        n += 1 + sum(b - a >= datetime.timedelta(minutes=30) for a, b in zip(rows, rows[1:]))
    assert len(got) == n


@pytest.fixture
def pairs(spark):
    return spark.range(100).select(F.col("id").alias("pair_id"), F.concat(F.lit("The man did not come to town "), F.col("id")).alias("original"), F.concat(F.lit("A man came to town "), F.col("id")).alias("version"))


def concepts(spark, *names):
    return spark.createDataFrame([(n, [n]) for n in names], "name string, variants array<string>")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_only_what_changed_is_computed(spark, pairs, tmp_path):
    store, listed = str(tmp_path / "store"), concepts(spark, "man", "town")
    pairs = pairs.unionAll(pairs.where("pair_id < 3")).unionAll(spark.createDataFrame([(200, None, "x"), (201, "", "x"), (202, None, None)], "pair_id long, original string, version string"))
    assert rows_of(incremental_report(pairs, listed, store, 1)) == rows_of(fidelity_report(pairs, listed))
    assert stored(spark, store).count() == 103
    changed = pairs.withColumn("version", F.when(F.col("pair_id") == 7, "nothing").otherwise(F.col("version")))
    for batch in (2, 2):  # the second run of a batch adds nothing
        assert rows_of(incremental_report(changed, listed, store, batch)) == rows_of(fidelity_report(changed, listed))
        assert stored(spark, store).groupBy("batch").count().orderBy("batch").collect()[-1]["count"] == 1
    assert rows_of(incremental_report(changed, listed, store, 3)) == rows_of(fidelity_report(changed, listed))
    assert stored(spark, store).count() == 104
    more = concepts(spark, "man", "come")  # another list is another report
    assert rows_of(incremental_report(changed, more, store, 4)) == rows_of(fidelity_report(changed, more))
    assert incremental_report(pairs.limit(0), listed, str(tmp_path / "none"), 1).count() == 0


def test_a_retried_batch_of_progress_replaces_itself(spark, tmp_path):
    path, target = str(tmp_path / "p"), str(tmp_path / "q")
    paras = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z")], "doc_id int, para_no int, para string")
    done = lambda *rows: spark.createDataFrame(rows, "doc_id int, para_no int, para string, n int")
    for _ in range(2):
        texts.save_progress(done((1, 1, "one", 0), (1, 2, "zz", 1), (1, 2, "aa", 2)), path, 1)
    assert spark.read.parquet(path).count() == 3
    texts.save_progress(done((1, 1, "newer", 0)), path, 2)
    want = [("newer", True), ("aa", True), ("z", False)]
    assert [(r["para"], r["done"]) for r in texts.with_progress(paras, path, ["doc_id", "para_no"], order="n").orderBy("para_no").collect()] == want
    texts.compact_progress(spark, path, target, ["doc_id", "para_no"], order="n")
    assert spark.read.parquet(target).count() == 2
    assert [(r["para"], r["done"]) for r in texts.with_progress(paras, target, ["doc_id", "para_no"]).orderBy("para_no").collect()] == want
