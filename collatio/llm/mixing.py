"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Every source's rows are put into a fixed random order and cut into blocks of equal size (characters, at least one a
row). With integer weights a(s) that sum to P, block i (from 0) of source s gets the release time floor(i * P / a(s))
and the deadline ceil((i + 1) * P / a(s)). Slot by slot the released block with the earliest deadline comes next (ties:
the source that comes first by name). All blocks then meet their windows, so that at every slot every source is less
than one block away from its share. The order repeats after P slots, when all sources are level, and so one period
describes a schedule of any length.

When a source's last block is out, a new phase begins: the sources that are left start level, with their weights
against each other kept. No row is dropped or repeated.

Only the number of blocks of each weighted source comes to the driver. A source is weighted if it is in `weights`; all
others, null among them, share one stream with the weight `rest`. So the plan's size is bounded by the parameters: at
most (len(weights) + 1) phases of P rows.

The place of a row in its source's order is a running sum in two levels (buckets of the order, then rows of a bucket),
so that no task ever holds a whole source. The number of buckets grows with the rows. A bucket that is large all the same, since
very many rows have no key or the same, is divided by key and size. The order is by a digest of the key, then the key, then the size.

Null or empty texts count one character, very long ones as many as they have. Rows with equal keys keep a place each (those
with equal sizes in any order), as rows without a key do; an empty table gives an empty result. Other columns stay, whatever their names;
columns of the names slot, block, place and stream are replaced.
"""

from __future__ import annotations

import json
from fractions import Fraction
from math import ceil, floor, log

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .shared import settle

#: Production weights; sources that are not listed share one stream.
WEIGHTS, REST = {"src0": 8, "src1": 4, "src2": 4, "src3": 3, "src4": 3, "src5": 2, "src6": 2, "src7": 1}, 9
#: Characters of a block; rows of a bucket on average and hexadecimal digits that name one, at least; the stream of sources without weight.
BLOCK, BUCKET, DIGITS, SALTS, OTHERS = 65_536, 50_000, 3, 1024, "*"


def period(weights: dict[str, int]) -> list[str]:
    """The source of every slot of one period, earliest deadline first."""
    total = sum(weights.values())
    done = dict.fromkeys(sorted(weights), 0)
    out = []
    for t in range(total):
        ready = [(ceil(Fraction((i + 1) * total, weights[s])), s) for s, i in done.items() if i < weights[s] and floor(Fraction(i * total, weights[s])) <= t]
        s = min(ready)[1]
        done[s] += 1
        out.append(s)
    return out


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[dict]:
    """Phases in order: start slot, period, and of each live source its first block, its number of blocks in this phase and its slots in a period."""
    left, out, start = {s: n for s, n in blocks.items() if n > 0}, [], 0
    done = dict.fromkeys(left, 0)
    while left:
        live = {s: weights[s] for s in sorted(left)}
        order = period(live)
        places = {s: [t for t, x in enumerate(order) if x == s] for s in live}
        full = min(-(-left[s] // live[s]) - 1 for s in live)
        cut = min(places[s][left[s] - full * live[s] - 1] for s in live if left[s] - full * live[s] <= live[s])
        took = {s: full * live[s] + sum(t <= cut for t in places[s]) for s in live}
        out.append({"start": start, "period": len(order), "sources": {s: {"first": done[s], "blocks": took[s], "places": places[s]} for s in live}})
        start += full * len(order) + cut + 1
        for s, n in took.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    return out


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's as one literal, without Python objects on the executors; as long as the weights' sum and the phases allow, so that it is broadcast."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    kind = "array<struct<" + ", ".join(": ".join(c.split()) for c in schema.split(", ")) + ">>"
    return F.broadcast(spark.range(1).select(F.explode(F.from_json(F.lit(text), kind)).alias("x")).select("x.*"))


def places(df: DataFrame, weights: dict[str, int], source: str, key: str, size: Column, block: int, seed: int) -> DataFrame:
    """(row, stream, place, block): df's rows whole, and the characters before each in its stream's order."""
    stream = F.when(F.col(source).isin(*weights), F.col(source)).otherwise(F.lit(OTHERS)) if weights else F.lit(OTHERS)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))
    size = F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(1)).cast("long")
    digits = max(DIGITS, ceil(log(max(df.count(), 1) / BUCKET, 16)))
    rows = df.select(F.struct("*").alias("row"), F.coalesce(stream, F.lit(OTHERS)).alias("stream"), F.col(key).alias("key"), size.alias("size"), digest.alias("digest"))
    rows = rows.withColumn("bucket", F.substring("digest", 1, digits))
    sums = settle(rows.groupBy("stream", "bucket").agg(F.sum("size").alias("n"), F.count("*").alias("rows")))
    busy = sums.where(F.col("rows") > shared.HOT_ROWS).select("stream", "bucket")
    names = ["stream", "bucket"]
    if not busy.isEmpty():
        listed = busy.withColumn("busy", F.lit(True))
        # equal rows of one key may come in any order, so that a number deals them out
        rows = settle(rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))))
        rows = rows.join(F.broadcast(listed) if listed.count() <= shared.SENT else listed, names, "left")
        rows = rows.withColumn("part", F.when(F.col("busy"), F.struct("digest", "key", "size", "salt"))).drop("busy")
        sums = rows.groupBy(*names, "part").agg(F.sum("size").alias("n"))
        names.append("part")
    before = Window.partitionBy("stream").orderBy(*names[1:]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*names, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*names).orderBy("digest", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    same = (F.col("r.stream") == F.col("b.stream")) & (F.col("r.bucket") == F.col("b.bucket"))
    if "part" in names:
        same = same & F.col("r.part").eqNullSafe(F.col("b.part"))
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("r").join(sums.alias("b"), same)
    return placed.select("r.row", "r.stream", (F.col("b.base") + F.col("r.ahead")).alias("place")).withColumn("block", F.expr(f"place div {block}"))


def mix(df: DataFrame, weights: dict[str, int] | None = None, rest: int = REST, source: str = "source", key: str = "doc_id", text: str = "text", size: str | None = None, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """df's rows with stream, block (of the stream), slot (of the mixture) and place (characters before the row in its stream).

    Rows read in the order (slot, place) are the mixture. size: a column that holds the characters of a row, if there is one.
    """
    weights = WEIGHTS if weights is None else weights
    if any(not isinstance(w, int) or w < 1 for w in [*weights.values(), rest]) or OTHERS in weights:
        raise ValueError("weights are positive integers, and the name of the stream of all others is taken")
    spark, own = df.sparkSession, [c for c in df.columns if c not in ("stream", "block", "slot", "place")]
    rows = settle(places(df.select(*[F.col(f"`{c}`") for c in own]), weights, source, key, F.col(size) if size else F.length(text), block, seed))
    counts = {r["stream"]: r["n"] + 1 for r in rows.groupBy("stream").agg(F.max("block").alias("n")).collect()}
    plan = phases(counts, weights | {OTHERS: rest})
    spans = table(spark, [(s, k, x["first"], x["first"] + x["blocks"] - 1, len(x["places"]), p["start"], p["period"]) for k, p in enumerate(plan) for s, x in p["sources"].items()], "stream string, phase int, low long, high long, share long, begin long, round long")
    slots = table(spark, [(s, k, i, t) for k, p in enumerate(plan) for s, x in p["sources"].items() for i, t in enumerate(x["places"])], "stream string, phase int, turn long, at long")
    r, s = rows.alias("r"), spans.alias("s")
    found = r.join(s, (F.col("r.stream") == F.col("s.stream")) & F.col("r.block").between(F.col("s.low"), F.col("s.high")))
    found = found.select("r.*", "s.phase", "s.begin", "s.round", F.expr("(r.block - s.low) div s.share").alias("rounds"), F.expr("(r.block - s.low) % s.share").alias("turn"))
    return found.join(slots, ["stream", "phase", "turn"]).select("row.*", "stream", "block", (F.col("begin") + F.col("rounds") * F.col("round") + F.col("at")).alias("slot"), "place")


def op3_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    """Where every document comes in the mixture of all sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs.select("doc_id", "source", F.length("text").alias("n_chars")), size="n_chars")
    return out.select("doc_id", "source", "stream", "block", "slot", "place")


def op3_sql() -> str:
    """The same by simulating every slot."""
    names = sorted([*WEIGHTS, OTHERS])
    share = {**WEIGHTS, OTHERS: REST}
    listed = ", ".join(f"'{s}'" for s in WEIGHTS)
    weights = ", ".join(str(share[s]) for s in names)
    return f"""
WITH RECURSIVE names AS (SELECT unnest([{", ".join(f"'{s}'" for s in names)}]) AS stream, unnest(generate_series(1, {len(names)})) AS i),
d AS (SELECT doc_id, source, CASE WHEN source IN ({listed}) THEN source ELSE '{OTHERS}' END AS stream, greatest(coalesce(length(text), 0), 1) AS n, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents),
o AS (SELECT doc_id, source, stream, CAST(sum(n) OVER (PARTITION BY stream ORDER BY k, doc_id, n ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS place FROM d),
b AS (SELECT *, place // {BLOCK} AS block FROM o),
c AS (SELECT list(coalesce(n, 0) ORDER BY i) AS n FROM names LEFT JOIN (SELECT stream, max(block) + 1 AS n FROM b GROUP BY stream) USING (stream)),
run AS (
  SELECT -1::BIGINT AS slot, 0::BIGINT AS pick, 0::BIGINT AS t, list_transform(n, lambda x: 0::BIGINT) AS done, n AS rest FROM c
  UNION ALL
  SELECT slot + 1, p, CASE WHEN rest[p] = 1 THEN 0 ELSE t + 1 END,
    CASE WHEN rest[p] = 1 THEN list_transform(done, lambda x: 0::BIGINT) ELSE list_transform(done, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END) END,
    list_transform(rest, lambda x, i: x - CASE WHEN i = p THEN 1 ELSE 0 END)
  FROM (SELECT *, list_min(list_transform(list_filter(generate_series(1, {len(names)}), lambda i: rest[i] > 0 AND (done[i] * total) // w[i] <= t), lambda i: (((done[i] + 1) * total + w[i] - 1) // w[i]) * 100000 + i)) % 100000 AS p
    FROM (SELECT *, [{weights}]::BIGINT[] AS w, list_sum(list_transform([{weights}]::BIGINT[], lambda x, i: CASE WHEN rest[i] > 0 THEN x ELSE 0 END))::BIGINT AS total FROM run) WHERE total > 0)
),
slots AS (SELECT slot, stream, row_number() OVER (PARTITION BY stream ORDER BY slot) - 1 AS block FROM run JOIN names ON pick = i)
SELECT doc_id, source, stream, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot, place FROM b JOIN slots USING (stream, block)
"""
