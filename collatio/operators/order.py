"""Joins and frames by order: the last row at or before a moment, and what lies within a distance of each row.

Both cut a key's rows into buckets of time (or place), so that a key that has a large part of all rows is many groups. As-of joins carry the last value of
earlier buckets over; frames repeat rows near a bucket's edge in its neighbour. Columns of the caller stay in one struct on the way,
so that no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds of a bucket of time.
DAY = 86_400_000_000


def number(at: Column, kind: str) -> Column:
    """A moment in microseconds (without a time zone: of its own clock), or a whole number as it is."""
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)
    return F.unix_micros(at.cast("timestamp")) if kind in ("timestamp", "date") else at.cast("long")


def bucket_of(t: Column, width: int) -> Column:
    return ((t - F.pmod(t, F.lit(width))) / width).cast("long")


def whole(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def as_of(left: DataFrame, right: DataFrame, key: list[str], at: str, values: list[str], into: str, bucket: int = DAY) -> DataFrame:
    """left, and a struct `into` of at and values of the last row of right with its key, at or before its moment; null if there is none.

    Of rows of right with one key and moment the one of the greatest values counts. Null keys and null moments match nothing. Rows are
    united and ordered inside (key, bucket), where the last value so far is taken; what comes from earlier buckets is one row a
    bucket. bucket: microseconds, or units of a whole-number order.
    """
    keys = [f"k{i}" for i in range(len(key))]

    def slim(df: DataFrame, *more: Column) -> DataFrame:
        t = number(F.col(f"`{at}`"), dict(df.dtypes)[at])
        return df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, keys)], t.alias("t"), bucket_of(t, bucket).alias("b"), *more)

    found = F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([at, *values])])
    saved = slim(right, found.alias("v")).where(" AND ".join(f"{k} IS NOT NULL" for k in [*keys, "t"]))
    saved = saved.groupBy(*keys, "t", "b").agg(F.max("v").alias("v"))
    asked = slim(left, whole(left).alias("row"))
    kind = saved.schema["v"].dataType
    rows = saved.select(*keys, "t", "b", "v", F.lit(False).alias("asks"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    rows = rows.unionAll(asked.select(*keys, "t", "b", F.lit(None).cast(kind).alias("v"), F.lit(True), "row"))
    so_far = Window.partitionBy(*keys, "b").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "b").agg(F.max(F.when(~F.col("asks"), F.struct("t", "v"))).alias("own"))
    carried = carried.select(*keys, "b", F.last("own.v", True).over(earlier).alias("before"))
    last = rows.withColumn("last", F.last("v", True).over(so_far)).where("asks")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*keys, "b"]]
    joined = last.alias("l").join(carried.alias("c"), same, "left")
    value = F.when(F.col("l.t").isNotNull(), F.coalesce("l.last", "c.before"))
    return joined.select(*[F.col("l.row").getField(c).alias(c) for c in left.columns if c != into], value.alias(into))


def near_rows(df: DataFrame, key: list[str], at: str, before: int, after: int, measures: dict[str, Column], bucket: int = DAY) -> DataFrame:
    """df, and aggregates over the rows of its key that lie from `before` units in front of it to `after` behind it, itself and ties included.

    Units are microseconds for moments, else those of the whole number. Rows without a moment get null. measures: aggregates of df's columns.
    """
    if bucket < max(before, after, 1):
        raise ValueError("a bucket must be as wide as the frame's wider side")
    kind = dict(df.dtypes)[at]
    keys = [f"k{i}" for i in range(len(key))]
    # rows that measures name are columns of their own; the row as the caller has it comes back from its struct
    rows = df.select("*", whole(df).alias("__row"), *[F.col(f"`{k}`").alias(f"__{n}") for k, n in zip(key, keys)], number(F.col(f"`{at}`"), kind).alias("__t"))
    b = bucket_of(F.col("__t"), bucket)
    homes = F.array_distinct(F.array(b, bucket_of(F.col("__t") + before, bucket), bucket_of(F.col("__t") - after, bucket)))
    rows = rows.withColumn("__home", b).withColumn("__b", F.explode(homes))
    frame = Window.partitionBy(*[f"__{k}" for k in keys], "__b").orderBy("__t").rangeBetween(-before, after)
    out = rows.withColumns({f"__m{i}": F.when(F.col("__t").isNotNull(), m.over(frame)) for i, m in enumerate(measures.values())})
    out = out.where(F.col("__b").eqNullSafe(F.col("__home")))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in df.columns if c not in measures], *[F.col(f"__m{i}").alias(name) for i, name in enumerate(measures)])
