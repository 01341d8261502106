"""Many levels and parts at once: grouping sets, stored sketches that merge, exact samples, multisets of n-grams."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.session import ship

#: Parts of a stratum that are ranked apart before its first rows meet.
PARTS = 64
#: Binary logarithms of the slots of the two kinds of sketches.
DISTINCT_BITS, SHARED_BITS = 14, 14


def by_levels(df: DataFrame, levels: list[list[str]], measures: list[Column]) -> DataFrame:
    """(columns, level, measures): measures for each set of columns in one pass. level: a bit for each column, in order, set where it is summed over."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    sets = [[F.col(c) for c in level] for level in levels]
    return df.groupingSets(sets, *[F.col(c) for c in names]).agg(F.grouping_id().cast("long").alias("level"), *measures)


def stored_sketches(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, distinct, members): for each group a sketch that counts distinct values, and one that can be intersected. Both merge, so that they can be stored
    by day and never be made again."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, DISTINCT_BITS).alias("distinct"), F.theta_sketch_agg(value, SHARED_BITS).alias("members"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of stored_sketches, over fewer columns."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("distinct").alias("distinct"), F.theta_union_agg("members").alias("members"))


def estimates(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_distinct)."""
    return sketches.select(*by, F.hll_sketch_estimate("distinct").alias("n_distinct"))


def shared_estimates(sketches: DataFrame, by: str, pairs: DataFrame) -> DataFrame:
    """(a, b, n_shared): distinct values that two groups have in common, for the given pairs (a, b) of groups."""
    a, b = sketches.select(F.col(by).alias("a"), F.col("members").alias("x")), sketches.select(F.col(by).alias("b"), F.col("members").alias("y"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", F.theta_sketch_estimate(F.theta_intersection("x", "y")).alias("n_shared"))


#: Groups that are bits of one number.
BITS = 62


def values_in_common(df: DataFrame, by: str, value: str) -> DataFrame:
    """(a, b, n_shared): distinct values that two groups have in common, counted exactly, for all pairs of groups (a < b) that have any.

    Up to BITS groups are bits of one number, so that a value is shuffled once, with its number, whatever groups have it; more groups are sets. Groups of a value
    are few, so that pairs are made of sets of groups, each with its number of values.
    """
    rows = df.where(F.col(by).isNotNull() & F.col(value).isNotNull())
    names = [r[0] for r in df.select(by).where(F.col(by).isNotNull()).distinct().limit(BITS + 1).collect()]
    if len(names) > BITS:
        sets = rows.select(by, value).distinct().groupBy(value).agg(F.array_sort(F.collect_set(by)).alias("s")).where(F.size("s") > 1).groupBy("s").agg(F.count("*").alias("n"))
    elif not names:
        return df.select(F.col(by).alias("a"), F.col(by).alias("b"), F.lit(0).cast("long").alias("n_shared")).limit(0)
    else:
        listed = F.array(*map(F.lit, names))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(listed, F.col(by)) - 1).cast("int"))
        masks = rows.select(value, bit.alias("m")).groupBy(value).agg(F.bit_or("m").alias("m")).where(F.bit_count("m") > 1).groupBy("m").agg(F.count("*").alias("n"))
        has = lambda x, i: F.call_function("shiftright", F.col("m"), i).bitwiseAND(F.lit(1)) == 1
        sets = masks.select(F.filter(listed, has).alias("s"), "n")
    both = sets.select("n", F.explode("s").alias("a"), "s").select("n", "a", F.explode("s").alias("b")).where("a < b")
    return both.groupBy("a", "b").agg(F.sum("n").alias("n_shared"))


def chance(key: Column, seed: str) -> Column:
    """A number above 0 and up to 1 that a row's key and a seed fix."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)


def sampled(df: DataFrame, strata: list[str], key: str, n: int, seed: str = "sample", weight: Column | None = None) -> DataFrame:
    """n rows of each stratum, without replacement, and their `place`, from 1; all of a stratum that has fewer. The same rows for any partitions.

    Without weights the rows of the smallest hashes; with weights those of the smallest exponential draws, -ln(u) / weight, so that a
    row's chance to come first is its weight's share. Weights of zero, null or less are never drawn. Ties go by key. First rows are taken in PARTS
    parts of a stratum, then of what they give.
    """
    u = chance(F.col(key), seed)
    rows = df if weight is None else df.where(weight > 0)
    rows = rows.withColumn("__draw", u if weight is None else -F.log(u) / weight)
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(PARTS))
    order = [F.col("__draw"), F.col(key)]
    first = rows.withColumn("__part", part).withColumn("place", F.row_number().over(Window.partitionBy(*strata, "__part").orderBy(*order))).where(F.col("place") <= n)
    best = first.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("place") <= n)
    return best.drop("__draw", "__part")


def gram_rows(df: DataFrame, key: list[str], text: str, n: int) -> DataFrame:
    """(key, gram), a row for each time a text says it."""
    return T.elements(df, key, T.ngrams(T.tokens(F.col(text)), n), "gram")


def keys_apart(df: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """df's rows whose key no other row has, and the others; None if there are none, and then nothing but the keys has been read."""
    many = df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(k).alias(f"__{k}") for k in key])
    if many.isEmpty():
        return df, None
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key])
    return df.join(many, same, "left_anti"), df.join(many, same, "left_semi")


def grams_of(words: str, n: int) -> Counter:
    """How often a text of words with blanks between says each n of them in a row."""
    w = words.split(" ") if words else []
    return Counter(zip(*[w[i:] for i in range(n)]))


def counted(text: Column, n: int, other: Column | None = None) -> Column:
    """(gram, n), both arrays: n-grams that a text says twice or more or, with another text, more often than that one."""

    alone = other is None

    @F.pandas_udf("gram array<string>, n array<long>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        if alone:
            found = [{g: k for g, k in grams_of(x, n).items() if k > 1} for x in a]
        else:
            found = [grams_of(x, n) - grams_of(y, n) for x, y in zip(a, b)]
        return pd.DataFrame({"gram": [[" ".join(g) for g in c] for c in found], "n": [list(c.values()) for c in found]})

    return run.asNondeterministic()(text, F.lit("") if alone else other)


def in_both(text: Column, other: Column, n: int) -> Column:
    """How many n-grams two texts have in common, each as often as both say it."""

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([sum((grams_of(x, n) & grams_of(y, n)).values()) for x, y in zip(a, b)], dtype="int64")

    return run.asNondeterministic()(text, other)


def word_line(text: str) -> Column:
    """A text's words, as native operators know them, with blanks between; empty for null."""
    return F.coalesce(F.array_join(T.tokens(F.col(text)), " "), F.lit(""))


def gram_counts(rows: DataFrame, key: list[str], found: Column, into: str) -> DataFrame:
    listed = rows.select(*key, found.alias("x")).select(*key, F.arrays_zip(F.col("x.gram").alias("gram"), F.col("x.n").alias(into)).alias("x"))
    return T.elements(listed, key, F.col("x"), "g").select(*key, "g.gram", f"g.{into}")


def said_repeatedly(df: DataFrame, key: list[str], text: str = "text", n: int = 8) -> DataFrame:
    """(key, gram, n): n-grams that the texts of a key say more than once. A text is counted in its own row; only texts of keys that several rows have are shuffled, as n-grams."""
    ship(df.sparkSession)
    one, more = keys_apart(df.select(*key, text), key)
    out = gram_counts(one, key, counted(word_line(text), n), "n")
    if more is None:
        return out
    return out.unionAll(gram_rows(more, key, text, n).groupBy(*key, "gram").agg(F.count("*").alias("n")).where("n > 1"))


def said_more_often(pairs: DataFrame, key: list[str], original: str = "original", version: str = "version", n: int = 4) -> DataFrame:
    """(key, gram, n_more): n-grams that a version says more often than its original, as a difference of multisets. A pair is compared in its own row; only
    pairs of keys that several rows have are shuffled, as n-grams."""
    ship(pairs.sparkSession)
    one, more = keys_apart(pairs.select(*key, original, version), key)
    out = gram_counts(one, key, counted(word_line(version), n, word_line(original)), "n_more")
    if more is None:
        return out
    rest = gram_rows(more, key, version, n).exceptAll(gram_rows(more, key, original, n))
    return out.unionAll(rest.groupBy(*key, "gram").agg(F.count("*").alias("n_more")))


def said_in_both(pairs: DataFrame, key: list[str], original: str = "original", version: str = "version", n: int = 4) -> DataFrame:
    """(key, n_both): how many n-grams a version and its original have in common, each as often as both say it. Rows as in said_more_often."""
    ship(pairs.sparkSession)
    one, more = keys_apart(pairs.select(*key, original, version), key)
    out = one.select(*key, in_both(word_line(version), word_line(original), n).alias("n_both")).where("n_both > 0")
    if more is None:
        return out
    rest = gram_rows(more, key, version, n).intersectAll(gram_rows(more, key, original, n))
    return out.unionAll(rest.groupBy(*key).agg(F.count("*").alias("n_both")))
