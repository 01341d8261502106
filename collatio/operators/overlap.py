"""How much of a version is copied: the exact share, a bound that spares most of the work, and shared n-grams at scale.

The share is defined by matching blocks, longest first, so it needs Python. One Arrow function takes both texts' words once; equal words
are a share of 1, and of all others the maximal common runs are found in one pass. Their words are a bound that clears texts below a limit;
what is left is a choice among few runs (see blocks).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.functions.predicates import is_check_heading
from collatio.session import ship

from .blocks import matching_blocks

# Words in a row that count as copied, shares from which a block is still the original; the same for short blocks.
RUN, LIMIT = 8, 0.6
SHORT_WORDS, SHORT_RUN, SHORT_LIMIT = 40, 4, 0.4
# End of fixed values.
WORDS = re.compile(r"\w+")


def covered(a: list[str], b: list[str], run: int) -> int:
    """How many words of b lie in a run of `run` words that a has too. Every matching block of as many words consists of such runs."""
    known = set(zip(*[a[i:] for i in range(run)]))
    n = end = 0
    for i, gram in enumerate(zip(*[b[i:] for i in range(run)])):
        if gram in known:
            n += i + run - max(i, end)
            end = i + run
    return n


def bound_of(original: str | None, version: str | None, run: int) -> float | None:
    """An upper bound of share_of, in time linear in the words."""
    if original is None or version is None:
        return None
    b = WORDS.findall(version.lower())
    return covered(WORDS.findall(original.lower()), b, run) / max(1, len(b))


def share_of(original: str | None, version: str | None, run: int, least: float = 0.0) -> float | None:
    """Share of a version's words in matching blocks of at least `run` words; null where it is known to be below `least`."""
    if original is None or version is None:
        return None
    a, b = (WORDS.findall(t.lower()) for t in (original, version))
    if a == b:
        return float(len(b) >= run > 0)
    if least and covered(a, b, run) / max(1, len(b)) < least:
        return None
    return sum(n for _, _, n in matching_blocks(a, b, run)) / max(1, len(b))


def exact_share(original: Column, version: Column, run: Column, least: Column) -> Column:
    """share_of as a column."""

    @F.pandas_udf("double")
    def share(a: pd.Series, b: pd.Series, n: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series([share_of(*row) for row in zip(a, b, n, low)], dtype="float64")

    return share.asNondeterministic()(original, version, run, least)


def copied_bound(original: Column, version: Column, run: int = RUN) -> Column:
    """bound_of as a column."""

    @F.pandas_udf("double")
    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bound_of(x, y, run) for x, y in zip(a, b)], dtype="float64")

    return bound.asNondeterministic()(original, version)


def with_copied_share(df: DataFrame, original: str, version: str, run: Column | int = RUN, into: str = "share", only: Column | None = None, least: Column | None = None) -> DataFrame:
    """df and the exact copied share.

    only: rows for which it is needed; others get null, and nothing of their texts is sent to Python. least: rows of a lesser share
    may get null.
    """
    ship(df.sparkSession)
    n = F.lit(run) if isinstance(run, int) else run
    low = F.lit(0.0) if least is None else least
    sent = [F.col(c) if only is None else F.when(F.coalesce(only, F.lit(False)), F.col(c)) for c in (original, version)]
    return df.withColumn(into, exact_share(*sent, n, low))


def paired_paragraphs(pairs: DataFrame, key: list[str], original: str = "original", version: str = "version") -> DataFrame:
    """(key, para_no, a, b): paragraphs of texts with equally many, side by side."""
    both = F.struct(T.paragraphs(F.col(original)).alias("a"), T.paragraphs(F.col(version)).alias("b"))
    side_by_side = T.let(both, lambda m: F.when(F.size(m["a"]) == F.size(m["b"]), F.zip_with(m["a"], m["b"], lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    return T.rows_of(pairs, key, side_by_side, "para_no", "x").select(*key, "para_no", "x.a", "x.b")


def still_original(pairs: DataFrame, key: list[str], original: str = "original", version: str = "version", limit: float = LIMIT) -> DataFrame:
    """(key, para_no, share) of version paragraphs that are still the original's.

    Blocks of more than SHORT_WORDS words count runs of RUN, shorter ones of five words or more that are no heading runs
    of SHORT_RUN. Texts with different numbers of paragraphs can't be compared and give no row (see comparable).
    The bound decides first; only paragraphs that it can't clear are matched.
    """
    rows = paired_paragraphs(pairs, key, original, version)
    n = T.n_parts(F.col("a"))
    rows = rows.withColumn("n", n).where((F.col("n") > SHORT_WORDS) | ((F.col("n") >= 5) & ~is_check_heading(F.col("a"))))
    long = F.col("n") > SHORT_WORDS
    rows = rows.withColumns({"run": F.when(long, RUN).otherwise(SHORT_RUN), "least": F.when(long, F.lit(limit)).otherwise(F.lit(min(limit, SHORT_LIMIT)))})
    return with_copied_share(rows, "a", "b", F.col("run"), least=F.col("least")).where("share >= least").select(*key, "para_no", "share")


BREAK = re.compile(r"\n\s*\n")


def is_original(a: str, b: str, limit: float) -> bool:
    """Whether a paragraph is still the original's, by the rule of still_original."""
    n, closed = len(a.split()), a.endswith((".", "!", "?", "…"))
    run, least = (RUN, limit) if n > SHORT_WORDS else (SHORT_RUN, min(limit, SHORT_LIMIT))
    share = share_of(a, b, run, least) if n > SHORT_WORDS or (n >= 5 and closed) else None
    return share is not None and share >= least


def original_paragraphs(original: Column, version: Column, limit: float = LIMIT) -> Column:
    """The numbers of a version's paragraphs that are still the original's, in the text's own row. Null where the numbers of
    paragraphs differ or a text is null."""

    def numbers(texts: tuple[str | None, str | None]) -> list[int] | None:
        if None in texts:
            return None
        sides = [[p for x in BREAK.split(t) if (p := x.strip())] for t in texts]
        same = len(sides[0]) == len(sides[1])
        return [i for i, pair in enumerate(zip(*sides), 1) if is_original(*pair, limit)] if same else None

    @F.pandas_udf("array<int>")
    def found(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([numbers(pair) for pair in zip(a, b)])

    return found.asNondeterministic()(original, version)


def comparable(original: Column, version: Column) -> Column:
    """Whether two texts have equally many paragraphs."""
    return F.size(T.paragraphs(original)) == F.size(T.paragraphs(version))


def shared_ngrams(left: DataFrame, right: DataFrame, left_key: str, right_key: str, text: str = "text", n: int = RUN, most: int = 64 << 20) -> DataFrame:
    """(left_key, right_key, n_shared): pairs of texts with distinct n-grams in common (an extension). `right` should be the smaller side.

    Runs of words are compared themselves, not by a hash alone. Where those of the right side have up to `most` bytes, they are broadcast, so that the left side
    isn't shuffled and no frequent run is a hot key. Beyond that both sides are shuffled by run, and partitions that a frequent run makes too
    large are left to the planner to split. Pairs are counted inside a task before they are shuffled.
    """

    def grams(df: DataFrame, key: str) -> DataFrame:
        return T.elements(df, [key], F.array_distinct(T.ngrams(T.tokens(F.col(text)), n)), "g")

    size = n * (right.select(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)  # every word is in n of them at most
    known = grams(right, right_key)
    if size <= most:
        known = F.broadcast(known.groupBy("g").agg(F.collect_set(right_key).alias(right_key)))
        met = grams(left, left_key).join(known, "g").select(left_key, F.explode(right_key).alias(right_key))
    else:
        met = grams(left, left_key).join(known, "g")
    return met.groupBy(left_key, right_key).agg(F.count("*").alias("n_shared"))
