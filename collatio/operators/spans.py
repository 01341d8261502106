"""Stretches of a text as rows, and joins of stretches that lie in one another.

A span is (key, kind, start, stop) in characters of its text, stop behind the last. Spans of quotations, flagged words and copied runs are
found in the text's own row; which lie inside which is an interval join over bins of characters, so that a long text is many groups.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.functions import lexicon
from collatio.functions import text as T

from .overlap import RUN

SPANS = "array<struct<start: int, stop: int>>"
WORDS, QUOTATION = re.compile(r"\w+"), re.compile(T.QUOTE)
NEGATIONS = frozenset(lexicon.NEGATIONS.split("|"))
#: Characters of a bin.
BIN = 1024


def words_of(text: str) -> list[re.Match[str]]:
    return list(WORDS.finditer(text))


def quotation_spans(text: Column) -> Column:
    """Of each quotation, from its first word to its last; those without a word are left out."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        def of(t: str | None):
            if t is None:
                return None
            inside = ((m.start(1), words_of(m.group(1))) for m in QUOTATION.finditer(t))
            return [{"start": at + w[0].start(), "stop": at + w[-1].end()} for at, w in inside if w]

        return texts.map(of)

    return found.asNondeterministic()(text)


def flagged_spans(text: Column) -> Column:
    """Negations and figures: words by which meaning is easily lost."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        flagged = lambda w: w[0].isdigit() or T.fold_text(w) in NEGATIONS
        return texts.map(lambda t: None if t is None else [{"start": m.start(), "stop": m.end()} for m in words_of(t) if flagged(m.group())])

    return found.asNondeterministic()(text)


def copied_spans(original: Column, version: Column, run: int = RUN) -> Column:
    """The version's stretches of words that all lie in runs of `run` words which the original has too."""

    @F.pandas_udf(SPANS)
    def found(originals: pd.Series, versions: pd.Series) -> pd.Series:
        def of(a: str | None, b: str | None):
            if a is None or b is None:
                return None
            old = WORDS.findall(a.lower())
            known = set(zip(*[old[k:] for k in range(run)]))
            places = words_of(b)
            new = [m.group().lower() for m in places]
            out: list[list[int]] = []
            for i, gram in enumerate(zip(*[new[k:] for k in range(run)])):
                if gram in known:
                    if out and i <= out[-1][1]:
                        out[-1][1] = i + run
                    else:
                        out.append([i, i + run])
            return [{"start": places[i].start(), "stop": places[j - 1].end()} for i, j in out]

        return pd.Series([of(*x) for x in zip(originals, versions)])

    return found.asNondeterministic()(original, version)


def span_rows(df: DataFrame, key: list[str], spans: Column, kind: str) -> DataFrame:
    """(key, kind, start, stop), a row for each span of an array."""
    return T.elements(df, key, spans, "x").select(*key, F.lit(kind).alias("kind"), "x.start", "x.stop")


def within(inner: DataFrame, outer: DataFrame, key: list[str], bin_size: int = BIN) -> DataFrame:
    """(key, kind, start, stop, outer_kind, outer_start, outer_stop): each span of inner with each span of outer that holds it whole.

    An inner span goes to the bin of its start, an outer one to all bins that it touches, so that every pair meets once.
    """
    small = inner.select(*key, "kind", "start", "stop", F.floor(F.col("start") / bin_size).alias("__bin"))
    bins = F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.greatest(F.col("stop") - 1, F.col("start")) / bin_size))
    large = outer.select(*key, F.col("kind").alias("outer_kind"), F.col("start").alias("outer_start"), F.col("stop").alias("outer_stop"), F.explode(bins).alias("__bin"))
    met = small.join(large, [*key, "__bin"]).where("outer_start <= start AND stop <= outer_stop")
    return met.select(*key, "kind", "start", "stop", "outer_kind", "outer_start", "outer_stop")
