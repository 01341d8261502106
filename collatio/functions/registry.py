"""Functions and generators for SQL: register(spark) makes them known to a session by name.

What is native in the DataFrame interface is a SQL function with a body, so that the planner sees through it: folding, paragraphs and runs of
words. What needs Python is an Arrow function under a name.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from collatio.functions.text import BLANK, BLANKS, WORD, accent_table
from collatio.operators.overlap import RUN, bound_of, share_of
from collatio.session import ship


def literal(text: str) -> str:
    """A string as SQL, its characters by number where they could be mistaken."""
    return "'" + "".join(c if c.isalnum() else f"\\u{ord(c):04X}" for c in text) + "'"


def bodies() -> dict[str, str]:
    """Native functions by name: what stands behind it in CREATE FUNCTION."""
    accented, plain = accent_table()
    breaks, word = literal(f"\n[{BLANK}]*\n"), literal(f"[{WORD}]+")
    return {
        "fold": f"(text STRING) RETURNS STRING RETURN regexp_replace(translate(lower(text), {literal(accented)}, {literal(plain)}), {literal('[' + chr(92) + 'p{Mn}]+')}, '')",
        "paragraphs": f"(text STRING) RETURNS TABLE(para_no INT, para STRING) RETURN SELECT pos + 1, col FROM posexplode(filter(transform(split(text, {breaks}), x -> btrim(x, {literal(BLANKS)})), x -> x <> ''))",
        "word_runs": f"(text STRING, n INT) RETURNS TABLE(run_no INT, run STRING) RETURN SELECT pos + 1, col FROM posexplode(transform(array(regexp_extract_all(lower(text), {word}, 0)), w -> CASE WHEN size(w) >= n THEN transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' ')) ELSE array() END)[0])",
    }


def register(spark: SparkSession) -> list[str]:
    """Registers all functions; returns their names.

    * copied_share(original, version), copied_bound(original, version): share of words in copied runs, and a bound of it;
    * fold(text): lower case without accents;
    * similarity(a, b): ratio of equal characters, as difflib counts it;
    * paragraphs(text): table function of (para_no, para); word_runs(text, n): table function of (run_no, run).
    """
    ship(spark)

    @F.pandas_udf("double")
    def copied_share(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([share_of(x, y, RUN) for x, y in zip(a, b)], dtype="float64")

    @F.pandas_udf("double")
    def copied_bound(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bound_of(x, y, RUN) for x, y in zip(a, b)], dtype="float64")

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        ratio = lambda x, y: None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
        return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")

    scalar = {"copied_share": copied_share, "copied_bound": copied_bound, "similarity": similarity}
    for name, f in scalar.items():
        spark.udf.register(name, f)
    native = bodies()
    for name, body in native.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return [*scalar, *native]
