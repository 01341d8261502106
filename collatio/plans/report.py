"""The fidelity report: how well each version keeps its original, in one pass over the pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.operators.concepts import concept_array, kept, lost_negations, shapes_of
from collatio.operators.overlap import comparable, original_paragraphs
from collatio.session import ship


def fidelity_report(pairs: DataFrame, concepts: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, n_kept, n_concepts, lost, source_complete, lost_negations, comparable, copied_paragraphs, shapes, failed).

    pairs: (key, original, version); concepts: (name, variants), written by hand. failed: a concept is lost, the original itself
    lacks one, or paragraphs of the version are still the original. Negations and shapes are for people to look at. Every
    column comes from its own row: nothing is shuffled, joined or grouped; copied paragraphs are found in Python, all else natively.
    """
    ship(pairs.sparkSession)
    a, b = F.col("original"), F.col("version")
    rows = pairs.select(
        key,
        kept(concept_array(T.fold(b), concepts)).alias("own"),
        kept(concept_array(T.fold(a), concepts)).alias("source"),
        lost_negations(a, b).alias("lost_negations"),
        comparable(a, b).alias("comparable"),
        original_paragraphs(a, b).alias("copied"),
        F.array_sort(F.transform(shapes_of(b), lambda x: F.concat_ws(": ", x["para_no"].cast("string"), x["kind"]))).alias("shapes"),
    )
    copied, shapes = (F.when(F.size(c) > 0, F.col(c)) for c in ("copied", "shapes"))
    complete = F.col("source.n_kept") == F.col("source.n_concepts")
    failed = (F.size("own.lost") > 0) | ~complete | (F.coalesce(F.size("copied"), F.lit(0)) > 0)
    return rows.select(key, "own.n_kept", "own.n_concepts", "own.lost", complete.alias("source_complete"), "lost_negations", "comparable", copied.alias("copied_paragraphs"), shapes.alias("shapes"), failed.alias("failed"))


def overall(report: DataFrame) -> DataFrame:
    """(n_pairs, n_failed, status) of a report: status is 1 if any pair failed, else 0, as a command's exit code."""
    n = F.count_if("failed")
    return report.agg(F.count("*").alias("n_pairs"), n.alias("n_failed"), F.when(n > 0, 1).otherwise(0).alias("status"))
