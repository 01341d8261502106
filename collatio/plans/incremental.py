"""Reports that are made once: results are stored by the digest of what they come from, and only what is new is computed.

A store is a folder of Parquet batches. A batch is written under its number, and written again it replaces itself, so that a retried batch adds
nothing; of a digest that two batches have, results are equal, and the first counts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .report import fidelity_report


def text_digest(*texts: Column) -> Column:
    """SHA-256 of texts with their lengths; a null differs from an empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def list_digest(concepts: DataFrame) -> str:
    """Of a concept list, whatever its order."""
    h = F.xxhash64("name", "variants")
    r = concepts.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}:{r['x']}:{r['s']}"


def save_batch(rows: DataFrame, store: str, batch: int) -> None:
    """Writes a batch, in place of an earlier writing of it."""
    rows.write.mode("overwrite").parquet(f"{store}/batch={batch:08d}")


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """All batches of a store; None if there is none yet."""
    try:
        return spark.read.option("basePath", store).parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def unknown(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """One row of each digest that is not stored yet. Texts that are stored aren't shuffled where the list of new digests is small."""
    new = rows.select("digest").distinct()
    if known is not None:
        new = new.join(known.select("digest"), "digest", "left_anti")
    return rows.join(new, "digest", "left_semi").dropDuplicates(["digest"])


def incremental_report(pairs: DataFrame, concepts: DataFrame, store: str, batch: int, key: str = "pair_id") -> DataFrame:
    """The fidelity report of pairs (key, original, version). Pairs of texts that the store has, with this concept list, are not read again by any
    operator; the others' results become batch number `batch`. A failed run is repeated with its number."""
    spark = pairs.sparkSession
    listed = list_digest(concepts)
    rows = pairs.select(key, text_digest(F.lit(listed), F.col("original"), F.col("version")).alias("digest"), "original", "version")
    known = stored(spark, store)
    if known is not None:
        known = known.where(F.col("batch") != batch)
    new = unknown(rows, known)
    save_batch(fidelity_report(new.select("digest", "original", "version"), concepts, "digest"), store, batch)
    have = stored(spark, store)
    if have is None:  # nothing was given and nothing is stored
        return fidelity_report(pairs, concepts, key)
    first = Window.partitionBy("digest").orderBy("batch")
    have = have.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "batch")
    return rows.select(key, "digest").join(have, "digest").drop("digest")
