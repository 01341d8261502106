"""The row-wise operators on streams of texts (an extension): guards of arriving pairs, and counts by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from collatio.functions import text as T
from collatio.functions.predicates import language
from collatio.operators.guards import with_guards


def read_pairs(spark: SparkSession, path: str, schema: str = "pair_id string, at timestamp, original string, version string") -> DataFrame:
    """Arriving Parquet files of pairs, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def guarded(pairs: DataFrame) -> DataFrame:
    """Pairs with every guard's message; native, so that it runs on streams as on tables."""
    return with_guards(pairs, "original", "version")


def counts_by_window(texts: DataFrame, at: str = "at", text: str = "text", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Texts and words by language and time window; windows close when the watermark passes, later rows don't count."""
    rows = texts.select(F.col(at).alias("at"), language(F.col(text)).alias("lang"), T.n_parts(F.col(text)).alias("n"))
    return rows.withWatermark("at", late).groupBy(F.window("at", window).alias("window"), "lang").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_words"))


def save(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream's finished rows as Parquet until all that has arrived is done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
