"""Reading and writing texts, concepts, candidates and reports."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.operators.concepts import parsed_concepts
from collatio.session import ship


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(name, variants) of a concept file."""
    return parsed_concepts(spark.read.text(path))


def joined_text(paras: DataFrame, key: list[str], para: str = "para") -> DataFrame:
    """(key, text): paragraphs with a blank line between and a line end behind the last."""
    out = paras.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("para_no", para))).alias("ps"))
    return out.select(*key, F.concat(F.array_join(F.transform("ps", lambda x: x[para]), "\n\n"), F.lit("\n")).alias("text"))


def write_texts(df: DataFrame, path: str, text: str = "text") -> None:
    """A text file for each partition of rows; every text ends with its own line end. write_files gives each text a file."""
    df.select(F.regexp_replace(text, "\n$", "").alias("value")).write.mode("overwrite").text(path)


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "text") -> None:
    """Each row's text (in UTF-8) or bytes as a file of the folder, which all executors must reach; written under another name, then renamed."""
    ship(df.sparkSession)

    def save(rows) -> None:
        import os
        import uuid
        from urllib.parse import urlparse

        from pyarrow import fs

        local = urlparse(folder).scheme in ("", "file")
        store, root = (fs.LocalFileSystem(), urlparse(folder).path) if local else fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for r in rows:
            part = os.path.join(root, f".{r[name]}.{uuid.uuid4().hex}")
            with store.open_output_stream(part) as out:
                out.write(bytes(r[content]))
            store.move(part, os.path.join(root, r[name]))

    df.select(name, F.col(content).cast("binary").alias(content)).where(F.col(content).isNotNull()).foreachPartition(save)


def save_progress(paras: DataFrame, path: str, batch: int | None = None) -> None:
    """Stores finished paragraphs under a batch's number, so that a stopped run goes on behind them. A batch that is retried under its number replaces
    itself; without a number it is the next one by the clock."""
    batch = time.time_ns() // 1000 if batch is None else batch
    paras.write.mode("overwrite").parquet(f"{path}/batch={batch:08d}")


def last_progress(spark: SparkSession, path: str, key: list[str], para: str = "para", order: str | None = None) -> DataFrame:
    """(key, para): of each paragraph, what the last batch that has it saved; of two in one batch that of the greatest `order` (without one, the greater text)."""
    rank = ["batch"] + ([order] if order else []) + [para]
    saved = spark.read.option("basePath", path).parquet(path).groupBy(*key).agg(F.max(F.struct(*rank)).alias("last"))
    return saved.select(*key, F.col(f"last.{para}").alias(para))


def compact_progress(spark: SparkSession, path: str, target: str, key: list[str], para: str = "para", order: str | None = None, files: int = 64) -> None:
    """Writes what last_progress gives as the first batch of another folder, in few files."""
    last_progress(spark, path, key, para, order).coalesce(files).write.mode("overwrite").parquet(f"{target}/batch={0:08d}")


def with_progress(paras: DataFrame, path: str, key: list[str], para: str = "para", order: str | None = None) -> DataFrame:
    """paras with finished paragraphs of save_progress in place, the others as they are; `done` tells which."""
    done = last_progress(paras.sparkSession, path, key, para, order).select(*key, F.col(para).alias("__done"), F.lit(True).alias("__is_done"))
    joined = paras.join(done, key, "left").withColumn("done", F.coalesce("__is_done", F.lit(False)))
    return joined.withColumn(para, F.when(F.col("done"), F.col("__done")).otherwise(F.col(para))).drop("__done", "__is_done")


def write_candidates(candidates: DataFrame, path: str, key: list[str], buckets: int = 256) -> None:
    """Candidates in up to `buckets` folders by a hash of their key, sorted in them, so that a text's candidates lie side by side and
    the number of files doesn't grow with the paragraphs. read_candidates reads those of one key from its folder alone."""
    rows = candidates.withColumn("bucket", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets)).cast("int"))
    order = [c for c in ("para_no", "cand_no") if c in candidates.columns and c not in key]
    rows.repartition("bucket").sortWithinPartitions("bucket", *key, *order).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_candidates(spark: SparkSession, path: str, key: dict, buckets: int = 256) -> DataFrame:
    """The candidates of one key."""
    bucket = F.pmod(F.xxhash64(*[F.lit(str(v)) for v in key.values()]), F.lit(buckets)).cast("int")
    rows = spark.read.parquet(path).where(F.col("bucket") == bucket).drop("bucket")
    for k, v in key.items():
        rows = rows.where(F.col(k) == v)
    return rows


def write_halves(halves: DataFrame, path: str) -> None:
    """Halves with their check phrases, as JSON lines."""
    halves.write.mode("overwrite").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files; empty files, which have no part to read, are left out."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def short_name(path, width: int = 18):
    """A file's name, cut to a width with an ellipsis."""
    base = F.regexp_extract(F.translate(path, "\\", "/"), "[^/]*$", 0)
    return F.when(F.length(base) <= width, base).otherwise(F.concat(F.substring(base, 1, width - 1), F.lit("…")))
