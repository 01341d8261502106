"""Helpers that the training-data operators share: storage, batches, word splitting, connected components.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from contextlib import contextmanager, suppress
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.functions.text import running  # noqa: F401  (operators take it from here)
from collatio.session import ship

#: Bytes of text in one Arrow batch at most (a single longer row makes a batch of its own).
BATCH_BYTES = "8m"
#: Names of the files that Spark writes: folder, task, file of the task.
WRITTEN = re.compile(r"(.*/)part-(\d+)-[^/]*-c(\d+)\.[^/]*parquet")
#: Rows of a key from which a join splits it; keys that may be broadcast.
HOT_ROWS, SENT = 1_000_000, 500_000


def bound_batches(spark: SparkSession) -> None:
    """Prepares a session for Python workers: the package's modules, and Arrow batches that are bounded by bytes too, so
    that very long texts do not gather in a worker's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session (tests) gets a new temporary folder, which is then set;
    on a cluster that is an error, since executors would write to disks of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="collatio-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Lists of the folders that were made since they were opened.
WATCHED: list[list[str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a folder of its own below shared_dir."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in WATCHED:
        made.append(folder)
    return folder


@contextmanager
def folders_made():
    """The folders that operators make meanwhile, so that what nothing reads any more can be deleted."""
    made: list[str] = []
    WATCHED.append(made)
    try:
        yield made
    finally:
        WATCHED[:] = [w for w in WATCHED if w is not made]


def delete_folders(folders: list[str], but: str) -> None:
    """Deletes folders of the shared folder, all but one; those that are gone are no error."""
    for folder in folders:
        if folder != but:
            store, path = filesystem(folder)
            with suppress(FileNotFoundError):
                store.delete_dir(path)


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table in the shared folder, so that a lost executor costs no recomputation upstream."""
    folder = new_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(folder)
    stored = df.sparkSession.read.schema(df.schema).parquet(folder)
    stored.stored_at = folder
    return stored


def standing(df: DataFrame) -> DataFrame:
    """df itself where it is a plain table of files that one job of Spark wrote to a folder, so that its rows can be told by their places; else df of settle."""
    if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        found = [WRITTEN.fullmatch(f) for f in df.inputFiles()]
        if all(found) and len({m[1] for m in found}) <= 1 and len({(int(m[2]), int(m[3])) for m in found}) == len(found) and all(int(m[2]) < 1 << 17 and int(m[3]) < 1 << 12 for m in found):
            return df
    return settle(df)


def place(df: DataFrame) -> Column:
    """A number for each row of a table of standing, the same however often it is read: the numbers of its file and of the row in it."""
    at = df.metadataColumn("_metadata")
    part, file = (F.regexp_extract(at["file_name"], pattern, 1).cast("long") for pattern in (r"^part-(\d+)-", r"-c(\d+)\."))
    return F.shiftleft(part, 46) + F.shiftleft(file, 34) + at["row_index"]


def discard(*tables: DataFrame) -> None:
    """Deletes tables of settle that nothing reads any more."""
    for table in tables:
        store, path = filesystem(table.stored_at)
        store.delete_dir(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles whose queries have ended, which it does when the driver collects garbage; with little garbage that can be hours later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(address: str):
    """(pyarrow file system, path) of a folder or file that every executor can reach."""
    from pyarrow import fs

    parsed = urlparse(address)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(address)


def put_file(address: str, data: bytes) -> None:
    """Writes a whole file under a name of its own and renames it, so that a repeated task never leaves half a file."""
    store, path = filesystem(address)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def map_file(address: str):
    """The bytes of a file of the shared folder as a numpy array: memory-mapped where the folder is mounted, else read into memory
    (nothing is copied to a worker's own disk, so such files must be small)."""
    import numpy as np

    store, path = filesystem(address)
    if urlparse(address).scheme in ("", "file"):
        return np.memmap(path, np.uint8, "r")
    with store.open_input_file(path) as src:
        return np.frombuffer(src.read(), np.uint8)


class Ranges:
    """Parts of a file of the shared folder: of its mapped bytes, or read one by one where the folder isn't mounted."""

    def __init__(self, address: str):
        import numpy as np

        store, path = filesystem(address)
        mounted = urlparse(address).scheme in ("", "file")
        self.mapped = np.memmap(path, np.uint8, "r") if mounted else None
        self.file = None if mounted else store.open_input_file(path)

    def get(self, start: int, size: int):
        import numpy as np

        return self.mapped[start : start + size] if self.file is None else np.frombuffer(self.file.read_at(size, start), np.uint8)


def join_hot(many: DataFrame, one: DataFrame, key: str | list[str], rows: str, hot: int | None = None) -> DataFrame:
    """many joined to one (a row for each key), where a key may hold a large part of many.

    rows: the column of one that says how many rows of many a key has. A key of more than `hot` of them is split into parts of
    about as many, and its row of one repeats for each part. Hot keys are at most a hot-th of the rows; they are broadcast
    behind a check of their number, beyond which the planner's own splitting of skewed partitions is left to act.
    """
    hot = HOT_ROWS if hot is None else hot
    keys = [key] if isinstance(key, str) else key
    busy = settle(one.where(F.col(rows) > hot).select(*keys, F.ceil(F.col(rows) / hot).cast("int").alias("__parts")))
    n = busy.count()
    if not 0 < n <= SENT:
        return many.join(one, key)
    parts = F.coalesce("__parts", F.lit(1))
    left = many.join(F.broadcast(busy), key, "left").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("__parts")
    right = one.join(F.broadcast(busy), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def ascii_lower_words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text whose A-Z are lower-cased, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def alnum_table() -> bytes:
    """Byte table that lower-cases A-Z, keeps 0-9, a-z and every byte of a non-ASCII character, and blanks the rest."""
    out = bytearray(b" " * 256)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        out[b] = b
    for b in range(0x41, 0x5B):
        out[b] = b + 32
    return bytes(out)


ALNUM = alnum_table()


def alnum_words(text: str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text whose A-Z are lower-cased, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v), root being the smallest node reachable.

    Alternates large-star and small-star steps, each one group-by over the edges, until nothing changes; hub nodes are
    halved by the map-side minimum. Every round's edges are stored in the shared folder. Rounds grow with the logarithm of the longest
    chain, so that `rounds` is a guard against a fault, not a limit.
    """
    e = settle(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct())
    for _ in range(rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        new = settle(small)
        if is_star(new):
            e = new
            break
        e = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def is_star(edges: DataFrame) -> bool:
    """Whether no node has two parents and no parent has a parent."""
    doubled = edges.groupBy("u").count().where("count > 1").select("u")
    chained = edges.select("u").join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return doubled.unionAll(chained).isEmpty()


def mixed(x, salt=0):
    """64-bit mix of numpy uint64 values with a salt."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (np.asarray(salt, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
