"""Brings the package to the executors, and small inputs to all cores."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an input, as it is stored, that are spread over all cores.
SMALL = 64 << 20

#: Bytes and rows of an Arrow batch that goes to a Python worker at most (a single larger row makes a batch of its own).
BATCH_BYTES, BATCH_ROWS = "8m", "4000"


def spread(df: DataFrame) -> DataFrame:
    """df's rows over all cores, where the input is so small that its few row groups would leave most of them idle; a larger one stays as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to Python workers, once for each Spark context, so that clusters need no installation. Batches are bounded by
    bytes too, so that long texts do not gather in a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    context = spark.sparkContext
    if getattr(context, "collatio_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="collatio-")) / "collatio.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    context.addPyFile(str(target))
    context.collatio_shipped = True
