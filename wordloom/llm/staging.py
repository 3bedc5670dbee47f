"""Tables written to the folder that driver and executors share.

``stage`` cuts lineage: a lost executor re-reads the table instead of recomputing what led to it,
and a table that is used twice is computed once.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a per-group side table is broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="wordloom-"))
    return made


def stage(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast hint if ``df`` has at most BROADCAST_ROWS rows, else ``df`` as it is."""
    from pyspark.sql import functions as F

    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of frames that are no longer referred to."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per application."""
    import os
    import zipfile

    if (app := spark.sparkContext.applicationId) in _shipped:
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="wordloom-ship-"), "wordloom.zip")  # the driver serves it to executors
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("wordloom", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


#: Bytes of a batch sent to a Python worker (Spark counts rows besides; a single row may be larger).
BATCH_BYTES = "4m"


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` with the package shipped to the workers, in batches of about BATCH_BYTES."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(fn, schema)
