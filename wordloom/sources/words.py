"""Word and query files, lists, and stored dictionaries."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, VERSION = "wordloom-dictionary", 3


def read_words(spark: SparkSession, path: str, max_bytes: int | None = None, max_words: int | None = None) -> DataFrame:
    """One word a line; line ends are stripped and blank lines dropped.  ``max_bytes`` and ``max_words`` (the first ones) cap the source."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    rows = spark.read.text(path).select(F.regexp_replace("value", r"[\r\n]+$", "").alias("word"), *place).where("word <> ''")
    if max_bytes is not None:
        rows = rows.where(F.octet_length("word") <= max_bytes)
    if max_words is not None:
        rows = rows.orderBy("file", "block", "line").limit(max_words)
    return rows.select("word")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """One query a line; blank lines and comments (#) are skipped."""
    return spark.read.text(path).select(F.regexp_replace("value", r"[\r\n]+$", "").alias("query")).where("query <> '' and not startswith(query, '#')")


def from_list(spark: SparkSession, words: Iterable[str], name: str = "word") -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], f"`{name}` string")


def text_words(docs: DataFrame, column: str = "text") -> DataFrame:
    """Lower-cased runs of letters and digits of every text, one row for each occurrence."""
    return docs.select(F.explode(F.split(F.lower(column), r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''")


def write_dictionary(keyed: DataFrame, path: str, overwrite: bool = True) -> None:
    """Stores ``word, n, mask, pairs`` as Parquet with a format mark, words of a length together; raises ValueError if the path cannot be written."""
    marked = keyed.select("word", "n", "mask", "pairs", F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"))
    try:
        marked.sortWithinPartitions("n", "word").write.mode("overwrite" if overwrite else "error").parquet(path)
    except Exception as e:  # the reasons differ by file system; callers get one error for all
        raise ValueError(f"cannot write a dictionary to {path}") from e


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """The stored ``word, n, mask, pairs``; ValueError if nothing is there or it is no dictionary."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        raise ValueError(f"cannot open a dictionary at {path}") from e
    if set(rows.columns) != {"word", "n", "mask", "pairs", "format", "version"}:
        raise ValueError(f"{path} holds no dictionary")
    bad = rows.where((F.col("format") != FORMAT) | (F.col("version") != VERSION)).limit(1).count()
    if bad:
        raise ValueError(f"{path} holds another format")
    return rows.select("word", "n", "mask", "pairs")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="wordloom-"))
    return made


def signature(df: DataFrame) -> str:
    """Hash of the names, sizes and times of the files that ``df`` reads."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    parts = []
    for name in sorted(df.inputFiles()):
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = at.getFileSystem(hadoop).getFileStatus(at)
        parts.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:24]
