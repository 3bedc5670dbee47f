"""A corpus pipeline of five stages over ``documents``.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run`` writes
as Parquet and reads again as the next one's ``docs``.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.jaccard_join import drop_near_duplicates
from wordloom.llm.mixing import mix_documents
from wordloom.llm.packing import pack_documents
from wordloom.llm.quality_classifier import keep_quality
from wordloom.llm.secrets import redact_documents
from wordloom.llm.staging import stage

#: The pipeline's near duplicates: five words a shingle, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, n=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = pack_documents(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: A fitted model (4) and a tokenizer (6) are beyond SQL: tests/llm/test_pipeline.py holds every stage and ``run`` against plain Python.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
