"""From raw documents to packed training sequences, in five stages.

Each stage reads what the one before kept, as written to Parquet, and returns
the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.llm.decontaminate import decontaminate
from vitals.llm.language import with_language
from vitals.llm.near_dedup import near_groups
from vitals.llm.packing import pack
from vitals.llm.secret_scan import redact_secrets
from vitals.llm.tables import landed, table

#: SQL has no form for the language model, the benchmark windows and the tokeniser.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; its own label stays as it is."""
    return with_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Of rows that repeat an id and its text one stays; rows without an id all
    do. Different texts of one id are one document and stay together.
    """
    kept = near_groups(docs).where("kept").groupBy("doc_id").agg(F.count("*").alias("rows"))
    kept = kept.withColumnRenamed("doc_id", "id")
    met = docs.join(kept, docs["doc_id"].eqNullSafe(kept["id"]))
    single = kept["id"].isNull() | (kept["rows"] == 1)
    return met.where(single).select(docs["*"]).unionByName(
        met.where(~single).select(docs["*"]).dropDuplicates(["doc_id", "text"])
    )


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
