"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.llm.alignment import scored as align_tokens
from vitals.llm.decontaminate import contaminated
from vitals.llm.html_text import extract
from vitals.llm.language import identify
from vitals.llm.licenses import digest as license_digest
from vitals.llm.licenses import scan as scan_licenses
from vitals.llm.near_dedup import near_groups
from vitals.llm.packing import pack
from vitals.llm.passages import repeated_passages
from vitals.llm.quality import quality
from vitals.llm.secret_scan import digest, find_secrets
from vitals.llm.shards import shards
from vitals.llm.tables import table
from vitals.llm.url_filter import judge_urls
from vitals.llm.vector_codes import digest as code_vectors


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), shingle=2)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("source", "host_rejected")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).drop("spans")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_secrets(table(spark, sf_dir, "documents")))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("url", "pattern")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_near_dedup": op2_near_dedup,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_secrets": op5_secrets,
    "op6_shards": op6_shards,
    "op7_decontaminate": op7_decontaminate,
    "op8_packing": op8_packing,
    "op9_passages": op9_passages,
    "op10_url_filter": op10_url_filter,
    "op11_licenses": op11_licenses,
    "op12_token_alignment": op12_token_alignment,
    "op13_vector_codes": op13_vector_codes,
}
