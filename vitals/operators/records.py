"""Scanned measurements to record rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.functions.text import parse_number, text
from vitals.schema import RECORD_TYPES


def type_dictionary(spark: SparkSession) -> DataFrame:
    """The ingested types: one row per identifier, a fixed 55.

    From an Arrow table it is a local relation, which joins without a job.
    """
    columns = {"type": [*RECORD_TYPES], "record_type": [*RECORD_TYPES.values()]}
    return spark.createDataFrame(pa.table(columns))


def map_record_type(scan: DataFrame) -> DataFrame:
    """Ingested types only, under their short names.

    The dictionary has a fixed size, so it is broadcast whatever the scan's.
    """
    names = type_dictionary(scan.sparkSession)
    return scan.join(F.broadcast(names), "type")


def project_record(
    scan: DataFrame, ingested: Column | int = 0
) -> DataFrame:
    """Record rows; a missing attribute is the empty string."""
    stamp = F.lit(ingested) if isinstance(ingested, int) else ingested
    return scan.select(
        "user_id",
        "record_type",
        text("start_date").alias("start_date"),
        text("value").alias("value"),
        text("unit").alias("unit"),
        text("creation_date").alias("creation_date"),
        "job_id",
        parse_number(F.col("value")).alias("value_num"),
        stamp.cast("long").alias("_ingested"),
        "_blk",
        "_pos",
    )
