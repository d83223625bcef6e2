"""All stored families under one (user, type and time) order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.functions.text import record_key, type_time_key


def _keyed(df: DataFrame, family: str, time: str) -> DataFrame:
    ordinal = F.col("ordinal").cast("string")
    return df.withColumns(
        {
            "record_type": F.lit(family),
            "sk": F.concat_ws(
                "#", record_key(F.lit(family), F.col(time)), ordinal
            ),
            "type_time_key": type_time_key(F.lit(family), F.col(time)),
        }
    )


def timeline(
    records: DataFrame, ecg: DataFrame, routes: DataFrame, jobs: DataFrame
) -> DataFrame:
    """One row per stored item with its key texts; absent attributes are null."""
    measured = records.withColumns(
        {
            "sk": record_key(F.col("record_type"), F.col("start_date")),
            "type_time_key": type_time_key(
                F.col("record_type"), F.col("start_date")
            ),
        }
    )
    job_key = F.concat_ws("#", F.lit("JOB"), F.col("job_id"))
    families = [
        measured,
        _keyed(ecg, "ECG", "ecg_time"),
        _keyed(routes, "GPX", "route_time"),
        jobs.withColumns({"sk": job_key, "type_time_key": job_key}),
    ]
    merged = families[0]
    for family in families[1:]:
        merged = merged.unionByName(family, allowMissingColumns=True)
    return merged
