"""What each export held and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.schema import RECORD_IDENTIFIERS

EXPORT = ["user_id", "job_id"]
COUNTS = [
    "file_count",
    "xml_members",
    "ecg_members",
    "gpx_members",
    "records_kept",
    "records_skipped",
    "ecg_rows",
    "routes",
]


def _counted(df: DataFrame, **flags: Column) -> DataFrame:
    """Sums of the given flags per export; the other counts are zero."""
    sums = [
        F.sum(flags[name].cast("long")).alias(name)
        if name in flags
        else F.lit(0).cast("long").alias(name)
        for name in COUNTS
    ]
    return df.groupBy(*EXPORT).agg(*sums)


def ingest_counts(
    members: DataFrame, scan: DataFrame, ecg: DataFrame, routes: DataFrame
) -> DataFrame:
    """Per export: files, members by kind, records kept and skipped, rows written.

    Each input is summed per export before the shuffle; the sums meet in one
    further, small aggregation.
    """
    kind = F.coalesce("kind", F.lit(""))
    tracked = F.coalesce(F.col("type"), F.lit("")).isin(RECORD_IDENTIFIERS)
    each = F.lit(True)
    parts = [
        _counted(
            members,
            file_count=F.col("member").isNotNull(),
            xml_members=kind == "xml",
            ecg_members=kind == "ecg",
            gpx_members=kind == "gpx",
        ),
        _counted(scan, records_kept=tracked, records_skipped=~tracked),
        _counted(ecg, ecg_rows=each),
        _counted(routes, routes=each),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy(*EXPORT).agg(*(F.sum(name).alias(name) for name in COUNTS))
