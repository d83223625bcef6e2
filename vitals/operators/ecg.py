"""ECG and route rows from scanned files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitals.functions.text import epoch_text

EXPORT = ["user_id", "job_id"]
FILE = [*EXPORT, "member_ordinal"]

def ecg_projection(scan: DataFrame, at: Column) -> DataFrame:
    """ECG rows; ``at``, the time of ingestion, stands in for a missing time."""
    return scan.select(
        *FILE,
        "source_file",
        F.coalesce("ecg_time", epoch_text(at)).alias("ecg_time"),
        "classification",
        "average_heart_rate",
        epoch_text(at).alias("created_at"),
        "row_in_file",
        F.unix_timestamp(at).alias("_ingested"),
    )


def route_projection(scan: DataFrame, at: Column) -> DataFrame:
    """Route rows; tracks without points are dropped.

    The time of a route is its first waypoint's, which may be empty.
    """
    routes = scan.where(F.size("waypoints") > 0)
    first, last = F.element_at("waypoints", 1), F.element_at("waypoints", -1)
    within = Window.partitionBy(*FILE).orderBy("track")
    return routes.select(
        *FILE,
        "source_file",
        first["time"].alias("route_time"),
        F.size("waypoints").alias("waypoint_count"),
        first["lat"].alias("start_lat"),
        first["lon"].alias("start_lon"),
        last["lat"].alias("end_lat"),
        last["lon"].alias("end_lon"),
        epoch_text(at).alias("created_at"),
        "track",
        F.unix_timestamp(at).alias("_ingested"),
    ).withColumn("row_in_file", F.row_number().over(within).cast("long") - 1).drop(
        "track"
    )


def row_ordinal(rows: DataFrame) -> DataFrame:
    """Adds ``ordinal``: a count from 0 over the files of one export.

    Rows are numbered within their file already, so only the files' row counts
    (combined before the shuffle) are put in order per export; the rows of an
    export are never gathered in one task. The counts are the side that is
    hashed, by file in every task: rows, whose texts may be long and yet take
    little room in a file, must not be sent to the driver to be broadcast.
    """
    counts = rows.groupBy(*FILE).agg(F.count("*").alias("_rows"))
    before = (
        Window.partitionBy(*EXPORT)
        .orderBy("member_ordinal")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        *FILE, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    return (
        rows.join(offsets.hint("shuffle_hash"), FILE)
        .withColumn("ordinal", F.col("_offset") + F.col("row_in_file"))
        .drop("_offset")
    )
