"""The stored tables: appended versions, newest-per-key views, snapshots."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.functions.text import month_of
from vitals.operators.filters import date_range
from vitals.operators.latest import latest_by_key
from vitals.schema import TABLES, column_names
from vitals.sources import snapshots


TIMES = {"records": "start_date", "ecg": "ecg_time", "routes": "route_time"}
#: Column that splits a table into folders.
PARTS = {"records": "record_type"}


def table_path(root: str, family: str) -> str:
    return f"{root.rstrip('/')}/{family}"


def present(spark: SparkSession, path: str) -> bool:
    """Whether there is such a folder; a run may have no member of a kind."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def _month(family: str) -> Column:
    return month_of(F.col(TIMES[family])) if family in TIMES else F.lit("")


LAYOUTS = {
    "records": lambda: ["record_type", _month("records"), "user_id", "start_date"],
    "ecg": lambda: [_month("ecg"), "user_id", "ecg_time", "ordinal"],
    "routes": lambda: [_month("routes"), "user_id", "route_time", "ordinal"],
    "jobs": lambda: ["user_id", "job_id"],
    "job_states": lambda: ["user_id", "job_id"],
    "users": lambda: ["id"],
    "rejects": lambda: ["user_id", "job_id", "source_file", "line"],
}


def snapshot_path(root: str, family: str) -> str:
    return f"{table_path(root, family)}-snapshot"


def _family(family: str) -> snapshots.Family:
    schema, keys, newest = TABLES[family]
    return snapshots.Family(column_names(schema), schema, keys, newest, PARTS.get(family), _month(family))


def _append(df: DataFrame, root: str, family: str, layout: list[str | Column]) -> None:
    """Appends versions of rows, ranged and sorted by ``layout``.

    Ranges split a heavy type or user over as many files as its rows need.
    Where the layout starts with a month, files and row groups span few months
    and, within one, few users: their bounds let a time range or a user leave
    the others unread, without a folder and a small file per month and run.
    Every call is a batch with a folder of its own, by which a snapshot knows
    what it has taken in.
    """
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    ranged = df.select(*column_names(TABLES[family][0])).repartitionByRange(*layout)
    writer = ranged.sortWithinPartitions(*layout).write
    if family in PARTS:
        writer = writer.partitionBy(PARTS[family])
    writer.parquet(f"{table_path(root, family)}/_batch={batch}")


def upsert_records(records: DataFrame, root: str) -> None:
    _append(records, root, "records", LAYOUTS["records"]())


def upsert_ecg(ecg: DataFrame, root: str) -> None:
    _append(ecg, root, "ecg", LAYOUTS["ecg"]())


def upsert_routes(routes: DataFrame, root: str) -> None:
    _append(routes, root, "routes", LAYOUTS["routes"]())


def write_job_status(jobs: DataFrame, root: str) -> None:
    _append(jobs, root, "jobs", LAYOUTS["jobs"]())


def write_job_states(states: DataFrame, root: str) -> None:
    _append(states, root, "job_states", LAYOUTS["job_states"]())


def write_rejects(rejects: DataFrame, root: str) -> None:
    _append(rejects, root, "rejects", LAYOUTS["rejects"]())


def upsert_users(users: DataFrame, root: str) -> None:
    _append(users, root, "users", LAYOUTS["users"]())


def scan_table(
    spark: SparkSession,
    root: str,
    family: str,
    user_id: str | None = None,
    versions: bool = False,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """A stored family, for all users or one.

    By default the newest row per key: rows of the snapshot, where there is one,
    replaced by those of later batches; without a snapshot all versions are
    ranked. ``versions`` returns all appended rows. Filters on key columns put on
    the result reach the scan either way. ``start`` and ``end`` keep the rows of
    that range of days.
    """
    schema, keys, newest = TABLES[family]
    path = table_path(root, family)
    ranged = start is not None and end is not None

    def chosen(rows: DataFrame) -> DataFrame:
        if ranged:
            rows = date_range(rows, TIMES[family], start, end)
        if user_id is not None:
            rows = rows.where(F.col("id" if family == "users" else "user_id") == user_id)
        return rows

    home = snapshot_path(root, family)
    if versions or snapshots.state(spark, home).version == 0:
        rows = chosen(spark.read.schema(schema).parquet(path).select(*column_names(schema)))
        return rows if versions else latest_by_key(rows, keys, newest)
    months = (start[:7], end[:7]) if ranged else None
    return chosen(snapshots.read_newest(spark, path, home, _family(family), months))


def compact(spark: SparkSession, root: str, family: str) -> None:
    """Takes what was appended since the last call into the family's snapshot.

    Files of types and months with new rows are written anew; the others stay.
    """
    home = snapshot_path(root, family)
    snapshots.compact_newer(spark, table_path(root, family), home, _family(family), LAYOUTS[family]())


def export_newest(spark: SparkSession, root: str, family: str, target: str) -> None:
    """Writes the newest rows of a family as a table below another root."""
    _append(scan_table(spark, root, family), target, family, LAYOUTS[family]())
