"""Row filters. All are plain predicates, so they reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def user_scope(df: DataFrame, user_id: str | None = None) -> DataFrame:
    """One user's rows; without a user, everybody's."""
    return df if user_id is None else df.where(F.col("user_id") == user_id)


def type_filter(df: DataFrame, *record_types: str) -> DataFrame:
    """Exact types. On a stored table this prunes partitions."""
    return df.where(F.col("record_type").isin(*record_types))


def in_range(column: str, start: str | Column, end: str | Column) -> Column:
    """Inclusive text range. ``~`` sorts after any time of the end day."""
    last = F.concat(F.lit(end) if isinstance(end, str) else end, F.lit("~"))
    return F.col(column).between(start, last)


def date_range(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    return df.where(F.col(column).between(start, f"{end}~"))


def key_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.where(F.col(column).startswith(prefix))


def metric_scope(
    records: DataFrame,
    record_types: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    user_id: str | None = None,
) -> DataFrame:
    """Type, time range and user restrictions of a metrics query."""
    scoped = user_scope(records, user_id)
    if record_types is not None:
        scoped = type_filter(scoped, *record_types)
    if start is not None or end is not None:
        scoped = date_range(scoped, "start_date", start or "", end or "")
    return scoped
