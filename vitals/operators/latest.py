"""Newest version per key, and first rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows that may reach one reducer from every task before the group is split.
SPLIT_ABOVE = 20
SALTS = 64
SALT = "_salt"


def with_salt(df: DataFrame) -> DataFrame:
    """Adds a salt that is the same for all rows of a task."""
    return df.withColumn(SALT, F.pmod(F.spark_partition_id(), F.lit(SALTS)))


def _ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    # A row_number bounded by a constant is cut to n rows per group before the
    # shuffle too (WindowGroupLimit), so a hot group costs n rows per task.
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(window)).where(
        F.col("position") <= n
    )


def cut_by_salt(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """At most ``n`` rows per group and salt, among them the group's first ``n``.

    Takes the salt of a salted input, else one per task.
    """
    salted = df if SALT in df.columns else with_salt(df)
    return _ranked(salted, [*keys, SALT], order, n).drop(SALT, "position")


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """The first ``n`` rows of every group in ``order``, numbered from 1.

    With a large ``n`` a group seen by every one of many tasks would still send
    n rows from each to a single reducer. Such groups are first cut within
    salts (one per task, so each task keeps at most n of their rows) and then
    once more as a whole. The outcome does not depend on the salts.
    """
    if n > SPLIT_ABOVE or SALT in df.columns:
        df = cut_by_salt(df, keys, order, n)
    return _ranked(df, keys, order, n)


def latest_by_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The newest row per key: the one with the greatest ``order`` values."""
    newest_first = [F.col(column).desc_nulls_last() for column in order]
    return _ranked(df, keys, newest_first, 1).drop("position")


def dedupe_last(records: DataFrame) -> DataFrame:
    """Per (user, type, start) the record that arrived last within its export."""
    return latest_by_key(
        records, ["user_id", "record_type", "start_date"], ["job_id", "_blk", "_pos"]
    )
