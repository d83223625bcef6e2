"""Statistics per metric, over days or a whole range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.functions.stats import statistics
from vitals.functions.text import date_prefix
from vitals.operators.filters import date_range, metric_scope, user_scope


def metric_daily(
    records: DataFrame,
    record_types: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    user_id: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Average, minimum, maximum and count per user, type and local date.

    Rows without a number are skipped and a day without any is absent. The
    statistics are combined on the map side, so a user or day with very many
    rows reaches the shuffle as one row per task.
    """
    scoped = metric_scope(records, record_types, start, end, user_id)
    daily = (
        scoped.where(F.col("value_num").isNotNull())
        .groupBy(
            "user_id", "record_type", date_prefix(F.col("start_date")).alias("date")
        )
        .agg(*statistics(F.col("value_num")))
    )
    return daily.orderBy("user_id", "record_type", "date") if ordered else daily


def metric_summary(
    records: DataFrame,
    record_types: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    user_id: str | None = None,
) -> DataFrame:
    """The same statistics over the whole range.

    A user with rows of a type but no number among them keeps a row of nulls.
    """
    scoped = metric_scope(records, record_types, start, end, user_id)
    summary = scoped.groupBy("user_id", "record_type").agg(
        *statistics(F.col("value_num"))
    )
    return summary.withColumn("count", F.expr("nullif(count, 0)"))


def first_unit(
    records: DataFrame,
    record_types: list[str] | None = None,
    start: str | None = None,
    end: str | None = None,
    user_id: str | None = None,
) -> DataFrame:
    """Unit of the earliest record in the range.

    A start occurs once per user and type, as in a stored table; where it does
    not, the smallest unit of the earliest start counts.
    """
    scoped = metric_scope(records, record_types, start, end, user_id)
    earliest = F.struct("start_date", "unit")
    return (
        scoped.groupBy("user_id", "record_type")
        .agg(F.min(earliest).alias("earliest"))
        .select("user_id", "record_type", F.col("earliest.unit").alias("unit"))
    )


def count_in_range(
    df: DataFrame, column: str, start: str, end: str, user_id: str | None = None
) -> DataFrame:
    """Rows per user whose time lies in the range."""
    scoped = date_range(user_scope(df, user_id), column, start, end)
    return scoped.groupBy("user_id").agg(F.count("*").alias("count"))
