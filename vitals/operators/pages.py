"""Ordered listings with keyset paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitals.functions.cursor import decode_cursor, encode_cursor, read_cursor
from vitals.operators.filters import date_range, type_filter, user_scope
from vitals.operators.latest import top_per_group
from vitals.schema import ECG_LIMITS, METRIC_LIMITS, WORKOUT_LIMITS


def order_by_start(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows by start text, by key text where the start is absent."""
    start = F.col("start_date")
    return df.orderBy("user_id", F.coalesce(start, F.col(key)) if key else start)


def after(order: Sequence[str], key: Sequence[Column]) -> Column:
    """Keyset predicate: the row's order columns are beyond ``key``.

    The first comparison is implied by the rest; stated on its own it can be
    pushed to the scan.
    """
    beyond = F.lit(False)
    for column, last in reversed(list(zip(order, key))):
        beyond = (F.col(column) > last) | ((F.col(column) == last) & beyond)
    return (F.col(order[0]) >= key[0]) & beyond


def page(
    df: DataFrame,
    order: Sequence[str],
    start: str,
    end: str,
    limit: int | None,
    limits: tuple[int, int],
    cursor: str | DataFrame | None = None,
    user_id: str | None = None,
) -> DataFrame:
    """The first rows per user in ``order`` within the range, after the cursor.

    ``order`` must identify a row within its user, or rows that tie across a
    page border would be lost. ``cursor`` is one cursor for all rows, or a
    DataFrame ``(user_id, cursor)``: a user absent from it, or with an empty
    text, starts at the beginning; a null cursor, as a last page returns it, is
    the end, and that user gets nothing.
    Adds ``position`` and ``page_count``.
    """
    default, maximum = limits
    limit = default if limit is None else limit
    if limit < 1:
        raise ValueError("limit must be at least 1")
    limit = min(limit, maximum)

    rows = date_range(user_scope(df, user_id), order[0], start, end)
    if isinstance(cursor, DataFrame):
        types = {name: kind for name, kind in df.dtypes}
        key_schema = ", ".join(f"{name} {types[name]}" for name in order)
        decoded = cursor.select(
            "user_id",
            F.col("cursor").isNull().alias("_ended"),
            F.nullif("cursor", F.lit("")).alias("_cursor"),
        ).withColumn("_last", decode_cursor(F.col("_cursor"), key_schema))
        # A text that is no cursor fails the query, as a bad argument does.
        decoded = decoded.withColumn(
            "_last",
            F.when(F.col("_cursor").isNull(), None)
            .when(F.col(f"_last.{order[0]}").isNotNull(), F.col("_last"))
            .otherwise(F.raise_error(F.lit("Invalid cursor"))),
        ).drop("_cursor")
        last = [F.col(f"_last.{name}") for name in order]
        # adaptive execution broadcasts few cursors and splits a heavy user's rows
        joined = rows.join(decoded, "user_id", "left")
        rows = (
            joined.where(~F.coalesce("_ended", F.lit(False)))
            .where(F.col("_last").isNull() | after(order, last))
            .drop("_last", "_ended")
        )
    else:
        key = read_cursor(cursor, list(order))
        if key is not None:
            rows = rows.where(after(order, [F.lit(part) for part in key]))

    columns = [F.col(name) for name in order]
    if user_id is not None:
        # one user's page is a plain ordered limit
        rows = rows.orderBy(*columns).limit(limit)
    first = top_per_group(rows, ["user_id"], columns, limit)
    return page_count(first).withColumn("_full", F.col("page_count") == limit)


def page_count(df: DataFrame) -> DataFrame:
    """Adds the number of rows returned to the user.

    A page holds at most its limit, and is already clustered by user.
    """
    return df.withColumn(
        "page_count", F.count("*").over(Window.partitionBy("user_id"))
    )


def next_cursor(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per user the cursor of the following page; null after a page not full."""
    key = F.struct(*order)
    return rows.groupBy("user_id").agg(
        encode_cursor(F.max_by(F.when(F.col("_full"), key), "position")).alias(
            "next_cursor"
        )
    )


def metric_page(
    records: DataFrame,
    record_type: str,
    start: str,
    end: str,
    limit: int | None = None,
    cursor: str | DataFrame | None = None,
    user_id: str | None = None,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Raw records of one type in start order.

    The start is unique per user and type once only the newest versions are
    left; ``tiebreak`` names further columns for rows where it is not.
    """
    return page(
        type_filter(records, record_type),
        ["start_date", *tiebreak],
        start,
        end,
        limit,
        METRIC_LIMITS,
        cursor,
        user_id,
    )


ECG_ORDER = ["ecg_time", "ordinal", "source_file", "row_in_file"]
ROUTE_ORDER = ["route_time", "ordinal", "source_file", "row_in_file"]


def ecg_page(
    ecg: DataFrame,
    start: str,
    end: str,
    limit: int | None = None,
    cursor: str | DataFrame | None = None,
    user_id: str | None = None,
) -> DataFrame:
    return page(ecg, ECG_ORDER, start, end, limit, ECG_LIMITS, cursor, user_id)


def workout_page(
    routes: DataFrame,
    start: str,
    end: str,
    limit: int | None = None,
    cursor: str | DataFrame | None = None,
    user_id: str | None = None,
) -> DataFrame:
    return page(
        routes, ROUTE_ORDER, start, end, limit, WORKOUT_LIMITS, cursor, user_id
    )
