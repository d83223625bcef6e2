"""Answers to tables of requests, all users at once.

The checked requests meet the rows in several places; they are written to the
shared folder when an answer is asked for, so that they are checked, and their
cursors decoded, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitals.functions.cursor import decode_cursor, encode_cursor
from vitals.functions.stats import statistics
from vitals.functions.text import date_prefix
from vitals.operators.filters import in_range
from vitals.operators.latest import cut_by_salt, top_per_group
from vitals.operators.pages import ECG_ORDER, ROUTE_ORDER, after
from vitals.operators.requests import check_requests
from vitals.schema import ECG_LIMITS, METRIC_LIMITS, WORKOUT_LIMITS
from vitals.session import once

KEYS = ["user_id", "record_type"]


def _accepted(
    requests: DataFrame, kind: str, granularity: str | None = None, key: list[str] | None = None
) -> DataFrame:
    """Requests without an error, once per calendar year they touch.

    A request spans at most 90 days, so two years at most. The year, with the
    user and type, makes the range an equality join in which a request meets
    one or two years of daily rows, however many rows its user has.
    """
    checked = check_requests(requests, kind, key).where(F.col("error_code").isNull())
    if granularity is not None:
        checked = checked.where(F.col("granularity") == granularity)
    years = F.array_distinct(
        F.array(F.substring("start", 1, 4), F.substring("end", 1, 4))
    )
    cursor = [F.nullif("cursor", F.lit("")).alias("_cursor")] if "cursor" in requests.columns else []
    return checked.select(
        "request_id",
        "user_id",
        (F.col("type") if kind == "metrics" else F.lit(kind)).alias("record_type"),
        "start",
        "end",
        "limit",
        *cursor,
        F.explode(years).alias("_year"),
    )


def _of_requested(
    rows: DataFrame, accepted: DataFrame, time: str = "start_date"
) -> DataFrame:
    """Only the rows of the users, types and times asked for.

    The types, at most the queryable ones, prune a stored table's partitions
    and bring the span of their requests, so that other rows end at the scan;
    users and types together meet in a plain semi-join.
    """
    spans = accepted.groupBy("record_type").agg(
        F.min("start").alias("_first"), F.max("end").alias("_last")
    )
    asked = (
        rows.join(F.broadcast(spans), "record_type")
        .where(in_range(time, F.col("_first"), F.col("_last")))
        .drop("_first", "_last")
    )
    return asked.join(accepted.select(*KEYS).distinct(), KEYS, "left_semi")


def _per_day(rows: DataFrame, *aggregates: Column, time: str = "start_date") -> DataFrame:
    day = date_prefix(F.col(time))
    return (
        rows.groupBy(*KEYS, day.alias("date"))
        .agg(*aggregates)
        .withColumn("_year", F.substring("date", 1, 4))
    )


def _days_of_requests(accepted: DataFrame, days: DataFrame) -> DataFrame:
    inside = in_range("date", F.col("start"), F.col("end"))
    return accepted.join(days, [*KEYS, "_year"]).where(inside).drop("_year")


def answer_daily(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Daily statistics of every accepted daily request, with the range's unit.

    Records are reduced to one row per user, type and day before they meet the
    requests. The unit is that of the first record in the range, whether or not
    it holds a number; days without numbers are absent. A start occurs once per
    user and type, as in a stored table; of several the smallest unit counts.
    """
    accepted = once(_accepted(requests, "metrics", "daily"), "accepted")
    days = _per_day(
        _of_requested(records, accepted),
        *statistics(F.col("value_num")),
        F.min(F.struct("start_date", "unit")).alias("_earliest"),
    )
    # at most two years of days in a window
    whole = Window.partitionBy("request_id")
    return (
        _days_of_requests(accepted, days)
        .withColumn("unit", F.min("_earliest").over(whole)["unit"])
        .where(F.col("count") > 0)
        .select("request_id", *KEYS, "date", "avg", "min", "max", "count", "unit")
    )


def _answer_pages(
    accepted: DataFrame, rows: DataFrame, order: list[str], largest: int
) -> DataFrame:
    """The page of every accepted request in ``order``, after its cursor if it has one.

    Daily counts tell which days a request's page reaches, and how many of its
    rows come before each. A page enters a day at the day's start, so of any
    day only the first rows up to the largest limit can be needed, and a row's
    place in its day gives its place in the page. A request thus meets fewer
    rows than its limit plus that number, and pages need no sort of their own.
    Only the day a cursor lies in is met row by row, and the page goes on with
    the days behind it.

    Adds ``count``, the rows of the page, and ``next_cursor``, null if the page
    is not full. A cursor that lacks a column of ``order`` gets no rows.
    """
    time, columns = order[0], [F.col(name) for name in order]
    types = dict(rows.dtypes)
    schema = ", ".join(f"{name} {types[name]}" for name in order)
    last = [F.col(f"_last.{name}") for name in order]
    if "_cursor" in accepted.columns:
        accepted = accepted.withColumn("_last", decode_cursor(F.col("_cursor"), schema)).withColumn(
            "_day", F.when(F.col("_cursor").isNotNull(), date_prefix(F.col(f"_last.{time}")))
        )
        whole = F.lit(True)
        for part in last:
            whole = whole & part.isNotNull()
        accepted = accepted.where(F.col("_cursor").isNull() | whole).drop("_cursor")
        accepted = once(accepted, "accepted")
    else:  # nothing is met row by row, which the plan can tell from the nulls
        none = F.lit(None).cast("string")
        accepted = once(accepted, "accepted").withColumns(
            {"_last": decode_cursor(none, schema), "_day": none}
        )
    rows = _of_requested(rows, accepted, time)
    dated = rows.withColumn("date", date_prefix(F.col(time)))
    # what is left of the days that cursors lie in
    begun = (
        accepted.where(F.col("_year") == F.substring("_day", 1, 4))
        .withColumn("date", F.col("_day"))
        .join(dated, [*KEYS, "date"])
        .where(in_range(time, F.col("start"), F.col("end")) & after(order, last))
        .drop("start", "end", "_year", "_last", "_day")
    )
    rest = begun.groupBy("request_id", *KEYS, "date", "limit").agg(F.count("*").alias("_rows"))
    before = (
        Window.partitionBy("request_id")
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    day = [*KEYS, "date"]
    counts = _per_day(rows, F.count("*").alias("_rows"), time=time)
    reached = (
        _days_of_requests(accepted, counts)
        .where(F.col("_day").isNull() | (F.col("date") > F.col("_day")))
        .select("request_id", *KEYS, "date", "limit", "_rows")
        .unionByName(rest.withColumn("_begun", F.lit(True)), allowMissingColumns=True)
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .where((F.col("_before") < F.col("limit")) & F.col("_begun").isNull())
        .select("request_id", *day, "limit", "_before")
    )
    # cut first, so that the join too meets a bounded number of rows per day
    cut = cut_by_salt(dated, day, columns, largest)
    wanted = cut.join(reached.select(*day).distinct(), day, "left_semi")
    place_in_day = F.row_number().over(Window.partitionBy(*day).orderBy(*columns))
    heads = wanted.withColumn("_place", place_in_day).where(F.col("_place") <= largest)
    place = (F.col("_before") + F.col("_place")).cast("int")
    paged = reached.join(heads, day).withColumn("position", place).drop("_before", "_place")
    paged = paged.unionByName(top_per_group(begun, ["request_id"], columns, largest))
    whole_page = Window.partitionBy("request_id")  # at most the largest limit
    full = F.when(F.col("position") == F.col("limit"), encode_cursor(F.struct(*order)))
    return (
        paged.where(F.col("position") <= F.col("limit"))
        .withColumn("count", F.count("*").over(whole_page))
        .withColumn("next_cursor", F.max(full).over(whole_page))
        .drop("limit", "date")
    )


def answer_raw(
    requests: DataFrame, records: DataFrame, tiebreak: tuple[str, ...] = ()
) -> DataFrame:
    """Records of every accepted raw request."""
    order = ["start_date", *tiebreak]
    accepted = _accepted(requests, "metrics", "raw", order)
    return _answer_pages(accepted, records, order, METRIC_LIMITS[1])


def answer_ecg(requests: DataFrame, ecg: DataFrame) -> DataFrame:
    """ECG rows of every accepted request; its type and granularity are ignored."""
    rows = ecg.withColumn("record_type", F.lit("ecg"))
    accepted = _accepted(requests, "ecg")
    return _answer_pages(accepted, rows, ECG_ORDER, ECG_LIMITS[1]).drop("record_type")


def answer_workouts(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes of every accepted request."""
    rows = routes.withColumn("record_type", F.lit("workouts"))
    accepted = _accepted(requests, "workouts")
    pages = _answer_pages(accepted, rows, ROUTE_ORDER, WORKOUT_LIMITS[1])
    return pages.drop("record_type")
