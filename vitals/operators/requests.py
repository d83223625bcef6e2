"""Bounds of the dashboard queries, applied to a table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.functions.cursor import decode_cursor
from vitals.functions.text import parse_date, parse_limit
from vitals.operators.pages import ECG_ORDER, ROUTE_ORDER
from vitals.schema import (
    ECG_LIMITS,
    MAX_RANGE_DAYS,
    METRIC_LIMITS,
    QUERYABLE_TYPES,
    WORKOUT_LIMITS,
)

LIMITS = {"metrics": METRIC_LIMITS, "ecg": ECG_LIMITS, "workouts": WORKOUT_LIMITS}
# Columns a cursor holds at least.
CURSOR_KEYS = {"metrics": ["start_date"], "ecg": ECG_ORDER, "workouts": ROUTE_ORDER}


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def check_requests(
    requests: DataFrame, kind: str = "metrics", key: list[str] | None = None
) -> DataFrame:
    """Adds ``error_code`` (the first failing rule, else null) and the bounds.

    ``requests`` has ``user_id, start, end, limit`` and, for metrics, ``type``
    and ``granularity``, all as text; ``cursor`` is optional. ``limit`` becomes
    the rows allowed and ``granularity`` its default. A daily request has no
    limit. A cursor that cannot be read or lacks a column of ``key``, which by
    default is the order of the kind's pages, is an error.
    """
    metrics = kind == "metrics"
    default, maximum = LIMITS[kind]
    granularity = F.coalesce(F.col("granularity"), F.lit("daily")) if metrics else None
    paged = granularity == "raw" if metrics else F.lit(True)
    parsed = requests.withColumns(
        {
            "_first": parse_date(F.col("start")),
            "_last": parse_date(F.col("end")),
            "_rows": F.when(paged, parse_limit(F.col("limit"), default, maximum)),
        }
    )
    first, last, limit = F.col("_first"), F.col("_last"), F.col("_rows")

    rules = [(_blank("user_id"), "UNAUTHORIZED")]
    for name in ["type", "start", "end"] if metrics else ["start", "end"]:
        rules.append((_blank(name), "MISSING_PARAMETER"))
    if metrics:
        rules.append((~F.col("type").isin(QUERYABLE_TYPES), "INVALID_METRIC_TYPE"))
    rules += [
        (first.isNull() | last.isNull() | (first > last), "INVALID_DATE"),
        (F.date_diff(last, first) > MAX_RANGE_DAYS, "DATE_RANGE_EXCEEDED"),
    ]
    if metrics:
        rules.append((~granularity.isin("daily", "raw"), "INVALID_GRANULARITY"))
    rules.append((paged & limit.isNull(), "INVALID_LIMIT"))
    if "cursor" in requests.columns:
        payload = decode_cursor(F.col("cursor"), "map<string,string>")
        held = payload.isNotNull()
        for name in key or CURSOR_KEYS[kind]:
            held = held & F.coalesce(payload[name].isNotNull(), F.lit(False))
        rules.append((paged & ~_blank("cursor") & ~held, "INVALID_CURSOR"))

    code = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        code = F.when(broken, name).otherwise(code)
    checked = parsed.withColumns({"error_code": code, "limit": limit})
    if metrics:
        checked = checked.withColumn("granularity", granularity)
    return checked.drop("_first", "_last", "_rows")
