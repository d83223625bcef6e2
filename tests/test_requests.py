"""Bounds of the queries."""

import base64
import json

import pytest

from vitals.operators.requests import check_requests
from vitals.plans.dashboard import answer_ecg
from vitals.schema import QUERYABLE_TYPES, RECORD_TYPES

FIELDS = ["user_id", "type", "start", "end", "granularity", "limit", "cursor"]
SCHEMA = ", ".join(f"{field} STRING" for field in FIELDS)
GOOD = dict(user_id="u", type="HeartRate", start="2024-01-01", end="2024-01-31")


def check(spark, kind="metrics", **changes):
    request = {**dict.fromkeys(FIELDS), **GOOD, **changes}
    df = spark.createDataFrame([tuple(request[f] for f in FIELDS)], SCHEMA)
    return check_requests(df, kind).first()


@pytest.mark.parametrize(
    "changes, code",
    [
        ({}, None),
        ({"user_id": None}, "UNAUTHORIZED"),
        ({"type": None}, "MISSING_PARAMETER"),
        ({"start": ""}, "MISSING_PARAMETER"),
        ({"end": None}, "MISSING_PARAMETER"),
        ({"type": "SleepAnalysis"}, "INVALID_METRIC_TYPE"),
        ({"type": "AppleStandTime"}, None),
        ({"start": "01-15-2024"}, "INVALID_DATE"),
        ({"end": "2024-02-30"}, "INVALID_DATE"),
        ({"start": "2024-02-01"}, "INVALID_DATE"),
        ({"end": "2024-01-01"}, None),
        ({"end": "2024-03-31"}, None),
        ({"end": "2024-04-01"}, "DATE_RANGE_EXCEEDED"),
        ({"end": "2024-06-01"}, "DATE_RANGE_EXCEEDED"),
        ({"granularity": "weekly"}, "INVALID_GRANULARITY"),
        ({"granularity": ""}, "INVALID_GRANULARITY"),
        ({"granularity": "raw", "limit": "0"}, "INVALID_LIMIT"),
        ({"granularity": "raw", "limit": "abc"}, "INVALID_LIMIT"),
        ({"limit": "abc"}, None),
        ({"granularity": "raw", "cursor": "not-base64!!"}, "INVALID_CURSOR"),
        ({"granularity": "raw", "cursor": ""}, None),
        ({"granularity": "raw", "cursor": "eyJzdGFydF9kYXRlIjoiMjAyNCJ9"}, None),
        # {"date":"2024"}, {"start_date":null}, {}
        ({"granularity": "raw", "cursor": "eyJkYXRlIjoiMjAyNCJ9"}, "INVALID_CURSOR"),
        ({"granularity": "raw", "cursor": "eyJzdGFydF9kYXRlIjpudWxsfQ=="}, "INVALID_CURSOR"),
        ({"granularity": "raw", "cursor": "e30="}, "INVALID_CURSOR"),
        ({"granularity": "daily", "cursor": "e30="}, None),
        ({"type": "x", "start": "y", "limit": "z"}, "INVALID_METRIC_TYPE"),
    ],
)
def test_first_failing_rule_names_the_error(spark, changes, code):
    assert check(spark, **changes)["error_code"] == code


def test_defaults_and_clamps(spark):
    daily = check(spark)
    assert (daily["granularity"], daily["limit"]) == ("daily", None)
    assert check(spark, granularity="raw")["limit"] == 100
    assert check(spark, granularity="raw", limit="5000")["limit"] == 1000
    assert check(spark, "ecg")["limit"] == 50
    assert check(spark, "workouts", limit="999")["limit"] == 200


def test_listings_need_neither_type_nor_granularity(spark):
    row = check(spark, "ecg", type=None, granularity="weekly")
    assert row["error_code"] is None
    assert check(spark, "ecg", limit="-1")["error_code"] == "INVALID_LIMIT"


def test_cursors_hold_all_columns_of_the_order(spark):
    def code(kind, **key):
        cursor = base64.urlsafe_b64encode(json.dumps(key).encode()).decode()
        return check(spark, kind, cursor=cursor)["error_code"]

    place = dict(ordinal=1, source_file="f", row_in_file=2)
    assert code("ecg", ecg_time="2024-01-01", **place) is None
    assert code("workouts", route_time="2024-01-01", **place) is None
    assert code("ecg", route_time="2024-01-01", **place) == "INVALID_CURSOR"
    assert code("workouts", route_time="2024-01-01") == "INVALID_CURSOR"


def test_dictionaries():
    assert len(RECORD_TYPES) == 55
    assert len(QUERYABLE_TYPES) == 25
    assert RECORD_TYPES["HKCategoryTypeIdentifierSleepAnalysis"] == "SleepAnalysis"
    assert set(QUERYABLE_TYPES) - set(RECORD_TYPES.values()) == {"AppleStandTime"}


def test_answers_check_their_requests_once(spark, tmp_path, rows):
    path = str(tmp_path / "requests")
    asked = spark.createDataFrame([(1, "u", "2024-01-01", "2024-01-09", "2"), (2, "u", "2024-01-01", "x", "2")],
                                  "request_id LONG, user_id STRING, start STRING, end STRING, limit STRING")
    asked.write.parquet(path)
    requests = spark.read.parquet(path)
    ecg = spark.range(5).selectExpr(
        "'u' user_id", "concat('2024-01-0', id + 1) ecg_time", "id ordinal", "'e.csv' source_file", "id row_in_file", "'1' job_id"
    )
    first = answer_ecg(requests, ecg)
    assert not [name for name in first.inputFiles() if path in name]
    assert rows(first, "ecg_time", "position") == [("2024-01-01", 1), ("2024-01-02", 2)]
    cursors = first.selectExpr("request_id", "next_cursor cursor").distinct()
    following = f"{path}-next"
    requests.join(cursors, "request_id").write.parquet(following)
    second = answer_ecg(spark.read.parquet(following), ecg)
    assert not [name for name in second.inputFiles() if following in name]
    assert rows(second, "ecg_time", "position") == [("2024-01-03", 1), ("2024-01-04", 2)]
