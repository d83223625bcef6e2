"""Daily and whole-range statistics, units and counts."""

import random
from decimal import ROUND_HALF_UP, Decimal, getcontext

import pytest

from vitals.operators.metrics import (
    count_in_range,
    first_unit,
    metric_daily,
    metric_summary,
)

SCHEMA = (
    "user_id STRING, record_type STRING, start_date STRING, value_num DOUBLE, unit STRING"
)


def make(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def hr(start, value, unit="bpm", user="a"):
    return (user, "HeartRate", start, value, unit)


def test_daily_groups_by_local_date(spark, rows):
    records = make(
        spark,
        [
            hr("2024-01-15T10:00:00", 58.5),
            hr("2024-01-15T14:00:00", 97.0),
            hr("2024-01-16T10:00:00", 43.0),
        ],
    )
    assert rows(metric_daily(records), "date", "avg", "min", "max", "count") == [
        ("2024-01-15", 77.75, 58.5, 97.0, 2),
        ("2024-01-16", 43.0, 43.0, 43.0, 1),
    ]


def test_daily_skips_missing_values_and_names_missing_dates(spark, rows):
    records = make(
        spark,
        [
            hr("2024-01-15T10:00:00", None),
            hr("2024-01-16T10:00:00", None),
            hr("2024-01-16T11:00:00", 1.0),
            hr("", 2.0),
            hr(None, 4.0),
        ],
    )
    assert rows(metric_daily(records), "date", "avg", "count") == [
        ("2024-01-16", 1.0, 1),
        ("unknown", 3.0, 2),
    ]


def test_daily_is_ordered_on_request(spark):
    records = make(spark, [hr(f"2024-01-{day:02d}", 1.0) for day in (3, 1, 2)])
    dates = [row["date"] for row in metric_daily(records, ordered=True).collect()]
    assert dates == ["2024-01-01", "2024-01-02", "2024-01-03"]


def test_offset_times_stay_on_their_own_day(spark, rows):
    records = make(spark, [hr("2024-01-15 23:30:00 -0800", 60.0)])
    assert rows(metric_daily(records), "date") == [("2024-01-15",)]


def test_range_includes_the_whole_end_day_and_excludes_empty_times(spark, rows):
    records = make(
        spark,
        [
            hr("2024-01-14 23:59:59", 1.0),
            hr("2024-01-15 00:00:00", 2.0),
            hr("2024-01-16 23:59:59.999", 3.0),
            hr("2024-01-17 00:00:00", 4.0),
            hr("", 5.0),
        ],
    )
    found = metric_daily(records, ["HeartRate"], "2024-01-15", "2024-01-16")
    assert rows(found, "avg") == [(2.0,), (3.0,)]


def test_type_filter_is_exact(spark, rows):
    records = make(
        spark,
        [hr("2024-01-15", 1.0), ("a", "HeartRateVariabilitySDNN", "2024-01-15", 9.0, "ms")],
    )
    assert rows(metric_daily(records, ["HeartRate"]), "avg") == [(1.0,)]


def test_summary_over_the_range(spark, rows):
    records = make(spark, [hr("2024-01-15", v) for v in (51.0, 112.0, 68.0)])
    assert rows(metric_summary(records), "avg", "min", "max", "count") == [
        (77.0, 51.0, 112.0, 3)
    ]


def test_summary_without_numbers_is_null(spark, rows):
    records = make(spark, [hr("2024-01-15", None)])
    assert rows(metric_summary(records), "avg", "min", "max", "count") == [
        (None, None, None, None)
    ]
    assert rows(metric_summary(records.where("false"))) == []


def test_average_of_decimals_is_exact(spark, rows):
    # sums of doubles round the tie 0.015 either way
    cents = [hr("2024-01-15", 0.01), hr("2024-01-15", 0.02)]
    assert rows(metric_daily(make(spark, cents)), "avg") == [(0.02,)]
    negative = [hr("2024-01-15", -0.01), hr("2024-01-15", -0.02)]
    assert rows(metric_daily(make(spark, negative)), "avg") == [(-0.02,)]


def test_average_matches_decimal_arithmetic(spark):
    generator = random.Random(3)
    data, expected = [], {}
    for user in range(60):
        values = [
            round(generator.uniform(-500, 500), generator.choice([0, 1, 2, 4, 6]))
            for _ in range(generator.randint(1, 9))
        ]
        data += [hr("2024-01-15", value, user=str(user)) for value in values]
        exact = sum(Decimal(repr(v)) for v in values) / len(values)
        expected[str(user)] = float(exact.quantize(Decimal("0.01"), ROUND_HALF_UP))
    found = {row["user_id"]: row["avg"] for row in metric_daily(make(spark, data)).collect()}
    assert found == expected


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_average_of_fine_and_large_values_has_one_rule(spark, parts):
    getcontext().prec = 60
    generator = random.Random(5)
    data, expected = [], {}
    for user in range(40):
        digits = generator.choice([7, 9, 10, 12])
        values = [round(generator.uniform(-50, 50), digits) for _ in range(generator.randint(1, 9))]
        if user % 4 == 0:
            values += [9e12, 1.0, 8e15, -3e16, 1 / 3]
        data += [hr("2024-01-15", value, user=str(user)) for value in values]
        exact = sum(Decimal(repr(v)).quantize(Decimal("1e-12"), ROUND_HALF_UP) for v in values) / len(values)
        expected[str(user)] = float(exact.quantize(Decimal("0.01"), ROUND_HALF_UP))
    generator.shuffle(data)
    found = {r["user_id"]: r["avg"] for r in metric_daily(make(spark, data).repartition(parts)).collect()}
    assert found == expected


def test_average_beyond_all_decimals_is_that_of_doubles(spark, rows):
    (average,), = rows(metric_daily(make(spark, [hr("2024-01-15", v) for v in (1e300, 3e300)])), "avg")
    assert average == pytest.approx(2e300)


def test_first_unit_is_the_earliest_records(spark, rows):
    records = make(
        spark,
        [hr("2024-01-16", 1.0, "b"), hr("2024-01-15", None, "a"), hr("2024-01-14", 1.0, "z")],
    )
    assert rows(first_unit(records, None, "2024-01-15", "2024-01-31"), "unit") == [("a",)]


def test_count_in_range(spark, rows):
    ecg = spark.createDataFrame(
        [("a", "2024-01-15 10"), ("a", "2024-01-16 10"), ("b", "2024-01-17"), ("a", "")],
        "user_id STRING, ecg_time STRING",
    )
    assert rows(count_in_range(ecg, "ecg_time", "2024-01-15", "2024-01-16")) == [("a", 2)]
