"""Scalar expressions."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from vitals.functions import text


def apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_parse_number(spark):
    cases = {
        "72": 72.0,
        " 72.5\n": 72.5,
        "-1e3": -1000.0,
        "+.5": 0.5,
        "5.": 5.0,
        "1_000": 1000.0,
        "1d": None,
        "1f": None,
        "0x10": None,
        "NaN": None,
        "Infinity": None,
        "-inf": None,
        "1e400": None,
        "": None,
        ".": None,
        "HKCategoryValueSleepAnalysisAsleep": None,
        None: None,
    }
    assert apply(spark, cases, text.parse_number) == list(cases.values())


def test_date_prefix(spark):
    assert apply(spark, ["2024-01-15T10:00", "2024", "", None], text.date_prefix) == [
        "2024-01-15", "2024", "unknown", "unknown",
    ]


def test_parse_date_wants_padded_real_days(spark):
    good = ["2024-02-29", "0001-01-01", "9999-12-31"]
    bad = ["2023-02-29", "2024-1-5", "01-15-2024", "2024-13-01", "0000-01-01", "", None]
    bad += ["2024-01-15T00:00:00", " 2024-01-15"]
    days = apply(spark, good + bad, text.parse_date)
    assert [d is not None for d in days] == [True] * len(good) + [False] * len(bad)


def test_parse_limit(spark):
    cases = {
        None: 50, "1": 1, "200": 200, "201": 200, "5000": 200, " 7 ": 7, "+9": 9,
        "1_0": 10, "007": 7, "99999999999999999999": 200, "0": None, "00": None,
        "-3": None, "": None, "abc": None, "1.5": None, "1__0": None, "_1": None,
    }
    found = apply(spark, cases, lambda c: text.parse_limit(c, 50, 200))
    assert found == list(cases.values())


@pytest.mark.parametrize(
    "member, kind",
    [
        ("export/exportar.xml", "xml"),
        ("EXPORT.XML", "xml"),
        ("a/electrocardiograms/ecg_2024.csv", "ecg"),
        ("a/Electrocardiograms/x.CSV", "ecg"),
        ("a/workout-routes/route.gpx", "gpx"),
        ("a/electrocardiograms/export.xml", "xml"),
        ("a/electrocardiograms/x.gpx", None),
        ("a/other.csv", None),
        ("a/export.xml.bak", None),
    ],
)
def test_member_kind(spark, member, kind):
    assert apply(spark, [member], text.member_kind) == [kind]


def test_flags_and_keys(spark):
    assert apply(spark, ["true", "false", "TRUE", None], text.is_true) == [
        True, False, False, False,
    ]
    assert apply(spark, ["2024-01-15"], lambda c: text.record_key(F.lit("HeartRate"), c)) == [
        "RECORD#HeartRate#2024-01-15"
    ]


def _generated(alphabet, size, seed):
    generator = random.Random(seed)
    return [
        "".join(generator.choice(alphabet) for _ in range(generator.randint(0, 7)))
        for _ in range(size)
    ]


def test_parse_number_agrees_with_decimal_arithmetic(spark):
    texts = _generated("0123456789..+--eE__ \tdfx", 4000, 1) + ["1e309", "-1e309", "1e-400"]

    def number(value):
        try:
            found = float(Decimal(value))
        except ArithmeticError:
            return None
        return found if math.isfinite(found) else None

    assert apply(spark, texts, text.parse_number) == [number(value) for value in texts]


def test_parse_limit_agrees_with_integer_arithmetic(spark):
    texts = _generated("0123456789+-_ .a", 4000, 2)

    def limit(value):
        try:
            found = int(value)
        except ValueError:
            return None
        return min(found, 1000) if found >= 1 else None

    found = apply(spark, texts, lambda c: text.parse_limit(c, 100, 1000))
    assert found == [limit(value) for value in texts]
