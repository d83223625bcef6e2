"""Text, number and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\v"
NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$"
INTEGER = r"^[+-]?\d+(_\d+)*$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def text(column: str) -> Column:
    """The attribute as text; a missing one is the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def date_prefix(start: Column) -> Column:
    """The recorder's local date: the first ten characters, or ``unknown``."""
    return F.when(F.coalesce(start, F.lit("")) == "", "unknown").otherwise(
        F.substring(start, 1, 10)
    )


def month_of(start: Column) -> Column:
    """The month a time text lies in, or ``other`` for one that starts otherwise."""
    return F.when(start.rlike(r"^\d{4}-\d{2}"), F.substring(start, 1, 7)).otherwise("other")


def parse_number(value: Column) -> Column:
    """A finite decimal number, or null.

    The guard refuses what a cast alone would take (``1d``, ``NaN``,
    ``Infinity``) and takes digit separators (``1_000``) and outer blanks.
    """
    plain = F.replace(F.trim(value, F.lit(BLANKS)), F.lit("_"), F.lit(""))
    # text that does not match is extracted as empty, which casts to null
    number = F.regexp_extract(plain, NUMBER, 1).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def parse_date(value: Column) -> Column:
    """A zero-padded ``YYYY-MM-DD`` text as a date, or null.

    The pattern refuses what a cast alone would take (``2024-1-5``, blanks, a
    time of day).
    """
    padded = value.rlike(ISO_DATE) & (value >= "0001-01-01")
    return F.when(padded, value.try_cast("date"))


def parse_limit(value: Column, default: int, maximum: int) -> Column:
    """Rows asked for, at most ``maximum``; null if not an integer of 1 or more."""
    plain = F.trim(value, F.lit(BLANKS))
    digits = F.regexp_replace(F.translate(plain, "_+", ""), "^0+", "")
    return (
        F.when(value.isNull(), F.lit(default))
        .when(~plain.rlike(INTEGER) | plain.startswith("-") | (digits == ""), None)
        # beyond nine digits any limit is above the maximum
        .when(F.length(digits) > 9, F.lit(maximum))
        .otherwise(F.least(digits.try_cast("int"), F.lit(maximum)))
    )


def is_true(value: Column) -> Column:
    return F.coalesce(value, F.lit("false")) == "true"


def epoch_text(moment: Column) -> Column:
    return F.unix_timestamp(moment).cast("string")


def member_kind(member: Column) -> Column:
    """What an archive member holds; null for members that are not ingested."""
    name = F.lower(member)
    return (
        F.when(name.endswith("exportar.xml") | name.endswith("export.xml"), "xml")
        .when(name.contains("electrocardiograms") & name.endswith(".csv"), "ecg")
        .when(name.contains("workout-routes") & name.endswith(".gpx"), "gpx")
    )


def record_key(record_type: Column, start: Column) -> Column:
    return F.concat_ws("#", F.lit("RECORD"), record_type, start)


def type_time_key(record_type: Column, start: Column) -> Column:
    return F.concat_ws("#", record_type, start)
