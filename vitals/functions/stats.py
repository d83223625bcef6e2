"""Average, minimum, maximum and count to two decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# From here on a double has no decimals worth keeping, and twelve would not fit.
LARGE = 1e15


def average(value: Column) -> Column:
    """Average rounded half up, of the values to twelve decimals.

    Summing doubles makes the second decimal depend on the order of rows.
    Decimals do not: every value counts with twelve decimals, or as a whole
    number from 1e15 on, in sums that are exact in any order. Only a value that
    no 28 digits hold leaves its group the average of doubles.
    """
    fine = F.when(F.abs(value) < LARGE, value).otherwise(0.0)
    fine = F.when(value.isNotNull(), fine).cast("decimal(28,12)")
    whole = F.when(F.abs(value) >= LARGE, value).otherwise(0.0)
    whole = F.when(value.isNotNull(), whole).try_cast("decimal(28,0)")
    count = F.count(value)
    fits = F.count(whole) == count
    mean = F.try_add(
        (F.sum(fine) / count.cast("decimal(12,0)")).cast("decimal(38,12)"),
        (F.sum(whole) / count.cast("decimal(12,0)")).try_cast("decimal(38,9)").try_cast("decimal(38,12)"),
    )
    exact = F.round(F.when(fits, mean), 2).cast("double")
    return F.coalesce(exact, F.round(F.avg(value), 2))


STATISTICS = ["avg", "min", "max", "count"]


def statistics(value: Column) -> list[Column]:
    """The four aggregates of ``value``; nulls are skipped."""
    return [
        average(value).alias("avg"),
        F.round(F.min(value), 2).alias("min"),
        F.round(F.max(value), 2).alias("max"),
        F.count(value).alias("count"),
    ]
