"""The seven-day health summary of every user."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.functions.stats import STATISTICS, statistics
from vitals.operators.filters import date_range, type_filter, user_scope
from vitals.operators.jobs import recent_jobs
from vitals.schema import SUMMARY_DAYS, SUMMARY_JOBS, column_names
from vitals.sources.store import scan_table

# Summary field -> measurement type.
SUMMARY_METRICS = {
    "heart_rate": "HeartRate",
    "hrv": "HeartRateVariabilitySDNN",
    "blood_pressure": "BloodPressureSystolic",
}
DIASTOLIC = "BloodPressureDiastolic"

# The last update comes first, as it orders the list.
JOB_FIELDS = "updated_at: STRING, job_id: STRING, status: STRING, error_step: STRING"


def _rows(df: DataFrame, family: Column, value: Column) -> DataFrame:
    return df.select("user_id", family.alias("family"), value.alias("value"))


def health_summary_stored(spark: SparkSession, root: str, as_of: date) -> DataFrame:
    """The summary of the stored tables, of which only the period is read."""
    period = {
        "start": (as_of - timedelta(days=SUMMARY_DAYS)).isoformat(),
        "end": as_of.isoformat(),
    }
    return health_summary(
        scan_table(spark, root, "records", **period),
        scan_table(spark, root, "ecg", **period),
        scan_table(spark, root, "routes", **period),
        scan_table(spark, root, "jobs"),
        as_of,
    )


def health_summary(
    records: DataFrame,
    ecg: DataFrame,
    routes: DataFrame,
    jobs: DataFrame,
    as_of: date,
    user_id: str | None = None,
) -> DataFrame:
    """One row per user with rows in the period or with jobs.

    The period is ``as_of`` and the seven days before it, both ends included.
    A metric without values is null, a count without rows 0, and
    ``recent_jobs`` empty. Measurements, ECGs and routes are aggregated
    together, in per-task partial results; the jobs join that on the same key.
    """
    start = (as_of - timedelta(days=SUMMARY_DAYS)).isoformat()
    end = as_of.isoformat()
    types = [*SUMMARY_METRICS.values(), DIASTOLIC]

    measured = date_range(
        type_filter(user_scope(records, user_id), *types), "start_date", start, end
    )
    no_value = F.lit(None).cast("double")
    rows = (
        _rows(measured, F.col("record_type"), F.col("value_num"))
        .unionAll(
            _rows(
                date_range(user_scope(ecg, user_id), "ecg_time", start, end),
                F.lit("ECG"),
                no_value,
            )
        )
        .unionAll(
            _rows(
                date_range(user_scope(routes, user_id), "route_time", start, end),
                F.lit("GPX"),
                no_value,
            )
        )
    )
    # One set of statistics per user and family, then at most six rows per user
    # side by side: cheaper than every set over every row.
    families = rows.groupBy("user_id", "family").agg(
        *statistics(F.col("value")), F.count("*").alias("rows")
    )
    of = lambda name, part: F.max(
        F.when(F.col("family") == name, F.col(part))
    )
    totals = families.groupBy("user_id").agg(
        *(
            of(name, part).alias(f"{field}_{part}")
            for field, name in SUMMARY_METRICS.items()
            for part in STATISTICS
        ),
        of(DIASTOLIC, "avg").alias("avg_diastolic"),
        of("ECG", "rows").alias("ecg_count"),
        of("GPX", "rows").alias("workout_count"),
    )

    # at most five jobs per user are gathered
    job = F.struct(*column_names(JOB_FIELDS.replace(": ", " ")))
    newest = (
        recent_jobs(jobs, SUMMARY_JOBS, user_id, ordered=False)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list(job), asc=False).alias("recent_jobs"))
    )
    empty = F.array().cast(f"array<struct<{JOB_FIELDS}>>")

    def metric(field: str) -> Column:
        value = F.struct(*(F.col(f"{field}_{part}").alias(part) for part in STATISTICS))
        return F.when(F.col(f"{field}_count") > 0, value).alias(field)

    return totals.join(newest, "user_id", "full").select(
        "user_id",
        F.lit(start).alias("period_start"),
        F.lit(end).alias("period_end"),
        *(metric(field) for field in SUMMARY_METRICS),
        "avg_diastolic",
        F.coalesce("ecg_count", F.lit(0)).alias("ecg_count"),
        F.coalesce("workout_count", F.lit(0)).alias("workout_count"),
        F.coalesce("recent_jobs", empty).alias("recent_jobs"),
    )
