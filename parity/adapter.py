"""The driver's tables as records, ECGs, routes, jobs, sign-ups and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {
    "click": "HKQuantityTypeIdentifierHeartRate",
    "view": "HKQuantityTypeIdentifierHeartRateVariabilitySDNN",
    "purchase": "HKQuantityTypeIdentifierBloodPressureSystolic",
    "signup": "HKQuantityTypeIdentifierStepCount",
    "error": "Untracked",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identifier() -> Column:
    code = F.lit(None).cast("string")
    for event, name in TYPES.items():
        code = F.when(F.col("event_type") == event, name).otherwise(code)
    return code


def time_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def user() -> Column:
    return F.col("user_id").cast("string").alias("user_id")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the XML reader would return them."""
    events = table(spark, sf_dir, "events")
    return events.select(
        user(),
        (F.col("event_id") % 3).cast("string").alias("job_id"),
        identifier().alias("type"),
        F.concat(F.lit("u"), (F.col("event_id") % 7).cast("string")).alias("unit"),
        F.col("value").cast("string").alias("value"),
        time_text("ts").alias("start_date"),
        F.lit("").alias("creation_date"),
        F.lit(0).cast("long").alias("_blk"),
        F.col("event_id").alias("_pos"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vitals.operators.records import map_record_type, project_record

    return project_record(map_record_type(scan(spark, sf_dir)))


def ecg(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type = 'view'")
    return events.select(
        user(),
        time_text("ts").alias("ecg_time"),
        F.col("event_id").alias("ordinal"),
        F.lit("ecg.csv").alias("source_file"),
        F.col("props").alias("classification"),
        F.col("value").cast("string").alias("average_heart_rate"),
        F.lit("0").alias("created_at"),
        (F.col("event_id") % 3).cast("string").alias("job_id"),
        F.col("event_id").alias("row_in_file"),
        F.lit(0).cast("long").alias("_ingested"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track per user and day: its first and last point, and their number."""
    events = table(spark, sf_dir, "events")
    point = F.struct(time_text("ts").alias("time"), "event_id", "value")
    return events.groupBy(
        user(), F.date_format("ts", "yyyy-MM-dd").alias("day")
    ).agg(
        F.min(point).alias("first"),
        F.max(point).alias("last"),
        F.count("*").cast("int").alias("waypoint_count"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select(
        "user_id",
        F.col("first.time").alias("route_time"),
        F.lit(0).cast("long").alias("ordinal"),
        F.concat("day", F.lit(".gpx")).alias("source_file"),
        "waypoint_count",
        F.col("first.value").cast("string").alias("start_lat"),
        F.col("first.event_id").cast("string").alias("start_lon"),
        F.col("last.value").cast("string").alias("end_lat"),
        F.col("last.event_id").cast("string").alias("end_lon"),
        F.lit("0").alias("created_at"),
        F.lit("0").alias("job_id"),
        F.lit(0).cast("long").alias("row_in_file"),
        F.lit(0).cast("long").alias("_ingested"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"),
        # of equal length, so that text order is upload order
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("job_id"),
        F.when(status == "F", "COMPLETED")
        .when(status == "P", "PROCESSING")
        .otherwise("FAILED")
        .alias("status"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
        .cast("string")
        .alias("updated_at"),
        F.lit(None).cast("string").alias("error_step"),
    )


def signups(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    verified = F.when(F.col("c_acctbal") > 0, "true").otherwise("false")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("user_name"),
        F.struct(
            F.concat(name, F.lit("@example.com")).alias("email"),
            verified.alias("email_verified"),
            F.split_part(name, F.lit("#"), F.lit(1)).alias("given_name"),
            F.split_part(name, F.lit("#"), F.lit(2)).alias("family_name"),
            name.alias("name"),
        ).alias("attributes"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metrics request per order, good and bad ones mixed by its key."""
    key, user_id = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (key % 30).cast("int"))
    span = (key % 100).cast("int")
    end = F.date_format(F.date_add(day, span), "yyyy-MM-dd")
    start = F.date_format(day, "yyyy-MM-dd")
    pick = lambda n, *cases: F.element_at(
        F.array(*(F.lit(case).cast("string") for case in cases)),
        (key % n + 1).cast("int"),
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("request_id"),
        F.when(key % 41 == 0, "")
        .otherwise(F.floor(user_id / 10).cast("string"))
        .alias("user_id"),
        pick(
            7, "HeartRate", "HeartRateVariabilitySDNN", "StepCount", "HeartRate",
            "BloodPressureSystolic", "SleepAnalysis", "HeartRate",
        ).alias("type"),
        F.when(key % 29 == 0, "2024-13-01").when(key % 31 == 0, "2024-1-5")
        .otherwise(start).alias("start"),
        F.when(key % 37 == 0, "").when(key % 23 == 0, "2023-12-31")
        .otherwise(end).alias("end"),
        pick(3, None, "daily", "raw").alias("granularity"),
        pick(
            11, None, "5", "0", "-3", "5000", "abc", "1_0", " 7 ", "+12", "", "99999999999"
        ).alias("limit"),
    ).withColumn(
        "granularity",
        F.when(F.col("request_id") % 43 == 0, "weekly").otherwise(F.col("granularity")),
    )
