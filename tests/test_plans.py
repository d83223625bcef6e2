"""The physical plans the operators are written for."""

import re

import pytest
from pyspark.sql import functions as F

from vitals.operators import metrics, pages
from vitals.plans.summary import health_summary
from vitals.schema import ECG, JOBS, ROUTES
from vitals.sources import store


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    days = F.format_string("2024-01-%02d 10", F.pmod("id", F.lit(28)).cast("int") + 1)
    rows = spark.range(400).select(
        (F.col("id") % 7).cast("string").alias("user_id"),
        F.when(F.col("id") % 2 == 0, "HeartRate").otherwise("StepCount").alias("record_type"),
        days.alias("start_date"), F.lit("1").alias("value"), F.lit("u").alias("unit"),
        F.lit("").alias("creation_date"), F.lit("1").alias("job_id"),
        F.lit(1.0).alias("value_num"), F.lit(0).cast("long").alias("_ingested"),
        F.lit(0).cast("long").alias("_blk"), F.col("id").alias("_pos"),
    )
    store.upsert_records(rows, root)
    for family, schema in [("ecg", ECG), ("routes", ROUTES), ("jobs", JOBS)]:
        spark.createDataFrame([], schema).write.parquet(store.table_path(root, family))
    return root


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_daily_scan_is_pruned_and_pushed(spark, tables):
    records = store.scan_table(spark, tables, "records", versions=True)
    text = plan(metrics.metric_daily(records, ["HeartRate"], "2024-01-05", "2024-01-09", "3"))
    assert re.search(r"PartitionFilters: \[[^]]*record_type[^]]* = HeartRate", text)
    assert "EqualTo(user_id,3)" in text and "GreaterThanOrEqual(start_date" in text
    assert re.search(r"ReadSchema: struct<user_id:string,start_date:string,value_num:double>", text)
    assert text.count("Exchange ") == 1
    assert "partial_" in text and "Sort " not in text


def test_newest_versions_are_limited_before_the_shuffle(spark, tables):
    current = store.scan_table(spark, tables, "records", user_id="3")
    text = plan(current.where("record_type = 'HeartRate'"))
    assert text.count("Exchange ") == 1
    assert re.search(r"Partial.*Exchange|Exchange[\s\S]*WindowGroupLimit.*Partial", text)
    # filters on key columns pass below the window
    assert "EqualTo(user_id,3)" in text
    assert re.search(r"PartitionFilters: \[[^]]*record_type[^]]* = HeartRate", text)


def test_pages_are_limited_before_both_shuffles(spark, tables):
    records = store.scan_table(spark, tables, "records", versions=True)
    text = plan(pages.metric_page(records, "HeartRate", "2024-01-01", "2024-01-31", 1000))
    assert len(re.findall(r"WindowGroupLimit.*Partial", text)) == 2
    assert text.count("Exchange ") == 2


def test_one_users_page_is_an_ordered_limit(spark, tables):
    records = store.scan_table(spark, tables, "records", versions=True)
    text = plan(
        pages.metric_page(records, "HeartRate", "2024-01-01", "2024-01-31", 10, user_id="3")
    )
    assert "TakeOrderedAndProject" in text


def test_summary_aggregates_three_families_together(spark, tables):
    from datetime import date

    read = lambda family: store.scan_table(spark, tables, family, versions=True)
    text = plan(
        health_summary(read("records"), read("ecg"), read("routes"), read("jobs"), date(2024, 1, 9))
    )
    # per user and family, per user, and the jobs; the join needs none
    assert text.count("Exchange ") == 3
    assert "partial_" in text and "SortAggregate" not in text
    for hint in ["Python", "Cartesian", "NestedLoop", "BroadcastExchange"]:
        assert hint not in text


def test_written_files_hold_one_type_and_sorted_users(spark, tables):
    text = spark.read.parquet(store.table_path(tables, "records"))
    files = text.groupBy(F.input_file_name()).agg(F.count_distinct("record_type").alias("n"))
    assert files.where("n > 1").count() == 0


def test_time_ranges_are_pushed_to_files_of_few_months(spark, tables, tmp_path):
    records = store.scan_table(spark, tables, "records", versions=True, start="2024-01-05", end="2024-01-09")
    text = plan(metrics.metric_daily(records, ["HeartRate"], "2024-01-05", "2024-01-09"))
    assert "GreaterThanOrEqual(start_date,2024-01-05)" in text
    rows = spark.range(24_000).select(
        (F.col("id") % 50).cast("string").alias("user_id"),
        F.lit("HeartRate").alias("record_type"),
        F.format_string("2023-%02d-15 %05d", F.pmod(F.xxhash64("id"), F.lit(12)).cast("int") + 1, "id").alias("start_date"),
        *[F.lit("1").alias(c) for c in ("value", "unit", "creation_date", "job_id")],
        F.lit(1.0).alias("value_num"),
        *[F.lit(0).cast("long").alias(c) for c in ("_ingested", "_blk", "_pos")],
    )
    with_parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.upsert_records(rows, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_parts)
    stored = store.scan_table(spark, str(tmp_path), "records", versions=True)
    months = stored.groupBy(F.input_file_name().alias("f")).agg(
        F.countDistinct(F.substring("start_date", 1, 7)).alias("n")
    )
    counts = [r["n"] for r in months.collect()]
    assert len(counts) > 1 and sum(counts) <= 12 + len(counts)


def test_scratch_data_needs_a_shared_folder_on_a_cluster():
    from vitals.session import shared_dir

    class Conf:
        values = {}

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    class Context:
        def __init__(self, master):
            self.master = master

        def getConf(self):
            return Conf()

    class Session:
        def __init__(self, master):
            self.conf, self.sparkContext = Conf(), Context(master)

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            shared_dir(Session(master), "x")
    assert "/x-" in shared_dir(Session("local[2]"), "x")


def test_ordinals_broadcast_no_rows(spark, tmp_path):
    from vitals.operators.ecg import row_ordinal

    # long equal texts take little room in a file, and a lot once they are rows
    rows = spark.range(40).select(
        F.lit("u").alias("user_id"), F.lit("1").alias("job_id"),
        (F.col("id") % 4).cast("int").alias("member_ordinal"),
        F.floor(F.col("id") / 4).alias("row_in_file"), F.repeat(F.lit("x"), F.lit(100_000)).alias("classification"),
    )
    rows.write.parquet(str(tmp_path / "rows"))
    numbered = row_ordinal(spark.read.parquet(str(tmp_path / "rows")))
    found = numbered.orderBy("ordinal").select("ordinal", "member_ordinal", "row_in_file").collect()
    assert [tuple(r) for r in found] == [(10 * m + n, m, n) for m in range(4) for n in range(10)]
    numbered.write.format("noop").mode("overwrite").save()
    assert "Broadcast" not in plan(numbered)
