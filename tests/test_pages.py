"""Ordered pages, cursors, newest versions and job history."""

import json
import random
from base64 import urlsafe_b64decode

import pytest
from pyspark.sql import functions as F

from vitals.functions.cursor import decode_cursor, encode_cursor, read_cursor
from vitals.operators.jobs import job_status, recent_jobs
from vitals.operators.latest import dedupe_last, latest_by_key, top_per_group
from vitals.operators.pages import (
    ecg_page,
    metric_page,
    next_cursor,
    order_by_start,
    workout_page,
)

RECORDS = "user_id STRING, record_type STRING, start_date STRING, _pos LONG"
ORDER = ["start_date", "_pos"]


@pytest.fixture(scope="module")
def tied(spark):
    """Two users with many rows at few, repeated times."""
    generator = random.Random(5)
    data = [
        (user, "HeartRate", f"2024-01-{generator.randint(1, 9):02d}", position)
        for user, size in [("a", 53), ("b", 20)]
        for position in range(size)
    ]
    generator.shuffle(data)
    return spark.createDataFrame(data, RECORDS).repartition(5).cache()


def ask(records, limit, cursor=None, user_id=None):
    return metric_page(
        records, "HeartRate", "2024-01-01", "2024-01-31", limit, cursor, user_id,
        tiebreak=["_pos"],
    )


def test_pages_of_one_user_cover_everything_once_in_order(tied):
    found, cursor = [], None
    for _ in range(9):
        page = ask(tied, 7, cursor, "a")
        found += [
            (r["start_date"], r["_pos"]) for r in page.orderBy("position").collect()
        ]
        (row,) = next_cursor(page, ORDER).collect() or [None]
        cursor = row and row["next_cursor"]
        if cursor is None:
            break
    everything = tied.where("user_id = 'a'").select(*ORDER).collect()
    assert found == sorted(tuple(row) for row in everything)


def test_pages_of_all_users_end_by_themselves(tied):
    found, cursors = set(), None
    for _ in range(20):
        page = ask(tied, 7, cursors)
        rows = page.collect()
        if not rows:
            break
        assert not found & {(r["user_id"], r["_pos"]) for r in rows}
        found |= {(r["user_id"], r["_pos"]) for r in rows}
        last = [(r["user_id"], r["next_cursor"]) for r in next_cursor(page, ORDER).collect()]
        if cursors is not None:
            named = {user for user, _ in last}
            last += [(r["user_id"], None) for r in cursors.collect() if r["user_id"] not in named]
        cursors = tied.sparkSession.createDataFrame(last, "user_id STRING, cursor STRING")
    assert not rows and len(found) == 73


def test_null_empty_and_absent_cursors(spark, tied):
    users = sorted({r["user_id"] for r in tied.select("user_id").distinct().collect()})
    first = ask(tied, 7)
    kept = {u: {r["_pos"] for r in first.collect() if r["user_id"] == u} for u in users}
    cursors = spark.createDataFrame([(users[0], None), (users[1], "")], "user_id STRING, cursor STRING")
    again = ask(tied, 7, cursors).collect()
    assert {u: {r["_pos"] for r in again if r["user_id"] == u} for u in users} == kept | {users[0]: set()}


def test_limit_is_clamped_and_checked(spark, tied):
    many = spark.range(1100).select(
        F.lit("a").alias("user_id"), F.lit("HeartRate").alias("record_type"),
        F.lit("2024-01-02").alias("start_date"), F.col("id").alias("_pos"),
    )
    assert ask(many, None).count() == 100
    full = ask(many, 5000)
    assert full.count() == 1000
    assert full.select("page_count").distinct().first()[0] == 1000
    with pytest.raises(ValueError):
        ask(tied, 0)


def test_large_pages_agree_with_a_plain_sort(spark):
    """The two cuts of a large page give what one sort gives."""
    df = spark.range(0, 5000, 1, 40).select(
        (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("group"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(900)).alias("time"),
        "id",
    )
    top = top_per_group(df, ["group"], [F.col("time"), F.col("id")], 300)
    found = {(r["group"], r["position"]): (r["time"], r["id"]) for r in top.collect()}
    rows = sorted((r["group"], r["time"], r["id"]) for r in df.collect())
    for group in (True, False):
        expected = [row[1:] for row in rows if row[0] is group][:300]
        assert [found[group, n] for n in range(1, 301)] == expected


def test_cursor_round_trip(spark):
    key = F.struct(F.lit("2024-01-15 ü?>").alias("start_date"), F.lit(7).alias("_pos"))
    text = spark.range(1).select(encode_cursor(key).alias("c")).first()["c"]
    assert "+" not in text and "/" not in text and "\n" not in text
    assert json.loads(urlsafe_b64decode(text)) == {"start_date": "2024-01-15 ü?>", "_pos": 7}
    assert read_cursor(text, ORDER) == ("2024-01-15 ü?>", 7)
    decoded = decode_cursor(F.lit(text), "start_date STRING, _pos INT")
    assert tuple(spark.range(1).select(decoded.alias("d")).first()["d"]) == (
        "2024-01-15 ü?>", 7,
    )


def test_long_cursor_has_no_line_breaks(spark):
    key = F.struct(F.repeat(F.lit("x"), 300).alias("start_date"))
    text = spark.range(1).select(encode_cursor(key).alias("c")).first()["c"]
    assert len(text) > 400 and text.strip() == text and "\r" not in text


def test_bad_cursors(spark, tied):
    for bad in ["not-valid-base64!!!", "bm90IGpzb24=", "WzFd"]:
        with pytest.raises(ValueError):
            read_cursor(bad, ORDER)
        cursors = spark.createDataFrame([("a", bad)], "user_id STRING, cursor STRING")
        with pytest.raises(Exception, match="Invalid cursor"):
            ask(tied, 7, cursors).collect()
    assert read_cursor("", ORDER) is None and read_cursor(None, ORDER) is None


def test_order_by_start_falls_back_to_the_key(spark):
    df = spark.createDataFrame(
        [("a", None, "2024-01-02"), ("a", "2024-01-03", "x"), ("a", "2024-01-01", "y")],
        "user_id STRING, start_date STRING, sk STRING",
    )
    assert [r["sk"] for r in order_by_start(df, "sk").collect()] == ["y", "2024-01-02", "x"]


def test_ecg_and_workout_pages(spark):
    data = [("a", f"2024-01-{d:02d} 10", 0, "f", 0) for d in range(1, 10)]
    columns = "user_id STRING, {} STRING, ordinal LONG, source_file STRING, row_in_file LONG"
    ecg = spark.createDataFrame(data + [("a", "", 9, "f", 9)], columns.format("ecg_time"))
    found = ecg_page(ecg, "2024-01-02", "2024-01-08", 3).orderBy("position").collect()
    assert [r["ecg_time"][:10] for r in found] == ["2024-01-02", "2024-01-03", "2024-01-04"]
    routes = spark.createDataFrame(data, columns.format("route_time"))
    assert workout_page(routes, "2024-01-08", "2024-01-08").count() == 1
    assert workout_page(routes, "2025-01-01", "2025-01-31").count() == 0


def test_latest_by_key(spark, rows):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", None, "w")],
        "k STRING, at INT, v STRING",
    )
    assert rows(latest_by_key(df, ["k"], ["at"]), "k", "v") == [("a", "y"), ("b", "w")]


def test_dedupe_keeps_the_last_in_file_order(spark, rows):
    df = spark.createDataFrame(
        [
            ("u", "HeartRate", "t", "1", 0, 5, "first"),
            ("u", "HeartRate", "t", "1", 128, 2, "later block"),
            ("u", "HeartRate", "t", "1", 128, 1, "earlier in block"),
            ("u", "StepCount", "t", "1", 0, 1, "other type"),
        ],
        "user_id STRING, record_type STRING, start_date STRING, job_id STRING, "
        "_blk LONG, _pos LONG, value STRING",
    )
    assert rows(dedupe_last(df), "value") == [("later block",), ("other type",)]


def test_recent_jobs_picks_by_id_and_lists_by_update(spark):
    data = [("u", f"{n:03d}", "COMPLETED", str(1000 - n)) for n in range(30)]
    jobs = spark.createDataFrame(
        data, "user_id STRING, job_id STRING, status STRING, updated_at STRING"
    )
    found = [r["job_id"] for r in recent_jobs(jobs, 5).collect()]
    # ids 25 to 29 are the highest; 25 was updated last, though "975" > "971"
    assert found == ["025", "026", "027", "028", "029"]
    assert recent_jobs(jobs).count() == 20


def test_job_status(spark, rows):
    checked = spark.createDataFrame(
        [("u", "1", True, None), ("u", "2", False, "ValidateFile")],
        "user_id STRING, job_id STRING, valid BOOLEAN, error_step STRING",
    )
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    assert rows(job_status(checked, at)) == [
        ("u", "1", "COMPLETED", "1700000000", None),
        ("u", "2", "FAILED", "1700000000", "ValidateFile"),
    ]
