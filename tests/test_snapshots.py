"""Incremental snapshots against a dictionary of the newest rows."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vitals.schema import RECORDS, TABLES, column_names
from vitals.sources import snapshots, store

COLUMNS = column_names(RECORDS)
TYPES = ["HeartRate", "StepCount", "odd/type +%"]


def record(user, kind, start, value, ingested, job="1", pos=0):
    return (user, kind, start, str(value), "u", "c", job, float(value), ingested, 0, pos)


def put(spark, root, rows):
    store.upsert_records(spark.createDataFrame(rows, RECORDS), root)


def newest(batches):
    """The newest row of every key over all batches."""
    out = {}
    for row in (r for batch in batches for r in batch):
        key, order = row[:3], (row[8], row[6], row[9], row[10])
        if key not in out or order > out[key][0]:
            out[key] = order, row
    return sorted((row for _, row in out.values()), key=repr)


def read(spark, root, **options):
    return sorted((tuple(r) for r in store.scan_table(spark, root, "records", **options).collect()), key=repr)


def random_batch(r, number, months):
    # a later batch may hold versions older than those before it
    return [
        record(
            r.choice([None, "a", "b", "hot", "hot"]), r.choice(TYPES),
            r.choice([f"2024-{r.choice(months):02}-{r.randint(1, 3):02} 10", "2024-1", "", "x"]),
            r.randint(0, 99), r.choice([number, number, -number]), str(number), pos,
        )
        for pos in range(60)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_puts_and_compactions(spark, tmp_path, seed):
    r, root, batches = random.Random(seed), str(tmp_path), []
    for number, action in enumerate(["put", "compact", "put", "read", "put", "compact", "compact", "put", "compact", "read"], 1):
        if action == "put":
            batches.append(random_batch(r, number, r.sample(range(1, 13), 2)))
            put(spark, root, batches[-1])
        elif action == "compact":
            store.compact(spark, root, "records")
        expected = newest(batches)
        assert read(spark, root) == expected
        span = [x for x in expected if "2024-03-01" <= x[2] <= "2024-08-31~"]
        assert read(spark, root, start="2024-03-01", end="2024-08-31") == span
        assert read(spark, root, user_id="hot") == [x for x in expected if x[0] == "hot"]
    assert len(read(spark, root, versions=True)) == sum(map(len, batches))


def home(root):
    return store.snapshot_path(str(root), "records")


def files(spark, root):
    return {r["file"] for r in snapshots.state(spark, home(root)).files}


def test_only_touched_files_are_rewritten(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, [record("u", kind, f"2024-{m:02}-01", 1, 1) for kind in TYPES for m in range(1, 13)])
    store.compact(spark, root, "records")
    first = files(spark, root)
    store.compact(spark, root, "records")  # nothing newer
    assert files(spark, root) == first and snapshots.state(spark, home(root)).version == 1

    put(spark, root, [record("u", "HeartRate", "2024-05-01", 2, 2), record("v", "HeartRate", "2025-05-01", 2, 2)])
    store.compact(spark, root, "records")
    second = files(spark, root)
    gone = [f for f in first if f not in second]
    assert gone and all("record_type=HeartRate" in f for f in gone)
    assert all("record_type=HeartRate" in f for f in second - first)
    assert sum(r["n_rows"] for r in snapshots.state(spark, home(root)).files) == 37


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_over_the_snapshot(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, [record("u", "HeartRate", f"2024-01-{d:02}", d, 1) for d in range(1, 29)])
    assert "Window" in plan(store.scan_table(spark, root, "records"))
    store.compact(spark, root, "records")
    settled = plan(store.scan_table(spark, root, "records"))
    assert "Window" not in settled and "Exchange" not in settled

    put(spark, root, [record("u", "HeartRate", "2024-01-05", 99, 2)])
    df = store.scan_table(spark, root, "records")
    ranked = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = []
    for line in (i for i, text in enumerate(ranked) if "Window [" in text):
        depth = len(ranked[line]) - len(ranked[line].lstrip(" :+-"))
        for text in ranked[line + 1 :]:
            if len(text) - len(text.lstrip(" :+-")) <= depth:
                break
            below.append(text)
    # what is ranked comes from the appended batches alone
    assert [t for t in below if "Relation" in t] and all("_batch" in t for t in below if "Relation" in t)
    assert df.where("value = '99'").count() == 1 and df.count() == 28


def test_unfinished_writes_are_left_for_later(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, [record("u", "HeartRate", "2024-01-01", 1, 1)])
    store.compact(spark, root, "records")
    put(spark, root, [record("u", "HeartRate", "2024-01-01", 2, 2)])
    (batch,) = snapshots.newer_batches(spark, store.table_path(root, "records"), snapshots.state(spark, home(root)).batches)
    marker = Path(store.table_path(root, "records"), f"_batch={batch}", "_SUCCESS")
    marker.unlink()
    store.compact(spark, root, "records")
    assert [r[3] for r in read(spark, root)] == ["1"]
    marker.touch()
    assert [r[3] for r in read(spark, root)] == ["2"]
    # a manifest without its marker does not count
    unfinished = Path(home(root), "manifest", "version=2")
    unfinished.mkdir()
    assert snapshots.state(spark, home(root)).version == 1
    store.compact(spark, root, "records")
    assert [r[3] for r in read(spark, root)] == ["2"] and snapshots.state(spark, home(root)).version == 2


def test_tables_without_types(spark, tmp_path):
    schema = TABLES["jobs"][0]
    root = str(tmp_path)
    for at, status in [("1", "FAILED"), ("2", "COMPLETED")]:
        store.write_job_status(spark.createDataFrame([("u", "j", status, at, None), ("u", at, status, at, None)], schema), root)
        store.compact(spark, root, "jobs")
    got = store.scan_table(spark, root, "jobs").select("job_id", "status").collect()
    assert sorted(map(tuple, got)) == [("1", "FAILED"), ("2", "COMPLETED"), ("j", "COMPLETED")]
    assert store.scan_table(spark, root, "jobs").where(F.col("user_id") == "v").count() == 0
