"""The seven-day summary and the answers to requests."""

from datetime import date

from vitals.operators.timeline import timeline
from vitals.operators.users import latest_users, normalise_users
from vitals.plans.dashboard import answer_daily, answer_raw
from vitals.plans.summary import health_summary
from vitals.schema import ECG, JOBS, RECORDS, ROUTES, column_names


def fill(spark, schema, *given):
    names = column_names(schema)
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in given], schema)


def record(start, value, kind="HeartRate", user="a", **more):
    return dict(user_id=user, record_type=kind, start_date=start, value_num=value, **more)


def test_period_holds_eight_dates(spark):
    records = fill(spark, RECORDS, *(record(f"2024-01-{d:02d} 12:00", float(d)) for d in range(1, 10)))
    none = [fill(spark, schema) for schema in (ECG, ROUTES, JOBS)]
    row = health_summary(records, *none, as_of=date(2024, 1, 8)).first()
    assert (row["period_start"], row["period_end"]) == ("2024-01-01", "2024-01-08")
    assert row["heart_rate"].asDict() == dict(avg=4.5, min=1.0, max=8.0, count=8)


def test_absent_parts_are_null_zero_or_empty(spark):
    records = fill(spark, RECORDS, record("2024-01-05", None, "HeartRateVariabilitySDNN"))
    jobs = fill(spark, JOBS, dict(user_id="b", job_id="1", status="FAILED", updated_at="5"))
    none = [fill(spark, schema) for schema in (ECG, ROUTES)]
    found = {r["user_id"]: r for r in health_summary(records, *none, jobs, date(2024, 1, 8)).collect()}
    assert found["a"]["hrv"] is None and found["a"]["recent_jobs"] == []
    assert found["b"]["heart_rate"] is None and found["b"]["ecg_count"] == 0
    assert found["b"]["recent_jobs"][0]["status"] == "FAILED"


def test_everything_present(spark):
    records = fill(
        spark, RECORDS,
        record("2024-01-05", 60.0), record("2024-01-06", 70.0),
        record("2024-01-05", 120.0, "BloodPressureSystolic"),
        record("2024-01-05", 80.0, "BloodPressureDiastolic"),
        record("2024-01-05", 5.0, "StepCount"),
    )
    ecg = fill(spark, ECG, dict(user_id="a", ecg_time="2024-01-08 23:00"), dict(user_id="a", ecg_time=""))
    routes = fill(spark, ROUTES, dict(user_id="a", route_time="2024-01-01"))
    jobs = fill(spark, JOBS, *(
        dict(user_id="a", job_id=str(n), status="COMPLETED", updated_at=str(90 - n)) for n in range(1, 8)
    ))
    row = health_summary(records, ecg, routes, jobs, date(2024, 1, 8), "a").first()
    assert row["heart_rate"]["avg"] == 65.0
    assert row["blood_pressure"].asDict() == dict(avg=120.0, min=120.0, max=120.0, count=1)
    assert row["avg_diastolic"] == 80.0
    assert (row["ecg_count"], row["workout_count"]) == (1, 1)
    # the five highest ids, by last update
    assert [j["job_id"] for j in row["recent_jobs"]] == ["3", "4", "5", "6", "7"]


def ask(spark, *given):
    names = ["request_id", "user_id", "type", "start", "end", "granularity", "limit"]
    rows = [tuple({**dict(type="HeartRate", user_id="a"), **g}.get(n) for n in names) for g in given]
    return spark.createDataFrame(rows, ", ".join(f"{n} STRING" for n in names))


def test_daily_answers_over_a_new_year(spark, rows):
    records = fill(
        spark, RECORDS,
        record("2023-12-30 10", None, unit="first"), record("2023-12-31 10", 1.0, unit="x"),
        record("2024-01-01 10", 3.0, unit="y"), record("2024-01-01 11", 4.0, unit="y"),
        record("2024-01-02 10", 9.0), record("2024-01-01", 5.0, user="b"),
    )
    requests = ask(
        spark,
        dict(request_id="r", start="2023-12-30", end="2024-01-01"),
        dict(request_id="bad", start="2023-01-01", end="2024-01-01"),
        dict(request_id="one", start="2024-01-02", end="2024-01-02"),
    )
    found = rows(answer_daily(requests, records), "request_id", "date", "avg", "count", "unit")
    assert found == [
        ("one", "2024-01-02", 9.0, 1, None),
        ("r", "2023-12-31", 1.0, 1, "first"),
        ("r", "2024-01-01", 3.5, 2, "first"),
    ]


def test_raw_answers_stop_at_each_requests_limit(spark):
    records = fill(spark, RECORDS, *(
        record(f"2024-01-{d:02d} {h:02d}", float(h)) for d in (1, 2, 3) for h in range(10)
    ))
    requests = ask(
        spark,
        dict(request_id="all", start="2024-01-01", end="2024-01-31", granularity="raw"),
        dict(request_id="few", start="2024-01-02", end="2024-01-31", granularity="raw", limit="12"),
        dict(request_id="daily", start="2024-01-02", end="2024-01-31"),
    )
    found = answer_raw(requests, records).orderBy("request_id", "position").collect()
    starts = lambda name: [r["start_date"] for r in found if r["request_id"] == name]
    assert len(starts("all")) == 30 and starts("all") == sorted(starts("all"))
    assert starts("few") == [f"2024-01-02 {h:02d}" for h in range(10)] + ["2024-01-03 00", "2024-01-03 01"]
    assert starts("daily") == []


def test_timeline_keys(spark, rows):
    merged = timeline(
        fill(spark, RECORDS, record("2024-01-01", 1.0)),
        fill(spark, ECG, dict(user_id="a", ecg_time="2024-01-02", ordinal=3)),
        fill(spark, ROUTES, dict(user_id="a", route_time="2024-01-03", ordinal=0)),
        fill(spark, JOBS, dict(user_id="a", job_id="17")),
    )
    assert rows(merged, "sk", "type_time_key") == [
        ("JOB#17", "JOB#17"),
        ("RECORD#ECG#2024-01-02#3", "ECG#2024-01-02"),
        ("RECORD#GPX#2024-01-03#0", "GPX#2024-01-03"),
        ("RECORD#HeartRate#2024-01-01", "HeartRate#2024-01-01"),
    ]


def test_users(spark):
    attributes = "STRUCT<email: STRING, email_verified: STRING, given_name: STRING, family_name: STRING, name: STRING>"
    signups = spark.createDataFrame(
        [("u", ("u@example.com", "true", "U", None, None)), ("v", (None, None, None, None, "V")), (None, None)],
        f"user_name STRING, attributes {attributes}",
    )
    found = {r["id"]: r for r in latest_users(normalise_users(signups)).collect()}
    assert set(found) == {"u", "v"}
    assert found["u"]["email_verified"] is True and found["v"]["email_verified"] is False
    assert found["u"]["status"] == "active"
    assert found["u"]["profile"].asDict() == dict(given_name="U", family_name=None, name=None)


def test_raw_answers_follow_cursors_to_the_end(spark):
    days = [1] * 7 + [2] * 2 + [4] * 5 + [6]
    starts = [f"2024-01-0{d} 10:00:{i:02d}" for i, d in enumerate(days)]
    records = spark.createDataFrame(
        [("u", "HeartRate", s, str(i)) for i, s in enumerate(starts)] + [("v", "HeartRate", starts[0], "x")],
        "user_id STRING, record_type STRING, start_date STRING, value STRING",
    )
    kind = "request_id LONG, user_id STRING, type STRING, start STRING, `end` STRING, granularity STRING, `limit` STRING, cursor STRING"
    for limit in (3, 5):
        seen, cursor = [], ""
        while cursor is not None:
            asked = spark.createDataFrame(
                [(1, "u", "HeartRate", "2024-01-01", "2024-01-05", "raw", str(limit), cursor),
                 (2, "v", "HeartRate", "2024-01-01", "2024-01-05", "raw", str(limit), None)], kind,
            )
            found = answer_raw(asked, records).orderBy("request_id", "position").collect()
            page = [r for r in found if r["request_id"] == 1]
            assert [r["position"] for r in page] == list(range(1, len(page) + 1)) and len(page) <= limit
            assert {(r["value"], r["next_cursor"]) for r in found if r["request_id"] == 2} == {("x", None)}
            assert all(r["count"] == len(page) for r in page)
            seen += [r["start_date"] for r in page]
            cursor = page[0]["next_cursor"] if page else None
        assert seen == starts[:-1]


def test_daily_answers_ignore_cursors(spark):
    records = spark.createDataFrame(
        [("u", "HeartRate", "2024-01-01 10", 1.0, "x")],
        "user_id STRING, record_type STRING, start_date STRING, value_num DOUBLE, unit STRING",
    )
    asked = spark.createDataFrame(
        [(1, "u", "HeartRate", "2024-01-01", "2024-01-05", "daily", None, "anything")],
        "request_id LONG, user_id STRING, type STRING, start STRING, `end` STRING, granularity STRING, `limit` STRING, cursor STRING",
    )
    assert answer_daily(asked, records).count() == 1


def test_ecg_answers_follow_cursors_among_equal_times(spark):
    from vitals.plans.dashboard import answer_ecg

    ecg = spark.createDataFrame(
        [("u", "2024-01-01 10", i // 2, f"f{i % 2}", i) for i in range(5)],
        "user_id STRING, ecg_time STRING, ordinal LONG, source_file STRING, row_in_file LONG",
    )
    seen, cursor = [], None
    for _ in range(3):
        asked = spark.createDataFrame(
            [(1, "u", "2024-01-01", "2024-01-05", "2", cursor)],
            "request_id LONG, user_id STRING, start STRING, `end` STRING, `limit` STRING, cursor STRING",
        )
        page = answer_ecg(asked, ecg).orderBy("position").collect()
        seen += [r["row_in_file"] for r in page]
        cursor = page[0]["next_cursor"]
    assert seen == [0, 1, 2, 3, 4] and cursor is None
