"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity import adapter
from parity.archives import render_archives, render_faulty
from vitals.functions.cursor import decode_cursor, encode_cursor
from vitals.functions.text import parse_number
from vitals.operators import filters, latest, metrics, pages
from vitals.operators.ecg import row_ordinal
from vitals.operators.jobs import abandoned, job_lifecycle, job_status, recent_jobs
from vitals.operators.records import map_record_type, project_record
from vitals.operators.requests import check_requests
from vitals.operators.timeline import timeline
from vitals.operators.users import normalise_users
from vitals.plans import ingest
from vitals.plans.dashboard import answer_daily, answer_ecg, answer_raw, answer_workouts
from vitals.plans.summary import SUMMARY_METRICS, health_summary, health_summary_stored
from vitals.session import shared_dir
from vitals.sources import archive, arrivals, store
from vitals.sources.ecg_csv import scan_ecg_csv
from vitals.sources.gpx import scan_gpx_routes
from vitals.streaming.ingest import ingest_stream

START, END = "2024-01-03", "2024-01-24"
PAGE = 7
AS_OF = date(2024, 1, 20)
AT = datetime(2024, 2, 1)

Query = Callable[[SparkSession, str], DataFrame]
_landed: dict[tuple[str, str], tuple[str, str]] = {}
_stored: dict[tuple[str, str], str] = {}
_asked: dict[tuple[str, str], str] = {}


def _at():
    return F.lit(AT).cast("timestamp")


def landed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Store and staging folder of the landed archives; once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _landed:
        root = render_archives(spark, sf_dir)
        tables, staging = shared_dir(spark, "store"), shared_dir(spark, "staging")
        ingest_stream(
            spark, root, tables, staging, shared_dir(spark, "landing")
        ).awaitTermination()
        _landed[key] = tables, staging
    return _landed[key]


def stored(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the tables with the landed archives normalised."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        tables, staging = landed(spark, sf_dir)
        ingest.normalise(spark, tables, staging, AT)
        _stored[key] = tables
    return _stored[key]


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, staging = landed(spark, sf_dir)
    return ingest.read_manifest(spark, tables, staging)


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals.export_arrivals(spark, render_archives(spark, sf_dir))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrivals.parse_export_key(
        _arrivals(spark, sf_dir), render_archives(spark, sf_dir)
    )


# --- statistics -------------------------------------------------------------


def metric_daily(spark, sf_dir):
    return metrics.metric_daily(adapter.records(spark, sf_dir))


def metric_daily_fine(spark, sf_dir):
    """Values of up to twelve decimals and more, each the same double in any engine."""
    fine = adapter.records(spark, sf_dir).withColumn("value_num", F.col("value_num") / 1024)
    return metrics.metric_daily(fine)


def metric_daily_range(spark, sf_dir):
    return metrics.metric_daily(
        adapter.records(spark, sf_dir), ["HeartRate"], START, END, ordered=True
    )


def metric_summary(spark, sf_dir):
    return metrics.metric_summary(adapter.records(spark, sf_dir), None, START, END)


def first_unit(spark, sf_dir):
    return metrics.first_unit(adapter.records(spark, sf_dir), None, START, END)


def count_in_range(spark, sf_dir):
    counts = [
        metrics.count_in_range(adapter.ecg(spark, sf_dir), "ecg_time", START, END)
        .withColumn("family", F.lit("ECG")),
        metrics.count_in_range(adapter.routes(spark, sf_dir), "route_time", START, END)
        .withColumn("family", F.lit("GPX")),
    ]
    return counts[0].unionByName(counts[1])


def summary(spark, sf_dir):
    rows = health_summary(
        adapter.records(spark, sf_dir),
        adapter.ecg(spark, sf_dir),
        adapter.routes(spark, sf_dir),
        adapter.jobs(spark, sf_dir),
        AS_OF,
    )
    fields = [
        F.col(f"{field}.{part}").alias(f"{field}_{part}")
        for field in SUMMARY_METRICS
        for part in ["avg", "min", "max", "count"]
    ]
    job = lambda j: F.concat_ws(":", j["job_id"], j["status"])
    return rows.select(
        "user_id",
        "period_start",
        "period_end",
        *fields,
        "ecg_count",
        "workout_count",
        F.array_join(F.transform("recent_jobs", job), ",").alias("recent_jobs"),
    )


# --- records ----------------------------------------------------------------


def map_type(spark, sf_dir):
    return map_record_type(adapter.scan(spark, sf_dir)).select(
        "user_id", "record_type", "start_date", "value"
    )


def project(spark, sf_dir):
    return project_record(map_record_type(adapter.scan(spark, sf_dir))).drop("_blk")


def _hourly(spark, sf_dir):
    """Records whose start is cut to the hour, so that keys repeat."""
    return adapter.records(spark, sf_dir).withColumn(
        "start_date", F.substring("start_date", 1, 13)
    )


def dedupe_last(spark, sf_dir):
    return latest.dedupe_last(_hourly(spark, sf_dir)).select(
        "user_id", "record_type", "start_date", "value", "job_id"
    )


def counts(spark, sf_dir):
    tables, staging = landed(spark, sf_dir)
    return ingest.run_counts(spark, tables, staging, AT)


def timeline_(spark, sf_dir):
    return timeline(
        adapter.records(spark, sf_dir),
        adapter.ecg(spark, sf_dir),
        adapter.routes(spark, sf_dir),
        adapter.jobs(spark, sf_dir),
    ).select("user_id", "sk", "type_time_key", "value", "status", "waypoint_count")


def numbers(spark, sf_dir):
    """Values written in several ways, some of which are no numbers."""
    value = F.col("value").cast("string")
    ways = [
        value,
        F.concat(F.lit(" +"), value, F.lit("\n")),
        F.concat(F.lit("1_0"), value),
        F.concat(value, F.lit("e1")),
        F.concat(value, F.lit("d")),
        F.lit("NaN"),
        F.lit("-Infinity"),
        F.lit(""),
    ]
    way = F.element_at(F.array(*ways), (F.col("event_id") % 8 + 1).cast("int"))
    events = adapter.table(spark, sf_dir, "events")
    return events.select("event_id", parse_number(way).alias("number"))


# --- filters ----------------------------------------------------------------


def user_scope(spark, sf_dir):
    return filters.user_scope(adapter.records(spark, sf_dir), "42").select(
        "user_id", "record_type", "start_date", "value"
    )


def date_range(spark, sf_dir):
    rows = filters.date_range(adapter.records(spark, sf_dir), "start_date", START, END)
    return filters.type_filter(rows, "HeartRate").select("user_id", "start_date")


def type_filter(spark, sf_dir):
    rows = filters.type_filter(adapter.records(spark, sf_dir), "HeartRate", "StepCount")
    return rows.select("user_id", "record_type", "start_date")


def key_prefix(spark, sf_dir):
    return filters.key_prefix(timeline_(spark, sf_dir), "sk", "JOB#").select(
        "user_id", "sk", "status"
    )


# --- pages ------------------------------------------------------------------


def _raw_page(spark, sf_dir, limit=None, cursor=None):
    return pages.metric_page(
        adapter.records(spark, sf_dir),
        "HeartRate",
        START,
        END,
        limit,
        cursor,
        tiebreak=["_pos"],
    )


def _page_columns(rows):
    return rows.select("user_id", "start_date", "value", "position", "page_count")


def order_by_start(spark, sf_dir):
    rows = adapter.records(spark, sf_dir).select("user_id", "start_date", "value")
    return pages.order_by_start(rows)


def metric_page(spark, sf_dir):
    return _page_columns(_raw_page(spark, sf_dir))


def metric_page_next(spark, sf_dir):
    first = _raw_page(spark, sf_dir, PAGE)
    cursors = pages.next_cursor(first, ["start_date", "_pos"]).select(
        "user_id", F.col("next_cursor").alias("cursor")
    )
    return _page_columns(_raw_page(spark, sf_dir, PAGE, cursors))


def page_count(spark, sf_dir):
    return (
        pages.page_count(_raw_page(spark, sf_dir, PAGE).drop("page_count"))
        .select("user_id", "page_count")
        .distinct()
    )


def cursor_keys(spark, sf_dir):
    """Every record's own cursor, read back."""
    key = F.struct("start_date", "_pos")
    cursors = adapter.records(spark, sf_dir).select(
        "user_id", encode_cursor(key).alias("cursor")
    )
    decoded = decode_cursor(F.col("cursor"), "start_date STRING, _pos LONG")
    return cursors.select("user_id", decoded.alias("key")).select("user_id", "key.*")


def next_cursor(spark, sf_dir):
    return pages.next_cursor(_raw_page(spark, sf_dir, PAGE), ["start_date", "_pos"])


def ecg_page(spark, sf_dir):
    return pages.ecg_page(adapter.ecg(spark, sf_dir), START, END, 5).select(
        "user_id", "ecg_time", "classification", "position", "page_count"
    )


def _second_page(page, rows, order):
    """The page after the first one of five rows."""
    cursors = pages.next_cursor(page(rows, START, END, 5), order)
    return page(rows, START, END, 5, cursors.withColumnRenamed("next_cursor", "cursor"))


def ecg_page_next(spark, sf_dir):
    rows = _second_page(pages.ecg_page, adapter.ecg(spark, sf_dir), pages.ECG_ORDER)
    return rows.select("user_id", "ecg_time", "classification", "position", "page_count")


def workout_page_next(spark, sf_dir):
    rows = _second_page(pages.workout_page, adapter.routes(spark, sf_dir), pages.ROUTE_ORDER)
    return rows.select("user_id", "route_time", "waypoint_count", "position", "page_count")


def workout_page(spark, sf_dir):
    return pages.workout_page(adapter.routes(spark, sf_dir), START, END, 5).select(
        "user_id", "route_time", "waypoint_count", "start_lat", "start_lon",
        "end_lat", "end_lon", "position", "page_count",
    )


# --- jobs, users, requests ---------------------------------------------------


def recent(spark, sf_dir):
    return recent_jobs(adapter.jobs(spark, sf_dir)).drop("error_step")


def latest_by_key(spark, sf_dir):
    jobs = adapter.jobs(spark, sf_dir)
    return latest.latest_by_key(jobs, ["user_id"], ["updated_at", "job_id"]).drop(
        "error_step"
    )


def users(spark, sf_dir):
    rows = normalise_users(adapter.signups(spark, sf_dir), _at())
    names = [F.col(f"profile.{name}").alias(name) for name in ["given_name", "family_name", "name"]]
    return rows.select("*", *names).drop("profile")


def upsert_users(spark, sf_dir):
    """Two rounds of sign-ups, read back as the newest row per user."""
    signups = adapter.signups(spark, sf_dir)
    root = shared_dir(spark, "users")
    before = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    store.upsert_users(normalise_users(signups, before), root)
    again = signups.where(F.col("attributes.email_verified") == "true")
    store.upsert_users(normalise_users(again, _at()), root)
    return store.scan_table(spark, root, "users").select(
        "id", "email", "email_verified", "updated_at", "status"
    )


def requests(spark, sf_dir):
    return check_requests(adapter.requests(spark, sf_dir)).select(
        "request_id", "granularity", "limit", "error_code"
    )


def _requests(spark, sf_dir):
    """The requests as a written table, as they would be given."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _asked:
        _asked[key] = shared_dir(spark, "requests")
        adapter.requests(spark, sf_dir).write.parquet(_asked[key])
    return spark.read.parquet(_asked[key])


def daily_answers(spark, sf_dir):
    return answer_daily(_requests(spark, sf_dir), adapter.records(spark, sf_dir))


def raw_answers(spark, sf_dir):
    return answer_raw(
        _requests(spark, sf_dir), adapter.records(spark, sf_dir), ("_pos",)
    ).select("request_id", "user_id", "record_type", "start_date", "value", "position")


def _following(spark, sf_dir, kind, answers):
    """The requests whose first page is full, with the cursor it gave, as a written table."""
    key = (spark.sparkContext.applicationId, f"{kind} {sf_dir}")
    if key not in _asked:
        cursors = answers.where("next_cursor is not null").selectExpr("request_id", "next_cursor cursor")
        path = shared_dir(spark, "requests")
        _requests(spark, sf_dir).drop("cursor").join(cursors.distinct(), "request_id").write.parquet(path)
        _asked[key] = path
    return spark.read.parquet(_asked[key])


def raw_answers_next(spark, sf_dir):
    """The second page of every raw request."""
    records = adapter.records(spark, sf_dir)
    first = answer_raw(_requests(spark, sf_dir), records, ("_pos",))
    return answer_raw(_following(spark, sf_dir, "raw", first), records, ("_pos",)).select(
        "request_id", "user_id", "record_type", "start_date", "value", "position"
    )


def ecg_answers_next(spark, sf_dir):
    """The second page of every ECG request."""
    rows = adapter.ecg(spark, sf_dir)
    first = answer_ecg(_requests(spark, sf_dir), rows)
    return answer_ecg(_following(spark, sf_dir, "ecg", first), rows).select(
        "request_id", "user_id", "ecg_time", "classification", "position"
    )


def requests_ecg(spark, sf_dir):
    return check_requests(adapter.requests(spark, sf_dir), "ecg").select(
        "request_id", "limit", "error_code"
    )


def ecg_answers(spark, sf_dir):
    return answer_ecg(_requests(spark, sf_dir), adapter.ecg(spark, sf_dir)).select(
        "request_id", "user_id", "ecg_time", "classification", "position"
    )


def workout_answers(spark, sf_dir):
    rows = answer_workouts(_requests(spark, sf_dir), adapter.routes(spark, sf_dir))
    return rows.select("request_id", "user_id", "route_time", "waypoint_count", "position")


# --- archives ---------------------------------------------------------------


def export_arrivals(spark, sf_dir):
    name = F.regexp_extract("path", "exports/([^/]+/[^/]+)$", 1)
    return _arrivals(spark, sf_dir).select(
        name.alias("name"), (F.col("length") > 0).alias("filled")
    )


def export_key(spark, sf_dir):
    good, rejects = arrivals.split_export_keys(
        _arrivals(spark, sf_dir), render_archives(spark, sf_dir)
    )
    return (
        good.withColumn("reason", F.lit(None).cast("string"))
        .unionByName(rejects)
        .select("user_id", "job_id", "reason")
    )


def list_members(spark, sf_dir):
    return archive.list_members(_keyed(spark, sf_dir)).select(
        "user_id", "job_id", "member", "member_ordinal", "kind", "reason"
    )


def export_manifest(spark, sf_dir):
    return archive.export_manifest(_keyed(spark, sf_dir)).select(
        "user_id", "job_id", "member", "member_ordinal", "kind"
    )


def validate_exports(spark, sf_dir):
    members = archive.list_members(_keyed(spark, sf_dir))
    return archive.validate_exports(members).select(
        "user_id", "job_id", "file_count", "valid", "reason"
    )


def export_xml(spark, sf_dir):
    return archive.pick_export_xml(_manifest(spark, sf_dir))


def unpack_members(spark, sf_dir):
    staging = shared_dir(spark, "unpacked")
    members = archive.list_members(_keyed(spark, sf_dir))
    unpacked = archive.unpack_members(members, staging)
    name = F.regexp_extract("staged_path", r"kind=.*$", 0)
    return unpacked.where(F.col("kind").isNotNull()).select(
        "user_id",
        "job_id",
        "member",
        name.alias("staged"),
        (F.length("content") == F.col("member_size")).alias("whole"),
    )


def stream(spark, sf_dir):
    return _manifest(spark, sf_dir).select(
        "user_id", "job_id", "member", "kind", "reason"
    )


def scan_xml(spark, sf_dir):
    _, staging = landed(spark, sf_dir)
    scan = ingest.staged_scan(spark, staging, _manifest(spark, sf_dir))
    return scan.drop("_file", "_blk", "_pos")


def ecg_scan(spark, sf_dir):
    members = ingest.members_of(_manifest(spark, sf_dir), "ecg")
    return scan_ecg_csv(members).drop("member_ordinal")


def gpx_scan(spark, sf_dir):
    points = F.transform(
        "waypoints", lambda p: F.concat_ws("|", p["lat"], p["lon"], p["ele"], p["time"])
    )
    members = ingest.members_of(_manifest(spark, sf_dir), "gpx")
    return scan_gpx_routes(members).select(
        "user_id", "job_id", F.array_join(points, ";").alias("waypoints")
    )


def ecg_rows(spark, sf_dir):
    rows = ingest.staged_ecg(_manifest(spark, sf_dir), _at())
    return rows.drop("_ingested")


def ordinals(spark, sf_dir):
    """ECG lines numbered over the files of each export."""
    scan = scan_ecg_csv(ingest.members_of(_manifest(spark, sf_dir), "ecg"))
    return row_ordinal(scan).select("user_id", "job_id", "ecg_time", "ordinal")


def route_rows(spark, sf_dir):
    tables, staging = landed(spark, sf_dir)
    rows = ingest.staged_routes(
        spark, staging, ingest.read_manifest(spark, tables, staging), _at()
    )
    return rows.drop("_ingested", "row_in_file")


# --- tables -----------------------------------------------------------------


def table_records(spark, sf_dir):
    rows = store.scan_table(spark, stored(spark, sf_dir), "records")
    return rows.drop("_ingested", "_blk", "_pos")


def summary_stored(spark, sf_dir):
    """The summary's statistics from the stored tables."""
    rows = health_summary_stored(spark, stored(spark, sf_dir), AS_OF)
    fields = [
        F.col(f"{field}.{part}").alias(f"{field}_{part}")
        for field in SUMMARY_METRICS
        for part in ["avg", "min", "max", "count"]
    ]
    return rows.select("user_id", *fields, "ecg_count")


def pending(spark, sf_dir):
    """Landed exports without a job row, after the jobs of two thirds were written."""
    manifest = _manifest(spark, sf_dir)
    done = job_status(archive.validate_exports(manifest), _at()).where("job_id <> '1'")
    return ingest.pending_exports(manifest, done)


def _faulty(spark, sf_dir):
    """Store and staging folder of the faulty archives, landed and normalised once."""
    key = (spark.sparkContext.applicationId, f"faulty {sf_dir}")
    if key not in _landed:
        root = render_faulty(spark, sf_dir)
        tables, staging = shared_dir(spark, "store"), shared_dir(spark, "staging")
        ingest_stream(spark, root, tables, staging, shared_dir(spark, "landing")).awaitTermination()
        ingest.normalise(spark, tables, staging, AT)
        _landed[key] = tables, staging
    return _landed[key]


def faulty_exports(spark, sf_dir):
    """What is wrong with each of the faulty archives."""
    manifest = ingest.read_manifest(spark, *_faulty(spark, sf_dir))
    return archive.validate_exports(manifest).drop("path", "length")


def faulty_jobs(spark, sf_dir):
    """How the ingestion of the faulty archives ended."""
    return store.scan_table(spark, _faulty(spark, sf_dir)[0], "jobs")


def lifecycle(spark, sf_dir):
    """States of the faulty archives, and what ends them, as if the runs of three users in seven broke off.

    Of the first such users no run began, of the others it broke off in the
    first step, or before its end.
    """
    tables, staging = _faulty(spark, sf_dir)
    landed = ingest.read_manifest(spark, tables, staging)
    group = F.col("user_id").cast("long") % 7
    states = store.scan_table(spark, tables, "job_states").where(
        (group > 1) | (group == 1) & (F.col("status") == "VALIDATING")
    )
    jobs = store.scan_table(spark, tables, "jobs").where(group > 2)
    now = job_lifecycle(landed, states, jobs)
    later = F.lit(datetime(2024, 2, 3)).cast("timestamp")
    after = job_lifecycle(landed, states, jobs.unionByName(abandoned(now, later, later)))
    ends = after.select(
        "user_id", "job_id", F.col("status").alias("end"), F.col("error_step").alias("end_step")
    )
    return now.withColumn("states", F.array_join("states", ",")).join(ends, ["user_id", "job_id"])


def faulty_counts(spark, sf_dir):
    """What the faulty archives held and what became of it."""
    return ingest.run_counts(spark, *_faulty(spark, sf_dir), _at())


def faulty_rows(spark, sf_dir):
    """What is stored of the faulty archives."""
    tables, _ = _faulty(spark, sf_dir)
    count = F.count("*").alias("rows")
    parts = [
        store.scan_table(spark, tables, family)
        .groupBy("user_id", F.lit(family).alias("family"))
        .agg(count)
        for family in ["records", "ecg", "routes"]
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def faulty_rejects(spark, sf_dir):
    """Members and lines of the faulty archives that could not be read, and why."""
    return store.scan_table(spark, _faulty(spark, sf_dir)[0], "rejects").drop("_ingested")


def table_ecg(spark, sf_dir):
    return store.scan_table(spark, stored(spark, sf_dir), "ecg").drop("_ingested")


def table_routes(spark, sf_dir):
    rows = store.scan_table(spark, stored(spark, sf_dir), "routes")
    return rows.drop("_ingested", "row_in_file")


def table_jobs(spark, sf_dir):
    return store.scan_table(spark, stored(spark, sf_dir), "jobs")


def upsert_records(spark, sf_dir):
    """Hourly records of each job put after one another; the last job wins."""
    root = shared_dir(spark, "records")
    rows = latest.dedupe_last(_hourly(spark, sf_dir))
    store.upsert_records(rows, root)
    store.upsert_records(
        rows.withColumns({"_ingested": F.lit(1).cast("long"), "unit": F.lit("v")})
        .where("record_type = 'HeartRate'"),
        root,
    )
    return store.scan_table(spark, root, "records").select(
        "user_id", "record_type", "start_date", "value", "unit", "job_id"
    )


def compacted_daily(spark, sf_dir):
    """Daily statistics of the stored records, from a compacted snapshot."""
    root = stored(spark, sf_dir)
    store.compact(spark, root, "records")
    return metrics.metric_daily(store.scan_table(spark, root, "records"))


def _put_twice(spark, sf_dir) -> str:
    """Hourly records stored and compacted, then one type's records put once more."""
    root = shared_dir(spark, "records")
    rows = latest.dedupe_last(_hourly(spark, sf_dir))
    store.upsert_records(rows, root)
    store.compact(spark, root, "records")
    store.upsert_records(
        rows.withColumns({"_ingested": F.lit(1).cast("long"), "unit": F.lit("v")})
        .where("record_type = 'HeartRate'"),
        root,
    )
    return root


PUT = ["user_id", "record_type", "start_date", "value", "unit", "job_id"]


def scan_newer(spark, sf_dir):
    """Rows of a snapshot, replaced by those put after it."""
    return store.scan_table(spark, _put_twice(spark, sf_dir), "records").select(*PUT)


def compact_twice(spark, sf_dir):
    """Rows of a snapshot that took in what was put after its first version."""
    root = _put_twice(spark, sf_dir)
    store.compact(spark, root, "records")
    return store.scan_table(spark, root, "records").select(*PUT)


def status(spark, sf_dir):
    checked = archive.validate_exports(_manifest(spark, sf_dir))
    return job_status(checked, _at())


QUERIES: dict[str, Query] = {
    "metric_daily": metric_daily,
    "metric_daily_fine": metric_daily_fine,
    "ecg_page_next": ecg_page_next,
    "workout_page_next": workout_page_next,
    "health_summary_stored": summary_stored,
    "pending_exports": pending,
    "faulty_exports": faulty_exports,
    "faulty_jobs": faulty_jobs,
    "job_lifecycle": lifecycle,
    "faulty_counts": faulty_counts,
    "faulty_rows": faulty_rows,
    "faulty_rejects": faulty_rejects,
    "metric_daily_range": metric_daily_range,
    "metric_summary": metric_summary,
    "first_unit": first_unit,
    "count_in_range": count_in_range,
    "health_summary": summary,
    "map_record_type": map_type,
    "project_record": project,
    "dedupe_last": dedupe_last,
    "timeline": timeline_,
    "user_scope": user_scope,
    "date_range": date_range,
    "type_filter": type_filter,
    "key_prefix": key_prefix,
    "parse_number": numbers,
    "order_by_start": order_by_start,
    "metric_page": metric_page,
    "metric_page_next": metric_page_next,
    "page_count": page_count,
    "next_cursor": next_cursor,
    "decode_cursor": cursor_keys,
    "ecg_page": ecg_page,
    "workout_page": workout_page,
    "recent_jobs": recent,
    "latest_by_key": latest_by_key,
    "normalise_users": users,
    "upsert_users": upsert_users,
    "check_requests": requests,
    "answer_daily": daily_answers,
    "answer_raw": raw_answers,
    "answer_raw_next": raw_answers_next,
    "check_requests_ecg": requests_ecg,
    "answer_ecg": ecg_answers,
    "answer_ecg_next": ecg_answers_next,
    "answer_workouts": workout_answers,
    "export_arrivals": export_arrivals,
    "parse_export_key": export_key,
    "list_members": list_members,
    "export_manifest": export_manifest,
    "validate_exports": validate_exports,
    "unpack_members": unpack_members,
    "ingest_stream": stream,
    "pick_export_xml": export_xml,
    "ingest_counts": counts,
    "scan_health_xml": scan_xml,
    "scan_ecg_csv": ecg_scan,
    "scan_gpx_routes": gpx_scan,
    "ecg_projection": ecg_rows,
    "row_ordinal": ordinals,
    "route_projection": route_rows,
    "job_status": status,
    "scan_table_records": table_records,
    "scan_table_ecg": table_ecg,
    "scan_table_routes": table_routes,
    "scan_table_jobs": table_jobs,
    "upsert_records": upsert_records,
    "compact_records": compacted_daily,
    "scan_newer": scan_newer,
    "compact_twice": compact_twice,
}
