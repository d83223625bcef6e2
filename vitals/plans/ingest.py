"""From landed archives to stored rows, as one batch per landing run."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitals.operators.counts import ingest_counts
from vitals.operators.ecg import (
    ecg_projection,
    route_projection,
    row_ordinal,
)
from vitals.operators.jobs import STEPS, abandoned, entered, job_lifecycle, job_status
from vitals.operators.latest import dedupe_last
from vitals.operators.records import map_record_type, project_record
from vitals.schema import ECG, JOBS, PROCESSING, ROUTES, VALIDATING, column_names
from vitals.session import once
from vitals.sources import archive, store
from vitals.sources.ecg_csv import scan_ecg
from vitals.sources.gpx import scan_gpx
from vitals.sources.health_xml import scan_health_xml, scan_xml_values
from vitals.streaming.ingest import empty_path, manifest_path


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, made without a Python worker on each core."""
    fields = StructType.fromDDL(schema).fields
    return spark.range(0).select(*(F.lit(None).cast(field.dataType).alias(field.name) for field in fields))


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows of all landing runs, empty uploads included."""
    schema = f"{archive.UNPACKED}, staging STRING"
    landed = [
        spark.read.schema(schema).parquet(path)
        for path in (manifest_path(root), empty_path(root))
        if store.present(spark, path)
    ]
    return reduce(DataFrame.unionByName, landed) if landed else _empty(spark, schema)


def read_manifest(spark: SparkSession, root: str, staging: str) -> DataFrame:
    """Manifest rows of one landing run."""
    return _manifest(spark, root).where(F.col("staging") == staging).drop("staging")


def staged_scan(
    spark: SparkSession, staging: str, manifest: DataFrame, exports: DataFrame | None = None
) -> DataFrame:
    """Record elements of a run, or of some exports of it.

    Large XML lies in files, laid out by export, so that ``exports`` prunes
    folders; the rest is held in the manifest.
    """
    xml = members_of(manifest, "xml")
    if exports is not None:
        xml = xml.join(exports, EXPORT, "left_semi")
    scan = scan_xml_values(xml)
    folder = f"{staging}/kind=xml"
    if not store.present(spark, folder):
        return scan
    files = scan_health_xml(spark, folder, staged=True)
    if exports is not None:
        files = files.join(exports, EXPORT, "left_semi")
    return scan.unionByName(files)


def staged_records(
    spark: SparkSession, staging: str, manifest: DataFrame, at: Column, exports: DataFrame | None = None
) -> DataFrame:
    """Record rows of a run, or of some exports of it: the last of every key."""
    scan = map_record_type(staged_scan(spark, staging, manifest, exports))
    return dedupe_last(project_record(scan, F.unix_timestamp(at)))


def members_of(manifest: DataFrame, kind: str) -> DataFrame:
    return manifest.where(F.col("kind") == kind)


def ecg_lines(manifest: DataFrame) -> DataFrame:
    """ECG lines of a run, and what could not be read, parsed once."""
    return once(scan_ecg(members_of(manifest, "ecg")), "ecg-lines")


def gpx_tracks(manifest: DataFrame) -> DataFrame:
    """Tracks of a run, and members that could not be read, parsed once."""
    return once(scan_gpx(members_of(manifest, "gpx")), "tracks")


def staged_ecg(manifest: DataFrame, at: Column, lines: DataFrame | None = None) -> DataFrame:
    """ECG rows of a run; ``lines`` where they have been parsed already."""
    scan = (ecg_lines(manifest) if lines is None else lines).where("reason is null")
    return row_ordinal(ecg_projection(scan, at)).select(*column_names(ECG))


def staged_routes(
    spark: SparkSession, staging: str, manifest: DataFrame, at: Column, tracks: DataFrame | None = None
) -> DataFrame:
    """Route rows of a run; ``tracks`` where they have been parsed already."""
    scan = (gpx_tracks(manifest) if tracks is None else tracks).where("reason is null")
    return row_ordinal(route_projection(scan, at)).select(*column_names(ROUTES))


def rejects(lines: DataFrame, tracks: DataFrame, at: Column) -> DataFrame:
    """What of a run's members could not be read: the file, the line if one, and why."""
    refused = tracks.withColumn("line", F.lit(None).cast("long"))
    columns = ["user_id", "job_id", "source_file", "line", "reason"]
    found = [df.where("reason is not null").select(*columns) for df in (lines, refused)]
    return found[0].unionByName(found[1]).withColumn("_ingested", F.unix_timestamp(at))


EXPORT = ["user_id", "job_id"]


def pending_exports(manifest: DataFrame, jobs: DataFrame) -> DataFrame:
    """Exports that have landed and have no job row yet."""
    landed = manifest.where(F.col("user_id").isNotNull() & F.col("job_id").isNotNull())
    return landed.select(*EXPORT).distinct().join(jobs.select(*EXPORT), EXPORT, "left_anti")


def normalise(spark: SparkSession, root: str, staging: str, at: datetime) -> None:
    """Writes the rows of a landing run's pending exports to the tables below ``root``.

    Job rows come last, so an export is pending until all its rows are stored.
    After a failure, and after each further batch of the stream, the call is
    simply repeated: every write is a put by key, and the newest version wins.
    """
    moment = F.lit(at).cast("timestamp")
    manifest = read_manifest(spark, root, staging)
    jobs = _versions(spark, root, "jobs")
    # unkeyed rows have no job and store nothing
    pending = once(pending_exports(manifest, jobs), "pending")
    store.write_job_states(entered(pending, VALIDATING, moment), root)
    manifest = manifest.join(pending, EXPORT, "left_semi")
    checked = archive.validate_exports(manifest).where(
        F.col("user_id").isNotNull() & F.col("job_id").isNotNull()
    )

    # of an export that failed validation nothing is stored, not even good members
    outcome = once(checked.select(*EXPORT, "valid", "error_step"), "checked")
    valid = outcome.where("valid").select(*EXPORT)
    # well-formedness was found out while unpacking, but it is a failure of parsing
    parsed = outcome.where(F.col("valid") | (F.col("error_step") == STEPS[PROCESSING]))
    store.write_job_states(entered(parsed, PROCESSING, moment), root)
    good = manifest.join(valid, EXPORT, "left_semi")

    store.upsert_records(staged_records(spark, staging, manifest, moment, valid), root)
    lines, tracks = ecg_lines(good), gpx_tracks(good)
    store.upsert_ecg(staged_ecg(good, moment, lines), root)
    store.upsert_routes(staged_routes(spark, staging, good, moment, tracks), root)
    store.write_rejects(rejects(lines, tracks, moment), root)

    store.write_job_status(job_status(outcome, moment), root)


def _versions(spark: SparkSession, root: str, family: str) -> DataFrame:
    """All rows written to a table of jobs; none before the first run."""
    if store.present(spark, store.table_path(root, family)):
        return store.scan_table(spark, root, family, versions=True)
    return _empty(spark, JOBS)


def lifecycle(spark: SparkSession, root: str) -> DataFrame:
    """The state of every export that has landed below ``root``, in whatever run."""
    return job_lifecycle(_manifest(spark, root).select(*EXPORT), _versions(spark, root, "job_states"), _versions(spark, root, "jobs"))


def end_abandoned(spark: SparkSession, root: str, before: datetime, at: datetime) -> None:
    """Fails the exports whose run has stood in one step since before ``before``.

    For runs whose driver died and that nobody repeats; ``normalise`` would
    take their exports in again, and no longer does so after this.
    """
    ended = abandoned(lifecycle(spark, root), F.lit(before).cast("timestamp"), F.lit(at).cast("timestamp"))
    store.write_job_status(once(ended, "abandoned"), root)


def run_counts(spark: SparkSession, root: str, staging: str, at: datetime) -> DataFrame:
    """Per export of a run: members, records kept and skipped, rows written.

    Of an export that failed validation the members count only, as nothing of
    it is stored.
    """
    moment = F.lit(at).cast("timestamp")
    manifest = read_manifest(spark, root, staging).where(F.col("user_id").isNotNull())
    checked = archive.validate_exports(manifest.where(F.col("job_id").isNotNull()))
    valid = once(checked.where("valid").select(*EXPORT), "valid")
    good = manifest.join(valid, EXPORT, "left_semi")
    return ingest_counts(
        manifest,
        staged_scan(spark, staging, manifest, valid),
        staged_ecg(good, moment),
        staged_routes(spark, staging, good, moment),
    )
