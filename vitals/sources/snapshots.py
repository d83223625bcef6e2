"""Incremental snapshots of the stored tables.

Upserts append batches of versions. A snapshot holds the newest row per key of
the batches it has taken in, as files whose bounds a manifest lists: their
type, first and last month. Reading ranks the rows of newer batches only and
lets them replace snapshot rows; files of types and months that no newer batch
touches are returned as they are. Compacting takes newer batches in and
rewrites the files of those types and months only.

A version of the manifest counts once its write is complete, and names all its
files; those of earlier versions stay where they are, so readers are not
disturbed and a failed run is simply repeated. One compaction of a table may
run at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vitals.operators.latest import latest_by_key

MANIFEST = "file STRING, part STRING, first_month STRING, last_month STRING, n_rows LONG, batch STRING"


class Family(NamedTuple):
    """What a snapshot needs to know of a table: its columns and keys, the
    columns by which the newer of two versions is told, the column that splits
    it into folders (if any), and a row's month."""

    columns: Sequence[str]
    schema: str
    keys: Sequence[str]
    newest: Sequence[str]
    part: str | None
    month: Column

    def part_of(self) -> Column:
        return F.col(self.part) if self.part else F.lit("")


class State(NamedTuple):
    """The manifest's latest version: its files and the batches they hold."""

    version: int
    files: list[Row]
    batches: frozenset[str]


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it does not exist."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(location):
        return []
    return [status.getPath().getName() for status in system.listStatus(location)]


OTHER_MONTH = "other"


def newer_batches(spark: SparkSession, log: str, taken: frozenset[str]) -> list[str]:
    """Batches that have been appended in full and are not among ``taken``."""
    names = {name for name in _children(spark, log) if name.startswith("_batch=")}
    names -= {f"_batch={batch}" for batch in taken}
    return sorted(name[7:] for name in names if "_SUCCESS" in _children(spark, f"{log}/{name}"))


def state(spark: SparkSession, home: str) -> State:
    """The latest complete version of the manifest below ``home``; 0 and empty if there is none."""
    versions = [int(name.removeprefix("version=")) for name in _children(spark, f"{home}/manifest") if name[8:].isdigit()]
    for version in sorted(versions, reverse=True):
        path = f"{home}/manifest/version={version}"
        if "_SUCCESS" in _children(spark, path):
            rows = spark.read.schema(MANIFEST).parquet(path).collect()  # a row per file and batch
            files = [r for r in rows if r["file"] is not None]
            return State(version, files, frozenset(r["batch"] for r in rows if r["batch"] is not None))
    return State(0, [], frozenset())


def read_files(spark: SparkSession, home: str, family: Family, files: Iterable[Row]) -> DataFrame:
    """Rows of some of a snapshot's files."""
    paths = [f"{home}/{r['file']}" for r in files]
    if not paths:
        return spark.createDataFrame([], family.schema)
    reader = spark.read.schema(family.schema).option("basePath", f"{home}/data")
    return reader.parquet(*paths).select(*family.columns)


def touched_parts(fresh: DataFrame, family: Family) -> set[tuple[str, str]]:
    """Types and months that rows lie in: a few thousand at most."""
    found = fresh.select(family.part_of().alias("part"), family.month.alias("month")).distinct()
    return {(r["part"], r["month"]) for r in found.collect()}


def split_files(files: Iterable[Row], parts: set[tuple[str, str]]) -> tuple[list[Row], list[Row]]:
    """Files that may hold rows of the given types and months, and the others."""
    touched: list[Row] = []
    others: list[Row] = []
    for r in files:
        meets = any(p == r["part"] and r["first_month"] <= m <= r["last_month"] for p, m in parts)
        (touched if meets else others).append(r)
    return touched, others


def replaced(old: DataFrame, fresh: DataFrame, family: Family) -> DataFrame:
    """The newer of both per key; each input has a key once.

    Joins only: where the fresh rows are few they are broadcast and the old ones
    are not shuffled.
    """
    old, fresh = old.alias("o"), fresh.alias("f")

    def order(side: str) -> Column:
        return F.struct(*[F.col(f"{side}.{c}") for c in family.newest])

    def same(left: str, right: str) -> Column:
        on = F.lit(True)
        for key in family.keys:
            on &= F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
        return on

    kept_old = old.join(fresh, same("o", "f") & (order("f") >= order("o")), "left_anti")
    beating = old.join(fresh, same("o", "f") & (order("o") > order("f")), "left_semi")
    kept_fresh = fresh.join(beating.select(*family.keys).alias("b"), same("f", "b"), "left_anti")
    return kept_old.unionByName(kept_fresh)


def read_newest(
    spark: SparkSession,
    log: str,
    home: str,
    family: Family,
    months: tuple[str, str] | None = None,
) -> DataFrame:
    """The newest row per key of a table, from its snapshot and the batches after it.

    ``months`` leaves out snapshot files and newer rows of other months; their
    rows may still come where a file has rows of both. Times that start with no
    month stay.
    """
    now = state(spark, home)
    rows = spark.read.schema(f"{family.schema}, _batch STRING").parquet(log)
    if now.version == 0:
        return latest_by_key(rows.select(*family.columns), family.keys, family.newest)
    files = now.files
    if months:
        files = [
            r
            for r in files
            if r["first_month"] <= months[1] and months[0] <= r["last_month"] or r["last_month"] == OTHER_MONTH
        ]
    newer = newer_batches(spark, log, now.batches)
    if not newer:
        return read_files(spark, home, family, files)
    fresh = rows.where(F.col("_batch").isin(newer)).select(*family.columns)
    if months:
        fresh = fresh.where(family.month.between(*months) | (family.month == OTHER_MONTH))
    touched, others = split_files(files, touched_parts(fresh, family))
    fresh = latest_by_key(fresh, family.keys, family.newest)
    if touched:
        fresh = replaced(read_files(spark, home, family, touched), fresh, family)
    return fresh.unionByName(read_files(spark, home, family, others)) if others else fresh


def compact_newer(
    spark: SparkSession, log: str, home: str, family: Family, layout: Sequence[str | Column]
) -> State:
    """Takes the batches after the snapshot in, and returns the manifest that results.

    New files are ranged and sorted by ``layout``. Without newer batches nothing
    is written.
    """
    now = state(spark, home)
    newer = newer_batches(spark, log, now.batches)
    if not newer:
        return now
    rows = spark.read.schema(f"{family.schema}, _batch STRING").parquet(log)
    fresh = rows.where(F.col("_batch").isin(newer)).select(*family.columns)
    touched, others = split_files(now.files, touched_parts(fresh, family))
    merged = latest_by_key(fresh, family.keys, family.newest)
    if touched:
        merged = replaced(read_files(spark, home, family, touched), merged, family)
    version = now.version + 1
    written = f"data/_version={version}"
    writer = merged.repartitionByRange(*layout).sortWithinPartitions(*layout).write.mode("overwrite")
    if family.part:
        writer = writer.partitionBy(family.part)
    writer.parquet(f"{home}/{written}")

    # bounds come from the key columns of what has just been written
    stored = spark.read.schema(family.schema).option("basePath", f"{home}/data").parquet(f"{home}/{written}")
    # a URI, while readers take paths as they are
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    place = F.concat(F.lit(f"{written}/"), F.substring_index(path, f"/{written}/", -1))
    listed = stored.select(place.alias("file"), family.part_of().alias("part"), family.month.alias("month"))
    added = listed.groupBy("file", "part").agg(
        F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.count("*").alias("n_rows")
    )
    kept = spark.createDataFrame(
        [(*r[:5], None) for r in others] + [(None, None, None, None, None, b) for b in {*now.batches, *newer}], MANIFEST
    )
    entries = added.withColumn("batch", F.lit(None).cast("string")).unionByName(kept)
    entries.coalesce(1).write.mode("overwrite").parquet(f"{home}/manifest/version={version}")
    return state(spark, home)
