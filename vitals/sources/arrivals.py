"""Export archives as they lie below, or arrive in, an upload folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.sources.files import list_files

# Schema of Spark's binaryFile source; streams need it stated.
BINARY_FILE = (
    "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"
)


MALFORMED_KEY = "malformed key"
ROWS = 10_000


ARRIVALS = "path STRING, length LONG, mtime TIMESTAMP"
#: Users' folders that a task lists.
FOLDERS = 200


def export_arrivals(
    spark: SparkSession,
    root: str,
    streaming: bool = False,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """``(path, length, mtime)`` of every ``exports/**.zip`` below ``root``.

    No archive is read here. A stream lists them as Spark's file sources do, on
    the driver; tasks are packed by file length. A batch lists them in tasks, so
    that the driver holds no file of what may be millions. Neither lists empty
    files; ``empty_arrivals`` does.
    """
    if not streaming:
        return _arrivals(spark, root, lambda size: size > 0, hidden=False)
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    reader = reader.option("pathGlobFilter", "*.zip").option(
        "recursiveFileLookup", "true"
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(f"{root.rstrip('/')}/exports").select(
        "path", "length", F.col("modificationTime").alias("mtime")
    )


def empty_arrivals(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, mtime)`` of the ``exports/**.zip`` without a byte.

    A root without uploads has no row.
    """
    return _arrivals(spark, root, lambda size: size == 0, hidden=True)


def _shown(path: str) -> bool:
    """Whether Spark's file sources would list a file of this path below the root."""
    return not any(
        name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
        for name in path.split("/")
    )


def _arrivals(spark: SparkSession, root: str, of_size: Callable[[int], bool], hidden: bool) -> DataFrame:
    """The archives of some size below ``root``, listed in tasks.

    One task lists the users' folders, the others what lies in some of them.
    """
    base = f"{root.rstrip('/')}/exports"
    # local paths are given as Spark lists them
    scheme = "file:" if ":" not in base.split("/", 1)[0] and not hidden else ""
    types = [pa.string(), pa.int64(), pa.timestamp("us", "UTC")]

    def rows(found: list[tuple], name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], [name, "length", "mtime"])

    def chosen(name: str, info) -> bool:
        return info.is_file and name.endswith(".zip") and of_size(info.size) and (hidden or _shown(name))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            # what lies beside the users' folders has a malformed key, but a row
            found = [
                (name, None if not info.is_file else info.size, None if not info.is_file else info.mtime)
                for name, info in list_files(base, recursive=False)
                if chosen(name, info) or not info.is_file and (hidden or _shown(name))
            ]
            for at in range(0, len(found), ROWS):
                yield rows(found[at : at + ROWS], "name")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, length, mtime in zip(*(column.to_pylist() for column in batch.columns)):
                if length is not None:
                    found.append((f"{scheme}{base}/{name}", length, mtime))
                    continue
                found += [
                    (f"{scheme}{base}/{name}/{inner}", info.size, info.mtime)
                    for inner, info in list_files(f"{base}/{name}")
                    if chosen(f"{name}/{inner}", info)
                ]
            if found:
                yield rows(found, "path")

    named = spark.range(0, 1, 1, 1).mapInArrow(first, "name STRING, length LONG, mtime TIMESTAMP")
    tasks = -(-named.count() // FOLDERS)
    return named.repartition(max(1, tasks)).mapInArrow(listed, ARRIVALS)


# Fixed format of an upload key, below the root: exports/{user}/{job}.zip
EXPORT_KEY = r"^exports/([^/]+)/([^/.]+)[^/]*\.zip$"


def parse_export_key(arrivals: DataFrame, root: str) -> DataFrame:
    """Adds ``user_id`` and ``job_id``, null where the key is malformed.

    The user is the second segment of the key and the job the third up to its
    first dot.
    """
    # the listing may add a scheme to the root it was given
    folder = "/" + root.split(":", 1)[-1].strip("/") + "/exports/"
    key = F.concat(F.lit("exports/"), F.substring_index("path", folder, -1))
    part = lambda group: F.nullif(
        F.regexp_extract(key, EXPORT_KEY, group), F.lit("")
    )
    return arrivals.withColumns({"user_id": part(1), "job_id": part(2)})


def split_export_keys(arrivals: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed arrivals, and the rejects with their reason."""
    keyed = parse_export_key(arrivals, root)
    known = F.col("user_id").isNotNull() & F.col("job_id").isNotNull()
    rejects = keyed.where(~known).withColumn("reason", F.lit(MALFORMED_KEY))
    return keyed.where(known), rejects
