"""Landing stream: every new archive is unpacked and listed exactly once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitals.session import BATCH_BYTES, BATCHING
from vitals.sources.archive import list_members, unpack_members
from vitals.sources.arrivals import ARRIVALS, empty_arrivals, export_arrivals, parse_export_key
from vitals.sources.store import present, table_path


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
OPENING = "spark.sql.files.openCostInBytes"
WRITING = "spark.sql.maxConcurrentOutputFileWriters"
#: Tasks per core that list the uploads.
LISTING_TASKS = 4
#: What opening an archive counts for beside its length: some 500 small ones make a task.
OPEN_BYTES = 256 << 10
AVAILABLE = {"availableNow": True}


def landing_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark``, but for those its file source goes by.

    By default the source lists every folder, and every file of a batch once
    more, in a task of its own, and packs 32 small archives into a task; then
    starting tasks is most of the work. A task's rows are of one run, so its
    file needs no sort. Other queries keep their settings.
    """
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            session.conf.set(name, value)
    session.conf.set(LISTING, str(LISTING_TASKS * spark.sparkContext.defaultParallelism))
    session.conf.set(OPENING, str(OPEN_BYTES))
    session.conf.set(BATCHING, str(BATCH_BYTES))
    session.conf.set(WRITING, "1")
    return session


def land(arrivals: DataFrame, root: str, staging: str) -> DataFrame:
    """Manifest rows of ``arrivals``, with their members, large ones copied to ``staging``.

    A malformed key keeps its row with a reason and is not opened. Works on a
    stream and on a batch: no step needs state or a shuffle.
    """
    listed = list_members(parse_export_key(arrivals, root))
    return unpack_members(listed, staging, inline_xml=True)


def manifest_path(store: str) -> str:
    return table_path(store, "manifest")


def empty_path(store: str) -> str:
    """Beside the stream's manifest, whose log names the stream's own files only."""
    return table_path(store, "manifest_empty")


def land_empty(spark: SparkSession, root: str, store: str, staging: str) -> None:
    """Manifest rows of the uploads without a byte, which the stream does not see.

    Called before ``plans.ingest.normalise`` of the run, which then ends their
    jobs as failed. An upload that has a row keeps to it, in whatever run.
    """
    rows = land(empty_arrivals(spark, root), root, staging).withColumn("staging", F.lit(staging))
    if present(spark, empty_path(store)):
        known = spark.read.schema(rows.schema).parquet(empty_path(store)).select("path")
        rows = rows.join(known, "path", "left_anti").select(*rows.columns)
    rows.write.mode("append").partitionBy("staging").parquet(empty_path(store))


def listed_arrivals(session: SparkSession, root: str, listing: str) -> DataFrame:
    """A stream of the uploads below ``root`` that ``listing`` does not name yet.

    Spark's file source keeps the list of all uploads on the driver and goes
    through it several times. Here tasks list them, and what is new is written
    below ``listing``; the stream's source sees those few files. A listing that
    was written counts even if the run breaks off: its stream is the next one's.
    Tasks get as many archives as the file source would pack into one.
    """
    path = session._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(session._jsc.hadoopConfiguration())
    whole = path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    found = export_arrivals(session, whole)
    if present(session, listing):
        known = _listing(session.read, listing).select("path").distinct()
        found = found.join(known, "path", "left_anti").select(*found.columns)
    new = f"{listing}/run-{time.time_ns():020d}"
    found.write.parquet(new)
    size = F.coalesce(F.sum(F.col("length") + OPEN_BYTES), F.lit(0))
    (total,) = _listing(session.read, new).agg(size).first()
    most = session._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    split = min(most, max(OPEN_BYTES, total // session.sparkContext.defaultParallelism))
    # the time after which the source forgets a file does not hold for a listing
    return _listing(session.readStream.option("maxFileAge", "36500d"), listing).repartition(max(1, -(-total // split)))


def _listing(reader, path: str) -> DataFrame:
    return reader.schema(ARRIVALS).option("recursiveFileLookup", "true").parquet(path)


def ingest_stream(
    spark: SparkSession,
    root: str,
    store: str,
    staging: str,
    checkpoint: str,
    files_per_trigger: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Starts the landing stream; ``availableNow=True`` unless told otherwise.

    The checkpoint makes it once per file. A run has a staging folder of its
    own; ``plans.ingest.normalise`` then turns the run into table rows. The
    stream runs in a session of its own, in whose ``streams`` it is found.

    A stream that ends when all is landed has its uploads listed in tasks, and
    its checkpoint keeps to that. With other triggers, with
    ``files_per_trigger``, and where such a stream has begun the checkpoint,
    Spark's file source lists them.
    """
    session = landing_session(spark)
    listing = f"{checkpoint.rstrip('/')}/uploads"
    ends = not files_per_trigger and (trigger or AVAILABLE) == AVAILABLE
    if present(spark, listing) and not ends:
        raise ValueError(f"{checkpoint} is of a stream with availableNow=True and without files_per_trigger")
    begun = present(spark, f"{checkpoint.rstrip('/')}/offsets") and not present(spark, listing)
    if ends and not begun and present(spark, f"{root.rstrip('/')}/exports"):
        arrivals = listed_arrivals(session, root, listing)
    else:
        arrivals = export_arrivals(session, root, streaming=True, files_per_trigger=files_per_trigger)
    rows = land(arrivals, root, staging).withColumn("staging", F.lit(staging))
    return (
        rows.writeStream.format("parquet")
        .option("path", manifest_path(store))
        .partitionBy("staging")  # a run reads its own folder only
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or AVAILABLE))
        .start()
    )
