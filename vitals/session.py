"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


PARTITION_BYTES = 128 << 20
#: Of rows that go to Python at once; each core holds such batches on both sides.
BATCH_BYTES = 8 << 20
BATCHING = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(
    master: str | None = None, shuffle_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings the library is written for.

    ``master`` is for tests and the bench; on a cluster leave it to
    ``spark-submit``. ``shuffle_bytes`` is the volume of the largest shuffle,
    for ingestion about a quarter of the XML: shuffles start with so many
    partitions that each fits in memory, and adaptive execution merges those
    that turn out small.
    """
    builder = SparkSession.builder.appName("vitals")
    if master:
        builder = builder.master(master)
    settings = {
        # start_date texts carry the recorder's own offset and are never
        # converted; UTC keeps the few real timestamps (as_of, arrival) stable.
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.parquet.compression.codec": "zstd",
        **conf,
    }
    if shuffle_bytes is not None:
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(
            max(200, -(-shuffle_bytes // PARTITION_BYTES))
        )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new, empty path below the folder every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where the
    setting is absent on a local master (tests) is a temporary folder used; on
    any other master that is an error, as executors have folders of their own.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_DIR
    )
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a shared folder on {master}")
        base = tempfile.mkdtemp(prefix="vitals-")
        spark.conf.set(CHECKPOINT_DIR, base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def once(df: DataFrame, label: str) -> DataFrame:
    """Rows written to the shared folder and read again, so that they are worked out once."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    before = spark.conf.get(BATCHING)
    spark.conf.set(BATCHING, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCHING, before)
    return spark.read.schema(df.schema).parquet(path)
