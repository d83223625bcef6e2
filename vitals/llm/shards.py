"""Sharding by extendible hashing, in DataFrame operations only.

The directory is indexed by the leading bits of a row's hash. A bucket whose
bytes exceed the limit is split on one more bit; the others keep their depth.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.llm.tables import landed

HASH_BITS = 60
LIMIT_BYTES = 16 << 20
#: Copies of one key are told apart in blocks of so many.
COPY_BLOCK = 10_000


def hash_bits(*parts: Column) -> Column:
    """The first 60 bits of an MD5 of the parts."""
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, copy, bits of every row.

    Rows of equal id and length are numbered (``copy``), so that no number of
    repeats of one key can make a bucket that does not split.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    counted = rows.groupBy("doc_id", "n_bytes").agg(F.count("*").alias("n"))
    blocks = counted.withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPY_BLOCK}")))
    )
    low = F.col("block") * COPY_BLOCK
    copies = F.sequence(low, F.least(low + COPY_BLOCK, F.col("n")) - 1)
    return blocks.select("doc_id", "n_bytes", F.explode(copies).alias("copy")).withColumn(
        "bits",
        hash_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")),
    )


def shards(docs: DataFrame, limit: int = LIMIT_BYTES, step: int = 8) -> DataFrame:
    """doc_id, n_bytes, copy, shard, depth, shard_bytes of every row of ``docs``.

    ``shard`` is the bucket's hash prefix in binary digits, empty while one
    shard holds everything. A shard exceeds ``limit`` only where it holds a
    single row that does. A null text has no bytes; a null id is a key like any
    other; rows that repeat are spread like other rows; other columns are not
    read; an empty table has no shards.
    """
    rest = landed(keyed(docs), "shard-keys")
    total = rest.agg(F.sum("n_bytes")).first()[0] or 0
    base, depth = 0, min(HASH_BITS, max(1, math.ceil(math.log2(max(total, 1) / limit + 1)) + 2))
    out = []
    while True:
        rest = rest.withColumn("leaf", F.expr(f"shiftright(bits, {HASH_BITS - depth})"))
        leaves = rest.groupBy("leaf").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        # every leaf's bytes count in the buckets above it, up to where the last round ended
        ladder = leaves.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(depth)))).withColumn(
            "prefix", F.expr(f"shiftright(leaf, {depth} - depth)")
        )
        buckets = (
            ladder.groupBy("depth", "prefix")
            .agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n"))
            .where((F.col("shard_bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") == HASH_BITS))
        )
        ends = landed(
            ladder.select("leaf", "depth", "prefix")
            .join(buckets.drop("n"), ["depth", "prefix"])
            .groupBy("leaf")
            .agg(F.min_by(F.struct("depth", "prefix", "shard_bytes"), "depth").alias("end")),
            "shard-ends",
        )
        name = F.expr("if(end.depth = 0, '', lpad(bin(end.prefix), end.depth, '0'))")
        joined = rest.join(ends, "leaf", "left")
        out.append(
            joined.where("end is not null").select(
                "doc_id", "n_bytes", "copy", name.alias("shard"), "end.depth", "end.shard_bytes"
            )
        )
        # the driver learns only whether a bucket is left to split
        if leaves.join(ends, "leaf", "left_anti").isEmpty():
            break
        rest = joined.where("end is null").select("doc_id", "n_bytes", "copy", "bits")
        base, depth = depth, min(HASH_BITS, depth + step)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
