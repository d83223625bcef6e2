"""Reading the given tables and cutting lineage."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.session import shared_dir


T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the folder all executors share, and read again.

    What follows starts from files, so a lost executor costs no more than its
    own tasks, and a table used twice is worked out once.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(spark: SparkSession, value: T) -> Callable[[], T]:
    """``value`` broadcast; a task calls the result once to have it.

    Sent as bytes that hold its class too where the package is pickled by
    value, as functions are: a plain broadcast names the class, and executors
    without the package could not read it.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs started inside hand workers batches of at most about ``size`` bytes, for rows that are large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


SIEVE_BITS = 24


def sieved(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` may be among that of ``ids``, before they are shuffled.

    A bitmap of hashed ids, broadcast as at most 2**18 words of 64 bits however
    many ids there are. A row that is among them always passes; of the others
    the fewer do, the fewer ids there are. A join with ``ids`` has to follow.
    """
    place = F.pmod(F.xxhash64(column), F.lit(1 << SIEVE_BITS))
    word, bit = F.expr("_place div 64").alias("_word"), F.expr("cast(_place % 64 as int)").alias("_bit")
    words = (
        ids.select(place.alias("_place"))
        .select(word, bit)
        .groupBy("_word")
        .agg(F.expr("bit_or(shiftleft(cast(1 as bigint), _bit))").alias("_bits"))
    )
    placed = rows.select("*", place.alias("_place")).select("*", word, bit).drop("_place")
    return (
        placed.join(F.broadcast(words), "_word").where("getbit(_bits, _bit) = 1").drop("_word", "_bit", "_bits")
    )
