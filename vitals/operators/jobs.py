"""Ingestion job history and the status an ingestion ends with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.functions.text import epoch_text
from vitals.operators.filters import user_scope
from vitals.operators.latest import top_per_group
from vitals.schema import COMPLETED, FAILED, JOB_STATES, PENDING, PROCESSING, RECENT_JOBS, VALIDATING

# The step a run stood in when it was broken off in a state.
STEPS = {VALIDATING: "ValidateFile", PROCESSING: "ParallelParsing"}


def recent_jobs(
    jobs: DataFrame,
    n: int = RECENT_JOBS,
    user_id: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Per user the ``n`` highest job ids, listed by last update, newest first."""
    highest = top_per_group(
        user_scope(jobs, user_id), ["user_id"], [F.col("job_id").desc()], n
    ).drop("position")
    if not ordered:
        return highest
    return highest.orderBy(
        "user_id", F.col("updated_at").desc(), F.col("job_id").desc()
    )


def job_status(checked: DataFrame, at: Column) -> DataFrame:
    """Job rows from checked exports: each reject fails with its own step."""
    return checked.select(
        "user_id",
        "job_id",
        F.when(F.col("valid"), COMPLETED).otherwise(FAILED).alias("status"),
        epoch_text(at).alias("updated_at"),
        F.when(~F.col("valid"), F.col("error_step")).alias("error_step"),
    )


def entered(exports: DataFrame, status: str, at: Column) -> DataFrame:
    """State rows of exports that enter ``status``, which is no end."""
    return exports.select(
        "user_id",
        "job_id",
        F.lit(status).alias("status"),
        epoch_text(at).alias("updated_at"),
        F.lit(None).cast("string").alias("error_step"),
    )


def job_lifecycle(landed: DataFrame, states: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per export its state, since when, the failed step, and the states it went through.

    ``landed`` are the exports that have arrived, ``states`` the rows of
    ``entered`` and ``jobs`` how ingestions ended. An export with neither is
    pending, since an unknown time. Of several rows the latest counts, of one
    time that of the later state: a run that is repeated goes back to its first
    step. Null ids have no state. One shuffle by export, a few rows each.
    """
    known = landed.where(F.col("user_id").isNotNull() & F.col("job_id").isNotNull())
    waiting = entered(known, PENDING, F.lit(None).cast("timestamp"))
    rows = waiting.unionByName(states).unionByName(jobs)
    rank = F.array_position(F.array(*map(F.lit, JOB_STATES)), F.col("status"))
    row = F.struct(F.col("updated_at").cast("long").alias("since"), rank.alias("rank"), "status", "updated_at", "error_step")
    found = rows.groupBy("user_id", "job_id").agg(
        F.max(row).alias("last"), F.collect_set(F.struct(rank.alias("rank"), "status")).alias("seen")
    )
    return found.select(
        "user_id",
        "job_id",
        "last.status",
        "last.updated_at",
        "last.error_step",
        F.array_sort("seen")["status"].alias("states"),
    )


def abandoned(lifecycle: DataFrame, before: Column, at: Column) -> DataFrame:
    """Job rows that end what has stood in a step since before ``before``: failed in it.

    Pending exports are not ended; a later run takes them in.
    """
    step = F.element_at(F.create_map(*[F.lit(x) for pair in STEPS.items() for x in pair]), F.col("status"))
    stale = lifecycle.where(F.col("status").isin(*STEPS) & (F.col("updated_at").cast("long") < F.unix_timestamp(before)))
    return stale.select(
        "user_id",
        "job_id",
        F.lit(FAILED).alias("status"),
        epoch_text(at).alias("updated_at"),
        step.alias("error_step"),
    )
