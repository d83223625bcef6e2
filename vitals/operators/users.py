"""Sign-up events to user rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.functions.text import is_true
from vitals.operators.latest import latest_by_key


def normalise_users(signups: DataFrame, at: Column | None = None) -> DataFrame:
    """User rows of ``signups (user_name, attributes STRUCT<...>)``.

    Events without a user name are left out. A null stands for an absent
    attribute. ``at`` is the time of processing.
    """
    moment = F.current_timestamp() if at is None else at
    stamp = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    attribute = F.col("attributes")
    return signups.where(F.coalesce("user_name", F.lit("")) != "").select(
        F.col("user_name").alias("id"),
        attribute["email"].alias("email"),
        is_true(attribute["email_verified"]).alias("email_verified"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
        F.lit("active").alias("status"),
        F.struct(
            *(attribute[name].alias(name) for name in ["given_name", "family_name", "name"])
        ).alias("profile"),
    )


def latest_users(users: DataFrame) -> DataFrame:
    return latest_by_key(users, ["id"], ["updated_at", "created_at"])
