"""Recomputing what a verdict claims, and how often the claims hold."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.operators.activity import login_trend

FIELDS = ("logins_prev_30_60d", "logins_recent_30d", "total_orders", "total_tickets", "worst_review_rating")


def facts(ids: DataFrame, orders: DataFrame, tickets: DataFrame, reviews: DataFrame, log: DataFrame, log_as_of: datetime, earlier: int = 60, recent: int = 30, few: bool = False) -> DataFrame:
    """The FIELDS of each distinct user of ids; 0 where there is nothing, a worst rating of 0 without reviews.

    Each fact table is counted by user, pre-aggregated, and then joined. few: ids are a short list, to which the facts are
    cut before they are counted.
    """
    asked = ids.select("user_id").distinct()
    of = lambda t: t.join(asked, "user_id", "left_semi") if few else t
    trend = login_trend(of(log), log_as_of, earlier, recent).withColumnsRenamed({"logins_prev": FIELDS[0], "logins_recent": FIELDS[1]})
    counted = (
        trend,
        of(orders).groupBy("user_id").agg(F.count("*").alias("total_orders")),
        of(tickets).groupBy("user_id").agg(F.count("*").alias("total_tickets")),
        of(reviews).groupBy("user_id").agg(F.min("rating").alias("worst_review_rating")),
    )
    out = asked
    for t in counted:
        out = out.join(t, "user_id", "left")
    return out.select("user_id", *[F.coalesce(F.col(f).cast("long"), F.lit(0)).alias(f) for f in FIELDS])


def facts_of(profile: DataFrame) -> DataFrame:
    """The FIELDS of each customer of a profile with logins."""
    source = ("logins_prev", "logins_recent", "total_orders", "total_tickets", "worst_rating")
    return profile.select("user_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(f) for f, c in zip(FIELDS, source, strict=True)])


def checks(predictions: DataFrame, real: DataFrame) -> DataFrame:
    """A row for each prediction and field: user_id, field, claimed, actual, correct. A missing claim is wrong, and
    predictions that repeat a user are checked one by one."""
    claimed = predictions.select("user_id", F.posexplode(F.array(*[F.col(f"evidence.{f}").cast("long") for f in FIELDS])).alias("i", "claimed"))
    actual = real.select("user_id", F.posexplode(F.array(*FIELDS)).alias("i", "actual"))
    name = F.element_at(F.array(*[F.lit(f) for f in FIELDS]), F.col("i") + 1)
    both = claimed.join(actual, ["user_id", "i"], "left")
    return both.select("user_id", name.alias("field"), "claimed", "actual", F.col("claimed").eqNullSafe(F.col("actual")).alias("correct"))


def mismatches(checked: DataFrame) -> DataFrame:
    return checked.where(~F.col("correct"))


def fidelity(checked: DataFrame) -> DataFrame:
    """One row: users and fields checked, fields correct, users with errors, and the share that is correct."""
    row = checked.agg(
        F.count_distinct("user_id").alias("users_checked"),
        F.count("*").alias("fields_checked"),
        F.count_if("correct").alias("fields_correct"),
        F.count_distinct(F.when(~F.col("correct"), F.col("user_id"))).alias("users_with_errors"),
    )
    return row.withColumn("fidelity", F.when(F.col("fields_checked") > 0, F.col("fields_correct") / F.col("fields_checked")).otherwise(0.0))
