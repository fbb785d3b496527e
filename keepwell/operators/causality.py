"""Do churners really differ? Pooled rates by label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.functions.columns import OPEN_TICKETS


def pooled_rates(truth: DataFrame, orders: DataFrame, tickets: DataFrame, reviews: DataFrame) -> DataFrame:
    """By churned: users, mean rating over reviews, cancellations by orders, unresolved by tickets, tickets by users.

    Each fact is summed by user before it meets the labels, so no raw row is joined.
    """
    label = truth.select("user_id", "churned")

    def of(table: DataFrame, hits: Column, name: str, n: str) -> DataFrame:
        by_user = table.groupBy("user_id").agg(F.sum(hits).alias(name), F.count(hits).alias(n))
        return by_user.join(label, "user_id").groupBy("churned").agg(F.sum(name).alias(name), F.sum(n).alias(n))

    users = label.groupBy("churned").agg(F.count("*").alias("users"))
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    rating = of(reviews, F.col("rating"), "stars", "rated")
    cancelled = of(orders, yes(F.col("order_status") == "CANCELLED"), "c", "o")
    open_ = of(tickets, yes(F.col("status").isin(*OPEN_TICKETS)), "u", "t")
    all_ = users.join(rating, "churned", "left").join(cancelled, "churned", "left").join(open_, "churned", "left")
    return all_.select("churned", "users", (F.col("stars") / F.col("rated")).alias("avg_rating"), (F.col("c") / F.col("o")).alias("cancel_rate"), (F.col("u") / F.col("t")).alias("unresolved_rate"), (F.coalesce("t", F.lit(0)) / F.col("users")).alias("tickets_per_user"))
