"""The retention report as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwell.functions.columns import mentions, percent


def summary(predictions: DataFrame) -> DataFrame:
    """One row: customers, high, medium, calls."""
    return predictions.agg(F.count("*").alias("customers"), F.count_if(F.col("risk_level") == "HIGH").alias("high"), F.count_if(F.col("risk_level") == "MEDIUM").alias("medium"), F.count_if(mentions("suggested_action", "call")).alias("calls"))


def with_factor(predictions: DataFrame, factors: DataFrame) -> DataFrame:
    """top_factor beside each prediction, a dash where there is none."""
    return predictions.join(factors.select("user_id", "top_factor"), "user_id", "left").withColumn("top_factor", F.coalesce("top_factor", F.lit("-")))


def ranked(predictions: DataFrame, top_n: int) -> DataFrame:
    """The top_n predictions by probability, missing ones as 0, with rank from 1. The ranking follows the cut, so its one
    task has top_n rows."""
    p = F.coalesce("churn_probability", F.lit(0.0))
    top = predictions.orderBy(p.desc(), "user_id").limit(top_n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(p.desc(), "user_id")))


def lines(rows: DataFrame) -> DataFrame:
    """rank, line: a row of the report's table."""
    text = F.format_string("| %d | %s (#%d) | %s | %s | %s | %s |", "rank", "full_name", "user_id", "risk_level", percent("churn_probability"), "top_factor", "suggested_action")
    return rows.select("rank", text.alias("line"))


def action_groups(rows: DataFrame, groups: tuple[tuple[str, str], ...] = (("Retention calls", "call"), ("Coupons", "coupon"))) -> DataFrame:
    """action, rank, user_id, full_name, churn_probability, top_factor, members (of the action): a row may be in several
    actions, and an action without rows does not show."""
    inside = F.filter(F.array(*[F.when(mentions("suggested_action", word), F.lit(name)) for name, word in groups]), lambda x: x.isNotNull())
    long = rows.withColumn("action", F.explode(inside))
    sizes = long.groupBy("action").agg(F.count("*").alias("members"))  # a row an action
    return long.join(F.broadcast(sizes), "action").select("action", "rank", "user_id", "full_name", "churn_probability", "top_factor", "members")
