"""From probabilities to the week's candidates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.functions.columns import is_customer
from keepwell.operators.activity import with_trend
from keepwell.operators.contacts import suppress
from keepwell.sources.shared import settle

#: A stand-in for a fitted model that SQL can follow; the constant keeps scores off the usual cuts.
FORMULA = "1 / (1 + exp(-(-1.0123D + 3 * cancellation_rate + 2 * unresolved_ticket_rate + 1.5D * pct_low_reviews + 0.5D * tickets_per_order - 0.3D * coalesce(avg_review_rating, 3D))))"


def formula_probability() -> Column:
    return F.expr(FORMULA)


def prioritise(scored: DataFrame) -> DataFrame:
    """priority_score = probability x mean order value; missing where there is no order."""
    return scored.withColumn("priority_score", F.col("churn_probability") * F.col("avg_order_value"))


def with_names(scored: DataFrame, users: DataFrame) -> DataFrame:
    return scored.join(users.where(is_customer()).select("user_id", "full_name"), "user_id", "left")


def top_candidates(scored: DataFrame, users: DataFrame, log: DataFrame, contacts: DataFrame, as_of: datetime, log_as_of: datetime, top_n: int = 15, days: int = 30, earlier: int = 60, recent: int = 30) -> DataFrame:
    """The top_n users by priority, missing ones last, without those contacted lately, with names and login trend.

    The limit is a take-ordered over the scores; names and logins are only looked up for what is left after it. As
    both need that list, its top_n rows are written once, so the scores are not worked out again for each.
    """
    free = suppress(prioritise(scored), contacts, as_of, days)
    top = settle(free.orderBy(F.desc_nulls_last("priority_score"), "user_id").limit(top_n), "candidates")
    named = with_names(top, users)
    return with_trend(named, log, log_as_of, earlier, recent)


def presented(candidates: DataFrame) -> DataFrame:
    """Rounded for people; nothing is computed from these figures."""
    return candidates.withColumns({"churn_probability": F.round("churn_probability", 3), "avg_order_value": F.round("avg_order_value", 2), "priority_score": F.round("priority_score", 2)})
