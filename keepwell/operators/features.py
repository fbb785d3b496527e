"""The per-customer feature table: each fact is aggregated by user before it is joined, so nothing fans out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.functions.columns import FEATURES, OPEN_TICKETS, is_bad_ticket, is_customer, rate

COUNTS = ("total_orders", "cancelled", "total_tickets", "unresolved", "total_reviews", "low_reviews")


def order_facts(orders: DataFrame) -> DataFrame:
    """By user: orders, their mean amount and cancellations. Cancelled orders count in all three."""
    return orders.groupBy("user_id").agg(F.count("*").alias("total_orders"), F.avg("total_amount").alias("avg_order_value"), F.count_if(F.col("order_status") == "CANCELLED").alias("cancelled"))


def ticket_facts(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("user_id").agg(F.count("*").alias("total_tickets"), F.count_if(F.col("status").isin(*OPEN_TICKETS)).alias("unresolved"))


def review_facts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("user_id").agg(F.avg("rating").alias("avg_review_rating"), F.count("*").alias("total_reviews"), F.count_if(F.col("rating") <= 2).alias("low_reviews"))


def with_facts(users: DataFrame, *facts: DataFrame) -> DataFrame:
    """Customers with each aggregate beside them; one exchange of user_id serves aggregate and join."""
    out = users.where(is_customer()).select("user_id")
    for fact in facts:
        out = out.join(fact, "user_id", "left")
    return out


def with_label(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """churned as 0 or 1; a user absent from the truth counts as 0."""
    label = truth.select("user_id", F.col("churned").cast("int").alias("churned"))
    return rows.join(label, "user_id", "left").withColumn("churned", F.coalesce("churned", F.lit(0)))


def with_rates(rows: DataFrame) -> DataFrame:
    """Missing counts become 0 and rates follow from them; missing averages stay null."""
    filled = rows.fillna(0, subset=list(COUNTS))
    return filled.withColumns({
        "cancellation_rate": rate("cancelled", "total_orders"),
        "unresolved_ticket_rate": rate("unresolved", "total_tickets"),
        "tickets_per_order": rate("total_tickets", "total_orders"),
        "pct_low_reviews": rate("low_reviews", "total_reviews"),
    })


def build_features(users: DataFrame, orders: DataFrame, tickets: DataFrame, reviews: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """user_id, COUNTS, FEATURES and, with a truth, churned: one row per customer."""
    rows = with_rates(with_facts(users, order_facts(orders), ticket_facts(tickets), review_facts(reviews)))
    columns = ["user_id", *COUNTS, *FEATURES]
    return rows.select(*columns) if truth is None else with_label(rows.select(*columns), truth)


def profile(users: DataFrame, orders: DataFrame, tickets: DataFrame, reviews: DataFrame, trend: DataFrame | None = None) -> DataFrame:
    """user_id, full_name, COUNTS, FEATURES and what verdicts ask besides (bad_tickets, worst_rating, and with a login trend
    its counts): every aggregate of a customer from one pass over each fact table."""
    by = [F.count("*").alias("total_tickets"), F.count_if(F.col("status").isin(*OPEN_TICKETS)).alias("unresolved"), F.count_if(is_bad_ticket()).alias("bad_tickets")]
    of_reviews = [F.avg("rating").alias("avg_review_rating"), F.count("*").alias("total_reviews"), F.count_if(F.col("rating") <= 2).alias("low_reviews"), F.min("rating").alias("worst_rating")]
    facts = [order_facts(orders), tickets.groupBy("user_id").agg(*by), reviews.groupBy("user_id").agg(*of_reviews), *([] if trend is None else [trend])]
    out = users.where(is_customer()).select("user_id", "full_name")
    for fact in facts:
        out = out.join(fact, "user_id", "left")
    return with_rates(out)


def group_means(features: DataFrame) -> DataFrame:
    """feature, mean for churned and for the others: means over users, missing ones left out."""
    return features.unpivot(["churned"], list(FEATURES), "feature", "value").groupBy("feature").agg(
        F.avg(F.when(F.col("churned") == 1, F.col("value"))).alias("mean_churned"), F.avg(F.when(F.col("churned") == 0, F.col("value"))).alias("mean_active")
    )
