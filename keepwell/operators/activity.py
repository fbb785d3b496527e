"""Logins, last orders and dormancy."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.functions.columns import days_before, is_customer
from keepwell.sources.shared import settle


def login_trend(log: DataFrame, as_of: datetime, earlier: int = 60, recent: int = 30) -> DataFrame:
    """Logins by user: prev from ``earlier`` to ``recent`` days back with both ends, recent from then on without an upper
    end, so an event on the border counts in both. One pass over the log, cut to the window at the scan."""
    start, border = days_before(as_of, earlier), days_before(as_of, recent)
    at = F.col("event_timestamp")
    logins = log.where((F.col("event_type") == "LOGIN") & (at >= start))
    return logins.groupBy("user_id").agg(F.count_if(at <= border).alias("logins_prev"), F.count_if(at >= border).alias("logins_recent"))


def with_trend(rows: DataFrame, log: DataFrame, as_of: datetime, earlier: int = 60, recent: int = 30) -> DataFrame:
    """A shortlist with its login trend, 0 without events. The log is cut to the shortlist before it is counted."""
    short = log.join(rows.select("user_id").distinct(), "user_id", "left_semi")
    trend = login_trend(short, as_of, earlier, recent)
    return rows.join(trend, "user_id", "left").fillna(0, subset=["logins_prev", "logins_recent"])


def last_orders(orders: DataFrame) -> DataFrame:
    """Cancelled orders count here too."""
    return orders.groupBy("user_id").agg(F.max("placed_at").alias("last_order"), F.count("*").alias("total_orders"))


def dormant(users: DataFrame, orders: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    """Customers whose last order lies more than ``days`` back, or who have none."""
    customers = users.where(is_customer()).select("user_id", "full_name", "city")
    rows = customers.join(last_orders(orders), "user_id", "left").fillna(0, subset=["total_orders"])
    return rows.where(F.col("last_order").isNull() | (F.col("last_order") < days_before(as_of, days)))


def without_recent_order(users: DataFrame, orders: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    """The same customers where the last order itself is not asked for: only the recent slice of orders is read."""
    recent = orders.where(F.col("placed_at") >= days_before(as_of, days)).select("user_id")
    return users.where(is_customer()).select("user_id").join(recent, "user_id", "left_anti")


def quietest(users: DataFrame, orders: DataFrame, log: DataFrame, as_of: datetime, log_as_of: datetime, days: int = 14, top_n: int = 10, earlier: int = 60, recent: int = 30) -> DataFrame:
    """The dormant customers that have been quiet longest, those without orders first, with their login trend."""
    first = settle(dormant(users, orders, as_of, days).orderBy(F.asc_nulls_first("last_order"), "user_id").limit(top_n), "quietest")
    return with_trend(first, log, log_as_of, earlier, recent)


def order_span(orders: DataFrame) -> DataFrame:
    return orders.agg(F.min("placed_at").alias("first_order"), F.max("placed_at").alias("last_order"))


def dormancy_headline(users: DataFrame, orders: DataFrame, as_of: datetime, days: int = 14) -> DataFrame:
    """How many customers there are and how many are dormant, in one row."""
    marked = users.where(is_customer()).select("user_id").join(without_recent_order(users, orders, as_of, days).select("user_id", F.lit(True).alias("dormant")), "user_id", "left")
    return marked.agg(F.count_if(F.col("dormant")).alias("dormant"), F.count("*").alias("customers"))
