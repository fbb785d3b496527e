"""Table contracts as data-quality jobs: what a table must hold is counted, not enforced."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

# The allowed values of each column.
DOMAINS = {
    "users": {"user_type": ("CUSTOMER", "DELIVERY_PARTNER", "ADMIN", "SUPPORT_AGENT"), "account_status": ("ACTIVE", "INACTIVE", "SUSPENDED", "DELETED")},
    "orders": {"order_status": ("PLACED", "PACKED", "OUT_FOR_DELIVERY", "DELIVERED", "CANCELLED")},
    "auth_audit_log": {"event_type": ("LOGIN", "LOGOUT", "LOGIN_FAILED", "PASSWORD_RESET"), "event_status": ("SUCCESS", "FAILED"), "device_type": ("ANDROID", "IOS", "WEB")},
    "support_tickets": {"category": ("ORDER_ISSUE", "PAYMENT", "DELIVERY_DELAY", "PRODUCT_QUALITY", "REFUND", "APP_ISSUE", "OTHER"), "priority": ("LOW", "MEDIUM", "HIGH", "URGENT"), "status": ("OPEN", "IN_PROGRESS", "WAITING_ON_CUSTOMER", "RESOLVED", "CLOSED")},
}
# Columns that must not be missing, and the ranges of numbers.
REQUIRED = {
    "users": ("full_name", "email", "phone_number", "password_hash", "user_type", "account_status", "is_email_verified", "is_phone_verified", "created_at", "updated_at"),
    "products": ("product_name", "price", "is_active"),
    "orders": ("user_id", "order_status", "total_amount", "placed_at"),
    "auth_audit_log": ("user_id", "event_type", "event_status", "event_timestamp"),
    "support_tickets": ("user_id", "subject", "description", "category", "priority", "status", "created_at", "updated_at"),
    "reviews": ("user_id", "product_id", "rating", "is_verified_purchase", "helpful_count", "created_at"),
}
RANGES = {"reviews": {"rating": (1, 5)}}


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, rows."""
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, t in tables.items()])


def rules_of(name: str, columns: list[str], domains: Mapping[str, tuple[str, ...]] | None = None, ranges: Mapping[str, tuple[float, float]] | None = None, required: tuple[str, ...] | None = None) -> dict[str, Column]:
    """What breaks each rule of a table that its columns allow to test. A missing value breaks only a required column."""
    domains, ranges, required = (given if given is not None else known.get(name, {}) for given, known in ((domains, DOMAINS), (ranges, RANGES), (required, REQUIRED)))
    rules = {f"{c} in domain": ~F.col(c).isin(*values) for c, values in domains.items() if c in columns}
    rules |= {f"{c} in {lo}..{hi}": ~F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items() if c in columns}
    return rules | {f"{c} not null": F.col(c).isNull() for c in required if c in columns}


def violations(name: str, table: DataFrame, domains: Mapping[str, tuple[str, ...]] | None = None, ranges: Mapping[str, tuple[float, float]] | None = None, required: tuple[str, ...] | None = None) -> DataFrame:
    """table, rule, violations: one pass over the table for all its rules, its own ones unless others are given."""
    rules = rules_of(name, table.columns, domains, ranges, required)
    row = table.agg(*[F.count_if(rule).alias(f"r{i}") for i, rule in enumerate(rules.values())])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("violations")) for i, r in enumerate(rules)])
    return row.select(F.lit(name).alias("table"), F.explode(pairs).alias("p")).select("table", "p.rule", "p.violations")


class Watch:
    """Counts violations while a job reads: the tables that ``over`` gives out carry the rules with them, and once an action
    has run over all of these, ``found`` has the counts. Nothing is read for them a second time, but their columns are
    read, and filters of the job come after them."""

    def __init__(self):
        self.watched: list[tuple[str, list[str], Observation]] = []

    def over(self, name: str, table: DataFrame) -> DataFrame:
        rules, seen = rules_of(name, table.columns), Observation(f"{name}-{uuid.uuid4().hex}")
        self.watched.append((name, list(rules), seen))
        return table.observe(seen, *[F.count_if(rule).alias(f"r{i}") for i, rule in enumerate(rules.values())])

    def found(self, spark: SparkSession) -> DataFrame:
        """table, rule, violations. Waits for the counts; a table that no action has read gives none."""
        rows = [(name, rule, seen.get[f"r{i}"]) for name, rules, seen in self.watched for i, rule in enumerate(rules)]
        return spark.createDataFrame(rows, "table string, rule string, violations long")


def duplicates(table: DataFrame, *key: str) -> DataFrame:
    """key columns, n for each key that occurs more than once; keys with a missing part never equal one another."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return table.where(whole).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def first_reviews(reviews: DataFrame, order: list[str]) -> DataFrame:
    """The first review of each user, product and order; reviews without an order are all kept and stay out of the
    window, where they would meet in one task."""
    keyed = reviews.where(F.col("order_id").isNotNull())
    place = F.row_number().over(Window.partitionBy("user_id", "product_id", "order_id").orderBy(*order))
    return keyed.withColumn("__place", place).where("__place = 1").drop("__place").unionByName(reviews.where(F.col("order_id").isNull()))


def orphans(facts: DataFrame, key: str, referenced: DataFrame, to: str) -> DataFrame:
    """Facts whose key is not in the table it refers to; a missing key refers to nothing."""
    there = referenced.select(F.col(to).alias("__to")).distinct()
    return facts.where(F.col(key).isNotNull()).join(there, F.col(key) == F.col("__to"), "left_anti")


def orphan_counts(references: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """table, reference, orphans for each (name, facts, key, referenced table, its key). Facts are counted by key before they
    meet the other table, so a hot key is one row there."""

    def of(name: str, facts: DataFrame, key: str, referenced: DataFrame, to: str) -> DataFrame:
        by_key = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        lost = orphans(by_key, key, referenced, to).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
        return lost.select(F.lit(name).alias("table"), F.lit(key).alias("reference"), "orphans")

    return reduce(DataFrame.unionByName, [of(*r) for r in references])
