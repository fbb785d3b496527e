"""Verdicts by rule: what tickets and reviews say, the level of risk, and what to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.functions.columns import is_bad_ticket, redact
from keepwell.operators.ranks import with_running
from keepwell.sources.shared import settle

#: Facts of a user that one window takes, and users that may have more: these are broadcast.
HOT_FACTS, HOT_USERS = 500_000, 100_000
#: Facts of a task where places are given and dossiers are made, about; so its memory doesn't grow with the input.
TASK_FACTS = 200_000
TICKET_COLUMNS = ("category", "priority", "status", "created_at")
REVIEW_COLUMNS = ("rating", "created_at")


def ticket_signal_of(n: Column, bad: Column) -> Column:
    """NONE without tickets, UNHAPPY with a bad one, else FINE."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, "NONE").when(bad > 0, "UNHAPPY").otherwise("FINE")


def review_signal_of(worst: Column, negative: Column | None = None) -> Column:
    """SILENT without reviews, UNHAPPY with a rating of 2 or less or a negative word, else FINE."""
    unhappy = (worst <= 2) if negative is None else (worst <= 2) | negative
    return F.when(worst.isNull(), "SILENT").when(unhappy, "UNHAPPY").otherwise("FINE")


def ticket_signal(users: DataFrame, tickets: DataFrame) -> DataFrame:
    """user_id, ticket_signal."""
    by = tickets.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(is_bad_ticket()).alias("bad"))
    return users.select("user_id").join(by, "user_id", "left").select("user_id", ticket_signal_of(F.col("n"), F.col("bad")).alias("ticket_signal"))


def review_signal(users: DataFrame, reviews: DataFrame, negative_words: str | None = None, text: str = "review_text") -> DataFrame:
    """user_id, review_signal; negative_words is a pattern that a review's text may match."""
    said = F.max(F.col(text).rlike(negative_words)) if negative_words else F.lit(False)
    by = reviews.groupBy("user_id").agg(F.min("rating").alias("worst"), said.alias("negative"))
    return users.select("user_id").join(by, "user_id", "left").select("user_id", review_signal_of(F.col("worst"), F.coalesce("negative", F.lit(False))).alias("review_signal"))


def risk_levels(rows: DataFrame, cut: float = 0.5) -> DataFrame:
    """risk_level from churn_probability and both signals, and suggested_action from it."""
    likely = F.col("churn_probability") >= cut
    unhappy = (F.col("ticket_signal") == "UNHAPPY") | (F.col("review_signal") == "UNHAPPY")
    level = F.when(likely & (unhappy | (F.col("review_signal") == "SILENT")), "HIGH").when(~likely & unhappy, "MEDIUM").otherwise("LOW")
    return with_action(rows.withColumn("risk_level", level))


def with_action(rows: DataFrame, level: str = "risk_level") -> DataFrame:
    action = F.when(F.col(level) == "HIGH", "retention call").when(F.col(level) == "MEDIUM", "send coupon").otherwise("ignore")
    return rows.withColumn("suggested_action", action)


def criticise(rows: DataFrame, activity: float = 0.8, good_rating: int = 4) -> DataFrame:
    """revised_level: one lower where logins hold up, or where there are no tickets and only good reviews."""
    holds = (F.col("logins_prev_30_60d") > 0) & (F.col("logins_recent_30d") >= activity * F.col("logins_prev_30_60d"))
    benign = (F.col("total_tickets") == 0) & (F.col("worst_review_rating") >= good_rating)
    lower = F.when(F.col("risk_level") == "HIGH", "MEDIUM").otherwise("LOW")
    return rows.withColumn("revised_level", F.when(holds | benign, lower).otherwise(F.col("risk_level")))


def newest_first(facts: DataFrame, ties: list[str], most: int | None = None, hot: int = HOT_FACTS) -> DataFrame:
    """Facts with their place, the newest of each user first; facts without a user have none. most keeps that many of each
    user, in a window that is cut before it is shuffled.

    Places come from a window of each user. Users of more than ``hot`` facts, few by that bound, are told apart by counts
    and get theirs from running totals, which spread a user over tasks; the places are the same.
    """
    order = [F.desc("created_at"), *[F.col(c) for c in ties]]
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    if most is not None:
        return facts.withColumn("place", place).where(F.col("place") <= most)
    facts = facts.where(F.col("user_id").isNotNull())
    sizes = facts.groupBy("user_id").agg(F.count("*").alias("n"))
    n, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    hot = max(hot, n // HOT_USERS)  # no more than HOT_USERS users have more
    tasks = max(-(-n // TASK_FACTS), min(facts.sparkSession.sparkContext.defaultParallelism, -(-n // 10_000)), 1)
    if largest <= hot:
        return facts.repartition(tasks, "user_id").withColumn("place", place)
    users = settle(sizes.where(F.col("n") > hot).select("user_id"), "hot")
    ran = with_running(facts.join(F.broadcast(users), "user_id", "left_semi").withColumn("one", F.lit(1)), ["user_id"], order, ["one"])
    ran = ran.withColumn("place", (F.col("one_before") + 1).cast("int")).drop("one", "one_before")
    return facts.join(F.broadcast(users), "user_id", "left_anti").repartition(tasks, "user_id").withColumn("place", place).unionByName(ran)


def of_users(facts: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """The facts of some users, with the named columns and no contact data."""
    return facts.join(ids.select("user_id").distinct(), "user_id", "left_semi").select("user_id", *columns)


def dossiers(ids: DataFrame, tickets: DataFrame, reviews: DataFrame, ticket_columns: list[str], review_columns: list[str], ties: tuple[list[str], list[str]], part: int = 20, texts: tuple[str, ...] = ()) -> DataFrame:
    """user_id, part (from 1), tickets, reviews: all facts of each user as JSON arrays, the newest first, with personal data
    in texts redacted. A part holds at most ``part`` facts of a kind, so no row grows with a user's facts; a user without
    facts has one part."""
    asked = ids.select("user_id").distinct()
    out = asked.withColumn("part", F.lit(1))
    for name, table, columns, tie in (("tickets", tickets, ticket_columns, ties[0]), ("reviews", reviews, review_columns, ties[1])):
        placed = newest_first(of_users(table, asked, sorted({*columns, *tie, "created_at"})), tie)
        shown = F.struct("place", *[(redact(F.col(c)) if c in texts else F.col(c)).alias(c) for c in columns])
        number = F.floor((F.col("place") - 1) / part).cast("int") + 1
        gathered = placed.groupBy("user_id", number.alias("part")).agg(F.array_sort(F.collect_list(shown)).alias(name))
        out = out.join(gathered, ["user_id", "part"], "full")
    return out.select("user_id", "part", *[F.coalesce(F.to_json(c), F.lit("[]")).alias(c) for c in ("tickets", "reviews")])
