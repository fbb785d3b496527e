"""The login trend from a table of daily counts: closed days come from the roll-up, only the days on the borders from the log."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.functions.columns import days_before, moment
from keepwell.sources.shared import exists


def merge_days(days: DataFrame, path: str) -> None:
    """Put closed days (user_id, day, logins) into the roll-up, a folder for each day. A day that comes again takes the place
    of its folder alone, so a replay changes nothing."""
    spark = days.sparkSession
    laid = days.groupBy("user_id", F.date_format("day", "yyyy-MM-dd").alias("of_day")).agg(F.sum("logins").alias("logins"))
    laid.repartition("of_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of_day").parquet(path)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """user_id, logins, of_day; no roll-up yet is an empty one."""
    schema = "user_id long, logins long, of_day string"
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def closed_until(days: DataFrame) -> date | None:
    """The last day of the roll-up. A stream gives days out once its watermark has passed them, so all before are closed."""
    last = days.agg(F.max("of_day")).first()[0]
    return None if last is None else date.fromisoformat(last)


def trend_from_days(days: DataFrame, log: DataFrame, as_of: datetime, earlier: int = 60, recent: int = 30, closed: date | None = None) -> DataFrame:
    """The rows of activity.login_trend. log: event_type, event_timestamp and of_day, which names the folder of a row.

    Whole days between the borders, and whole closed days after the second one, are sums of the roll-up. The first day, if
    the window begins within it, the day of the second border, on whose very moment a login counts twice, and days not
    yet closed are counted from the log.
    """
    start, border = as_of - timedelta(days=earlier), as_of - timedelta(days=recent)
    closed = closed_until(days) if closed is None else closed
    text = lambda d: F.lit(d.isoformat())
    day, first = F.col("of_day"), start.date() if start.time() == time() else start.date() + timedelta(days=1)
    whole = (day >= text(first)) & (day != text(border.date())) & (day <= text(closed or date.min))
    summed = days.where(whole).select("user_id", F.when(day < text(border.date()), F.col("logins")).otherwise(0).alias("prev"), F.when(day > text(border.date()), F.col("logins")).otherwise(0).alias("recent"))
    open_days = (day == text(border.date())) | ((day > text(closed or date.min)) & (day < "none"))
    raw_days = open_days if first == start.date() else open_days | (day == text(start.date()))
    at = F.col("event_timestamp")
    raw = log.where(raw_days & (F.col("event_type") == "LOGIN") & (at >= moment(start)))
    border_at = days_before(as_of, recent)
    counted = raw.select("user_id", (at <= border_at).cast("long").alias("prev"), (at >= border_at).cast("long").alias("recent"))
    both = summed.unionByName(counted).groupBy("user_id").agg(F.sum("prev").alias("logins_prev"), F.sum("recent").alias("logins_recent"))
    return both
