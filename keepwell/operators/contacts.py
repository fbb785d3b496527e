"""Who was contacted, when, and whom to leave alone."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.functions.columns import days_before


def mark_contacted(log: DataFrame, ids: DataFrame, on: date) -> DataFrame:
    """The log after contacting ids on a day: the last date of each user."""
    new = ids.select("user_id", F.lit(on.isoformat()).cast("date").alias("contacted_on"))
    return last_contacts(log.select("user_id", "contacted_on").unionByName(new))


def last_contacts(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id").agg(F.max("contacted_on").alias("contacted_on"))


def recently_contacted(log: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Users contacted within days. A contact is the midnight that begins its date."""
    return last_contacts(log).where(F.col("contacted_on").cast("timestamp_ntz") >= days_before(as_of, days)).select("user_id")


def suppress(rows: DataFrame, log: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Rows of users that may be contacted. Comes before any limit."""
    return rows.join(recently_contacted(log, as_of, days), "user_id", "left_anti")
