"""Rows arriving more than once: the first of each key passes, what comes too late is set aside.

For each key the time it was last seen lies in a table of versions. A batch meets only the recent ones, and a base drops the
others, so what is kept is bounded by the keys of twice the lateness. All of it is DataFrame work on one batch at a time;
a replayed batch reads what earlier batches left and overwrites its own folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from keepwell.functions.columns import moment
from keepwell.streaming.versions import current, put, rebase

#: Keys of a batch that are broadcast at most to cut the kept ones down; a batch of more meets them in a shuffle.
MOST_BROADCAST = 250_000


def first_of_each(path: str, key: Sequence[str], at: str, late: timedelta, ties: Sequence[str] = (), compact_every: int = 8) -> Callable[[DataFrame, int], None]:
    """For foreachBatch. Under path: out (rows that pass, a folder for each batch), dead (rows set aside, with a reason) and
    seen (keys with the time they were last seen).

    A row passes unless one of its key was seen within ``late`` (a day at least) before it; of rows at one time the first by
    ties passes. A row more than ``late`` behind the newest one of earlier batches is set aside as late, one without a time as
    timeless. Rows with a part of the key missing are no duplicates of one another and pass, and do not move the clock.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    day, last, row = "__day", "__last", "__row"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        kept = ", ".join([*(f"`{c}` {batch.schema[c].dataType.simpleString()}" for c in key), f"{last} {batch.schema[at].dataType.simpleString()}"])
        seen = current(spark, f"{path}/seen", kept, batch_id).groupBy(*key).agg(F.max(last).alias(last))
        newest = seen.agg(F.max(last)).first()[0]
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            behind = F.lit(False) if newest is None else F.col(at) < moment(newest - late)
            reason = F.when(F.col(at).isNull(), "timeless").when(behind, "late")
            batch.where(reason.isNotNull()).withColumn("reason", reason).write.mode("overwrite").parquet(f"{path}/dead/batch={batch_id}")
            timely = batch.where(reason.isNull())
            others = [c for c in columns if c not in key and c != at and c not in ties]
            # a row for each key and day, so a key of very many rows has no more than days in the window
            days = timely.where(whole).groupBy(*key, F.to_date(at).alias(day)).agg(F.min(F.struct(at, *ties, *others)).alias(row), F.max(at).alias(last))
            before = F.lag(last).over(Window.partitionBy(*key).orderBy(day))
            first = days.withColumn("__before", before).where(F.col("__before").isNull() | (F.col(f"{row}.{at}") > F.col("__before") + F.lit(late)))
            if newest is not None:
                recent = seen.where(F.col(last) >= moment(newest - 2 * late)).withColumnRenamed(last, "__seen")
                if first.count() <= MOST_BROADCAST:
                    recent = recent.join(F.broadcast(first.select(*key).distinct()), list(key), "left_semi")
                first = first.join(recent, list(key), "left").where(F.col("__seen").isNull() | (F.col(f"{row}.{at}") > F.col("__seen") + F.lit(late)))
            first.select(*key, f"{row}.*").select(*columns).unionByName(timely.where(~whole)).write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")
            put(timely.where(whole).groupBy(*key).agg(F.max(at).alias(last)), f"{path}/seen", batch_id)
        finally:
            batch.unpersist()
        if (batch_id + 1) % compact_every == 0:
            now = current(spark, f"{path}/seen", kept, batch_id + 1).groupBy(*key).agg(F.max(last).alias(last))
            newest = now.agg(F.max(last)).first()[0]
            rebase(now if newest is None else now.where(F.col(last) >= moment(newest - 2 * late)), f"{path}/seen", batch_id)

    return write


def run_first_of_each(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str], at: str, late: timedelta, ties: Sequence[str] = (), compact_every: int = 8) -> StreamingQuery:
    """Take in all there is and stop."""
    query = stream.writeStream.foreachBatch(first_of_each(path, key, at, late, ties, compact_every)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def passed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that passed."""
    return spark.read.schema(schema).parquet(f"{path}/out/batch=*")


def set_aside(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that did not, with their reason."""
    return spark.read.schema(f"{schema}, reason string").parquet(f"{path}/dead/batch=*")
