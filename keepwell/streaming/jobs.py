"""Streams of arriving rows: the same results as the batch jobs, kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from keepwell.streaming.versions import current, put, rebase

REVIEW_KEY = ["user_id", "product_id", "order_id"]


def read_stream(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def with_event_time(stream: DataFrame, column: str, late: str) -> DataFrame:
    """A watermark wants an instant; naive times are taken as UTC by a session in UTC."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def daily_logins(log: DataFrame, late: str = "1 day") -> DataFrame:
    """user_id, day, logins by day and user, from logins alone; rows later than the watermark are dropped. In append mode a
    day is given out once the watermark has passed it, so state is bounded by the users of a day or two."""
    logins = with_event_time(log.where(F.col("event_type") == "LOGIN"), "event_timestamp", late)
    counted = logins.groupBy(F.window("event_timestamp", "1 day"), "user_id").agg(F.count("*").alias("logins"))
    return counted.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("day"), "logins")


def running_orders(orders: DataFrame) -> DataFrame:
    """user_id, last_order, total_orders so far, for update mode. State grows with the users; run_upserts keeps it in RocksDB."""
    return orders.groupBy("user_id").agg(F.max("placed_at").alias("last_order"), F.count("*").alias("total_orders"))


def first_reviews(reviews: DataFrame, late: str = "1 day") -> DataFrame:
    """Reviews whose key has not been seen within the watermark. Those without an order are no duplicates of one another
    and pass by."""
    timed = with_event_time(reviews, "created_at", late)
    keyed = timed.where(F.col("order_id").isNotNull()).dropDuplicatesWithinWatermark(REVIEW_KEY)
    return keyed.unionByName(timed.where(F.col("order_id").isNull()))


def upsert_parquet(path: str, key: str, compact_every: int = 8) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch of updates is a folder of its own, which a replay overwrites. Every compact_every batches
    all rows so far are merged into a base, so readers meet one base and a few batches; what it replaces goes with the
    base after it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        put(batch, path, batch_id)
        if (batch_id + 1) % compact_every == 0:
            schema = ", ".join(f"`{c}` {t}" for c, t in batch.dtypes)
            rebase(latest(batch.sparkSession, path, key, schema, batch_id + 1), path, batch_id)

    return write


def latest(spark: SparkSession, path: str, key: str, schema: str, before: int | None = None) -> DataFrame:
    """What upserts left of each key: its row of the last batch. before: what that batch and later ones wrote is not read."""
    rows = current(spark, path, schema, before)
    columns = [c for c in rows.columns if c not in (key, "batch", "kind")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select(key, "r.*")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, off the heap and on disk, with a log of changes as its
    checkpoint, so state may outgrow memory. A stream remembers its store; the session's own settings return."""
    settings = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "rocksdb.changelogCheckpointing.enabled": "true"}
    settings = {f"spark.sql.streaming.stateStore.{k}": v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take in all there is, write it as Parquet and stop."""
    with keyed_state(stream.sparkSession):
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_upserts(stream: DataFrame, path: str, checkpoint: str, key: str, compact_every: int = 8) -> StreamingQuery:
    with keyed_state(stream.sparkSession):
        query = stream.writeStream.outputMode("update").foreachBatch(upsert_parquet(path, key, compact_every)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
