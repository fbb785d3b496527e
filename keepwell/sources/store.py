"""Facts laid out for the jobs that read them: bucketed by user, and those with a time in a folder for each day, month or year.

All tables of a store have the same number of buckets, so aggregates and joins by user need no exchange, and a window of
time reads the folders of that time alone. The files are plain Parquet under one root; a session learns of them by
``open_table``, which reads the layout that was written beside them. A user's rows lie in one bucket, so a user with very
many rows makes one long task, which aggregates as it reads and shuffles nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from keepwell.sources.shared import exists, remove

BUCKETS = 64
#: Lengths of time that a folder may hold: the column that names it, and its form. Text keeps the order of time.
GRAINS = {"day": ("of_day", "yyyy-MM-dd"), "month": ("of_month", "yyyy-MM"), "year": ("of_year", "yyyy")}
#: The folder of rows without a time; it comes after all others.
TIMELESS = "none"
LAYOUT = "columns string, key string, at string, grain string, buckets int"


def folder_of(at: str, grain: str) -> Column:
    return F.coalesce(F.date_format(at, GRAINS[grain][1]), F.lit(TIMELESS))


def _name(root: str, table: str) -> str:
    return f"store_{hashlib.md5(root.rstrip('/').encode()).hexdigest()[:12]}_{table}"


def _layout(spark: SparkSession, root: str, table: str) -> Row:
    return spark.read.schema(LAYOUT).json(f"{root}/_layout/{table}").first()


def write_table(rows: DataFrame, root: str, table: str, key: str = "user_id", at: str | None = None, grain: str = "day", buckets: int = BUCKETS) -> DataFrame:
    """Write a table of the store anew and give it back as its readers see it. at: the time that names a row's folder, in
    the form of grain. Rows are dealt by key as the buckets are, so each bucket of a folder is one file."""
    spark, name = rows.sparkSession, _name(root, table)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in (f"{root}/{table}", f"{root}/_layout/{table}"):
        if exists(spark, path):
            remove(spark, path)
    laid = rows if at is None else rows.withColumn(GRAINS[grain][0], folder_of(at, grain))
    writer = laid.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{table}")
    (writer if at is None else writer.partitionBy(GRAINS[grain][0])).saveAsTable(name)
    layout = [(", ".join(f"`{c}` {t}" for c, t in laid.dtypes), key, at, grain, buckets)]
    spark.createDataFrame(layout, LAYOUT).coalesce(1).write.mode("overwrite").json(f"{root}/_layout/{table}")
    return open_table(spark, root, table)


def open_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the store. A session that has not met it learns its columns, buckets and folders from the files."""
    name = _name(root, table)
    if not spark.catalog.tableExists(name):
        layout = _layout(spark, root, table)
        folders = f"PARTITIONED BY ({GRAINS[layout['grain']][0]})" if layout["at"] else ""
        spark.sql(f"CREATE TABLE {name} ({layout['columns']}) USING parquet {folders} CLUSTERED BY ({layout['key']}) SORTED BY ({layout['key']}) INTO {layout['buckets']} BUCKETS LOCATION '{root}/{table}'")
        if layout["at"]:
            spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def add_rows(rows: DataFrame, root: str, table: str) -> DataFrame:
    """Rows that arrived later, added to their buckets and folders."""
    spark = rows.sparkSession
    open_table(spark, root, table)
    layout = _layout(spark, root, table)
    laid = rows if layout["at"] is None else rows.withColumn(GRAINS[layout["grain"]][0], folder_of(layout["at"], layout["grain"]))
    writer = laid.repartition(layout["buckets"], layout["key"]).write.mode("append").format("parquet").bucketBy(layout["buckets"], layout["key"]).sortBy(layout["key"])
    (writer if layout["at"] is None else writer.partitionBy(GRAINS[layout["grain"]][0])).saveAsTable(_name(root, table))
    return spark.table(_name(root, table))


def in_folders(rows: DataFrame, first: str, last: str | None = None) -> DataFrame:
    """Rows of the folders from first to last, both included; others are not read. Rows without a time lie in none."""
    folder = F.col(next(column for column, _ in GRAINS.values() if column in rows.columns))
    return rows.where((folder >= first) & (folder <= last if last else folder < TIMELESS))


def forget(spark: SparkSession, root: str, table: str) -> None:
    """Take a table out of the session's catalog; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_name(root, table)}")
