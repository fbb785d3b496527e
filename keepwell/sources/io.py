"""Sources and sinks: tables, labels, predictions, the contact log, ranked lists, reports and models."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.schemas import CONTACTS, PREDICTIONS, TABLES, TRUTH
from keepwell.sources.shared import children, exists, remove


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the six tables; columns that a job does not use never leave the files."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def read_table_jdbc(spark: SparkSession, url: str, name: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """The same over JDBC, in ranges read side by side: of user_id, or of a table's own key where it has no users. Rows
    outside lower and upper fall to the first and the last range."""
    key = "user_id" if "user_id long" in TABLES[name] else TABLES[name].split(" ", 1)[0]
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=parts, **options).load()


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """The answer key, a JSON array."""
    return spark.read.schema(TRUTH).json(path, multiLine=True)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Verdicts with their nested evidence: a JSON array, an object {"assessments": [...]}, or one verdict per line."""
    plain = spark.read.schema(f"{PREDICTIONS}, assessments array<struct<{_as_struct(PREDICTIONS)}>>").json(path, multiLine=True)
    own = [c for c in plain.columns if c != "assessments"]
    inner = plain.where(F.col("assessments").isNotNull()).select(F.explode("assessments").alias("a")).select("a.*")
    return plain.where(F.col("assessments").isNull()).select(*own).unionByName(inner)


def _as_struct(ddl: str) -> str:
    """A column list as the inside of struct<>; commas of nested types have no space after them."""
    return ",".join(c.replace(" ", ":", 1) for c in ddl.split(", "))


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("overwrite").json(path)


def _snapshots(spark: SparkSession, path: str) -> list[str]:
    """Days of the whole snapshots of a contact log."""
    found = [x.removeprefix("upto=") for x in children(spark, f"{path}/_snapshots")]
    return [d for d in found if exists(spark, f"{path}/_snapshots/upto={d}/_SUCCESS")]


def read_contacts(spark: SparkSession, path: str) -> DataFrame:
    """The contact log: its last whole snapshot and the days after it. None written yet is an empty one."""
    days = [x for x in children(spark, path) if x.startswith("run_date=")]
    upto = _snapshots(spark, path)[-1:]
    later = [f"{path}/{d}" for d in days if not upto or d.removeprefix("run_date=") > upto[0]]
    read = spark.read.schema("user_id long, contacted_on date")
    parts = [read.parquet(f"{path}/_snapshots/upto={d}") for d in upto] + ([read.parquet(*later)] if later else [])
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], CONTACTS)


def contacts_from_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """A contact log kept as a JSON map from id to date."""
    pairs = texts.select(F.explode(F.from_json(column, "map<string,string>")).alias("user_id", "contacted_on"))
    return pairs.select(F.col("user_id").cast("long").alias("user_id"), F.to_date("contacted_on").alias("contacted_on"))


def append_contacts(contacts: DataFrame, path: str) -> None:
    """The log only grows, a folder for each day; readers take the last date of an id. What comes for a day that a snapshot
    holds already goes to the folder of the day after it. Contacts without a date are left out. One writer at a time."""
    upto = _snapshots(contacts.sparkSession, path)[-1:]
    day = F.col("contacted_on") if not upto else F.greatest("contacted_on", F.date_add(F.lit(upto[0]).cast("date"), 1))
    contacts.where(F.col("contacted_on").isNotNull()).withColumn("run_date", day).write.mode("append").partitionBy("run_date").parquet(path)


def compact_contacts(spark: SparkSession, path: str) -> None:
    """Merge the log into a snapshot with the last date of each user, while no writer appends.

    A snapshot counts once it is whole, so a reader sees one whole state or the other. What the snapshot replaces stays until
    the next one is whole, for readers that began before; what the last one replaced is deleted now.
    """
    days = [x.removeprefix("run_date=") for x in children(spark, path) if x.startswith("run_date=")]
    before = _snapshots(spark, path)
    if not days or (before and max(days) <= before[-1]):
        return
    merged = read_contacts(spark, path).groupBy("user_id").agg(F.max("contacted_on").alias("contacted_on"))
    merged.write.mode("overwrite").parquet(f"{path}/_snapshots/upto={max(days)}")
    for last in before[-1:]:
        for d in days:
            if d <= last:
                remove(spark, f"{path}/run_date={d}")
        for d in before[:-1]:
            remove(spark, f"{path}/_snapshots/upto={d}")


def as_json_documents(rows: DataFrame) -> DataFrame:
    """One JSON document for each row, in a column named document."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("document"))


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines, ordered by rank, as text."""
    lines.orderBy("rank").select("line").coalesce(1).write.mode("overwrite").text(path)


def save_model(model: PipelineModel, path: str) -> None:
    """A model with its list of features, which the assembler holds in order."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
