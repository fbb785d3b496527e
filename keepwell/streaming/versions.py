"""Tables that micro-batches keep up to date: a base, and the batches since.

Each batch writes a folder of its own, which a replay overwrites. Every so many batches all is merged into a base; a base
counts once it is whole, which its _SUCCESS file says, so readers move over to it at once. What a base replaces is deleted
when the next base is whole: a reader that began before has until then.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from keepwell.sources.shared import children, exists, remove


def put(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/kind=delta/batch={batch}")


def _batches(spark: SparkSession, path: str, kind: str) -> list[int]:
    found = [int(m[1]) for x in children(spark, f"{path}/kind={kind}") if (m := re.fullmatch(r"batch=(\d+)", x))]
    return sorted(b for b in found if exists(spark, f"{path}/kind={kind}/batch={b}/_SUCCESS"))


def current(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of the last base and of the batches since, with their kind and batch. before: what that batch and later ones
    wrote is not read, so a replay sees what was there at first."""
    bases, deltas = ([b for b in _batches(spark, path, kind) if before is None or b < before] for kind in ("base", "delta"))
    folders = [f"{path}/kind=base/batch={b}" for b in bases[-1:]] + [f"{path}/kind=delta/batch={d}" for d in deltas if not bases or d > bases[-1]]
    schema = f"{schema}, kind string, batch long"
    return spark.read.schema(schema).option("basePath", path).parquet(*folders) if folders else spark.createDataFrame([], schema)


def rebase(rows: DataFrame, path: str, batch: int) -> None:
    """Write the base that stands for all up to a batch, and delete what the base before it had replaced."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/kind=base/batch={batch}")
    older = [b for b in _batches(spark, path, "base") if b < batch]
    for last in older[-1:]:
        for b in older[:-1]:
            remove(spark, f"{path}/kind=base/batch={b}")
        for d in _batches(spark, path, "delta"):
            if d <= last:
                remove(spark, f"{path}/kind=delta/batch={d}")
