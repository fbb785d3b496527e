"""The folder that the driver and all executors can write to."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local master gets a temporary folder, as in tests; on a
    cluster that folder would be another one on each machine, so there it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = Path(tempfile.mkdtemp(prefix="keepwell-")).as_uri()
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: what is used twice is worked out once, and survives lost executors."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that no result reads any more."""
    files, target = _at(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _at(spark, path)
    return files.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; a folder that is not there has nothing."""
    files, target = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []


def python_ready(spark: SparkSession) -> None:
    """Ship this package to the Python workers once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_keepwell_shipped", False) is False:
        root = Path(__file__).resolve().parents[2]
        target = Path(tempfile.mkdtemp(prefix="keepwell-code-")) / "keepwell_code.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted((root / "keepwell").rglob("*.py")):
                z.write(p, p.relative_to(root))
        sc.addPyFile(str(target))
        sc._keepwell_shipped = True
