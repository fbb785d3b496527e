"""Training rows of the two tree models: statistics of a bounded, repeatable sample of labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.llm.cluster import python_ready, small
from keepwell.llm.docstats import NAMES, features, stats

#: Labelled documents that a model is fitted on at most: those whose ids hash lowest.
SAMPLE = 20_000


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and the counts of docstats.NAMES as longs."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = np.array([stats(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, i]) for i in range(len(NAMES))]], names=["doc_id", *NAMES])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in NAMES))


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(features, quality) of at most ``sample`` labelled documents. usable: a condition on labels.doc_id.

    Labels without id or quality are left out, of repeated ones the lowest counts, and of repeated documents the one with
    the lowest statistics.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    rows = rows if usable is None else rows.where(usable)
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = F.broadcast(rows.select("doc_id", F.col("quality").cast("int").alias("quality")))  # sample rows at most
    ids = chosen.select(F.col("doc_id").alias("labelled"))
    one = with_stats(docs.join(ids, docs["doc_id"] == ids["labelled"], "left_semi")).groupBy("doc_id").agg(F.min(F.struct(*NAMES)).alias("s"))
    got = one.join(chosen, "doc_id").select("doc_id", "s.*", "quality").orderBy("doc_id").collect()
    x = features([list(r[1:-1]) for r in got])
    return x, np.array([r[-1] for r in got], np.float64)
