"""Quality classifier: histogram gradient-boosted trees over document statistics.

Fitted on a bounded, repeatable sample of labelled documents outside the held-out fold (crc32 of the id as text modulo
``FOLDS`` is 0), flattened into arrays and scored for whole batches. Ids, languages, sources and labels are never inputs.

Null texts count as empty and are scored like any other, whole texts however long; without labels every score is one half;
of repeated labels the lowest counts; equal texts have equal scores, a score on the threshold is accepted, repeated rows
give repeated results and an empty table an empty one. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm import gbt
from keepwell.llm.cluster import python_ready, small
from keepwell.llm.docstats import features, stats
from keepwell.llm.labelled import SAMPLE, training_rows
from keepwell.llm.textcols import is_remainder

FOLDS = 5
THRESHOLD = 0.3


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> gbt.FlatTrees:
    x, y = training_rows(docs, labels, ~is_remainder(F.col("doc_id"), FOLDS), sample)
    return gbt.fit(x, y)


def classify(docs: DataFrame, model: gbt.FlatTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            score = model.score(features(stats(t or b"") for t in texts)) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", is_remainder(F.col("doc_id"), FOLDS).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: gbt.FlatTrees, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, with their own columns, in one pass."""
    python_ready(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            if texts:
                yield batch.filter(pa.array(model.score(features(stats(t or b"") for t in texts)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, fit_classifier(docs, labels))
