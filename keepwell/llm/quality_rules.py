"""Quality rules: fixed rules on document statistics, then a verdict of boosted trees with monotonic constraints.

A text fails the base rules with fewer than ``LEAST_WORDS`` words or with over ``REPEAT_PERCENT`` percent of them in
repeated windows. Of the others the trees decide: they are fitted on a bounded sample of labels, and may only lower the
score as symbols, repeated lines, repeated windows, capitals, digits or exclamation marks grow.

Null texts count as empty and fail; whole texts count however long; without labels the trees keep all; of repeated labels
the lowest counts; repeated rows give repeated results and an empty table an empty one. Only id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm import gbt
from keepwell.llm.cluster import python_ready, small
from keepwell.llm.docstats import FEATURES, NAMES, features, stats
from keepwell.llm.labelled import SAMPLE, training_rows

LEAST_WORDS, REPEAT_PERCENT = 20, 30
THRESHOLD = 0.3
FALLING = ("symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "bangs_per_word", "digit_share")
RULE_FEATURES = ("log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "words_per_line", "upper_share", "digit_share", "stops_per_word", "bangs_per_word", "distinct_share", "top_word_share", "stopped_line_share")
AT = [FEATURES.index(f) for f in RULE_FEATURES]


def fit_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> gbt.FlatTrees:
    x, y = training_rows(docs, labels, sample=sample)
    return gbt.fit(x[:, AT], y, np.array([-1 if f in FALLING else 0 for f in RULE_FEATURES]), trees=60)


def judge(docs: DataFrame, model: gbt.FlatTrees, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""

    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = np.array([stats(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(NAMES))
            score = model.score(features(rows)[:, AT])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(rows[:, i]) for i in range(5)], pa.array(score, pa.float64())], names=["doc_id", *NAMES[:5], "score"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in NAMES[:5]) + ", score double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def query(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit_rules(docs, labels))
