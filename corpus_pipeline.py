"""From raw documents to training tokens in five stages, each of which works on all that the one before it kept.

Every stage is written as Parquet to the shared folder and read back as the next one's documents; once that one is written,
it is deleted. In all stages null texts
count as empty, whole texts are worked on however long, other columns pass unread, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keepwell.llm import bpe, exact_dedup, jaccard, mixing, quality_classifier
from keepwell.llm.cluster import materialize, read, temporary
from keepwell.sources.shared import new_path, remove

#: Near copies share at least this many percent of their shingles of so many words.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; a score on the threshold does, empty texts are scored like others, and
    repeated rows stay or go together."""
    return quality_classifier.keep_good(docs, quality_classifier.fit_classifier(docs, read(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; of rows that repeat id and text one is left, the first by its columns. Empty
    texts are equal, and a null id loses against any other."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of near copies join, the one with the least id. Empty texts and rows without id all stay."""
    return jaccard.keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT, 100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, a row for each copy. A null source is one of its own, rows that
    share an id are taken equally often, and of equal quotients the earlier source or shard takes the seat."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether they decode to its text; an empty text has none."""
    return bpe.encode_checked(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact_copies), ("ngram_jaccard", near_copies), ("mixing", mix), ("bpe", encode)]

#: The first stage is a fitted model, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with temporary(spark) as keep:  # what a stage writes on its way goes once its result is written
            docs = keep(materialize(stage(spark, docs, sf_dir), name, path))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
