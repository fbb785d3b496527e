"""Every operator and stage over odd documents and over none."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keepwell.llm import bpe, exact_dedup, gbt, jaccard, mixing, pii, ppm, quality_classifier, quality_rules, url_rules
from keepwell.llm.docstats import FEATURES

import numpy as np

FLAT = gbt.fit(np.zeros((0, len(FEATURES))), np.zeros(0))
RULES = gbt.fit(np.zeros((0, len(quality_rules.AT))), np.zeros(0))

PER_ROW = {
    "pii": lambda d: pii.find(d),
    "redact": lambda d: pii.redact(d),
    "rules": lambda d: quality_rules.judge(d, RULES),
    "lm": lambda d: ppm.score(d, ppm.is_remainder(F.col("doc_id"), 2), order=3),
    "jaccard": lambda d: jaccard.near_copies(d, 3, 90),
    "classifier": lambda d: quality_classifier.classify(d, FLAT),
    "mixing": lambda d: mixing.mix(d),
    "dedup": lambda d: exact_dedup.mark_copies(d),
    "bpe": lambda d: bpe.encode_checked(d, bpe.default_path()),
    "urls": lambda d: url_rules.judge(d, id_col="doc_id", url_col="text"),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_a_row_for_each_row(odd_docs, no_docs, name):
    rows = PER_ROW[name](odd_docs).collect()
    assert len(rows) == odd_docs.count()
    ids = "page_id" if name == "urls" else "doc_id"
    key = lambda x: (x is None, x or 0)
    assert sorted((r[ids] for r in rows), key=key) == sorted((r[0] for r in odd_docs.select("doc_id").collect()), key=key)
    assert PER_ROW[name](no_docs).collect() == []


def test_defined_results(odd_docs):
    found = {r["doc_id"]: r for r in jaccard.near_copies(odd_docs, 3, 90).collect()}
    assert found[2]["component_id"] == 1 and found[7]["component_id"] == 6 and found[4]["n_shingles"] == 0 and found[3]["component_id"] == 3 and found[9]["n_shingles"] >= 1
    assert found[None]["component_id"] is None
    copies = {r["doc_id"]: r for r in exact_dedup.mark_copies(odd_docs).collect()}
    assert copies[1]["keep_id"] == 2 and copies[1]["group_size"] == 3 and copies[2]["kept"] and not copies[1]["kept"]
    assert copies[4]["group_size"] == 3 and copies[4]["keep_id"] == 4  # null and empty texts, one of them without id
    judged = {r["doc_id"]: r for r in quality_rules.judge(odd_docs, RULES).collect()}
    assert judged[3]["n_words"] == 0 and judged[3]["base_failed"] and not judged[3]["kept"]
    assert all(r["round_trip"] for r in bpe.encode_checked(odd_docs, bpe.default_path()).collect())


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_columns(spark, odd_docs, no_docs, data, stage):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, odd_docs, no_docs):
        got = stage[1](spark, docs, data)
        assert got.columns == docs.columns
        rows = got.collect()
        assert {r["doc_id"] for r in rows} <= {r[0] for r in docs.select("doc_id").collect()}


def test_last_stage(spark, odd_docs, no_docs, data):
    assert corpus_pipeline.STAGES[-1][1](spark, odd_docs, data).count() == odd_docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, data).count() == 0


def test_the_session_keeps_its_settings(spark, data):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    quality_rules.query(spark, data).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
