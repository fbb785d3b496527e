import hashlib
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keepwell.llm import cluster, fim
from tests.llm.conftest import LONG

TEXTS = [None, "", " ", "a", " a", "a ", " \n\ta\x0b b\r\r", "ÿ é x  y", "<P> marked", "a<S", "P>b c", "< P >", "x<", "\u0000 zero \u0000", "one two three four five six", "<M", LONG, "w " * 50_000]


def plainly(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, len(units), "plain", None, None, text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    return (doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_against_a_plain_version(spark):
    """Every text under many ids, so that each comes in every form; a null id, and repeated rows."""
    rows = [(i, t) for i in range(40) for t in TEXTS] + [(None, t) for t in TEXTS] + [(1, "again and again")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n", "form", "output", "h0", "h1", "prefix_chars")})
    made = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((plainly(*r) for r in rows), key=key)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert sorted((str(r["doc_id"]), r["back"]) for r in made) == sorted((str(i), t or "") for i, t in rows)


def test_odd_and_no_documents(odd_docs, no_docs):
    assert fim.transform(odd_docs).count() == odd_docs.count()
    assert fim.transform(no_docs).collect() == []


@pytest.mark.parametrize("cut_percent, spm_percent, forms", [(0, 80, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})])
def test_shares(spark, cut_percent, spm_percent, forms):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    assert {r["form"] for r in fim.transform(docs, cut_percent=cut_percent, spm_percent=spm_percent).collect()} == forms


def test_no_shuffle(spark, data):
    plan = fim.query(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_batches_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_pydict({"text": ["aa", None, "b" * 50, "", "cc", "dd"]})
    parts = list(cluster.by_bytes(iter([batch, batch.slice(0, 0)]), "text", 4))
    assert [p.column(0).to_pylist() for p in parts] == [["aa", None], ["b" * 50], ["", "cc", "dd"]]
