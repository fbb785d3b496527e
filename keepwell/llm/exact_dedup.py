"""Exact duplicates: heavy hitters are settled map-side, the other digests through an ordinary shuffle.

Built from DataFrame and SQL functions alone. Texts are equal when identical after lower-casing A-Z, whole however long;
null counts as empty. Of equal texts the document with the largest id stays. Rows that repeat both id and text are one
document and share its verdict, and where rows are dropped only one of them is left, the one whose columns come first as
JSON. A null id loses against any other, and an empty table gives an empty result. Further columns are never read but for
that, and are taken from their table, so any names may occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.cluster import MOST_BROADCAST, materialize, without
from keepwell.llm.textcols import ascii_lower

#: Counters of the frequent-items sketch, and candidates that are verified and broadcast at most (400 KB). The sketch may be
#: off by 3.5 / 8192 of the rows, so each digest with more than about one row in 2000 is among the candidates.
TRACKED = HOT = 4096


def digest(text: Column) -> Column:
    """Lower-case hex of the normalised text's SHA-256."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    A frequent-items sketch (a Misra-Gries summary, merged over the tasks) proposes at most ``hot`` digests. Their exact
    winners come from a pre-aggregated count and are broadcast, so the copies of a hot text are never shuffled. With the
    defaults no other digest has more than one row in 2000, and those meet in an ordinary shuffle of ids and digests.
    """
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256")), "digests")
    proposed = rows.agg(F.expr(f"approx_top_k(text_sha256, {hot}, {tracked})").alias("top")).select(F.explode("top").alias("t"))
    candidates = F.broadcast(proposed.select(F.col("t.item").alias("text_sha256")))
    winners = (
        rows.join(candidates, "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    winners = materialize(winners, "winners")  # hot rows at most
    settled = rows.join(F.broadcast(winners), "text_sha256")
    same = Window.partitionBy("text_sha256")
    others = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").select(
        "text_sha256", "doc_id", F.max("doc_id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size")
    )
    return settled.select(*others.columns).unionByName(others).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns, each document once.

    Ids and digests of what goes are broadcast up to a size, so texts are not shuffled. Rows that repeat a document are
    a table of their own; only these are gathered, pre-aggregated to one row for each document.
    """
    marks = mark_copies(docs, id_col, text_col).groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1")
    marks = materialize(marks.select("doc_id", "text_sha256", "kept"), "marks")
    meets = lambda table: docs[id_col].eqNullSafe(table["doc_id"]) & (digest(docs[text_col]) == table["text_sha256"])
    once = without(docs, marks, meets(marks))
    repeated = marks.where("kept")
    n = repeated.count()
    if n == 0:
        return once
    of = F.broadcast(repeated) if n <= MOST_BROADCAST else repeated
    rows = docs.join(of, meets(of)).select(of["doc_id"], of["text_sha256"], F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return once.unionAll(rows.groupBy("doc_id", "text_sha256").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))


def query(spark, sf_dir):
    return mark_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), m AS (
  SELECT doc_id, text_sha256, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM m
"""
