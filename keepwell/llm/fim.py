"""Fill-in-middle: a document cut into prefix, middle and suffix, given out in the order in which a model learns to fill gaps.

Each Arrow batch is one pipeline of pyarrow.compute kernels, without a Python step a row: every unit is followed by a byte
that UTF-8 never uses and the texts are split there into list arrays; these are flattened with their parent indices, an
ordinal is worked out for each unit, units are filtered by their role (before the first cut, between the cuts, after the
second), each role's units are rebuilt into lists and joined to one piece a document, and the pieces are joined in the
order of the document's form. A unit is a run of other than ASCII white space with the white space before it, and the white
space that ends a text is one of its own; bytes of longer code points are never white space, so bytes may be looked at.

Cuts and forms come from a seeded hash of the id, so they are the same for every partitioning. Null texts count as empty, a
null id as the empty text; empty texts, and texts that hold a marker, stay plain; whole texts are cut however long, a batch
being cut down to ``BATCH_BYTES`` of text or one row; repeated rows give repeated results and an empty table an empty one.
Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.llm.cluster import by_bytes, python_ready

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Percent of the documents that are cut, and of these the percent that begin with the suffix.
CUT_PERCENT, SPM_PERCENT = 50, 80
#: Bytes of text worked on at a time, one document at least.
BATCH_BYTES = 16 << 20

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: A byte that no UTF-8 text has.
BREAK = b"\xff"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32, from the first digits of the SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _joined(units: pa.Array, role: pa.Array, sizes: pa.Array) -> pa.Array:
    """One piece a document from its units of a role, of which it has sizes."""
    ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))])
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), units.filter(role))
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))


def _code_points(piece: pa.Array) -> pa.Array:
    return pc.utf8_length(piece.cast(pa.large_string())).cast(pa.int64())


def cut(text: pa.Array, h: list[pa.Array], cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars, output of a batch of texts and their draws."""
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    lists = pc.split_pattern(pc.replace_substring_regex(text, pattern=f"({UNIT})", replacement=b"\\1" + BREAK), pattern=BREAK)
    n = pc.subtract(pc.list_value_length(lists), 1).cast(pa.int64())  # nothing stands after the last break
    units, parent = lists.flatten(), pc.list_parent_indices(lists)
    first = pa.array(np.asarray(lists.offsets)[:-1] - int(lists.offsets[0].as_py()), pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(units)), pa.int64()), first.take(parent))

    rest = lambda x: pc.subtract(x, pc.multiply(pc.divide(x, pc.add(n, 1)), pc.add(n, 1)))
    one, two = rest(h[0]), rest(h[1])
    low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    percent = lambda x: pc.subtract(x, pc.multiply(pc.divide(x, 100), 100))
    marked = pc.match_substring_regex(text, pattern=f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    plain = pc.or_(pc.or_(pc.equal(pc.binary_length(text), 0), marked), pc.greater_equal(percent(h[2]), cut_percent))
    spm = pc.less(percent(h[3]), spm_percent)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))

    low_of, high_of, n_of = low.take(parent), high.take(parent), n.take(parent)
    prefix = _joined(units, pc.less(ordinal, low_of), low)
    middle = _joined(units, pc.and_(pc.greater_equal(ordinal, low_of), pc.less(ordinal, high_of)), pc.subtract(high, low))
    suffix = _joined(units, pc.and_(pc.greater_equal(ordinal, high_of), pc.less(ordinal, n_of)), pc.subtract(n, high))
    mark = lambda m: pa.scalar(m.encode(), pa.large_binary())
    join = lambda *pieces: pc.binary_join_element_wise(*pieces, mark(""))
    as_psm = join(mark(PREFIX), prefix, mark(SUFFIX), suffix, mark(MIDDLE), middle)
    as_spm = join(mark(SUFFIX), suffix, mark(PREFIX), prefix, mark(MIDDLE), middle)
    output = pc.if_else(plain, text, pc.if_else(spm, as_spm, as_psm))
    none = pa.scalar(None, pa.int64())
    return [n, form, pc.if_else(plain, none, _code_points(prefix)), pc.if_else(plain, none, _code_points(middle)), output.cast(pa.string())]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points, null
    where plain), output. Map-only: a document stays in its partition."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            made = cut(batch.column("text"), [batch.column(f"h{i}") for i in range(4)], cut_percent, spm_percent)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col(id_col), seed))])
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text from output and form alone. A text that is cut holds no marker, so the markers stand where they were put."""
    piece = lambda i: F.try_element_at(F.split(output, "<[PSM]>", -1), F.lit(i))
    return F.when(form == "psm", F.concat(piece(2), piece(4), piece(3))).when(form == "spm", F.concat(piece(3), piece(4), piece(2))).otherwise(output)


def query(spark, sf_dir):
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x
  FROM documents
), h AS (
  SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT doc_id, text, n, array_to_string(u[:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
    array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
