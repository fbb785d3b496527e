"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test questions and answers.

Words are runs of ASCII letters and digits, A-Z lower-cased, and of all characters beyond ASCII. A window is ``WINDOW``
consecutive words of a benchmark item; an item of fewer words is one window. The windows are the automaton's keys, each with
a blank before, between and after its words, so that no word is met in part. A document is normalised byte by byte, which
leaves every byte where it was; its words are then read once, joined by single blanks, piece by piece however long it is.
A key that ends at a blank ends at the word before that blank, and the word's place in the original text is known.

The windows of the items are made and told apart on the cluster. Up to ``MOST_WINDOWS`` pairs of window and item make one
automaton, which is broadcast; a larger benchmark is dealt into as many automata as it takes, each of which scans the
documents in a pass of its own, and what the passes find in a document is joined. So neither the driver nor a worker ever
holds more than that.

Null texts have no words and are clean, items without words have no window, items that share an item_id are one item, a null
item_id is the empty id, whole texts and items are read however long, repeated rows give repeated results, an empty
benchmark hits nothing and an empty table gives an empty result. Of documents only id and text are read, and of the
benchmark only item_id and text, so other columns cannot clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.llm.cluster import by_bytes, materialize, python_ready, small

WINDOW = 10
#: Pairs of window and item in one automaton: about 250 MB in a worker, 25 MB on the driver.
MOST_WINDOWS = 100_000
#: Bytes of a text that are scanned at a time, and windows of an item that are given out at a time.
PIECE, ITEM_ROWS = 1 << 20, 4096
BATCH_BYTES = 16 << 20

#: Each byte's normal form: A-Z lower-cased, ASCII letters, digits and bytes beyond ASCII as they are, all others a blank.
NORMAL = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
RUNS = "array<struct<first:bigint,last:bigint,begin:bigint,end:bigint>>"

Run = tuple[int, int, int, int]


def windows(text: bytes, window: int = WINDOW) -> Iterator[str]:
    """The windows of an item, each as a key of the automaton."""
    words = [w.decode("latin-1") for w in text.translate(NORMAL).split()]
    for i in range(max(1, len(words) - window + 1) if words else 0):
        yield f" {' '.join(words[i : i + window])} "


class Scanner:
    """An automaton over windows, each with its number of words and the items that have it."""

    def __init__(self, pairs: list[tuple[str, str]]):
        items: dict[str, list[str]] = {}
        for key, item in pairs:
            items.setdefault(key, []).append(item)
        self.automaton = ahocorasick.Automaton()
        for key, of in items.items():
            self.automaton.add_word(key, (key.count(" ") - 1, of))
        self.automaton.make_automaton()
        self.empty = not items

    def scan(self, text: bytes, piece: int = PIECE) -> tuple[int, list[Run], list[str]]:
        """Words of a text; runs of hit words that stand side by side, as first and last word and as begin and end in code
        points of the text; and the items whose windows occur, in order."""
        normal, at, n_words, passed = text.translate(NORMAL), 0, 0, 0
        search, found, items = None if self.empty else self.automaton.iter(""), [], set()
        while at < len(normal):
            stop = normal.find(b" ", at + piece)  # a piece ends between two words
            stop = len(normal) if stop < 0 else stop
            words = normal[at:stop].split()
            at = stop
            if search is not None and words:
                line = ("" if passed else " ") + b" ".join(words).decode("latin-1") + " "
                search.set(line)  # the automaton goes on where the last piece left it, and so do its places
                hits = list(search)
                if hits:
                    blanks = np.cumsum([len(w) + 1 for w in words]) - (1 if passed else 0)  # after each word
                    last = n_words + np.searchsorted(blanks, [h[0] - passed for h in hits])
                    for end, (_, (size, of)) in zip(last.tolist(), hits, strict=True):
                        found.append((end - size + 1, end))
                        items.update(of)
                passed += len(line)
            n_words += len(words)
        return n_words, self._in_text(text, normal, found), sorted(items)

    @staticmethod
    def _in_text(text: bytes, normal: bytes, found: list[tuple[int, int]]) -> list[Run]:
        runs: list[list[int]] = []
        for first, last in sorted(found):
            if runs and first <= runs[-1][1] + 1:
                runs[-1][1] = max(runs[-1][1], last)
            else:
                runs.append([first, last])
        if not runs:
            return []
        inside = np.diff(np.frombuffer(b" " + normal + b" ", np.uint8) != 0x20)
        edges = np.flatnonzero(inside)  # begin and end of each word in turn
        points = np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)  # code points up to each byte
        return [(a, b, int(points[edges[2 * a]]) - 1, int(points[edges[2 * b + 1] - 1])) for a, b in runs]


_BUILT: dict[str, Scanner] = {}


def _scanner(key: str, pairs: Broadcast) -> Scanner:
    """The automaton of a pass, built once in each worker; the last one makes room for it."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Scanner(pairs.value)
    return _BUILT[key]


def window_table(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """key, item: each window of each item once."""
    python_ready(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keys, owners = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for key in windows(text or b"", window):
                    keys.append(key)
                    owners.append(item)
                    if len(keys) == ITEM_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(owners, pa.string())], names=["key", "item"])
                        keys, owners = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(owners, pa.string())], names=["key", "item"])

    picked = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "key string, item string").distinct()


def _passes(benchmark: DataFrame, window: int, most: int, **columns: str) -> Iterator[tuple[str, Broadcast, int]]:
    """The pairs of each pass, broadcast, and the number of passes. Whoever asks for the next pass has written the result of
    the last one, whose pairs are then given up; those of the final pass stay, as its result may not have been read yet."""
    spark = benchmark.sparkSession
    table = materialize(window_table(benchmark, window=window, **columns), "windows")
    n = max(1, -(-table.count() // most))
    for i in range(n):
        part = table.where(F.pmod(F.xxhash64("key", "item"), F.lit(n)) == i) if n > 1 else table
        pairs = spark.sparkContext.broadcast([tuple(r) for r in part.toLocalIterator()])  # about most of them
        yield uuid.uuid4().hex, pairs, n
        if i < n - 1:
            pairs.destroy()


def _scan(docs: DataFrame, key: str, pairs: Broadcast) -> DataFrame:
    """id, text_key, n_words, runs and items of each document; without a match, runs and items are empty."""
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "begin", "end")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, pairs)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            got = [scanner.scan(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            runs = pa.array([[dict(zip(("first", "last", "begin", "end"), r, strict=True)) for r in g[1]] for g in got], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([g[0] for g in got], pa.int64()), runs, pa.array([g[2] for g in got], pa.list_(pa.string()))], names=["doc_id", "text_key", "n_words", "runs", "items"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key string, n_words long, runs {RUNS}, items array<string>")


def _merged(runs: Column) -> Column:
    """Runs of several passes as one list of runs that neither meet nor touch."""
    grown = lambda a, r: F.named_struct(F.lit("first"), a.first, F.lit("last"), F.greatest(a.last, r.last), F.lit("begin"), a.begin, F.lit("end"), F.greatest(a.end, r.end))

    def add(done: Column, r: Column) -> Column:
        now = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce(r.first <= now.last + 1, F.lit(False))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown(now, r)))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(F.array_sort(runs), F.array().cast(RUNS), add)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST_WINDOWS, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside an occurrence of a window), items (ids whose windows occur,
    sorted), runs (of hit words: first and last word, begin and end in code points of the text), contaminated.

    With one automaton this is one pass over the documents and no shuffle. With several, only documents with hits are
    shuffled, by id and digest, one row for each of these and each pass.
    """
    python_ready(docs.sparkSession)
    passes = _passes(benchmark, window, most, **columns)
    key, pairs, n = next(passes)
    text = F.col(text_col).cast("string")
    several = n > 1
    picked = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), (F.sha2(text.cast("binary"), 256) if several else F.lit(None).cast("string")).alias("text_key"))
    found = _scan(picked, key, pairs)
    if several:
        rows = materialize(found, "scanned")
        each = [rows, *(materialize(_scan(picked, key, pairs).where("size(items) > 0"), "scanned") for key, pairs, _ in passes)]
        hit = [d.where("size(items) > 0").groupBy("doc_id", "text_key").agg(F.first("runs").alias("runs"), F.first("items").alias("items")) for d in each]
        whole = hit[0]
        for more in hit[1:]:
            whole = whole.unionByName(more)
        whole = whole.groupBy("doc_id", "text_key").agg(_merged(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        other = whole.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_text"), F.col("runs").alias("of_runs"), F.col("items").alias("of_items"))
        found = rows.join(other, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_text")), "left")
        found = found.select("doc_id", "n_words", F.coalesce("of_runs", "runs").alias("runs"), F.coalesce("of_items", "items").alias("items"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r.last - r.first + 1)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "runs", (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST_WINDOWS, text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of docs that no window occurs in, with their own columns. Each pass sees what the one before it left."""
    python_ready(docs.sparkSession)
    at = docs.columns.index(text_col)
    for i, (key, pairs, n) in enumerate(_passes(benchmark, window, most, **columns)):

        def run(batches: Iterator[pa.RecordBatch], key: str = key, pairs: Broadcast = pairs) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(key, pairs)
            for batch in by_bytes(batches, at, BATCH_BYTES):
                yield batch.filter(pa.array([not scanner.scan(t or b"")[2] for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        docs = materialize(docs, "clean") if i < n - 1 else docs
    return docs


def query(spark, sf_dir):
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


SQL = r"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), s AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item, least(10, len(w))::BIGINT AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win FROM s),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), k AS (SELECT DISTINCT k FROM p), t AS (SELECT r, w, k, unnest(range(1, greatest(0, len(w) - k + 1) + 1)) AS s FROM d, k),
o AS (SELECT DISTINCT t.r, t.s, t.k, p.item FROM t JOIN p ON p.k = t.k AND p.win = array_to_string(t.w[t.s:t.s + t.k - 1], ' ')),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS x FROM o) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
