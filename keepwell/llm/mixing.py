"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share 100% of all words. A target stops at
``MAX_REPEATS`` times its source's size; the excess is shared again by weight. Targets become whole blocks of
``BLOCK`` words: highest quotients (weight / (2 * seats + 1), in whole numbers) give each source its quota, and each shard
of the source its part. A shard lays its documents out in a seeded order as one line of words, takes whole passes of the
line and then a run of blocks from a seeded start, so reruns agree.

Null texts have size 0; sizes and takings of repeated rows count per row; of equal quotients the earlier source, or shard,
takes the seat; documents without id are laid out by their texts; whole texts are counted however long; an empty table
gives an empty result. Only id, text and source are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.cluster import materialize
from keepwell.llm.textcols import word_count

BLOCK = 16
MAX_REPEATS = 3
SEED = 20
#: Documents a shard should hold, and shards in all: the quota table on the driver has a row for each shard.
SHARD_ROWS = 2_000
MAX_SHARDS = 16_384
#: A mix is configured by source; more sources than this are refused rather than collected.
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: list[int], repeats: int = MAX_REPEATS) -> list[Fraction]:
    """Words wanted of each source: the total by weight, never above repeats * size, the excess shared again."""
    out, open_ = [Fraction(0)] * len(sizes), set(range(len(sizes)))
    left = Fraction(sum(sizes))
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] > repeats * sizes[i] * whole]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = Fraction(repeats * sizes[i])
            left -= repeats * sizes[i]
            open_.remove(i)
    return out


def sainte_lague(weights: list[int] | list[Fraction], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotient weight / (2 * own seats + 1), ties to the earlier, none above its cap.

    A party has floor((weight / t + 1) / 2) quotients of t or more, so a bisection over whole multiples of a small step
    finds a threshold t that stays within the house; the few seats that remain are dealt one by one. All of it is exact.
    """
    scale = math.lcm(*(Fraction(w).denominator for w in weights))
    whole = [int(w * scale) for w in weights]
    seats = min(seats, sum(c for w, c in zip(whole, caps, strict=True) if w > 0))
    if seats <= 0:
        return [0] * len(whole)
    fine = 1 << 20

    def dealt(t: int) -> list[int]:  # the threshold is t / fine
        return [min(c, (w * fine + t) // (2 * t)) if w > 0 else 0 for w, c in zip(whole, caps, strict=True)]

    low, high = 0, max(whole) * fine + 1  # too many seats at low, none at high
    while high - low > 1:
        mid = (low + high) // 2
        if sum(dealt(mid)) > seats:
            low = mid
        else:
            high = mid
    out = dealt(high)
    quotients = [(Fraction(-w, 2 * out[i] + 1), i) for i, w in enumerate(whole) if out[i] < caps[i] and w > 0]
    heapq.heapify(quotients)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(quotients)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(quotients, (Fraction(-whole[i], 2 * out[i] + 1), i))
    return out


def plan(shards: list[tuple[str | None, int, int, int]], block: int = BLOCK, repeats: int = MAX_REPEATS) -> list[tuple]:
    """(source, shard, words, blocks taken, source's words, source's target) from (source, shard, rows, words)."""
    by: dict[str | None, list[tuple[int, int]]] = {}
    for source, shard, _, words in sorted(shards, key=lambda s: s[1]):
        by.setdefault(source, []).append((shard, words))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(w for _, w in by[s]) for s in order]
    want = targets(sizes, [1 + i % 3 for i in range(len(order))], repeats)
    blocks = {s: [math.ceil(w / block) for _, w in by[s]] for s in order}
    caps = [repeats * sum(blocks[s]) for s in order]
    quotas = sainte_lague(want, caps, round(sum(want) / block))
    out = []
    for s, size, target, quota in zip(order, sizes, want, quotas, strict=True):
        parts = sainte_lague([w for _, w in by[s]], [repeats * b for b in blocks[s]], quota)
        out += [(s, shard, words, part, size, float(target)) for (shard, words), part in zip(by[s], parts, strict=True)]
    return out


def _place(doc_id: Column, text: Column, seed: int) -> Column:
    """A row's place in its shard's line, from which its shard follows too."""
    return F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit("")))))


def _laid(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Each document with what the mix takes of it, and the number of shards by source."""
    spark = docs.sparkSession
    place = _place(F.col(id_col), F.col(text_col), seed)
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), place.alias("place")), "sizes")
    per_source = rows.groupBy("source").agg(F.count("*").alias("n"))
    n_sources, n_rows = per_source.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_sources > MAX_SOURCES:
        raise ValueError(f"{n_sources} sources; a mix has at most {MAX_SOURCES}")
    rows_a_shard = max(SHARD_ROWS, math.ceil(n_rows / MAX_SHARDS))
    shards = F.broadcast(per_source.select(F.col("source").alias("of"), F.ceil(F.col("n") / rows_a_shard).cast("int").alias("shards")))
    dealt = rows.join(shards, rows["source"].eqNullSafe(shards["of"])).select("doc_id", "source", "size", "place", _shard(F.col("place"), F.col("shards")).alias("shard"))
    found = dealt.groupBy("source", "shard").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()  # MAX_SHARDS + MAX_SOURCES rows at most
    quotas = spark.createDataFrame(plan([tuple(r) for r in found], block), "__source string, __shard int, line long, quota long, source_size long, target double")

    line = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = dealt.withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size"))
    joined = laid.join(F.broadcast(quotas), laid.source.eqNullSafe(F.col("__source")) & (laid.shard == F.col("__shard")))
    n_blocks = F.ceil(F.col("line") / block).cast("long")
    passes = F.when(n_blocks > 0, F.floor(F.col("quota") / n_blocks)).otherwise(0).cast("long")
    rest = (F.col("quota") - passes * n_blocks) * block
    first = F.when(n_blocks > 0, F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), n_blocks)).otherwise(0) * block
    # the run [first, first + rest) of the line, and what runs over its end at the line's beginning, in whole blocks
    over = F.greatest(F.lit(0), first + rest - n_blocks * block)
    common = lambda a, b: F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(F.col("begin"), a))
    once = common(first, first + rest) + common(F.lit(0), over)
    starts = ((F.col("begin") >= first) & (F.col("begin") < first + rest)) | (F.col("begin") < over)
    again = F.when(F.col("size") > 0, 2 * once >= F.col("size")).otherwise(starts)
    taken = (passes * F.col("size") + once).cast("long").alias("taken")
    columns = ["doc_id", "source", "size", "source_size", "target", "shard", "place"]
    return joined.select(*columns, taken, passes.alias("passes"), again.alias("again"), ((F.col("end") > first) | (F.col("begin") >= first)).alias("late")), shards


def _shard(place: Column, shards: Column) -> Column:
    return F.pmod(F.shiftright(place, 20), shards).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted), copies (for whole
    documents: its passes, and one more where the run of blocks takes at least half of it)."""
    laid, _ = _laid(docs, id_col, text_col, source_col, block, seed)
    return laid.select("doc_id", "source", "size", "source_size", "target", "taken", (F.col("passes") + F.col("again").cast("long")).alias("copies"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mixed documents with their own columns, a row for each copy.

    The documents that a shard takes once more than its passes stand side by side in its line, from the run's begin to
    its end and, where the run goes over the end, from the line's begin on. So two intervals of places for each shard say
    how often any document is taken: these are broadcast, MAX_SHARDS + MAX_SOURCES rows at most, and no text is shuffled.
    Rows that share an id, or a text where there is none, stand in one place and are taken equally often.
    """
    laid, shards = _laid(docs, id_col, text_col, source_col, block, seed)
    bound = lambda f, late: f(F.when(F.col("again") & (F.col("late") == late), F.col("place")))
    runs = laid.groupBy("source", "shard").agg(
        F.first("passes").alias("passes"), bound(F.min, True).alias("begin"), bound(F.max, True).alias("end"), bound(F.min, False).alias("begin2"), bound(F.max, False).alias("end2")
    )
    runs = F.broadcast(materialize(runs, "runs"))
    # columns are taken from their tables, so any names may occur in docs
    source, place = docs[source_col].cast("string"), _place(docs[id_col], docs[text_col], seed)
    marked = docs.join(shards, source.eqNullSafe(shards["of"]))
    marked = marked.join(runs, source.eqNullSafe(runs["source"]) & (_shard(place, shards["shards"]) == runs["shard"]))
    inside = lambda begin, end: F.coalesce(place.between(runs[begin], runs[end]), F.lit(False))
    copies = (runs["passes"] + (inside("begin", "end") | inside("begin2", "end2")).cast("long")).cast("int")
    own = [docs[c] for c in docs.columns]
    return marked.where(copies > 0).select(*own, F.explode(F.array_repeat(F.lit(1), copies))).select(*own)


def query(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
