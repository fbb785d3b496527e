"""Language-model scores by prediction by partial matching over bytes.

Spark counts what follows each context of up to ``ORDER`` bytes in all training texts. A byte is looked up in the longest
context; where it did not follow, the model escapes (as many escapes as different bytes were seen) to the context one byte
shorter, from which the bytes just ruled out are excluded, down to all bytes being equally likely. As those probabilities
depend on the context alone they are worked out once, and a text's code length is a sum over table look-ups, whole batches
at a time.

Every context counts, at every size. The contexts that occur most (a bounded number) become a trie that is sent to the
tasks; a context's suffixes and prefixes occur at least as often, so they are in it too. Beside it go the most frequent
grams, a whole context and its byte, of the other contexts. All other grams of a document meet their probabilities in a
shuffle, once for each document and gram: they are worked out from the written counts, up from the longest suffix that the
trie has. No such gram has more than a small share of all positions.

Beside it stands a smoothed word model. Word counts are exact over all training texts; the most frequent words (a bounded
number) are sent to the tasks, and each other word of a document meets its count in a shuffle, where no word has more
than a small share of all tokens.

Null texts count as empty and hold only the end; whole texts are learnt and scored however long, in parts that overlap by
their contexts; equal texts have equal scores; repeated rows are rows of their own in training and result; an empty table
gives an empty result. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.llm.cluster import materialize, python_ready, small
from keepwell.llm.textcols import is_remainder

#: At most 5: a context and the byte after it are counted under one 64-bit number.
ORDER = 5
#: Contexts of the trie sent to every task: with all 256 bytes in use, its two tables have at most 135 MB.
MAX_CONTEXTS = 65_536
#: Grams of other contexts are sent to every task, in 12 bytes each, where they are one in so many positions or more; so there
#: are no more of them than this, and the positions left to the shuffle are a like share at every size.
MAX_GRAMS = 1 << 21
#: Words sent to every task.
MAX_WORDS = 131_072
#: Neither byte occurs in UTF-8: before a text, and after it.
BEFORE, END = 0xFE, 0xFF
SMOOTHING = 0.1
FOLDS = 10
#: Positions worked on at a time, and entries of a task's counter before it is passed on.
CHUNK, FLUSH = 1 << 20, 400_000


# -- counting ----------------------------------------------------------------------------------------------------------


def gram_keys(text: bytes, order: int) -> np.ndarray:
    """For each byte of the text and its end: the order bytes before it and itself, as a number."""
    x = np.frombuffer(bytes([BEFORE]) * order + text + bytes([END]), np.uint8)
    keys = np.zeros(len(x) - order, np.int64)
    for j in range(order + 1):
        keys = (keys << 8) | x[j : len(x) - order + j]
    return keys


def count_training(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """gram (long, null for words), word (empty for the end, null for grams), n: summed over all rows, written once."""
    python_ready(texts.sparkSession)

    def batch(keys: np.ndarray, counts: np.ndarray, words: Counter) -> pa.RecordBatch:
        n, m = len(keys), len(words)
        gram = pa.concat_arrays([pa.array(keys, pa.int64()), pa.nulls(m, pa.int64())])
        word = pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(list(words), pa.binary()).cast(pa.string())])
        return pa.RecordBatch.from_arrays([gram, word, pa.array(np.concatenate([counts, np.fromiter(words.values(), np.int64, m)]))], names=["gram", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        keys, counts, fresh, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (keys[:0], counts[:0])
            every, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            return every, np.bincount(where, np.concatenate([counts, n]), len(every)).astype(np.int64)

        for b in small(batches):
            for text in b.column(0).cast(pa.binary()).to_pylist():
                low = (text or b"").lower()
                words.update(low.split())
                words[b""] += 1
                for at in range(0, len(low) + 1, CHUNK):  # very long texts in parts that overlap by their contexts
                    part = gram_keys(low[max(0, at - order) : at + CHUNK], order)
                    fresh.append(part[(order if at else 0) : len(part) if at + CHUNK > len(low) else -1])
                    size += len(fresh[-1])
                    if size >= CHUNK:
                        (keys, counts), fresh, size = merged(), [], 0
            if len(words) + len(keys) >= FLUSH:
                keys, counts = merged()
                yield batch(keys, counts, words)
                words, keys, counts, fresh, size = Counter(), keys[:0], counts[:0], [], 0
        keys, counts = merged()
        yield batch(keys, counts, words)

    counted = texts.select(F.col("text").cast("string")).mapInArrow(run, "gram long, word string, n long")
    return materialize(counted.groupBy("gram", "word").agg(F.sum("n").alias("n")), "counts")


def most_frequent(counts: DataFrame, limit: int) -> int:
    """The least n such that at most ``limit`` rows of counts have as much, from a histogram of at most 512 bins."""
    bin_of = F.floor(F.log2("n") * 8).cast("int")
    left = limit
    least = 0
    for row in counts.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most")).orderBy(F.desc("bin")).collect():
        if row["rows"] > left:
            return least or row["most"] + 1
        left, least = left - row["rows"], row["least"]
    return least


# -- the model ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trie:
    """Tables of a pretrained model. column: of each byte, the last for bytes never seen; step: next context by context
    and column; log10: of each column's probability in each context; depth: of each context; grams: in order, those of
    contexts that the trie lacks, and gram_log10: their probabilities."""

    order: int
    column: np.ndarray
    step: np.ndarray
    log10: np.ndarray
    depth: np.ndarray
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    gram_log10: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def scores(self, texts: list[bytes], others: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """log10 probability of each lower-cased text with its end. others, where given, takes (numbers of texts, grams)
        of the positions that neither the trie nor the grams know, and these are left out of the sums; else a position
        that the trie does not know has its probability in the longest context of the trie."""
        out = np.zeros(len(texts))
        group, size = [], 0
        for i, text in enumerate(texts):
            group.append(i)
            size += len(text)
            if size >= CHUNK or i == len(texts) - 1:
                if len(group) == 1:
                    out[i] = sum(self._sums([text[max(0, a - self.order) : a + CHUNK]], group, others, a > 0, a + CHUNK > len(text))[0] for a in range(0, len(text) + 1, CHUNK))
                elif size < 2 * CHUNK:
                    out[group] = self._sums([texts[j] for j in group], group, others)
                else:
                    out[group[:-1]] = self._sums([texts[j] for j in group[:-1]], group[:-1], others)
                    alone = None if others is None else []
                    out[i] = self.scores([text], alone)[0]
                    if alone:
                        others.extend((at + i, grams) for at, grams in alone)
                group, size = [], 0
        return out

    def states(self, x: np.ndarray) -> np.ndarray:
        """The longest context of the trie before each column but the first ones."""
        context = np.zeros(len(x) - self.order, np.int32)
        for j in range(self.order):
            context = self.step[context, x[j : len(x) - self.order + j]]
        return context

    def _sums(self, texts: list[bytes], numbers: list[int], others: list | None, inside: bool = False, ended: bool = True) -> np.ndarray:
        """Sums by text. inside: the texts begin with their contexts, else these are BEFORE."""
        lead, tail = (b"" if inside else bytes([BEFORE]) * self.order), (bytes([END]) if ended else b"")
        raw = np.frombuffer(b"".join(lead + t + tail for t in texts), np.uint8)
        x = self.column[raw]
        if len(x) <= self.order:
            return np.zeros(len(texts))
        context = self.states(x)
        values = np.zeros(len(x))
        values[self.order :] = self.log10[context, x[self.order :]]
        starts = np.cumsum([0, *(len(lead) + len(t) + len(tail) for t in texts)])[:-1]
        for j in range(self.order):  # the lead itself is not scored
            values[starts + j] = 0
        if others is not None:
            at = np.flatnonzero(self.depth[context] < self.order) + self.order
            text = np.searchsorted(starts, at, side="right") - 1
            scored = at - starts[text] >= self.order
            at, text = at[scored], text[scored]
            keys = np.zeros(len(at), np.int64)
            for j in range(self.order + 1):
                keys = (keys << 8) | raw[at - self.order + j]
            place = np.searchsorted(self.grams, keys)
            known = np.zeros(len(at), bool)
            inner = place < len(self.grams)
            known[inner] = self.grams[place[inner]] == keys[inner]
            values[at] = 0
            values[at[known]] = self.gram_log10[place[known]]
            others.append((np.asarray(numbers)[text[~known]], keys[~known]))
        return np.add.reduceat(values, starts)


@dataclass(frozen=True)
class Escapes:
    """What a longer context needs of each context of a trie: how often bytes followed, how many different ones, and which
    columns (as bits). Counts and escaped probabilities follow from these and the trie, so their tables are not sent."""

    total: np.ndarray
    kinds: np.ndarray
    present: np.ndarray

    def of(self, log10: np.ndarray, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n: how often each column followed, 0 for never; after: the probability of one that did not, having escaped from the context."""
        p, whole = 10.0 ** log10.astype(np.float64), np.maximum(self.total[state] + self.kinds[state], 1)
        followed = (self.present[state, column >> 3] >> (7 - (column & 7)) & 1).astype(bool)
        escape = np.where(self.total[state] > 0, self.kinds[state] / whole, 1.0)
        return np.where(followed, p * whole, 0.0), np.where(followed, 0.0, p / escape)


def build(order: int, lengths: np.ndarray, contexts: np.ndarray, symbols: np.ndarray, n: np.ndarray) -> Trie:
    """A trie from how often n a byte followed a context; a context is the number that its bytes spell."""
    return build_all(order, lengths, contexts, symbols, n)[0]


def build_all(order: int, lengths: np.ndarray, contexts: np.ndarray, symbols: np.ndarray, n: np.ndarray) -> tuple[Trie, Escapes]:
    seen = sorted({*symbols[lengths == 0].tolist(), BEFORE})
    column = np.full(256, len(seen), np.int16)
    column[seen] = np.arange(len(seen))
    width = len(seen) + 1
    name = lambda m, c: np.asarray(m, np.int64) << 48 | np.asarray(c, np.int64)
    states = np.unique(np.append(name(lengths, contexts), 0))
    length, spelled = states >> 48, states & ((1 << 48) - 1)

    def number(m: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of each context, -1 where the trie has none."""
        at = np.minimum(np.searchsorted(states, name(m, c)), len(states) - 1)
        return np.where(states[at] == name(m, c), at, -1)

    counts = np.zeros((len(states), width), np.float64)
    np.add.at(counts, (number(lengths, contexts), column[symbols]), n)
    total, kinds = counts.sum(1), (counts > 0).sum(1)
    unseen = 256 - int(kinds[0])  # bytes that can only be coded after the last escape
    short = np.maximum(number(np.maximum(length - 1, 0), spelled & ((1 << 8 * np.maximum(length - 1, 0)) - 1)), 0)
    parent = number(np.maximum(length - 1, 0), spelled >> 8)

    step = np.zeros((len(states), width), np.int32)
    log10 = np.zeros((len(states), width), np.float32)
    after = np.zeros((len(states), width), np.float32)  # probability of a byte that a context lacks, having escaped from it
    after[0] = 1 / max(1, unseen)
    for m in range(order + 1):
        level = np.flatnonzero(length == m)
        for at in np.array_split(level, len(level) // 4096 + 1):
            own, s = counts[at], short[at]
            present = own > 0
            if m:
                left = np.where(present, 0, counts[s])
                left_kinds = (left > 0).sum(1)
                whole = left.sum(1) + left_kinds
                escaped = np.where(whole > 0, left_kinds / np.maximum(whole, 1), 1.0)
                after[at] = np.where(left > 0, left / np.maximum(whole, 1)[:, None], escaped[:, None] * after[s])
                step[at] = step[s]
            whole = np.maximum(total[at] + kinds[at], 1)[:, None]
            escape = np.where(total[at] > 0, kinds[at] / whole[:, 0], 1.0)[:, None]
            log10[at] = np.log10(np.maximum(np.where(present, own / whole, escape * after[at]), 1e-300))
        child = np.flatnonzero((length == m + 1) & (parent >= 0))
        step[parent[child], column[spelled[child] & 255]] = child
    return Trie(order, column, step, log10, length.astype(np.int8)), Escapes(total.astype(np.int64), kinds.astype(np.int64), np.packbits(counts > 0, axis=1))


def last_bytes(context: Column, m: Column) -> Column:
    masks = F.array(*[F.lit((1 << 8 * i) - 1).cast("long") for i in range(8)])
    return context.bitwiseAND(F.get(masks, m))


@dataclass(frozen=True)
class Model:
    """A trie, its escapes, and what the trie lacks. contexts: m, context, nexts (map of byte to n), total, kinds, and of the
    bytes that only its suffix has: left (their n and kinds) and left_kinds."""

    trie: Trie
    escapes: Escapes
    contexts: DataFrame


def fit(grams: DataFrame, order: int, most: int, most_grams: int) -> Model:
    """From gram and n. Every context of every length is counted; most of them become the trie, the others stay in a table."""
    lengths = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit((1 << 8 * m) - 1).cast("long").alias("mask")) for m in range(order + 1)])).alias("part")
    context = F.shiftright("gram", 8).bitwiseAND(F.col("part.mask"))
    cut = grams.select("gram", "n", lengths).select("part.m", context.alias("context"), F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("byte"), "n")
    counted = materialize(cut.groupBy("m", "context", "byte").agg(F.sum("n").alias("n")), "contexts")
    sizes = materialize(counted.groupBy("m", "context").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")), "sizes")
    least = most_frequent(sizes, most)
    hot = (F.col("n") >= least) | (F.col("m") == 0)
    kept = F.broadcast(sizes.where(hot).select("m", "context"))  # most and one rows at most
    rows = counted.join(kept, ["m", "context"]).select("m", "context", "byte", "n").toArrow()  # 256 * most rows at the very most
    trie, escapes = build_all(order, *(rows.column(c).to_numpy().astype(np.int64) for c in ("m", "context", "byte", "n")))

    others = counted.join(kept, ["m", "context"], "left_anti")
    whole = others.where(F.col("m") == order).drop("m")
    positions = sizes.where(F.col("m") == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    totals = sizes.where((F.col("m") == order) & ~hot).select("context", (F.col("n") + F.col("kinds")).alias("whole"))
    sent = whole.where(F.col("n") * most_grams >= positions).join(totals, "context")
    table = sent.select((F.shiftleft("context", 8) + F.col("byte")).alias("gram"), F.log10(F.col("n") / F.col("whole")).alias("log10")).toArrow()
    keys = table.column("gram").to_numpy()
    by_key = np.argsort(keys)
    trie = replace(trie, grams=keys[by_key], gram_log10=table.column("log10").to_numpy()[by_key].astype(np.float32))

    # a context has at most 256 bytes after it, a suffix at most 256 contexts that are one byte longer
    suffix = last_bytes(F.col("context"), F.col("m") - 1)
    shorter = counted.select((F.col("m") + 1).alias("m"), F.col("context").alias("suffix"), "byte", F.col("n").alias("suffix_n"))
    own = others.withColumn("suffix", suffix).join(shorter, ["m", "suffix", "byte"])
    nexts = F.map_from_entries(F.collect_list(F.struct("byte", "n")))
    by_context = own.groupBy("m", "suffix", "context").agg(nexts.alias("nexts"), F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("suffix_n").alias("both"))
    of_suffix = sizes.select((F.col("m") + 1).alias("m"), F.col("context").alias("suffix"), F.col("n").alias("suffix_total"), F.col("kinds").alias("suffix_kinds"))
    left_kinds = F.col("suffix_kinds") - F.col("kinds")
    contexts = by_context.join(of_suffix, ["m", "suffix"]).select("m", "context", "nexts", "total", "kinds", (F.col("suffix_total") - F.col("both") + left_kinds).alias("left"), left_kinds.alias("left_kinds"))
    return Model(trie, escapes, contexts)


def gram_values(grams: DataFrame, sent: Broadcast, order: int, contexts: DataFrame) -> DataFrame:
    """gram, log10: of the probability of each gram (each once) whose whole context the trie lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, escapes, _ = sent.value
        for b in small(batches):
            keys = b.column(0).to_numpy()
            column = lambda j: trie.column[(keys >> 8 * (trie.order - j)) & 255]  # noqa: E731, B023
            state = np.zeros(len(keys), np.int32)
            for j in range(trie.order):
                state = trie.step[state, column(j)]
            last = column(trie.order)
            values = trie.log10[state, last].astype(np.float64)
            n, after = escapes.of(values, state, last)
            values = (trie.depth[state].astype(np.int32), values, after, n)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, values)], names=["gram", "depth", "log10", "after", "n"])

    started = grams.select("gram").mapInArrow(run, "gram long, depth int, log10 double, after double, n double")
    longer = started.select("*", F.explode(F.sequence(F.col("depth") + 1, F.lit(order))).alias("m"))
    context = last_bytes(F.shiftright("gram", 8), F.col("m"))
    met = longer.withColumn("context", context).join(contexts, ["m", "context"], "left")
    followed = F.coalesce(F.try_element_at("nexts", F.col("gram").bitwiseAND(F.lit(255)).cast("int")), F.lit(0)).cast("double")
    level = F.struct("m", followed.alias("n"), "total", "kinds", "left", "left_kinds")
    levels = met.groupBy("gram").agg(*[F.first(c).alias(c) for c in ("log10", "after", "n")], F.array_sort(F.collect_list(level)).alias("levels"))

    def step(acc: Column, x: Column) -> Column:
        escaped = F.when(x.left > 0, x.left_kinds / x.left).otherwise(1.0)
        after = F.when(acc.n > 0, acc.n / F.greatest(x.left, F.lit(1))).otherwise(escaped * acc.after)
        whole = x.total + x.kinds
        log10 = F.log10(F.when(x.n > 0, x.n / whole).otherwise(F.greatest(x.kinds / whole * after, F.lit(1e-300))))
        longer = F.struct(log10.alias("log10"), after.alias("after"), x.n.alias("n"))
        return F.when(x.total.isNull(), acc).otherwise(longer)  # never seen: the shorter context decides

    return levels.select("gram", F.aggregate("levels", F.struct("log10", "after", "n"), step, lambda acc: acc.log10).alias("log10"))


# -- scoring -----------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, trained_on: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, trained (bool), n_tokens, n_known, train_tokens, base_score, score.

    trained_on: a condition on doc_id that says which documents the models learn from.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = count_training(rows.where(trained_on).select("text"), order)
    words = counts.where(F.col("word").isNotNull()).select("word", F.col("n").alias("count"))
    n_tokens, n_types = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    least = most_frequent(words.select(F.col("count").alias("n")), MAX_WORDS)
    table = words.where(F.col("count") >= least).toArrow()  # MAX_WORDS rows at most
    frequent = {w.encode(): c for w, c in zip(table.column("word").to_pylist(), table.column("count").to_pylist(), strict=True)}
    fitted = fit(counts.where(F.col("gram").isNotNull()).select("gram", "n"), order, MAX_CONTEXTS, MAX_GRAMS)
    scale = math.log10(n_tokens + SMOOTHING * (n_types + 1))
    sent = spark.sparkContext.broadcast((fitted.trie, fitted.escapes, {w: math.log10(c + SMOOTHING) for w, c in frequent.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _, logs = sent.value
        for b in small(batches):
            low = [(t or b"").lower() for t in b.column("text").cast(pa.binary()).to_pylist()]
            tokens, known, base, rare_words, rare_counts = [], [], [], [], []
            for text in low:
                found = text.split()
                found.append(b"")
                values = list(map(logs.get, found))
                rare = Counter(w for w, v in zip(found, values, strict=True) if v is None) if None in values else Counter()
                n_rare = sum(rare.values())
                tokens.append(len(found))
                known.append(len(found) - n_rare)
                base.append(math.fsum(v for v in values if v is not None))
                rare_words.append(list(rare))
                rare_counts.append(list(rare.values()))
            others: list[tuple[np.ndarray, np.ndarray]] = []
            scores = model.scores(low, others) if low else np.zeros(0)
            at = np.concatenate([a for a, _ in others] or [np.zeros(0, np.int64)])
            grams = np.concatenate([g for _, g in others] or [np.zeros(0, np.int64)])
            by_text = np.lexsort((grams, at))
            at, grams = at[by_text], grams[by_text]
            first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (grams[1:] != grams[:-1]))[: len(at)])
            times = np.diff(np.append(first, len(at))).astype(np.int32)
            ends = pa.array(np.searchsorted(at[first], np.arange(len(low) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(grams[first], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(times))]
            columns = [b.column("doc_id"), b.column("row"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64()), pa.array(rare_words, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(rare_counts, pa.list_(pa.int32())), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n_tokens", "known", "base", "score", "words", "counts", "grams", "times"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"doc_id {kind}, row long, n_tokens long, known long, base double, score double, words array<string>, counts array<int>, grams array<long>, times array<int>")
    scored = materialize(scored, "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    met = rare.join(words.where(F.col("count") < least), "word", "left")
    count = F.coalesce("count", F.lit(0))
    sums = met.groupBy("row").agg(F.sum(F.col("n") * F.log10(count + F.lit(SMOOTHING))).alias("rare_base"), F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    other = scored.select("row", F.explode(F.arrays_zip("grams", "times")).alias("g")).select("row", F.col("g.grams").alias("gram"), F.col("g.times").alias("n"))
    valued = other.join(gram_values(other.select("gram").distinct(), sent, order, fitted.contexts), "gram")
    other_sums = valued.groupBy("row").agg(F.sum(F.col("n") * F.col("log10")).alias("other_score"))
    whole = scored.select("doc_id", "row", "n_tokens", "known", "base", "score").join(sums, "row", "left").join(other_sums, "row", "left")
    return whole.select(
        "doc_id",
        trained_on.alias("trained"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("score") + F.coalesce("other_score", F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir):
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~is_remainder(F.col("doc_id"), FOLDS))
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
