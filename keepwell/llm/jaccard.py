"""Similarity join on word shingles with a token-group matrix.

1. A document's set is its distinct shingles as 64-bit hashes. Documents of equal sets form a class, of which one goes on.
2. Two sets that reach the threshold differ in at most D tokens, a number that follows from their sizes; when the hash
   range is cut into more than D segments, they agree in the whole of one segment at least. Sets that share a segment's
   signature are a neighbourhood, named after its least id. Nothing is lost, and a word, line or passage that many
   documents share does not bring them together unless it fills a segment.
3. In a neighbourhood the token-group matrix decides. A row of it is a group of similar sets and holds the union of their
   tokens, each token as one bit. The sets come in order of size, and each is a query: how many of its tokens lie outside
   a group's union bounds its overlap with every member, so only groups whose bound reaches the threshold are opened, and
   their members bounded one by one. Then the set joins the group that holds most of it, or begins one. A group whose
   members are all joined with the set already is not opened, so a task returns a spanning forest and never all pairs.
4. What those pairs join is compared exactly, again by groups and their unions, now of whole tokens.
5. Components of those links, from the least id.

Neighbourhoods of more sets than ``BLOCK_SETS`` or more tokens than ``BLOCK_SHINGLES``, and what has more tokens than
``BLOCK_TOKENS`` to compare, are dealt out in blocks, and each pair of blocks is a task of its own. Any threshold above 0 is exact; low ones have large segments and cost more.

Null texts count as empty. Rows without id and documents without words link with nothing, and texts are read whole however
long. Rows that share an id are one document with the links of each of its texts. Equal sets are joined whatever their
number, the least id names a component, and an empty table gives an empty result. Only id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.llm.cluster import MOST_BROADCAST, materialize, meet, python_ready, sent, small, small_transfers, temporary, without
from keepwell.llm.components import components

#: Sets of a block of a neighbourhood, and tokens: at 4 to 8 bits each, 32 MB of bit arrays.
BLOCK_SETS, BLOCK_SHINGLES = 10_000, 32_000_000
#: Tokens of a block of a group: 32 MB of hashes.
BLOCK_TOKENS = 4_000_000
#: Sets in a group of the token-group matrix.
GROUP = 16
#: Each band of sizes reaches up to this many times its least size.
BAND = 1.3

# Odd multipliers for the words of a shingle, and those of a 64-bit finaliser.
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, A-Z lower-cased; a shorter text is one shingle, an empty one none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    of = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(of, found), np.uint64, len(found))
    k = min(words, len(found))
    total = np.full(len(hashes) - k + 1, k, np.uint64)
    for j in range(k):
        total = mix(total + hashes[j : len(hashes) - k + 1 + j] * np.uint64(ODD[j % len(ODD)]))
    return np.unique(total)


# -- segments ----------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def bands(num: int, den: int, up_to: int = 1 << 32) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
    """(least size of each band, segments, how many of them may be empty unseen) for similarity num / den.

    A set and the largest one that may be similar to it are in one band or in two that follow each other.
    """
    edges, segments, slack = [1], [], []
    while edges[-1] <= up_to:
        e = edges[-1]
        edges.append(max(e + 1, int(e * BAND), (e - 1) * den // num + 1))
        top = 2 * (edges[-1] - 1)
        differ = max(most_different(t, 0, num, den) for t in range(max(2, top - 4 * den), top + 1))
        m = differ + 1 if differ else 0
        empty = m * np.exp(-e / m) if m else 0.0
        slack.append(int(empty + 3 * empty**0.5) if m else 0)
        segments.append(m and m + slack[-1])
    return tuple(edges), tuple(segments), tuple(slack)


def segment_keys(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of a set's segments, for its own band and for the next where a similar set may be in that.

    With d tokens of difference and e segments empty in both sets, two sets agree in all but d + e of the others; so empty
    segments need a signature only in sets that have more of them than the band allows for.
    """
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.uint64)
    edges, segments, slack = bands(num, den)
    own = bisect_right(edges, n) - 1
    out = []
    for band in (own, own + 1) if n * den // num >= edges[own + 1] else (own,):
        m = segments[band]
        if not m:
            continue
        place = ((tokens >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # rises with the token
        starts = np.searchsorted(place, np.arange(m))
        sums = np.add.reduceat(np.append(mix(tokens + np.uint64(ODD[0])), np.uint64(0)), starts)
        full = np.diff(np.append(starts, n)) > 0
        name = mix(np.arange(m, dtype=np.uint64) + np.uint64(band * ODD[1] & (1 << 64) - 1))
        keys = mix(np.where(full, sums, np.uint64(0)) + name)
        out.append(keys if m - full.sum() > slack[band] else keys[full])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


# -- the token-group matrix of bits ------------------------------------------------------------------------------------


def token_bits(tokens: np.ndarray) -> bytes:
    """A bit array, in width the power of two from four times the set's size on, 64 at least, with a bit for each token."""
    width = max(64, 1 << (4 * len(tokens) - 1).bit_length())
    out = np.zeros(width, np.uint8)
    out[(mix(tokens + np.uint64(ODD[1])) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bit array as it would be in ``size`` words: which bit a token has depends on the low bits of its hash."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def most_different(a: np.ndarray | int, b: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Tokens in which similar sets of these sizes may differ."""
    return a + b - 2 * least_common(a, b, num, den)


def least_common(a: np.ndarray | int, b: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Tokens that similar sets of these sizes have in common at least."""
    return -(-num * (a + b) // (num + den))


class Grown:
    """Rows of one width, in words of 64 bits, in an array that grows."""

    def __init__(self, width: int):
        self.rows, self.n = np.zeros((8, width), np.uint64), 0

    def add(self, row: np.ndarray | tuple[int, ...]) -> None:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = row
        self.n += 1


class BitGroups:
    """The groups of sets whose bit arrays have one width: their unions, members, and sizes of members."""

    def __init__(self, width: int):
        self.unions, self.arrays = Grown(width), Grown(width)
        self.members: list[list[tuple[int, int]]] = []  # set and its row in arrays
        self.spans = Grown(2)  # the least and the most of their members' sizes
        self.ones = np.ones(width)  # a product with it adds up a row's counts, exactly
        self.joined: list[int | None] = []  # a member by which all others are known to be joined, else None

    def missing(self, bits: np.ndarray, start: int) -> np.ndarray:
        """Of the set with these bits, the tokens at least that are outside each union from start on."""
        met = np.bitwise_count(bits & self.unions.rows[start : self.unions.n])
        return int(np.bitwise_count(bits).sum(dtype=np.int64)) - (met.astype(np.float64) @ self.ones).astype(np.int64)

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each group, the least and the most of its members' sizes."""
        spans = self.spans.rows[: self.spans.n].view(np.int64)
        return spans[:, 0], spans[:, 1]

    def put(self, i: int, size: int, bits: np.ndarray, group: int | None) -> int:
        if group is None:
            group = self.unions.n
            self.unions.add(bits)
            self.members.append([])
            self.spans.add((size, size))
            self.joined.append(i)
        else:
            self.unions.rows[group] |= bits
            self.spans.rows[group, 1] = size
        self.members[group].append((i, self.arrays.n))
        self.arrays.add(bits)
        return group


class BitMatrix:
    """The token-group matrix of a neighbourhood. bounded: query and group met; opened: of these, the bound let through."""

    def __init__(self, sizes: np.ndarray, arrays: list[bytes], num: int, den: int):
        self.sizes, self.arrays, self.num, self.den = sizes, arrays, num, den
        self.up = list(range(len(sizes)))
        self.bounded = self.opened = 0

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def forest(self) -> Iterator[tuple[int, int]]:
        """A spanning forest of the pairs whose sizes and bits do not rule them out."""
        num, den = self.num, self.den
        of_width: dict[int, BitGroups] = {}
        for i in np.argsort(self.sizes, kind="stable").tolist():  # so all sets met are as large at most, and in width too
            n, own = int(self.sizes[i]), np.frombuffer(self.arrays[i], np.uint64)
            least = -(-num * n // den)
            home = None
            for width, groups in of_width.items():
                smallest, largest = groups.sizes()
                start = int(np.argmax(largest >= least))
                if largest[start] < least:
                    continue
                bits = folded(own, width)
                missing = groups.missing(bits, start)
                may = (largest[start:] >= least) & (n - missing >= least_common(n, np.maximum(smallest[start:], least), num, den))
                self.bounded += len(missing)
                for g in (np.flatnonzero(may)[np.argsort(missing[may], kind="stable")] + start).tolist():
                    self.opened += 1
                    if groups.joined[g] is None or self.root(groups.joined[g]) != self.root(i):
                        yield from self._open(groups, g, i, n, bits, least)
                    if home is None and width == len(own) and len(groups.members[g]) < GROUP:
                        home = g
            groups = of_width.setdefault(len(own), BitGroups(len(own)))
            g = groups.put(i, n, own, home)
            if groups.joined[g] is not None and self.root(groups.joined[g]) != self.root(i):
                groups.joined[g] = None

    def _open(self, groups: BitGroups, g: int, i: int, n: int, bits: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
        """Bounds for the members of a group, from both sides."""
        members = [(j, row) for j, row in groups.members[g] if self.sizes[j] >= least]
        if not members:
            return
        theirs = groups.arrays.rows[[row for _, row in members]]
        m = self.sizes[[j for j, _ in members]]
        mine_out = np.bitwise_count(bits & ~theirs).sum(axis=1, dtype=np.int64)
        theirs_out = np.bitwise_count(theirs & ~bits).sum(axis=1, dtype=np.int64)
        near = np.minimum(n - mine_out, m - theirs_out) >= least_common(n, m, self.num, self.den)
        for (j, _), ok in zip(members, near.tolist(), strict=True):
            a, b = self.root(i), self.root(j)
            if ok and a != b:
                self.up[a] = b
                yield i, j
        if all(self.root(j) == self.root(i) for j, _ in groups.members[g]):
            groups.joined[g] = groups.members[g][0][0]


# -- the token-group matrix of whole tokens ----------------------------------------------------------------------------


class TokenGroupMatrix:
    """Which token is in the union of which group, and the members of each group."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.sizes = np.array([len(s) for s in sets])
        order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        self.group_of = np.zeros(len(sets), np.int64)
        self.group_of[order] = np.arange(len(sets)) // GROUP
        self.n_groups = int(self.group_of.max()) + 1
        self.members = [[] for _ in range(self.n_groups)]
        for i in order:
            self.members[self.group_of[i]].append(i)
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        cuts = np.cumsum([0, *self.sizes])
        self.tokens = [flat[cuts[i] : cuts[i + 1]] for i in range(len(sets))]
        cells = np.unique(flat * self.n_groups + np.repeat(self.group_of, self.sizes))
        self.groups = cells % self.n_groups  # by token
        self.first = np.searchsorted(cells // self.n_groups, np.arange(len(names) + 1))
        self.mark = np.zeros(len(names), bool)

    def bounds(self, i: int) -> np.ndarray:
        """For each group, how many of set i's tokens its union holds."""
        t = self.tokens[i]
        count = self.first[t + 1] - self.first[t]
        ends = np.cumsum(count)
        return np.bincount(self.groups[np.repeat(self.first[t] - (ends - count), count) + np.arange(ends[-1])], minlength=self.n_groups)

    def forest(self) -> Iterator[tuple[int, int]]:
        """Links of a spanning forest of the similarity graph."""
        waiting = [set(m) for m in self.members]
        for root in range(len(self.tokens)):
            if root not in waiting[self.group_of[root]]:
                continue
            waiting[self.group_of[root]].discard(root)
            todo = [root]
            while todo:
                i = todo.pop()
                needed = -(-self.num * self.sizes[i] // self.den)  # an overlap is at least num / den of the set itself
                opened = [j for b in np.flatnonzero(self.bounds(i) >= needed) for j in waiting[b] if self.sizes[j] * self.den >= self.num * self.sizes[i] and self.sizes[i] * self.den >= self.num * self.sizes[j]]
                if not opened:
                    continue
                self.mark[self.tokens[i]] = True
                starts = np.cumsum([0, *self.sizes[opened]])[:-1]
                common = np.add.reduceat(self.mark[np.concatenate([self.tokens[j] for j in opened])].astype(np.int64), starts)
                self.mark[self.tokens[i]] = False
                for j, c in zip(opened, common.tolist(), strict=True):
                    if self.den * c >= self.num * (int(self.sizes[i]) + int(self.sizes[j]) - c):
                        waiting[self.group_of[j]].discard(j)
                        todo.append(j)
                        yield i, j


# -- the join ----------------------------------------------------------------------------------------------------------


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set), bits from doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingle_set(t or b"", words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            names = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
            bits = [token_bits(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.string()), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "set_hash", "bits"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_hash string, bits binary")


def key_bits(tokens: int) -> int:
    """Bits of a signature: as many as leave one in 2^14 signatures with a stranger of the same value, which the bit arrays
    then tell apart. Shorter signatures make a smaller shuffle."""
    return min(64, max(1, tokens).bit_length() + 14)


def _postings(rows: DataFrame, words: int, num: int, den: int, bits: int) -> DataFrame:
    """a, key: a row for each segment signature of doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            keys = [segment_keys(shingle_set(t or b"", words), num, den) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            if keys:
                owners = batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), list(map(len, keys)))))
                yield pa.RecordBatch.from_arrays([owners, pa.array((np.concatenate(keys) >> np.uint64(64 - bits)).view(np.int64))], names=["a", "key"])

    return rows.mapInArrow(run, f"a {rows.schema['doc_id'].dataType.simpleString()}, key long")


def _in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """Members of a group with the pairs of blocks (one, other) that they are in: the blocks of a group are a triangle of
    tasks, and a member of block i goes to each pair with i in it. Rows come in the order of their tasks."""
    block = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(block, j).alias("one"), F.greatest(block, j).alias("other")))
    columns = [c for c in members.columns if c not in ("group", "blocks")]
    dealt = members.select("group", *columns, F.explode(pairs).alias("p")).select("group", "p.one", "p.other", *columns)
    return dealt.repartition("group", "one", "other").sortWithinPartitions("group", "one", "other", "doc_id")


def _by_task(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], forest: Callable[..., Iterator[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """a, b: the links that forest finds among the rows of each task, which stand together."""
    task, ids, values, kind = None, [], [], None

    def linked() -> pa.RecordBatch | None:
        found = list(forest(*zip(*values, strict=True))) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], kind), pa.array([ids[j] for _, j in found], kind)], names=["a", "b"]) if found else None

    for batch in small(batches):
        kind = batch.column("doc_id").type
        names = zip(*(batch.column(c).to_pylist() for c in ("group", "one", "other")), strict=True)
        cells = zip(*(batch.column(c).to_numpy(zero_copy_only=False) for c in columns), strict=True)
        for name, doc_id, cell in zip(names, batch.column("doc_id").to_pylist(), cells, strict=True):
            if name != task:
                if (out := linked()) is not None:
                    yield out
                task, ids, values = name, [], []
            ids.append(doc_id)
            values.append(cell)
    if (out := linked()) is not None:
        yield out


def _groups(neighbours: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: pairs that may be links, which join the members of each group, from group, blocks, doc_id, n_shingles, bits."""
    kind = neighbours.schema["doc_id"].dataType.simpleString()

    def forest(sizes: tuple, arrays: tuple) -> Iterator[tuple[int, int]]:
        return BitMatrix(np.array(sizes), list(arrays), num, den).forest()

    return _in_blocks(neighbours, F.col("blocks")).mapInArrow(lambda batches: _by_task(batches, ("n_shingles", "bits"), forest), f"a {kind}, b {kind}")


def _links(members: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """a, b: links from group, blocks, doc_id, text."""
    kind = members.schema["doc_id"].dataType.simpleString()

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingle_set(t or b"", words).view(np.int64) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("blocks"), batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["group", "blocks", "doc_id", "tokens"])

    def forest(sets: tuple) -> Iterator[tuple[int, int]]:
        return TokenGroupMatrix([np.asarray(s).view(np.uint64) for s in sets], num, den).forest()

    with_tokens = members.mapInArrow(tokens_of, f"group {kind}, blocks int, doc_id {kind}, tokens array<long>")
    return _in_blocks(with_tokens, F.col("blocks")).mapInArrow(lambda batches: _by_task(batches, ("tokens",), forest), f"a {kind}, b {kind}")


def near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least id that links of similarity num / den reach)."""
    python_ready(docs.sparkSession)
    # all Python steps are written before this returns, and of what was written only the two tables that the result reads stay
    with small_transfers(docs.sparkSession), temporary(docs.sparkSession) as keep:
        return _near_copies(docs, words, num, den, id_col, text_col, keep)


def _near_copies(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = keep(materialize(_sets(rows, words), "sets"))
    named = sets.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialize(named.groupBy("set_hash").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n")), "classes")
    n_tokens, n_named = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    several = named.groupBy("doc_id").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y")).where("x <> y").select("doc_id")
    further = meet(named.select("doc_id", "set_hash"), classes.where("n > 1").select("set_hash", "least", "n"), "set_hash", "n", n_named)
    further = further.where("doc_id > least").select("doc_id").distinct().join(several, "doc_id", "left_anti")
    further = materialize(further, "further")

    some = rows.where(F.col("doc_id").isNotNull())
    alone = without(some, further, some["doc_id"] == further["doc_id"])
    postings = materialize(_postings(alone, words, num, den, key_bits(n_tokens)), "postings")
    # of a key that a set alone has, nothing is left; the others hang on the least id that has it
    leaders = postings.groupBy("key").agg(F.min("a").alias("group"), F.max("a").alias("last"), F.count("*").alias("n")).where("`group` <> last").select("key", "group", "n")
    leaders = materialize(leaders, "leaders")
    near = meet(postings, leaders, "key", "n", n_tokens)
    near = materialize(near.groupBy("group", "a").agg(F.lit(1).alias("x")).select("group", F.col("a").alias("__id")), "near")
    sized = near.join(named.select("doc_id", "n_shingles"), F.col("__id") == F.col("doc_id"))
    n_blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    blocks = sized.groupBy("group").agg(n_blocks.alias("__blocks")).where("__blocks > 1").withColumnRenamed("group", "__group")
    known = named.select("doc_id", "n_shingles", "bits")
    dealt = near.join(sent(blocks, "blocks"), F.col("group") == F.col("__group"), "left").select("group", F.coalesce("__blocks", F.lit(1)).alias("blocks"), "__id")
    neighbours = dealt.join(known, F.col("__id") == F.col("doc_id")).select("group", "blocks", "doc_id", "n_shingles", "bits")
    groups = components(_groups(neighbours, num, den))
    groups = materialize(groups.select(F.col("node").alias("__id"), F.col("component").alias("group")), "groups")

    sizes = groups.join(named.select("doc_id", "n_shingles"), F.col("__id") == F.col("doc_id")).groupBy("group").agg(F.ceil(F.sum("n_shingles") / BLOCK_TOKENS).cast("int").alias("__blocks"))
    sizes = sizes.where("__blocks > 1").withColumnRenamed("group", "__group")
    wanted = groups.join(sent(sizes, "blocks"), F.col("group") == F.col("__group"), "left").select("__id", "group", F.coalesce("__blocks", F.lit(1)).alias("blocks"))
    if groups.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    members = rows.join(wanted, rows["doc_id"] == F.col("__id")).select("group", "blocks", "doc_id", "text")
    linked = components(_links(members, words, num, den))
    labels = keep(materialize(classes.join(linked, F.col("least") == F.col("node"), "left").select("set_hash", F.coalesce("component", "least").alias("component_id"), "n"), "labels"))
    unlinked = sets.where(F.col("set_hash").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return meet(named.select("doc_id", "n_shingles", "set_hash"), labels, "set_hash", "n", n_named).drop("set_hash").unionByName(unlinked)


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but for those whose component has a smaller id, with their own columns."""
    with temporary(docs.sparkSession) as keep:
        found = near_copies(docs, words, num, den, id_col, text_col)
        gone = keep(materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone"))
    return without(docs, gone, docs[id_col] == gone["doc_id"])


def query(spark, sf_dir):
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, num=90)
