"""Boosted trees that take missing values as they are.

Every feature is cut into bins at quantiles of the training rows, with a bin of its own for missing values. A tree grows
level by level: sums of gradients and of curvatures by node, feature and bin are added up over the cluster, which gives the
driver a bounded table, and each node takes the split that lowers the loss most, trying missing values on either side. So a
split learns where missing values go, and nothing is imputed.

Gradients are rounded to whole multiples of 1 / SCALE before they are added, so sums are exact and a fit gives the same trees
for every partitioning. Up to LOCAL_ROWS training rows are binned on the cluster and then summed in one place; more stay
where they are as blocks of arrays, and every level is a job. Both add the same whole numbers.
"""

from __future__ import annotations

import math
import pickle
import random
from collections.abc import Iterator, Sequence
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from keepwell.sources.shared import new_path, python_ready, remove, settle, shared_dir

BINS = 64
SCALE = 1 << 20
#: Training rows that are summed in one place at most: about 5 MB. More are summed where they lie, a job for each level.
LOCAL_ROWS = 100_000
#: Rows of a block of arrays on the cluster (about 8 MB with one forest), and rows of a task.
BLOCK_ROWS, TASK_ROWS = 1 << 18, 1 << 20
#: A checkpoint cuts the lineage of the running margins after so many trees.
CUT_EVERY = 25
#: Weight of the square of a leaf, and the least curvature of a leaf.
RIDGE, LEAST_CURVATURE = 1.0, 1.0
NODES = "tree int, node int, feature int, threshold double, left int, right int, missing_left boolean, value double, gain double, cover double"


@dataclass(frozen=True)
class Tree:
    """Node arrays, the root first; a leaf has feature -1. Values below the threshold go left. cover: rows of training, by
    weight of curvature; value: what the node would give as a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        v = x[:, self.feature[node]]
        return np.where(np.isnan(v), self.missing_left[node], v < self.threshold[node])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            v = x[np.arange(len(x)), np.maximum(f, 0)]
            to_left = np.where(np.isnan(v), self.missing_left[at], v < self.threshold[at])
            at = np.where(inner, np.where(to_left, self.left[at], self.right[at]), at)


@dataclass(frozen=True)
class Forest:
    """Trees whose leaves add up to the margin, of which the probability is the logistic."""

    features: tuple[str, ...]
    trees: tuple[Tree, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return sum((t.value[t.leaves(x)] for t in self.trees), np.zeros(len(x)))

    def importances(self) -> dict[str, float]:
        """Each feature's share of all gains."""
        total = dict.fromkeys(self.features, 0.0)
        for t in self.trees:
            for f, g in zip(t.feature.tolist(), t.gain.tolist(), strict=True):
                if f >= 0:
                    total[self.features[f]] += g
        whole = sum(total.values())
        return {f: g / whole if whole else 0.0 for f, g in total.items()}


# -- fitting -----------------------------------------------------------------------------------------------------------


def cuts_of(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """The places where each feature is cut: its distinct values at the quantiles, from a summary that the tasks merge. A
    feature of few values is cut at each of them."""
    steps = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    got = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), steps, 20_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted({c for c in (got[f"q{i}"] or []) if not math.isnan(c)}) for i in range(len(features))]


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts a value has reached; one more than there are cuts where it is missing."""
    number = value.cast("double")
    reached = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c <= number))
    return F.when(number.isNull() | F.isnan(number), F.lit(len(cuts) + 1)).otherwise(reached).cast("int")


Split = tuple[int, int, bool]  # feature, bin (values of lower bins go left), missing values go left
Asked = tuple[dict[int, Split], list[int], list[int]]  # of a forest's tree: splits so far, nodes of the level, features
Grown = tuple[dict[int, Split], dict[int, float]]  # of a forest's tree: splits, values of its leaves


class Block:
    """Binned rows, with the running margins of each forest that is grown on them. A split has a feature's place among all."""

    def __init__(self, table: pa.Table | pa.RecordBatch, n_features: int, n_forests: int):
        narrow = lambda c: c.astype(np.uint8) if c.max(initial=0) < 256 else c
        self.bins = [narrow(table.column(f"b{i}").to_numpy()) for i in range(n_features)]
        self.y, self.weight, self.draw = table.column("y").to_numpy().astype(np.int8), table.column("weight").to_numpy(), table.column("draw").to_numpy().astype(np.int32)
        self.margin = np.zeros((n_forests, len(self.y)))

    def _nodes(self, splits: dict[int, Split], missing: list[int]) -> np.ndarray:
        """The node that each row has come to."""
        node = np.zeros(len(self.y), np.int64)
        for parent in sorted(splits):
            f, cut, missing_left = splits[parent]
            here = np.flatnonzero(node == parent)
            b = self.bins[f][here]
            left = np.where(b == missing[f], missing_left, b < cut)
            node[here] = np.where(left, 2 * parent + 1, 2 * parent + 2)
        return node

    def sums(self, number: int, share: float, missing: list[int], level: list[Asked]) -> list[np.ndarray]:
        """For each forest (node, feature, bin, gradient and curvature) of the nodes of a level."""
        taken = _drawn(self.draw.astype(np.int64), number, share)
        width = max(missing) + 1
        out = []
        for margin, (splits, nodes, features) in zip(self.margin, level, strict=True):
            found = np.zeros((len(nodes), len(features), width, 2), np.int64)
            out.append(found)
            if not nodes:
                continue
            p = 1 / (1 + np.exp(-margin))
            parts = [np.rint(self.weight * (p - self.y) * SCALE) * taken, np.rint(self.weight * p * (1 - p) * SCALE) * taken]
            node = self._nodes(splits, missing)
            at = np.full(max(max(nodes), int(node.max(initial=0))) + 1, len(nodes))  # rows of other nodes fall behind the last
            at[nodes] = range(len(nodes))
            place = at[node] * width
            for j, f in enumerate(features):
                key = place + self.bins[f]
                for k, part in enumerate(parts):
                    found[:, j, :, k] = np.bincount(key, part, (len(nodes) + 1) * width).reshape(-1, width)[:-1]
        return out

    def add(self, missing: list[int], grown: list[Grown]) -> Block:
        """The rows with a tree of each forest added to its margin."""
        out = copy(self)
        out.margin = self.margin.copy()
        for margin, (splits, values) in zip(out.margin, grown, strict=True):
            value = np.zeros(max(values) + 1)
            value[list(values)] = list(values.values())
            margin += value[self._nodes(splits, missing)]
        return out


class Local:
    """Binned rows in one place."""

    def __init__(self, rows: DataFrame, n_features: int, n_forests: int):
        self.block = Block(rows.toArrow(), n_features, n_forests)

    def sums(self, number: int, share: float, missing: list[int], level: list[Asked]) -> list[np.ndarray]:
        return self.block.sums(number, share, missing, level)

    def finish(self, missing: list[int], grown: list[Grown]) -> None:
        self.block = self.block.add(missing, grown)

    def close(self) -> None:
        pass


class Spread:
    """Binned rows that stay on the cluster as blocks of arrays, with their running margins, in memory and beyond it on disk.
    A level of a tree, of all forests at once, is one job, which returns a bounded table; the first level of the next tree adds
    the one before to the margins."""

    def __init__(self, rows: DataFrame, n_features: int, n_forests: int, n_rows: int):
        spark = rows.sparkSession
        python_ready(spark)
        self.sc = spark.sparkContext
        if self.sc.getCheckpointDir() is None:
            self.sc.setCheckpointDir(shared_dir(spark))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _tables(batches, BLOCK_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Block(table, n_features, n_forests))], pa.binary())], names=["block"])

        parts = max(self.sc.defaultParallelism, -(-n_rows // TASK_ROWS))
        self.depth = 1 if parts <= 64 else 2
        made = rows.repartition(parts).mapInArrow(blocks, "block binary")
        self.rows = made.rdd.map(lambda r: pickle.loads(r["block"])).persist(StorageLevel.MEMORY_AND_DISK)
        self.grown: list[Grown] | None = None
        self.spark, self.path, self.done = spark, None, 0

    def sums(self, number: int, share: float, missing: list[int], level: list[Asked]) -> list[np.ndarray]:
        before = None
        if (grown := self.grown) is not None:
            before, self.grown = self.rows, None
            self.rows = before.map(lambda block: block.add(missing, grown)).persist(StorageLevel.MEMORY_AND_DISK)
            self.done += 1
            if cut := self.done % CUT_EVERY == 0:
                self.rows.checkpoint()
        found = self.rows.map(lambda block: block.sums(number, share, missing, level)).treeReduce(_added, self.depth)
        if before is not None:
            before.unpersist()
            if cut:
                earlier, self.path = self.path, self.rows.getCheckpointFile()
                if earlier is not None:
                    remove(self.spark, earlier)
        return found

    def finish(self, missing: list[int], grown: list[Grown]) -> None:
        self.grown = grown

    def close(self) -> None:
        self.rows.unpersist()
        if self.path is not None:
            remove(self.spark, self.path)
            self.path = None


def _added(one: list[np.ndarray], other: list[np.ndarray]) -> list[np.ndarray]:
    return [a + b for a, b in zip(one, other, strict=True)]


def _tables(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of batches in tables of about so many rows."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(waiting)
            waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting)


#: Draws are whole numbers below this prime, so a line through them, modulo it, draws anew for each tree.
PRIME = (1 << 31) - 1


def _drawn(draw: np.ndarray | Column, number: int, share: float) -> np.ndarray | Column:
    """The rows that a tree is grown on: the same for arrays and for columns."""
    rnd = random.Random(number)
    return (draw * rnd.randrange(1, PRIME) + rnd.randrange(PRIME)) % PRIME < int(share * PRIME)


def best_split(sums: np.ndarray, features: list[int], missing: list[int]) -> tuple[float, Split | None]:
    """The gain and the split of a node that lower the loss most; of equal ones the first feature, the lowest cut, and
    missing values to the right. A cut above all values parts the missing ones from the others."""
    best: tuple[float, Split | None] = (1e-9, None)
    for j, f in enumerate(features):
        g, h = (sums[j, : missing[f], k].cumsum() / SCALE for k in (0, 1))
        gm, hm = sums[j, missing[f]] / SCALE
        whole_g, whole_h = g[-1] + gm, h[-1] + hm
        for missing_left in (False, True):
            gl, hl = (g + gm, h + hm) if missing_left else (g, h)
            gr, hr = whole_g - gl, whole_h - hl
            fits = (hl >= LEAST_CURVATURE) & (hr >= LEAST_CURVATURE)
            gain = np.where(fits, gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - whole_g**2 / (whole_h + RIDGE), -np.inf)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), (f, at + 1, missing_left))
    return best


def fit(rows: DataFrame, features: Sequence[str], label: str = "churned", weight: Column | float = 1.0, trees: int = 200, depth: int = 3, rate: float = 0.08, rows_share: float = 0.9, features_share: float = 0.9, seed: int = 42, key: str = "user_id", bins: int = BINS, local_rows: int = LOCAL_ROWS) -> Forest:
    """Boosted trees for a label of 0 or 1. Which rows a tree sees follows from seed and key, so refits agree. No rows
    give a forest without trees, whose probability is one half."""
    return fit_each(rows, [features], label, weight, trees, depth, rate, rows_share, features_share, seed, key, bins, local_rows)[0]


def fit_each(rows: DataFrame, choices: Sequence[Sequence[str]], label: str = "churned", weight: Column | float = 1.0, trees: int = 200, depth: int = 3, rate: float = 0.08, rows_share: float = 0.9, features_share: float = 0.9, seed: int = 42, key: str = "user_id", bins: int = BINS, local_rows: int = LOCAL_ROWS) -> list[Forest]:
    """For each choice of features the forest that fit gives on it. The rows are binned once, and the forests grow side by
    side: a level of all their trees is one pass."""
    features = list(dict.fromkeys(f for c in choices for f in c))
    cuts = cuts_of(rows, features, bins)
    missing = [len(c) + 1 for c in cuts]
    of_weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(PRIME))
    binned = rows.select(*[_bin(F.col(f), c).alias(f"b{i}") for i, (f, c) in enumerate(zip(features, cuts, strict=True))], F.col(label).cast("int").alias("y"), of_weight.cast("double").alias("weight"), draw.cast("long").alias("draw"))
    path = new_path(rows.sparkSession, "binned")
    binned = settle(binned, "binned", path)
    n = binned.count()
    places = [[features.index(f) for f in c] for c in choices]
    grown: list[list[Tree]] = [[] for _ in choices]
    if n:
        source = Local(binned, len(features), len(choices)) if n <= local_rows else Spread(binned, len(features), len(choices), n)
        try:
            for number in range(trees):
                chosen = []
                for of in places:
                    rnd = random.Random(f"{seed}:{number}")
                    chosen.append([of[i] for i in sorted(rnd.sample(range(len(of)), max(1, round(features_share * len(of)))))])
                for out, of, tree in zip(grown, places, _grow(source, number + seed * 1_000_003, chosen, missing, depth, rate, rows_share), strict=True):
                    out.append(tree.arrays(of, cuts))
        finally:
            source.close()
    remove(rows.sparkSession, path)
    return [Forest(tuple(c), tuple(g)) for c, g in zip(choices, grown, strict=True)]


class Growing:
    """A tree that grows by levels, its nodes numbered as in a heap: children 2n + 1 and 2n + 2. Sums of the leaves follow from
    the sums of the nodes above, so the last level is not read for."""

    def __init__(self, features: list[int], rate: float):
        self.features, self.rate = features, rate
        self.splits: dict[int, Split] = {}
        self.value: dict[int, float] = {}
        self.gains, self.cover = {}, {}
        self.level = [0]

    def take(self, sums: np.ndarray, missing: list[int]) -> None:
        """Split the nodes of the level by their sums."""
        below = []
        for node, s in zip(self.level, sums, strict=True):
            whole = s[0].sum(axis=0)
            self._settle(node, whole)
            gain, split = best_split(s, self.features, missing)
            if split is not None:
                self.splits[node], self.gains[node] = split, gain
                f, cut, missing_left = split
                of = s[self.features.index(f)]
                left = of[:cut].sum(axis=0) + (of[missing[f]] if missing_left else 0)
                self._settle(2 * node + 1, left)
                self._settle(2 * node + 2, whole - left)
                below += [2 * node + 1, 2 * node + 2]
        self.level = below

    def _settle(self, node: int, whole: np.ndarray) -> None:
        g, h = whole / SCALE
        self.value[node], self.cover[node] = float(-self.rate * g / (h + RIDGE)), float(h)

    def leaves(self) -> dict[int, float]:
        return {n: v for n, v in self.value.items() if n not in self.splits}

    def arrays(self, of: list[int], cuts: list[list[float]]) -> Tree:
        """The tree; features are numbered by their places in of."""
        order, splits = sorted(self.value), self.splits
        at = {n: i for i, n in enumerate(order)}
        limit = lambda f, c: cuts[f][c - 1] if c <= len(cuts[f]) else math.inf
        rows = [(of.index(splits[n][0]), limit(*splits[n][:2]), at[2 * n + 1], at[2 * n + 2], splits[n][2]) if n in splits else (-1, 0.0, 0, 0, False) for n in order]
        column = lambda i, t: np.array([r[i] for r in rows], t)
        return Tree(column(0, np.int64), column(1, np.float64), column(2, np.int64), column(3, np.int64), column(4, bool), np.array([self.value[n] for n in order]), np.array([self.gains.get(n, 0.0) for n in order]), np.array([self.cover[n] for n in order]))


def _grow(source: Local | Spread, number: int, chosen: list[list[int]], missing: list[int], depth: int, rate: float, share: float) -> list[Growing]:
    """A tree of each forest."""
    trees = [Growing(features, rate) for features in chosen]
    for _ in range(depth):
        found = source.sums(number, share, missing, [(t.splits, t.level, t.features) for t in trees])
        for t, sums in zip(trees, found, strict=True):
            t.take(sums, missing)
        if not any(t.level for t in trees):
            break
    source.finish(missing, [(t.splits, t.leaves()) for t in trees])
    return trees


# -- use ---------------------------------------------------------------------------------------------------------------


def matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """The features of a batch, missing ones as NaN."""
    if batch.num_rows == 0:
        return np.zeros((0, len(features)))
    return np.column_stack([batch.column(f).cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False) for f in features])


def score(forest: Forest, rows: DataFrame, column: str = "churn_probability") -> DataFrame:
    """The rows with the probability of the label."""
    spark = rows.sparkSession
    python_ready(spark)
    sent = spark.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 1 / (1 + np.exp(-sent.value.margin(matrix(batch, sent.value.features))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, column])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(column, DoubleType())]))


def node_table(forest: Forest, spark: SparkSession) -> DataFrame:
    """A row for each node, with the trees' features in the order of their numbers."""
    columns = [f.split()[0] for f in NODES.split(", ")][2:]
    rows = [(i, n, *[getattr(t, c)[n].item() for c in columns]) for i, t in enumerate(forest.trees) for n in range(len(t.feature))]
    return spark.createDataFrame(rows, NODES)


def save(forest: Forest, spark: SparkSession, path: str) -> None:
    node_table(forest, spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(i, f) for i, f in enumerate(forest.features)], "place int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load(spark: SparkSession, path: str) -> Forest:
    """A saved forest; its nodes, trees x 2^(depth + 1) at most, come to the driver."""
    names = [r["feature"] for r in spark.read.parquet(f"{path}/features").orderBy("place").collect()]
    by_tree: dict[int, list] = {}
    for r in spark.read.schema(NODES).parquet(f"{path}/nodes").orderBy("tree", "node").collect():
        by_tree.setdefault(r["tree"], []).append(r[2:])
    kinds = (np.int64, np.float64, np.int64, np.int64, bool, np.float64, np.float64, np.float64)
    return Forest(tuple(names), tuple(Tree(*[np.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]) for _, rows in sorted(by_tree.items())))
