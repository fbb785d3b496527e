"""Additive attribution of a boosted-tree score to its features.

Path-dependent Shapley values: the value of a set of features in a tree is the tree's mean output when splits on the set's
features are followed and others are averaged by how many training rows went each way. For a leaf that only depends on
the features of its path: of each, whether a row takes the path there (one) and the share of training rows that do (zero).
The weights of Shapley's formula are integrals of t^s (1 - t)^r, so the sum over all subsets of a path's features is the
integral of a product with a factor for each feature, a polynomial that a few Gauss points integrate exactly: depth^2 steps
for a leaf instead of 2^depth, at any depth, for a whole Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.functions.columns import FEATURES, NO_SIGNAL, phrase
from keepwell.operators.trees import Forest, Tree, matrix
from keepwell.sources.shared import python_ready


def mean_output(tree: Tree) -> float:
    """What a tree gives a row of which nothing is known."""
    reach = np.zeros(len(tree.feature))
    reach[0] = 1.0
    for n in range(len(tree.feature)):  # a node comes before those below it
        if tree.feature[n] >= 0:
            for child in (tree.left[n], tree.right[n]):
                reach[child] = reach[n] * tree.cover[child] / (tree.cover[tree.left[n]] + tree.cover[tree.right[n]])
    return float((reach * tree.value)[tree.feature < 0].sum())


def paths(tree: Tree) -> Iterator[tuple[int, list[tuple[int, bool]]]]:
    """Each leaf with the nodes above it and whether its path goes left there."""
    stack: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
    while stack:
        node, above = stack.pop()
        if tree.feature[node] < 0:
            yield node, above
        else:
            stack += [(int(tree.left[node]), [*above, (node, True)]), (int(tree.right[node]), [*above, (node, False)])]


def attribution(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The push of each feature for each row."""
    out = np.zeros(x.shape)
    to_left = {n: tree.goes_left(n, x) for n in range(len(tree.feature)) if tree.feature[n] >= 0}
    for leaf, above in paths(tree):
        one: dict[int, np.ndarray] = {}
        zero: dict[int, float] = {}
        for node, left in above:
            f, child = int(tree.feature[node]), tree.left[node] if left else tree.right[node]
            takes = to_left[node] if left else ~to_left[node]
            one[f] = one[f] & takes if f in one else takes
            zero[f] = zero.get(f, 1.0) * tree.cover[child] / (tree.cover[tree.left[node]] + tree.cover[tree.right[node]])
        used = list(one)
        points, weights = np.polynomial.legendre.leggauss(max(1, (len(used) + 1) // 2))
        for t, w in zip((points + 1) / 2, weights / 2, strict=True):
            factors = [np.where(one[f], t, 0.0) + zero[f] * (1 - t) for f in used]
            after = [np.ones(len(x))]
            for a in reversed(factors[1:]):
                after.append(after[-1] * a)
            before = np.full(len(x), w * tree.value[leaf])
            for f, a, rest in zip(used, factors, reversed(after), strict=True):
                out[:, f] += (one[f] - zero[f]) * before * rest
                before = before * a
    return out


def attribute(forest: Forest, rows: DataFrame, key: str = "user_id") -> DataFrame:
    """key, a push for each feature, base and margin (of which the score is the logistic): pushes and base add up to the
    margin."""
    spark, features = rows.sparkSession, forest.features
    python_ready(spark)
    base, sent = sum(map(mean_output, forest.trees)), spark.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, features)
            pushes = sum((attribution(t, x) for t in sent.value.trees), np.zeros(x.shape))
            columns = [*pushes.T, np.full(len(x), float(base)), sent.value.margin(x)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *[pa.array(c, pa.float64()) for c in columns]], names=[key, *features, "base", "margin"])

    picked = rows.select(key, *features)
    return picked.mapInArrow(run, f"{key} {picked.schema[key].dataType.simpleString()}, " + ", ".join(f"{f} double" for f in features) + ", base double, margin double")


def top_factor(pushes: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """user_id, top_factor: the feature that pushes a score up most, in words; the first of equals."""
    most = F.greatest(*[F.col(f) for f in features])
    name: Column = F.lit(None).cast("string")
    for f in reversed(features):
        name = F.when(F.col(f) == most, f).otherwise(name)
    return pushes.select("user_id", F.when(most > 0, phrase(name)).otherwise(NO_SIGNAL).alias("top_factor"))


def strongest(pushes: DataFrame, k: int = 4, features: Sequence[str] = FEATURES) -> DataFrame:
    """user_id, place, feature, push, direction: the k largest pushes of each user by size."""
    long = pushes.unpivot(["user_id"], list(features), "feature", "push")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.abs("push")), "feature"))
    return long.withColumn("place", place).where(F.col("place") <= k).withColumn("direction", F.when(F.col("push") > 0, "UP").otherwise("DOWN"))


def global_importance(pushes: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """feature, mean_abs: the largest first."""
    means = pushes.agg(*[F.avg(F.abs(f)).alias(f) for f in features])
    return means.unpivot([], list(features), "feature", "mean_abs").orderBy(F.desc("mean_abs"), "feature")
