"""Boosted trees with missing values, and their attributions, against plain versions."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell.operators import explain, trees

FEATURES = ["a", "b", "c"]
SCHEMA = "user_id long, churned int, " + ", ".join(f"{f} double" for f in FEATURES)


def table(spark, n=400, seed=0):
    """Missing values that tell something, ties, a feature of two values, and labels that depend on all."""
    rnd = np.random.default_rng(seed)
    a, b, c = rnd.integers(0, 6, n).astype(float), rnd.normal(size=n).round(1), rnd.integers(0, 2, n).astype(float)
    a[rnd.random(n) < 0.3] = np.nan
    y = ((np.isnan(a) & (b > 0)) | (a > 3) ^ (c > 0)).astype(int)
    b[rnd.random(n) < 0.1] = np.nan
    none = lambda v: None if math.isnan(v) else float(v)
    return spark.createDataFrame([(i, int(y[i]), none(a[i]), none(b[i]), none(c[i])) for i in range(n)], SCHEMA), np.column_stack([a, b, c]), y


def plain_tree(x, g, h, cuts, rate, depth):
    """A tree as nested tuples by trying every cut and both sides for what is missing, a row at a time."""
    value = -rate * g.sum() / (h.sum() + trees.RIDGE)
    best = (1e-9, None)
    if depth:
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + trees.RIDGE)
        for f in range(x.shape[1]):
            gone = np.isnan(x[:, f])
            for missing_left in (False, True):
                for cut in [*cuts[f], math.inf]:
                    left = np.where(gone, missing_left, x[:, f] < cut)
                    if h[left].sum() < trees.LEAST_CURVATURE or h[~left].sum() < trees.LEAST_CURVATURE:
                        continue
                    gain = score(left) + score(~left) - score(np.full(len(g), True))
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, cut, missing_left, left))
    if best[1] is None:
        return value
    f, cut, missing_left, left = best[1]
    return (f, cut, missing_left, plain_tree(x[left], g[left], h[left], cuts, rate, depth - 1), plain_tree(x[~left], g[~left], h[~left], cuts, rate, depth - 1))


def nested(t, n=0):
    if t.feature[n] < 0:
        return t.value[n]
    return (int(t.feature[n]), float(t.threshold[n]), bool(t.missing_left[n]), nested(t, int(t.left[n])), nested(t, int(t.right[n])))


def same(one, other):
    if isinstance(one, tuple):
        return isinstance(other, tuple) and one[:3] == other[:3] and same(one[3], other[3]) and same(one[4], other[4])
    return not isinstance(other, tuple) and abs(one - other) < 1e-5


@pytest.mark.parametrize("depth", [1, 3])
def test_trees_equal_trying_everything(spark, depth):
    rows, x, y = table(spark)
    forest = trees.fit(rows, FEATURES, trees=3, depth=depth, rows_share=1.0, features_share=1.0)
    cuts = trees.cuts_of(rows, FEATURES)
    margin = np.zeros(len(y))
    for t in forest.trees:
        p = 1 / (1 + np.exp(-margin))
        want = plain_tree(x, p - y, p * (1 - p), cuts, 0.08, depth)
        assert same(nested(t), want)
        margin += t.value[t.leaves(x)]
    assert any(t.missing_left.any() for t in forest.trees) or depth == 1


def test_the_same_trees_in_one_place_and_on_the_cluster(spark, monkeypatch):
    """Also over a cut of the lineage, whatever the partitions, and with samples of rows and features."""
    monkeypatch.setattr(trees, "CUT_EVERY", 2)
    rows, _, _ = table(spark, 200)
    how = {"trees": 5, "depth": 2, "features_share": 0.6, "weight": F.when(F.col("churned") == 1, 1.7).otherwise(1.0)}
    one, other = trees.fit(rows, FEATURES, **how), trees.fit(rows.repartition(3), FEATURES, local_rows=0, **how)
    assert [nested(t) for t in one.trees] == [nested(t) for t in other.trees]
    assert len({tuple(t.feature) for t in one.trees}) > 1


def test_a_level_is_one_job_on_the_cluster(spark):
    """A tree of depth 3 costs three jobs, whatever its number: leaves follow from the sums above, and margins are added
    with the next tree's first level."""
    rows, _, _ = table(spark, 300)

    def jobs(n):
        spark.sparkContext.setJobGroup(f"fit {n}", "")
        forest = trees.fit(rows, FEATURES, trees=n, local_rows=0)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert all(len(t.feature) > 7 for t in forest.trees)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit {n}"))

    assert jobs(9) - jobs(2) <= 7 * 3


@pytest.mark.parametrize("local_rows", [0, 1000])
def test_forests_side_by_side_are_those_fitted_alone(spark, monkeypatch, local_rows):
    monkeypatch.setattr(trees, "CUT_EVERY", 2)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 20)
    rows, _, _ = table(spark, 200)
    choices = [["a", "b", "c"], ["a", "c"], ["c", "b"]]
    for c, forest in zip(choices, trees.fit_each(rows, choices, trees=5, features_share=0.6, local_rows=local_rows), strict=True):
        alone = trees.fit(rows, c, trees=5, features_share=0.6)
        assert forest.features == tuple(c) and [nested(t) for t in forest.trees] == [nested(t) for t in alone.trees]
        assert all((one.cover == other.cover).all() and (one.gain == other.gain).all() for one, other in zip(forest.trees, alone.trees, strict=True))


def test_missing_values_are_learnt(spark):
    """A label that is nothing but what is missing: one split parts it, and no value is made up for it."""
    rows = spark.createDataFrame([(i, i % 2, None if i % 2 else float(i % 7), 0.0, None) for i in range(200)], SCHEMA)
    forest = trees.fit(rows, FEATURES, trees=20, depth=1, rate=0.5, rows_share=1.0, features_share=1.0)
    got = {r["churned"]: r["churn_probability"] for r in trees.score(forest, rows).collect()}
    assert got[1] > 0.95 and got[0] < 0.05
    assert forest.importances() == {"a": 1.0, "b": 0.0, "c": 0.0}


def test_scores_columns_and_a_saved_forest(spark, tmp_path):
    rows, x, _ = table(spark, 150)
    forest = trees.fit(rows, FEATURES, trees=4)
    scored = trees.score(forest, rows.withColumn("odd", F.array(F.lit(1))))
    assert scored.columns == [*rows.columns, "odd", "churn_probability"]
    got = [r["churn_probability"] for r in scored.orderBy("user_id").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-forest.margin(x))))
    trees.save(forest, spark, str(tmp_path / "f"))
    again = trees.load(spark, str(tmp_path / "f"))
    assert again.features == forest.features and [nested(t) for t in again.trees] == [nested(t) for t in forest.trees]
    assert np.allclose(again.margin(x), forest.margin(x), atol=0)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    forest = trees.fit(none, FEATURES)
    assert forest.trees == () and forest.importances() == dict.fromkeys(FEATURES, 0.0)
    one = spark.createDataFrame([(1, 1, None, 2.0, None)], SCHEMA)
    assert [r["churn_probability"] for r in trees.score(forest, one).collect()] == [0.5]
    assert trees.score(trees.fit(one, FEATURES, trees=2, rows_share=1.0), none).collect() == []
    pushes = explain.attribute(forest, one).first()
    assert pushes["margin"] == 0 and pushes["base"] == 0 and pushes["a"] == 0


def by_subsets(tree, x):
    """Shapley values of a tree for one row from all subsets of its features."""
    used = sorted({int(f) for f in tree.feature if f >= 0})

    def mean(known, n=0):
        f = int(tree.feature[n])
        if f < 0:
            return tree.value[n]
        left, right = int(tree.left[n]), int(tree.right[n])
        if f in known:
            return mean(known, left if tree.goes_left(n, x[None])[0] else right)
        return (tree.cover[left] * mean(known, left) + tree.cover[right] * mean(known, right)) / (tree.cover[left] + tree.cover[right])

    out = np.zeros(len(x))
    k = len(used)
    for f in used:
        rest = [u for u in used if u != f]
        for size in range(k):
            for s in combinations(rest, size):
                out[f] += math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k) * (mean({*s, f}) - mean(set(s)))
    return out, mean(set())


@pytest.mark.parametrize("depth, n_features", [(1, 3), (3, 3), (8, 8)])
def test_attributions_equal_all_subsets(spark, depth, n_features):
    rnd = np.random.default_rng(depth)
    names = [f"f{i}" for i in range(n_features)]
    x = rnd.normal(size=(300, n_features))
    x[rnd.random(x.shape) < 0.15] = np.nan
    y = (np.nansum(x[:, : n_features // 2 + 1], axis=1) > 0).astype(int)
    none = lambda v: None if math.isnan(v) else float(v)
    rows = spark.createDataFrame([(i, int(y[i]), *map(none, x[i])) for i in range(len(x))], "user_id long, churned int, " + ", ".join(f"{f} double" for f in names))
    forest = trees.fit(rows, names, trees=2, depth=depth, rate=1.0, rows_share=1.0, features_share=1.0)
    assert depth < 8 or max(len(above) for t in forest.trees for _, above in explain.paths(t)) >= 6
    for t in forest.trees:
        got = explain.attribution(t, x[:25])
        for i in range(25):
            want, base = by_subsets(t, x[i])
            assert np.allclose(got[i], want, atol=1e-9) and base == pytest.approx(explain.mean_output(t), abs=1e-12)
    told = explain.attribute(forest, rows).toPandas().sort_values("user_id")
    assert np.allclose(told[names].sum(axis=1) + told["base"], told["margin"], atol=1e-9)
    assert np.allclose(told["margin"], forest.margin(x), atol=1e-12)
