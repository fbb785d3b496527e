import numpy as np
import pytest

from keepwell.operators import drift


def reference(base, new, bins=10):
    """Brute force in numpy."""
    edges = np.unique(np.percentile(base, np.linspace(0, 100, bins + 1)))
    if len(edges) < 2:
        return 0.0
    cut = lambda x: np.bincount(np.searchsorted(edges[1:-1], x, side="right"), minlength=len(edges) - 1) / len(x) + 1e-6
    b, n = cut(base), cut(new)
    return float(((n - b) * np.log(n / b)).sum())


def psi(spark, base, new, **k):
    of = lambda xs: spark.createDataFrame([(None if x is None else float(x),) for x in xs], "x double")
    return drift.stability(of(base), of(new), ["x"], **k).first()["psi"]


def test_same_and_shifted(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 1, 500), rng.normal(2, 1, 500)
    assert psi(spark, a, a) < 0.01
    assert psi(spark, a, b) > 0.2
    assert psi(spark, a, b) == pytest.approx(reference(a, b), rel=1e-9)


@pytest.mark.parametrize("base,new", [([1, 1, 1], [2, 3]), ([], [1]), ([1, 2], []), ([None, None], [1])])
def test_nothing_to_compare(spark, base, new):
    assert psi(spark, base, new) == 0.0


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_outside_values(spark, seed):
    rng = np.random.default_rng(seed)
    base, new = rng.integers(0, 5, 80), rng.integers(-3, 9, 50)
    got = psi(spark, base, [*new, None])
    assert got >= 0 and got == pytest.approx(reference(base, new), rel=1e-9)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_exact_over_many_ranges(spark, parts):
    """Values at the wanted ranks are found wherever the ranges are cut."""
    rng = np.random.default_rng(5)
    base, new = np.round(rng.normal(0, 1, 3000), 1), rng.normal(0.3, 1, 900)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert psi(spark, base, new) == pytest.approx(reference(base, new), rel=1e-9)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sketch_is_close(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 4000), rng.normal(0.5, 1, 4000)
    assert psi(spark, a, b, approximate=True) == pytest.approx(reference(a, b), rel=0.05)


def test_labels_and_verdict(spark):
    table = drift.drift_table(spark.createDataFrame([("a", 0.3), ("b", 0.15), ("c", 0.2)], "feature string, psi double"))
    assert {r["feature"]: r["verdict"] for r in table.collect()} == {"a": "DRIFT", "b": "small shift", "c": "small shift"}
    assert tuple(drift.retrain_verdict(table).first()) == (1, "a", True)


def frame(spark, xs):
    return spark.createDataFrame([(None if x is None else float(x),) for x in xs], "x double")


def test_a_stored_summary_gives_the_same(spark, tmp_path):
    """Also after the baseline grew by rows that its cuts were not made of."""
    rng = np.random.default_rng(4)
    base, more, new = rng.integers(0, 40, 300), rng.integers(-5, 60, 100), rng.normal(25, 9, 200)
    drift.summarise(frame(spark, base), ["x"]).write.parquet(str(tmp_path / "s"))
    stored = spark.read.schema(drift.SUMMARY).parquet(str(tmp_path / "s"))
    got = drift.stability_from(stored, frame(spark, new), ["x"]).first()["psi"]
    assert got == pytest.approx(reference(base, new), rel=1e-9)
    edges = np.unique(np.percentile(base, np.linspace(0, 100, 11)))
    cut = lambda x: np.bincount(np.searchsorted(edges[1:-1], x, side="right"), minlength=len(edges) - 1) / len(x) + 1e-6
    b, n = cut(np.concatenate([base, more])), cut(new)
    got = drift.stability_from(drift.grown(stored, frame(spark, [*more, None])), frame(spark, new), ["x"]).first()["psi"]
    assert got == pytest.approx(float(((n - b) * np.log(n / b)).sum()), rel=1e-9)


def test_a_summary_without_values(spark):
    empty = drift.summarise(frame(spark, [None]), ["x"])
    assert empty.collect() == [] and drift.grown(empty, frame(spark, [1.0])).collect() == []
    assert drift.stability_from(empty, frame(spark, [1.0]), ["x"]).first()["psi"] == 0.0


def test_sketches_of_weeks_are_merged(spark):
    """Three weeks of different places; psi of their merged sketches is near the exact one, and bins are near a tenth."""
    rng = np.random.default_rng(5)
    weeks = [rng.normal(i, 1 + i / 2, 4000) for i in range(3)]
    sketches = drift.week_sketches(frame(spark, weeks[0]), "w0", ["x"])
    for i, w in enumerate(weeks[1:], 1):
        sketches = sketches.unionByName(drift.week_sketches(frame(spark, w), f"w{i}", ["x"]))
    summary = drift.summary_of_sketches(sketches)
    whole, new = np.concatenate(weeks), rng.normal(1, 1, 3000)
    row = summary.first()
    assert sum(b["n"] for b in row["bins"]) == len(whole) and all(abs(b["n"] / len(whole) - 0.1) < 0.02 for b in row["bins"])
    got = drift.stability_from(summary, frame(spark, new), ["x"]).first()["psi"]
    assert got == pytest.approx(reference(whole, new), rel=0.1)
    alone = drift.summary_of_sketches(drift.week_sketches(frame(spark, [1, 1, 1]), "w", ["x"]))
    assert drift.stability_from(alone, frame(spark, [2.0]), ["x"]).first()["psi"] == 0.0
