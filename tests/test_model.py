import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwell.functions.columns import FEATURES, PHRASES
from keepwell.operators import evaluation, explain, features, model
from keepwell.sources import io


@pytest.fixture(scope="module")
def rows(views):
    return model.split(features.build_features(views.users, views.orders, views.tickets, views.reviews, views.truth)).persist()


@pytest.fixture(scope="module")
def fitted(rows):
    return model.train(rows.where(~F.col("is_test")), trees=20)


def test_scores_are_probabilities_and_refits_agree(fitted, rows):
    one = {r[0]: r[1] for r in model.score(fitted, rows).select("user_id", "churn_probability").collect()}
    assert len(one) == rows.count() and all(0 <= p <= 1 for p in one.values())
    again = model.train(rows.where(~F.col("is_test")).repartition(5), trees=20)
    assert one == {r[0]: r[1] for r in model.score(again, rows).select("user_id", "churn_probability").collect()}


def test_split_is_stable_and_near_its_share(rows):
    one = {(r["user_id"], r["is_test"]) for r in rows.collect()}
    assert one == {(r["user_id"], r["is_test"]) for r in model.split(rows.drop("is_test").repartition(9)).collect()}
    assert 0.1 < np.mean([t for _, t in one]) < 0.4


@pytest.mark.parametrize("bits", [1, 4, 16])
@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 1.0])
def test_exact_split_takes_the_share_of_each_label(spark, bits, share):
    """With few buckets, many users stand in the one that is put in order; no plan sorts all users."""
    users = spark.range(301).select(F.col("id").alias("user_id"), (F.col("id") % 3 == 0).cast("int").alias("churned"), F.lit("x").alias("digest"))
    got = model.split_exactly(users, share, bits=bits)
    assert got.columns == ["user_id", "churned", "digest", "is_test"]
    taken = {(r["churned"], r["user_id"]) for r in got.collect() if r["is_test"]}
    import hashlib

    for label, n in ((1, 101), (0, 200)):
        ids = sorted((i for i in range(301) if (i % 3 == 0) == bool(label)), key=lambda i: (hashlib.md5(f"split:{i}".encode()).hexdigest(), i))
        assert {i for c, i in taken if c == label} == set(ids[: int(n * share + 0.5)])
    assert "RangePartitioning" not in got._jdf.queryExecution().executedPlan().toString() and "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_top_factor(spark):
    columns = "user_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    pushes = spark.createDataFrame([(1, -1.0, -1.0, 0.0, -1.0, -1.0, -1.0), (2, 0.5, 0.5, 0.1, 0.0, 0.0, 0.0)], columns)
    assert {r[0]: r[1] for r in explain.top_factor(pushes).collect()} == {1: "no strong signal", 2: "low review ratings"}
    four = explain.strongest(pushes, 2).where("user_id = 2").orderBy("place").collect()
    assert [(r["feature"], r["direction"]) for r in four] == [("avg_review_rating", "UP"), ("pct_low_reviews", "UP")]


def test_other_library_for_comparison(rows, tmp_path):
    """MLlib's trees on imputed values: saved, loaded, and measured by the same metrics."""
    m = model.train_mllib(rows.where(~F.col("is_test")), trees=3)
    io.save_model(m, str(tmp_path / "m"))
    again = io.load_model(str(tmp_path / "m"))
    held = rows.where("is_test")
    one, other = (evaluation.metrics(model.score_mllib(x, held)).collect() for x in (m, again))
    assert one == other and {r["metric"] for r in one} >= {"auc", "tp", "fp"}


def test_ablation_leaves_each_feature_out(spark):
    """A label that follows one feature: without that the model knows nothing, without another it knows as much."""
    users = spark.range(400).select(
        F.col("id").alias("user_id"), (F.col("id") % 2).cast("int").alias("churned"), (F.col("id") % 2 + F.col("id") % 3).cast("double").alias("tells"), F.lit(1.0).alias("says_nothing")
    )
    users = users.withColumn("is_test", F.col("user_id") % 5 == 0)
    got = {r["left_out"]: r["auc"] for r in model.ablation(users, ["tells", "says_nothing"], trees=5).collect()}
    assert set(got) == {None, "tells", "says_nothing"}
    assert got[None] == got["says_nothing"] > 0.7 and got["tells"] == 0.5


def test_registered_queries_take_the_whole_model(views):
    """What is registered on the model, from its trees, scores and pushes by hand."""
    from keepwell.plans import jobs

    m, table = jobs.fitted(views)
    assert len(m.trees) == 200
    scored = model.score(m, table)
    got = explain.attribute(m, table).join(scored.select("user_id", "churn_probability"), "user_id").toPandas()
    assert np.allclose(got[list(FEATURES)].sum(axis=1) + got["base"], got["margin"], atol=1e-8)
    assert np.allclose(1 / (1 + np.exp(-got["margin"])), got["churn_probability"], atol=1e-8)
    names = list(FEATURES)
    four = {(r["user_id"], r["place"]): (r["feature"], r["direction"]) for r in jobs.w3_strongest_factors(views).collect()}
    tops = {r["user_id"]: r["top_factor"] for r in jobs.l7_top_factor(views).collect()}
    for _, r in got.iterrows():
        by_size = sorted(names, key=lambda f: (-abs(r[f]), f))[:4]
        assert [four[r["user_id"], i + 1] for i in range(4)] == [(f, "UP" if r[f] > 0 else "DOWN") for f in by_size]
        most = max(names, key=lambda f: r[f])
        assert tops[r["user_id"]] == (PHRASES[most] if r[most] > 0 else "no strong signal")
    means = [(r["feature"], r["mean_abs"]) for r in jobs.l8_global_importance(views).collect()]
    assert [f for f, _ in means] == sorted(names, key=lambda f: -got[f].abs().mean()) and dict(means) == pytest.approx({f: got[f].abs().mean() for f in names})
    labels = {r["user_id"]: (r["churned"], r["is_test"], r["churn_probability"]) for r in scored.collect()}
    held = [(y, p) for y, t, p in labels.values() if t]
    metric = {r["metric"]: r["value"] for r in jobs.l4_held_out_metrics(views).collect()}
    wins = [(a > b) + (a == b) / 2 for y, a in held if y for z, b in held if not z]
    assert metric["tp"] == sum(y == 1 and p >= 0.5 for y, p in held) and metric["fp"] == sum(y == 0 and p >= 0.5 for y, p in held) and metric["auc"] == pytest.approx(np.mean(wins))
    assert {r["user_id"]: r["churn_probability"] for r in jobs.l3_model_scores(views).collect()} == {u: p for u, (_, _, p) in labels.items()}
    gains = dict.fromkeys(names, 0.0)
    for t in m.trees:
        for f, g in zip(t.feature, t.gain, strict=True):
            if f >= 0:
                gains[names[f]] += g
    shares = [(r["feature"], r["importance"]) for r in jobs.l5_importances(views).collect()]
    assert [f for f, _ in shares] == sorted(names, key=lambda f: -gains[f]) and dict(shares) == pytest.approx({f: g / sum(gains.values()) for f, g in gains.items()})
    flagged = {r["archetype"]: (r["n"], r["flagged"]) for r in jobs.a9_model_by_archetype(views).collect()}
    truth = [(r["archetype"], labels[r["user_id"]][2] > 0.5 if r["user_id"] in labels else False) for r in views.truth.collect()]
    assert flagged == {a: (sum(x == a for x, _ in truth), sum(f for x, f in truth if x == a)) for a in {x for x, _ in truth}}
    # the candidates: those with the highest products of score and order value among users not contacted of late
    kept = {r["user_id"] for r in jobs.JOBS["j6_suppressed"](views).collect()}
    value = {r["user_id"]: r["avg_order_value"] for r in table.collect()}
    ranked = sorted((u for u in kept if value.get(u) is not None), key=lambda u: (-labels[u][2] * value[u], u))[:15]
    top = {r["user_id"]: r for r in jobs.k2_model_candidates(views).collect()}
    assert set(top) == set(ranked)
    for u in ranked:
        assert top[u]["priority_score"] == pytest.approx(labels[u][2] * value[u], abs=0.01) and top[u]["churn_probability"] == pytest.approx(labels[u][2], abs=0.0006)


def test_other_rows_are_fitted_anew(spark, views, tmp_path):
    """Tables that change under the same name are not scored with the model of the old ones."""
    from keepwell.plans import jobs
    from keepwell.sources.views import Views

    def written(part):
        for name in ("customer", "nation", "orders", "lineitem", "events"):
            t = views.table(name)
            (t.where(F.col("c_custkey") % 3 != part) if name == "customer" else t).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))

    before = len(jobs.FITTED)
    written(0)
    one, _ = jobs.fitted(Views(spark, str(tmp_path)))
    jobs.fitted(Views(spark, str(tmp_path)))
    assert len(jobs.FITTED) == before + 1
    written(1)
    other, _ = jobs.fitted(Views(spark, str(tmp_path)))
    assert len(jobs.FITTED) == before + 2 and any(a.value.tolist() != b.value.tolist() for a, b in zip(one.trees, other.trees, strict=True))


def test_rows_in_another_order_are_not_fitted_again(spark, views, tmp_path):
    """Amounts that are added up in another order give means with other last digits; the model and its rows are the first's."""
    from keepwell.plans import jobs
    from keepwell.sources.views import Views

    means, got = [], []
    for i in range(2):
        for name in ("customer", "nation", "orders", "lineitem", "events"):
            t = views.table(name)
            (t.orderBy(F.rand(i)).repartition(2 + 5 * i) if name == "orders" else t).write.mode("overwrite").parquet(str(tmp_path / f"{i}" / f"{name}.parquet"))
        v = Views(spark, str(tmp_path / f"{i}"))
        means.append({r["user_id"]: r["avg_order_value"] for r in jobs.feature_table(v).where("total_orders > 0").collect()})
        scores = {r["user_id"]: r["churn_probability"] for r in jobs.l3_model_scores(v).collect()}
        got.append((len(jobs.FITTED), scores))
    assert means[0] != means[1] and means[0] == pytest.approx(means[1], rel=1e-12)
    assert got[0] == got[1]
