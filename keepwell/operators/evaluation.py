"""Verdicts and scores against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.functions.columns import is_flagged, over
from keepwell.operators.ranks import with_running

# The customer types in the order of the report, with what a flag on one means.
ARCHETYPES = (("cliff_dropper", "yes", "recall"), ("gradual_fader", "yes", "recall"), ("vacationer", "NO (trap)", "false-alarm"), ("loyal_bulk_buyer", "NO (trap)", "false-alarm"), ("regular_active", "no", "false-alarm"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def flagged_users(predictions: DataFrame, level: str = "risk_level") -> DataFrame:
    return predictions.where(is_flagged(level)).select("user_id").distinct()


def churned_users(truth: DataFrame) -> DataFrame:
    return truth.where("churned").select("user_id").distinct()


def caught(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    return flagged_users(predictions).intersect(churned_users(truth))


def false_alarms(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    return flagged_users(predictions).subtract(churned_users(truth))


def missed(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    return churned_users(truth).subtract(flagged_users(predictions))


def agent_scores(predictions: DataFrame, truth: DataFrame, level: str = "risk_level") -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of flagged against churned users; 0 where a denominator is."""
    both = flagged_users(predictions, level).withColumn("flagged", F.lit(True)).join(churned_users(truth).withColumn("churned", F.lit(True)), "user_id", "full")
    f, c = F.coalesce("flagged", F.lit(False)), F.coalesce("churned", F.lit(False))
    row = both.agg(F.count_if(f & c).alias("tp"), F.count_if(f & ~c).alias("fp"), F.count_if(~f & c).alias("fn"))
    row = row.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return row.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def by_archetype(truth: DataFrame, scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """place, archetype, churned (label), n, flagged, rate, meaning for each known type that occurs, strictly over the threshold."""
    marked = truth.select("user_id", "archetype").join(scored.where(over("churn_probability", threshold)).select("user_id", F.lit(1).alias("hit")).distinct(), "user_id", "left")
    groups = marked.groupBy("archetype").agg(F.count("*").alias("n"), F.count("hit").alias("flagged"))
    place, label, meaning = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, said, means) in enumerate(ARCHETYPES):
        here = F.col("archetype") == name
        place, label, meaning = F.when(here, i + 1).otherwise(place), F.when(here, said).otherwise(label), F.when(here, means).otherwise(meaning)
    known = groups.where(F.col("archetype").isin(*[a for a, _, _ in ARCHETYPES]))
    return known.select(place.alias("place"), "archetype", label.alias("churned"), "n", "flagged", (F.col("flagged") / F.col("n")).alias("rate"), meaning.alias("meaning"))


def label_mix(truth: DataFrame) -> DataFrame:
    """archetype, customers, churned for each type and, with a null archetype, for all."""
    count = [F.count("*").alias("customers"), F.count_if("churned").alias("churned")]
    return truth.groupBy("archetype").agg(*count).unionByName(truth.agg(*count).withColumn("archetype", F.lit(None).cast("string")))


def review_impact(reviewed: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, hits and flagged users before and after the review step changed risk_level to revised_level."""
    churned = churned_users(truth).withColumn("churned", F.lit(1))
    rows = reviewed.select("user_id", F.explode(F.array(F.struct(F.lit("before").alias("step"), F.col("risk_level").alias("level")), F.struct(F.lit("after").alias("step"), F.col("revised_level").alias("level")))).alias("s")).select("user_id", "s.*")
    flagged = rows.where(is_flagged("level")).select("step", "user_id").distinct().join(churned, "user_id", "left")
    found = flagged.groupBy("step").agg(F.count("churned").alias("tp"), F.count("*").alias("flagged"))
    steps = reviewed.sparkSession.range(2).select(F.when(F.col("id") == 0, "before").otherwise("after").alias("step"))
    return steps.join(found, "step", "left").fillna(0, subset=["tp", "flagged"]).withColumn("precision", _ratio(F.col("tp"), F.col("flagged")))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: tn, fp, fn, tp of churned against probability >= threshold."""
    hit, label = over("churn_probability", threshold, inclusive=True), F.col("churned") == 1
    return scored.agg(F.count_if(~label & ~hit).alias("tn"), F.count_if(~label & hit).alias("fp"), F.count_if(label & ~hit).alias("fn"), F.count_if(label & hit).alias("tp"))


def class_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """class, precision, recall, f1, support: for 0 and 1, accuracy, and the plain and weighted means."""
    c = confusion(scored, threshold)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))

    def of(name: str, right: Column, wrong: Column, left: Column) -> Column:
        p, r = _ratio(right, right + wrong), _ratio(right, right + left)
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"), (right + left).alias("support"))

    two = c.select(of("0", tn, fn, fp).alias("a"), of("1", tp, fp, fn).alias("b"), (tn + fp + fn + tp).alias("n"), _ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    mean = lambda f: (a[f] + b[f]) / 2
    weighted = lambda f: _ratio(a[f] * a["support"] + b[f] * b["support"], n)
    row = lambda name, f: F.struct(F.lit(name).alias("class"), *[f(x).alias(x) for x in ("precision", "recall", "f1")], n.alias("support"))
    return two.select(F.explode(F.array(a, b, row("accuracy", lambda _: F.col("accuracy")), row("macro avg", mean), row("weighted avg", weighted))).alias("r")).select("r.*")


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row: auc, with ties counted half, from counts by distinct score and their running totals; null where a class
    is missing. A row without score counts in neither class."""
    counts = scored.where(F.col("churn_probability").isNotNull()).groupBy(F.col("churn_probability").alias("score")).agg(F.count_if(F.col("churned") == 1).alias("pos"), F.count_if(F.col("churned") == 0).alias("neg"))
    won = with_running(counts, [], [F.col("score")], ["neg"]).withColumn("won", F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    row = won.agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return row.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("auc"))


def metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """metric, value: the confusion counts and the AUC in one long table."""
    counts = confusion(scored, threshold).unpivot([], ["tn", "fp", "fn", "tp"], "metric", "value")
    area = roc_auc(scored).select(F.lit("auc").alias("metric"), F.col("auc").alias("value"))
    return counts.select("metric", F.col("value").cast("double").alias("value")).unionByName(area)


def class_weight(rows: DataFrame) -> DataFrame:
    """One row: neg, pos and their ratio."""
    row = rows.agg(F.count_if(F.col("churned") == 0).alias("neg"), F.count_if(F.col("churned") == 1).alias("pos"))
    return row.withColumn("weight", F.when(F.col("pos") > 0, F.col("neg") / F.col("pos")).otherwise(1.0))


def naive_dormancy(truth: DataFrame, dormant: DataFrame) -> DataFrame:
    """How many of each type a rule flags that takes every dormant customer for a churner."""
    return by_archetype(truth, dormant.select("user_id", F.lit(1.0).alias("churn_probability")))
