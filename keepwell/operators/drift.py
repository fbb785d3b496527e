"""Population stability of features.

What a comparison needs of its baseline is a summary: the cuts of each feature and how many values fell into each bin, a
bounded row a feature. It can be stored, so the baseline is not read again, and grows by further weeks, whose values are
counted into the same bins. Sketches of weeks can be merged where the cuts themselves should follow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.functions.columns import FEATURES, shocked
from keepwell.operators.ranks import with_running
from keepwell.sources.shared import settle

FLOOR = 1e-6
#: feature, its cuts (empty without values), and the rows of each bin that has any.
SUMMARY = "feature string, cuts array<double>, bins array<struct<bin:int,n:bigint>>"


def _long(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, value of all that is not missing."""
    numbers = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return numbers.unpivot([], list(columns), "feature", "value").where(F.col("value").isNotNull())


def quantile_cuts(long: DataFrame, bins: int) -> DataFrame:
    """feature, cuts: the distinct i / bins quantiles of (feature, value), interpolated between neighbours. Exact at every
    size: rows are counted by distinct value, and running counts say which values stand at the wanted ranks."""
    return _cuts_of_counts(long.groupBy("feature", "value").agg(F.count("*").alias("n")), bins)


def _cuts_of_counts(counted: DataFrame, bins: int) -> DataFrame:
    ran = with_running(counted, ["feature"], [F.col("value")], ["n"])
    totals = counted.groupBy("feature").agg(F.sum("n").alias("total"))
    steps = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    at = F.transform(steps, lambda q: (F.col("total") - 1) * q)
    here = lambda rank: (rank >= F.col("n_before")) & (rank < F.col("n_before") + F.col("n"))
    met = ran.join(F.broadcast(totals), "feature").select("feature", "value", F.explode(F.filter(at, lambda x: here(F.floor(x)) | here(F.ceil(x)))).alias("at"))
    cut = met.groupBy("feature", "at").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    cut = cut.select("feature", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))).alias("cut"))
    return cut.groupBy("feature").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))  # bins + 1 of them at most


def _bin_of(value: Column) -> Column:
    """The bin by the cuts beside it: outer bins reach to infinity, a value on a cut belongs to the bin that it begins."""
    inner = F.slice("cuts", 2, F.greatest(F.size("cuts") - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda c: c <= value))


def _binned(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """feature, cuts, bins from (feature, value, n). Only the cuts, bins + 1 a feature, are broadcast."""
    placed = counted.join(F.broadcast(cuts), "feature").groupBy("feature", "cuts", _bin_of(F.col("value")).alias("bin")).agg(F.sum("n").alias("n"))
    return placed.groupBy("feature", "cuts").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))


def summarise(baseline: DataFrame, columns: Sequence[str] = FEATURES, bins: int = 10, approximate: bool = False) -> DataFrame:
    """The summary of a baseline, cut at its distinct quantiles. These are exact unless a sketch of them is asked for. The
    baseline is read once: quantiles and bins come from the counts of its distinct values."""
    counted = settle(_long(baseline, columns).groupBy("feature", "value").agg(F.count("*").alias("n")), "counted")
    sketch = F.percentile_approx("value", F.array(*[F.lit(i / bins) for i in range(bins + 1)]), 10_000)
    cuts = _long(baseline, columns).groupBy("feature").agg(F.array_distinct(F.array_sort(sketch)).alias("cuts")) if approximate else _cuts_of_counts(counted, bins)
    return _binned(counted, cuts)


def grown(summary: DataFrame, more: DataFrame) -> DataFrame:
    """The summary after further rows of the baseline, counted into its bins; the cuts stay."""
    columns = [r["feature"] for r in summary.select("feature").collect()]
    if not columns:
        return summary
    added = _binned(_long(more, columns).groupBy("feature", "value").agg(F.count("*").alias("n")), summary.select("feature", "cuts"))
    each = summary.unionByName(added).select("feature", "cuts", F.explode("bins").alias("b")).groupBy("feature", "cuts", "b.bin").agg(F.sum("b.n").alias("n"))
    return each.groupBy("feature", "cuts").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))


def stability_from(summary: DataFrame, new: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """feature, psi of new rows against a stored summary, for each column. A side without values, or a baseline of one
    value, has 0; missing values are left out."""
    spark = new.sparkSession
    known = summary.select("feature", "cuts")
    other = _binned(_long(new, columns).groupBy("feature", "value").agg(F.count("*").alias("n")), known)
    side = lambda df, b, n: df.select("feature", F.size("cuts").alias("n_cuts"), F.explode("bins").alias("x")).select("feature", "n_cuts", "x.bin", F.lit(b).cast("long") * F.col("x.n"), F.lit(n).cast("long") * F.col("x.n")).toDF("feature", "n_cuts", "bin", "b", "n")
    counts = side(summary, 1, 0).unionByName(side(other, 0, 1)).groupBy("feature", "bin").agg(F.max("n_cuts").alias("n_cuts"), F.sum("b").alias("b"), F.sum("n").alias("n"))
    # bins + 1 rows a feature from here on; bins that no row fell into add nothing, as both shares are the floor
    of_feature = counts.groupBy("feature").agg(F.max("n_cuts").alias("n_cuts"), F.sum("b").alias("all_b"), F.sum("n").alias("all_n"), F.collect_list(F.struct("b", "n")).alias("bins"))
    share = lambda part, whole: part / F.greatest(F.col(whole), F.lit(1)) + FLOOR
    term = lambda x: (share(x.n, "all_n") - share(x.b, "all_b")) * F.log(share(x.n, "all_n") / share(x.b, "all_b"))
    psi = F.aggregate("bins", F.lit(0.0), lambda total, x: total + term(x))
    sums = of_feature.where("all_b > 0 AND all_n > 0 AND n_cuts >= 2").select("feature", psi.alias("psi"))
    names = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("feature"))
    return names.join(F.broadcast(sums), "feature", "left").select("feature", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def stability(baseline: DataFrame, new: DataFrame, columns: Sequence[str] = FEATURES, bins: int = 10, approximate: bool = False) -> DataFrame:
    """feature, psi of new rows against a baseline."""
    return stability_from(summarise(baseline, columns, bins, approximate), new, columns)


# -- weeks -------------------------------------------------------------------------------------------------------------


def week_sketches(rows: DataFrame, week: str, columns: Sequence[str] = FEATURES, k: int = 400) -> DataFrame:
    """week, feature, sketch: a quantile sketch (KLL) of each week, a few kilobytes whatever the week holds."""
    return _long(rows, columns).groupBy("feature").agg(F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch")).select(F.lit(week).alias("week"), "feature", "sketch")


def summary_of_sketches(sketches: DataFrame, bins: int = 10, grid: int = 1000) -> DataFrame:
    """The summary of all the weeks together: cuts at the merged sketches' quantiles, and bins from a grid of quantiles, each
    of which stands for its share of the rows. Both are off by the sketch's error, under 1 % of the rows at k = 400."""
    merged = sketches.groupBy("feature").agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    at = lambda steps: F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(s) for s in steps]))
    cut = merged.select("feature", F.kll_sketch_get_n_double("sketch").alias("total"), F.array_distinct(F.array_sort(at([i / bins for i in range(bins + 1)]))).alias("cuts"), at([(i + 0.5) / grid for i in range(grid)]).alias("grid"))
    cell = cut.select("feature", "cuts", "total", F.posexplode("grid").alias("i", "value"))
    upto = lambda i: F.floor(F.col("total") * i / grid)
    placed = cell.groupBy("feature", "cuts", _bin_of(F.col("value")).alias("bin")).agg(F.sum(upto(F.col("i") + 1) - upto(F.col("i"))).alias("n"))
    return placed.where("n > 0").groupBy("feature", "cuts").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))


def drift_table(stabilities: DataFrame) -> DataFrame:
    return stabilities.withColumn("verdict", F.when(F.col("psi") > 0.2, "DRIFT").when(F.col("psi") > 0.1, "small shift").otherwise("stable"))


def retrain_verdict(table: DataFrame) -> DataFrame:
    """One row: how many features drifted, which, and whether to train again."""
    row = table.where("verdict = 'DRIFT'").agg(F.count("*").alias("n_drifted"), F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("drifted"))
    return row.withColumn("retrain", F.col("n_drifted") > 0)


def incident(features: DataFrame, deltas: Mapping[str, float]) -> DataFrame:
    """The features as they would look after an incident that raises some rates."""
    return features.withColumns({c: shocked(c, d) for c, d in deltas.items()})
