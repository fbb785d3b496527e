"""Campaign uplift against a hold-out group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.functions.columns import uniform, winnability

BASE_RETURN = 0.08


def assign_arms(truth: DataFrame, seed: str = "arms", share: float = 0.7) -> DataFrame:
    """Churned users with arm: treatment or control, by a hash of seed and id, so reruns and partitions agree."""
    return truth.where("churned").withColumn("arm", F.when(uniform(seed, F.col("user_id")) < share, "treatment").otherwise("control"))


def with_outcome(arms: DataFrame, seed: str = "outcome", base: float = BASE_RETURN) -> DataFrame:
    """return_probability, and returned as a draw from it. Where returned is known already, it stays."""
    p = arms.withColumn("return_probability", F.lit(base) + F.when(F.col("arm") == "treatment", winnability()).otherwise(0.0))
    if "returned" in arms.columns:
        return p
    return p.withColumn("returned", (uniform(seed, F.col("user_id")) < F.col("return_probability")).cast("int"))


def uplift(outcomes: DataFrame) -> DataFrame:
    """One row: n, returned and return rate of each arm, and their difference; null where an arm is empty."""
    row = outcomes.agg(*[x for arm in ("treatment", "control") for x in (F.count_if(F.col("arm") == arm).alias(f"n_{arm}"), F.count_if((F.col("arm") == arm) & (F.col("returned") == 1)).alias(f"returned_{arm}"))])
    rate = lambda arm: F.try_divide(F.col(f"returned_{arm}"), F.col(f"n_{arm}"))
    return row.withColumns({"rate_treatment": rate("treatment"), "rate_control": rate("control"), "uplift": rate("treatment") - rate("control")})
