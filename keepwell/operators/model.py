"""Splitting, training and applying the churn model.

The model is ``trees.fit``: boosted trees that take missing values as they are. MLlib's trees, which want them imputed, stay
beside it for comparison.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepwell.functions.columns import FEATURES
from keepwell.operators import trees as T
from keepwell.operators.evaluation import roc_auc
from keepwell.sources.shared import settle, shared_dir

#: Features that may be missing; a model sees them imputed, beside an indicator.
NULLABLE = ("avg_review_rating", "avg_order_value")
CHECKPOINT_EVERY = 25


def split(rows: DataFrame, test: float = 0.25, seed: str = "split") -> DataFrame:
    """is_test by a hash of seed and id, which is independent of the label: each label is split alike, without a shuffle,
    and reruns and partitionings agree. The share is kept to the sampling error."""
    cut = f"{int(test * 2**32):08x}"
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("user_id").cast("string")).cast("binary"))
    return rows.withColumn("is_test", F.substring(digest, 1, 8) < cut)


def split_exactly(rows: DataFrame, test: float = 0.25, seed: str = "split", bits: int = 16) -> DataFrame:
    """is_test for the users whose hashes come first in their label: of each label just the share, rounded.

    Users are counted by label and by the first bits of their hash, at most 2^bits counts a label. These say in which bucket
    the cut falls and how many of it are wanted; only that bucket, a 2^bits-th of a label, is put in order. Its users'
    hashes come out as one bound for each label, and all others are decided by comparison with that.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("user_id").cast("string")).cast("binary"))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    hashed = settle(rows.select(F.col("churned").alias("label"), "user_id", digest.alias("digest"), F.shiftright(bucket, 32 - bits).alias("bucket")), "hashed")
    counts = hashed.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("label").orderBy("bucket")
    ran = counts.withColumns({"upto": F.sum("n").over(upto), "whole": F.sum("n").over(Window.partitionBy("label"))})  # 2^bits rows a label
    wanted = F.floor(F.col("whole") * test + 0.5)
    cut = ran.where((F.col("upto") > wanted) & (F.col("upto") - F.col("n") <= wanted)).select("label", "bucket", (wanted - F.col("upto") + F.col("n")).alias("left"))
    inside = hashed.join(F.broadcast(cut), ["label", "bucket"])
    placed = inside.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("digest", "user_id")))
    bound = placed.where(F.col("place") == F.col("left") + 1).select(F.col("label").alias("of_label"), F.col("digest").alias("from_digest"), F.col("user_id").alias("from_user"))
    # a label whose share is all of it has no bound
    met = rows.join(F.broadcast(bound), F.col("churned").eqNullSafe(F.col("of_label")), "left")
    before = (digest < F.col("from_digest")) | ((digest == F.col("from_digest")) & (F.col("user_id") < F.col("from_user")))
    return met.withColumn("is_test", F.coalesce(before, F.lit(True))).select(*rows.columns, "is_test")


def ablation(rows: DataFrame, features: Sequence[str] = FEATURES, **how: int) -> DataFrame:
    """left_out, auc on the rows with is_test: of the model on all features (left_out is null) and of one fitted without
    each feature. The models grow side by side on rows that are binned once."""
    training, held = rows.where(~F.col("is_test")), rows.where("is_test")
    left_out = [None, *features]
    fitted = train_each(training, [[f for f in features if f != out] for out in left_out], **how)
    of = lambda out, m: roc_auc(score(m, held)).select(F.lit(out).cast("string").alias("left_out"), "auc")
    return reduce(DataFrame.unionByName, map(of, left_out, fitted))


def with_indicators(rows: DataFrame) -> DataFrame:
    """Missing values marked in a column of their own; MLlib takes no missing value in a vector."""
    return rows.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in NULLABLE} | {c: F.col(c).cast("double") for c in FEATURES})


def assembled_names(features: Sequence[str] = FEATURES) -> list[str]:
    return [f"{c}_filled" if c in NULLABLE else c for c in features] + [f"{c}_missing" for c in NULLABLE if c in features]


def weighted(rows: DataFrame) -> DataFrame:
    """weight: negatives / positives for churned rows, 1 for the others."""
    counts = rows.agg(F.count_if(F.col("churned") == 0).alias("neg"), F.count_if(F.col("churned") == 1).alias("pos")).first()
    ratio = counts["neg"] / counts["pos"] if counts["pos"] else 1.0
    return rows.withColumn("weight", F.when(F.col("churned") == 1, ratio).otherwise(1.0))


def train_each(training: DataFrame, choices: Sequence[Sequence[str]], trees: int = 200, depth: int = 3, rate: float = 0.08, rows_share: float = 0.9, features_share: float = 0.9, seed: int = 42, **how: int) -> list[T.Forest]:
    """Class-weighted boosted trees on the training rows, for each choice of features."""
    counts = training.agg(F.count_if(F.col("churned") == 0).alias("neg"), F.count_if(F.col("churned") == 1).alias("pos")).first()
    weight = F.when(F.col("churned") == 1, counts["neg"] / counts["pos"] if counts["pos"] else 1.0).otherwise(1.0)
    return T.fit_each(training, choices, "churned", weight, trees, depth, rate, rows_share, features_share, seed, **how)


def train(training: DataFrame, trees: int = 200, depth: int = 3, rate: float = 0.08, rows_share: float = 0.9, features_share: float = 0.9, seed: int = 42, features: Sequence[str] = FEATURES, **how: int) -> T.Forest:
    """Class-weighted boosted trees on the training rows."""
    return train_each(training, [features], trees, depth, rate, rows_share, features_share, seed, **how)[0]


def score(model: T.Forest, rows: DataFrame) -> DataFrame:
    """The rows with churn_probability."""
    return T.score(model, rows)


def importances(model: T.Forest, spark: SparkSession) -> DataFrame:
    """feature, importance (its share of the gains), the largest first."""
    return spark.createDataFrame(list(model.importances().items()), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def train_mllib(training: DataFrame, trees: int = 200, depth: int = 3, rate: float = 0.08, rows_share: float = 0.9, features_share: float = 0.9, seed: int = 42, features: Sequence[str] = FEATURES) -> PipelineModel:
    """Class-weighted boosted trees. Imputation is fitted on the training rows alone, which stay in memory, spilling to
    disk, while the trees are grown; each level of a tree is one pass with tree-wise aggregation, and every
    CHECKPOINT_EVERY trees the lineage of the running predictions is cut in the shared folder."""
    sc = training.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(training.sparkSession))
    nullable = [c for c in NULLABLE if c in features]
    stages = [VectorAssembler(inputCols=assembled_names(features), outputCol="features"), GBTClassifier(labelCol="churned", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, checkpointInterval=CHECKPOINT_EVERY, subsamplingRate=rows_share, featureSubsetStrategy=str(features_share), seed=seed)]
    if nullable:
        stages.insert(0, Imputer(strategy="median", inputCols=nullable, outputCols=[f"{c}_filled" for c in nullable]))
    # subsampling draws row by row: with rows always in the same partitions and order, a refit gives the same trees
    parts = int(training.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = weighted(with_indicators(training)).repartition(parts, "user_id").sortWithinPartitions("user_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=stages).fit(ready)
    finally:
        ready.unpersist()


def score_mllib(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with churn_probability and the assembled vector."""
    out = model.transform(with_indicators(rows))
    return out.withColumn("churn_probability", vector_to_array("probability")[1]).select(*rows.columns, "features", "churn_probability")
