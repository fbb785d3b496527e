"""Running totals over rows in order, spread over the cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.sources.shared import settle


def with_running(rows: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Sequence[str], xors: Sequence[str] = ()) -> DataFrame:
    """Adds <name>_before for each of sums: its total over the rows of the same ``by`` (never null) that come earlier; for
    each of xors, longs, the exclusive or of these rows.

    Rows are range-partitioned by ``by`` and order, and written so. What a partition adds to its group is summed first and
    carried into the partitions that follow, by a broadcast of two rows a partition at most; inside a partition a window
    runs on. So a group of any size, even all rows, is spread over as many tasks as it fills.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    laid = settle(rows.repartitionByRange(parts, *keys, *order).withColumn("__part", F.spark_partition_id()), "ranked")
    folds = {s: F.sum for s in sums} | {x: F.bit_xor for x in xors}
    # groups lie side by side, so only a partition's first group can have begun in an earlier one: a row a partition
    first = laid.groupBy("__part").agg(F.min(F.struct(*by)).alias("g")).select("g.*").distinct() if by else None
    spread = laid if first is None else laid.join(F.broadcast(first), list(by), "left_semi")
    # a row for each of these groups and each partition that it reaches into: two rows a partition at most
    reached = spread.groupBy(*by, "__part").agg(*[fold(s).alias(f"__{s}") for s, fold in folds.items()])
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = reached.select(*by, "__part", *[fold(f"__{s}").over(earlier).alias(f"__{s}") for s, fold in folds.items()])
    inside = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = laid.withColumns({f"{s}_before": F.coalesce(fold(s).over(inside), F.lit(0)) for s, fold in folds.items()})
    joined = own.join(F.broadcast(carried), [*by, "__part"], "left")
    of = lambda name: F.coalesce(F.col(f"__{name}"), F.lit(0))
    added = {s: F.col(f"{s}_before") + of(s) for s in sums} | {x: F.col(f"{x}_before").bitwiseXOR(of(x)) for x in xors}
    return joined.withColumns({f"{s}_before": c for s, c in added.items()}).drop("__part", *[f"__{s}" for s in folds])
