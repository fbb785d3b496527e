"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.llm.cluster import materialize, meet
from keepwell.sources.shared import new_path, remove

#: Links of a node that are met by a shuffle at most, where one row a node meets them; nodes of more are met by a broadcast.
MANY = 100_000


def components(edges: DataFrame, many: int = MANY) -> DataFrame:
    """node, component (the least node that its links reach) for every node of edges(a, b); loops and repeats may occur.

    Large star: each neighbour above a node is hung on the least node it sees. Small star: so are those below it, and the
    node. Edges never grow in number, components stay the same, and in the end, when a round changes nothing, each node
    hangs on the least of its component. A node with very many neighbours is met by a minimum, which is pre-aggregated, and
    by that one row: where any node has over ``many`` of them, these rows are broadcast, so its edges stay where they are. A
    round's table is deleted when the next one is written.
    """
    spark = edges.sparkSession
    root = new_path(spark, "edges")
    now, state = _kept(_tidy(edges.select("a", "b")), f"{root}/0")
    for i in count(1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = _tidy(_met(both.where("b > a"), least, many, state).select(F.col("b").alias("a"), F.col("m").alias("b")))
        # now a > b in every row: b are the lower neighbours of a
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hung = _met(large, low, many, state).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, new_state = _kept(_tidy(hung.unionByName(low.select("a", F.col("m").alias("b")))), f"{root}/{i}")
        remove(spark, f"{root}/{i - 1}")
        if new_state == state:
            break
        state = new_state
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _met(rows: DataFrame, least: DataFrame, many: int, state: tuple) -> DataFrame:
    """rows(a, b) with the m of their a. No node has more than ``many`` links where there are no more links than that."""
    if state[0] <= many:
        return rows.join(least.drop("n"), "a")
    return meet(rows, materialize(least, "least"), "a", "n", state[0])


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _kept(edges: DataFrame, path: str) -> tuple[DataFrame, tuple]:
    written = materialize(edges, "edges", path)
    return written, tuple(written.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
