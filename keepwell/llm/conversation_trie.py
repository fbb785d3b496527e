"""Prefix trie of conversations, rolled up by bands of depth.

A node is a distinct sequence of first turns, named by its depth and by 128 bits that its turns' hashes with their places
sum up to under exclusive or; the root is the sequence without turns. Sums over subtrees are taken in bands of ``BAND``
depths. Within a band each node explodes to its ancestors of that band alone, BAND rows at most, and these are summed. A
band's top nodes, now complete for their band, form a trie of a BAND-th of the depth, which is rolled up in the same way;
then the completed totals of a band's tops go to the ancestors in the band above. So a trie of depth d takes log d rounds to
the base BAND, and no node ever gives more than BAND rows in a round.

Turns are ordered by their number, null first, then by the hashes of role and text. A conversation's order and its running
hashes come from ranges over all turns, so a conversation of any length, or one with a third of all turns, is spread over
tasks; ids that end at a node are cut into chunks by ranges too, and only their digest runs through them one after the
other, chunk by chunk. Texts are hashed where they are read and never shuffled.

Null roles and texts are empty, rows without conv_id belong to no conversation and are left out, repeated rows are turns of
their own, whole texts are hashed however long, and an empty table has no conversation and so no node. Only the four named
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.llm.cluster import materialize, meet, python_ready
from keepwell.operators.ranks import with_running

#: Depths in a band.
BAND = 8
#: Each conversation takes up to SHARED - 1 turns from the first one of its FAMILY.
FAMILY, SHARED = 5, 9
#: A node's name.
NODE = ["depth", "a", "b"]


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), t1, t2 (hashes of role and text), n_bytes of each turn."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.lit(1).alias("one"),
    )
    ran = with_running(rows, ["conv_id"], [F.col("turn"), F.col("t1"), F.col("t2")], ["one"])
    return materialize(ran.select("conv_id", "t1", "t2", "n_bytes", (F.col("one_before") + 1).cast("long").alias("pos")), "turns")


def first_of(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (conv_id, depth, t1, t2, n_bytes, length) and conversations (conv_id, length): each conversation begins with
    the first turns of its family's first, where there are any, and goes on with its own from there."""
    c = F.col("conv_id")
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    firsts = sizes.select(c.alias("first"), F.least(F.col("n"), F.lit(SHARED - 1)).alias("there"))
    convs = sizes.withColumns({"h": shared_turns(c), "first": first_of(c)}).join(firsts, "first", "left")
    convs = convs.withColumn("taken", F.least(F.col("h"), F.coalesce("there", F.lit(0))))
    convs = materialize(convs.select("conv_id", "n", "taken", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "convs")
    own = meet(turns.where(F.col("pos") > shared_turns(c)), convs, "conv_id", "n", turns.count())
    own = own.withColumn("depth", F.col("pos") - shared_turns(c) + F.col("taken"))
    # the few first turns of a family's first, once for each of its conversations that takes them
    family = F.transform(F.sequence(F.lit(1 - FAMILY), F.lit(FAMILY - 1)), lambda i: F.col("first") + i)
    takers = F.filter(family, lambda x: (first_of(x) == F.col("first")) & (shared_turns(x) >= F.col("pos")))
    heads = turns.where((F.col("pos") < SHARED) & (c % FAMILY == 0)).withColumnRenamed("conv_id", "first").withColumn("conv_id", F.explode(takers))
    heads = heads.join(convs, "conv_id").withColumn("depth", F.col("pos"))
    columns = ["conv_id", "depth", "t1", "t2", "n_bytes", "length"]
    return own.select(*columns).unionByName(heads.select(*columns)), convs.select("conv_id", "length")


def _named(paths: DataFrame) -> DataFrame:
    """Paths with each node's name (depth, a, b) and its parent's (p1, p2)."""
    marked = paths.withColumns({"m1": F.xxhash64("depth", "t1", "t2"), "m2": F.xxhash64("t2", "depth", "t1")}).drop("t1", "t2")
    ran = with_running(marked, ["conv_id"], [F.col("depth")], (), xors=["m1", "m2"])
    before, own = ("m1_before", "m2_before"), ("m1", "m2")
    names = {x: F.col(p).bitwiseXOR(F.col(m)) for x, p, m in zip("ab", before, own, strict=True)}
    return materialize(ran.select("conv_id", "depth", "n_bytes", "length", *[n.alias(x) for x, n in names.items()], F.col(before[0]).alias("p1"), F.col(before[1]).alias("p2")), "paths")


def _nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """depth, a, b, conv_id (least member), n_convs, n_bytes, p1, p2, n_children of each node, the root included."""
    found = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("n_bytes", "p1", "p2")])
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"), none.alias("p1"), none.alias("p2"))
    nodes = materialize(found.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("a"), F.col("p2").alias("b")).agg(F.count("*").alias("n_children"))
    return materialize(nodes.join(children, NODE, "left").fillna(0, subset=["n_children"]), "nodes")


def _points(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node on the way of every conversation, the root included."""
    roots = convs.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in NODE])
    return paths.select("conv_id", *NODE).unionByName(roots)


def _up(chains: DataFrame, values: DataFrame) -> DataFrame:
    """Sums at each node of what the values (conv_id, band, depth, leaves, saved) give to their ancestors in that band."""
    met = values.join(chains, ["conv_id", "band"]).select(F.explode(F.filter("ids", lambda x: x.depth <= F.col("depth"))).alias("to"), "leaves", "saved")
    return met.groupBy("to.depth", "to.a", "to.b").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _rolled_up(points: DataFrame, values: DataFrame, deepest: int, step: int = 1, band: int = BAND) -> DataFrame:
    """depth, a, b, leaves, saved summed over subtrees, for the nodes whose depth is a multiple of step. values: these
    nodes (NODE, conv_id) with their own leaves and saved."""
    height = step * band
    of = lambda depth: F.floor(depth / height).cast("long")
    chains = points.where(F.col("depth") % step == 0).groupBy("conv_id", of(F.col("depth")).alias("band")).agg(F.array_sort(F.collect_list(F.struct(*NODE))).alias("ids"))
    if deepest < height:
        return _up(chains, values.withColumn("band", of(F.col("depth"))))
    chains = materialize(chains, "chains")  # a row holds band names at most
    inside = materialize(_up(chains, values.withColumn("band", of(F.col("depth")))), "inside")
    tops = inside.where(F.col("depth") % height == 0).join(values.select(*NODE, "conv_id"), NODE)
    whole = _rolled_up(points, tops, deepest, height, band)
    below = whole.where("depth > 0").join(values.select(*NODE, "conv_id"), NODE)
    handed = _up(chains, below.withColumn("band", of(F.col("depth")) - 1))
    return inside.unionByName(handed).groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 from the conversations (NODE, conv_id) that end at a node. Ids are sorted by ranges, in
    which a node may fill many tasks, and joined in chunks of an Arrow batch at most; a node's chunks are then digested one after the other."""
    python_ready(ends.sparkSession)
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*NODE, "conv_id"]

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            out = [(*node, (ids := [r[3] for r in of])[0], ",".join(map(str, ids))) for node, of in groupby(rows, key=lambda r: r[:3])]
            yield pa.RecordBatch.from_pylist([dict(zip([*keys, "ids"], r, strict=True)) for r in out], pa.schema([(c, pa.int64()) for c in keys] + [("ids", pa.string())]))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(node, running) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in node], pa.array([running.hexdigest()])], names=[*NODE, "ends_sha256"])

        now, running = None, None
        for batch in batches:
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"]), strict=True):
                if node == now:
                    running.update(b"," + ids.encode())
                    continue
                if now is not None:
                    yield done(now, running)
                now, running = node, hashlib.sha256(ids.encode())
        if now is not None:
            yield done(now, running)

    chunks = ends.select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(chunk, "depth long, a long, b long, conv_id long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*keys).mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def trie(paths: DataFrame, convs: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. paths: conv_id, depth (from 1, without gaps), t1, t2, n_bytes, length; convs: conv_id, length."""
    deepest = convs.agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
    paths = _named(paths)
    nodes = _nodes(paths, convs)
    own = nodes.select(*NODE, "conv_id", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    totals = _rolled_up(_points(paths, convs), own, deepest, band=band)
    turnless = convs.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id")
    ends = _end_digests(paths.where("depth = length").select(*NODE, "conv_id").unionByName(turnless))
    # a parent with very many children is met by a broadcast, so these stay where they are
    name = lambda depth, a, b: F.struct(depth.alias("depth"), F.col(a).alias("a"), F.col(b).alias("b")).alias("parent")
    parents = nodes.where("n_children > 0").select(name(F.col("depth"), "a", "b"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = meet(nodes.where("depth > 0").withColumn("parent", name(F.col("depth") - 1, "p1", "p2")), parents, "parent", "n_children", nodes.count())
    below = below.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children")
    every = below.unionByName(nodes.where("depth = 0").select(*NODE, "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children"))
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return every.join(totals, NODE).join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), digest.alias("ends_sha256")
    )


def query(spark, sf_dir):
    return trie(*rebuild(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), s AS (
  SELECT c, max(pos) AS n, c - c % 5 AS f,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_transform(range(8), lambda i: ((ascii(x) >> i::INT) & 1)::BIGINT)))),
      lambda a, x: xor(a >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 9 AS h
  FROM t GROUP BY c
), v AS (SELECT s.c, s.f, s.h, least(s.h, coalesce(b.n, 0)) AS k FROM s LEFT JOIN s b ON b.c = s.f),
r AS (
  SELECT v.c, t.pos AS d, role, text FROM v JOIN t ON t.c = v.f AND t.pos <= v.h
  UNION ALL SELECT v.c, t.pos - v.h + v.k, role, text FROM v JOIN t ON t.c = v.c AND t.pos > v.h
), p AS (
  SELECT c, d, strlen(text) AS bytes, sha256(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER w) AS id FROM r WINDOW w AS (PARTITION BY c ORDER BY d)
  UNION ALL SELECT c, 0, 0, 'root' FROM s
), n AS (SELECT d, id, min(c) AS c, count(*) AS members, any_value(bytes) AS bytes FROM p GROUP BY d, id),
e AS (
  SELECT id, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(id, d) AS id FROM p GROUP BY c) GROUP BY id
), w AS (SELECT n.*, q.id AS parent FROM n LEFT JOIN p q ON q.c = n.c AND q.d = n.d - 1),
k AS (SELECT parent AS id, count(*) AS kids FROM w WHERE parent IS NOT NULL GROUP BY parent),
u AS (
  SELECT a.id, sum((k.id IS NULL)::INT) AS leaves, sum((n.members - 1) * n.bytes) AS saved
  FROM n JOIN p a ON a.c = n.c AND a.d <= n.d LEFT JOIN k ON k.id = n.id GROUP BY a.id
)
SELECT w.c AS conv_id, w.d::BIGINT AS depth, o.c AS parent_conv_id, w.members::BIGINT AS n_convs, coalesce(k.kids, 0)::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens,
  coalesce(e.ends, sha256('')) AS ends_sha256
FROM w LEFT JOIN n o ON o.id = w.parent LEFT JOIN k ON k.id = w.id JOIN u ON u.id = w.id LEFT JOIN e ON e.id = w.id
"""
