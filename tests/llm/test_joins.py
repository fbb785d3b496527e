"""Exact copies, near copies, components and mixing against brute force."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import corpus_pipeline
from keepwell.llm import cluster, exact_dedup, jaccard, mixing
from keepwell.llm.components import components


def links_of(docs, words, num):
    """doc_id -> (size of its set, least id of its component), comparing all that share a shingle."""
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset([tuple(w[j : j + words]) for j in range(len(w) - words + 1)] or ([tuple(w)] if w else []))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    inside = defaultdict(list)
    for i, s in sets.items():
        common = Counter(j for t in s for j in inside[t])
        for j, n in common.items():
            if 100 * n >= num * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
        for t in s:
            inside[t].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def varied(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(1500)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    while len(rows) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9, 10, 11, 14, 20, 25, 40, 80, 200]))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 4, 9])):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0, 0.01, 0.02, 0.05])) + rng.randrange(2)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
            rows.append((len(rows) * 7 + 3, " ".join(w)))
    return rows


@pytest.mark.parametrize("words,num,block", [(3, 90, 4_000_000), (5, 80, 4_000_000), (3, 90, 700)])
def test_near_copies(spark, monkeypatch, words, num, block):
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block)
    rows = varied(words + block, 500)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), words, num).collect()}
    assert got == links_of(rows, words, num)


def test_near_copies_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.query(spark, folder).collect()}
    assert got == links_of(rows, 3, 90)


def test_texts_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MOST_BROADCAST", 0)
    monkeypatch.setattr(cluster, "MOST_BROADCAST", 0)
    rows = varied(9, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(df, 3, 90).collect()}
    want = links_of(rows, 3, 90)
    assert got == want
    assert {r["doc_id"] for r in jaccard.keep_one(df, 3, 90).collect()} == {i for i, (_, c) in want.items() if i == c}


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.sampled_from([(90, 100), (80, 100)]), st.randoms())
def test_similar_sets_share_a_segment(n, similar, rng):
    num, den = similar
    a = {rng.getrandbits(64) for _ in range(n)}
    b = set(a)
    for _ in range(rng.randrange(0, n // 9 + 2)):
        if rng.random() < 0.5 and b:
            b.discard(rng.choice(sorted(b)))
        else:
            b.add(rng.getrandbits(64))
    if den * len(a & b) >= num * len(a | b) and a != b and b:
        keys = [jaccard.segment_keys(np.array(sorted(s), np.uint64), num, den) for s in (a, b)]
        assert np.intersect1d(*keys).size


def near_sets(rng, n, tries):
    base = [rng.getrandbits(64) for _ in range(n)]
    sets = []
    for _ in range(tries):
        s = set(base) if rng.random() < 0.7 else {rng.getrandbits(64) for _ in range(n)}
        for _ in range(rng.randrange(0, n // rng.choice([1, 2, 6]) + 2)):
            s.discard(rng.choice(base)) if rng.random() < 0.5 else s.add(rng.getrandbits(64))
        sets.append(np.array(sorted(s or {1}), np.uint64))
    return sets


@pytest.mark.parametrize("group", [1, 3, 16])
@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.data_too_large])
@given(st.integers(1, 300), st.sampled_from([(90, 100), (80, 100), (40, 100), (10, 100)]), st.randoms())
def test_bounds_rule_out_no_link(group, n, similar, rng):
    """The forest of the bit matrix joins whatever is similar, also at low thresholds; the other forest joins just that."""
    num, den = similar
    sets = near_sets(rng, n, 14)
    old, jaccard.GROUP = jaccard.GROUP, group
    try:
        bits = list(jaccard.BitMatrix(np.array([len(s) for s in sets]), [jaccard.token_bits(s) for s in sets], num, den).forest())
        exact = list(jaccard.TokenGroupMatrix(sets, num, den).forest())
    finally:
        jaccard.GROUP = old

    def joined(pairs):
        up = list(range(len(sets)))
        find = lambda x: x if up[x] == x else find(up[x])
        for i, j in pairs:
            assert find(i) != find(j)
            up[find(i)] = find(j)
        return find

    links = [(i, j) for i in range(len(sets)) for j in range(i) if den * len(np.intersect1d(sets[i], sets[j])) >= num * len(np.union1d(sets[i], sets[j]))]
    by_bits, by_tokens = joined(bits), joined(exact)
    assert all(by_bits(i) == by_bits(j) and by_tokens(i) == by_tokens(j) for i, j in links)
    assert all((i, j) in links or (j, i) in links for i, j in exact)


def test_most_groups_are_decided_by_a_bound():
    rng = random.Random(5)
    sets = [s for _ in range(40) for s in near_sets(rng, 120, 6)]
    matrix = jaccard.BitMatrix(np.array([len(s) for s in sets]), [jaccard.token_bits(s) for s in sets], 90, 100)
    list(matrix.forest())
    assert matrix.bounded > 2000 and matrix.opened < 0.05 * matrix.bounded


def test_low_thresholds(spark):
    rows = [r for r in varied(3, 160) if len(r[1].split()) < 60]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 2, 35).collect()}
    assert got == links_of(rows, 2, 35)


def test_hot_classes_and_keys(spark, monkeypatch):
    """A class and a segment that a third of all documents have are met without a shuffle of their rows."""
    monkeypatch.setattr(cluster, "LEAST_HOT", 5)
    rows = varied(21, 120) + [(5000 + i, "one text that very many documents have word for word") for i in range(80)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == links_of(rows, 3, 90)


@pytest.mark.parametrize("block_sets,block_shingles,block_tokens,broadcast", [(7, 32_000_000, 4_000_000, 100), (10_000, 32_000_000, 900, 100), (10_000, 600, 4_000_000, 0), (5, 900, 500, 0)])
def test_neighbourhoods_and_groups_in_blocks(spark, monkeypatch, block_sets, block_shingles, block_tokens, broadcast):
    monkeypatch.setattr(cluster, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block_sets)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block_shingles)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", block_tokens)
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(900)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == links_of(rows, 3, 90)


@pytest.mark.parametrize("many", [100_000, 10])
def test_components(spark, monkeypatch, many):
    """Chains and hubs; with few links allowed to a node in a shuffle, hubs are met by a broadcast."""
    from keepwell.llm import cluster

    monkeypatch.setattr(cluster, "LEAST_HOT", 20)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(50)] + [(9000, 8900 + i) for i in range(60)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), many).collect()}
    assert got == {x: find(x) for x in list(up) if x in {y for e in edges if e[0] != e[1] for y in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_temporary_tables_go_when_the_result_stands(spark, data):
    from keepwell.llm import cluster
    from keepwell.sources.shared import children, shared_dir

    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = set(children(spark, shared_dir(spark)))
    found = jaccard.near_copies(docs, 3, 90)
    left = {x.rsplit("-", 1)[0] for x in set(children(spark, shared_dir(spark))) - before}
    assert left <= {"sets", "labels", "edges"} and found.count() == docs.count()
    with cluster.temporary(spark) as keep:
        kept, gone = keep(cluster.materialize(spark.range(3), "kept")), cluster.materialize(spark.range(3), "gone")
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()


def test_exact_copies_with_hot_texts(spark):
    rows = [(i, "HOT text" if i % 3 == 0 else f"text {i // 4}") for i in range(900)] + [(5000, "hot TEXT"), (5001, "É"), (5002, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in t)].append(i)
    want = {i: (max(g), len(g)) for g in groups.values() for i in g}
    for tracked, hot in ((4096, 256), (4, 2)):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.mark_copies(df, tracked=tracked, hot=hot).collect()}
        assert got == want
    assert {r["doc_id"] for r in exact_dedup.drop_copies(df).collect()} == {k for k, _ in want.values()}


@pytest.mark.parametrize("broadcast", [250_000, 0])
def test_repeated_rows_are_left_once(spark, monkeypatch, broadcast):
    monkeypatch.setattr(exact_dedup, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(cluster, "MOST_BROADCAST", broadcast)
    rows = [(1, "a", "x")] * 5 + [(2, "A", "y")] * 3 + [(3, "b", "z"), (None, None, None), (None, None, "q"), (None, "c", None)]
    got = exact_dedup.drop_copies(spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(2, "A"), (3, "b"), (None, None), (None, "c")], key=str) and got.columns == ["doc_id", "text", "kept"]


def seats_one_by_one(weights, caps, seats):
    out = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if out[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        out[max(open_, key=lambda i: (Fraction(weights[i]) / (2 * out[i] + 1), -i))] += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 120), st.data())
def test_seats(weights, seats, data):
    caps = [data.draw(st.integers(0, 40)) for _ in weights]
    assert mixing.sainte_lague(weights, caps, seats) == seats_one_by_one(weights, caps, seats)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.fractions(0, 9, max_denominator=12), min_size=1, max_size=6), st.integers(0, 200))
def test_seats_of_fractions(weights, seats):
    caps = [60] * len(weights)
    assert mixing.sainte_lague(weights, caps, seats) == seats_one_by_one(weights, caps, seats)


@pytest.mark.parametrize(
    "weights,caps,seats",
    [
        ([3, 5, 5, 1], [26, 39, 40, 9], 113), ([0, 0, 3, 0, 5, 5, 1], [0, 0, 26, 0, 39, 40, 9], 113), ([1, 1, 1], [9, 9, 9], 4), ([1, 3, 9], [50] * 3, 39), ([9, 3, 1], [50] * 3, 38),
        ([2, 6], [40, 40], 7), ([3, 1], [99, 99], 102), ([51 * 17, 51, 17], [2000] * 3, 1234), ([], [], 5), ([4], [2], 9),
    ],
)
def test_ties_of_unequal_weights(weights, caps, seats):
    """3/51 and 1/17 are one quotient: the earlier party takes the seat."""
    assert mixing.sainte_lague(weights, caps, seats) == seats_one_by_one(weights, caps, seats)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert sum(got) == pytest.approx(sum(sizes))
    assert all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    free = [(t / w) for t, s, w in zip(got, sizes, weights, strict=True) if t < 3 * s - 1e-9]
    assert not free or max(free) == pytest.approx(min(free))


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 400), rng.choice(["a"] * 30 + ["b", "B", "é", None])) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(map(tuple, mixing.mix(df.repartition(5)).drop("source").collect()))
    assert one == sorted(map(tuple, mixing.mix(df.coalesce(2)).drop("source").collect()))
    by = defaultdict(lambda: [0, 0, 0.0])
    source = {i: s for i, _, s in rows}
    words = Counter()
    for _, t, s in rows:
        words[s] += len(t.split())
    for doc_id, size, source_size, target, taken, copies in one:
        assert 0 <= taken <= 3 * size and 0 <= copies <= 3
        by[source[doc_id]][0] += size
        by[source[doc_id]][1] += taken
        by[source[doc_id]][2] = target
        assert source_size == words[source[doc_id]]
    assert sorted(by, key=lambda s: (s is None, s)) == ["B", "a", "b", "é", None]
    for size, taken, target in by.values():
        assert abs(taken - target) <= max(64, 0.01 * target), (size, taken, target)


def mixed_by_hand(spark, rows, block, seed):
    """doc_id -> (size, source_size, target, taken, copies): the words of each line written out one by one."""
    hashed = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("doc_id", "source", f"xxhash64({seed}, CAST(doc_id AS STRING)) AS place")
    places = {r["doc_id"]: r["place"] for r in hashed.collect()}
    docs = defaultdict(list)
    for i, text, source in rows:
        docs[source].append((places[i], i, len((text or "").split())))
    order = sorted(docs, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, _, n in docs[s]) for s in order]
    want, left, open_ = {}, Fraction(sum(sizes)), list(range(len(order)))
    while True:  # water filling, one full source at a time
        whole = sum(1 + i % 3 for i in open_)
        full = next((i for i in open_ if left * (1 + i % 3) > 3 * sizes[i] * whole), None)
        if full is None:
            want |= {i: left * (1 + i % 3) / whole for i in open_}
            break
        want[full] = Fraction(3 * sizes[full])
        left -= want[full]
        open_.remove(full)
    shards = {s: defaultdict(list) for s in order}
    for s in order:
        n_shards = math.ceil(len(docs[s]) / mixing.SHARD_ROWS)
        for place, i, n in sorted(docs[s]):
            shards[s][(place >> 20) % n_shards].append((i, n))
    n_blocks = lambda line: math.ceil(sum(n for _, n in line) / block)
    quotas = seats_one_by_one([want[k] for k in range(len(order))], [3 * sum(map(n_blocks, shards[s].values())) for s in order], round(sum(want.values()) / block))
    starts = {(r["source"], r["shard"]): r["h"] for r in spark.createDataFrame([(s, k) for s in order for k in shards[s]], "source string, shard int").selectExpr("source", "shard", f"xxhash64({seed}, source, shard) AS h").collect()}
    out = {}
    for k, s in enumerate(order):
        lines = sorted(shards[s].items())
        parts = seats_one_by_one([sum(n for _, n in line) for _, line in lines], [3 * n_blocks(line) for _, line in lines], quotas[k])
        for (shard, line), part in zip(lines, parts, strict=True):
            words = [i for i, n in line for _ in range(n)]
            blocks = [words[j : j + block] for j in range(0, len(words), block)]
            first = starts[s, shard] % len(blocks) if blocks else 0
            taken = Counter(w for j in range(part) for w in blocks[(first + j) % len(blocks)])
            passes = part // len(blocks) if blocks else 0
            for i, n in line:
                once = taken[i] - passes * n
                out[i] = (n, sizes[k], float(want[k]), taken[i], None if n == 0 else passes + (2 * once >= n))
    return out


@pytest.mark.parametrize("shard_rows,block", [(7, 5), (2000, 16)])
def test_mix_against_brute_force(spark, monkeypatch, shard_rows, block):
    monkeypatch.setattr(mixing, "SHARD_ROWS", shard_rows)
    rng = random.Random(shard_rows)
    rows = [(i, "w " * rng.choice([0, 1, 3, 17, 40, 200, 3000 if i % 97 == 0 else 5]), rng.choice(["a"] * 20 + ["b"] * 3 + ["B", "é", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = mixed_by_hand(spark, rows, block, mixing.SEED)
    got = {r["doc_id"]: r for r in mixing.mix(df.repartition(3), block=block).collect()}
    for i, (size, source_size, target, taken, copies) in want.items():
        r = got[i]
        assert (r["size"], r["source_size"], r["taken"]) == (size, source_size, taken) and r["target"] == pytest.approx(target)
        assert copies in (None, r["copies"])
    emitted = Counter(r["doc_id"] for r in mixing.apply_mix(df, block=block).collect())
    assert emitted == Counter({i: r["copies"] for i, r in got.items() if r["copies"]})


def test_emitted_words_follow_the_target_with_long_documents(spark):
    """Each border of a run is off by half a document at most."""
    rng = random.Random(11)
    rows = [(i, "w " * (20_000 if i % 40 == 0 else rng.randrange(5, 60)), "long" if i % 4 == 0 else "short") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    emitted = Counter()
    for r in mixing.apply_mix(df).select("source", "text").collect():
        emitted[r["source"]] += len(r["text"].split())
    for r in got:
        assert abs(emitted[r["source"]] - r["max(target)"]) <= 20_000 + 64, (r, emitted)


def test_pipeline_stages(spark):
    """Each stage against brute force on its own input."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = corpus_pipeline.materialize(corpus_pipeline.quality(spark, docs, folder), "t")
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert np.mean([i in ids for i, q in labels.items() if q == 1]) > 0.98 and np.mean([i in ids for i, q in labels.items() if q == 0]) < 0.05
    unique = corpus_pipeline.materialize(corpus_pipeline.exact_copies(spark, kept, folder), "t")
    last = {}
    for r in kept.collect():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
        last[key] = max(last.get(key, -1), r["doc_id"])
    assert {r["doc_id"] for r in unique.select("doc_id").collect()} == set(last.values())
    single = corpus_pipeline.materialize(corpus_pipeline.near_copies(spark, unique, folder), "t")
    want = links_of([(r["doc_id"], r["text"]) for r in unique.collect()], 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in want.items() if i == c}
    mixed = corpus_pipeline.materialize(corpus_pipeline.mix(spark, single, folder), "t")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(single).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    assert corpus_pipeline.encode(spark, mixed, folder).where("NOT round_trip").count() == 0
