"""Statistics, trees and the language model against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keepwell.llm import gbt, ppm, quality_classifier, quality_rules
from keepwell.llm.docstats import NAMES, features, stats
from keepwell.llm.textcols import is_remainder


def brute(text):
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return [len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(inside)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c d", "\n", " ", "é#", "a b c a b c a b c", "\n\n", "\x0b", "x\xa0y"]), max_size=60).map("".join))
def test_counts(text):
    assert stats(text.encode())[:5] == brute(text)


def test_rules_query(spark, data):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = quality_rules.query(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert [r[n] for n in NAMES[:5]] == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_agree_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in quality_rules.query(spark, folder).collect() if r["doc_id"] in labels]
    good = [r["kept"] for r in rows if labels[r["doc_id"]] == 1 and r["n_words"] >= 20]
    bad = [r["kept"] for r in rows if labels[r["doc_id"]] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.05


def test_classifier_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = quality_classifier.query(spark, folder).collect()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_monotone_trees():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = (np.sin(9 * x[:, 0]) + x[:, 1] + 0.3 * rng.normal(size=2000) > 0.5).astype(float)
    model = gbt.fit(x, y, np.array([-1, 1, 0]), trees=40)
    probe = np.repeat(rng.random((50, 3)), 40, axis=0)
    for f, sign in ((0, -1), (1, 1)):
        moved = probe.copy()
        moved[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(model.margin(moved).reshape(50, 40), axis=1) * sign
        assert (steps >= -1e-12).all()
    free = gbt.fit(x, y, trees=40)
    assert np.mean((free.score(x) > 0.5) == y) > 0.85


def walked(model, row):
    """A score by walking each tree from node to node."""
    margin = model.base
    for t in range(len(model.feature)):
        at, last = 0, model.feature.shape[1]
        while at < last:
            at = 2 * at + (2 if row[model.feature[t][at]] > model.threshold[t][at] else 1)
        margin += model.value[t][at - last]
    return 1 / (1 + math.exp(-margin))


def slow_boost(x, y, trees, depth, rate, bins, l2, least):
    """Boosting by trying every edge of every feature in every node over its own rows. Returns the margins."""
    share = (sum(y) + 1) / (len(y) + 2)
    margin = [math.log(share / (1 - share))] * len(y)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]

    def grow(rows, g, h, level):
        value = lambda some: sum(g[i] for i in some) / (sum(h[i] for i in some) + l2)
        loss = lambda some: -sum(g[i] for i in some) * value(some)
        best, found = 1e-6, None
        for f in range(x.shape[1]) if level < depth else ():
            for e in edges[f]:
                left, right = [i for i in rows if x[i, f] <= e], [i for i in rows if x[i, f] > e]
                if min(sum(h[i] for i in left), sum(h[i] for i in right)) < least:
                    continue
                gain = loss(rows) - loss(left) - loss(right)
                if gain > best + 1e-12:
                    best, found = gain, (left, right)
        if found is None:
            return [(rows, value(rows))]
        return [leaf for part in found for leaf in grow(part, g, h, level + 1)]

    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        for rows, v in grow(list(range(len(y))), [b - a for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p], 0):
            for i in rows:
                margin[i] += rate * v
    return margin


def test_trees_against_a_slow_booster():
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.random(90), rng.integers(0, 4, 90), rng.normal(size=90)])
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 1)).astype(float)
    model = gbt.fit(x, y, trees=6, depth=3, rate=0.3, bins=8, l2=1.0, least_weight=0.5)
    assert model.margin(x) == pytest.approx(slow_boost(x, y.tolist(), 6, 3, 0.3, 8, 1.0, 0.5), abs=1e-9)
    assert model.score(x) == pytest.approx([walked(model, r) for r in x], abs=1e-12)


def test_query_scores_by_walking_the_trees(spark, data):
    """Both registered tree queries against plain tree walks over plainly counted statistics, labels of the right fold only."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in texts}
    ids = sorted(i for i in quality if zlib.crc32(str(i).encode()) % 5)
    x, y = quality_classifier.training_rows(docs, labels, ~is_remainder(F.col("doc_id"), 5))
    assert np.array_equal(x, features([stats(texts[i]) for i in ids])) and y.tolist() == [quality[i] for i in ids]
    model = gbt.fit(x, y)
    for r in quality_classifier.query(spark, data).collect():
        assert r["score"] == pytest.approx(walked(model, features([stats(texts[r["doc_id"]])])[0]), abs=1e-9)
    rules = quality_rules.fit_rules(docs, labels)
    for r in quality_rules.query(spark, data).collect():
        score = walked(rules, features([stats(texts[r["doc_id"]])])[0][quality_rules.AT])
        assert r["score"] == pytest.approx(score, abs=1e-9) and r["kept"] == (not r["base_failed"] and r["score"] >= 0.3)


def test_constant_trees():
    assert gbt.fit(np.zeros((0, 2)), np.zeros(0)).score(np.zeros((3, 2))).tolist() == [0.5] * 3
    assert len(set(gbt.fit(np.eye(2), np.ones(2)).score(np.eye(2)))) == 1


class Reference:
    """Prediction by partial matching byte by byte."""

    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(Counter)
        for t in texts:
            x = bytes([ppm.BEFORE]) * order + t + bytes([ppm.END])
            for i in range(order, len(x)):
                for k in range(order + 1):
                    self.counts[x[i - k : i]][x[i]] += 1

    def probability(self, context, byte):
        gone, p = set(), 1.0
        for k in range(self.order, -1, -1):
            left = {b: n for b, n in self.counts.get(context[len(context) - k :], {}).items() if b not in gone}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if byte in left:
                return p * left[byte] / whole
            p, gone = p * len(left) / whole, gone | set(left)
        return p / (256 - len(gone))

    def score(self, text):
        x = bytes([ppm.BEFORE]) * self.order + text + bytes([ppm.END])
        return sum(math.log10(self.probability(x[i - self.order : i], x[i])) for i in range(self.order, len(x)))


def test_scores_equal_the_reference(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode().lower() for r in docs.collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    model, words = Reference(train, 2), Counter(w for t in train for w in [*t.split(), b""])
    n, v = sum(words.values()), len(words)
    got = {r["doc_id"]: r for r in ppm.score(docs, ~is_remainder(F.col("doc_id"), 10), order=2).collect()}
    for i, text in texts.items():
        tokens, r = [*text.split(), b""], got[i]
        assert r["trained"] == (zlib.crc32(str(i).encode()) % 10 != 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(words[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel=1e-9)
    for i in list(texts)[:40]:
        assert got[i]["score"] == pytest.approx(model.score(texts[i]), rel=1e-6)


def test_rare_words_meet_their_counts_in_a_join(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = ~is_remainder(F.col("doc_id"), 10)
    whole = {r["doc_id"]: r for r in ppm.score(docs, held, order=1).collect()}
    monkeypatch.setattr(ppm, "MAX_WORDS", 50)
    for r in ppm.score(docs, held, order=1).collect():
        assert r["n_known"] == whole[r["doc_id"]]["n_known"] and r["base_score"] == pytest.approx(whole[r["doc_id"]]["base_score"], rel=1e-9)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"abcd "), size=50)) for _ in range(30)]
    grams = Counter(k for t in texts for k in ppm.gram_keys(t, 3).tolist())
    rows = Counter()
    for key, n in grams.items():
        for m in range(4):
            rows[m, (key >> 8) & ((1 << 8 * m) - 1), key & 255] += n
    m, c, b, n = (np.array(x) for x in zip(*[(*k, v) for k, v in rows.items()], strict=True))
    trie = ppm.build(3, m, c, b, n)
    unseen = 256 - (m == 0).sum()
    columns = trie.column[sorted(set(b[m == 0].tolist()))]
    p = 10.0 ** trie.log10
    assert np.allclose(p[:, columns].sum(1) + unseen * p[:, -1], 1, atol=1e-5)
    reference = Reference(texts, 3)
    for t in (b"abca dd", b"xyz", b"", texts[0]):
        assert trie.scores([t, t])[1] == pytest.approx(reference.score(t), rel=1e-5)


def test_long_texts_in_parts(monkeypatch):
    grams = Counter(ppm.gram_keys(b"abcabcaab" * 9, 2).tolist())
    rows = Counter()
    for key, n in grams.items():
        for m in range(3):
            rows[m, (key >> 8) & ((1 << 8 * m) - 1), key & 255] += n
    trie = ppm.build(2, *(np.array(x) for x in zip(*[(*k, v) for k, v in rows.items()], strict=True)))
    texts = [b"abcab" * 20, b"", b"c", b"abc" * 50, b"b" * 33]
    whole = trie.scores(texts)
    monkeypatch.setattr(ppm, "CHUNK", 16)
    assert np.allclose(trie.scores(texts), whole)


@pytest.mark.parametrize("contexts,grams", [(20, 0), (300, 200)])
def test_contexts_outside_the_trie_score_the_same(spark, monkeypatch, contexts, grams):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdé "), size=rng.integers(1, 9))) for _ in range(60)]
    texts = {i: " ".join(rng.choice(words, size=rng.integers(0, 30))) for i in range(60)} | {60: "xyz abc", 61: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(ppm, "MAX_CONTEXTS", contexts)
    monkeypatch.setattr(ppm, "MAX_GRAMS", grams)
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs, F.col("doc_id") % 3 != 0, order=5).collect()}
    model = Reference([t.encode() for i, t in texts.items() if i % 3], 5)
    for i, text in texts.items():
        assert got[i] == pytest.approx(model.score(text.encode()), rel=1e-6)
