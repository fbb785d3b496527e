import random
import re

import pytest
from pyspark.sql import functions as F

from keepwell.llm import decontamination as dc
from tests.llm.conftest import LONG

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [(m.group(), m.start(), m.end()) for m in WORD.finditer((text or "").translate(UPPER))]


def plainly(text, items):
    """n_words, items, hit words' runs by comparing every place of the text with every window of every item."""
    own = words(text)
    plain, hit, found = [w for w, _, _ in own], set(), set()
    for item, body in items:
        theirs = [w for w, _, _ in words(body)]
        k = min(10, len(theirs))
        for i in range(len(theirs) - k + 1 if k else 0):
            for s in range(len(plain) - k + 1):
                if plain[s : s + k] == theirs[i : i + k]:
                    found.add("" if item is None else str(item))
                    hit.update(range(s, s + k))
    runs = [(i, next(j for j in range(i, len(own) + 1) if j not in hit) - 1) for i in sorted(hit) if i - 1 not in hit]
    return len(own), sorted(found), [(a, b, own[a][1], own[b][2]) for a, b in runs]


def many(seed=1):
    """Few words, so that windows meet, overlap and touch; unusual separators and letters."""
    rnd = random.Random(seed)
    vocabulary = ["a", "b", "Ça", "d1", "é", "ß", "x y", "😀"]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice([" ", ", ", "\n", "-", "\u0000", "_"]) for _ in range(n))
    items = [(i % 17, text(rnd.choice([0, 1, 3, 5, 9, 10, 11, 14]))) for i in range(20)] + [(None, "d1 d1 é é"), (3, None), (4, " ,;"), (10, "ZZ"), (2, "zz top zz top zz top zz top zz top zz top")]
    bodies = [text(rnd.choice([0, 2, 30, 60])) for _ in range(40)] + [None, "", "zz", "Zz!", "zzz", "éé", *[f"x {b} y" for _, b in items if b]]
    return items, bodies


@pytest.mark.parametrize("most", [dc.MOST_WINDOWS, 20], ids=["one automaton", "several"])
def test_against_every_window_at_every_place(spark, most):
    items, bodies = many()
    rows = list(enumerate(bodies)) + [(None, bodies[5])] + [(3, bodies[3])] * 2
    extra = {c: F.lit("x") for c in ("n_words", "items", "runs", "text_key", "of_id", "key", "item")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra)
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("key", "item")})
    got = dc.find(docs, benchmark, most=most).collect()
    seen = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], list(r["items"]), [tuple(x) for x in r["runs"]], r["contaminated"]) for r in got)
    want = []
    for doc_id, text in rows:
        n, found, runs = plainly(text, items)
        want.append((str(doc_id), n, sum(b - a + 1 for a, b, _, _ in runs), found, runs, bool(runs)))
    assert seen == sorted(want)
    clean = dc.keep_clean(docs, benchmark, most=most)
    assert clean.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(w[0] for w in want if not w[5])


def test_pieces_go_on_where_the_last_one_ended():
    """A window is met wherever a text is cut into pieces."""
    items, bodies = many(2)
    scanner = dc.Scanner([(k, str(i)) for i, b in items for k in dc.windows((b or "").encode())])
    for body in bodies:
        whole = scanner.scan((body or "").encode())
        assert whole == scanner.scan((body or "").encode(), piece=7) == scanner.scan((body or "").encode(), piece=1)


def test_odd_tables(odd_docs, no_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = dc.find(odd_docs, none).collect()
    assert len(found) == odd_docs.count() and not any(r["contaminated"] for r in found)
    assert dc.find(no_docs, odd_docs.withColumnRenamed("doc_id", "item_id")).collect() == []
    own = dc.find(odd_docs, odd_docs.withColumnRenamed("doc_id", "item_id")).collect()
    assert all(r["contaminated"] == (r["n_words"] > 0) and r["n_hit"] == r["n_words"] for r in own)
    long = next(r for r in own if r["n_words"] == len(words(LONG)))
    assert long["runs"][0]["begin"] == 0 and long["runs"][0]["end"] == len(LONG)
    assert dc.keep_clean(odd_docs, odd_docs.withColumnRenamed("doc_id", "item_id")).count() == sum(r["n_words"] == 0 for r in own)


def test_one_pass_and_no_shuffle_with_one_automaton(spark, data):
    assert "Exchange" not in dc.query(spark, data)._jdf.queryExecution().executedPlan().toString()
