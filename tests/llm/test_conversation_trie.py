import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from keepwell.llm import conversation_trie as ct


def rebuilt(rows):
    """Each conversation's turns (role, text) by the rule, in memory."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])
        out[c] = first[:h] + turns[h:]
    return out


def plainly(paths):
    """The rows of the trie from whole prefixes."""
    members, kids = {}, {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves, saved = (not kids.get(p)), (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        stack = list(kids.get(p, []))
        while stack:
            x = stack.pop()
            leaves, saved = leaves + (not kids.get(x)), saved + (len(members[x]) - 1) * len(x[-1][1].encode())
            stack += kids.get(x, [])
        return leaves, saved

    rows = []
    for p, of in members.items():
        ends = ",".join(map(str, sorted(c for c in of if len(paths[c]) == len(p))))
        rows.append((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), len(kids.get(p, [])), *map(int, below(p)), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def run(spark, rows, **how):
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("pos", "t1", "a", "b", "n", "depth", "length", "one", "__part")})
    got = ct.trie(*ct.rebuild(ct.turns_of(table)), **how)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def made(seed, convs, longest):
    """Conversations over few different turns, so that prefixes are shared; some very short, some absent."""
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        if rnd.random() < 0.2:
            continue
        for t in range(rnd.choice([1, 2, 4, longest])):
            rows.append((c, t, rnd.choice(["user", "assistant"]) if rnd.random() < 0.1 else ["user", "assistant"][t % 2], rnd.choice(["ä", "bb", "ccc"]) if rnd.random() < 0.3 else f"turn {t}"))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("band", [2, 3, ct.BAND])
def test_against_whole_prefixes(spark, band):
    """Narrow bands, so that totals cross many of them and bands are banded again."""
    rows = made(band, 60, 30)
    assert run(spark, rows, band=band) == plainly(rebuilt(rows))


def test_nulls_and_repeats(spark):
    rows = [(0, None, "user", None), (0, 0, None, "x"), (0, 1, "user", "y"), (5, 3, "user", "p"), (5, 9, "assistant", "q"), (7, 0, "a", "z"), (8, 0, "a", "z"), (-3, 0, "user", "neg"), (None, 0, "user", "nobody's"), (11, 0, "u", "one"), (11, 0, "u", "one"), (12, 1, "ab", "c"), (13, 1, "a", "bc")]
    got = run(spark, rows)
    assert got == plainly(rebuilt(rows))
    assert [r for r in got if r[1] == 0][0][3] == 8  # those left without turns too


def test_no_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "x")]) == []


def test_one_very_long_conversation(spark):
    """A third of all turns in one conversation, many alike, with very long texts."""
    rows = [(1000, t, "user", f"t{t % 7}") for t in range(700)] + [(c, t, "user", f"{t}" * 2000) for c in range(1, 300) for t in range(4)]
    assert run(spark, rows) == plainly(rebuilt(rows))
