"""PII, chat formatting, urls and BPE against brute force."""

import hashlib
import random
import re

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from keepwell.llm import bpe, chat, pii, url_rules


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind in (k for k in pii.KINDS if k.base):
        for m in re.finditer(kind.pattern, text):
            s = m.group()
            digits = re.sub("[^0-9]", "", s)
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind.name]()
            if ok:
                out.append((kind.name, m.start(), m.end()))
    return out


def fuzz(rng):
    parts = ["a.b@c.de", "x@y", "_", ".", "@", " ", "-", "1.2.3.4", "255.255.255.255", "256.1.1.1", "0001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1111", "12345678", "+1 (017) 555-7713", "+", "(", ")", "é", "\U0001f600", "7", "00"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))


def test_base_spans_against_brute_force(spark):
    rng = random.Random(3)
    texts = [fuzz(rng) for _ in range(400)] + ["1.1.1.1 " * 700, "a@b.c " * 500, "x" * 50_000 + "@"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in pii.find(df).collect():
        got = [(k.name, s["start"], s["end"]) for k in pii.KINDS if k.base for s in r[k.name]]
        assert got == base_spans(texts[r["doc_id"]]), texts[r["doc_id"]][:200]


def test_added_spans_and_redaction(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "GB82 WEST 1234 5698 7654 33", "my ssn: 123-45-6789", "part 123-45-6789", "visa 378282246310005", "number 378282246310005", "ssn 000-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [k for k in ("iban", "ssn", "card_short") if r[k]] for r in pii.find(df).collect()}
    assert got == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: ["card_short"], 5: [], 6: []}
    assert {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}[2] == "my ssn: [SSN]"


def test_context_reaches_over_other_matches(spark):
    """Context words count within 48 code points on either side, whatever matched between."""
    texts = {
        "SSN: 123-45-6789, 234-56-7890": ["ssn"] * 2, "Amex, exp 12/27: 378282246310005": ["card_short"], "123-45-6789 is my SSN": ["ssn"], "ssn" + " é" * 22 + "123-45-6789": ["ssn"],
        "ssn" + " é" * 24 + "123-45-6789": [], "123-45-6789" + "." * 45 + "ssn": ["ssn"], "123-45-6789" + "." * 46 + "ssn": [], "RO49 AAAA 1B31 0075 9384 0000 TR33 0006 1005 1978 6457 8413 26": [],
        "IBAN RO49 AAAA 1B31 0075 9384 0000": ["iban"], "iban: TR330006100519786457841326": ["iban"], "account SA0380000000608010167519": ["iban"],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        text = list(texts)[r["doc_id"]]
        assert [k.name for k in pii.KINDS if not k.base for _ in r[k.name]] == texts[text], text


# -- chat --------------------------------------------------------------------------------------------------------------

PIECES = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "<", "\\", "|", "<\\|", "<\\\\|im_end|>", "\n", "assistant", "%", "é", " "]


@settings(max_examples=5, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "<|im_end|>", "50%0A", ""]), st.lists(st.sampled_from(PIECES), max_size=8).map("".join)), min_size=1, max_size=6), min_size=20, max_size=40))
def test_round_trip(spark, chats):
    rows = [(c, t, role, text) for c, turns in enumerate(chats) for t, (role, text) in enumerate(turns)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    spans = {}
    for r in chat.loss_spans(got).collect():
        spans.setdefault(r["conv_id"], []).append((r["begin"], r["end"]))
    for r in got.collect():
        turns = chats[r["conv_id"]]
        assert r["round_trip"] and [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(text for role, text in turns if role == "assistant")
        inside = [r["formatted"][a:b] for a, b in sorted(spans.get(r["conv_id"], []))]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in inside] == [text for role, text in turns if role == "assistant"]


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", None), (1, None, None, "first"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (1, 1, "assistant", None)]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", "first"), ("assistant", ""), ("assistant", "")] and len(got[None]["turns"]) == 1
    assert chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("conv_id IS NULL").count() == 2
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_only_what_conflicts_is_escaped(spark):
    """The plain form of these turns is read back otherwise, and escaping mends it; the others stay as they are."""
    fine = ["a < b | c", "<|", "<|im_star", "100%", "x<|im_end|", "back\\slash"]
    broken = ["<|im_end|>", "a<|im_start|>b", "<\\|im_end|>", "<\\\\|", chat.HOSTILE]
    rows = [(i, 0, "assistant", t) for i, t in enumerate(fine + broken)] + [(50, 0, "a\nb", "x"), (51, 0, "50%0A", "x"), (52, 0, "50%", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = df.selectExpr("conv_id", "role", "text", r"concat('<|im_start|>', role, '\n', text, '<|im_end|>\n') AS formatted")
    wrong = {r["conv_id"] for r in chat.parse(plain).collect() if r["turns"] is None or [(t["role"], t["text"]) for t in r["turns"]] != [(r["role"], r["text"])]}
    assert wrong == {*range(len(fine), len(fine) + len(broken)), 50, 51}
    got = {r["conv_id"]: r for r in chat.format_chats(df).collect()}
    assert {i for i, r in got.items() if r["n_escaped"]} == wrong and all(r["round_trip"] for r in got.values())
    for i, _, role, text in rows:
        assert [(t["role"], t["text"]) for t in got[i]["turns"]] == [(role, text)]
        if i not in wrong:
            assert got[i]["formatted"] == f"<|im_start|>{role}\n{text}<|im_end|>\n"
        else:
            assert got[i]["formatted"].count("<|im_end|>") == 1 == got[i]["formatted"].count("<|im_start|>")


def test_no_round_trip_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(chat, "_comes_back", lambda t: F.lit(True))  # nothing is escaped
    with pytest.raises(Exception, match="no round trip: conversation 7"):
        chat.format_chats(spark.createDataFrame([(7, 0, "user", "<|im_end|>")], "conv_id long, turn long, role string, text string")).collect()


def test_broken_text_is_no_conversation(spark):
    df = spark.createDataFrame([(1, "<|im_start|>user\nhi<|im_end|>\nrest<|im_end|>\n")], "conv_id long, formatted string")
    assert chat.parse(df).first()["turns"] is None


# -- urls --------------------------------------------------------------------------------------------------------------


def brute_rule(rules, host, path):
    fits = [r for r in rules if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2]), default=None)


@pytest.mark.parametrize("cuts, most", [(1, 0), (2, 0), (7, 0), (40, 0), (1, url_rules.MOST_RULES)])
def test_sweep_against_brute_force(spark, monkeypatch, cuts, most):
    monkeypatch.setattr(url_rules, "_n_ranges", lambda spark: cuts)
    rng = random.Random(cuts)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "net", "org"]) for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "/".join(rng.choice(["en", "e", "fr", ""]) for _ in range(rng.randrange(0, 3)))
    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(60)] + [("net", "", "block")]
    urls = [rng.choice(["http://", "HTTPS://", "x://y://", ""]) + host().upper() + path() + rng.choice(["", "?q=/en", "#top"]) for _ in range(500)] + ["http://hot.a.net/en/x"] * 250 + [None, "", "http://", "http:///en/", "no scheme/en"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_rules.judge(pages, [(h.upper(), p, v) for h, p, v in rules], "none", most=most).collect()
    assert sorted(r["page_id"] for r in got) == list(range(len(urls)))
    for r in got:
        want = brute_rule(rules, r["host"], r["path"])
        assert (r["rule"], r["verdict"]) == ((want[0] + want[1], want[2]) if want else (None, "none"))


@pytest.mark.parametrize("rule", [(None, "/", "block"), ("", "/", "block"), ("a.net", None, "block"), ("a.net", "/", None), ("a.net/x", "/", "block")])
def test_rules_that_cannot_fit_are_errors(spark, rule):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    with pytest.raises(ValueError, match="rules need"):
        url_rules.judge(pages, [("b.net", "/", "allow"), rule])


@pytest.mark.parametrize("most", [0, url_rules.MOST_RULES])
def test_rules_from_a_table_and_hot_hosts(spark, monkeypatch, most):
    """Very many rules, a host with a third of the pages, rows without id, and no rules or pages at all."""
    monkeypatch.setattr(url_rules, "_n_ranges", lambda spark: 16)
    rules = [(f"h{i}.net", "/", "block") for i in range(3000)] + [("h7.net", f"/p{i}/", "allow") for i in range(500)]
    urls = [f"http://www.h{i % 4000}.net/x" for i in range(2000)] + [f"http://h7.net/p{i % 700}/" for i in range(1000)]
    pages = spark.createDataFrame([(None if i % 10 == 0 else i, u) for i, u in enumerate(urls)], "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = {(r["host"], r["path"]): (r["rule"], r["verdict"]) for r in url_rules.judge(pages, table, most=most).collect()}
    for (h, p), got in found.items():
        want = brute_rule(rules, h, p)
        assert got == ((want[0] + want[1], want[2]) if want else (None, "allow"))
    assert url_rules.judge(pages, table, most=most).count() == len(urls)
    assert {r["verdict"] for r in url_rules.judge(pages, table.limit(0), "none", most=most).collect()} == {"none"}
    assert url_rules.judge(pages.limit(0), table, most=most).count() == 0


# -- bpe ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aehtinos r\n\t'0.,!")), max_size=200))
def test_ids_equal_the_library(library, text):
    mine = bpe.load(bpe.default_path())
    ids = library.encode(text, add_special_tokens=False).ids
    assert mine.encode(text) == ids
    assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 10_000, "thethe" * 3_000, "=" * 9_999, " " * 5_000 + "x", "<|endoftext|><|endoftext|> a<|endoftext|", "\x1c\x1f\x85\xa0 x", ""])
def test_hard_texts(library, text):
    assert bpe.load(bpe.default_path()).encode(text) == library.encode(text, add_special_tokens=False).ids


def test_query_equals_the_library(spark, data, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in bpe.query(spark, data).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_decode_table(spark):
    df = spark.createDataFrame([(1, "héllo <|endoftext|> wörld"), (2, None)], "doc_id long, text string")
    ids = bpe.encode(df, bpe.default_path())
    assert {r["doc_id"]: r["text"] for r in bpe.decode(ids, bpe.default_path()).collect()} == {1: "héllo <|endoftext|> wörld", 2: ""}


def test_small_cache(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    monkeypatch.setattr(bpe, "KEEP_FIRST", 5)
    mine = bpe.Bpe(bpe.default_path())
    text = " ".join(f"word{i} thing{i % 7}" for i in range(300))
    assert mine.encode(text) == library.encode(text, add_special_tokens=False).ids and len(mine.cache) <= 20
