"""URL filters by a sort-merge range join of reversed hosts.

A host's labels are reversed and each is ended by a dot, so ``www.example.net`` becomes ``net.example.www.`` and a rule's
host with all its subdomains becomes one interval of keys. Intervals are nested or apart. Rules and hosts are sorted by key
and swept once with a stack of the rules that are open; of the open rules whose path the page's path starts with, the
longest rule (host and path together, then the longer host) wins.

Up to ``MOST_RULES`` rules are broadcast, and each batch of pages is sorted and swept where it lies. More rules are cut into
key ranges across the cluster together with the pages, at places taken from a bounded sample of both, which decides nothing
but the balance; a host with very many pages is cut further by a hash of the page, a rule goes to each range that its
interval touches, and each range is one task's sweep.

Hosts of rules are lower-cased (A-Z) as those of pages are. A rule with a null part, or without a host, is an error, as is a
host with a character that ends one. A null url, or one without ``://``, has empty host and path and fits no rule; where no
rule fits, the verdict is ``default``. Of rules that tie in both lengths the last verdict in order wins. Urls are read
whole however long, repeated rows give repeated results, and an empty table of pages gives an empty one. Only id and url
are read, so other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.llm.cluster import materialize, python_ready, small
from keepwell.llm.textcols import ascii_lower

Rule = tuple[str, str, str]  # host, path, verdict

#: Rules that are broadcast at most (about 20 MB in a worker).
MOST_RULES = 50_000
#: Keys that are sampled for each range.
SAMPLED = 40

RULES: list[Rule] = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def reversed_key(host: str) -> str:
    return "".join(label + "." for label in reversed(host.split("."))) if host else ""


class Level:
    """The rules of one host: their verdicts by path, and the lengths of these paths."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.verdicts, self.lengths = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        if path not in self.verdicts and len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)
        self.verdicts[path] = max(verdict, self.verdicts.get(path, verdict))

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.lengths if n <= len(path) and path[:n] in self.verdicts), None)


class Sweep:
    """A stack of the rules that are open, fed with rules and hosts in the order of their keys."""

    def __init__(self):
        self.stack: list[Level] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def open(self, key: str, host: str, path: str, verdict: str) -> None:
        self._close(key)
        if not self.stack or self.stack[-1].key != key:
            self.stack.append(Level(key, host))
        self.stack[-1].add(path, verdict)

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that is open and fits, of equally long ones that of the longer host."""
        self._close(key)
        best = None
        for level in self.stack:
            p = level.longest(path)
            if p is not None and (best is None or len(level.host) + len(p) >= best[0]):
                best = (len(level.host) + len(p), level, p)
        return None if best is None else (best[1].host + best[2], best[1].verdicts[best[2]])


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """reversed_key as a column."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _n_ranges(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _cuts(keyed: DataFrame, n: int) -> list[tuple[str, int]]:
    """n - 1 places at most that cut (key, salt) into even ranges, from the SAMPLED * n rows whose keys and salts hash lowest."""
    rows = keyed.select("key", "salt").orderBy(F.xxhash64("salt", "key"), "key", "salt").limit(SAMPLED * n).collect()
    found = sorted((r["key"], r["salt"]) for r in rows)
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def checked(rules: DataFrame) -> DataFrame:
    """host, path, verdict of each rule once, hosts lower-cased; an error where a rule could never be told to fit."""
    known = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").distinct()
    bad = known.where(F.col("host").isNull() | (F.col("host") == "") | F.col("host").rlike("[/?#]") | F.col("path").isNull() | F.col("verdict").isNull())
    found = bad.limit(3).collect()
    if found:
        raise ValueError(f"rules need a host without / ? #, a path and a verdict: {[tuple(r) for r in found]}")
    return known


def judge(pages: DataFrame, rules: list[Rule] | DataFrame = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most: int = MOST_RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path, else null), verdict. rules: a list, or a table of host,
    path and verdict of any size."""
    spark = pages.sparkSession
    python_ready(spark)
    known = checked(rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "host string, path string, verdict string"))
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    few = known.limit(most + 1).collect()
    if len(few) <= most:
        return _where_they_lie(urls, [tuple(r) for r in few], default)
    return _in_ranges(urls, known, default)


def _won(state: Sweep, key: str, host: str, path: str, default: str) -> tuple[str | None, str]:
    return (state.judge(key, path) if host else None) or (None, default)


def _where_they_lie(urls: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """Each batch of pages, sorted by key, against all rules: one sweep a batch."""
    kind = urls.schema["page_id"].dataType.simpleString()
    sent = urls.sparkSession.sparkContext.broadcast(sorted((reversed_key(h), h, p, v) for h, p, v in rules))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = sent.value
        for batch in batches:
            hosts, paths = (batch.column(c).to_pylist() for c in ("host", "path"))
            keys = {h: reversed_key(h) for h in set(hosts)}
            state, at, won = Sweep(), 0, [(None, default)] * len(hosts)
            for i in sorted(range(len(hosts)), key=lambda i: keys[hosts[i]]):
                key = keys[hosts[i]]
                while at < len(ordered) and ordered[at][0] <= key:
                    state.open(*ordered[at])
                    at += 1
                won[i] = _won(state, key, hosts[i], paths[i], default)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([w[0] for w in won], pa.string()), pa.array([w[1] for w in won], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return urls.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")


def _in_ranges(urls: DataFrame, known: DataFrame, default: str) -> DataFrame:
    """Rules and pages cut into key ranges, one sweep a range."""
    kind, n = urls.schema["page_id"].dataType.simpleString(), _n_ranges(urls.sparkSession)
    pages = urls.select("*", F.lit(None).cast("string").alias("verdict"), key_of(F.col("host")).alias("key"), F.xxhash64("page_id", "path").alias("salt"))
    ruled = known.select(F.lit(None).cast(kind).alias("page_id"), "host", "path", "verdict", key_of(F.col("host")).alias("key"), F.lit(-(1 << 63)).alias("salt"))
    both = materialize(pages.unionByName(ruled), "urls")  # hosts and paths are read out of the urls once
    cuts = _cuts(both, n)  # SAMPLED * ranges rows at most come to the driver

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The range of each page, and all ranges that a rule's interval touches."""
        for batch in small(batches):
            keys, salts, is_rule = (batch.column(c).to_pylist() for c in ("key", "salt", "verdict"))
            ranges = [list(range(bisect_right(cuts, (k, s)), bisect_right(cuts, (k + chr(0x10FFFF), 0)) + 1)) if v is not None else [bisect_right(cuts, (k, s))] for k, s, v in zip(keys, salts, is_rule, strict=True)]
            owner = pa.array([i for i, r in enumerate(ranges) for _ in r], pa.int32())
            columns = [batch.column(c).take(owner) for c in ("page_id", "host", "path", "verdict", "key")]
            yield pa.RecordBatch.from_arrays([pa.array([x for r in ranges for x in r], pa.int32()), *columns], names=["range", "page_id", "host", "path", "verdict", "key"])

    dealt = both.mapInArrow(cut, f"range int, page_id {kind}, host string, path string, verdict string, key string")
    # a range's number is its partition's, and rules of a key come before its pages
    dealt = dealt.repartitionById(n, F.col("range")).sortWithinPartitions("range", "key", F.desc_nulls_last("verdict"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = Sweep(), None
        for batch in small(batches):
            wanted, won = [], []
            for i, (r, h, p, v, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("range", "host", "path", "verdict", "key")), strict=True)):
                if r != now:
                    state, now = Sweep(), r
                if v is not None:
                    state.open(k, h, p, v)
                    continue
                wanted.append(i)
                won.append(_won(state, k, h, p, default))
            rows = [batch.column(c).take(pa.array(wanted, pa.int32())) for c in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*rows, pa.array([w[0] for w in won], pa.string()), pa.array([w[1] for w in won], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return dealt.mapInArrow(sweep, f"page_id {kind}, host string, path string, rule string, verdict string")


def query(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
w AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT host, path FROM u) JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN w USING (host, path)
"""
