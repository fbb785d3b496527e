"""Personal data in texts, from DataFrame and SQL functions alone.

Regular expressions propose spans from left to right without overlap within a kind; a match that fails its validator is
dropped and not tried again. The base kinds (email, ip, card, phone) stay whenever their own rule holds. The other kinds
need a score of ``THRESHOLD``: the pattern's share, plus the checksum's, plus the share of context words among the
``CONTEXT`` code points before or after the match, whatever else matched there.

Null texts count as empty, an empty text has no spans, whole texts are searched however long, repeated rows give repeated
results, an empty table an empty one. Kinds are apart, so spans of two kinds may overlap. Only id and text are read, so
other columns cannot clash. Positions are code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 48
THRESHOLD = 0.6
#: Matches are laid out in runs of this many, or of the square root of their number where that is more.
RUN = 128

# IBAN lengths by country, as the registry of the standard gives them.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}


@dataclass(frozen=True)
class Kind:
    name: str
    #: As the contract or the rule writes it; DuckDB reads this form.
    pattern: str
    #: The same matches found by Java in linear time: possessive where nothing can be given back, and starts only where one can be leftmost.
    java: str
    #: Holds for each text with a match; cheap.
    hint: str
    base: bool
    pattern_score: float = 1.0
    check_score: float = 0.0
    context_score: float = 0.0
    context: str = ""


KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"[A-Z][A-Z][0-9][0-9]", False, 0.2, 0.5, 0.2, "iban|account|konto|bank|compte|cuenta"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]-[0-9][0-9]-[0-9]", False, 0.3, 0.1, 0.4, "ssn|social security"),
    Kind("card_short", r"[0-9]([\x20-]?[0-9])+", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", False, 0.1, 0.3, 0.3, "card|karte|carte|tarjeta|visa|amex"),
)


def _hinted(text: Column, kind: Kind) -> Column:
    return text.contains(kind.hint) if len(kind.hint) == 1 else text.rlike(kind.hint)


def _luhn(digits: Column) -> Column:
    """Whether the digits' Luhn sum ends in 0."""
    n = F.char_length(digits)
    at = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  i-th from the right
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, at(i)).otherwise(twice(at(i))))
    return total % 10 == 0


def _mod97(compact: Column) -> Column:
    """Whether the IBAN, its first four characters moved to the end and letters read as 10 to 35, leaves 1 modulo 97."""
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c))) == 1


def _checked(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(match, r"\."), part)
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "card_short":
        return F.when(n.between(13, 15), _luhn(digits)).otherwise(False)
    if kind == "ssn":
        area = F.substr(match, F.lit(1), F.lit(3))
        return ~area.isin("000", "666") & ~area.startswith("9") & (F.substr(match, F.lit(5), F.lit(2)) != "00") & (F.substr(match, F.lit(8), F.lit(4)) != "0000")
    compact = F.replace(match, F.lit(" "), F.lit(""))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    return F.when(F.try_element_at(lengths, F.substr(compact, F.lit(1), F.lit(2))) == F.char_length(compact), _mod97(compact)).otherwise(False)


SPANS = "array<struct<start:int,end:int,score:double>>"


def pieces_of(text: Column, kind: Kind) -> Column:
    """Array of struct(gap, match, after): each match of a kind with the text between it and the one before, and, where the
    kind has context words, the CONTEXT code points after it."""
    after = rf"(?=([\s\S]{{0,{CONTEXT}}}))" if kind.context else "()"
    found = F.lit(rf"\G([\s\S]*?)({kind.java}){after}")
    group = lambda i: F.regexp_extract_all(text, found, F.lit(i))
    parts = F.arrays_zip(group(1).alias("gap"), group(2).alias("match"), (group(3) if kind.context else F.transform(group(1), lambda _: F.lit(""))).alias("after"))
    return F.when(_hinted(text, kind), parts).otherwise(F.array().cast("array<struct<gap:string,match:string,after:string>>"))


def spans_of(pieces: Column, kind: Kind) -> Column:
    """Array of struct(start, end, score) of a kind, in order, from its pieces."""
    none = F.array().cast(SPANS)
    last = lambda text: F.right(text, F.lit(CONTEXT))

    def step(acc: Column, x: Column) -> Column:
        start = acc.pos + F.char_length(x.gap)
        end = start + F.char_length(x.match)
        ok = _checked(kind.name, x.match)
        # before: the end of the text up to the last match, of which no more than CONTEXT is kept
        before = last(F.concat(acc.before, x.gap)) if kind.context else F.lit("")
        near = F.lower(before).rlike(kind.context) | F.lower(x.after).rlike(kind.context) if kind.context else F.lit(False)
        score = F.lit(kind.pattern_score) + F.when(ok, kind.check_score).otherwise(0.0) + F.when(near, kind.context_score).otherwise(0.0)
        wanted = ok if kind.base else ok & (F.round(score, 6) >= THRESHOLD)
        one = F.array(F.struct(start.alias("start"), end.alias("end"), score.alias("score")))
        rest = last(F.concat(before, x.match)) if kind.context else F.lit("")
        return F.struct(end.alias("pos"), rest.alias("before"), F.when(wanted, F.concat(acc.spans, one)).otherwise(acc.spans).cast(SPANS).alias("spans"))

    length = F.greatest(F.lit(RUN), F.ceil(F.sqrt(F.size(pieces))).cast("int"))

    def run(acc: Column, i: Column) -> Column:
        zero = F.struct(acc.pos.alias("pos"), acc.before.alias("before"), none.alias("spans"))
        return F.aggregate(F.slice(pieces, i * length + 1, length), zero, step, lambda a: F.struct(a.pos.alias("pos"), a.before.alias("before"), F.concat(acc.spans, a.spans).cast(SPANS).alias("spans")))

    runs = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / length).cast("int"))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("before"), none.alias("spans"))
    return F.when(F.size(pieces) == 0, none).otherwise(F.aggregate(runs, start, run, lambda acc: acc.spans))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (null made empty) and an array of spans for each kind, named by kind."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = text.select("doc_id", "text", *[pieces_of(F.col("text"), k).alias(f"{k.name}_pieces") for k in KINDS])
    return pieces.select("doc_id", "text", *[spans_of(F.col(f"{k.name}_pieces"), k).alias(k.name) for k in KINDS])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with each span replaced by its kind in brackets; of overlapping spans the one that starts first, then the longer, is replaced."""
    def labelled(k: Kind) -> Column:
        return F.transform(k.name, lambda s: F.struct(s.start.alias("start"), (-s.end).alias("minus_end"), F.lit(k.name).alias("kind")))

    spans = F.array_sort(F.concat(*[labelled(k) for k in KINDS]))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(F.col("text"), acc.pos + 1, s.start - acc.pos)
        out = F.concat(acc.out, F.array(between, F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))))
        return F.when(s.start < acc.pos, acc).otherwise(F.struct((-s.minus_end).alias("pos"), out.cast("array<string>").alias("out")))

    return find(docs, id_col, text_col).select("doc_id", F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substr(F.col("text"), acc.pos + 1))).alias("text"))


def query(spark, sf_dir):
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text")
    told = lambda k: F.transform(k.name, lambda s: F.concat_ws(":", F.lit(k.name), s.start.cast("string"), s.end.cast("string")))
    base, every = ([told(k) for k in KINDS if k.base], [told(k) for k in KINDS])
    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.concat(*base), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(*every), ",").alias("spans"))


def _sql() -> str:
    hints = {"email": "contains(t, '@')", "phone": "contains(t, '+')"}
    luhn = "list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN d[length(d) - i]::INT WHEN d[length(d) - i]::INT > 4 THEN 2 * d[length(d) - i]::INT - 9 ELSE 2 * d[length(d) - i]::INT END)) % 10 = 0"
    lengths = "MAP {" + ", ".join(f"'{c}': {n}" for c, n in IBAN_LENGTHS.items()) + "}"
    turned = "(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4])"
    expanded = f"array_to_string(list_transform(string_split({turned}, ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN (ascii(c) - 55)::VARCHAR ELSE c END), '')"
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(left(ltrim(p, '0'), 3) AS INT), 0) > 255)) = 0",
        "card": f"length(d) BETWEEN 16 AND 19 AND {luhn}",
        "phone": "length(d) BETWEEN 8 AND 15",
        "card_short": f"length(d) BETWEEN 13 AND 15 AND {luhn}",
        "ssn": "m[:3] NOT IN ('000', '666') AND m[1] <> '9' AND m[5:6] <> '00' AND m[8:11] <> '0000'",
        "iban": f"coalesce({lengths}[m[:2]], 0) = length(replace(m, ' ', '')) AND TRY_CAST({expanded} AS HUGEINT) % 97 = 1",
    }
    parts = []
    for order, k in enumerate(KINDS):
        around = f"(regexp_matches(lower(substring(t, greatest(1, s - {CONTEXT - 1}), least(s, {CONTEXT}))), '{k.context}') OR regexp_matches(lower(substring(t, e + 1, {CONTEXT})), '{k.context}'))"
        near = around if k.context else "false"
        wanted = "" if k.base else f" AND {k.pattern_score} + {k.check_score} + CASE WHEN {near} THEN {k.context_score} ELSE 0 END >= {THRESHOLD - 1e-9}"
        pattern = rf"((?s:.*?))({k.pattern})"
        parts.append(f"""
  SELECT doc_id, {order} AS o, '{k.name}' AS kind, s, e FROM (SELECT *, e - length(m) AS s FROM (
    SELECT doc_id, t, m, regexp_replace(m, '[^0-9]', '', 'g') AS d, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM (
      SELECT doc_id, t, unnest(regexp_extract_all(t, '{pattern}', 1)) AS g, unnest(regexp_extract_all(t, '{pattern}', 2)) AS m,
        generate_subscripts(regexp_extract_all(t, '{pattern}', 2), 1) AS i
      FROM texts WHERE {hints.get(k.name, f"regexp_matches(t, '{k.hint}')")})))
  WHERE CASE WHEN {checks[k.name]} THEN true ELSE false END{wanted}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)
    n_base = reduce(lambda n, k: n + k.base, KINDS, 0)
    one = "kind || ':' || s || ':' || e"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}
)
SELECT doc_id, {counts},
  sha256(coalesce(string_agg({one}, ',' ORDER BY o, s) FILTER (o < {n_base}), '')) AS base_sha256,
  coalesce(string_agg({one}, ',' ORDER BY o, s) FILTER (kind IS NOT NULL), '') AS spans
FROM texts LEFT JOIN found USING (doc_id) GROUP BY doc_id
"""


SQL = _sql()
