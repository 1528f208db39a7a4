"""Secret scans: three fixed patterns plus sliding-window Shannon entropy.

Pattern spans are the leftmost non-overlapping matches of each kind.  The
entropy scan takes candidate strings (long runs of key characters), slides a
window over each, and updates the sum of ``c * log2(c)`` over the window's
character counts as one character enters and one leaves.  Sums are fixed-point
integers, so a threshold is met or not met exactly.  A candidate counts as one
class (hex, letters only, or mixed) with its own threshold; candidates that
match the allow-list as a whole are left out, so nothing that stands beside an allowed
string in a longer run is silenced with it.  Pattern spans are never left out.

Defined cases: null text is empty; a text without matches has counts 0 and empty
span lists; repeated rows are scanned one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import let, plain_names, text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Maximal runs, found without trying every position inside a run again.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
SCALE = 1 << 20
#: c * log2(c) for every count a window can hold, as fixed-point integers.
TERMS = tuple(round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 1))
#: Bits a character at least, by character class.
THRESHOLDS = {"hex": 3.0, "letters": 4.0, "mixed": 3.7}
#: The classes' candidates; what is neither is mixed.  Words joined by signs count as letters.
CLASSES = {"hex": "^[0-9a-fA-F]+$", "letters": "^[A-Za-z_=/-]+$"}
#: Strings that look random and are none: UUIDs, numbers, paths of short names, documented example keys.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_=/+-]+$", r"^([A-Za-z_-]+=)?(AKIA[A-Z0-9]{9}|[A-Za-z0-9/+]{30})EXAMPLE(KEY)?$",
    r"^/?[a-z0-9_-]{1,19}(/[a-z0-9_-]{1,19})+/?$",
)


def most_sum(bits: float) -> int:
    """The largest fixed-point sum at which a window still has so many bits a character."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * SCALE)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value): code points, end exclusive.

    Splitting and extracting with the same pattern give the texts between and
    inside the matches, whose lengths add up to the positions.
    """
    spans = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    placed = F.aggregate(
        F.filter(spans, lambda s: s["hit"].isNotNull()),
        F.struct(F.lit(0).alias("at"), empty.alias("found")),
        lambda a, s: let(a["at"] + s["gap"], lambda start: F.struct(
            (start + F.length(s["hit"])).alias("at"),
            F.array_append(a["found"], F.struct(
                start.alias("start"), (start + F.length(s["hit"])).alias("end"), s["value"].alias("value"))).alias("found"))),
        lambda a: a["found"])
    return F.when(text.rlike(pattern), placed).otherwise(empty)


def _term(count: Column) -> Column:
    return F.get(F.array(*[F.lit(t).cast("long") for t in TERMS]), count)


def _count(chars: Column, start: Column, char: Column) -> Column:
    return F.size(F.filter(F.slice(chars, start, WINDOW), lambda c: c == char))


def hot_range(value: Column, limit: Column) -> Column:
    """(first, last) offsets of windows whose entropy is high enough, or nulls."""

    def scan(chars: Column) -> Column:
        first_sum = F.aggregate(
            F.array_distinct(F.slice(chars, 1, WINDOW)), F.lit(0).cast("long"),
            lambda s, c: s + _term(_count(chars, F.lit(1), c)))

        def move(a: Column, i: Column) -> Column:
            # The window starting at i (0-based) loses chars[i - 1] and gains chars[i + WINDOW - 1].
            out, new = F.get(chars, i - 1), F.get(chars, i + (WINDOW - 1))
            less = _count(chars, i, out)
            total = let(less, lambda n: a["s"] - _term(n) + _term(n - 1))
            more = _count(chars, i, new) - F.when(out == new, 1).otherwise(0)
            total = let(more, lambda n: total - _term(n) + _term(n + 1))
            return let(total, lambda s: F.struct(
                s.alias("s"), F.coalesce(a["first"], F.when(s <= limit, i)).alias("first"),
                F.when(s <= limit, i).otherwise(a["last"]).alias("last")))

        start = let(first_sum, lambda s: F.struct(
            s.alias("s"), F.when(s <= limit, F.lit(0)).alias("first"), F.when(s <= limit, F.lit(0)).alias("last")))
        moves = F.when(F.size(chars) > WINDOW, F.sequence(F.lit(1), F.size(chars) - WINDOW)).otherwise(
            F.array().cast("array<int>"))
        return F.aggregate(moves, start, move)

    return let(F.split(value, ""), scan)


def entropy_spans(text: Column, allow: Sequence[str] = ALLOW) -> Column:
    """Array of (start, end) around the high-entropy windows of each candidate."""
    allowed = lambda v: F.coalesce(*[F.when(v.rlike(a), F.lit(True)) for a in allow], F.lit(False))
    limit = lambda v: F.coalesce(
        *[F.when(v.rlike(p), F.lit(most_sum(THRESHOLDS[c]))) for c, p in CLASSES.items()], F.lit(most_sum(THRESHOLDS["mixed"]))).cast("long")
    candidates = F.filter(matches(text, CANDIDATE), lambda c: ~allowed(c["value"]))
    scanned = F.transform(candidates, lambda c: let(hot_range(c["value"], limit(c["value"])), lambda h: F.struct(
        (c["start"] + h["first"]).alias("start"), (c["start"] + h["last"] + WINDOW).alias("end"))))
    return F.filter(scanned, lambda s: s["start"].isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the spans of every kind, as ``array<struct<start,end>>`` columns."""
    span = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))
    base = plain_names(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias(id_col), text_of(text_col).alias("_t"))
    t = F.col("_t")
    return base.select(
        id_col,
        F.transform(F.filter(matches(t, ASSIGN, 2), lambda m: F.length(m["value"]) >= 6), span).alias("assign"),
        F.transform(matches(t, ACCESS), span).alias("access"),
        F.transform(matches(t, HEX), span).alias("hex"),
        entropy_spans(t).alias("entropy"))


def listed(kinds: Sequence[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""

    def tag(order: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(order).alias("order"),
            F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("name")))

    tagged = F.concat(*[tag(i, k) for i, k in enumerate(kinds)])
    return F.concat_ws(",", F.transform(F.sort_array(tagged), lambda s: s["name"]))


def op8_secret_scans(docs: DataFrame) -> DataFrame:
    return scan(docs).select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"), listed(KINDS).alias("spans"))


def _located_sql(kind: str, pattern: str, source: str = "d", value: str = "0") -> str:
    return f"""(SELECT doc_id, '{kind}' AS kind, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, vals FROM (
        SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits,
               regexp_extract_all(t, '{pattern}', {value}) AS vals FROM {source} WHERE regexp_matches(t, '{pattern}')))"""


_TERM_LIST = "[" + ", ".join(str(t) for t in TERMS) + "]"
_ASSIGN_SQL = ASSIGN.replace("'", "''")
_LIMIT_SQL = " ".join(f"WHEN regexp_matches(val, '{p}') THEN {most_sum(THRESHOLDS[c])}" for c, p in CLASSES.items())
_ALLOW_SQL = " AND ".join(f"NOT regexp_matches(val, '{a}')" for a in ALLOW)
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT *, 1 AS o FROM {_located_sql("assign", _ASSIGN_SQL, value="2")}
  UNION ALL SELECT *, 2 FROM {_located_sql("access", "AKIA[A-Z0-9]{16,}")}
  UNION ALL SELECT *, 3 FROM {_located_sql("hex", "[0-9a-f]{24,}")}
  UNION ALL SELECT *, 4 FROM {_located_sql("entropy", "[A-Za-z0-9+/_=-]{20,}")}),
p AS (SELECT doc_id, kind, o, vals[i] AS val, hits[i] AS hit,
             CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM m),
e AS (SELECT doc_id, s, val, unnest(range(0, length(val) - {WINDOW - 1})) AS k,
             CASE {_LIMIT_SQL} ELSE {most_sum(THRESHOLDS["mixed"])} END AS most
      FROM p WHERE kind = 'entropy' AND {_ALLOW_SQL}),
h AS (SELECT doc_id, s, k FROM e WHERE list_sum(list_transform(
        list_distinct(string_split(substr(val, CAST(k + 1 AS INT), {WINDOW}), '')),
        lambda c: ({_TERM_LIST})[len(list_filter(string_split(substr(val, CAST(k + 1 AS INT), {WINDOW}), ''), lambda y: y = c)) + 1])) <= most),
spans AS (
  SELECT doc_id, kind, o, s AS a, s + length(hit) AS b FROM p WHERE kind IN ('access', 'hex') OR (kind = 'assign' AND length(val) >= 6)
  UNION ALL SELECT doc_id, 'entropy', 4, s + min(k), s + max(k) + {WINDOW} FROM h GROUP BY doc_id, s),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'entropy') AS n_entropy,
             string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) FILTER (o < 4) AS base,
             string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
