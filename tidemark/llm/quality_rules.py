"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one failure bit per rule; policies are versioned sets of bits applied to
the ledger later, and ablations (what would a policy keep without one rule) are
computed from the counts of distinct bit patterns, so neither reads a text again.

Defined cases: a null or empty text has no words and all measurements 0 (it
fails ``few_words``); repeated rows each get their own ledger row; an empty
table gives an empty ledger; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import plain_names, text_of, words_of

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


#: A rule's bit is its position: append only, so that stored ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("shouting", "10 * n_shouts > 3 * n_words"),
)


def bit(name: str) -> int:
    return 1 << [r.name for r in RULES].index(name)


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(bit(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy("strict", 1, tuple(r.name for r in RULES))
POLICIES = (BASE, Policy("no_symbols", 1, ("few_words", "repeated_windows", "symbols")), STRICT)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of every document, in one pass without a shuffle.

    Repeats are found inside the row: hashes of all 8-word windows, and only if
    some are equal, a sort by hash that brings equal windows side by side.
    """
    base = plain_names(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias(id_col), text_of(text_col).alias("_t"))
    step = base.select(id_col, "_t", words_of(F.col("_t")).alias("_w"), F.split("_t", "\n").alias("_l"))
    step = step.select(
        id_col, F.size("_w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("!!")).cast("long").alias("n_shouts"),
        F.filter("_l", lambda line: line.rlike("[^ \\t-\\r]")).alias("_l"),
        F.when(F.size("_w") >= WINDOW,
               F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)),
                           lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).alias("_h"))
    step = step.withColumns({
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_h": F.when(F.size("_h") > F.size(F.array_distinct("_h")),
                     F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))})
    same = lambda other: F.get("_h", other)["h"]
    step = step.withColumn("_p", F.sort_array(F.transform(
        F.filter("_h", lambda x, j: F.coalesce(same(j - 1) == x["h"], F.lit(False))
                 | F.coalesce(same(j + 1) == x["h"], F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(
        "_p", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"])
    return step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")


def failure_bits(rules: Sequence[Rule] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``failure_bits`` of every document."""
    return measure(docs, id_col, text_col).withColumn("failure_bits", failure_bits())


def apply_policy(rows: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    return rows.withColumn(name, F.col("failure_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policies: Sequence[Policy] = POLICIES) -> DataFrame:
    """Per policy and rule: kept with it, kept without the rule, failed by it alone.

    The ledger shrinks to one row per bit pattern (at most 2 to the number of
    rules) before policies and rules multiply it.
    """
    patterns = rows.groupBy("failure_bits").agg(F.count(F.lit(1)).alias("n"))
    cases = F.array(*[
        F.struct(F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(r).alias("rule"),
                 F.lit(p.mask).cast("long").alias("mask"), F.lit(bit(r)).cast("long").alias("bit"))
        for p in policies for r in p.rules])
    failed = F.col("failure_bits").bitwiseAND(F.col("mask"))
    return (patterns.select("failure_bits", "n", F.inline(cases))
            .groupBy("policy", "version", "rule")
            .agg(F.sum(F.when(failed == 0, F.col("n")).otherwise(0)).alias("n_kept"),
                 F.sum(F.when(failed.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
                 F.sum(F.when(F.col("failure_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed")))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT doc_id, t, w, len(w) AS n_words, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
             len(regexp_extract_all(t, '!!')) AS n_shouts
      FROM w),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM m WHERE len(w) >= 8),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM g),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM h) WHERE c > 1),
p AS (SELECT doc_id, sum(least(8, i - coalesce(prev, i - 8))) AS n_repeat_words
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM r) GROUP BY doc_id),
f AS (SELECT m.*, coalesce(p.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN p USING (doc_id)),
b AS (SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END
        + CASE WHEN word_chars > 14 * n_words THEN 8 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END
        + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END
        + CASE WHEN 10 * n_shouts > 3 * n_words THEN 64 ELSE 0 END AS failure_bits FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(failure_bits AS BIGINT) AS failure_bits,
       (failure_bits & 3) <> 0 AS base_failed, failure_bits = 0 AS kept
FROM b
"""


def op1_quality_rules(docs: DataFrame) -> DataFrame:
    """The contract's columns: the base verdict, then the strict policy's."""
    return apply_policy(ledger(docs), STRICT).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failure_bits",
        (F.col("failure_bits").bitwiseAND(F.lit(BASE.mask)) != 0).alias("base_failed"), "kept")
