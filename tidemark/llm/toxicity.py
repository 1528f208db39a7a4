"""Toxicity from a weighted lexicon matched by an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and digits or
signs used as letters become the plain letter.  The lexicon holds folded words and word
beginnings with log-odds weights learned from labelled rows; exception phrases (an entry
with a neighbour word, met almost only in harmless rows) silence the hits inside them.
The score is a logistic curve over the matched weight, plain and per hundred words.

What is fitted comes from at most ``SAMPLE`` labelled rows, those with the smallest hash
of their id; labels, language, source and id are never inputs of a score.  Every text is
scored whole.

Defined cases: null and empty texts have no hits and get the curve's lowest score;
repeated rows are scored one by one; conflicting labels count as toxic if half say so;
without usable labels the lexicon is empty and every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.logistic import fit_logistic, predict
from tidemark.llm.words import plain_names

SAMPLE = 12_000
ENTRIES = 2_000
PHRASES = 500
PREFIXES = (4, 5, 6, 7, 8)
LEAST_DOCS = 4
LEAST_WEIGHT = 1.8
CUT = 0.3

#: Look-alikes of Latin letters, and digits and signs used as letters.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
}
FOLD = str.maketrans(LOOKALIKES)


def folded(text: str | None) -> str:
    return text.lower().translate(FOLD) if text else ""


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass(frozen=True)
class Lexicon:
    """``entries``: pattern to weight; a pattern ending in ``*`` matches a word's beginning."""

    entries: dict[str, float]
    exceptions: tuple[str, ...]
    weights: tuple[float, ...] = ()

    def matcher(self):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[bool, float]]] = {}
        for name, weight in self.entries.items():
            found.setdefault(name.rstrip("*"), []).append((name.endswith("*"), weight))
        for word, kinds in found.items():
            automaton.add_word(word, (len(word), kinds))
        for phrase in self.exceptions:
            automaton.add_word(phrase, (len(phrase), None))
        if len(automaton):
            automaton.make_automaton()
        return automaton

    def features(self, text: str, automaton) -> tuple[float, float, float]:
        """Matched weight (logarithm), weight per hundred words, distinct entries."""
        total, distinct = 0.0, set()
        for start, end, weight in self.hits(text, automaton):
            total += weight
            distinct.add(text[start:end])
        words = text.count(" ") + 1
        return math.log1p(total), math.log1p(100.0 * total / words), math.log1p(len(distinct))

    def hits(self, text: str, automaton) -> list[tuple[int, int, float]]:
        if not text or not len(automaton):
            return []
        hits, silent, n = [], [], len(text)
        for last, (size, kinds) in automaton.iter(text):
            start, end = last + 1 - size, last + 1
            if start and text[start - 1].isalnum():
                continue
            whole = end == n or not text[end].isalnum()
            if kinds is None:
                if whole:
                    silent.append((start, end))
                continue
            for beginning, weight in kinds:
                if beginning or whole:
                    hits.append((start, end, weight))
        if silent:
            hits = [h for h in hits if not any(s <= h[0] and h[1] <= e for s, e in silent)]
        best: dict[int, tuple[int, int, float]] = {}  # one hit a word: the heaviest
        for h in hits:
            if h[0] not in best or h[2] > best[h[0]][2]:
                best[h[0]] = h
        return list(best.values())


def words_in(text: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", text)


def learning_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled rows that are not held out."""
    truth = (plain_names(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    # At most ``limit`` rows of two numbers are broadcast.
    return plain_names(docs, "doc_id", "text").join(F.broadcast(truth), "doc_id").select("text", "toxic")


def _counts(rows: DataFrame, count) -> DataFrame:
    """Documents per feature and label; ``count`` gives a folded text's set of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per = (Counter(), Counter())

        def flush():
            names = list(per[0].keys() | per[1].keys())
            out = pa.RecordBatch.from_arrays([
                pa.array(names, pa.string()), pa.array([per[1][x] for x in names], pa.int64()),
                pa.array([per[0][x] for x in names], pa.int64())], names=["name", "n1", "n0"])
            per[0].clear()
            per[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                per[toxic].update(count(folded(text.as_py())))
                if len(per[0]) + len(per[1]) > 300_000:
                    yield flush()
        yield flush()

    return (rows.mapInArrow(run, "name string, n1 long, n0 long").groupBy("name")
            .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Lexicon:
    rows = learning_rows(docs, labels, limit)

    def entries_of(text: str) -> set[str]:
        out = {""}  # counts the documents
        for word in set(words_in(text)):
            if len(word) >= 3:
                out.add(word)
            out.update(word[:k] + "*" for k in PREFIXES if len(word) > k)
        return out

    counted = _counts(rows, entries_of)
    total = counted.where("name = ''").first()
    if total is None or not total.n1 or not total.n0:
        return Lexicon({}, ())
    odds = F.log((F.col("n1") + 0.5) / (total.n1 + 1)) - F.log((F.col("n0") + 0.5) / (total.n0 + 1))
    # Strength weighs the odds by how many toxic rows they explain.
    best = (counted.where((F.col("name") != "") & (F.col("n1") >= LEAST_DOCS)).withColumn("weight", odds)
            .where(F.col("weight") >= LEAST_WEIGHT)
            .orderBy(F.desc(F.col("weight") * F.sqrt("n1")), "name").limit(4 * ENTRIES).collect())
    entries: dict[str, float] = {}
    reach: dict[str, int] = {}
    for row in best:
        word = row.name.rstrip("*")
        shorter = [word[:k] + "*" for k in PREFIXES if k <= len(word)]
        if any(s in entries and entries[s] >= row.weight - 0.5 and reach[s] >= row.n1 for s in shorter if s != row.name):
            continue
        entries[row.name], reach[row.name] = row.weight, row.n1
        if len(entries) == ENTRIES:
            break
    plain = Lexicon(entries, ())
    phrases = _counts(rows, _phrases_of(plain)).where((F.col("n0") >= 4) & (F.col("n0") >= 8 * F.col("n1") * (total.n0 / total.n1)))
    lexicon = Lexicon(entries, tuple(r.name for r in phrases.orderBy(F.desc("n0"), "name").limit(PHRASES).collect()))
    return Lexicon(entries, lexicon.exceptions, _curve(rows, lexicon))


def _phrases_of(lexicon: Lexicon):
    def phrases(text: str) -> set[str]:
        automaton = lexicon.matcher()
        out = set()
        for start, end, _ in lexicon.hits(text, automaton):
            while end < len(text) and text[end].isalnum():
                end += 1
            before, after = text[max(0, start - 40):start], text[end:end + 40]
            if before.endswith(" ") and (w := before[:-1].rpartition(" ")[2]).isalnum():
                out.add(f"{w} {text[start:end]}")
            if after.startswith(" ") and (w := after[1:].partition(" ")[0]).isalnum():
                out.add(f"{text[start:end]} {w}")
        return out

    state: dict[str, object] = {}

    def once(text: str) -> set[str]:
        if "matcher" not in state:
            state["matcher"] = lexicon.matcher()
            lexicon_matcher = state["matcher"]
            object.__setattr__(lexicon, "matcher", lambda: lexicon_matcher)
        return phrases(text)

    return once


def _curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, ...]:
    """Logistic weights (intercept first) of the three features on the learning rows."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.matcher()
        for batch in batches:
            got = [lexicon.features(folded(t.as_py()), automaton) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([g[i] for g in got], pa.float64()) for i in range(3)), batch.column("toxic").cast(pa.int32())],
                names=["a", "b", "c", "toxic"])

    # Four numbers for each of at most ``limit`` rows.
    found = rows.mapInArrow(run, "a double, b double, c double, toxic int").collect()
    x = np.array([[r.a, r.b, r.c] for r in found])
    y = np.array([r.toxic for r in found], float)
    return tuple(float(w) for w in fit_logistic(x, y, ridge=1.0))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id score`` of every document, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        automaton = lexicon.matcher()
        for batch in batches:
            got = [lexicon.features(folded(t.as_py()), automaton) for t in batch.column("text")]
            if lexicon.weights:
                scores = predict(np.array(lexicon.weights), np.array(got, float).reshape(-1, 3))
            else:
                scores = np.zeros(len(got))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = plain_names(docs, "doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"))
