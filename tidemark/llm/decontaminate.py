"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words and put into one suffix automaton: every state stands
for the word sequences that end at the same item positions.  A document's words are
streamed through it, which gives at each word the longest sequence of item words that
ends there.  A match as long as the window (or as a whole shorter item) marks its
words; the state tells which items hold that window.

Items are cut into pieces that share ``window - 1`` words, so that every window lies in
a piece, and pieces are put into shards.  An automaton holds at most ``shard_words``
words and one piece more, however long an item is.  Shards are written under the shared
folder and met one after another: a pass broadcasts one automaton, scans all documents,
stages the spans of the few that it hits and destroys the broadcast, so that neither the
driver nor a task ever holds two.  ``docs`` is scanned once a shard and once more to be
cut; more ``shard_words`` mean fewer scans and larger workers.  Spans are kept by digest
of the text, so a text with any number of copies is one row, and only documents that
meet a bitmap of the digests are joined with their spans: no other text is shuffled.
Before streaming, runs of words that no item uses are skipped, which can't lose a match.

Defined cases: null text or item has no words; empty items match nothing; without
items every document is clean; repeated rows are judged one by one, repeated items
count by their distinct ids, and a null id counts as the empty one; extra columns pass
through ``decontaminate``.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.exact_dedup import cells_of, with_repeated
from tidemark.llm.words import plain_names
from tidemark.workspace import Workspace

WINDOW = 10
SHARD_WORDS = 200_000
#: Lower-cased letters, digits and bytes of non-ASCII characters make words; the rest is blank.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class ItemAutomaton:
    """Suffix automaton over all pieces of a shard, with windows and their items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        sequences = []
        for item, words in items:
            codes = [self.ids.setdefault(w, len(self.ids)) for w in words]
            last = 0
            for code in codes:
                last = self._extend(last, code)
            sequences.append((item, codes))
        #: state -> items that hold the state's sequence of window length
        self.items: dict[int, set[str]] = {}
        #: state -> (length, item) of shorter items that are one of the state's sequences
        self.short: dict[int, set[tuple[int, str]]] = {}
        self.least = window
        for item, codes in sequences:
            if len(codes) < window:
                if codes:
                    self.least = min(self.least, len(codes))
                    state = 0
                    for code in codes:
                        state = self.next[state][code]
                    self.short.setdefault(self._suffix(state, len(codes)), set()).add((len(codes), item))
                continue
            state, size = 0, 0
            for code in codes:
                state, size = self.next[state][code], size + 1
                if size >= window:
                    self.items.setdefault(self._suffix(state, window), set()).add(item)
        self.near_short = self._near_short()

    @classmethod
    def of(cls, state: dict) -> ItemAutomaton:
        """The automaton of plain values that another process built."""
        made = cls.__new__(cls)
        made.__dict__.update(state)
        return made

    def _new(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, code: int, target: int) -> int:
        """A copy of ``target`` for the sequences that reach it from ``state``."""
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(code) == target:
            self.next[state][code] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, code: int) -> int:
        known = self.next[last].get(code)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, code, known)
        state = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and code not in self.next[last]:
            self.next[last][code] = state
            last = self.link[last]
        if last >= 0:
            target = self.next[last][code]
            self.link[state] = target if self.length[target] == self.length[last] + 1 else self._split(last, code, target)
        return state

    def _suffix(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of ``state``'s sequences."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _near_short(self) -> list[int]:
        """Per state the nearest state on its suffix path that ends a short item, or -1."""
        near = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            near[state] = state if state in self.short else near[self.link[state]] if state else -1
        return near

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged (start, end) word spans inside occurrences, and the items found."""
        import numpy as np

        if len(words) < self.least or not self.ids:
            return [], set()
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for begin, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - begin >= self.least:
                self._stream(codes[begin:end].tolist(), begin, spans, found)
        return spans, found

    def _stream(self, codes: list[int], at: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        moves, link, length, window, near = self.next, self.link, self.length, self.window, self.near_short
        state = size = 0
        for i, code in enumerate(codes, at + 1):
            while state and code not in moves[state]:
                state = link[state]
                size = length[state]
            target = moves[state].get(code)
            if target is None:
                size = 0
                continue
            state, size = target, size + 1
            hit = 0
            if size >= window:
                hit = window
                found |= self.items[self._suffix(state, window)]
            short = near[state]
            while short >= 0:
                for n, item in self.short[short]:
                    if n <= size:
                        hit = max(hit, n)
                        found.add(item)
                short = near[link[short]] if short else -1
            if hit:
                start = i - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))


def _pieces(window: int, size: int):
    """Items as normalised pieces of at most ``size`` words that together hold every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies, counts = [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text"), strict=True):
                words = normal_words(text.as_py())
                for start in range(0, max(len(words) - window, 0) + 1, size - window + 1):
                    piece = words[start:start + size]
                    if piece:
                        ids.append(item)
                        bodies.append(b" ".join(piece))
                        counts.append(len(piece))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(bodies, pa.binary()), pa.array(counts, pa.int64())],
                names=["item_id", "piece", "n"])

    return run


def _fillings(pieces: list[tuple[str, bytes]], shard_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The pieces in order, in lists that are closed once they hold ``shard_words`` words."""
    filling, held = [], 0
    for item, piece in pieces:
        words = piece.split()
        filling.append((item, words))
        held += len(words)
        if held >= shard_words:
            yield filling
            filling, held = [], 0
    if filling:
        yield filling


def automata(items: DataFrame, space: Workspace, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``shard automaton``: the pickled values of one automaton per row, built on the executors and staged."""
    rows = plain_names(items, "item_id", "text").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text"))
    # Small pieces fill shards evenly; two windows at least, or the shared words outweigh the others.
    size = max(2 * window, shard_words // 10)
    pieces = space.stage(rows.mapInArrow(_pieces(window, size), "item_id string, piece binary, n long").distinct(), "pieces")
    shards = math.ceil((pieces.agg(F.sum("n")).first()[0] or 0) / shard_words)

    def build(group: pa.Table) -> pa.Table:
        held = sorted(zip(group.column("item_id").to_pylist(), group.column("piece").to_pylist(), strict=True))
        built = [pickle.dumps(vars(ItemAutomaton(filling, window))) for filling in _fillings(held, shard_words)]
        return pa.table({"automaton": pa.array(built, pa.binary())})

    built = (pieces.withColumn("shard", F.pmod(F.xxhash64("item_id", "piece"), F.lit(max(shards, 1))))
             .groupBy("shard").applyInArrow(build, "automaton binary"))
    return space.stage(built.select(F.monotonically_increasing_id().alias("shard"), "automaton"), "automata")


SPANS = "array<struct<start:int,end:int>>"
COUNTED = [T.StructField("digest", T.BinaryType()), T.StructField("n_words", T.LongType())]
HITS = f"digest binary, spans {SPANS}, items array<string>"


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def found_in(docs: DataFrame, items: DataFrame, space: Workspace, window: int = WINDOW,
             shard_words: int = SHARD_WORDS) -> DataFrame:
    """``digest spans items``, staged: one row per distinct text that holds an occurrence of any shard."""
    spark = docs.sparkSession
    texts = plain_names(docs, "text").select(F.col("text").cast("binary").alias("text"))
    shards = automata(items, space, window, shard_words)
    passes = []
    for (shard,) in shards.select("shard").collect():
        state = shards.where(F.col("shard") == shard).first().automaton
        shared = spark.sparkContext.broadcast(bytes(state))
        # Rows of one digest are alike, so any of them stands for all; copies are combined before the shuffle.
        hits = texts.mapInArrow(_hits(shared), HITS).groupBy("digest").agg(
            F.first("spans").alias("spans"), F.first("items").alias("items"))
        passes.append(space.stage(hits, "hits"))
        shared.destroy()
    if len(passes) < 2:
        return passes[0] if passes else spark.createDataFrame([], HITS)
    each = reduce(DataFrame.unionAll, passes).groupBy("digest").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return space.stage(each.mapInArrow(_unite, HITS), "found")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _hit_rows(rows: list[tuple[bytes, list[tuple[int, int]], set[str]]]) -> pa.RecordBatch:
    spans = [[{"start": s, "end": e} for s, e in _merged(row[1])] for row in rows]
    return pa.RecordBatch.from_arrays([
        pa.array([row[0] for row in rows], pa.binary()),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        pa.array([sorted(row[2]) for row in rows], pa.list_(pa.string()))], names=["digest", "spans", "items"])


def _hits(shared):
    """Digest, spans and items of the texts that the broadcast automaton finds something in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ItemAutomaton.of(pickle.loads(shared.value))
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                body = text.as_py()
                spans, found = automaton.scan(normal_words(body))
                if spans:
                    rows.append((hashlib.sha256(body).digest(), spans, found))
            yield _hit_rows(rows)

    return run


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What several shards found in a text, merged."""
    for batch in batches:
        yield _hit_rows([
            (row["digest"], [(s["start"], s["end"]) for s in row["spans"]], set(row["items"])) for row in batch.to_pylist()])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and number of words of each text; null text has no digest and no words."""
    for batch in batches:
        digests, sizes = [], []
        for text in batch.column("text"):
            body = text.as_py()
            digests.append(None if body is None else hashlib.sha256(body).digest())
            sizes.append(len(normal_words(body)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "digest", "n_words"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per document ``n_words``, the word ``spans`` inside occurrences and the ``items`` found."""
    found = found_in(docs, items, Workspace(docs.sparkSession), window, shard_words)
    rows = plain_names(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(_counted, T.StructType([rows.schema["doc_id"], *COUNTED]))
    return rows.join(found, "digest", "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = 0.5,
                  shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents, all columns kept, without the words inside item occurrences.

    A document of which occurrences cover more than ``max_coverage`` is removed.
    Spans of all shards are found in the whole text before any of it is cut.
    """
    space = Workspace(docs.sparkSession)
    found = found_in(docs, items, space, window, shard_words)
    bitmap = space.stage(cells_of(found, ["digest"]), "cells")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = with_repeated(rows.withColumn("digest", _digest("row.text")), ["digest"], bitmap)
    # The bitmap lets some clean texts through: they meet no spans and stay as they are.
    met = rows.where("shared").join(found, "digest", "left").select("row", "spans")
    cut = met.mapInArrow(_cutting(max_coverage), T.StructType(docs.schema.fields))
    return rows.where("NOT shared").select("row.*").unionAll(cut)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans, nor what stands between those words."""
    import re

    places = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def _cutting(max_coverage: float):
    """Rows with their spans, cut; rows that are mostly spans are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column("row")
            rows = pa.RecordBatch.from_arrays(packed.flatten(), names=[f.name for f in packed.type])
            place = rows.schema.get_field_index("text")
            keep, texts = [], []
            for text, spans in zip(rows.column(place).cast(pa.binary()), batch.column("spans").to_pylist(), strict=True):
                body, places = text.as_py(), [(s["start"], s["end"]) for s in spans or ()]
                keep.append(sum(e - s for s, e in places) <= max_coverage * len(normal_words(body)))
                texts.append(cut_words(body, places) if places else body)
            kind = rows.schema.field(place)
            rows = rows.set_column(place, kind, pa.array(texts, pa.binary()).cast(kind.type, safe=False))
            yield rows.filter(pa.array(keep, pa.bool_()))

    return run


def op5_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    hits = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return contamination(docs, items).select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (
       SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
