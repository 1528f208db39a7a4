"""Repeated passages found by content-chosen anchors, located by Aho-Corasick automata.

A window is ``WINDOW`` consecutive words.  Windows that recur anywhere are confirmed in
three narrowing steps: (1) each window's anchor is its 8-word run with the least hash, so
equal windows have equal anchors, about one word in fifteen is an anchor, and a window whose
anchor is met once in the corpus can't recur; (2) documents with repeated anchors hash the
windows of those anchors, and only window hashes met twice are recurring; (3) recurring
windows, one sample of each per shard, are joined to passages, cut into tiles of
``TILE`` words that every window inside the passage must contain one of, and the tiles of a
shard are compiled into one automaton.  The shard's documents are streamed through it, and
each tile met is extended word by word: a stretch of at least a window that agrees with a
passage is an occurrence, and its words are removed.

Each text is dealt to a slot, and slots to shards; a slot sends one sample of a window and its
count, combined before the shuffle, so a window that very many texts hold is no hot key.

Equal texts are one text with copies: if it has a window, all its words recur.  Shards hold
a bounded number of recurring windows and of words on average, so automata and the texts a
task holds stay small however many there are, and a window of a text belongs to the text's
shard, so no text meets more than one automaton.

Defined cases: null or empty text has no words; texts shorter than a window lose nothing;
repeated rows are copies of each other; rows without an id are treated like any other; an
empty table gives no rows; extra columns pass through ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import WordHashes, gram_hashes, plain_names
from tidemark.workspace import Workspace

WINDOW = 35
ANCHOR = 8
#: Longest tile of which every window holds a whole one: 2 * TILE - 1 <= WINDOW.
TILE = (WINDOW + 1) // 2
SHARD_WINDOWS = 40_000
#: Words and eighths of bytes of a shard's texts, which one task holds as word lists.
SHARD_LOAD = 4_000_000
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Grams:
    """Words of a text with the hashes of its windows and their anchors."""

    def __init__(self, window: int = WINDOW, anchor: int = ANCHOR):
        self.window, self.anchor = window, min(anchor, window)
        self.hashes = WordHashes()

    def codes(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def anchors(self, codes):
        """Anchor hash at each position, and the anchor position of each window."""
        import numpy as np

        grams = gram_hashes(codes, self.anchor)
        size = self.window - self.anchor + 1
        best, place, have = grams, np.arange(len(grams)), 1
        while have < size:
            step = min(have, size - have)
            right, at = best[step:], place[step:]
            left, was = best[:len(right)], place[:len(right)]
            swap = right < left  # equal hashes: the leftmost
            best, place, have = np.where(swap, right, left), np.where(swap, at, was), have + step
        return grams, place

    def windows(self, codes):
        return gram_hashes(codes, self.window)


def _rows(docs: DataFrame) -> DataFrame:
    return plain_names(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))


def _kind(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def scanned(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """``doc_id n_words whole hashes many``: the digest of the words joined, the distinct
    anchors and whether the text itself repeats them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        grams = Grams(window, anchor)
        for batch in batches:
            sizes, wholes, hashes, many = [], [], [], []
            for text in batch.column("text"):
                words = (text.as_py() or b"").split()
                sizes.append(len(words))
                wholes.append(hashlib.sha256(b" ".join(words)).digest())
                if len(words) < window:
                    hashes.append([])
                    many.append([])
                    continue
                values, place = grams.anchors(grams.codes(words))
                values, count = np.unique(values[np.unique(place)], return_counts=True)
                hashes.append(values.view(np.int64))
                many.append(count > 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(wholes, pa.binary()),
                pa.array(hashes, pa.list_(pa.int64())), pa.array(many, pa.list_(pa.bool_()))],
                names=["doc_id", "n_words", "whole", "hashes", "many"])

    rows = _rows(docs)
    return rows.mapInArrow(run, f"doc_id {_kind(rows)}, n_words long, whole binary, hashes array<long>, many array<boolean>")


def candidate_windows(routed: DataFrame, window: int, anchor: int) -> DataFrame:
    """``doc_id part fp place many`` of each distinct window whose anchor is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        grams = Grams(window, anchor)
        for batch in batches:
            prints, places, many = [], [], []
            for text, repeated in zip(batch.column("text"), batch.column("repeated"), strict=True):
                codes = grams.codes(text.as_py().split())
                anchors, place = grams.anchors(codes)
                known = np.isin(anchors, repeated.values.to_numpy().view(np.uint64))
                at = np.flatnonzero(known[place])
                values, first, count = np.unique(grams.windows(codes)[at], return_index=True, return_counts=True)
                order = np.argsort(first)  # in text order the rows compress
                prints.append(values[order].view(np.int64))
                places.append(at[first][order].astype(np.int32))
                many.append(count[order] > 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("whole"), pa.array(prints, pa.list_(pa.int64())),
                pa.array(places, pa.list_(pa.int32())), pa.array(many, pa.list_(pa.bool_()))],
                names=["doc_id", "whole", "fp", "place", "many"])

    lists = routed.select("doc_id", "whole", "text", "repeated").mapInArrow(
        run, f"doc_id {_kind(routed)}, whole binary, fp array<long>, place array<int>, many array<boolean>")
    return lists.select("doc_id", F.xxhash64("whole").alias("part"), F.inline(F.arrays_zip("fp", "place", "many")))


def recurring_windows(windows: DataFrame, slots: int) -> DataFrame:
    """``fp slot part place``: of windows met twice, one sample of each for every slot that has it.

    Texts are dealt to slots, and a slot's samples are combined before the shuffle, so a window
    that a third of all texts hold is as many rows as there are slots when it is counted.
    """
    held = windows.groupBy("fp", F.pmod(F.xxhash64("part"), F.lit(slots)).alias("slot")).agg(
        F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n"), F.min("part").alias("part"), F.min_by("place", "part").alias("place"))
    met = held.withColumn("met", F.sum("n").over(Window.partitionBy("fp")))
    return met.where("met > 1").select("fp", "slot", "part", "place")


class PassageAutomaton:
    """Tiles of passages (word-id sequences) in one automaton; matches are extended."""

    def __init__(self, passages: list[list[int]], window: int):
        import ahocorasick

        self.window, self.tile = window, (window + 1) // 2
        self.passages = passages
        tiles: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for p, codes in enumerate(passages):
            for at in range(0, len(codes) - self.tile + 1, self.tile):
                tiles.setdefault(tuple(codes[at:at + self.tile]), []).append((p, at))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for tile, homes in tiles.items():
            self.automaton.add_word(tile, homes)
        if tiles:
            self.automaton.make_automaton()

    def spans(self, codes: list[int]) -> list[tuple[int, int]]:
        """Merged (start, end) of stretches of a window or more that a passage holds."""
        if not len(self.automaton) or len(codes) < self.window:
            return []
        reached: dict[tuple[int, int], int] = {}  # passage and shift -> end of its last stretch
        found: list[tuple[int, int]] = []
        n, tile = len(codes), self.tile
        for last, homes in self.automaton.iter(tuple(codes)):
            begin = last + 1 - tile
            for p, at in homes:
                key = (p, begin - at)
                if reached.get(key, -1) > begin:
                    continue
                passage = self.passages[p]
                left, a = begin, at
                while left and a and codes[left - 1] == passage[a - 1]:
                    left, a = left - 1, a - 1
                right, a = begin + tile, at + tile
                size = len(passage)
                while right < n and a < size and codes[right] == passage[a]:
                    right, a = right + 1, a + 1
                reached[key] = right
                if right - left >= self.window:
                    found.append((left, right))
        merged: list[tuple[int, int]] = []
        for start, end in sorted(found):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        return merged


def located(routed: DataFrame, phrases: DataFrame, window: int) -> DataFrame:
    """``whole spans kept_sha256`` of the routed texts, shard by shard."""

    def run(key, texts: pa.Table, starts: pa.Table) -> pa.Table:
        ids: dict[bytes, int] = {}
        wholes = texts.column("whole").to_pylist()
        bodies = [t.as_py().split() for t in texts.column("text")]
        coded = [[ids.setdefault(w, len(ids)) for w in words] for words in bodies]
        by_whole = dict(zip(wholes, coded, strict=True))
        by_part = dict(zip(texts.column("part").to_pylist(), wholes, strict=True))
        passages = []
        for part, places in zip(starts.column("part").to_pylist(), starts.column("places").to_pylist(), strict=True):
            codes, begin, end = by_whole[by_part[part]], None, None
            for place in sorted(places):
                if begin is None or place > end:
                    if begin is not None:
                        passages.append(codes[begin:end - 1 + window])
                    begin = place
                end = place + 1
            if begin is not None:
                passages.append(codes[begin:end - 1 + window])
        automaton = PassageAutomaton(passages, window)
        spans, digests = [], []
        for words, codes in zip(bodies, coded, strict=True):
            got = automaton.spans(codes)
            kept, at = [], 0
            for start, end in got:
                kept += words[at:start]
                at = end
            kept += words[at:]
            spans.append([{"start": s, "end": e} for s, e in got])
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table([pa.array(wholes, pa.binary()), pa.array(spans, SPANS), pa.array(digests, pa.string())],
                        names=["whole", "spans", "kept_sha256"])

    return (routed.select("shard", "part", "whole", "text").groupBy("shard")
            .cogroup(phrases.groupBy("shard"))
            .applyInArrow(run, "whole binary, spans array<struct<start:int,end:int>>, kept_sha256 string"))


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_windows: int = SHARD_WINDOWS,
            shard_load: int = SHARD_LOAD) -> DataFrame:
    """``doc_id n_words n_removed spans kept_sha256 whole`` of every document.

    ``spans`` are the removed words (word positions), ``whole`` the digest of the text's words.
    """
    space = Workspace(docs.sparkSession)
    all_rows = space.stage(scanned(docs, window, anchor), "scanned")
    texts = (all_rows.where(F.col("n_words") >= window).groupBy("whole", "n_words")
             .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
    texts = space.stage(texts, "texts")

    # One row per distinct text: the one with the least id; its anchors join by digest and id.
    single = all_rows.where(F.col("n_words") >= window).join(
        texts.select("whole", F.col("doc_id").alias("first")), "whole").where(F.col("doc_id").eqNullSafe(F.col("first")))
    anchors = space.stage(single.select("doc_id", F.substring("whole", 1, 8).alias("part"), F.inline(F.arrays_zip(
        F.col("hashes").alias("hash"), F.col("many").alias("many")))), "anchors")
    met = anchors.groupBy("hash").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n")).where("n > 1").select("hash")
    hinted = anchors.join(met, "hash").groupBy("doc_id", "part").agg(F.collect_set("hash").alias("repeated"))

    rows = _rows(docs)
    joined = hinted.withColumnRenamed("doc_id", "_id").join(rows, F.col("_id").eqNullSafe(rows["doc_id"]))
    joined = joined.select("doc_id", "part", "text", "repeated")
    routed = space.stage(_own_texts(joined), "routed")

    # A text has at most as many windows as words, so the final shards are never more than the slots.
    load = routed.agg(F.sum("load")).first()[0] or 0
    slots = load // min(shard_windows, shard_load) + 1
    recurring = space.stage(recurring_windows(candidate_windows(routed, window, anchor), slots), "recurring")
    shards = max(space.rows["recurring"] // shard_windows, load // shard_load) + 1
    shard = lambda slot: F.pmod(slot, F.lit(shards)).alias("shard")
    phrases = (recurring.groupBy(shard(F.col("slot")), "fp")
               .agg(F.min("part").alias("part"), F.min_by("place", "part").alias("place"))
               .groupBy("shard", "part").agg(F.collect_list("place").alias("places")))
    part = F.xxhash64("whole")
    dealt = routed.withColumns({"part": part, "shard": shard(F.pmod(F.xxhash64(part), F.lit(slots)))})
    found = located(dealt, phrases, window).where(F.size("spans") > 0)

    copied = texts.where("copies > 1").select(
        "whole", F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).alias("spans"),
        F.sha2(F.lit(""), 256).alias("kept_sha256"))
    marks = copied.unionAll(found.join(copied.select("whole"), "whole", "left_anti"))
    marks = space.stage(marks, "marks")
    out = all_rows.select("doc_id", "n_words", "whole").join(marks, "whole", "left")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return out.select("doc_id", "n_words", F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
                      F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
                      F.coalesce("kept_sha256", F.lower(F.hex("whole"))).alias("kept_sha256"), "whole")


def _own_texts(joined: DataFrame) -> DataFrame:
    """Rows whose text has the digest they were joined for (ids may repeat), with the digest and the load in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wholes, loads = [], []
            for t in batch.column("text"):
                text = t.as_py() or b""
                words = text.split()
                wholes.append(hashlib.sha256(b" ".join(words)).digest())
                loads.append(len(words) + len(text) // 8)
            own = [w[:8] == p.as_py() for w, p in zip(wholes, batch.column("part"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(wholes, pa.binary()), batch.column("text"), batch.column("repeated"), pa.array(loads, pa.int64())],
                names=["doc_id", "whole", "text", "repeated", "load"]).filter(pa.array(own, pa.bool_()))

    return joined.mapInArrow(run, f"doc_id {_kind(joined)}, whole binary, text binary, repeated array<long>, load long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The documents, all columns kept, with the kept words joined by one space.

    A text that loses nothing stays as it is.
    """
    from tidemark.llm.words import text_of, words_of

    found = (repeats(docs, window, anchor).where("n_removed > 0")
             .select(F.col("doc_id").alias("_id"), F.hex("whole").alias("_whole"), F.col("spans").alias("_spans")).distinct())
    words = words_of(text_of("text"))
    own = docs.withColumn("_key", F.upper(F.sha2(F.concat_ws(" ", words), 256)))
    out = own.join(found, own["doc_id"].eqNullSafe(found["_id"]) & (own["_key"] == found["_whole"]), "left")
    outside = F.transform(
        F.sequence(F.lit(0), F.size("_spans")),
        lambda i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get("_spans", i - 1)["end"]).alias("start"),
                           F.coalesce(F.get("_spans", i)["start"], F.size(words)).alias("end")))
    kept = F.flatten(F.transform(outside, lambda s: F.slice(words, s["start"] + 1, s["end"] - s["start"])))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat_ws(" ", kept))
    return out.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_repeated_phrases(docs: DataFrame) -> DataFrame:
    return repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 34], ' ')) AS h, md5(array_to_string(w[i:i + 34], ' ')) AS m
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h, m) AS c FROM g) WHERE c > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS t, count(*) AS n FROM k LEFT JOIN x ON x.doc_id = k.doc_id AND x.p = k.p
         WHERE x.p IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
