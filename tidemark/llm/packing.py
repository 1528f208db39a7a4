"""Packing into optimal length buckets.

Documents are cut into pieces of at most ``max_len`` tokens.  The global histogram of
piece lengths (at most ``max_len`` rows) is the only thing the driver sees; dynamic
programming over it chooses the bucket lengths with the least padding.  Inside a
bucket every piece is padded to the bucket's length and batches hold as many pieces
as the token budget allows.

Ranks inside a bucket come from counts per (bucket, salt) plus a row number inside
each salt, so a bucket with most of the rows is still ranked by many tasks.  Salts
are hashes of the piece, so a lost task recomputes the same ranks.

Defined cases: a document has its words plus one closing token, so null and empty
texts are one piece of length 1; repeated rows are packed one by one (equal rows may
swap places); an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import plain_names, text_of, words_of
from tidemark.workspace import Workspace

MAX_LEN = 2048
BUCKETS = 8
TOKEN_BUDGET = 16_384
SALT_ROWS = 50_000


def word_tokens(text: Column) -> Column:
    """Words plus a closing token."""
    return F.size(words_of(text)).cast("long") + 1


def best_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Bucket lengths, at most ``buckets``, with the least total padding.

    ``cost[j]`` is the least padding of all lengths up to the j-th; a bucket from
    i to j pads every piece in it to the j-th length.
    """
    import numpy as np

    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    rows = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    n = len(lengths)
    cost = lengths * rows[1:] - tokens[1:]
    choices = []
    for _ in range(1, min(buckets, n)):
        better, choice = cost.copy(), np.full(n, -1)
        for j in range(1, n):
            padded = cost[:j] + lengths[j] * (rows[j + 1] - rows[1:j + 1]) - (tokens[j + 1] - tokens[1:j + 1])
            i = int(padded.argmin())
            if padded[i] < better[j]:
                better[j], choice[j] = padded[i], i
        choices.append(choice)
        cost = better
    bounds, j = [int(lengths[-1])], n - 1
    for choice in reversed(choices):
        if choice[j] >= 0:
            j = int(choice[j])
            bounds.append(int(lengths[j]))
    return bounds[::-1]


def pieces_of(docs: DataFrame, max_len: int = MAX_LEN, tokens=word_tokens, space: Workspace | None = None) -> DataFrame:
    """``doc_id piece start length``; token counts are staged, texts read once."""
    space = space or Workspace(docs.sparkSession)
    sizes = space.stage(plain_names(docs, "doc_id", "text").select(
        "doc_id", tokens(text_of("text")).alias("n_tokens")), "sizes")
    cut = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / max_len))))
    start = F.col("piece") * max_len
    return cut.select("doc_id", "piece", start.alias("start"),
                      F.least(F.lit(max_len).cast("long"), F.col("n_tokens") - start).alias("length"))


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET,
         tokens=word_tokens, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Each piece with its ``bucket_len``, ``batch`` (numbered within the bucket) and ``slot``."""
    space = Workspace(docs.sparkSession)
    pieces = pieces_of(docs, max_len, tokens, space)
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = best_bounds(histogram, buckets)
    return batches(pieces, bounds, token_budget, max(1, sum(histogram.values()) // salt_rows))


def batches(pieces: DataFrame, bounds: Sequence[int], token_budget: int, salts: int) -> DataFrame:
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    placed = pieces.withColumns({
        "bucket_len": F.get(F.filter(limits, lambda b: b >= F.col("length")), F.lit(0)),
        "salt": F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts))})
    counts = placed.groupBy("bucket_len", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket_len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket_len", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket_len", "salt").orderBy("doc_id", "piece", "length")
    rank = F.col("offset") + F.col("rank") - 1
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.col("bucket_len")))
    return (placed.withColumn("rank", F.row_number().over(inside))
            .join(offsets, ["bucket_len", "salt"])
            .select("doc_id", "piece", "start", "length", "bucket_len",
                    F.floor(rank / fit).cast("long").alias("batch"), F.pmod(rank, fit).cast("long").alias("slot")))


def op7_packing(docs: DataFrame) -> DataFrame:
    return pack(docs)
