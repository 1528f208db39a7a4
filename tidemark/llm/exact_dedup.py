"""Exact duplicates by progressive refinement.

Three levels tell texts apart: length, then a hash of the first characters, then a hash
of the whole text.  A level looks only at texts that some other text could still equal:
the level before counts its keys with partial aggregation, and the keys that occur more
than once mark cells of a bitmap of fixed size (``CELLS`` bits, at most 4 MB as a table).
The next scan meets the bitmap in a broadcast join, so no text is ever shuffled.  Cells
are shared by hash: that can let a text through for nothing, never lose one.  Whole
contents are hashed for survivors only, and only digests and ids are grouped; a group is
one aggregate of its greatest id, so a group of any size is counted map-side.

Only built-in functions are used.

Defined cases: null text counts as empty, and empty texts are equal; rows without an id
sort below all ids; of rows that repeat an id and a text one stays; no rows give no rows;
extra columns pass through ``drop_exact_duplicates`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import plain_names, text_of
from tidemark.workspace import Workspace

#: Characters under the second level's hash.
PREFIX = 64
#: Bits of the bitmap that carries a level's surviving keys, in rows of 64 bits.
CELLS = 1 << 24
ROW = 64


def unchanged(text: Column) -> Column:
    return text


def _cell(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(CELLS))


def repeated_cells(rows: DataFrame, key: list[str]) -> DataFrame:
    """``cells bits``: the bitmap of the keys that more than one row has."""
    return cells_of(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), key)


def cells_of(keys: DataFrame, key: list[str]) -> DataFrame:
    """``cells bits``: the bitmap of the keys."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % ROW).cast("int"))
    return keys.select(_cell(key).alias("cell")).groupBy(F.floor(F.col("cell") / ROW).alias("cells")).agg(F.bit_or(bit).alias("bits"))


def with_repeated(rows: DataFrame, key: list[str], bitmap: DataFrame) -> DataFrame:
    """The rows with ``shared``: whether their key may be in the bitmap."""
    # At most CELLS / ROW rows of two numbers, 4 MB.
    met = rows.withColumn("_cell", _cell(key)).join(F.broadcast(bitmap), F.floor(F.col("_cell") / ROW) == F.col("cells"), "left")
    bit = F.getbit(F.coalesce("bits", F.lit(0).cast("long")), (F.col("_cell") % ROW).cast("int"))
    return met.withColumn("shared", bit == 1).drop("_cell", "cells", "bits")


def refined(docs: DataFrame, normal: Callable[[Column], Column], space: Workspace) -> DataFrame:
    """``doc_id text size prefix shared`` of every row after the two cheap levels."""
    rows = plain_names(docs, "doc_id", "text").select("doc_id", normal(text_of("text")).alias("text"))
    rows = rows.withColumn("size", F.octet_length("text"))
    lengths = space.stage(repeated_cells(rows, ["size"]), "lengths")
    rows = with_repeated(rows, ["size"], lengths)
    rows = rows.withColumn("prefix", F.when(F.col("shared"), F.xxhash64(F.left("text", F.lit(PREFIX)))))
    prefixes = space.stage(repeated_cells(rows.where("shared"), ["size", "prefix"]), "prefixes")
    longer = with_repeated(rows.withColumnRenamed("shared", "_length"), ["size", "prefix"], prefixes)
    return longer.withColumn("shared", F.col("shared") & F.col("_length")).drop("_length")


def exact_duplicates(docs: DataFrame, normal: Callable[[Column], Column] = unchanged, all_digests: bool = False) -> DataFrame:
    """``doc_id keep_id group_size kept digest`` of every row.

    Of rows whose normalised texts are equal, the one with the greatest id stays.
    ``digest`` (SHA-256 of the normalised text, binary) is null for texts that the cheap
    levels told apart, unless ``all_digests`` asks for it: the last scan then hashes them too.
    """
    space = Workspace(docs.sparkSession)
    rows = refined(docs, normal, space)
    digest = F.unhex(F.sha2("text", 256))
    # The staged row number is what tells repeated rows apart from here on.
    rows = space.stage(rows.select(
        "doc_id", "shared", (digest if all_digests else F.when(F.col("shared"), digest)).alias("digest"),
        F.monotonically_increasing_id().alias("row")), "rows")
    # Written out, so that the join below has plain shuffles on both sides and AQE can split a hot digest.
    groups = space.stage(rows.where("shared").groupBy("digest").agg(
        F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups")
    met = rows.where("shared").join(groups, "digest", "left")
    alone = F.col("last").isNull()
    decided = met.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("last.row") == F.col("row"))).alias("kept"), "digest")
    apart = rows.where("NOT shared").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return decided.unionAll(apart)


def drop_exact_duplicates(docs: DataFrame, normal: Callable[[Column], Column] = unchanged) -> DataFrame:
    """The documents, all columns kept, with one row of each group of equal texts."""
    space = Workspace(docs.sparkSession)
    lost = space.stage(exact_duplicates(docs, normal).where("NOT kept").select("doc_id", "keep_id", "digest").distinct(), "lost")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(normal(text_of("row.text")), 256)))

    def match(other: DataFrame):
        return rows["row.doc_id"].eqNullSafe(other["_id"]) & (rows["digest"] == other["_digest"])

    named = lost.withColumnsRenamed({"doc_id": "_id", "digest": "_digest"})
    again = F.col("_id").eqNullSafe(F.col("keep_id"))
    left = rows.join(named, match(named), "left_anti")
    # A winner that is itself repeated: its rows are interchangeable, one of them stays.
    winners = rows.join(named.where(again), match(named.where(again)), "left_semi")
    once = winners.withColumn("_id", F.col("row.doc_id")).dropDuplicates(["_id", "digest"]).drop("_id")
    return left.unionAll(once).select("row.*")


def op11_exact_dedup(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs, all_digests=True).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)
"""
