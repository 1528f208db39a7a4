"""Line dedup by a segment-partition edit join over words.

A line's symbols are its words (runs of non-blank characters), so lines that differ in
blanks only are equal.  Two lines are linked if at most ``min(max_edits, words //
words_per_edit)`` words, counted on the shorter line, must be inserted, deleted or replaced
to make them equal; links join transitively, and a class keeps its first line, by document
id and line number.  A line of fewer words than ``words_per_edit`` has no edits: it is
equal to another or it is not.

A line with k edits is split into k + 1 segments; a line within k edits must contain one of
them unchanged, close to its old place.  Each line posts its segments under (number of
words, segment, hash of the segment's words) and probes the runs of words that can meet a
segment of a line as long as itself or shorter by as many as that one's edits.  Keys of all
lines are counted once, with equal lines combined in each task; the few keys that
different lines share are marked in a bitmap of fixed size, and only rows that meet it are
listed.  Lines of a list are verified by a banded bit-parallel edit distance: the 2k + 1
cells around the diagonal are the bits of a number that slides along with the words, so a
line of any length needs one number for a column.

Only built-in functions are used.  Lists with many lines are resolved by
``components.connect`` without writing out their pairs.

Defined cases: null text has no lines; empty and blank lines are never touched; rows that
repeat an id and a text are one occurrence and fare alike, and so do equal lines at the same
place of documents without an id; rows without an id come first; a text without dropped
lines stays as it is, and extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connect
from tidemark.llm.exact_dedup import cells_of, with_repeated
from tidemark.llm.words import let, plain_names, text_of
from tidemark.workspace import Workspace

MAX_EDITS = 2
WORDS_PER_EDIT = 8
PLAIN = {"parquet.enable.dictionary": "false"}


def digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def node_of(line: Column) -> Column:
    """Short name of a line among the lists of keys; its digest is what names its class.

    Should two lines have one name, one of them is listed and the other left alone.
    """
    return F.xxhash64(line)


def flat_lines(text: Column) -> Column:
    """Array of a text's lines, words one space apart (but for a space at either end)."""
    return F.split(F.regexp_replace(text, r"[ \t\x0B\f\r]{2,}|[\t\x0B\f\r]", " "), "\n")


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id line_no line`` of every non-blank line, its words joined by one space."""
    lines = plain_names(docs, "doc_id", "text").select("doc_id", F.posexplode(flat_lines(text_of("text"))).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.btrim("line").alias("line")).where("line != ''")


def allowed(words: Column, max_edits: int, words_per_edit: int) -> Column:
    """Edits allowed between a line of so many words and one as long or longer."""
    return F.least(F.lit(max_edits), (words / words_per_edit).cast("int"))


def cases_of(edits: int) -> list[tuple[int, int, int, int]]:
    """(edits, how much shorter the other line is, segment, shift) of every key at a number of edits."""
    cases = []
    for less in range(edits + 1):
        for i in range(edits + 1):
            # An unchanged segment has i edits at most before it, or edits - i after it.
            shifts = {s for s in range(-edits, edits + 1) if abs(s) <= i and abs(s - less) <= edits - i}
            if less == 0:
                shifts.add(0)  # the line's own segments
            cases += [(edits, less, i, s) for s in sorted(shifts)]
    return cases


def keys_of(lines: DataFrame, max_edits: int, words_per_edit: int) -> DataFrame:
    """``node key``: the hashed index and probe keys of every line that may have edits.

    Segments are even; the last ones take the rest of the length.
    """
    names = ("edits", "less", "i", "shift")

    def cases(least: int) -> Column:
        return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, case, strict=True)])
                         for edits in range(least, max_edits + 1) for case in cases_of(edits)])

    # Long lines meet only lines of the most edits.
    own = F.when(F.size("words") >= max_edits * words_per_edit + max_edits, cases(max_edits)).otherwise(cases(1))
    rows = lines.where(F.length("line") >= 2 * words_per_edit - 1).select(node_of(F.col("line")).alias("node"), F.split("line", " ").alias("words"))
    rows = rows.select("node", "words", F.size("words").alias("n"), F.explode(own).alias("c")).select("node", "words", "n", "c.*")
    parts, i, target = F.col("edits") + 1, F.col("i"), F.col("target")
    rest = target % parts
    short = ((target - rest) / parts).cast("int")
    start = i * short + F.greatest(F.lit(0), i - (parts - rest)) + F.col("shift")
    length = short + F.when(i >= parts - rest, 1).otherwise(0)
    real = (F.col("edits") == allowed(target, max_edits, words_per_edit)) & (start >= 0) & (start + length <= F.col("n"))
    return rows.withColumn("target", F.col("n") - F.col("less")).where(real).select(
        "node", F.xxhash64("target", "i", F.slice("words", start + 1, length)).alias("key"))


def word_edits(a: Column, b: Column, k: int) -> Column:
    """Word edits between two arrays, right up to ``k``; more than ``k`` otherwise.

    Bit i of a column's numbers stands for row j - k + i of column j.  ``vp`` and ``vn``
    mark the rows whose value is one more or one less than that of the row above; the value
    itself is followed down the band's lowest diagonal, then along the last row.
    """
    m, n, full = F.size(a), F.size(b), (1 << (2 * k + 1)) - 1
    inverse = lambda x: F.bitwise_not(x).bitwiseAND(full)
    half = lambda x: F.shiftright(x, 1)

    def column(state: Column, j: Column) -> Column:
        vp, vn = state["vp"], state["vn"]

        def equal_rows(word: Column) -> Column:
            hits = [F.when(F.get(a, j + (i - k - 1)) == word, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(2 * k + 1)]
            total = hits[0]
            for hit in hits[1:]:
                total = total + hit
            return total

        def after(zero: Column) -> Column:
            """``zero``: the rows whose value is that of the row above in the column before."""
            up, down = vn.bitwiseOR(inverse(zero.bitwiseOR(vp))), zero.bitwiseAND(vp)

            def closed(up: Column, down: Column) -> Column:
                bit = m - j + k
                moved = F.when(j + k <= m, 1 - F.getbit(zero.cast("long"), F.lit(2 * k)).cast("int")).otherwise(
                    F.getbit(up.cast("long"), bit).cast("int") - F.getbit(down.cast("long"), bit).cast("int"))
                return F.struct(down.bitwiseOR(inverse(half(zero).bitwiseOR(up))).alias("vp"), half(zero).bitwiseAND(up).alias("vn"),
                                (state["value"] + moved).alias("value"))

            return let(F.struct(up.alias("up"), down.alias("down")), lambda h: closed(h["up"], h["down"]))

        return let(equal_rows(F.get(b, j - 1)), lambda x: let(
            (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(full), after))

    start = F.struct(F.lit(full & ~((1 << k) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("value"))
    far = (F.abs(m - n) > k) | (m < k) | (n == 0)
    return F.when(far, F.greatest(m, n, F.lit(k + 1)) if k else F.lit(1)).otherwise(F.aggregate(F.sequence(F.lit(1), n), start, column)["value"])


def listed(keys: DataFrame, space: Workspace) -> DataFrame:
    """``key node`` of the keys that different lines share."""
    shared = space.stage(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least != most").select("key"), "shared")
    # The bitmap lets a part of the other keys through, so the exact list decides once more.
    near = with_repeated(keys, ["key"], cells_of(shared, ["key"])).where("shared").select("key", "node")
    return near.join(shared, "key", "left_semi").distinct()


def listed_lines(inst: DataFrame, lists: DataFrame, space: Workspace) -> DataFrame:
    """``node lid words`` of the listed lines (words as hashes); only they leave the scan."""
    nodes = space.stage(lists.select("node").distinct(), "nodes")
    cells = space.stage(cells_of(nodes, ["node"]), "cells")
    lines = with_repeated(inst.select(node_of(F.col("line")).alias("node"), "line"), ["node"], cells).where("shared")
    first = lines.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("line").alias("line"))
    words = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))
    return space.stage(first.select("node", digest(F.col("line")).alias("lid"), words.alias("words")), "lines")


def linked_lines(inst: DataFrame, max_edits: int, words_per_edit: int, space: Workspace) -> DataFrame:
    """``lid component`` of the lines that have a link to a different line."""
    # Hashes hardly repeat, so dictionaries would only cost time.
    keys = space.stage(keys_of(inst, max_edits, words_per_edit), "keys", **PLAIN)
    lists = space.stage(listed(keys, space), "listed")
    lines = listed_lines(inst, lists, space)

    def linked(x: Column, y: Column) -> Column:
        n, m = F.size(x["words"]), F.size(y["words"])
        least = allowed(F.least(n, m), max_edits, words_per_edit)
        # An edit takes away one word at most, so cheap set differences settle most pairs.
        close = (F.abs(n - m) <= least) & (F.size(F.array_except(x["words"], y["words"])) <= least) & (
            F.size(F.array_except(y["words"], x["words"])) <= least)
        return F.when(close, word_edits(x["words"], y["words"], max_edits) <= least).otherwise(False)

    # Lines near the middle of a group share most of its keys, so they should lead its lists.
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    weights = lists.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("weight"))
    joined = connect(lists.join(weights, "node").select("key", "node", "weight"), lines.select("node", "words"), linked, space)
    names = lines.select("node", "lid")
    return space.stage(joined.join(names, "node").select("lid", F.col("component").alias("node")).join(
        names.withColumnRenamed("lid", "component"), "node").select("lid", "component"), "joined")


def duplicate_lines(docs: DataFrame, max_edits: int = MAX_EDITS, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """``doc_id line_no lid class_doc class_line kept`` of every non-blank line."""
    if words_per_edit < 2:
        raise ValueError("a line of one word has no segments: words_per_edit is 2 at least")
    space = Workspace(docs.sparkSession)
    # Later passes read the columns they need instead of cutting all texts again.
    inst = space.stage(lines_of(docs).select("doc_id", "line_no", digest(F.col("line")).alias("lid"), "line"), "inst", **PLAIN)
    joined = linked_lines(inst, max_edits, words_per_edit, space)
    rows = inst.select("doc_id", "line_no", "lid", F.xxhash64("lid").alias("mark"))
    # Lines that are neither repeated nor linked pass a bitmap in the scan; all others meet their class.
    again = rows.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    cells = space.stage(cells_of(again.unionAll(joined.select(F.xxhash64("lid").alias("mark"))), ["mark"]), "cells")
    marked = with_repeated(rows, ["mark"], cells)
    met = space.stage(marked.where("shared").join(joined, "lid", "left").select(
        "doc_id", "line_no", "lid", F.coalesce("component", "lid").alias("component")), "met")
    heads = space.stage(met.groupBy("component").agg(F.min(F.struct("doc_id", "line_no")).alias("first")), "heads")
    own = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.line_no") == F.col("line_no"))
    return met.join(heads, "component").select(
        "doc_id", "line_no", "lid", F.col("first.doc_id").alias("class_doc"), F.col("first.line_no").alias("class_line"), own.alias("kept")).unionAll(
        marked.where("NOT shared").select(
            "doc_id", "line_no", "lid", F.col("doc_id").alias("class_doc"), F.col("line_no").alias("class_line"), F.lit(True).alias("kept")))


def drop_duplicate_lines(docs: DataFrame, max_edits: int = MAX_EDITS, words_per_edit: int = WORDS_PER_EDIT) -> DataFrame:
    """The documents, all columns kept, without their dropped lines.

    A document that had words and has none left goes as a whole.
    """
    name = lambda n, lid: F.concat(n.cast("string"), F.lit(":"), F.lower(F.hex(lid)))
    gone = (duplicate_lines(docs, max_edits, words_per_edit).where("NOT kept").groupBy(F.col("doc_id").alias("_id"))
            .agg(F.collect_set(name(F.col("line_no"), F.col("lid"))).alias("_gone")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(gone, rows["row.doc_id"].eqNullSafe(gone["_id"]), "left")
    lines = F.split(text_of("row.text"), "\n")
    flat = flat_lines(text_of("row.text"))
    named = F.transform(flat, lambda x, i: F.concat(i.cast("string"), F.lit(":"), F.md5(F.btrim(x))))
    # Names start with the line's number, so the difference keeps their order.
    kept = F.transform(F.array_except(named, F.col("_gone")), lambda x: F.get(F.col("_lines"), F.substring_index(x, ":", 1).cast("int")))
    text = F.when(F.col("_gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("_lines", F.when(F.col("_gone").isNotNull(), lines)).withColumn("_new", text)
    emptied = F.col("_gone").isNotNull() & ~F.col("_new").rlike(r"[^ \t-\r]")
    return out.where(~F.coalesce(emptied, F.lit(False))).select(
        *[F.col("_new").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op6_line_dedup(docs: DataFrame) -> DataFrame:
    return duplicate_lines(docs).select("doc_id", "line_no", "class_doc", "class_line", "kept")


def _oracle() -> str:
    """Links of at most two edits, after the common first and last words are taken off.

    What is left differs at both ends, so two edits must mend one end each.
    """
    ends = [(1, 1), (1, 0), (0, 1)]  # words that an edit takes from either line
    middle = " OR ".join(
        f"(a[p + {1 + fa}:na - s - {ba}] = b[p + {1 + fb}:nb - s - {bb}])" for fa, fb in ends for ba, bb in ends)
    return rf"""
WITH RECURSIVE i AS (SELECT doc_id, CAST(n - 1 AS INTEGER) AS line_no, regexp_extract_all(l[n], '[^\x20\x09-\x0D]+') AS w FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
x AS (SELECT * FROM i WHERE len(w) > 0),
u AS (SELECT w, len(w) AS n, row_number() OVER (ORDER BY w) AS id FROM (SELECT DISTINCT w FROM x)),
pairs AS (SELECT x.id AS ida, y.id AS idb, x.w AS a, y.w AS b, x.n AS na, y.n AS nb, least({MAX_EDITS}, x.n // {WORDS_PER_EDIT}) AS k
    FROM u x JOIN u y ON y.n BETWEEN x.n AND x.n + least({MAX_EDITS}, x.n // {WORDS_PER_EDIT}) AND (x.n < y.n OR x.id < y.id) AND x.n >= {WORDS_PER_EDIT}),
front AS (SELECT *, coalesce(list_position(list_transform(list_zip(a, b), lambda z: z[1] IS DISTINCT FROM z[2]), true), na + 1) - 1 AS p FROM pairs),
back AS (SELECT *, least(na - p, coalesce(list_position(list_transform(list_zip(list_reverse(a), list_reverse(b)),
    lambda z: z[1] IS DISTINCT FROM z[2]), true), na + 1) - 1) AS s FROM front),
e AS (SELECT ida AS a, idb AS b FROM back WHERE nb - p - s <= 1 OR (k >= 2 AND (nb - p - s <= 2 OR {middle}))),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk(a, b) AS (SELECT a, a FROM s UNION SELECT walk.a, s.b FROM walk JOIN s ON s.a = walk.b),
g AS (SELECT a AS id, min(b) AS c FROM walk GROUP BY a),
m AS (SELECT x.doc_id, x.line_no, coalesce(g.c, u.id) AS c FROM x JOIN u USING (w) LEFT JOIN g USING (id)),
k AS (SELECT *, first_value(doc_id) OVER o AS class_doc, first_value(line_no) OVER o AS class_line FROM m
      WINDOW o AS (PARTITION BY c ORDER BY doc_id, line_no))
SELECT doc_id, line_no, class_doc, class_line, doc_id = class_doc AND line_no = class_line AS kept FROM k
"""


ORACLE_SQL = _oracle()
