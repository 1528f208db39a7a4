"""Spelling variants by k-d trees over letter-count vectors.

Words (lower-cased runs of letters) are counted over all documents.  Two words are near if
one inserted, deleted or replaced letter makes them equal.  Such an edit moves the vector
of letter counts by one up, one down, or both, an L1 distance of at most two.  So a word
asks the tree of its own length for vectors at most one up and one down away, and the tree
of the next length for vectors one up away; boxes that lie further off are pruned, and the
words that are met have their letters compared in order.

A vector is held as bits: bit t of a letter says that it occurs more than t times, for
``LETTERS`` counters (letters outside a-z share some) and up to ``STEPS`` occurrences.
Distances between such bits never exceed the true ones, so no near word is lost, and boxes
and points are compared by counting bits.

Trees are spread over tasks.  Each length has a top tree of about one leaf per ``CELL``
words, split on a sample of about ``SAMPLE`` words chosen by hash (which only sets where
the cuts lie); a word goes to its own leaf and as a question to the leaves that its box
query reaches, and each leaf is searched by a k-d tree of its own in one task.

A word's form is its near word with the most occurrences if those are ``ratio`` times its
own; roots follow forms to the end by doubling, as counts grow at each step.

Defined cases: null texts have no words; a null id counts as empty where ids are hashed;
repeated rows count again; no words give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import plain_names
from tidemark.workspace import Workspace

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
#: Words in a leaf of a top tree, and the sample that places its cuts.
CELL = 40_000
SAMPLE = 60_000
#: Words in a leaf of a task's own tree; questions compared with a leaf at once.
LEAF = 64
BATCH = 20_000
#: Entries of a task's table of counts before it is handed on.
TABLE = 400_000
LETTERS = 42
STEPS = 3

_RUNS = re.compile("[a-zÀ-ÿ]+")


def as_read(doc_id, run: str) -> str:
    return run


def planted(doc_id, run: str) -> str:
    """The run with one letter deleted where the checksum of id and run says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 199:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, change: Callable[[object, str], str] = as_read, min_length: int = MIN_LENGTH) -> DataFrame:
    """``word n`` of all documents; counts are combined in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        found: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_py()
                if raw is None:
                    continue
                # Lower-casing bytes changes A-Z only.
                for word, n in Counter(_RUNS.findall(raw.lower().decode())).items():
                    word = change(doc_id.as_py(), word)
                    if len(word) >= min_length:
                        found[word] += n
                if len(found) > TABLE:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    texts = plain_names(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(words: list[str]):
    """Letters of words of one length as a matrix of code points."""
    import numpy as np

    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def bits_of(letters):
    """Letter counts as bits: one row of two 64-bit values for each word."""
    import numpy as np

    n, size = letters.shape
    code = letters.astype(np.int64)
    kind = np.where((code >= 97) & (code <= 122), code - 97, 26 + code % (LETTERS - 26))
    counts = np.bincount((np.arange(n)[:, None] * LETTERS + kind).ravel(), minlength=n * LETTERS).reshape(n, LETTERS)
    bits = np.zeros((n, 128), bool)
    for step in range(STEPS):
        bits[:, step * LETTERS:(step + 1) * LETTERS] = counts > step
    return np.packbits(bits, axis=1).view(np.uint64)


def _size(bits):
    import numpy as np

    return np.bitwise_count(bits).sum(axis=-1)


def _splits(bits, at) -> tuple[int, object] | None:
    """The (letter, count) whose cut is nearest to the middle, and who lies above it."""
    import numpy as np

    flat = np.unpackbits(bits[at].view(np.uint8), axis=1)
    share = flat.sum(axis=0, dtype=np.int64)
    best = int(np.abs(2 * share - len(at)).argmin())
    return None if share[best] in (0, len(at)) else (best, flat[:, best].astype(bool))


class Tree:
    """A k-d tree: boxes as the least (``low``) and greatest (``high``) counts of a subtree."""

    def __init__(self, bits, leaf: int):
        import numpy as np

        self.bits = bits
        self.nodes: list[tuple] = []  # (low, high, own points or None, lower child, upper child)
        self._grow(np.arange(len(bits)), leaf)

    def _grow(self, at, leaf: int) -> int:
        import numpy as np

        here, own = len(self.nodes), self.bits[at]
        box = (np.bitwise_and.reduce(own), np.bitwise_or.reduce(own))
        cut = _splits(self.bits, at) if len(at) > leaf else None
        if cut is None:
            self.nodes.append((*box, at, -1, -1))
            return here
        self.nodes.append(())
        below, above = self._grow(at[~cut[1]], leaf), self._grow(at[cut[1]], leaf)
        self.nodes[here] = (*box, None, below, above)
        return here

    def search(self, asked, up: int, down: int):
        """Pairs (question, point) whose point lies at most ``up`` above and ``down`` below it."""
        import numpy as np

        if not len(self.bits):
            return
        todo = [(0, np.arange(len(asked)))]
        while todo:
            node, who = todo.pop()
            low, high, own, below, above = self.nodes[node]
            q = asked[who]
            who = who[(_size(low & ~q) <= up) & (_size(q & ~high) <= down)]
            if not len(who):
                continue
            if own is None:
                todo += [(below, who), (above, who)]
                continue
            points = self.bits[own]
            # An unsplittable leaf (equal vectors) may be large: go through it in blocks.
            for start in range(0, len(own), 1024):
                part = points[start:start + 1024]
                step = max(1, BATCH * LEAF // len(part))
                for first in range(0, len(who), step):
                    q = asked[who[first:first + step]][:, None, :]
                    ok = (_size(part[None] & ~q) <= up) & (_size(q & ~part[None]) <= down)
                    i, j = np.nonzero(ok)
                    yield who[first + i], own[start + j]


def one_replaced(a, b):
    """Which rows of two equally long letter matrices differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(short, long):
    """Which rows of ``long`` are the row of ``short`` with one letter more."""
    import numpy as np

    ahead = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= short.shape[1]


class TopTree:
    """The cuts of one length's words; leaves are numbered from 0."""

    def __init__(self, bits, leaves: int):
        import numpy as np

        self.cuts: list[tuple] = []  # (bit, lower child, upper child) or (leaf number,)
        self.leaves = 0
        self._grow(bits, np.arange(len(bits)), max(1, len(bits) // max(1, leaves)))

    def _grow(self, bits, at, least: int) -> int:
        here = len(self.cuts)
        cut = _splits(bits, at) if len(at) > least else None
        if cut is None:
            self.cuts.append((self.leaves,))
            self.leaves += 1
            return here
        self.cuts.append(())
        self.cuts[here] = (cut[0], self._grow(bits, at[~cut[1]], least), self._grow(bits, at[cut[1]], least))
        return here

    def reach(self, flat, up: int, down: int) -> Iterator[tuple[int, object]]:
        """(leaf, rows of ``flat`` that have points of the leaf in their box)."""
        import numpy as np

        n = len(flat)
        todo = [(0, np.arange(n), np.full(n, up, np.int8), np.full(n, down, np.int8))]
        while todo:
            node, who, ups, downs = todo.pop()
            if not len(who):
                continue
            if len(self.cuts[node]) == 1:
                yield self.cuts[node][0], who
                continue
            bit, below, above = self.cuts[node]
            high = flat[who, bit].astype(bool)
            # Each cut on the way down is another bit, so the steps spent never exceed the distance.
            to_high, to_low = high | (ups > 0), ~high | (downs > 0)
            todo += [(above, who[to_high], (ups - ~high)[to_high], downs[to_high]),
                     (below, who[to_low], ups[to_low], (downs - high)[to_low])]


def _by_length(words: list[str]):
    groups: dict[int, list[str]] = {}
    for word in words:
        groups.setdefault(len(word), []).append(word)
    return groups


def top_trees(vocabulary: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict[int, TopTree]:
    """Top trees of the lengths that need more than one leaf."""
    sizes = {r.size: r.n for r in vocabulary.groupBy(F.length("word").alias("size")).agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > cell).collect()}
    if not sizes:
        return {}
    # Every task sends only the words whose hash falls into the sample's share.
    share = int(min(1.0, sample / sum(sizes.values())) * (1 << 31))
    drawn = vocabulary.where(F.length("word").isin(list(sizes)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 31)) < share)).select("word").orderBy("word")
    return {size: TopTree(bits_of(letters_of(words)), -(-sizes[size] // cell))
            for size, words in _by_length([r.word for r in drawn.collect()]).items()}


def routed(vocabulary: DataFrame, trees: dict[int, TopTree]) -> DataFrame:
    """``size leaf own word``: each word in its own leaf, and as a question in others."""
    alone = TopTree.__new__(TopTree)
    alone.cuts, alone.leaves = [(0,)], 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out: list[tuple] = []
            for size, words in _by_length(batch.column(0).to_pylist()).items():
                flat = np.unpackbits(bits_of(letters_of(words)).view(np.uint8), axis=1)
                names = np.array(words, object)
                home = np.zeros(len(words), np.int64)
                for leaf, who in trees.get(size, alone).reach(flat, 0, 0):
                    home[who] = leaf
                    out.append((size, leaf, True, names[who]))
                for leaf, who in trees.get(size, alone).reach(flat, 1, 1):
                    out.append((size, leaf, False, names[who[home[who] < leaf]]))  # a pair is asked for once
                for leaf, who in trees.get(size + 1, alone).reach(flat, 1, 0):
                    out.append((size + 1, leaf, False, names[who]))
            for size, leaf, own, names in out:
                n = len(names)
                if n:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, size), pa.int32()), pa.array(np.full(n, leaf), pa.int32()),
                        pa.array(np.full(n, own), pa.bool_()), pa.array(names, pa.string())], names=["size", "leaf", "own", "word"])

    return vocabulary.select("word").mapInArrow(run, "size int, leaf int, own boolean, word string")


def search_cell(table: pa.Table) -> Iterator[tuple]:
    """(words, others) of the near pairs of one leaf."""
    import numpy as np

    words, own = table.column("word").to_pylist(), table.column("own").to_pylist()
    points = sorted(w for w, o in zip(words, own, strict=True) if o)
    if not points:
        return
    letters, names = letters_of(points), np.array(points, object)
    bits = bits_of(letters)
    tree = Tree(bits, LEAF)
    for i, j in tree.search(bits, 1, 1):
        i, j = i[i < j], j[i < j]
        ok = one_replaced(letters[i], letters[j])
        yield names[i[ok]], names[j[ok]]
    for size, asked in _by_length([w for w, o in zip(words, own, strict=True) if not o]).items():
        theirs, askers = letters_of(asked), np.array(asked, object)
        same = size == letters.shape[1]
        for i, j in tree.search(bits_of(theirs), 1, 1 if same else 0):
            ok = one_replaced(theirs[i], letters[j]) if same else one_inserted(theirs[i], letters[j])
            yield askers[i[ok]], names[j[ok]]


def near_pairs(vocabulary: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """``word other``: every pair of words one edit apart, once, in either order."""

    def run(table: pa.Table) -> pa.Table:
        import numpy as np

        found = list(search_cell(table))
        sides = [np.concatenate([f[s] for f in found]) if found else np.empty(0, object) for s in (0, 1)]
        return pa.table({"word": pa.array(sides[0], pa.string()), "other": pa.array(sides[1], pa.string())})

    cells = routed(vocabulary, top_trees(vocabulary, cell, sample))
    return cells.groupBy("size", "leaf").applyInArrow(run, "word string, other string")


def roots(forms: DataFrame, space: Workspace) -> DataFrame:
    """``word root`` of every word of ``forms`` (word, form): the last form of the chain."""
    ends = space.stage(forms.select("word", F.col("form").alias("root")), "ends")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = space.stage(ends.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "ends")
        if ends.where("moved").isEmpty():
            return ends.select("word", "root")
        ends = ends.select("word", "root")


def spelling_variants(counts: DataFrame, min_count: int = MIN_COUNT, ratio: int = RATIO, cell: int = CELL,
                      sample: int = SAMPLE) -> DataFrame:
    """``word form root n n_near form_n`` of every word of ``counts`` (word, n) with enough occurrences."""
    space = Workspace(counts.sparkSession)
    words = space.stage(counts.where(F.col("n") >= min_count), "words")
    pairs = space.stage(near_pairs(words, cell, sample), "pairs")
    both = pairs.unionAll(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))
    best = both.join(words.withColumnsRenamed({"word": "other", "n": "other_n"}), "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    strong = -F.col("best.n") >= ratio * F.col("n")
    found = space.stage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n")), "found")
    ends = roots(found.where("form IS NOT NULL"), space)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(docs: DataFrame) -> DataFrame:
    return spelling_variants(word_counts(docs, planted))


#: The checksum's table follows from its polynomial; letters here take one or two bytes.
ORACLE_SQL = r"""
WITH RECURSIVE step(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
hashed AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
    string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM runs, crc),
made AS (SELECT c, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
half AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
    UNION SELECT cut.word, v.word FROM cut JOIN v ON v.word = cut.d),
near AS (SELECT word, other FROM half UNION SELECT other, word FROM half),
best AS (SELECT near.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS b, max(o.n) AS bn
    FROM near JOIN v o ON o.word = near.other GROUP BY near.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 5 * v.n THEN b END AS form, CASE WHEN bn >= 5 * v.n THEN bn END AS form_n
    FROM v LEFT JOIN best USING (word)),
chase(word, cur, k) AS (SELECT word, word, 0 FROM f UNION ALL SELECT chase.word, f.form, k + 1 FROM chase JOIN f ON f.word = chase.cur WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(cur, k) AS root FROM chase GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends ON ends.word = f.word
"""
