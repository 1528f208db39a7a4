"""Quality by co-training two views of a page.

The content view sees the text only: shares of word shapes (letters, signs and digits
folded to classes), repetition, symbols, capitals.  The metadata view sees language, source,
length and line layout only.  Each view is a ridge logistic regression, first fitted on a
labelled sample.  In every round both views score all other documents; the most confident
ones of each class, in the proportion of the labelled classes and a share of all that grows
by ``SHARE`` a round, become training rows of the other view.  Both views are then
calibrated on labelled rows that trained neither, and a logistic combination of the two
calibrated scores is the document's score.

The labelled sample is bounded: the ``LABELLED`` labelled ids with the smallest hash, whose
short feature rows reach the driver.  All documents outside it take part as unlabelled
pages, however many: their features are staged once, a distributed histogram of confidence
gives each view's threshold for each class, and each Newton step adds up the gradients and
Hessians of the chosen pages in the tasks, then over all tasks, as fixed-point numbers, so
that the order of tasks changes nothing.  Together they weigh at most half of what the
labelled rows do.  Every document is scored, in one pass without a shuffle.

Defined cases: null and empty texts are scored like any other (few words speak against a
page); null language, source or length are values of their own; conflicting labels count
by majority; one of the texts that repeat a labelled id stands for it; without labels of
both kinds every document scores 1 and is kept; repeated rows are scored one by one; extra
columns pass through ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.logistic import fit_logistic, predict
from tidemark.llm.words import plain_names
from tidemark.workspace import Workspace

LABELLED = 8_000
ROUNDS = 3
#: Newton steps of a round; each is one pass over the staged features.
STEPS = 3
SHARE = 0.04
SURE = 0.9
#: Cells of the histogram of confidence from SURE to 1.
BINS = 512
#: Fixed-point unit of the sums.
UNIT = 1 << 24
SHAPES = 64
SOURCES = 32
KEEP_FROM = 0.5
FIELDS = ("doc_id", "text", "lang", "source", "n_chars")

#: Byte classes of a word's shape: capital, small or other letter, digit, sign.
_CLASS = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


class ShapeBuckets(dict):
    """Bucket of a word's shape (runs of a class count once); emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        shape = bytearray()
        for b in word.translate(_CLASS):
            if not shape or shape[-1] != b:
                shape.append(b)
        value = zlib.crc32(bytes(shape)) % SHAPES
        self[word] = value
        return value


def content_features(text: bytes, buckets: ShapeBuckets):
    import numpy as np

    words = text.split()
    n = len(words)
    out = np.zeros(SHAPES + 8)
    if not n:
        out[SHAPES] = 1.0
        return out
    out[:SHAPES] = np.bincount(np.fromiter(map(buckets.__getitem__, words), np.int64, n), minlength=SHAPES) / n
    lines = [x for x in text.split(b"\n") if x]
    signs = len(text.translate(None, b"#*$%&|<>@^~_=+"))
    out[SHAPES + 1] = min(n, 100) / 100
    out[SHAPES + 2] = len(set(words)) / n
    out[SHAPES + 3] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    out[SHAPES + 4] = min(1.0, 4 * (len(text) - signs) / n)
    out[SHAPES + 5] = min(1.0, len(text) / n / 20)
    out[SHAPES + 6] = len(set(lines)) / max(1, len(lines))
    out[SHAPES + 7] = min(1.0, text.count(b"!!") / n)
    return out


def metadata_features(lang, source, n_chars, text: bytes):
    import numpy as np

    out = np.zeros(SOURCES + 16 + 8)
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1.0
    out[SOURCES + zlib.crc32((lang or "").encode()) % 16] = 1.0
    size = np.log1p(max(0, n_chars or 0))
    lines = text.count(b"\n") + 1
    out[-8:] = [n_chars is None, size / 10, (size / 10) ** 2, size < np.log(120), np.log1p(lines) / 6,
                np.log1p(len(text) / lines) / 8, source is None, lang is None]
    return out


def _features(batch: pa.RecordBatch, buckets: ShapeBuckets):
    import numpy as np

    texts = [t.as_py() or b"" for t in batch.column(batch.schema.get_field_index("text")).cast(pa.binary())]
    side = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "source", "n_chars")]
    content = np.array([content_features(t, buckets) for t in texts]).reshape(len(texts), -1)
    meta = np.array([metadata_features(*row) for row in zip(*side, texts, strict=True)]).reshape(len(texts), -1)
    return content, meta


@dataclass(frozen=True)
class CoTrained:
    """Weights of the views, their calibration curves and the combination; None: no labels."""

    content: object = None
    meta: object = None
    curves: tuple = ()
    blend: object = None
    #: Of each round: how many pages each view labelled 0 and 1 for the other.
    pseudo: tuple = ()

    def scores(self, content, meta):
        """(score, content score, metadata score), each a calibrated probability."""
        import numpy as np

        if self.blend is None:
            return np.ones(len(content)), np.ones(len(content)), np.ones(len(content))
        one = predict(self.curves[0], _logit(predict(self.content, content))[:, None])
        two = predict(self.curves[1], _logit(predict(self.meta, meta))[:, None])
        return predict(self.blend, np.column_stack([_logit(one), _logit(two)])), one, two


def _logit(p):
    import numpy as np

    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def features(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """Feature rows ``id quality content meta`` of all documents; quality null outside the labelled sample."""
    truth = (plain_names(labels, "doc_id", "quality").where("quality IS NOT NULL AND doc_id IS NOT NULL")
             .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality")))
    known = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = plain_names(docs, *FIELDS).join(F.broadcast(known), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = ShapeBuckets()
        for batch in batches:
            content, meta = _features(batch, buckets)
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")).cast(pa.string()),
                batch.column(batch.schema.get_field_index("quality")),
                pa.array([row.tobytes() for row in content.astype("float32")], pa.binary()),
                pa.array([row.tobytes() for row in meta.astype("float32")], pa.binary())], names=["id", "quality", "content", "meta"])

    return rows.mapInArrow(run, "id string, quality int, content binary, meta binary")


def _matrix(column):
    import numpy as np

    rows = column.to_pylist() if hasattr(column, "to_pylist") else column
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(float)


def _bin(sure):
    import numpy as np

    return np.clip(np.floor((sure - SURE) / (1 - SURE) * BINS), -1, BINS - 1).astype(int)


def confidences(pages: DataFrame, weights: tuple) -> dict:
    """Histogram of each view's confidence in each class: (view, label) to counts of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        seen = np.zeros((2, 2, BINS), np.int64)
        for batch in batches:
            for v in (0, 1):
                p = predict(weights[v], _matrix(batch.column(v)))
                for label, sure in ((0, 1 - p), (1, p)):
                    cells = _bin(sure)
                    seen[v, label] += np.bincount(cells[cells >= 0], minlength=BINS)
        at = np.flatnonzero(seen.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen.ravel()[at], pa.int64())], names=["cell", "n"])

    import numpy as np

    counts = np.zeros(4 * BINS, np.int64)
    for r in pages.select("content", "meta").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r.cell] = r.n
    return {(v, label): counts.reshape(2, 2, BINS)[v, label] for v in (0, 1) for label in (0, 1)}


def lowest_cell(counts, wanted: float) -> int:
    """The lowest cell to take, from the top, until ``wanted`` pages are reached; whole cells only."""
    import numpy as np

    above = np.cumsum(counts[::-1])[::-1] - counts
    return int(np.flatnonzero(above < wanted).min()) if wanted > 0 else BINS


def _chosen(weights, lowest, views, v):
    """(rows, labels) that view ``v`` hands to the other view."""
    import numpy as np

    p = predict(weights[v], views[v])
    yes, no = _bin(p) >= lowest[v, 1], _bin(1 - p) >= lowest[v, 0]
    rows = np.flatnonzero(yes | no)
    return rows, yes[rows].astype(float)


def pseudo_sums(pages: DataFrame, weights: tuple, lowest: dict, current: list) -> list:
    """For each view: (rows, gradient, Hessian) at ``current`` over the pages chosen by the other view."""
    import numpy as np

    sizes = [len(w) for w in current]
    spans = [1 + n + n * n for n in sizes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(n) for n in spans]
        for batch in batches:
            views = [_matrix(batch.column(v)) for v in (0, 1)]
            for v in (0, 1):
                rows, y = _chosen(weights, lowest, views, v)
                u = 1 - v
                x = np.column_stack([np.ones(len(rows)), views[u][rows]])
                p = predict(current[u], views[u][rows])
                curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
                sums[u] += np.concatenate([[len(rows)], x.T @ (y - p), curve.ravel()])
        fixed = np.rint(np.concatenate(sums) * UNIT).astype(np.int64)
        at = np.flatnonzero(fixed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(fixed[at], pa.int64())], names=["i", "s"])

    flat = np.zeros(sum(spans))
    for r in pages.select("content", "meta").mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect():
        flat[r.i] = r.s / UNIT
    parts = np.split(flat, [spans[0]])
    return [(part[0], part[1:1 + n], part[1 + n:].reshape(n, n)) for part, n in zip(parts, sizes, strict=True)]


def newton_step(w, x, y, extra, ridge: float = 1.0):
    """One step on the labelled rows and the sums over the chosen pages, which weigh half at most."""
    import numpy as np

    x = np.column_stack([np.ones(len(x)), x])
    shrink = np.full(len(w), ridge)
    shrink[0] = 1e-6
    p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
    share = 0.5 * min(1.0, len(x) / max(1.0, extra[0]))
    slope = x.T @ (y - p) - shrink * w + share * extra[1]
    curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(shrink) + share * extra[2]
    move = np.linalg.solve(curve, slope)
    return w + move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained:
    """Fit both views on the labelled sample and on all other documents, then their combination."""
    import numpy as np

    space = Workspace(docs.sparkSession)
    rows = space.stage(features(docs, labels, labelled), "features")
    sample = sorted(rows.where("quality IS NOT NULL").groupBy("id").agg(F.min(F.struct("content", "meta", "quality")).alias("r"))
                    .select("id", "r.*").collect())
    known = [_matrix([bytes(r[v]) for r in sample]) if sample else np.empty((0, 0)) for v in ("content", "meta")]
    y = np.array([r.quality for r in sample], float)
    # A quarter of the labelled rows, by hash, calibrates and trains neither view.
    spare = np.array([zlib.crc32(r.id.encode()) % 4 == 0 for r in sample], bool)
    if len({*y[~spare]}) < 2 or len({*y[spare]}) < 2:
        return CoTrained()
    pages = rows.where("quality IS NULL")
    total = pages.count()
    weights = [fit_logistic(known[v][~spare], y[~spare], ridge=1.0) for v in (0, 1)]
    pseudo = []
    for turn in range(1, rounds + 1 if total else 1):
        counts = confidences(pages, tuple(weights))
        lowest = {(v, label): lowest_cell(cells, turn * SHARE * total * (y[~spare] == label).mean()) for (v, label), cells in counts.items()}
        pseudo.append({at: int(cells[lowest[at]:].sum()) for at, cells in counts.items()})
        current = list(weights)
        for _ in range(STEPS):
            sums = pseudo_sums(pages, tuple(weights), lowest, current)
            current = [newton_step(current[v], known[v][~spare], y[~spare], sums[v]) for v in (0, 1)]
        weights = current
    raw = [predict(weights[v], known[v][spare]) for v in (0, 1)]
    curves = tuple(fit_logistic(_logit(p)[:, None], y[spare], ridge=0.1) for p in raw)
    sides = np.column_stack([_logit(predict(c, _logit(p)[:, None])) for c, p in zip(curves, raw, strict=True)])
    return CoTrained(weights[0], weights[1], curves, fit_logistic(sides, y[spare], ridge=0.1), tuple(pseudo))


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """``doc_id score content_score meta_score`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = ShapeBuckets()
        for batch in batches:
            scores = model.scores(*_features(batch, buckets))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s, pa.float64()) for s in scores)],
                                             names=["doc_id", "score", "content_score", "meta_score"])

    rows = plain_names(docs, *FIELDS)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, content_score double, meta_score double")


def keep_good(docs: DataFrame, model: CoTrained, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents, all columns kept, whose score is at least ``keep_from``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = ShapeBuckets()
        for batch in batches:
            yield batch.filter(pa.array(model.scores(*_features(batch, buckets))[0] >= keep_from, pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op2_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).withColumn("kept", F.col("score") >= KEEP_FROM)
