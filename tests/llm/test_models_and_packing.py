"""Classifier, toxicity, decontamination, packing and the pipeline."""

from __future__ import annotations

import itertools
import pickle
import random
import re
import zlib

import pytest

from tests.conftest import SF_SMALL, SF_TINY
from tidemark.llm import cotrain, decontaminate, packing, toxicity
from tidemark.workspace import Workspace

WIDE = "doc_id long, text string, lang string, source string, n_chars long, quality string, score string"


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_cotraining_on_rows_it_did_not_see(spark):
    docs, labels = read(spark, SF_SMALL, "documents"), read(spark, SF_SMALL, "labels")
    model = cotrain.train(docs, labels.where("doc_id % 3 != 0"))
    seen = cotrain.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    assert len(seen) > 100
    right = sum((r.score >= cotrain.KEEP_FROM) == (r.quality == 1) for r in seen) / len(seen)
    assert right >= 0.97
    good = [r for r in seen if r.quality == 1]
    assert sum(r.score >= cotrain.KEEP_FROM for r in good) / len(good) >= 0.98


def in_memory_cotraining(docs, labels, labelled, rounds):
    """The same method on plain arrays, with every page in memory."""
    import zlib

    import numpy as np

    from tidemark.llm.logistic import fit_logistic, predict

    buckets = cotrain.ShapeBuckets()
    votes = {}
    for r in labels:
        votes.setdefault(r.doc_id, []).append(r.quality)
    rows = []
    for r in docs:
        text = (r.text or "").encode()
        rows.append((r.doc_id, cotrain.content_features(text, buckets), cotrain.metadata_features(r.lang, r.source, r.n_chars, text)))
    views = [np.array([r[k] for r in rows], np.float32).astype(float) for k in (1, 2)]
    known = np.array([r[0] in votes and r[0] in labelled for r in rows])
    y = np.array([float(r[0] in votes and np.mean(votes[r[0]]) >= 0.5) for r in rows])
    spare = known & np.array([zlib.crc32(str(r[0]).encode()) % 4 == 0 for r in rows])
    base, open_ = known & ~spare, ~known
    weights = [fit_logistic(v[base], y[base]) for v in views]
    for turn in range(1, rounds + 1):
        handed = []
        for v in (0, 1):
            p = predict(weights[v], views[v])
            marks = np.full(len(rows), np.nan)
            for label, sure in ((0.0, 1 - p), (1.0, p)):
                cell = np.floor((sure - 0.9) / (1 - 0.9) * cotrain.BINS).clip(max=cotrain.BINS - 1)
                wanted, took = turn * cotrain.SHARE * open_.sum() * (y[base] == label).mean(), 0
                for c in range(cotrain.BINS - 1, -1, -1):
                    if took >= wanted:
                        break
                    here = open_ & (cell == c)
                    marks[here] = label
                    took += here.sum()
            handed.append(marks)
        after = []
        for v in (0, 1):
            w, marks = weights[v], handed[1 - v]
            extra = ~np.isnan(marks)
            share = 0.5 * min(1.0, base.sum() / max(1, extra.sum()))
            for _ in range(cotrain.STEPS):
                x = np.column_stack([np.ones(len(rows)), views[v]])
                weight = np.where(base, 1.0, np.where(extra, share, 0.0))
                p = predict(w, views[v])
                shrink = np.full(len(w), 1.0)
                shrink[0] = 1e-6
                slope = x.T @ (weight * (np.where(base, y, np.nan_to_num(marks)) - p)) - shrink * w
                curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(shrink)
                move = np.linalg.solve(curve, slope)
                w = w + move * min(1.0, 5.0 / max(np.abs(move).max(), 1e-12))
            after.append(w)
        weights = after
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    sides = []
    for v in (0, 1):
        raw = logit(predict(weights[v], views[v]))[:, None]
        sides.append(logit(predict(fit_logistic(raw[spare], y[spare], ridge=0.1), raw)))
    sides = np.column_stack(sides)
    return {r[0]: s for r, s in zip(rows, predict(fit_logistic(sides[spare], y[spare], ridge=0.1), sides))}


def test_cotraining_matches_the_same_method_in_memory(spark):
    docs, labels = read(spark, SF_SMALL, "documents"), read(spark, SF_SMALL, "labels").where("doc_id % 2 = 0")
    model = cotrain.train(docs, labels, rounds=2)
    own = {r.doc_id for r in labels.collect()}
    want = in_memory_cotraining(docs.collect(), labels.collect(), own, 2)
    got = {r.doc_id: r.score for r in cotrain.score(docs, model).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-3


def test_pseudo_labels_grow_with_the_table(spark):
    docs, labels = read(spark, SF_SMALL, "documents"), read(spark, SF_SMALL, "labels")
    more = docs.unionAll(docs.selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars"))
    one, two = cotrain.train(docs, labels, rounds=1), cotrain.train(more, labels, rounds=1)
    assert sum(one.pseudo[0].values()) > 0
    assert all(two.pseudo[0][at] >= 1.8 * n for at, n in one.pseudo[0].items())
    bounded = cotrain.train(docs, labels, labelled=120, rounds=1)  # labelled ids beyond the sample are pages like others
    assert sum(bounded.pseudo[0].values()) > sum(one.pseudo[0].values())


def test_cotraining_of_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None, "q", "s"), (1, None, None, None, None, "q", "s"), (None, "a b", "en", "s", 3, "q", "s"),
         (2, "w " * 50_000, "en", "s", 100_000, "q", "s")], WIDE)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = cotrain.train(docs, none)
    assert [r.score for r in cotrain.score(docs, model).collect()] == [1.0] * 4
    kept = cotrain.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    trained = cotrain.train(read(spark, SF_TINY, "documents"), read(spark, SF_TINY, "labels"))
    assert all(0 <= r.score <= 1 for r in cotrain.score(docs, trained).collect())
    assert cotrain.score(docs.limit(0), trained).collect() == []


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    got = toxicity.op4_toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == labels.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    hits = [r for r in held if r.predicted == 1]
    toxic = [r for r in held if r.toxic == 1]
    assert sum(r.toxic for r in hits) / len(hits) >= 0.9
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.9


def test_folding_and_exceptions():
    words = toxicity.Lexicon({"idiot": 3.0, "scu*": 2.0}, ("idiot board",), (-4.0, 2.0, 1.0, 1.0))
    matcher = words.matcher()
    spans = lambda t: [toxicity.folded(t)[a:b] for a, b, _ in words.hits(toxicity.folded(t), matcher)]
    assert spans("You 1d10t, you ІDІОТ!") == ["idiot", "idiot"]
    assert spans("idiots scum obscure") == ["scu"]
    assert spans("the idiot board and the idiot") == ["idiot"]
    assert spans("") == [] and toxicity.folded(None) == ""


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "q", "s"), (None, "", "x", "x", 0, "q", "s"), (1, "a " * 9999, "", "", 1, "q", "s")], WIDE)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.op4_toxicity(docs, none).collect()] == [0.0] * 3
    assert toxicity.op4_toxicity(docs.limit(0), none).collect() == []


ITEM_WORDS = [f"i{k}" for k in range(30)]


def brute_hits(text, items, window):
    norm = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    words, hit, found = norm(text), set(), set()
    for item, body in items:
        own = norm(body)
        n = min(window, len(own))
        for g in {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i:i + n]) == g:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(words), hit, sorted(found)


@pytest.mark.parametrize("shard", [200_000, 20])
def test_contamination_matches_brute_force(spark, shard):
    rng = random.Random(shard)
    items = [(k, " ".join(rng.choice(ITEM_WORDS) for _ in range(rng.randrange(1, 25)))) for k in range(25)]
    items += [(90, None), (91, ""), (92, "Ünï cödé-word"), (3, items[3][1]), (93, items[4][1])]
    texts = [None, "", "i1", "x " * 4000]
    for _ in range(60):
        body = rng.choice(items)[1] or ""
        texts.append(" ".join([*(rng.choice(ITEM_WORDS) for _ in range(rng.randrange(12))), body.upper().replace(" ", ", "), "end"]))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, shard_words=shard).collect()}
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, max_coverage=0.9, shard_words=shard).collect()}
    for i, text in enumerate(texts):
        n, hit, found = brute_hits(text, items, decontaminate.WINDOW)
        assert got[i].n_words == n and sorted(got[i]["items"]) == found
        assert {p for s in got[i].spans for p in range(s.start, s.end)} == hit
        assert (i in cut) == (len(hit) <= 0.9 * n)
        if i in cut and not hit:
            assert cut[i] == text
        elif i in cut:
            left = decontaminate.normal_words(cut[i].encode())
            assert len(left) == n - len(hit)


def test_a_long_item_is_spread_over_shards_and_one_is_held_at_a_time(spark, monkeypatch):
    rng = random.Random(3)
    long = [f"i{rng.randrange(400)}" for _ in range(1200)]
    items = [(1, " ".join(long)), (2, " ".join(long[100:130])), (3, "short item"), (None, " ".join(long[5:17]))]
    texts = [" ".join(["a", *long[i:i + n], "b"]) for i, n in ((0, 9), (0, 10), (7, 40), (95, 60), (600, 600), (1190, 10), (1191, 9), (0, 1200))]
    texts += [texts[4]] * 30 + ["SHORT. Item short", None, "", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    alive, most, sizes = [], [], []
    context = spark.sparkContext
    make = context.broadcast

    class Watched:
        def __init__(self, value):
            self.inner = make(value)
            alive.append(self)
            most.append(len(alive))
            sizes.append(sum(map(len, pickle.loads(value)["next"])))

        def __reduce__(self):
            return self.inner.__reduce__()

        @property
        def value(self):
            return self.inner.value

        def destroy(self):
            alive.remove(self)
            self.inner.destroy()

    monkeypatch.setattr(context, "broadcast", Watched)
    found = decontaminate.found_in(docs, bench, Workspace(spark), shard_words=40)
    monkeypatch.undo()
    assert len(most) >= 50 and max(most) == 1 and not alive
    # A shard holds at most 40 words and a piece of 20; a suffix automaton has fewer than three moves a word.
    assert max(sizes) < 3 * (40 + 20)
    assert found.count() == len({t for t in texts if t and brute_hits(t, [(i or "", b) for i, b in items], 10)[1]})
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, shard_words=300).collect()}
    whole = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert got == whole and len(got) == len(texts)
    for i, text in enumerate(texts):
        n, hit, ids = brute_hits(text, [("" if k is None else k, body) for k, body in items], decontaminate.WINDOW)
        assert (got[i].n_words, sorted(got[i]["items"])) == (n, ids)
        assert {p for s in got[i].spans for p in range(s.start, s.end)} == hit


def test_cut_documents_keep_every_column(spark):
    body = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame(
        [(1, f"keep, this: {' '.join(f'x{i}' for i in range(40))} {body}.", "r", 1, None), (2, body, "r", 1, None), (None, None, None, None, None), (4, "clean ü", "r", 2, "s")],
        "doc_id long, text string, row string, digest int, shared string")
    bench = spark.createDataFrame([(7, body)], "item_id long, text string")
    rows = decontaminate.decontaminate(docs, bench)
    assert rows.schema == docs.schema
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        (1, f"keep, this: {' '.join(f'x{i}' for i in range(40))} .", "r", 1, None), (None, None, None, None, None), (4, "clean ü", "r", 2, "s")], key=str)


def test_contamination_without_items(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.op5_decontamination(docs, none).columns[:3] == ["doc_id", "n_words", "n_hit"]
    assert decontaminate.decontaminate(docs, none).collect() == docs.collect()
    assert decontaminate.contamination(docs.limit(0), none).collect() == []


def padding(histogram, bounds):
    return sum(n * (next(b for b in bounds if b >= size) - size) for size, n in histogram.items())


def test_bounds_are_the_best(spark):
    rng = random.Random(1)
    for _ in range(30):
        histogram = {rng.randrange(1, 60): rng.randrange(1, 50) for _ in range(rng.randrange(1, 9))}
        k = rng.randrange(1, 5)
        bounds = packing.best_bounds(histogram, k)
        best = min(padding(histogram, [*c, max(histogram)]) for r in range(k) for c in itertools.combinations(sorted(histogram)[:-1], min(r, len(histogram) - 1)))
        assert len(bounds) <= k and padding(histogram, bounds) == best
    assert packing.best_bounds({}, 3) == []


def test_packing_keeps_every_token(spark):
    rng = random.Random(2)
    texts = [None, "", *(" ".join(["w"] * rng.randrange(0, 300)) for _ in range(200)), "w " * 999]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 1)], "doc_id long, text string, length int")
    rows = packing.pack(docs, max_len=100, buckets=3, token_budget=500, salt_rows=20).collect()
    assert sum(r.length for r in rows) == sum(len((t or "").split()) + 1 for t in [*texts, texts[5]])
    seats = [(r.bucket_len, r.batch, r.slot) for r in rows]
    assert len(set(seats)) == len(seats) and len({r.bucket_len for r in rows}) <= 3
    for bucket in {r.bucket_len for r in rows}:
        sizes = [sum(r.bucket_len == bucket and r.batch == b for r in rows) for b in range(max(r.batch for r in rows if r.bucket_len == bucket) + 1)]
        assert all(n == max(1, 500 // bucket) for n in sizes[:-1]) and 0 < sizes[-1] <= max(1, 500 // bucket)
        assert all(r.length <= bucket for r in rows if r.bucket_len == bucket)
    assert packing.pack(docs.limit(0)).collect() == []


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = read(spark, SF_TINY, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "packing"]
    counts = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF_TINY).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
    assert 200 >= counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert corpus_pipeline.run(spark, SF_TINY).count() == counts[4]
