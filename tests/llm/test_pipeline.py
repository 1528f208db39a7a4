"""The pipeline's stages, each against a brute-force version of it on its own input."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import pytest

from tests.conftest import SF_TINY
from tests.llm.test_dedup import brute_near, distance, groups, words_in
from tests.llm.test_models_and_packing import brute_hits, padding
from tidemark.llm import cotrain, decontaminate, line_dedup, packing

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)


def by_id(rows):
    return sorted((r.doc_id, r.text) for r in rows)


def write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, DOCUMENT).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """The smallest documents, with planted edited lines, near copies and benchmark passages."""
    rng = random.Random(5)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_TINY}/documents.parquet").orderBy("doc_id").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF_TINY}/labels.parquet").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_TINY}/benchmark.parquet").collect()]
    last = docs[-1][0]
    for i, (_, text, lang, source, n) in enumerate(rng.sample([d for d in docs if d[1] and len(d[1].split()) > 60], 30)):
        words = text.split(" ")
        if i % 3 == 0:
            words[rng.randrange(len(words))] = "replacedword"
        elif i % 3 == 1:
            words[10:10] = rng.choice(items)[1].split(" ")
        else:
            words = [w if "\n" in w or rng.random() > 0.01 else "other" for w in words]
        docs.append((last + 1 + i, " ".join(words), lang, source, n))
    return write(spark, tmp_path_factory.mktemp("corpus"), docs, labels, items)


def brute_line_stage(texts):
    """Kept texts by place, with the text's lines that equal or nearly equal an earlier one gone."""
    at = {(d, n): tuple(words_in(x)) for d, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if words_in(x)}
    distinct = sorted(set(at.values()), key=len)
    links = []
    for i, a in enumerate(distinct):
        most = min(2, len(a) // 8)
        for b in distinct[i + 1:] if most else ():
            if len(b) > len(a) + most:
                break
            if len(set(a) ^ set(b)) <= 2 * most and distance(a, b, most) <= most:
                links.append((a, b))
    top = groups(distinct, links)
    first, kept = {}, {}
    for place in sorted(at):
        first.setdefault(top[at[place]], place)
    for d, text in enumerate(texts):
        left = [x for n, x in enumerate((text or "").split("\n")) if (d, n) not in at or first[top[at[d, n]]] == (d, n)]
        if any(words_in(x) for x in left) or not words_in(text or ""):
            kept[d] = "\n".join(left)
    return kept, links


def test_stages_match_brute_force(spark, corpus, tmp_path):
    def through(name, docs):
        STAGE[name](spark, docs, corpus).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    good = through("quality classifier", docs)
    model = cotrain.train(docs, spark.read.parquet(f"{corpus}/labels.parquet"))
    kept = {r.doc_id for r in cotrain.score(docs, model).collect() if r.score >= cotrain.KEEP_FROM}
    assert by_id(good.collect()) == by_id([r for r in docs.collect() if r.doc_id in kept])

    rows = by_id(good.collect())
    want, links = brute_line_stage([t for _, t in rows])
    lines = through("line dedup", good)
    assert links and by_id(lines.collect()) == [(rows[d][0], t) for d, t in sorted(want.items())]

    rows = by_id(lines.collect())
    _, component = brute_near([t for _, t in rows], 5, 80)
    near = through("MinHash near-dedup", lines)
    assert by_id(near.collect()) == [r for i, r in enumerate(rows) if component[i] == i]

    items = [tuple(r) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    rows, clean = by_id(near.collect()), through("benchmark decontamination", near)
    got, hits = dict(by_id(clean.collect())), 0
    for doc, text in rows:
        n, hit, _ = brute_hits(text, items, decontaminate.WINDOW)
        assert (doc in got) == (len(hit) <= 0.5 * n)
        if doc in got and hit:
            hits += 1
            words = decontaminate.normal_words((text or "").encode())
            assert decontaminate.normal_words(got[doc].encode()) == [w for p, w in enumerate(words) if p not in hit]
        elif doc in got:
            assert got[doc] == text
    assert hits

    packed = STAGE["packing"](spark, clean, corpus).collect()
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for d, t in got.items()}
    pieces = sorted((d, s, min(packing.MAX_LEN, n - s)) for d, n in sizes.items() for s in range(0, n, packing.MAX_LEN))
    assert sorted((r.doc_id, r.start, r.length) for r in packed) == pieces
    histogram = {}
    for _, _, n in pieces:
        histogram[n] = histogram.get(n, 0) + 1
    assert sum(r.bucket_len - r.length for r in packed) == padding(histogram, packing.best_bounds(histogram, packing.BUCKETS))
    seats = {(r.bucket_len, r.batch, r.slot) for r in packed}
    assert len(seats) == len(packed) and all((r.slot + 1) * r.bucket_len <= max(packing.TOKEN_BUDGET, r.bucket_len) for r in packed)
    assert sorted(map(tuple, corpus_pipeline.run(spark, corpus).select("doc_id", "start", "length").collect())) == pieces


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_pipeline_with_an_empty_table(spark, tmp_path, empty):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    docs = [(i, text.replace("w", f"v{i}"), "en", "a", len(text)) for i in range(12)] + [(50, None, None, None, None), (51, "", "en", "", 0)]
    labels = [(i, i % 2, 0) for i in range(12)]
    items = [(1, " ".join(f"v3{0}x{j}" for j in range(12)))]
    tables = {"documents": docs, "labels": labels, "benchmark": items} | {empty: []}
    folder = write(spark, tmp_path, tables["documents"], tables["labels"], tables["benchmark"])
    rows = corpus_pipeline.run(spark, folder).collect()
    assert (rows == []) if empty == "documents" else {r.doc_id for r in rows} <= {*range(12), 50, 51}


def test_line_rule_of_the_stage():
    assert (line_dedup.MAX_EDITS, line_dedup.WORDS_PER_EDIT) == (2, 8)
