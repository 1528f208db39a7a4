"""Near-duplicates, lines, phrases and components against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, line_dedup, near_dups, phrases
from tidemark.workspace import Workspace

DOCS = "doc_id long, text string, key string, node string"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "k", None) for i, t in enumerate(texts, first)], DOCS)


def groups(nodes, links):
    top = {n: n for n in nodes}
    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark, workspace):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), workspace).collect()}
    nodes = {n for p in links for n in p} - {300}
    assert got == groups(nodes, [p for p in links if p[0] != p[1]])


def test_components_of_nothing(spark, workspace):
    assert components.components(spark.createDataFrame([], "a long, b long"), workspace).collect() == []


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    base = [prose(rng, 150) for _ in range(12)]
    texts = [None, "", "   ", "one two", "One TWO", "solo"]
    for words in base:
        texts.append(" ".join(words))
        texts += [" ".join(edited(rng, words, rng.randrange(1, 9))) for _ in range(12)]
        texts += [" ".join(words).upper()] * 2
    shared = prose(rng, 60)
    texts += [" ".join(prose(rng, 30) + shared + prose(rng, 40)) for _ in range(40)]
    texts.append("again and " * 3000)
    rng.shuffle(texts)
    return texts


def brute_near(texts, k, percent):
    sets = {}
    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j:j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, groups(sets, links)


@pytest.mark.parametrize("shingle,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, corpus, shingle, percent):
    sets, want = brute_near(corpus, shingle, percent)
    got = {r.doc_id: r for r in near_dups.near_duplicates(frame(spark, corpus), shingle, percent).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A B C D")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dups.near_duplicates(rows).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dups.near_duplicates(rows.limit(0)).collect() == []
    kept = near_dups.drop_near_duplicates(rows.selectExpr("*", "'x' AS _gone"))
    assert kept.columns == ["doc_id", "text", "_gone"] and {r.doc_id for r in kept.collect()} == {None, 1}


def test_near_duplicates_of_an_id_with_other_texts(spark):
    """Only the rows whose own text is a copy go, whichever of an id's texts speaks for it."""
    rng = random.Random(11)
    one, two, three = (" ".join(prose(rng, 60)) for _ in range(3))
    rows = [(3, one), (5, one), (5, two), (6, two), (9, three), (9, three + " end"), (9, "quite another text"), (2, three + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(tuple(r) for r in near_dups.drop_near_duplicates(docs).collect())
    assert (3, one) in left and (5, one) not in left  # a copy of document 3
    assert (5, two) in left and (6, two) not in left
    assert (9, "quite another text") in left and (2, three + " end") in left and (9, three + " end") not in left


def test_threshold_misses_are_rare():
    assert near_dups.least_collisions(0.85, 48) == 26
    assert near_dups.least_collisions(1.0, 10) >= 1


def distance(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words_in(line):
    return line.strip(" \t\n\x0b\f\r").split()


def brute_lines(texts, max_edits, words_per_edit):
    """First place of the class of every non-blank line."""
    at = [(d, n, tuple(words_in(x))) for d, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if words_in(x)]
    distinct = sorted({x for _, _, x in at})
    most = lambda a, b: min(max_edits, min(len(a), len(b)) // words_per_edit)
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:]
             if most(a, b) and distance(a, b, most(a, b)) <= most(a, b)]
    top = groups(distinct, links)
    first = {}
    for d, n, x in at:
        first.setdefault(top[x], (d, n))
    return {(d, n): first[top[x]] for d, n, x in at}, len(links)


def edited_line(rng, words, edits, letters):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words) + 1)
        words[at:at + rng.randrange(2)] = [rng.choice(letters)] * rng.randrange(2)
    return words


def test_exploded_signatures_and_shingles_are_never_broadcast(spark, monkeypatch):
    """Spark sizes them like the small table that they come from."""
    plans, stage = {}, Workspace.stage

    def spied(self, df, name, **options):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stage(self, df, name, **options)

    monkeypatch.setattr(Workspace, "stage", spied)
    docs = spark.range(40).selectExpr("id AS doc_id", "concat_ws(' ', 'a b c d e f g h i j', id % 4) AS text")
    near_dups.near_duplicates(docs).collect()
    # Made of the exploded rows: the profiles, and the lists whose nodes met enough of their shingles.
    for plan in (plans["profiles"][0], plans["mixed"][1]):
        joins = [line for line in plan.splitlines() if "Join" in line and ("[key#" in line or "[shingle#" in line)]
        assert any("SortMergeJoin [key#" in line or "SortMergeJoin [shingle#" in line for line in joins), plan
        assert not any("BroadcastHashJoin [shingle#" in line for line in joins), plan


@pytest.mark.parametrize("max_edits,words_per_edit", [(1, 4), (2, 8), (2, 2), (3, 5)])
def test_lines_match_brute_force(spark, max_edits, words_per_edit):
    rng = random.Random(max_edits * 10 + words_per_edit)
    letters = ["a", "b", "cé", "d", "e"]
    base = [[rng.choice(letters) for _ in range(rng.randrange(1, words_per_edit * (max_edits + 2)))] for _ in range(40)]
    base += [[rng.choice(letters) for _ in range(90)] for _ in range(3)]  # wider than 64 words
    lines = [" ".join(w) for w in base]
    lines += [" ".join(edited_line(rng, w, rng.randrange(max_edits + 2), letters)) for w in base * 3]
    lines += ["\t" + rng.choice(lines).replace(" ", "  ") + " " for _ in range(10)]
    rng.shuffle(lines)
    texts = ["\n".join(lines[i:i + 8]) for i in range(0, len(lines), 8)] + [None, "", "\t \n  ", lines[0], "z"]
    want, links = brute_lines(texts, max_edits, words_per_edit)
    assert links > 25
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line, r.kept)
           for r in line_dedup.duplicate_lines(frame(spark, texts), max_edits, words_per_edit).collect()}
    assert got == {at: (*first, first == at) for at, first in want.items()}
    kept = {r.doc_id: r.text for r in line_dedup.drop_duplicate_lines(frame(spark, texts), max_edits, words_per_edit).collect()}
    for d, text in enumerate(texts):
        left = "\n".join(x for n, x in enumerate((text or "").split("\n")) if not words_in(x) or got[d, n][2])
        if left.strip() or not (text or "").strip():
            assert (kept[d] or "") == left
        else:
            assert d not in kept


def test_short_lines_are_equal_or_apart(spark):
    texts = ["And.", "Les.", "Ist.\nOf.", "And.", "a b c d e f g", "a b c d e f h"]
    got = {(r.doc_id, r.line_no): r.kept for r in line_dedup.duplicate_lines(frame(spark, texts)).collect()}
    assert [at for at, kept in got.items() if not kept] == [(3, 0)]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_banded_word_distance(spark, k):
    rng = random.Random(k)
    rows = []
    for _ in range(250):
        a = [rng.choice("abc") for _ in range(rng.randrange(k, 30))]
        rows.append((a, edited_line(rng, a, rng.randrange(k + 3), "abc")))
    rows += [(["x"] * 200, ["x"] * (200 + k)), (["x", "y"] * 100, ["y", "x"] * 100), ([], ["x"]), (["x"], [])]
    frame_of = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in frame_of.select("a", "b", line_dedup.word_edits(F.col("a"), F.col("b"), k).alias("d")).collect():
        want = distance(r.a, r.b, 300)
        assert r.d == want if want <= k and len(r.a) >= k and r.b else r.d > k


def test_lines_with_one_hot_list(spark):
    """Many different lines under one key, and one line in a third of all documents."""
    head = " ".join(f"w{i}" for i in range(12))
    texts = [f"{head} " + " ".join(f"t{d}x{i}" for i in range(8)) for d in range(150)] + ["the very same line"] * 80
    texts += [texts[3].replace("t3x2", "other"), texts[9] + " more"]
    want, links = brute_lines(texts, 2, 8)
    got = {(r.doc_id, r.line_no): (r.class_doc, r.class_line) for r in line_dedup.duplicate_lines(frame(spark, texts)).collect()}
    assert got == want and links == 2


def test_lines_use_no_python(spark):
    plan = line_dedup.op6_line_dedup(frame(spark, ["a b c", "a b c"]))._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_lines_of_odd_rows(spark):
    line = "the same long line of words again"
    rows = spark.createDataFrame([(None, line), (3, line + "\nother words in another long line"), (3, line)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.line_no, r.kept) for r in line_dedup.duplicate_lines(rows).collect())
    assert got == [(-1, 0, True), (3, 0, False), (3, 0, False), (3, 1, True)]
    assert line_dedup.duplicate_lines(rows.limit(0)).collect() == []
    assert line_dedup.drop_duplicate_lines(rows.limit(0)).collect() == []
    twice = spark.createDataFrame([(None, line), (None, line)], "doc_id long, text string")  # one occurrence, as the docstring says
    assert [r.kept for r in line_dedup.duplicate_lines(twice).collect()] == [True, True]
    clash = spark.createDataFrame([(1, line, "a", 0), (2, line + "\nx y", "b", 1)], "doc_id long, text string, _gone string, row long")
    assert [tuple(r) for r in line_dedup.drop_duplicate_lines(clash).orderBy("doc_id").collect()] == [(1, line, "a", 0), (2, "x y", "b", 1)]
    with pytest.raises(ValueError):
        line_dedup.duplicate_lines(rows, 1, 1)


def brute_repeats(texts, window):
    starts = defaultdict(list)
    words = [(t or "").encode().split() for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            starts[tuple(w[i:i + window])].append((d, i))
    gone = defaultdict(set)
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + window))
    return [(len(w), len(gone[d]), b" ".join(x for i, x in enumerate(w) if i not in gone[d])) for d, w in enumerate(words)]


@pytest.mark.parametrize("window,shard", [(35, 40_000), (12, 50)])
def test_phrases_match_brute_force(spark, corpus, window, shard):
    rng = random.Random(3)
    passage = prose(rng, 70)
    texts = [*corpus, *(" ".join(prose(rng, 5) + passage[rng.randrange(30):40 + rng.randrange(30)] + prose(rng, 9)) for _ in range(25)),
             " ".join(passage + passage), "x y " * 200, "tail " * window, "tail " * (window - 1)]
    want = brute_repeats(texts, window)
    got = {r.doc_id: r for r in phrases.repeats(frame(spark, texts), window=window, anchor=8, shard_windows=shard).collect()}
    for d, (n, removed, kept) in enumerate(want):
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (n, removed, hashlib.sha256(kept).hexdigest()), d
    out = {r.doc_id: r.text for r in phrases.remove_repeats(frame(spark, texts), window).collect()}
    for d, (_, removed, kept) in enumerate(want):
        assert out[d] == (kept.decode() if removed else texts[d])


def test_phrase_shards_bound_the_texts_of_a_task(spark, monkeypatch):
    rng = random.Random(5)
    run, passage = prose(rng, 30), prose(rng, 50)
    texts = [" ".join(prose(rng, 40) + run + prose(rng, 40)) for _ in range(60)]
    texts += [" ".join(prose(rng, 20) + passage + prose(rng, 20)) for _ in range(4)]
    sizes, located = [], phrases.located

    def spy(routed, found, window):
        sizes.extend(r["count"] for r in routed.groupBy("shard").count().collect())
        return located(routed, found, window)

    monkeypatch.setattr(phrases, "located", spy)
    got = {r.doc_id: r for r in phrases.repeats(frame(spark, texts), shard_load=1000).collect()}
    assert sum(sizes) >= 60 and max(sizes) <= 20  # far under 40,000 windows recur, which was one shard
    for d, (n, removed, kept) in enumerate(brute_repeats(texts, 35)):
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (n, removed, hashlib.sha256(kept).hexdigest())


def test_a_window_in_every_text_is_one_row_a_slot(spark):
    held = spark.range(3000).selectExpr("id AS part", "explode(array(7L, 1000L + id)) AS fp", "cast(id % 9 AS int) AS place", "id = 5 AS many")
    got = phrases.recurring_windows(held, 4)
    rows = got.collect()
    assert sorted((r.fp, r.slot) for r in rows) == [(7, 0), (7, 1), (7, 2), (7, 3), (1005, rows_slot(spark, 5))]
    assert all(r.place == r.part % 9 for r in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.rindex("partial_sum")  # combined below the first exchange


def rows_slot(spark, part):
    return spark.range(1).select(F.pmod(F.xxhash64(F.lit(part).cast("long")), F.lit(4))).first()[0]


def test_phrases_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(None, text), (7, text + " end"), (7, "other"), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in phrases.repeats(rows).collect())
    assert got == [(-1, 40, 40), (7, 1, 0), (7, 41, 40), (8, 0, 0)]
    assert phrases.repeats(rows.limit(0)).collect() == []


def test_workspace_is_used(spark):
    assert Workspace(spark).root.startswith(spark.conf.get("spark.checkpoint.dir"))
