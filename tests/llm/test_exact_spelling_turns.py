"""Exact duplicates, conversation repair and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest

from tidemark.llm import exact_dedup, spelling, turn_repair
from tidemark.llm.queries import table
from tidemark.workspace import Workspace

TINY = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, digest string, keep_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS)


def duplicates(spark, rows, **options):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs(spark, rows), **options).collect()),
                  key=str)


def test_exact_levels_tell_texts_apart(spark):
    same_start = "p" * 100
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, same_start + "x"), (5, same_start + "y"), (6, same_start + "x"), (7, None), (8, ""), (9, "é")]
    assert duplicates(spark, rows) == sorted([
        (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 6, 2, False), (5, 5, 1, True), (6, 6, 2, True), (7, 8, 2, False),
        (8, 8, 2, True), (9, 9, 1, True)], key=str)
    full = {r.doc_id: r.digest for r in exact_dedup.exact_duplicates(docs(spark, rows)).collect()}
    # Only texts that some other could still equal are hashed as a whole.
    assert {i for i, d in full.items() if d is None} == {3, 9}
    assert bytes(full[5]) == hashlib.sha256((same_start + "y").encode()).digest()


def test_exact_repeated_rows_null_ids_and_long_texts(spark):
    rows = [(5, "t"), (5, "t"), (None, "t"), (None, "u"), (None, "u"), (1, "z " * 500_000), (2, "z " * 500_000)]
    assert duplicates(spark, rows) == sorted([
        (5, 5, 3, True), (5, 5, 3, False), (None, 5, 3, False), (None, None, 2, True), (None, None, 2, False),
        (1, 2, 2, False), (2, 2, 2, True)], key=str)
    kept = exact_dedup.drop_exact_duplicates(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "digest", "keep_id"]
    assert sorted(((r.doc_id, r.text[:1]) for r in kept.collect()), key=str) == sorted([(5, "t"), (None, "u"), (2, "z")], key=str)
    assert exact_dedup.exact_duplicates(docs(spark, [])).collect() == []
    assert exact_dedup.drop_exact_duplicates(docs(spark, [])).collect() == []


def test_exact_normalised_texts_and_a_hot_group(spark):
    from pyspark.sql import functions as F

    assert duplicates(spark, [(1, "A"), (2, "a")], normal=F.lower) == [(1, 2, 2, False), (2, 2, 2, True)]
    rows = [(i, "same") for i in range(3000)] + [(i, f"own {i}") for i in range(3000, 4000)]
    found = duplicates(spark, rows)
    assert Counter(n for _, _, n, _ in found) == {3000: 3000, 1: 1000}
    assert [i for i, _, n, kept in found if n > 1 and kept] == [2999]


def test_exact_uses_no_python_and_shuffles_no_text(spark):
    frame = exact_dedup.op11_exact_dedup(table(spark, TINY, "documents"))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    rows = exact_dedup.refined(table(spark, TINY, "documents"), exact_dedup.unchanged, Workspace(spark))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


# Conversation repair

NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def fits(roles):
    if not roles:
        return True
    body = roles[1:] if roles[0] == "s" else roles
    return len(body) >= 2 and len(body) % 2 == 0 and body == "ua" * (len(body) // 2)


def brute_repair(rows):
    """All suffixes, spelled out: (cost, audit, lines) of the best edits of a conversation's rows."""
    texts, marked = set(), []
    for role, text in rows:
        words = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not words else "duplicate" if (role, text) in texts else "truncated" if words[-1] not in ".!?" else ""
        marked.append((role, text, fault))
        texts.add((role, text))

    memo = {}

    def best(i, state, inserts):
        if (i, state, inserts) in memo:
            return memo[i, state, inserts]
        found = []
        if i == len(marked):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = marked[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 3, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] and role[:1] in NEXT[state]:
                    c, a, t = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *t)))
                for new in ("user", "assistant"):
                    if new[0] in NEXT[state]:
                        c, a, t = best(i + 1, new[0], 0)
                        found.append((c + 2 + more, "R" + a, (f"{new}:{text}", *t)))
        if inserts < 4:
            for new in ("user", "assistant"):
                if new[0] in NEXT[state]:
                    c, a, t = best(i, new[0], inserts + 1)
                    found.append((c + 2, "I" + a, (f"{new}:", *t)))
        memo[i, state, inserts] = min(found) if found else (10 ** 9, "", ())
        return memo[i, state, inserts]

    return best(0, "", 0), marked


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", "", "u"]), rng.choice(["A.", "b", "c!", "", " \n", "d?", "e e", "F."]))
            for _ in range(n)]


def codes_of(marked):
    out = ""
    for role, _, fault in marked:
        letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
        out += dict(zip("suao", "1234"))[letter] if fault in ("blank", "duplicate") else letter.upper() if fault == "truncated" else letter
    return out


def test_repair_paths_match_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        (cost, audit, _), marked = brute_repair(random_rows(rng, rng.randrange(0, 14)))
        moves, got = turn_repair.solved(codes_of(marked), turn_repair.START, None)
        assert (got, moves.translate(turn_repair.AUDIT)) == (cost, audit)


def test_repair_of_segments_is_that_of_the_whole():
    rng = random.Random(6)
    for _ in range(300):
        _, marked = brute_repair(random_rows(rng, rng.randrange(3, 30)))
        codes = codes_of(marked)
        cuts = [0, *sorted(rng.sample(range(1, len(codes)), min(3, len(codes) - 1))), len(codes)]
        parts = [codes[a:b] for a, b in zip(cuts, cuts[1:])]
        blocks = [turn_repair.summed([turn_repair.block_of(c) for c in p]) for p in parts]
        states = turn_repair.crossings(blocks, turn_repair.START, turn_repair.last_state(blocks))
        ends = [*states[1:-1], None]
        moves = "".join(turn_repair.solved(p, s, e)[0] for p, s, e in zip(parts, states, ends))
        assert moves == turn_repair.solved(codes, turn_repair.START, None)[0]


def test_repaired_roles_always_fit():
    for codes in map("".join, product("suaoSUAO14", repeat=4)):
        moves, _ = turn_repair.solved(codes, turn_repair.START, None)
        roles, at = "", 0
        for m in moves:
            if m in "ij":
                roles += "u" if m == "i" else "a"
                continue
            roles += {"K": turn_repair.role_of(codes[at]), "R": "u", "r": "a", "D": ""}[m]
            at += 1
        assert fits(roles) and at == len(codes)


TURNS = "conv_id long, turn long, role string, text string, codes string, start long"


def conversation_rows():
    rng = random.Random(8)
    rows = []
    for conv in range(40):
        rows += [(conv, t, *row) for t, row in enumerate(random_rows(rng, rng.randrange(1, 12)))]
    rows += [(100, t, *row) for t, row in enumerate(random_rows(rng, 3000))]  # one hot conversation
    rows += [(None, 1, "user", "hi."), (None, None, None, None), (101, None, "user", None), (102, 5, "system", "z. " * 100_000)]
    rows += [(103, 3, "user", "same?")] * 4
    return rows


def brute_report(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role if role is not None else " ", hashlib.md5((" " if text is None else text).encode()).hexdigest(),
                         " " if text is None else text))
    out = {}
    for conv, own in by.items():
        own.sort()
        (cost, audit, lines), marked = brute_repair([(o[2], o[4]) for o in own])
        turns = [o[1] for o in own if o[0]]
        faults = Counter(m[2] for m in marked)
        roles = [m[0][:1] for m in marked]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_repair_report_matches_brute_force(spark, parts):
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(50_000)
    rows = conversation_rows()
    want = brute_report(rows)
    sys.setrecursionlimit(old)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS)
    if parts > 1:  # the hot conversation then spans range partitions
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r[0]: tuple(r)[1:] for r in turn_repair.repair_report(frame).collect()}
        if parts > 1:
            edits = turn_repair.repair(frame)[1].collect()
            assert len([e for e in edits if e.conv_id == 100]) > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_repair_of_nothing_and_of_lost_conversations(spark):
    empty = spark.createDataFrame([], TURNS)
    assert turn_repair.repair_report(empty).collect() == []
    ids = spark.createDataFrame([(7, 0, "user", "x", "", 0)], TURNS)
    assert [tuple(r) for r in turn_repair.repair_report(empty, ids).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_damage_by_checksum(spark):
    rows = [(c, t, "assistant", "a.b!") for c in range(30) for t in range(10)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = Counter()
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{c}:{t}".encode()) % 20
        if fault:
            want[c, t, "user" if fault == 4 else role, {1: "", 2: "ab"}.get(fault, text)] += 2 if fault == 3 else 1
    assert Counter(tuple(r) for r in turn_repair.damaged(frame).collect()) == want


# Spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(counts, least=5, ratio=5):
    words = {w: n for w, n in counts.items() if n >= least}
    form, rows = {}, {}
    for w, n in words.items():
        others = sorted((-words[o], o) for o in words if near(w, o))
        if others and -others[0][0] >= ratio * n:
            form[w] = others[0][1]
        rows[w] = (n, len(others))
    def root(w):
        while w in form:
            w = form[w]
        return w
    return {w: (form.get(w), root(w), n, m, words[form[w]] if w in form else None) for w, (n, m) in rows.items()}


def letters(rng, n):
    return "".join(rng.choice("abcé") for _ in range(n))


@pytest.mark.parametrize("cell", [40_000, 25])
def test_variants_match_brute_force(spark, cell):
    rng = random.Random(11)
    counts = {}
    for _ in range(300):
        word = letters(rng, rng.randrange(6, 10))
        counts[word] = rng.choice([3, 5, 6, 30, 200, 1000])
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(word))
            other = rng.choice([word[:i] + word[i + 1:], word[:i] + "b" + word[i:], word[:i] + "ÿ" + word[i + 1:]])
            counts[other] = rng.choice([5, 7, 40])
    counts |= {"aaaaaaab": 9, "aaaaaaba": 9, "aaaaaaaab": 50, "b" * 300: 6, "b" * 299: 600}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: tuple(r)[1:] for r in spelling.spelling_variants(frame, cell=cell, sample=200).collect()}
    assert got == {w: r for w, r in brute_variants(counts).items()}


def test_variant_chains_follow_to_the_last(spark):
    counts = {"a" * (6 + k): 5 * 5 ** k for k in range(7)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: r.root for r in spelling.spelling_variants(frame).collect()}
    assert set(got.values()) == {"a" * 12}


def test_words_are_counted_over_odd_rows(spark):
    rows = [(1, "Zebras zebras, ZEBRAS! Éclairs x"), (1, "zebras"), (None, None), (None, "éclairs"), (2, ""), (3, "k" * 100_000)]
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    got = {r.word: r.n for r in spelling.word_counts(frame).collect()}
    assert got == {"zebras": 4, "Éclairs": 1, "éclairs": 1, "k" * 100_000: 1}
    assert spelling.op13_spelling_variants(frame.limit(0)).collect() == []


def test_planted_deletions(spark):
    texts = [(i, " ".join(f"word{chr(97 + i % 26)}{chr(97 + j % 26)}ing" for j in range(40))) for i in range(60)]
    want = Counter()
    for i, text in texts:
        for run, n in Counter(text.split()).items():
            h = zlib.crc32(f"{i}:{run}".encode())
            want[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += n
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(frame, spelling.planted).collect()} == dict(want)


def test_tree_search_is_exhaustive():
    rng = random.Random(3)
    points, asked = sorted({letters(rng, 8) for _ in range(900)}), sorted({letters(rng, 7) for _ in range(200)})
    bits, questions = spelling.bits_of(spelling.letters_of(points)), spelling.bits_of(spelling.letters_of(asked))
    found = {(asked[i], points[j]) for a, b in spelling.Tree(bits, 16).search(questions, 1, 0) for i, j in zip(a, b)}
    assert all(n == 1 for n in Counter((i, j) for a, b in spelling.Tree(bits, 16).search(questions, 1, 0) for i, j in zip(a, b)).values())
    want = {(a, p) for a in asked for p in points if all(min(p.count(c), 3) >= min(a.count(c), 3) for c in "abcé")
            and sum(min(p.count(c), 3) - min(a.count(c), 3) for c in "abcé") <= 1}
    assert found == want
