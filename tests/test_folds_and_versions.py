"""Fold statistics from slice states, composable early stopping, versioned tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import fold_states, history, prep
from tidemark.operators.policy import FeatureSpec
from tidemark.operators.temporal import Fold
from tidemark.sources.versions import VersionedTable

SPEC = FeatureSpec(("a", "b", "never"), ("kind", "late"))


def dated(spark, n=600):
    rng = random.Random(4)
    start = datetime(2020, 1, 1)
    rows = [(i, start + timedelta(hours=rng.randrange(5000)), rng.choice([None, rng.gauss(1e6, 3.0), float("nan")]), float(rng.randrange(5)), None,
             rng.choice(["x", "y", "z", None]), rng.choice(["p", "q"])) for i in range(n)]
    rows = [(*r[:6], r[6] if r[1] > start + timedelta(hours=2000) else None) for r in rows] + [(n, None, 5.0, 5.0, 5.0, "w", "w")]
    return spark.createDataFrame(rows, "row_id long, history_date timestamp_ntz, a double, b double, never double, kind string, late string")


def folds_of(n):
    edge = [datetime(2020, 1, 1) + timedelta(hours=5000 * i // (n + 1)) for i in range(n + 2)]
    return [Fold(i, edge[i], edge[i + 1]) for i in range(1, n + 1)]


@pytest.mark.parametrize("n", [1, 4, 9])
def test_fold_statistics_equal_fitting_fold_by_fold(spark, n):
    df = dated(spark)
    for fold, found in zip(folds_of(n), fold_states.fold_statistics(df, folds_of(n), SPEC), strict=True):
        train = df.where(fold.train_rows())
        want = prep.fit_preprocessor(train, SPEC)
        assert found.medians == want.medians and found.modes == want.modes and found.categories == want.categories
        assert found.scaler.keys() == want.scaler.keys()
        for c, (mean, scale) in want.scaler.items():
            assert found.scaler[c] == (pytest.approx(mean, rel=1e-12), pytest.approx(scale, rel=1e-6))


def test_fold_statistics_scan_once_for_all_folds(spark, monkeypatch):
    seen = []
    real = fold_states.exact_medians
    monkeypatch.setattr(fold_states, "exact_medians", lambda df, columns, **o: seen.append(len(columns)) or real(df, columns, **o))
    fold_states.fold_statistics(dated(spark, 80), folds_of(6), SPEC)
    assert seen == [18]


def test_fold_statistics_refuse_wide_categories(spark):
    with pytest.raises(ValueError, match="kind"):
        fold_states.fold_statistics(dated(spark, 80), folds_of(2), SPEC, max_categories=2)


def test_slice_states_merge_in_any_grouping():
    rng = random.Random(2)
    values = [rng.gauss(50, 4) for _ in range(90)]
    parts = [fold_states.Moments(1, v, 0.0) for v in values]
    left = fold_states.Moments()
    for p in parts:
        left = left.merge(p)
    halves = [fold_states.Moments(), fold_states.Moments()]
    for i, p in enumerate(parts):
        halves[i % 2] = halves[i % 2].merge(p)
    both = halves[0].merge(halves[1])
    assert (both.n, both.mean, both.squares) == (left.n, pytest.approx(left.mean), pytest.approx(left.squares))


def folded(rows, patience, tol):
    best_epoch, best = 0, float("inf")
    for epoch, value in sorted(rows):
        if value is None or value != value:
            continue
        if epoch > best_epoch + patience:
            break
        if value < best - tol:
            best_epoch, best = epoch, value
    return best_epoch, best


@pytest.mark.parametrize("chunk,fan_in", [(1, 2), (3, 2), (7, 3), (50, 256), (1000, 2)])
def test_early_stop_is_the_same_at_all_chunk_sizes(spark, chunk, fan_in):
    rng = random.Random(9)
    runs = {
        "slow": [(e, 1.0 - e * 1e-7) for e in range(1, 200)],
        "steady": [(e, 100.0 - e) for e in range(1, 200)],
        "stuck": [(e, 5.0) for e in range(1, 60)],
        "late": [(e, None if e < 30 else 1.0) for e in range(1, 60)],
        "gap": [(e, 50.0 - e) for e in [*range(1, 20), *range(40, 80)]],
        "empty": [(e, None) for e in range(1, 9)],
    }
    for i in range(12):
        value, own = 10.0, []
        for e in range(1, rng.randrange(20, 220)):
            value -= rng.choice([0, 0, 4e-7, 9e-7, 1e-6, 2e-6])
            own.append((e, value + rng.choice([0, 0, 5e-7, 1.0])))
        runs[f"r{i}"] = own
    frame = spark.createDataFrame([(r, e, v) for r, own in runs.items() for e, v in own], "run_id string, epoch int, val_rmse double")
    for patience in (3, 10):
        got = {r.run_id: (r.best_epoch, r.best_value) for r in history.early_stop(frame, patience, 1e-6, chunk=chunk, fan_in=fan_in).collect()}
        want = {r: folded(own, patience, 1e-6) for r, own in runs.items()}
        want["empty"] = (None, None)
        assert got == want


def test_no_task_sorts_a_whole_run(spark):
    minima = [{"epoch": e, "value": -float(e)} for e in range(100, 5000)]
    assert len(history._summary(minima, 10, 1e-6)) == 10
    parts = [history._summary(minima[i:i + 100], 10, 1e-6) for i in range(0, len(minima), 100)]
    assert history._composed(parts, 10, 1e-6) == history._summary(minima, 10, 1e-6)


SCORES = "model string, test_rmse double"


def test_versions_replace_what_they_read(spark, workspace):
    stored = VersionedTable(spark, workspace.path("board"))
    assert stored.read() is None and stored.current() == 0
    assert stored.upsert(spark.createDataFrame([("a", 1.0), ("b", 2.0)], SCORES)) == 1
    assert stored.upsert(spark.createDataFrame([("b", 3.0), ("c", 4.0)], SCORES)) == 2
    assert stored.upsert(spark.createDataFrame([("a", 5.0)], SCORES)) == 3
    assert sorted(map(tuple, stored.read().collect())) == [("a", 5.0), ("b", 3.0), ("c", 4.0)]
    assert sorted(map(tuple, stored.read(1).collect())) == [("a", 1.0), ("b", 2.0)]


def test_failed_publish_leaves_the_old_version(spark, workspace, monkeypatch):
    stored = VersionedTable(spark, workspace.path("kept"))
    stored.publish(spark.createDataFrame([("a", 1.0)], SCORES))

    def lost(*_):
        raise OSError("driver lost between write and pointer")

    monkeypatch.setattr(stored, "_point", lost)
    with pytest.raises(OSError):
        stored.upsert(spark.createDataFrame([("a", 9.0)], SCORES))
    reader = VersionedTable(spark, stored.path)
    assert [tuple(r) for r in reader.read().collect()] == [("a", 1.0)]
    assert reader.upsert(spark.createDataFrame([("a", 2.0)], SCORES)) == 2


def test_second_writer_of_a_version_is_refused(spark, workspace):
    from pyspark.errors import AnalysisException

    stored = VersionedTable(spark, workspace.path("raced"))
    rows = spark.createDataFrame([("a", 1.0)], SCORES)
    stored.publish(rows, after=0)
    with pytest.raises(AnalysisException):
        stored.publish(rows, after=0)
    assert stored.current() == 1
