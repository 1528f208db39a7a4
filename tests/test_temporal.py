from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import temporal as t


@pytest.fixture(scope="module")
def span(spark):
    """The documented date range, with rows on both sides of every cut."""
    days = [datetime(1995, 1, 2), datetime(2015, 10, 26), datetime(2015, 10, 27), datetime(2018, 10, 16),
            datetime(2018, 10, 17), datetime(2024, 9, 27)]
    return spark.createDataFrame(list(enumerate(days)), "row_id int, history_date timestamp_ntz")


def test_documented_cuts(span):
    split, bounds = t.calendar_split(span)
    assert bounds.cut_train_end == datetime(2015, 10, 26, 16, 48)
    assert bounds.cut_val_end == datetime(2018, 10, 16, 19, 12)
    assert [r.split for r in split.orderBy("row_id").collect()] == ["train", "train", "val", "val", "test", "test"]
    t.assert_temporal_purity(split)


def test_documented_folds(span):
    folds = t.walk_forward_folds(span)
    starts = ["2000-12-13", "2006-11-24", "2012-11-04", "2018-10-16"]
    ends = [*starts[1:], "2024-09-27"]
    assert [f.label for f in folds] == [f"fold_{i}_{a}_{b}" for i, (a, b) in enumerate(zip(starts, ends), 1)]


def test_splits_partition_the_rows(sales):
    split, bounds = t.calendar_split(sales)
    assert split.where("split IS NULL").isEmpty()
    parts = [sales.where(bounds.rows_of(s)) for s in t.SPLITS]
    assert sum(p.count() for p in parts) == sales.count()
    for s, p in zip(t.SPLITS, parts):
        assert p.count() == split.where(F.col("split") == s).count()
    row = t.split_ranges(split).first()
    assert row.pure and row.train_max <= row.val_min and row.val_max <= row.test_min


def test_errors(spark, span):
    with pytest.raises(ValueError, match="sum to 1"):
        t.fit_calendar_split(span, fractions=(0.5, 0.1, 0.1))
    with pytest.raises(ValueError, match="zero time span"):
        t.fit_calendar_split(span.limit(1))
    lonely = t.assign_split(span.where("row_id IN (0, 5)"), t.fit_calendar_split(span))
    with pytest.raises(ValueError, match="empty split: val"):
        t.assert_temporal_purity(lonely)
    mixed = span.withColumn("split", F.when(F.col("row_id") == 0, "test").when(F.col("row_id") == 1, "val").otherwise("train"))
    with pytest.raises(ValueError, match="purity"):
        t.assert_temporal_purity(mixed)


def test_folds_expand_and_last_instant_is_in_no_validation(sales):
    folds = t.walk_forward_folds(sales)
    members = t.fold_members(sales.select("row_id", "history_date"), folds)
    counts = {(r.fold, r.role): r["count"] for r in members.groupBy("fold", "role").count().collect()}
    trains = [counts[f.fold, "train"] for f in folds]
    assert trains == sorted(trains)
    for f in folds[:-1]:
        assert counts[f.fold + 1, "train"] == counts[f.fold, "train"] + counts[f.fold, "val"]
    last = sales.agg(F.max("history_date")).first()[0]
    at_end = sales.where(F.col("history_date") == F.lit(last).cast("timestamp_ntz")).count()
    assert counts[4, "train"] + counts[4, "val"] == sales.count() - at_end
    support = {r.fold: (r.train_rows, r.val_rows) for r in t.fold_support(sales, folds, min_rows=1).collect()}
    assert support == {f.fold: (counts[f.fold, "train"], counts[f.fold, "val"]) for f in folds}
    assert t.fold_support(sales, folds, min_rows=10**9).isEmpty()


def test_split_filter_reaches_the_scan(sales):
    bounds = t.fit_calendar_split(sales)
    plan = sales.where(bounds.rows_of("val")).select("history_price")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThan(history_date" in pushed and "LessThanOrEqual(history_dat" in pushed
    assert "ReadSchema: struct<history_date:timestamp_ntz,history_price:double>" in plan


def test_fold_members_need_no_join(sales):
    plan = t.fold_members(sales, t.walk_forward_folds(sales))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


@pytest.mark.parametrize("n", [1, 4, 400])
def test_fold_members_equal_the_filters_of_each_fold(spark, n):
    edge = [datetime(2000, 1, 1) + timedelta(days=3 * i) for i in range(n + 2)]
    folds = [t.Fold(i, edge[i], edge[i + 1]) for i in range(1, n + 1) if i % 7 != 3]
    days = [None, edge[0], edge[1], edge[-1], datetime(1990, 1, 1), datetime(2030, 1, 1), *edge[2:30], *(e + timedelta(hours=5) for e in edge[-12:])]
    rows = spark.createDataFrame(list(enumerate(days)), "row_id int, history_date timestamp_ntz")
    got = sorted((r.row_id, r.fold, r.role) for r in t.fold_members(rows, folds[::-1]).collect())
    want = [(i, f.fold, role) for i, d in enumerate(days) if d for f in folds
            for role, inside in (("train", d < f.val_start), ("val", f.val_start <= d < f.val_end)) if inside]
    assert got == sorted(want) and t.fold_members(rows, folds).schema["role"].dataType.simpleString() == "string"


def test_fold_members_plan_does_not_grow(spark):
    rows = spark.createDataFrame([(1, datetime(2000, 1, 9))], "row_id int, history_date timestamp_ntz")

    def cases(n):
        edge = [datetime(2000, 1, 1) + timedelta(days=i) for i in range(n + 2)]
        made = t.fold_members(rows, [t.Fold(i, edge[i], edge[i + 1]) for i in range(1, n + 1)])
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("CASE WHEN"), plan.count("get(")

    assert cases(4) == cases(400) != (0, 0)


def test_fold_members_of_overlapping_folds(spark):
    rows = spark.createDataFrame([(1, datetime(2000, 1, 9))], "row_id int, history_date timestamp_ntz")
    with pytest.raises(ValueError, match="overlap"):
        t.fold_members(rows, [t.Fold(1, datetime(2000, 1, 1), datetime(2000, 3, 1)), t.Fold(2, datetime(2000, 2, 1), datetime(2000, 4, 1))])
