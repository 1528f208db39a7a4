"""One key holding a third of all rows must change neither results nor plans."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import clean, compare, metrics, prep, profile

N = 6000


@pytest.fixture(scope="module")
def frame():
    rng = random.Random(11)
    rows = []
    for i in range(N):
        hot = i % 3 == 0
        rows.append((i, "hot" if hot else f"a{rng.randrange(900)}", "2020-01-01" if hot else f"2020-01-{rng.randrange(1, 29):02d}",
                     100.0 if hot else round(rng.random() * 500, 1), "A" if hot else f"Z{i % 7}"))
    return pd.DataFrame(rows, columns=["row_id", "fullAddress", "history_date", "history_price", "area"])


@pytest.fixture(scope="module")
def hot(spark, frame):
    return spark.createDataFrame(frame).repartition(16).cache()


def test_dedup_and_duplicates(hot, frame):
    key = list(clean.DEDUP_KEY)
    got = sorted(r.row_id for r in clean.dedup_keep_first(hot).collect())
    assert got == sorted(frame.drop_duplicates(key, keep="first").row_id)
    row = profile.duplicate_membership(hot, key).first()
    assert row.duplicate_rows == frame.duplicated(key, keep=False).sum()
    assert row.removable_rows == frame.duplicated(key).sum()


def test_quantiles_both_ways(hot, frame):
    probs = [0.01, 0.3, 0.5, 0.99]
    want = np.quantile(frame.history_price, probs)
    for options in ({}, {"builtin_cells": 0, "leaf_rows": 50}):
        np.testing.assert_allclose(exact_quantiles(hot, {"history_price": probs}, **options)["history_price"], want)


def test_segments_and_modes(hot, frame):
    scored = hot.select("area", F.lit("m").alias("model"), F.col("history_price").alias("y_true"), F.lit(100.0).alias("y_pred"))
    got = {r.segment_value: (r.rows, r.mae) for r in metrics.segment_metrics(scored, ["area"]).collect()}
    for area, g in frame.groupby("area"):
        assert got[area] == (len(g), pytest.approx((g.history_price - 100).abs().mean()))
    modes, values = prep.fit_categories(hot, ["area"])
    assert modes == {"area": "A"} and values["area"] == sorted(frame.area.unique())


def test_grouped_work_is_combined_before_the_shuffle(hot):
    scored = hot.select("area", F.lit("m").alias("model"), F.col("history_price").alias("y_true"), F.lit(1.0).alias("y_pred"))
    for df in (metrics.segment_metrics(scored, ["area"]), metrics.regression_metrics(scored, by=("model",)),
               prep.category_counts(hot, ["area"]), profile.date_profile(hot, ["history_date"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_wide_and_long_predictions(spark):
    rows = [(1, "m", 1.0), (1, "n", 2.0), (2, "m", 3.0)]
    df = spark.createDataFrame(rows, "row_id int, model string, y_pred double")
    wide = compare.wide_predictions(df, ["m", "n"], keys=("row_id",))
    assert sorted(tuple(r) for r in wide.collect()) == [(1, 1.0, 2.0), (2, 3.0, None)]
    back = compare.long_predictions(wide).where("y_pred IS NOT NULL")
    assert sorted(tuple(r) for r in back.collect()) == rows
