from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bands, diagnostics, metrics, profile

# A published 5 x 5 confusion table and its report.
CONFUSION = [
    [18234, 4900, 1706, 770, 343],
    [11405, 10016, 3636, 962, 193],
    [3253, 10582, 8218, 2874, 425],
    [510, 3865, 9565, 10036, 2368],
    [98, 234, 1216, 6967, 18100],
]
REPORT = [
    (0.5442985074626866, 0.7025777366778407, 0.6133920912317292, 25953),
    (0.33841267696050276, 0.382115061803754, 0.35893852246053504, 26212),
    (0.3376196540815907, 0.3241558851372673, 0.3307508099732357, 25352),
    (0.46443611458188716, 0.3809596112966899, 0.418576522845286, 26344),
    (0.8446497736711932, 0.6800676310351306, 0.7534759803513446, 26615),
]


def predictions(spark, rows):
    return spark.createDataFrame(rows, "row_id int, split string, model string, y_true double, y_pred double")


def test_metrics_against_numpy(spark):
    rng = random.Random(1)
    rows = [(i, "test", "m", rng.random() * 1000, rng.random() * 1000) for i in range(500)]
    row = metrics.regression_metrics(predictions(spark, rows)).first()
    y, p = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    big = np.abs(y) > 100
    rel = np.abs((y - p) / y)[big]
    assert row.mae == pytest.approx(np.abs(y - p).mean())
    assert row.rmse == pytest.approx(math.sqrt(((y - p) ** 2).mean()))
    assert row.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row.mape == pytest.approx(rel.mean()) and row.within_10pct_rate == pytest.approx((rel < 0.1).mean())


def test_metrics_do_not_depend_on_partitioning(spark):
    rows = [(i, "test", "m", float(i), float(i * i % 17)) for i in range(400)]
    df = predictions(spark, rows)
    one, many = (metrics.regression_metrics(df.repartition(n)).first() for n in (1, 13))
    for c in metrics.METRICS:
        assert one[c] == pytest.approx(many[c], rel=1e-12)


def test_metric_edge_cases(spark):
    df = predictions(spark, [
        (1, "test", "small", 50.0, 60.0), (2, "test", "small", 100.0, 1.0),
        (1, "test", "hit", 5.0, 5.0), (2, "test", "hit", 5.0, 5.0),
        (1, "test", "miss", 5.0, 6.0), (2, "test", "miss", 5.0, 5.0),
        (1, "test", "border", 1000.0, 1100.0), (2, "test", "border", 1000.0, None), (3, "test", "border", 200.0, 200.0)])
    got = {r.model: r for r in metrics.regression_metrics(df).collect()}
    assert got["small"].mape is None and got["small"].within_10pct_rate is None
    assert got["hit"].r2 == 1.0 and got["miss"].r2 == 0.0
    # Exactly 10% off is not within 10%, and the unscored row does not count.
    assert got["border"].n_rows == 2 and got["border"].within_10pct_rate == 0.5


def test_leaderboard_order_uplift_and_first_run(spark):
    cells = []
    for model, test_rmse, arrival in (("NaiveMedian", 200.0, 1), ("b", 50.0, 1), ("a", 50.0, 2), ("b", 1.0, 3)):
        for split in ("val", "test"):
            cells.append((model, split, 1.0, test_rmse, 0.0, 0.0, 0.0, arrival))
    table = spark.createDataFrame(
        cells, "model string, split string, mae double, rmse double, r2 double, mape double, within_10pct_rate double, arrival int")
    board = metrics.leaderboard(table, arrival="arrival").collect()
    assert [(r.model, r.test_rmse_improvement_vs_naive_pct) for r in board] == [("a", 75.0), ("b", 75.0), ("NaiveMedian", 0.0)]
    wide = spark.createDataFrame([("x", 2.0, 5), ("x", 1.0, 6)], "model string, test_rmse double, run int")
    assert [r.test_rmse for r in metrics.first_per_model(wide, "run").collect()] == [2.0]


def test_published_uplift(spark):
    # Published test RMSE of the best model and of the naive median.
    wide = spark.createDataFrame(
        [("HistGBR", 393489.2706136952), ("NaiveMedian", 927645.6044640152)], "model string, test_rmse double")
    got = {r.model: r.test_rmse_improvement_vs_naive_pct for r in metrics.with_uplift(wide).collect()}
    assert got["HistGBR"] == pytest.approx(57.58193983562834, rel=1e-13)


def test_segments_drop_small_and_null_groups(spark):
    rows = [(i, "m", 10.0, 12.0, "A" if i < 60 else "B" if i < 70 else None) for i in range(140)]
    df = spark.createDataFrame(rows, "row_id int, model string, y_true double, y_pred double, area string")
    got = metrics.segment_metrics(df, ["area"]).collect()
    assert [(r.segment_type, r.segment_value, r.rows, r.rmse) for r in got] == [("area", "A", 60, 2.0)]


def test_attach_attributes(spark):
    pred = predictions(spark, [(1, "test", "m", 1.0, 2.0)])
    rows = spark.createDataFrame([(1, "A"), (2, "B")], "row_id int, area string")
    assert metrics.attach_attributes(pred, rows, ["area"]).first().area == "A"
    assert metrics.attach_attributes(pred, rows, ["model"]) is pred


def test_benchmark_columns(spark):
    df = spark.createDataFrame([(100.0, 110.0, None), (200.0, 190.0, 200.0)], "history_price double, a double, b double")
    got = metrics.benchmark_columns(df, ["a", "b", "zz"], min_rows=2).collect()
    assert [(r.benchmark, r.test_rows_used, r.test_mae) for r in got] == [("a", 2, 10.0)]
    with pytest.raises(ValueError):
        metrics.benchmark_columns(df, ["zz"])


@pytest.mark.parametrize("values", [
    [round(random.Random(i).random() * 1e6, 2) for i in range(500)],
    [1.0] * 300 + [2.0] * 50 + [3.0, 4.0, 5.5],
    [float(i % 4) for i in range(203)],
    [0.001 * i for i in range(100)],
])
def test_bands_match_qcut(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, y_true double")
    edges = bands.fit_band_edges(df)
    got = [r.price_band for r in bands.assign_bands(df, edges).orderBy("i").collect()]
    assert got == list(pd.qcut(pd.Series(values), q=5, duplicates="drop").astype("string"))


def test_bins_are_left_closed_and_clamp(spark):
    edges = [0.0, 10.0, 20.0, 30.0]
    df = spark.createDataFrame([(v,) for v in (-5.0, 0.0, 10.0, 19.9, 20.0, 30.0, 99.0, None)], "x double")
    got = [r[0] for r in df.select(bands.bin_index(F.col("x"), edges)).collect()]
    assert got == [0, 0, 1, 1, 2, 2, 2, None]


def test_bin_edges_merge_ties(spark):
    df = spark.createDataFrame([(1.0,)] * 80 + [(float(i),) for i in range(2, 22)], "y_true double")
    edges = bands.fit_bin_edges(df)
    assert len(edges) < 6 and edges[0] == 1.0 and edges[-1] == 21.0
    binned = diagnostics.assign_bins(df.withColumn("y_pred", F.col("y_true")), edges)
    cells = diagnostics.confusion(binned, len(edges) - 1)
    assert cells.agg(F.sum("n")).first()[0] == 100


def test_published_confusion_report(spark):
    rows = [(i, j, n) for i, line in enumerate(CONFUSION) for j, n in enumerate(line)]
    cells = spark.createDataFrame(rows, "true_bin int, pred_bin int, n bigint")
    report = diagnostics.bin_report(cells).orderBy("bin").collect()
    for got, want in zip(report, REPORT):
        assert (got.precision, got.recall, got.f1, got.support) == pytest.approx(want, rel=1e-12)
    row = diagnostics.bin_summary(cells, "HistGBR", 5).first()
    assert row.accuracy == pytest.approx(0.4951408688187866) and row.macro_f1 == pytest.approx(0.4950267853724261)
    assert row.weighted_f1 == pytest.approx(0.4965955360664132) and row.support == 130476
    wide = diagnostics.confusion_wide(cells, 5).orderBy("true_bin").collect()
    assert [list(r)[1:] for r in wide] == CONFUSION


def test_report_with_absent_bins(spark):
    """A bin that never occurs scores 0 and stays out of the averages."""
    df = spark.createDataFrame([(0, 0), (0, 1)], "true_bin int, pred_bin int")
    cells = diagnostics.confusion(df, 3)
    report = {r.bin: (r.precision, r.recall, r.f1) for r in diagnostics.bin_report(cells).collect()}
    assert report[0] == (1.0, 0.5, pytest.approx(2 / 3)) and report[1] == (0.0, 0.0, 0.0) and report[2] == (0.0, 0.0, 0.0)
    assert diagnostics.bin_summary(cells, "m", 3).first().macro_f1 == pytest.approx(1 / 3)


def test_hash_sample_is_exact_with_and_without_the_threshold(spark):
    df = spark.range(30_000).withColumnRenamed("id", "row_id")
    got = {r.row_id for r in diagnostics.hash_sample(df, 50).collect()}
    plain = {r.row_id for r in diagnostics.hash_sample(df, 50, rows=60).collect()}
    assert len(got) == 50 and got == plain
    again = {r.row_id for r in diagnostics.hash_sample(df.repartition(7), 50).collect()}
    assert got == again
    assert diagnostics.hash_sample(spark.range(5).withColumnRenamed("id", "row_id"), 50).count() == 5


def test_histogram_matches_numpy(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(800)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = profile.histogram(df, F.col("x"), 17).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=17)
    assert [r.n for r in got] == list(counts)
    np.testing.assert_allclose([r.edge_left for r in got], edges[:-1], atol=1e-12)
    flat = profile.histogram(df.select(F.lit(3.0).alias("x")), F.col("x"), 4).orderBy("bin").collect()
    assert [r.n for r in flat] == [0, 0, 801, 0]


def test_best_model_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None)], "model string, test_rmse double")
    assert diagnostics.best_model(df) == "a"


def test_profiles_count_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b"), (2.0, "c")], "x double, s string")
    assert {r.column_name: r.missing_pct for r in profile.missing_profile(df).collect()} == {"x": 50.0, "s": 25.0}
    assert [(r.column_name, r.dtype, r.non_null) for r in profile.schema_profile(df).orderBy("position").collect()] == [
        ("x", "double", 2), ("s", "string", 3)]
    assert profile.distinct_count(df, "s", approximate=True).first()[0] == 3
