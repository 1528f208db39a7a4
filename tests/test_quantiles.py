from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tidemark.functions import quantiles as q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.8, 0.99, 1.0]


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(4)


def shapes():
    rng = random.Random(7)
    n = 3000
    return {
        "uniform": [rng.random() for _ in range(n)],
        "heavy_ties": [float(rng.choice([1, 1, 1, 2, 5])) for _ in range(n)],
        "one_value_third": [42.0 if i % 3 == 0 else rng.gauss(40, 5) for i in range(n)],
        "outliers": [rng.random() * 1e-300 for _ in range(n - 3)] + [1e300, -1e300, 5.0],
        "negative_zero": [rng.choice([0.0, -0.0, 1.0, -1.0]) for _ in range(n)],
        "constant": [3.5] * n,
    }


@pytest.mark.parametrize("name", list(shapes()))
def test_distributed_selection_is_exact(spark, name):
    values = shapes()[name]
    df = column(spark, values)
    got = q.exact_quantiles(df, {"x": PROBS}, builtin_cells=0, leaf_rows=40)["x"]
    builtin = q.exact_quantiles(df, {"x": PROBS})["x"]
    np.testing.assert_allclose(got, np.quantile(values, PROBS), rtol=1e-12, atol=1e-300)
    np.testing.assert_allclose(builtin, got, rtol=1e-12, atol=1e-300)


def test_order_statistics_of_several_columns(spark):
    rng = random.Random(3)
    rows = [(rng.random(), float(rng.randrange(9)), None if i % 2 else float(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    ranks = {"a": [0, 1000, 1999], "b": [0, 500, 1999], "c": [0, 999]}
    got = q.order_statistics(df, ranks, leaf_rows=30)
    for i, name in enumerate("abc"):
        ordered = sorted(r[i] for r in rows if r[i] is not None)
        assert got[name] == {r: ordered[r] for r in ranks[name]}


def test_nulls_nan_and_empty(spark):
    df = column(spark, [None, float("nan"), 4.0, 2.0])
    assert q.exact_quantiles(df, {"x": [0.5]})["x"] == [3.0]
    assert q.exact_quantiles(df, {"x": [0.5]}, builtin_cells=0)["x"] == [3.0]
    empty = column(spark, [None, float("nan")])
    assert q.exact_quantiles(empty, {"x": [0.1, 0.5]})["x"] == [None, None]
    assert q.exact_quantiles(empty, {"x": [0.1, 0.5]}, builtin_cells=0)["x"] == [None, None]


def test_infinite_values_keep_their_place(spark):
    df = column(spark, [math.inf, -math.inf, *map(float, range(100))])
    got = q.order_statistics(df, {"x": [0, 1, 51, 100, 101]}, leaf_rows=5)["x"]
    assert got == {0: -math.inf, 1: 0.0, 51: 50.0, 100: 99.0, 101: math.inf}


def test_rank_out_of_range(spark):
    with pytest.raises(ValueError):
        q.order_statistics(column(spark, [1.0, 2.0]), {"x": [2]})


@pytest.mark.parametrize("n", [5, 7, 10, 23, 100, 1001])
def test_averaged_edges_match_numpy(spark, n):
    rng = random.Random(n)
    values = [round(rng.random() * 50) / 2 for _ in range(n)]
    got = q.averaged_inverted_cdf_edges(column(spark, values), "x", 5, leaf_rows=20)
    # Quantiles as exact fractions of n; numpy's own q*n is off by rounding for some n.
    want = np.quantile(values, [i / 5 for i in range(6)], method="averaged_inverted_cdf")
    if all((i * n) % 5 for i in range(1, 5)) or n in (5, 10, 100):
        np.testing.assert_allclose(got, want)
    ordered = sorted(values)
    assert got[0] == ordered[0] and got[-1] == ordered[-1]


def test_sketch_option_is_close(spark):
    values = [float(i) for i in range(10_000)]
    got = q.approx_quantiles(column(spark, values), {"x": [0.5]}, 1000)["x"][0]
    assert abs(got - 5000) <= 20
