from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import compare, history, importance, learners, policy, prep, target, temporal, walkforward
from tidemark.operators.clean import clean_transactions
from tidemark.operators.metrics import regression_metrics
from tidemark.workspace import Workspace

TREES = {"max_depth": 3, "max_iter": 3, "min_samples_leaf": 5, "max_bins": 32}
FOREST = {"n_estimators": 5, "max_depth": 5, "max_bins": 32}


@pytest.fixture(scope="module")
def matrix(spark, sales):
    clean = clean_transactions(sales, Workspace(spark))
    made = compare.prepare_matrix(clean, temporal.fit_calendar_split(clean), policy.mainline_policy(clean.schema))
    yield made
    made.release()


def arrays(matrix, *splits):
    rows = matrix.of(*splits).select(vector_to_array("features").alias("x"), "y_true").collect()
    return np.array([r.x for r in rows]), np.array([r.y_true for r in rows])


# ---- preprocessing


def test_preprocessor_edge_cases(spark, tmp_path):
    train = spark.createDataFrame(
        [(1.0, 5.0, None, "b", None), (3.0, 5.0, None, "a", None), (None, 5.0, None, "it's", None), (float("nan"), 5.0, None, None, None)],
        "x double, same double, nothing double, `c.c` string, empty string")
    spec = policy.FeatureSpec(("x", "same", "nothing"), ("c.c", "empty"))
    fitted = prep.fit_preprocessor(train, spec)
    assert fitted.feature_names == ("x", "same", "c.c_a", "c.c_b", "c.c_it's")
    assert fitted.medians["x"] == 2.0 and fitted.modes == {"c.c": "a"}
    new = spark.createDataFrame([(2.0, 7.0, 1.0, "unseen", "z"), (4.0, None, None, None, None)], train.schema)
    got = [list(r[0]) for r in fitted.transform(new).select(vector_to_array("features")).collect()]
    sd = np.std([1, 3, 2, 2])
    # Constant column: scale 1.  Unseen category: all zeros.  NULL category: the mode.
    np.testing.assert_allclose(got, [[0, 2, 0, 0, 0], [2 / sd, 0, 1, 0, 0]])
    assert fitted.transform(new).columns == [*new.columns, "features"]
    path = str(tmp_path / "prep")
    fitted.pipeline.write().save(path)
    again = PipelineModel.load(path).transform(new).select(vector_to_array("features")).collect()
    np.testing.assert_allclose([list(r[0]) for r in again], got)


def test_median_options(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1001)], "x double")
    assert prep.fit_medians(df, ["x"]) == {"x": 500.0}
    assert abs(prep.fit_medians(df, ["x"], accuracy=500)["x"] - 500) <= 5


def test_category_limit(spark):
    df = spark.createDataFrame([(str(i),) for i in range(100)], "c string")
    with pytest.raises(ValueError, match="too many"):
        prep.fit_categories(df, ["c"], max_categories=10)


def test_matrix_is_standardised_on_train(matrix):
    x, _ = arrays(matrix, "train")
    names = matrix.prep.feature_names
    assert matrix.prep.feature_dim == x.shape[1] == len(names)
    k = len(matrix.prep.scaler)
    np.testing.assert_allclose(x[:, :k].mean(axis=0), 0, atol=1e-9)
    np.testing.assert_allclose(x[:, :k].std(axis=0), 1, atol=1e-9)
    assert set(np.unique(x[:, k:])) <= {0.0, 1.0}


# ---- learners


def test_ridge_closed_form(matrix):
    x, y = arrays(matrix, "train")
    model = learners.ridge(alpha=1.0).fit(matrix.of("train"))
    xc, yc = x - x.mean(axis=0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ yc)
    np.testing.assert_allclose(model.coefficients.toArray(), want, rtol=1e-6)
    assert model.intercept == pytest.approx(y.mean() - x.mean(axis=0) @ want)


def test_elastic_net_coordinate_descent(matrix):
    x, y = arrays(matrix, "train")
    alpha, l1 = 0.5, 0.3
    xc, yc, n = x - x.mean(axis=0), y - y.mean(), len(y)
    w, size = np.zeros(x.shape[1]), (xc ** 2).sum(axis=0) / n
    for _ in range(3000):
        for j in range(len(w)):
            rho = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (size[j] + alpha * (1 - l1))
    model = learners.elastic_net(alpha=alpha, l1_ratio=l1).fit(matrix.of("train"))
    pred = x @ model.coefficients.toArray() + model.intercept
    want = xc @ w + y.mean()
    np.testing.assert_allclose(pred, want, rtol=1e-3, atol=2.0)


def test_lbfgs_uses_the_same_penalty(matrix, monkeypatch):
    normal = learners.ridge(alpha=5.0).fit(matrix.of("train"))
    other = learners.ridge(alpha=5.0, solver="l-bfgs").fit(matrix.of("train"))
    p = [m.transform(matrix.of("test")).agg(F.avg("prediction")).first()[0] for m in (normal, other)]
    assert p[0] == pytest.approx(p[1], rel=1e-4)
    monkeypatch.setattr(learners, "NORMAL_EQUATION_WIDTH", 1)
    with pytest.raises(ValueError, match="l-bfgs"):
        learners.ridge().fit(matrix.of("train"))


def test_comparison_beats_naive_and_reports_skips(spark, matrix):
    def broken(_):
        raise ValueError("no luck")

    found = compare.compare_models(matrix, [
        learners.naive_median(), learners.boosted_trees(**TREES), learners.random_forest(**FOREST), learners.ridge(),
        learners.elastic_net(), learners.Learner("Broken", broken), learners.boosted_trees("Wide", max_dim=3)])
    board = found.results.collect()
    rmse = {r.model: r.test_rmse for r in board}
    assert list(rmse) == [m for m, _ in sorted(rmse.items(), key=lambda kv: kv[1])]
    assert all(rmse[m] < rmse["NaiveMedian"] for m in rmse if m != "NaiveMedian") and len(rmse) == 5
    assert set(found.skipped) == {"Broken", "Wide"} and "no luck" in found.skipped["Broken"]
    assert {r.model for r in compare.skipped_table(spark, found.skipped).collect()} == {"Broken", "Wide"}
    assert "history_date" in found.predictions.columns


def test_grid_search_ranks_by_validation(matrix):
    grid = compare.parameter_grid(max_depth=[2, 4], n_estimators=[3])
    got = compare.grid_search(matrix, {"RandomForest": (learners.random_forest, grid)}).collect()
    assert len(got) == 2 and got[0].val_rmse <= got[1].val_rmse
    assert len(compare.BOOSTING_GRID) == len(compare.FOREST_GRID) == 6


@pytest.mark.parametrize("kind", ["standard", "log", "none"])
def test_target_maps_round_trip(spark, kind):
    df = spark.createDataFrame([(float(v),) for v in (1, 10, 1000, 250000)], "y_true double")
    m = target.fit_target_map(df, kind)
    row = df.select(F.max(F.abs(m.inverse(m.forward(F.col("y_true"))) - F.col("y_true")))).first()
    assert row[0] < 1e-6
    with pytest.raises(ValueError):
        target.fit_target_map(df, "cube")


def test_mapped_learner(matrix):
    for learner in (learners.mapped_target(learners.ridge(), "standard"), learners.mapped_target(learners.ridge(), "log", guard=True)):
        model = learner.fit(matrix.of("train"))
        scored = learners.score(model, matrix.of("test")).withColumn("model", F.lit("m"))
        assert regression_metrics(scored).first().r2 > 0.3


def test_foreign_scoring(matrix):
    width = matrix.prep.feature_dim
    scored = learners.score_foreign(matrix.of("val"), lambda: lambda batch: batch.sum(axis=1), batch_size=7)
    rows = scored.select(vector_to_array("features").alias("x"), "y_pred").collect()
    assert all(len(r.x) == width and r.y_pred == pytest.approx(sum(r.x)) for r in rows)


# ---- importance


def test_even_sample_positions(spark, workspace):
    ids = random.Random(2).sample(range(10**6), 997)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "row_id bigint, s string").repartition(5)
    got = importance.even_sample(df, workspace, n=100).orderBy("sample_index").collect()
    want = np.sort(ids)[np.linspace(0, 996, num=100, dtype=int)]
    assert [r.row_id for r in got] == list(want) and all(r.s == str(r.row_id) for r in got)
    assert importance.even_sample(df, workspace, n=1).count() == 1
    assert importance.even_sample(df, workspace, n=5000).count() == 997


def test_even_sample_of_more_rows_than_an_int_product_takes(spark, workspace):
    rows = 700_001
    got = importance.even_sample(spark.range(rows).withColumnRenamed("id", "row_id"), workspace).orderBy("sample_index").collect()
    assert [r.row_id for r in got] == [i * (rows - 1) // 3999 for i in range(4000)]
    assert [r.sample_index for r in got] == list(range(4000))


def test_permutation_importance_of_a_useless_feature(spark, workspace):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id int, a double, b double").withColumn("y_true", 100 * F.col("a"))
    fitted = prep.fit_preprocessor(df, policy.FeatureSpec(("a", "b"), ()))
    ready = fitted.transform(df)
    model = learners.random_forest(**FOREST).fit(ready)
    sample = importance.even_sample(ready, workspace, n=200)
    got = {r.feature: r.importance for r in importance.permutation_importance(model, sample, fitted.feature_names).collect()}
    assert got["a"] > 10 and abs(got["b"]) < 2
    gain = importance.gain_importance(spark, model, fitted.feature_names).collect()
    assert gain[0].feature == "a" and sum(r.importance for r in gain) == pytest.approx(1)


def test_permutation_importance_of_a_wide_matrix(spark, workspace):
    """Only what the model reads is shuffled; the rest is zero without being scored."""
    from pyspark.ml.regression import DecisionTreeRegressor

    width = 2000
    df = spark.range(300).selectExpr("cast(id AS int) AS row_id", "cast(id % 7 AS double) AS a", "1D * id % 7 * 10 AS y_true")
    fill = F.array_repeat(F.lit(0.0), width - 1)
    df = df.select("row_id", "y_true", array_to_vector(F.concat(F.array("a"), fill)).alias("features"))
    df = workspace.stage(df, "wide")
    model = DecisionTreeRegressor(labelCol="y_true", maxDepth=3).fit(df)
    names = [f"f{i:04d}" for i in range(width)]
    sample = workspace.stage(importance.even_sample(df, workspace, n=200), "wide-sample")
    got = {r.feature: r.importance for r in importance.permutation_importance(model, sample, names, k=width).collect()}
    assert len(got) == width and got["f0000"] > 5 and {v for f, v in got.items() if f != "f0000"} == {0.0}


# ---- histories and folds

# Validation RMSE of a published 31-epoch training history.
PUBLISHED = [
    514787.7068114784, 485987.9805746958, 470722.5727913541, 466628.973695526, 459695.59725561884, 455006.9206239194,
    471247.49904697476, 481891.03567933495, 447266.14654920326, 441493.37339049455, 447548.48469433945, 495559.5907147839,
    439695.87230046093, 455207.54806272197, 463788.70271416823, 456313.5110458331, 448984.94419964997, 470632.6447111705,
    507827.7857557619, 462430.7967477698, 428184.9839838557, 514633.49435045396, 558571.7052834384, 486196.5596742935,
    437969.64205383, 441505.75427474215, 521232.0313900096, 518816.57999493915, 518999.12637898786, 447508.1818489634,
    486591.4353180989]


def replay(values, patience, tol):
    """The training loop's own bookkeeping."""
    best, best_epoch, misses = float("inf"), 0, 0
    for epoch, v in enumerate(values, 1):
        if v is not None and v < best - tol:
            best, best_epoch, misses = v, epoch, 0
        else:
            misses += 1
            if misses >= patience:
                return best_epoch, epoch
    return best_epoch, None


def stops(spark, runs, patience, tol, chunk):
    rows = [(name, e, v) for name, values in runs.items() for e, v in enumerate(values, 1)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, val_rmse double")
    return {r.run_id: (r.best_epoch, r.stop_epoch) for r in history.early_stop(df, patience, tol, chunk=chunk).collect()}


def test_published_early_stop(spark):
    assert stops(spark, {"p": PUBLISHED}, 10, 1e-6, history.CHUNK) == {"p": (21, 31)}


def test_early_stop_matches_replay(spark):
    rng = random.Random(9)
    runs = {f"r{i}": [rng.choice([rng.random(), round(rng.random(), 1), 0.5]) for _ in range(rng.randrange(1, 60))] for i in range(40)}
    runs |= {"falling": [100.0 - i for i in range(50)], "creeping": [1.0 - i * 0.004 for i in range(60)],
             "flat": [1.0] * 20, "gap": [None, None, 3.0, None, 2.0]}
    for patience, tol, chunk in ((3, 0.01, 4), (5, 1e-6, 7), (10, 0.05, 1000)):
        assert stops(spark, runs, patience, tol, chunk) == {n: replay(v, patience, tol) for n, v in runs.items()}


def test_early_stop_of_a_long_run_that_always_improves(spark):
    """Every epoch is a minimum; the fold holds one state, not the epochs."""
    n = 1_000_000
    df = spark.range(1, n + 1).selectExpr("'long' AS run_id", "cast(id AS int) AS epoch", f"{n}D - id AS val_rmse")
    df = df.unionAll(spark.createDataFrame([("none", 1, None), ("none", 11, None)], "run_id string, epoch int, val_rmse double"))
    got = {r.run_id: tuple(r)[1:] for r in history.early_stop(df).collect()}
    assert got == {"long": (n, 0.0, None, n), "none": (None, None, 10, 11)}


def test_early_stop_of_an_empty_history(spark):
    assert history.early_stop(spark.createDataFrame([], "run_id string, epoch int, val_rmse double")).collect() == []


def test_loss_curves(matrix):
    train = matrix.of("train")
    curve = [r.loss for r in history.loss_curve(learners.boosted_trees(**TREES).fit(train), train).orderBy("iteration").collect()]
    assert len(curve) == 3 and curve == sorted(curve, reverse=True)

    from pyspark.ml.regression import LinearRegression

    linear = LinearRegression(labelCol="y_true", solver="l-bfgs", regParam=0.1, maxIter=5).fit(train)
    losses = [r.loss for r in history.loss_curve(linear).orderBy("iteration").collect()]
    assert len(losses) > 1 and losses == sorted(losses, reverse=True)


# Published fold errors of two families.
FOLDS = [
    ("fold_1", 224290.75921860474, 293533.1934892543), ("fold_2", 341327.7232408502, 312845.8785792135),
    ("fold_3", 462977.05468723364, 411278.64026229223), ("fold_4", 361405.1842044775, 408975.44383984717)]


def fold_table(spark):
    rows = [(f, m, 1, 1, r) for f, rf, mlp in FOLDS for m, r in (("RandomForest", rf), ("MLP", mlp))]
    return spark.createDataFrame(rows, walkforward.FOLD_SCHEMA)


def test_published_stability_and_winners(spark):
    table = fold_table(spark)
    got = {r.model_family: r for r in walkforward.family_stability(table).collect()}
    assert got["RandomForest"].rmse_mean == pytest.approx(347500.18033779156)
    assert got["RandomForest"].rmse_std == pytest.approx(84774.58098)
    assert got["RandomForest"].cv_pct == pytest.approx(24.39555021162072)
    assert got["MLP"].cv_pct == pytest.approx(15.115061299012709)
    winners = {r.fold: r.winner for r in walkforward.fold_winners(table).collect()}
    assert winners == {"fold_1": "RandomForest", "fold_2": "MLP", "fold_3": "MLP", "fold_4": "RandomForest"}
    assert {r.model_family: r.folds_won for r in walkforward.folds_won(table).collect()} == {"RandomForest": 2, "MLP": 2}


def test_walk_forward_refits_and_skips(spark, sales):
    clean = clean_transactions(sales, Workspace(spark))
    folds = temporal.walk_forward_folds(clean)
    spec = policy.mainline_policy(clean.schema)
    got = walkforward.walk_forward(clean, folds, [learners.naive_median(), learners.ridge()], spec, min_rows=200).collect()
    assert {r.model_family for r in got} == {"NaiveMedian", "Ridge"} and len({r.fold for r in got}) >= 3
    by = {(r.fold, r.model_family): r.rmse for r in got}
    assert all(by[f, "Ridge"] < by[f, "NaiveMedian"] for f, _ in by)
    with pytest.raises(ValueError, match="no fold"):
        walkforward.walk_forward(clean, folds, [learners.naive_median()], None, min_rows=10**9)


def test_best_of_family(spark):
    df = spark.createDataFrame([("s", 3.0), ("m", 1.0), ("x", 0.5)], "model string, test_rmse double")
    got = {r.model: r.test_rmse for r in compare.best_of_family(df, {"s": "Fam", "m": "Fam"}).collect()}
    assert got == {"s": 3.0, "m": 1.0, "x": 0.5, "Fam": 1.0}


def test_failed_settings_and_folds_stay_visible(spark):
    from tidemark.operators import governance, walkforward

    folds = spark.createDataFrame(
        [("a", "Ridge", 10, 5, 1.0), ("b", "Ridge", 20, 5, None), ("a", "Naive", 10, 5, 2.0), ("b", "Naive", 20, 5, 2.0)],
        walkforward.FOLD_SCHEMA)
    assert governance.gate_variation(folds, "Ridge") is None
    assert governance.gate_variation(folds, "Naive") == 0.0
    assert {r.fold: r.winner for r in walkforward.fold_winners(folds).collect()} == {"a": "Ridge", "b": "Naive"}


def test_a_failed_job_is_not_a_skipped_candidate(spark):
    import pytest

    from tidemark.operators import compare, learners

    def lost(_):
        raise RuntimeError("executor lost")

    with pytest.raises(RuntimeError):
        compare.fit_all(spark.range(1), [learners.Learner("Lost", lost)], 1)


def test_fits_run_at_a_time_and_wide_ones_take_turns(spark):
    """Two fits that wait for each other both end; of the wide ones none begins before the last has ended."""
    import threading

    both, turn = threading.Barrier(2), threading.Lock()

    def meet(train):
        both.wait(timeout=60)
        return learners.ConstantModel(0.0)

    def alone(train):
        assert turn.acquire(blocking=False)
        time.sleep(0.2)
        turn.release()
        return learners.ConstantModel(1.0)

    found = [learners.Learner("A", meet), *[learners.Learner(n, alone, wide=True) for n in "BC"], learners.Learner("D", meet)]
    models, skipped = compare.fit_all(spark.range(1), found, 1)
    assert list(models) == ["A", "B", "C", "D"] and not skipped


def test_boosting_stops_early_on_held_out_rows(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0).alias("x"),
        (F.col("id") % 2 * 10 + F.pmod(F.xxhash64("id"), F.lit(7))).cast("double").alias("y_true"))
    train = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    full = learners.boosted_trees(max_iter=12, max_depth=2).fit(train)
    early = learners.boosted_trees(max_iter=12, max_depth=2, validation_fraction=0.1).fit(train)
    assert full.getNumTrees == 12 and early.getNumTrees < 12


@pytest.mark.parametrize("name", [
    "model_gbt", "model_rf", "compare_models", "assisted_eval", "importance_gain", "permutation_importance", "wf_forest", "loss_curve"])
def test_registered_models_use_the_defaults(spark, monkeypatch, name):
    from tests.conftest import SF_TINY
    from tidemark.operators import walkforward
    from tidemark.plans import catalog

    used = []

    class Stop(Exception):
        pass

    def stop(*args, **kwargs):
        raise Stop

    def spy(*names, **params):
        used.append(params)
        return learners.Learner("spy", stop)

    for factory in ("boosted_trees", "random_forest", "walk_forward_forest"):
        monkeypatch.setattr(learners, factory, spy)
    monkeypatch.setattr(compare, "compare_models", stop)
    monkeypatch.setattr(walkforward, "walk_forward", stop)
    with pytest.raises(Stop):
        catalog.queries()[name](spark, SF_TINY)
    assert used and not any(used)


def test_registered_search_uses_the_whole_grids(spark, monkeypatch):
    from tests.conftest import SF_TINY
    from tidemark.plans import catalog

    class Stop(Exception):
        pass

    def search(matrix, families):
        assert {k: grid for k, (_, grid) in families.items()} == {"HistGBR": compare.BOOSTING_GRID, "RandomForest": compare.FOREST_GRID}
        raise Stop

    monkeypatch.setattr(compare, "grid_search", search)
    with pytest.raises(Stop):
        catalog.queries()["grid_search"](spark, SF_TINY)
