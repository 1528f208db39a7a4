"""Queries that fit models, score them and look inside."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_medians
from tidemark.operators import compare, history, importance, learners, policy, target, walkforward
from tidemark.operators.compare import prepare_matrix
from tidemark.operators.metrics import leaderboard, regression_metrics
from tidemark.operators.prep import fit_preprocessor
from tidemark.operators.temporal import walk_forward_folds
from tidemark.plans import fixtures, run
from tidemark.plans.inputs import KEYS, SCORED, Inputs
from tidemark.plans.oracles import twin
from tidemark.plans.registry import query, rounded
from tidemark.sources.tables import write_table

_BY_SPLIT = """count(*) AS n_rows, round(avg(abs(y-p)),4) AS mae, round(sqrt(avg((y-p)*(y-p))),4) AS rmse,
       round(1 - sum((y-p)*(y-p))/nullif(var_pop(y)*count(*),0),4) AS r2,
       round(avg(CASE WHEN abs(y)>100 THEN abs((y-p)/y) END),4) AS mape,
       round(avg(CASE WHEN abs(y)>100 THEN CASE WHEN abs((y-p)/y) < 0.10 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END),4) AS within_10pct_rate"""


@query(twin(f"""
SELECT split, {_BY_SPLIT} FROM (
  SELECT split, history_price AS y, (SELECT median(history_price) FROM train) AS p FROM sp) s GROUP BY split"""))
def model_naive(spark, sf_dir):
    """Flagship: clean, split by time, fit the naive median on train, judge."""
    q = Inputs(spark, sf_dir, KEYS)
    rows = q.split.withColumnRenamed("history_price", "y_true")
    model = learners.fit_naive_median(rows.where(q.bounds.rows_of("train")))
    return rounded(regression_metrics(learners.score(model, rows), by=("split",)))


def _mainline_matrix(q: Inputs) -> compare.Matrix:
    return prepare_matrix(q.clean, q.bounds, policy.mainline_policy(q.clean.schema), rows=q.size)


def _compared(q: Inputs, *models: learners.Learner):
    """Leaderboard rows of the models with the naive baseline beside them."""
    matrix = _mainline_matrix(q)
    found = compare.compare_models(matrix, [learners.naive_median(), *models])
    results = q.workspace.stage(found.results, "results")
    matrix.release()
    return rounded(results)


@query()
def model_gbt(spark, sf_dir):
    return _compared(Inputs(spark, sf_dir), learners.boosted_trees())


@query()
def model_rf(spark, sf_dir):
    return _compared(Inputs(spark, sf_dir), learners.random_forest())


@query()
def model_ridge(spark, sf_dir):
    return _compared(Inputs(spark, sf_dir), learners.ridge())


@query()
def model_enet(spark, sf_dir):
    return _compared(Inputs(spark, sf_dir), learners.elastic_net())


@query()
def compare_models(spark, sf_dir):
    return _compared(
        Inputs(spark, sf_dir), learners.boosted_trees(), learners.random_forest(),
        learners.ridge(), learners.elastic_net())


_PREDICTORS = ("NaiveMedian", "RoomRate", *fixtures.ESTIMATES)


@query(twin("SELECT row_id, split, history_date, round(max(y_true), 6) AS y_true, " + ", ".join(
    f"round(max(CASE WHEN model = '{m}' THEN y_pred END), 6) AS pred_{m}" for m in _PREDICTORS)
    + " FROM preds GROUP BY row_id, split, history_date"))
def predictions_wide(spark, sf_dir):
    return rounded(compare.wide_predictions(Inputs(spark, sf_dir, SCORED).predictions(), _PREDICTORS), 6)


@query(twin("SELECT row_id, split, history_date, round(y_true, 6) AS y_true, model, round(y_pred, 6) AS y_pred FROM preds"))
def predictions_long(spark, sf_dir):
    wide = compare.wide_predictions(Inputs(spark, sf_dir, SCORED).predictions(), _PREDICTORS)
    return rounded(compare.long_predictions(wide), 6)


# With one standardised feature both penalised regressions have a closed form.
_ONE_FEATURE = (
    "one AS (SELECT avg(bedrooms) AS mu, stddev_pop(bedrooms) AS sd, avg(history_price) AS ybar, count(*) AS n FROM train)",
    """cross_terms AS (
  SELECT sum((bedrooms-mu)/sd * (history_price-ybar)) AS sxy, sum(((bedrooms-mu)/sd) * ((bedrooms-mu)/sd)) AS sxx
  FROM train CROSS JOIN one)""",
)


def _single_feature(spark, sf_dir, learner: learners.Learner, digits: int):
    q = Inputs(spark, sf_dir, (*KEYS, "bedrooms"))
    matrix = prepare_matrix(q.clean, q.bounds, policy.FeatureSpec(("bedrooms",), ()), rows=q.size)
    model = learner.fit(matrix.of("train"))
    scored = learners.score(model, matrix.of("val", "test")).select(
        "row_id", F.round("y_pred", digits).alias("y_pred"))
    staged = q.workspace.stage(scored, "scored")
    matrix.release()
    return staged


@query(twin("""
SELECT row_id, round(ybar + sxy/(sxx + 1) * (bedrooms-mu)/sd, 2) AS y_pred
FROM sp CROSS JOIN one CROSS JOIN cross_terms WHERE split <> 'train'""", *_ONE_FEATURE))
def model_ridge_single(spark, sf_dir):
    return _single_feature(spark, sf_dir, learners.ridge(alpha=1.0), 2)


@query(twin("""
SELECT row_id, round(ybar + sign(sxy)*greatest(abs(sxy)/n - CAST(0.001 AS DOUBLE)*0.2, 0)/(sxx/n + CAST(0.001 AS DOUBLE)*0.8) * (bedrooms-mu)/sd, 0) AS y_pred
FROM sp CROSS JOIN one CROSS JOIN cross_terms WHERE split <> 'train'""", *_ONE_FEATURE))
def model_enet_single(spark, sf_dir):
    return _single_feature(spark, sf_dir, learners.elastic_net(), 0)


@query(twin("""
SELECT row_id, round(y, 6) AS y, round((y - mu)/sd, 6) AS z_standard, round(ln(1 + y), 6) AS z_log,
       round(y, 4) AS back_standard, round(y, 4) AS back_log
FROM (SELECT row_id, round(history_price, 6) AS y FROM sp) s
CROSS JOIN (SELECT avg(round(history_price, 6)) AS mu, stddev_pop(round(history_price, 6)) AS sd FROM train) f"""))
def target_transform(spark, sf_dir):
    """Both maps and their inverses, which must give the target back."""
    q = Inputs(spark, sf_dir, KEYS)
    rows = q.split.select("row_id", "split", F.round("history_price", 6).alias("y_true"))
    maps = {k: target.fit_target_map(rows.where("split = 'train'"), k) for k in ("standard", "log")}
    y = F.col("y_true")
    return rounded(rows.select(
        "row_id", y.alias("y"),
        *[m.forward(y).alias(f"z_{k}") for k, m in maps.items()],
        *[F.round(m.inverse(m.forward(F.round(y, 4))), 4).alias(f"back_{k}") for k, m in maps.items()]), 6)


@query(twin("""
SELECT row_id, round(exp(least(greatest(pred_log, lo), hi)) - 1, 2) AS y_pred
FROM (SELECT row_id, 2*ln(1 + saleEstimate_upperPrice) - 11 AS pred_log FROM scored) p
CROSS JOIN (SELECT min(ln(1 + history_price)) - 0.5 AS lo, max(ln(1 + history_price)) + 0.5 AS hi FROM train) b
WHERE pred_log IS NOT NULL"""))
def log_clip(spark, sf_dir):
    """Exaggerated log predictions are held to the padded train range."""
    q = Inputs(spark, sf_dir, (*KEYS, "saleEstimate_upperPrice"))
    train = q.rows_of("train").withColumnRenamed("history_price", "y_true")
    wild = q.rows_of("val", "test").select(
        "row_id", (2 * F.log1p("saleEstimate_upperPrice") - 11).alias("pred_log")).where("pred_log IS NOT NULL")
    clipped = target.clip_log_prediction(wild, target.fit_log_range(train))
    return rounded(clipped.select("row_id", "y_pred"), 2)


@query(twin("""
SELECT row_id, round(100 + 2*(bedrooms-mb)/sb - 3*(bathrooms-ma)/sa, 6) AS y_pred FROM sp CROSS JOIN (
  SELECT avg(bedrooms) AS mb, stddev_pop(bedrooms) AS sb, avg(bathrooms) AS ma, stddev_pop(bathrooms) AS sa FROM train) f
WHERE split <> 'train'"""))
def score_batches(spark, sf_dir):
    """A model from outside Spark, scored in Arrow batches."""
    q = Inputs(spark, sf_dir, (*KEYS, "bedrooms", "bathrooms"))
    prep = fit_preprocessor(q.rows_of("train"), policy.FeatureSpec(("bedrooms", "bathrooms"), ()), rows=q.size)

    def make_predict():
        weights = np.array([2.0, -3.0])
        return lambda batch: 100.0 + batch @ weights

    scored = learners.score_foreign(prep.transform(q.rows_of("val", "test")), make_predict)
    return rounded(scored.select("row_id", "y_pred"), 6)


@query()
def assisted_eval(spark, sf_dir):
    """The same learners on the matrix that includes vendor estimates."""
    q = Inputs(spark, sf_dir)
    matrix = prepare_matrix(q.clean, q.bounds, policy.assisted_policy(q.clean.schema), rows=q.size)
    found = compare.compare_models(matrix, [
        learners.boosted_trees("AssistedHistGBR"),
        learners.random_forest("AssistedRandomForest")])
    results = q.workspace.stage(
        found.results.select("model", "val_mae", "val_rmse", "test_mae", "test_rmse"), "results")
    matrix.release()
    return rounded(results)


@query(twin("""
SELECT 'HistGBR' AS model, concat('feature_dim=', 1 + count(DISTINCT propertyType), ' > 3') AS reason FROM train"""))
def width_guard(spark, sf_dir):
    """A learner that does not take so wide a matrix is skipped with a reason."""
    q = Inputs(spark, sf_dir, (*KEYS, "bedrooms", "propertyType"))
    matrix = prepare_matrix(q.clean, q.bounds, policy.FeatureSpec(("bedrooms",), ("propertyType",)), rows=q.size)
    found = compare.compare_models(matrix, [learners.naive_median(), learners.boosted_trees(max_dim=3)])
    matrix.release()
    return compare.skipped_table(spark, found.skipped)


@query(twin("""
SELECT benchmark, test_rows_used, round(test_mae,4) AS test_mae, round(test_rmse,4) AS test_rmse FROM benchmark_rows"""))
def run_benchmark_task(spark, sf_dir):
    """One task of a whole run, from a text file to its result table."""
    q = Inputs(spark, sf_dir, SCORED)
    source = write_table(q.sales.drop("row_id"), q.workspace.root, "source", "csv")
    written = run.evaluate(spark, run.RunConfig(source, q.workspace.path("out")), ["benchmark"])
    return rounded(spark.read.parquet(written["external_benchmark"]))


@query()
def grid_search(spark, sf_dir):
    q = Inputs(spark, sf_dir)
    matrix = _mainline_matrix(q)
    trials = compare.grid_search(matrix, {
        "HistGBR": (learners.boosted_trees, compare.BOOSTING_GRID),
        "RandomForest": (learners.random_forest, compare.FOREST_GRID),
    })
    results = q.workspace.stage(trials, "trials")
    matrix.release()
    return rounded(results)


@query()
def importance_gain(spark, sf_dir):
    q = Inputs(spark, sf_dir)
    matrix = _mainline_matrix(q)
    model = learners.random_forest().fit(matrix.of("train"))
    matrix.release()
    return rounded(importance.gain_importance(spark, model, matrix.prep.feature_names), 8)


@query(twin("""
SELECT r.row_id, CAST(i AS INTEGER) AS sample_index, round(r.history_price, 6) AS history_price
FROM range(0, 4000) AS t(i) JOIN (
  SELECT row_id, history_price, row_number() OVER (ORDER BY row_id) - 1 AS rk, count(*) OVER () AS n FROM sp WHERE split = 'val') r
ON r.rk = (i * (n - 1)) // (least(4000, n) - 1) WHERE i < least(4000, n)"""))
def even_sample(spark, sf_dir):
    """The feature is the sample size: 4,000 evenly spaced validation rows."""
    q = Inputs(spark, sf_dir, KEYS)
    rows = q.rows_of("val").select("row_id", "history_price")
    return rounded(importance.even_sample(rows, q.workspace), 6)


@query()
def permutation_importance(spark, sf_dir):
    q = Inputs(spark, sf_dir)
    matrix = _mainline_matrix(q)
    model = learners.random_forest().fit(matrix.of("train"))
    sample = q.workspace.stage(importance.even_sample(matrix.of("val"), q.workspace), "sample")
    matrix.release()
    return rounded(importance.permutation_importance(model, sample, matrix.prep.feature_names))


_BOARD = """model, round(val_mae,4) AS val_mae, round(val_rmse,4) AS val_rmse, round(val_r2,4) AS val_r2,
       round(val_mape,4) AS val_mape, round(val_within_10pct_rate,4) AS val_within_10pct_rate, round(test_mae,4) AS test_mae,
       round(test_rmse,4) AS test_rmse, round(test_r2,4) AS test_r2, round(test_mape,4) AS test_mape,
       round(test_within_10pct_rate,4) AS test_within_10pct_rate,
       round(test_rmse_improvement_vs_naive_pct,4) AS test_rmse_improvement_vs_naive_pct"""


@query(twin(f"""
SELECT {_BOARD} FROM (
  SELECT * FROM board
  UNION ALL
  SELECT * REPLACE ('VendorEstimate' AS model) FROM (
    SELECT * FROM board WHERE model LIKE 'saleEstimate%' ORDER BY test_rmse, model LIMIT 1) b) u"""))
def best_of_family(spark, sf_dir):
    board = leaderboard(regression_metrics(Inputs(spark, sf_dir, SCORED).predictions()))
    return rounded(compare.best_of_family(board, dict.fromkeys(fixtures.ESTIMATES, "VendorEstimate")))


_FOLD_COLUMNS = "fold, model_family, train_rows, val_rows, round(rmse,4) AS rmse"


@query(twin(f"SELECT {_FOLD_COLUMNS} FROM fold_metrics WHERE train_rows >= 1000 AND val_rows >= 1000"))
def wf_eval(spark, sf_dir):
    return rounded(Inputs(spark, sf_dir, KEYS).fold_metrics())


@query()
def wf_forest(spark, sf_dir):
    """Forest and ridge refitted on every fold."""
    q = Inputs(spark, sf_dir)
    folds = walk_forward_folds(q.clean)
    return rounded(walkforward.walk_forward(
        q.clean, folds, [learners.walk_forward_forest(), learners.ridge()],
        policy.mainline_policy(q.clean.schema)))


@query(twin(f"""
SELECT {_FOLD_COLUMNS}, round(rmse_mean,4) AS rmse_mean, round(rmse_std,4) AS rmse_std, round(cv_pct,4) AS cv_pct FROM stability"""))
def wf_stability(spark, sf_dir):
    return rounded(walkforward.family_stability(Inputs(spark, sf_dir, KEYS).fold_metrics()))


@query(twin("""
SELECT f.model_family, count(w.fold) AS folds_won FROM (SELECT DISTINCT model_family FROM fold_metrics) f
LEFT JOIN (SELECT fold, model_family, row_number() OVER (PARTITION BY fold ORDER BY rmse, model_family) AS rn FROM fold_metrics) w
ON w.model_family = f.model_family AND w.rn = 1 GROUP BY f.model_family"""))
def wf_winner(spark, sf_dir):
    return walkforward.folds_won(Inputs(spark, sf_dir, KEYS).fold_metrics())


# The replay carries the best value so far row by row, as a training loop does.
@query("""
WITH RECURSIVE hours AS (
  SELECT event_type AS run_id, date_trunc('hour', ts) AS hour, round(avg(value), 6) AS v FROM events GROUP BY 1, 2),
hist AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY hour) AS epoch, v FROM hours),
replay(run_id, epoch, best, best_epoch, misses) AS (
  SELECT run_id, epoch, v, epoch, CAST(0 AS BIGINT) FROM hist WHERE epoch = 1
  UNION ALL
  SELECT h.run_id, h.epoch, CASE WHEN h.v < r.best - 1e-6 THEN h.v ELSE r.best END,
         CASE WHEN h.v < r.best - 1e-6 THEN h.epoch ELSE r.best_epoch END,
         CASE WHEN h.v < r.best - 1e-6 THEN 0 ELSE r.misses + 1 END
  FROM replay r JOIN hist h ON h.run_id = r.run_id AND h.epoch = r.epoch + 1 WHERE r.misses < 10)
SELECT r.run_id, arg_max(best_epoch, r.epoch) AS best_epoch, round(arg_max(best, r.epoch), 6) AS best_value,
       max(CASE WHEN misses >= 10 THEN r.epoch END) AS stop_epoch,
       (SELECT CAST(max(epoch) AS INTEGER) FROM hist h WHERE h.run_id = r.run_id) AS last_epoch
FROM replay r GROUP BY r.run_id""")
def early_stop(spark, sf_dir):
    return rounded(history.early_stop(fixtures.hourly_history(spark, sf_dir)), 6)


@query()
def loss_curve(spark, sf_dir):
    q = Inputs(spark, sf_dir)
    matrix = _mainline_matrix(q)
    train = matrix.of("train")
    curve = history.loss_curve(learners.boosted_trees().fit(train), train)
    matrix.release()
    return rounded(curve)


@query(twin("""
SELECT 'history_price' AS column_name, round((SELECT median(history_price) FROM train), 6) AS median_value
UNION ALL SELECT 'rate', round((SELECT median(history_price / bedrooms) FROM train), 4)"""))
def train_medians(spark, sf_dir):
    """Medians by distributed selection, without the one-task value map."""
    q = Inputs(spark, sf_dir, (*KEYS, "bedrooms"))
    train = q.rows_of("train").select("history_price", (F.col("history_price") / F.col("bedrooms")).alias("rate"))
    found = exact_medians(train, ["history_price", "rate"], builtin_cells=0, leaf_rows=500)
    rows = [("history_price", round(found["history_price"], 6)), ("rate", round(found["rate"], 4))]
    return spark.createDataFrame(rows, "column_name string, median_value double")
