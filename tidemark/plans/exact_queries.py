"""Model operators on problems small enough in width that SQL states the exact answer.

All rows are fitted and scored; only the features are few.  A tree on a yes/no feature
predicts group means, ridge and elastic net on one feature have a closed form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import compare, history, importance, learners, policy, walkforward
from tidemark.operators.compare import Matrix, prepare_matrix
from tidemark.operators.temporal import walk_forward_folds
from tidemark.plans import fixtures
from tidemark.plans.inputs import KEYS, Inputs
from tidemark.plans.oracles import twin
from tidemark.plans.registry import query, rounded
from tidemark.sources.records import run_manifest, write_manifest
from tidemark.sources.tables import require_columns

COLUMNS = (*KEYS, "bedrooms", "livingRooms")


def _flagged(clean: DataFrame) -> DataFrame:
    """Two yes/no features: a large home, and any living room."""
    return clean.withColumns({
        "large": F.when(F.col("bedrooms") > 4, 1.0).otherwise(0.0),
        "lounge": F.when(F.col("livingRooms") > 0, 1.0).otherwise(0.0)})


def _matrix(q: Inputs, *numeric: str) -> Matrix:
    return prepare_matrix(_flagged(q.clean), q.bounds, policy.FeatureSpec(numeric, ()), rows=q.size)


def _stump() -> learners.Learner:
    return learners.random_forest(n_estimators=1, max_depth=1, bootstrap=False)


def _staged(q: Inputs, matrix: Matrix, df: DataFrame) -> DataFrame:
    staged = q.workspace.stage(df, "exact")
    matrix.release()
    return staged


_FLAGGED = """flagged AS (
  SELECT *, CASE WHEN bedrooms > 4 THEN 1 ELSE 0 END AS large, CASE WHEN livingRooms > 0 THEN 1 ELSE 0 END AS lounge FROM sp)"""
_GROUPS = "groups AS (SELECT large, avg(history_price) AS mean FROM flagged WHERE split = 'train' GROUP BY large)"
_GROUP_MEANS = "SELECT row_id, round(mean, 2) AS y_pred FROM flagged JOIN groups USING (large) WHERE split <> 'train'"


def _group_means(spark, sf_dir, learner: learners.Learner) -> DataFrame:
    q = Inputs(spark, sf_dir, COLUMNS)
    matrix = _matrix(q, "large")
    scored = learners.score(learner.fit(matrix.of("train")), matrix.of("val", "test"))
    return _staged(q, matrix, scored.select("row_id", F.round("y_pred", 2).alias("y_pred")))


@query(twin(_GROUP_MEANS, _FLAGGED, _GROUPS))
def model_rf_single(spark, sf_dir):
    """One whole-sample tree on a yes/no feature: the mean of each side."""
    return _group_means(spark, sf_dir, _stump())


@query(twin(_GROUP_MEANS, _FLAGGED, _GROUPS))
def model_gbt_single(spark, sf_dir):
    """Boosting on a yes/no feature: the first round leaves nothing to the others."""
    return _group_means(spark, sf_dir, learners.boosted_trees(max_iter=4, max_depth=2))


@query(twin("""
SELECT CAST(i AS INTEGER) AS iteration, round(sqrt(avg((history_price - mean) * (history_price - mean))), 2) AS loss_root
FROM flagged JOIN groups USING (large) CROSS JOIN range(1, 5) AS r(i) WHERE split = 'train' GROUP BY i""", _FLAGGED, _GROUPS))
def loss_curve_single(spark, sf_dir):
    """Mean squared train loss per boosting round is the variance inside the groups."""
    q = Inputs(spark, sf_dir, COLUMNS)
    matrix = _matrix(q, "large")
    train = matrix.of("train")
    curve = history.loss_curve(learners.boosted_trees(max_iter=4, max_depth=2).fit(train), train)
    return _staged(q, matrix, curve.select("iteration", F.round(F.sqrt("loss"), 2).alias("loss_root")))


# What a split on each feature takes from the squared error of the train rows.
_GAINS = """gains AS (
  SELECT feature, sum(s * s / n) AS kept FROM (
    SELECT feature, flag, sum(history_price) AS s, count(*) AS n FROM (
      SELECT 'large' AS feature, large AS flag, history_price FROM flagged WHERE split = 'train'
      UNION ALL SELECT 'lounge', lounge, history_price FROM flagged WHERE split = 'train') u GROUP BY feature, flag) g
  GROUP BY feature)"""


@query(twin("""
SELECT feature, CASE WHEN kept = (SELECT max(kept) FROM gains) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS importance,
       'rf_gain' AS source FROM gains""", _FLAGGED, _GAINS))
def importance_gain_single(spark, sf_dir):
    """A tree of one split gives all importance to the feature with the larger gain."""
    q = Inputs(spark, sf_dir, COLUMNS)
    matrix = _matrix(q, "large", "lounge")
    found = importance.gain_importance(spark, _stump().fit(matrix.of("train")), matrix.prep.feature_names)
    return _staged(q, matrix, rounded(found, 8))


@query(twin("""
SELECT feature, kept = (SELECT max(kept) FROM gains) AS matters FROM gains""", _FLAGGED, _GAINS))
def permutation_importance_single(spark, sf_dir):
    """Shuffling the feature that the tree splits on hurts; the other is exactly zero."""
    q = Inputs(spark, sf_dir, COLUMNS)
    matrix = _matrix(q, "large", "lounge")
    model = _stump().fit(matrix.of("train"))
    sample = q.workspace.stage(importance.even_sample(matrix.of("val"), q.workspace), "sample")
    found = importance.permutation_importance(model, sample, matrix.prep.feature_names)
    return _staged(q, matrix, found.select("feature", (F.col("importance") > 0).alias("matters")))


# One standardised feature: the sums that ridge and elastic net are made of.
_ONE = (
    "one AS (SELECT avg(bedrooms) AS mu, stddev_pop(bedrooms) AS sd, avg(history_price) AS ybar, count(*) AS n FROM train)",
    """terms AS (
  SELECT sum((bedrooms-mu)/sd * (history_price-ybar)) AS sxy, sum(((bedrooms-mu)/sd) * ((bedrooms-mu)/sd)) AS sxx
  FROM train CROSS JOIN one)""",
)
_ERRORS = """round(avg(abs(y-p)) FILTER (split = 'val'), 2) AS val_mae, round(sqrt(avg((y-p)*(y-p)) FILTER (split = 'val')), 2) AS val_rmse,
       round(avg(abs(y-p)) FILTER (split = 'test'), 2) AS test_mae, round(sqrt(avg((y-p)*(y-p)) FILTER (split = 'test')), 2) AS test_rmse"""


@query(twin(f"""
SELECT model, {_ERRORS} FROM (
  SELECT split, history_price AS y, 'NaiveMedian' AS model, (SELECT median(history_price) FROM train) AS p FROM sp
  UNION ALL SELECT split, history_price, 'Ridge', ybar + sxy/(sxx + 1) * (bedrooms-mu)/sd FROM sp CROSS JOIN one CROSS JOIN terms
  UNION ALL SELECT f.split, f.history_price, 'RandomForest', g.mean FROM flagged f JOIN bedroom_means g USING (large)) u
GROUP BY model""", *_ONE, _FLAGGED, "bedroom_means AS (SELECT large, avg(history_price) AS mean FROM flagged WHERE split = 'train' GROUP BY large)"))
def compare_models_single(spark, sf_dir):
    """Naive median and ridge on the rooms beside a one-split tree on a large home."""
    q = Inputs(spark, sf_dir, COLUMNS)
    rooms, large = _matrix(q, "bedrooms"), _matrix(q, "large")
    fields = ("model", "val_mae", "val_rmse", "test_mae", "test_rmse")
    found = compare.compare_models(rooms, [learners.naive_median(), learners.ridge()]).results.select(*fields)
    tree = compare.compare_models(large, [learners.naive_median(), _stump()]).results.where("model = 'RandomForest'").select(*fields)
    staged = _staged(q, rooms, rounded(found.unionByName(tree), 2))
    large.release()
    return staged


@query(twin(f"""
SELECT 'Ridge' AS model_family, concat('{{"alpha": ', alpha, '}}') AS params, {_ERRORS}, 'fitted' AS status, CAST(NULL AS VARCHAR) AS reason
FROM (SELECT split, alpha, history_price AS y, ybar + sxy/(sxx + CAST(alpha AS DOUBLE)) * (bedrooms-mu)/sd AS p
      FROM sp CROSS JOIN one CROSS JOIN terms CROSS JOIN (SELECT unnest(['0.5', '100.0', '5000.0']) AS alpha) a) u GROUP BY alpha
UNION ALL SELECT 'HistGBR', '{{"max_dim": 0}}', NULL, NULL, NULL, NULL, 'failed', 'feature_dim=1 > 0'""", *_ONE))
def grid_search_status(spark, sf_dir):
    """Three penalties with their closed forms, and a setting that can't be fitted."""
    q = Inputs(spark, sf_dir, COLUMNS)
    matrix = _matrix(q, "bedrooms")
    trials = compare.grid_search(matrix, {
        "Ridge": (learners.ridge, compare.parameter_grid(alpha=[0.5, 100.0, 5000.0])),
        "HistGBR": (learners.boosted_trees, [{"max_dim": 0}])})
    return _staged(q, matrix, rounded(trials, 2))


@query(twin(f"""
SELECT 'AssistedRidge' AS model, {_ERRORS} FROM (
  SELECT split, history_price AS y, ybar + sxy/(sxx + 1) * (x-mu)/sd AS p FROM filled CROSS JOIN vendor CROSS JOIN vendor_terms) u""",
    "filled AS (SELECT *, coalesce(saleEstimate_upperPrice, (SELECT median(saleEstimate_upperPrice) FROM train)) AS x FROM sp)",
    "vendor AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd, avg(history_price) AS ybar FROM filled WHERE split = 'train')",
    """vendor_terms AS (SELECT sum((x-mu)/sd * (history_price-ybar)) AS sxy, sum(((x-mu)/sd) * ((x-mu)/sd)) AS sxx
  FROM filled CROSS JOIN vendor WHERE split = 'train')"""))
def assisted_single(spark, sf_dir):
    """Ridge on one vendor estimate, gaps filled by the train median."""
    q = Inputs(spark, sf_dir, (*KEYS, *fixtures.ESTIMATES))
    matrix = prepare_matrix(q.clean, q.bounds, policy.FeatureSpec((fixtures.ESTIMATES[2],), ()), rows=q.size)
    found = compare.compare_models(matrix, [learners.naive_median(), learners.ridge("AssistedRidge")])
    return _staged(q, matrix, rounded(found.results.where("model = 'AssistedRidge'").select(
        "model", "val_mae", "val_rmse", "test_mae", "test_rmse"), 2))


@query(twin("""
SELECT label AS fold, model_family, train_rows, val_rows, CASE WHEN model_family = 'Ridge' THEN rmse END AS rmse FROM (
  SELECT g.label, count(*) AS val_rows, max(g.n) AS train_rows,
         round(sqrt(avg(pow(c.history_price - (g.ybar + g.sxy/(g.sxx + 1) * (c.bedrooms - g.mu)/g.sd), 2))), 2) AS rmse
  FROM fold_fit g JOIN clean c ON c.history_date >= g.val_start AND c.history_date < g.val_end GROUP BY g.label) e
CROSS JOIN (SELECT unnest(['Ridge', 'HistGBR']) AS model_family) m WHERE train_rows >= 1000 AND val_rows >= 1000""",
    """fold_base AS (
  SELECT f.label, f.val_start, f.val_end, avg(bedrooms) AS mu, stddev_pop(bedrooms) AS sd, avg(history_price) AS ybar, count(*) AS n
  FROM labelled f JOIN clean c ON c.history_date < f.val_start GROUP BY f.label, f.val_start, f.val_end)""",
    """fold_fit AS (
  SELECT b.label, b.val_start, b.val_end, b.mu, b.sd, b.ybar, b.n,
         sum((c.bedrooms-b.mu)/b.sd * (c.history_price-b.ybar)) AS sxy, sum(pow((c.bedrooms-b.mu)/b.sd, 2)) AS sxx
  FROM fold_base b JOIN clean c ON c.history_date < b.val_start GROUP BY ALL)"""))
def wf_status(spark, sf_dir):
    """Ridge refitted on every fold; a family that can't be fitted keeps its row without an error."""
    q = Inputs(spark, sf_dir, COLUMNS)
    found = walkforward.walk_forward(
        q.clean, walk_forward_folds(q.clean), [learners.ridge(), learners.boosted_trees(max_dim=0)],
        policy.FeatureSpec(("bedrooms",), ()))
    return rounded(found, 2)


@query(twin("""
SELECT 'nightly' AS run_name, key, value FROM (
  SELECT 'target' AS key, 'history_price' AS value
  UNION ALL SELECT 'date_axis', 'history_date'
  UNION ALL SELECT 'split_policy', 'calendar_fair_70_10_20_by_time_span'
  UNION ALL SELECT 'primary_metric', 'test_rmse'
  UNION ALL SELECT concat('artifact.', split), concat(count(*), ' rows') FROM sp GROUP BY split) m"""))
def manifest(spark, sf_dir):
    """The manifest of a run, written as JSON and read back."""
    q = Inputs(spark, sf_dir, KEYS)
    sizes = {r["split"]: f"{r['count']} rows" for r in q.split.groupBy("split").count().collect()}  # three rows
    path = write_manifest(run_manifest(spark, "nightly", sizes), q.workspace.path("manifest"))
    return spark.read.schema("run_name string, key string, value string").json(path)


@query(twin("""
SELECT 'complete' AS scan, CAST(count(*) AS VARCHAR) AS outcome FROM sales
UNION ALL SELECT 'incomplete', 'missing required columns: history_date, country'"""))
def required_columns(spark, sf_dir):
    """A scan that meets the schema contract, and one refused before it starts a job."""
    sales = fixtures.sales(spark, sf_dir)
    wanted = ["history_price", "history_date", "country"]
    complete = require_columns(sales, wanted[:2]).agg(
        F.lit("complete").alias("scan"), F.count(F.lit(1)).cast("string").alias("outcome"))
    try:
        require_columns(sales.drop("history_date"), wanted)
    except ValueError as error:
        return complete.unionByName(complete.limit(1).select(F.lit("incomplete").alias("scan"), F.lit(str(error)).alias("outcome")))
    raise AssertionError("an incomplete scan passed")
