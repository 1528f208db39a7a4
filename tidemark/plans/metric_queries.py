"""Queries over predictions and metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bands, diagnostics, governance, metrics, walkforward
from tidemark.plans import fixtures
from tidemark.plans.inputs import DRAWN_MODEL, KEYS, SCORED, Inputs
from tidemark.plans.model_queries import _BOARD
from tidemark.plans.oracles import twin
from tidemark.plans.registry import query, rounded

# ---- metrics -----------------------------------------------------------


def _metrics(spark, sf_dir, *columns: str):
    found = metrics.regression_metrics(Inputs(spark, sf_dir, SCORED).predictions())
    return rounded(found.select("model", "split", *columns))


@query(twin("SELECT model, split, n_rows, round(mae,4) AS mae, round(rmse,4) AS rmse FROM metrics"))
def metric_mae_rmse(spark, sf_dir):
    return _metrics(spark, sf_dir, "n_rows", "mae", "rmse")


@query(twin("SELECT model, split, round(r2,4) AS r2 FROM metrics"))
def metric_r2(spark, sf_dir):
    return _metrics(spark, sf_dir, "r2")


@query(twin("SELECT model, split, round(mape,4) AS mape, round(within_10pct_rate,4) AS within_10pct_rate FROM metrics"))
def metric_mape_within(spark, sf_dir):
    return _metrics(spark, sf_dir, "mape", "within_10pct_rate")


@query(twin("""
SELECT model, round(test_rmse,4) AS test_rmse, round(test_rmse_improvement_vs_naive_pct,4) AS test_rmse_improvement_vs_naive_pct
FROM board"""))
def metric_uplift(spark, sf_dir):
    wide = metrics.wide_results(metrics.regression_metrics(Inputs(spark, sf_dir, SCORED).predictions()))
    return rounded(metrics.with_uplift(wide.select("model", "test_rmse")))


@query(twin(f"SELECT {_BOARD} FROM board"))
def leaderboard(spark, sf_dir):
    """Every model arrives twice; the later, worse run of a name is ignored."""
    first = metrics.regression_metrics(Inputs(spark, sf_dir, SCORED).predictions()).withColumn("arrival", F.lit(1))
    again = first.withColumns({"arrival": F.lit(2), "rmse": F.col("rmse") * 2})
    return rounded(metrics.leaderboard(first.unionByName(again), arrival="arrival"))


@query(twin("""
SELECT model, CAST(year(history_date) AS INTEGER) AS year, round(sqrt(avg((y_true-y_pred)*(y_true-y_pred))),4) AS rmse
FROM test GROUP BY 1, 2"""))
def err_by_year(spark, sf_dir):
    return rounded(metrics.error_by_year(Inputs(spark, sf_dir, SCORED).predictions("test")))


def _banded(q: Inputs):
    edges = bands.fit_band_edges(q.rows_of("test"), "history_price", rows=q.size)
    return bands.assign_bands(q.predictions("test"), edges)


@query(twin("SELECT row_id, price_band FROM banded WHERE model = 'NaiveMedian'"))
def band_quantile(spark, sf_dir):
    return _banded(Inputs(spark, sf_dir, SCORED)).where("model = 'NaiveMedian'").select("row_id", "price_band")


@query(twin("""
SELECT segment_type, segment_value, model, "rows", round(mae,4) AS mae, round(rmse,4) AS rmse FROM segments"""))
def segment_metrics(spark, sf_dir):
    return rounded(metrics.segment_metrics(
        _banded(Inputs(spark, sf_dir, SCORED)), ["outcode_area", "propertyType", "price_band"]))


@query(twin("""
SELECT benchmark, test_rows_used, round(test_mae,4) AS test_mae, round(test_rmse,4) AS test_rmse FROM benchmark_rows"""))
def external_benchmark(spark, sf_dir):
    return rounded(metrics.benchmark_columns(Inputs(spark, sf_dir, SCORED).rows_of("test"), fixtures.ESTIMATES))


# ---- diagnostics -------------------------------------------------------


@query(twin("""
SELECT row_id, model, round(y_true,6) AS y_true, round(y_pred,6) AS y_pred, round(y_true-y_pred,6) AS residual
FROM test WHERE model = (SELECT model FROM board ORDER BY test_rmse, model LIMIT 1)"""))
def residuals(spark, sf_dir):
    q = Inputs(spark, sf_dir, SCORED)
    rows = q.workspace.stage(q.predictions(), "predictions")
    best = diagnostics.best_model(metrics.leaderboard(metrics.regression_metrics(rows)))
    kept = diagnostics.residuals(rows, best).where("split = 'test' AND y_pred IS NOT NULL")
    return rounded(kept.select("row_id", "model", "y_true", "y_pred", "residual"), 6)


@query(twin("""
SELECT row_id, round(y_true,6) AS y_true, round(y_pred,6) AS y_pred FROM test WHERE model = 'saleEstimate_currentPrice'
ORDER BY md5(concat('42:', CAST(row_id AS VARCHAR))), row_id LIMIT 12000"""))
def scatter_sample(spark, sf_dir):
    """The feature is the sample size: 12,000 points for a plot."""
    rows = Inputs(spark, sf_dir, SCORED).predictions("test").where(
        (F.col("model") == DRAWN_MODEL) & F.col("y_pred").isNotNull())
    return rounded(diagnostics.hash_sample(rows.select("row_id", "y_true", "y_pred"), 12_000), 6)


@query(twin("""
SELECT round(least(min(y_true), min(y_pred)), 6) AS axis_min, round(greatest(max(y_true), max(y_pred)), 6) AS axis_max
FROM test WHERE model = 'saleEstimate_currentPrice'"""))
def scatter_limits(spark, sf_dir):
    rows = Inputs(spark, sf_dir, SCORED).predictions("test").where(
        (F.col("model") == DRAWN_MODEL) & F.col("y_pred").isNotNull())
    return rounded(diagnostics.axis_limits(rows), 6)


@query(twin("""
SELECT CAST(i AS INTEGER) AS bin, round(lo + i*((hi-lo)/60), 4) AS edge_left, round(lo + (i+1)*((hi-lo)/60), 4) AS edge_right, count(b.bin) AS n
FROM range(0, 60) AS r(i) CROSS JOIN lg LEFT JOIN b ON b.bin = i GROUP BY i, lo, hi""",
    "x AS (SELECT y_true - y_pred AS v FROM test WHERE model = 'saleEstimate_currentPrice')",
    "lg AS (SELECT min(v) AS lo, max(v) AS hi FROM x)",
    "b AS (SELECT least(CAST(floor((v - lo)/((hi-lo)/60)) AS BIGINT), 59) AS bin FROM x CROSS JOIN lg)"))
def residual_hist(spark, sf_dir):
    q = Inputs(spark, sf_dir, SCORED)
    return rounded(diagnostics.residual_histogram(q.predictions("test"), DRAWN_MODEL))


def _edges(q: Inputs, **options) -> list[float]:
    return bands.fit_bin_edges(q.rows_of("test"), "history_price", **options)


def _binned(q: Inputs, edges):
    rows = q.predictions("test").where((F.col("model") == DRAWN_MODEL) & F.col("y_pred").isNotNull())
    return diagnostics.assign_bins(rows, edges)


@query(twin("""
SELECT CAST(l.k AS INTEGER) AS bin_index, round(l.edge, 6) AS edge_left, round(r.edge, 6) AS edge_right
FROM edge l JOIN edge r ON r.k = l.k + 1"""))
def bin_edges(spark, sf_dir):
    return rounded(bands.bin_edges_table(spark, _edges(Inputs(spark, sf_dir, KEYS), leaf_rows=500)), 6)


@query(twin("SELECT row_id, true_bin, pred_bin FROM binned"))
def bin_assign(spark, sf_dir):
    q = Inputs(spark, sf_dir, SCORED)
    return _binned(q, _edges(q)).select("row_id", "true_bin", "pred_bin")


def _cells(spark, sf_dir):
    q = Inputs(spark, sf_dir, SCORED)
    edges = _edges(q)
    n_bins = len(edges) - 1
    return diagnostics.confusion(_binned(q, edges), n_bins), n_bins


@query(twin("SELECT true_bin, pred_bin, n FROM cells"))
def bin_confusion(spark, sf_dir):
    return _cells(spark, sf_dir)[0]


@query(twin("SELECT true_bin, " + ", ".join(
    f"CAST(sum(CASE WHEN pred_bin = {j} THEN n ELSE 0 END) AS BIGINT) AS pred_bin_{j}" for j in range(5))
    + " FROM cells GROUP BY true_bin"))
def bin_confusion_wide(spark, sf_dir):
    return diagnostics.confusion_wide(*_cells(spark, sf_dir))


@query(twin("""
SELECT bin, round("precision",6) AS "precision", round(recall,6) AS recall, round(f1,6) AS f1, support FROM scores"""))
def bin_report(spark, sf_dir):
    return rounded(diagnostics.bin_report(_cells(spark, sf_dir)[0]).drop("predicted", "hit"), 6)


@query(twin("""
SELECT 'saleEstimate_currentPrice' AS model, CAST(5 AS INTEGER) AS n_bins, round(sum(hit)/sum(support),6) AS accuracy,
       round(avg(f1),6) AS macro_f1, round(sum(f1*support)/sum(support),6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support
FROM scores WHERE support + predicted > 0"""))
def bin_summary(spark, sf_dir):
    cells, n_bins = _cells(spark, sf_dir)
    return rounded(diagnostics.bin_summary(cells, DRAWN_MODEL, n_bins), 6)


# ---- decisions ---------------------------------------------------------

#: Low enough that the fixture has failing segments.
LOOSE = governance.Thresholds(segment_factor=1.05)


def _tracks(q: Inputs, *parts: str) -> governance.Tracks:
    """The named result tables, staged because each is read several times."""
    make = {
        "results": q.mainline,
        "walk_forward": q.fold_metrics,
        "benchmark": lambda: metrics.benchmark_columns(q.rows_of("test"), fixtures.ESTIMATES),
        "assisted": q.assisted,
        "segments": lambda: metrics.segment_metrics(_banded(q), ["outcode_area", "propertyType", "price_band"]),
    }
    return governance.Tracks(**{p: q.workspace.stage(make[p](), p) for p in parts})


_ALL = ("results", "walk_forward", "benchmark", "assisted", "segments")


@query(twin("""
SELECT 'mainline' AS track, model AS name, round(test_rmse,4) AS test_rmse, round(test_mae,4) AS test_mae FROM bm
UNION ALL SELECT 'benchmark', benchmark, round(test_rmse,4), round(test_mae,4) FROM be
UNION ALL SELECT 'assisted', model, round(test_rmse,4), round(test_mae,4) FROM ba"""))
def gov_best(spark, sf_dir):
    tracks = _tracks(Inputs(spark, sf_dir, SCORED), "results", "benchmark", "assisted")
    return rounded(governance.best_per_track(spark, governance.read_bests(tracks)))


@query(twin("""
SELECT round(bm.test_rmse,4) AS mainline_best_rmse, round(bm.test_mae,4) AS mainline_best_mae, round(ba.test_rmse,4) AS assisted_best_rmse,
       round(ba.test_mae,4) AS assisted_best_mae, round(be.test_rmse,4) AS external_best_rmse, round(be.test_mae,4) AS external_best_mae,
       round(ba.test_rmse-bm.test_rmse,4) AS delta_assisted_vs_mainline_rmse, round(be.test_rmse-bm.test_rmse,4) AS delta_benchmark_vs_mainline_rmse,
       CASE WHEN ba.test_rmse < bm.test_rmse THEN 'assisted' ELSE 'mainline' END AS preferred_track_rmse
FROM bm CROSS JOIN be CROSS JOIN ba"""))
def gov_track_comparison(spark, sf_dir):
    tracks = _tracks(Inputs(spark, sf_dir, SCORED), "results", "benchmark", "assisted")
    return rounded(governance.track_comparison(spark, governance.read_bests(tracks)))


_DECISION = """decided AS (
  SELECT bm.test_rmse AS p, be.test_rmse AS e, ba.test_rmse AS a,
         CASE WHEN bm.test_rmse - be.test_rmse > 0 THEN 'open_assisted_track' ELSE 'keep_primary_only' END AS recommendation,
         CASE WHEN ba.test_rmse < bm.test_rmse AND ba.test_rmse <= be.test_rmse THEN 'deploy_assisted'
              WHEN bm.test_rmse <= ba.test_rmse AND bm.test_rmse <= be.test_rmse THEN 'deploy_mainline'
              ELSE 'pilot_assisted_only' END AS governance_recommendation
  FROM bm CROSS JOIN be CROSS JOIN ba)"""


@query(twin("""
SELECT round(p,4) AS best_primary_model_rmse, round(e,4) AS best_external_benchmark_rmse, round(a,4) AS best_assisted_model_rmse,
       round(p-e,4) AS delta_rmse, recommendation, governance_recommendation FROM decided""", _DECISION))
def gov_decision(spark, sf_dir):
    tracks = _tracks(Inputs(spark, sf_dir, SCORED), "results", "benchmark", "assisted")
    return rounded(governance.decision(spark, governance.read_bests(tracks)))


_GATES = """gates AS (
  SELECT 'artifacts' AS gate, CAST(1 AS DOUBLE) AS value, CAST(1 AS DOUBLE) AS threshold, true AS passed
  UNION ALL SELECT 'primary_rmse', test_rmse, CAST(396614.68 AS DOUBLE), test_rmse <= 396614.68 FROM bm
  UNION ALL SELECT 'walk_forward_cv', v, CAST(26 AS DOUBLE), v <= 26 FROM (
    SELECT max(cv_pct) AS v FROM stability WHERE model_family = (SELECT min(model_family) FROM stability)) s
  UNION ALL SELECT 'segment_rmse', CAST(count(*) AS DOUBLE), CAST(0 AS DOUBLE), count(*) = 0 FROM critical)"""


@query(twin("SELECT gate, round(value,4) AS value, threshold, passed FROM gates", _GATES))
def gov_gates(spark, sf_dir):
    tracks = _tracks(Inputs(spark, sf_dir, SCORED), *_ALL)
    return rounded(governance.release_gates(spark, tracks, governance.read_bests(tracks), LOOSE))


@query(twin("""
SELECT bm.model, round(1.05*bm.test_rmse,4) AS threshold, (SELECT count(*) FROM critical) AS failing,
       (SELECT count(*) FROM critical) = 0 AS passed FROM bm"""))
def gov_segment_gate(spark, sf_dir):
    tracks = _tracks(Inputs(spark, sf_dir, SCORED), "results", "segments")
    best = governance.read_bests(tracks).primary
    return rounded(governance.segment_gate(tracks.segments, best["model"], best["test_rmse"], LOOSE))


_WORST = """worst AS (
  SELECT segment_type, segment_value, "rows", rmse,
         CASE WHEN "rows" < 500 THEN 'accept_with_business_signoff' ELSE 'mitigate_in_model' END AS status,
         CASE WHEN "rows" < 500 THEN 'product_owner' ELSE 'ml_team' END AS action_owner,
         CASE WHEN "rows" < 500 THEN 'business_risk_acceptance' ELSE 'segment_features_or_calibration' END AS mitigation_plan
  FROM critical ORDER BY rmse DESC, segment_type, segment_value LIMIT 5)"""


@query(twin("SELECT segment_type, segment_value, \"rows\", round(rmse,4) AS rmse, status, action_owner, mitigation_plan FROM worst", _WORST))
def gov_blockers(spark, sf_dir):
    tracks = _tracks(Inputs(spark, sf_dir, SCORED), "results", "segments")
    best = governance.read_bests(tracks).primary
    return rounded(governance.blocker_actions(tracks.segments, best["model"], best["test_rmse"], LOOSE))


@query(twin("""
SELECT model_family, count(*) AS folds, round(max(rmse_mean),4) AS rmse_mean, round(max(rmse_std),4) AS rmse_std, round(max(cv_pct),4) AS cv_pct
FROM stability GROUP BY model_family"""))
def gov_stability(spark, sf_dir):
    return rounded(governance.stability_summary(Inputs(spark, sf_dir, KEYS).fold_metrics()))


def _fact_rows(source: str, section: str, facts, prefix: str = "") -> str:
    """SQL rows of one report section, from its list of facts."""
    rows = []
    for key, (column, pattern) in facts.items():
        value = f"CAST({column} AS VARCHAR)" if pattern == "%s" else f"printf('{pattern}', {column})"
        name = f"concat({prefix}, '.{key}')" if prefix else f"'{key}'"
        rows.append(f"SELECT '{section}' AS section, {name} AS key, coalesce({value}, 'n/a') AS value FROM {source}")
    return "\nUNION ALL ".join(rows)


@query(twin("\nUNION ALL ".join([
    _fact_rows("bm", "baseline", governance.BASELINE_FACTS),
    _fact_rows("folded", "walk_forward", governance.STABILITY_FACTS, "model_family"),
    _fact_rows("be", "benchmark", governance.BENCHMARK_FACTS),
    _fact_rows("ba", "assisted", governance.ASSISTED_FACTS),
    _fact_rows("tracked", "tracks", governance.TRACK_FACTS),
    _fact_rows("decided_named", "decision", governance.DECISION_FACTS),
    "SELECT 'gates', gate, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END FROM gates",
    "SELECT 'blockers', concat(segment_type, ':', segment_value), printf('rmse=%.2f, rows=%d, %s', rmse, \"rows\", status) FROM worst",
]), _DECISION, _GATES, _WORST,
    "folded AS (SELECT model_family, count(*) AS folds, max(rmse_mean) AS rmse_mean, max(rmse_std) AS rmse_std, max(cv_pct) AS cv_pct FROM stability GROUP BY model_family)",
    """tracked AS (SELECT p AS mainline_best_rmse, a AS assisted_best_rmse, e AS external_best_rmse,
  CASE WHEN a < p THEN 'assisted' ELSE 'mainline' END AS preferred_track_rmse FROM decided)""",
    """decided_named AS (SELECT p AS best_primary_model_rmse, e AS best_external_benchmark_rmse, p - e AS delta_rmse,
  recommendation, governance_recommendation FROM decided)"""))
def report_facts(spark, sf_dir):
    return governance.report_facts(spark, _tracks(Inputs(spark, sf_dir, SCORED), *_ALL), LOOSE)


@query(twin("""
SELECT fold, arg_min(model_family, rmse) AS winner FROM fold_metrics GROUP BY fold"""))
def wf_fold_winner(spark, sf_dir):
    return walkforward.fold_winners(Inputs(spark, sf_dir, KEYS).fold_metrics())
