"""Decision tables over metric tables (tens of rows, one job each)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.walkforward import family_stability

# Release thresholds.
MAX_PRIMARY_RMSE = 396614.68
MAX_FOLD_VARIATION_PCT = 26.0
SEGMENT_FACTOR = 1.8
SEGMENT_MIN_ROWS = 200
SIGNOFF_BELOW_ROWS = 500
WORST_SEGMENTS = 5
STABILITY_FAMILY = "RandomForest"


@dataclass(frozen=True)
class Thresholds:
    primary_rmse: float = MAX_PRIMARY_RMSE
    fold_variation_pct: float = MAX_FOLD_VARIATION_PCT
    segment_factor: float = SEGMENT_FACTOR
    segment_min_rows: int = SEGMENT_MIN_ROWS
    signoff_below_rows: int = SIGNOFF_BELOW_ROWS


@dataclass(frozen=True)
class Tracks:
    """Result tables of the tracks; None where a track was not run."""

    results: DataFrame | None = None
    walk_forward: DataFrame | None = None
    benchmark: DataFrame | None = None
    assisted: DataFrame | None = None
    segments: DataFrame | None = None
    bins: DataFrame | None = None


def best_row(results: DataFrame, score: str = "test_rmse", key: str = "model") -> DataFrame:
    """The row with the lowest score."""
    return results.where(F.col(score).isNotNull()).orderBy(score, key).limit(1)


@dataclass(frozen=True)
class Bests:
    """Best row of each track as plain values; None where there is none."""

    primary: Mapping | None
    benchmark: Mapping | None
    assisted: Mapping | None

    def score(self, track: str, metric: str = "test_rmse") -> float | None:
        row = getattr(self, track)
        return None if row is None else row[metric]


def read_bests(tracks: Tracks) -> Bests:
    def first(df: DataFrame | None, key: str = "model"):
        row = None if df is None else best_row(df, key=key).first()
        return None if row is None else row.asDict()

    return Bests(first(tracks.results), first(tracks.benchmark, "benchmark"), first(tracks.assisted))


def best_per_track(spark: SparkSession, bests: Bests) -> DataFrame:
    """(track, name, test_rmse, test_mae) of the tracks that have results."""
    rows = [
        (track, row["benchmark" if track == "benchmark" else "model"], row["test_rmse"], row["test_mae"])
        for track, row in (("mainline", bests.primary), ("benchmark", bests.benchmark), ("assisted", bests.assisted))
        if row is not None]
    return spark.createDataFrame(rows, "track string, name string, test_rmse double, test_mae double")


def _number(x: float | None) -> Column:
    return F.lit(x).cast("double")


def track_comparison(spark: SparkSession, bests: Bests) -> DataFrame | None:
    """Best scores side by side; needs the mainline and a benchmark."""
    if bests.primary is None or bests.benchmark is None:
        return None
    row = spark.range(1).select(
        _number(bests.score("primary")).alias("mainline_best_rmse"),
        _number(bests.score("primary", "test_mae")).alias("mainline_best_mae"),
        _number(bests.score("assisted")).alias("assisted_best_rmse"),
        _number(bests.score("assisted", "test_mae")).alias("assisted_best_mae"),
        _number(bests.score("benchmark")).alias("external_best_rmse"),
        _number(bests.score("benchmark", "test_mae")).alias("external_best_mae"))
    main, assisted, external = (F.col(f"{t}_best_rmse") for t in ("mainline", "assisted", "external"))
    return row.withColumns({
        "delta_assisted_vs_mainline_rmse": assisted - main,
        "delta_benchmark_vs_mainline_rmse": external - main,
        "preferred_track_rmse": F.when(assisted < main, "assisted").otherwise("mainline"),
    })


def decision(spark: SparkSession, bests: Bests) -> DataFrame | None:
    """What to do next; a missing assisted score ends in a pilot."""
    if bests.primary is None or bests.benchmark is None:
        return None
    row = spark.range(1).select(
        _number(bests.score("primary")).alias("best_primary_model_rmse"),
        _number(bests.score("benchmark")).alias("best_external_benchmark_rmse"),
        _number(bests.score("assisted")).alias("best_assisted_model_rmse"))
    primary, external, assisted = (F.col(c) for c in row.columns)
    governance = (
        F.when((assisted < primary) & (assisted <= external), "deploy_assisted")
        .when((primary <= assisted) & (primary <= external), "deploy_mainline")
        .otherwise("pilot_assisted_only"))
    return row.withColumns({
        "delta_rmse": primary - external,
        "recommendation": F.when(primary - external > 0, "open_assisted_track").otherwise("keep_primary_only"),
        "governance_recommendation": governance,
    })


def stability_summary(fold_metrics: DataFrame) -> DataFrame:
    """Folds, mean, deviation and variation per family."""
    return family_stability(fold_metrics).groupBy("model_family").agg(
        F.count("*").alias("folds"),
        *[F.max(c).alias(c) for c in ("rmse_mean", "rmse_std", "cv_pct")])


def gate_variation(fold_metrics: DataFrame, family: str = STABILITY_FAMILY) -> float | None:
    """Variation of the gate's family, or of the first family by name without it."""
    summary = stability_summary(fold_metrics)
    row = summary.orderBy(F.col("model_family") != family, "model_family").select("cv_pct").first()
    return None if row is None else row[0]


def critical_segments(
    segments: DataFrame, model: str, overall_rmse: float, thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """Well-supported segments of one model whose RMSE exceeds the limit."""
    return segments.where(
        (F.col("model") == model)
        & (F.col("rows") >= thresholds.segment_min_rows)
        & (F.col("rmse") > F.lit(thresholds.segment_factor * overall_rmse)))


def segment_gate(
    segments: DataFrame, model: str, overall_rmse: float, thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """One row: number of failing segments and the verdict."""
    failing = critical_segments(segments, model, overall_rmse, thresholds)
    return failing.agg(F.count("*").alias("failing")).select(
        F.lit(model).alias("model"),
        F.lit(thresholds.segment_factor * overall_rmse).alias("threshold"),
        "failing", (F.col("failing") == 0).alias("passed"))


def blocker_actions(
    segments: DataFrame, model: str, overall_rmse: float, thresholds: Thresholds = Thresholds(),
    k: int = WORST_SEGMENTS,
) -> DataFrame:
    """Who has to act on the worst failing segments; empty when the gate passes."""
    small = F.col("rows") < thresholds.signoff_below_rows
    worst = critical_segments(segments, model, overall_rmse, thresholds).orderBy(
        F.desc("rmse"), "segment_type", "segment_value").limit(k)
    return worst.select(
        "segment_type", "segment_value", "rows", "rmse",
        F.when(small, "accept_with_business_signoff").otherwise("mitigate_in_model").alias("status"),
        F.when(small, "product_owner").otherwise("ml_team").alias("action_owner"),
        F.when(small, "business_risk_acceptance").otherwise("segment_features_or_calibration")
        .alias("mitigation_plan"))


def _has_rows(df: DataFrame | None) -> bool:
    return df is not None and not df.isEmpty()


def release_gates(
    spark: SparkSession, tracks: Tracks, bests: Bests, thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """(gate, value, threshold, passed) for the four gates; missing input fails."""
    complete = all(t is not None for t in (tracks.results, tracks.walk_forward, tracks.benchmark))
    primary = bests.score("primary")
    variation = gate_variation(tracks.walk_forward) if _has_rows(tracks.walk_forward) else None
    failing = None
    if primary is not None and _has_rows(tracks.segments):
        failing = critical_segments(tracks.segments, bests.primary["model"], primary, thresholds).count()
    rows = [
        ("artifacts", float(complete), 1.0, complete),
        ("primary_rmse", primary, thresholds.primary_rmse,
         primary is not None and primary <= thresholds.primary_rmse),
        ("walk_forward_cv", variation, thresholds.fold_variation_pct,
         variation is not None and variation <= thresholds.fold_variation_pct),
        ("segment_rmse", None if failing is None else float(failing), 0.0, failing == 0),
    ]
    return spark.createDataFrame(rows, "gate string, value double, threshold double, passed boolean")


def _facts(df: DataFrame, section: str, columns: Mapping[str, tuple[str, str]], prefix: str | None = None) -> DataFrame:
    """(section, key, value) rows: one per listed column, formatted as text."""
    cells = []
    for key, (column, pattern) in columns.items():
        label = F.lit(key) if prefix is None else F.concat_ws(".", F.col(prefix).cast("string"), F.lit(key))
        value = F.col(column).cast("string") if pattern == "%s" else F.format_string(pattern, F.col(column))
        shown = F.when(F.col(column).isNull(), "n/a").otherwise(value)
        cells.append(F.struct(F.lit(section).alias("section"), label.alias("key"), shown.alias("value")))
    return df.select(F.inline(F.array(*cells)))


def _fact(spark: SparkSession, section: str, key: str, value: str) -> DataFrame:
    return spark.range(1).select(
        F.lit(section).alias("section"), F.lit(key).alias("key"), F.lit(value).alias("value"))


# What each section of the report shows, with its number format.
BASELINE_FACTS = {
    "best_model": ("model", "%s"),
    "test_rmse": ("test_rmse", "%.2f"),
    "test_mae": ("test_mae", "%.2f"),
    "improvement_vs_naive_pct": ("test_rmse_improvement_vs_naive_pct", "%.2f"),
    "test_r2": ("test_r2", "%.4f"),
    "test_mape": ("test_mape", "%.4f"),
    "test_within_10pct_rate": ("test_within_10pct_rate", "%.4f"),
}
BIN_FACTS = {
    "price_bins": ("n_bins", "%s"),
    "price_bin_accuracy": ("accuracy", "%.4f"),
    "price_bin_macro_f1": ("macro_f1", "%.4f"),
}
STABILITY_FACTS = {
    "folds": ("folds", "%s"),
    "rmse_mean": ("rmse_mean", "%.2f"),
    "rmse_std": ("rmse_std", "%.2f"),
    "cv_pct": ("cv_pct", "%.2f"),
}
BENCHMARK_FACTS = {
    "best_benchmark": ("benchmark", "%s"),
    "test_rmse": ("test_rmse", "%.2f"),
    "test_rows_used": ("test_rows_used", "%s"),
}
ASSISTED_FACTS = {
    "best_model": ("model", "%s"),
    "test_rmse": ("test_rmse", "%.2f"),
    "test_mae": ("test_mae", "%.2f"),
}
TRACK_FACTS = {
    "mainline_rmse": ("mainline_best_rmse", "%.2f"),
    "assisted_rmse": ("assisted_best_rmse", "%.2f"),
    "external_rmse": ("external_best_rmse", "%.2f"),
    "preferred_track": ("preferred_track_rmse", "%s"),
}
DECISION_FACTS = {
    "best_primary_rmse": ("best_primary_model_rmse", "%.2f"),
    "best_benchmark_rmse": ("best_external_benchmark_rmse", "%.2f"),
    "delta_rmse": ("delta_rmse", "%.2f"),
    "recommendation": ("recommendation", "%s"),
    "governance_recommendation": ("governance_recommendation", "%s"),
}


def _blocker_facts(
    spark: SparkSession, gates: DataFrame, tracks: Tracks, bests: Bests, thresholds: Thresholds
) -> list[DataFrame]:
    passed = {r["gate"]: (r["passed"], r["value"]) for r in gates.collect()}
    facts = []
    texts = {
        "artifacts": "missing one or more required result tables",
        "primary_rmse": f"primary RMSE above {thresholds.primary_rmse:.2f}",
        "walk_forward_cv": f"walk-forward variation above {thresholds.fold_variation_pct:g}%",
    }
    facts += [_fact(spark, "blockers", gate, text) for gate, text in texts.items() if not passed[gate][0]]
    verdict, failing = passed["segment_rmse"]
    if failing is None:
        facts.append(_fact(spark, "blockers", "segment_rmse", "missing segment metrics or primary RMSE"))
    elif not verdict:
        worst = blocker_actions(tracks.segments, bests.primary["model"], bests.score("primary"), thresholds)
        facts.append(worst.select(
            F.lit("blockers").alias("section"),
            F.concat_ws(":", "segment_type", "segment_value").alias("key"),
            F.format_string("rmse=%.2f, rows=%d, %s", "rmse", "rows", "status").alias("value")))
    return facts or [_fact(spark, "blockers", "none", "none")]


def report_facts(spark: SparkSession, tracks: Tracks, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """The whole report as tidy (section, key, value) facts."""
    bests = read_bests(tracks)
    facts = []

    def section(name: str, table: DataFrame | None, columns: Mapping, prefix: str | None = None) -> None:
        facts.append(_fact(spark, name, "status", "not found") if table is None
                     else _facts(table, name, columns, prefix))

    section("baseline", None if bests.primary is None else best_row(tracks.results), BASELINE_FACTS)
    if bests.primary is not None and tracks.bins is not None:
        section("baseline", tracks.bins, BIN_FACTS)
    folds = tracks.walk_forward if _has_rows(tracks.walk_forward) else None
    section("walk_forward", None if folds is None else stability_summary(folds), STABILITY_FACTS, "model_family")
    section("benchmark", None if bests.benchmark is None else best_row(tracks.benchmark, key="benchmark"),
            BENCHMARK_FACTS)
    section("assisted", None if bests.assisted is None else best_row(tracks.assisted), ASSISTED_FACTS)
    compared = track_comparison(spark, bests)
    if compared is not None:
        section("tracks", compared, TRACK_FACTS)
    section("decision", decision(spark, bests), DECISION_FACTS)
    gates = release_gates(spark, tracks, bests, thresholds)
    facts.append(gates.select(
        F.lit("gates").alias("section"), F.col("gate").alias("key"),
        F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("value")))
    facts += _blocker_facts(spark, gates, tracks, bests, thresholds)
    return reduce(lambda a, b: a.unionByName(b), facts)
