"""A whole evaluation run as one library call.

Each task reads the clean table and writes its result tables; the report task
reads whatever result tables exist.  Tasks can run alone, together, or in
separate sessions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bands, compare, diagnostics, governance, history, importance, learners, metrics
from tidemark.operators import policy, walkforward
from tidemark.operators.clean import clean_transactions
from tidemark.operators.temporal import (
    SplitBounds, assert_temporal_purity, assign_split, bounds_table, fit_calendar_split, walk_forward_folds)
from tidemark.sources.records import publish_snapshot, run_manifest, utc_stamp, write_manifest
from tidemark.sources.tables import read_optional, read_transactions, write_clean, write_table
from tidemark.workspace import Workspace

TASKS = ("baseline", "walk_forward", "benchmark", "assisted", "report")
SEGMENTS = ("outcode_area", "propertyType", "price_band")

# Third-party estimate columns that serve as benchmarks.
VENDOR_COLUMNS = ("saleEstimate_currentPrice", "saleEstimate_lowerPrice", "saleEstimate_upperPrice")
# Result tables that a frozen snapshot holds.
PUBLISHED = (
    "model_results", "walk_forward", "external_benchmark", "assisted_results", "decision", "track_comparison",
    "segment_blockers", "bin_confusion", "bin_edges", "bin_report", "bin_summary", "loss_curve", "report_facts",
)


def default_families() -> list[learners.Learner]:
    return [learners.walk_forward_forest(), learners.ridge()]


@dataclass
class RunConfig:
    """Where to read, where to write and what to fit."""

    source: str
    output: str
    fmt: str = "csv"
    run_name: str = "baseline"
    models: Sequence[learners.Learner] = field(default_factory=learners.default_learners)
    assisted_models: Sequence[learners.Learner] = field(default_factory=learners.assisted_learners)
    fold_families: Sequence[learners.Learner] = field(default_factory=default_families)
    importance_model: str = "RandomForest"
    n_folds: int = 4
    fold_min_rows: int = 1000
    segment_min_rows: int = 50
    n_bins: int = 5
    thresholds: governance.Thresholds = field(default_factory=governance.Thresholds)
    publish_to: str | None = None
    csv_to: str | None = None


class Run:
    """State that the tasks of one run share: the clean table and its split."""

    def __init__(self, spark: SparkSession, config: RunConfig):
        self.spark, self.config = spark, config
        self.workspace = Workspace(spark)
        self.artifacts: dict[str, str] = {}
        self._clean: DataFrame | None = None
        self._bounds: SplitBounds | None = None

    @property
    def clean(self) -> DataFrame:
        """Written once, partitioned by year, and read back by every task."""
        if self._clean is None:
            raw = read_transactions(self.spark, self.config.source, self.config.fmt, infer=True)
            rows = clean_transactions(raw, self.workspace)
            path = write_clean(rows, f"{self.config.output}/clean")
            self.artifacts["clean"] = path
            self._clean = self.spark.read.schema(rows.schema).parquet(path)
        return self._clean

    @property
    def bounds(self) -> SplitBounds:
        if self._bounds is None:
            self._bounds = fit_calendar_split(self.clean)
            assert_temporal_purity(assign_split(self.clean, self._bounds))
            self.save("split_bounds", bounds_table(self.spark, self._bounds))
        return self._bounds

    def rows_of(self, split: str) -> DataFrame:
        return self.clean.where(self.bounds.rows_of(split, year="history_year"))

    def save(self, name: str, table: DataFrame) -> DataFrame:
        """Write a result table and return it as read back, so it is computed once."""
        path = write_table(table, self.config.output, name)
        self.artifacts[name] = path
        return self.spark.read.schema(table.schema).parquet(path)

    def load(self, name: str) -> DataFrame | None:
        return read_optional(self.spark, self.config.output, name)


def run_baseline(run: Run) -> None:
    """Leaderboard, predictions, importances and all diagnostics of the mainline."""
    config, spark = run.config, run.spark
    matrix = compare.prepare_matrix(run.clean, run.bounds, policy.mainline_policy(run.clean.schema))
    try:
        found = compare.compare_models(matrix, config.models)
        predictions = run.save("predictions", found.predictions)
        results = run.save("model_results", metrics.leaderboard(metrics.regression_metrics(predictions)))
        run.save("skipped", compare.skipped_table(spark, found.skipped))
        names = matrix.prep.feature_names
        model = found.models.get(config.importance_model)
        if model is not None:
            sample = run.workspace.stage(importance.even_sample(matrix.of("val"), run.workspace), "sample")
            run.save("feature_importance", importance.gain_importance(spark, model, names).unionByName(
                importance.permutation_importance(model, sample, names)))
        curves = {
            n: m for n, m in found.models.items() if hasattr(m, "evaluateEachIteration")}
        if curves:
            tables = [
                history.loss_curve(m, matrix.of("train")).withColumn("model", F.lit(n)) for n, m in curves.items()]
            run.save("loss_curve", tables[0] if len(tables) == 1 else _union(tables))
    finally:
        matrix.release()

    test = predictions.where("split = 'test'")
    run.save("test_rmse_by_year", metrics.error_by_year(test))
    edges = bands.fit_band_edges(run.rows_of("test"), "history_price")
    run.save("segment_metrics", metrics.segment_metrics(
        bands.assign_bands(test, edges), SEGMENTS, config.segment_min_rows))
    _diagnostics(run, test, diagnostics.best_model(results))
    write_manifest(run_manifest(spark, config.run_name, run.artifacts), f"{config.output}/manifest")


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def _diagnostics(run: Run, test: DataFrame, best: str) -> None:
    """Plot data and the binned view of the best model."""
    rows = test.where(F.col("model") == best)
    sample = run.save("scatter_sample", diagnostics.hash_sample(rows.select("row_id", "y_true", "y_pred"), 12_000))
    run.save("axis_limits", diagnostics.axis_limits(sample))
    run.save("residual_histogram", diagnostics.residual_histogram(test, best))
    edges = bands.fit_bin_edges(rows, "y_true", run.config.n_bins)
    n_bins = len(edges) - 1
    run.save("bin_edges", bands.bin_edges_table(run.spark, edges))
    cells = run.save("bin_confusion", diagnostics.confusion(diagnostics.assign_bins(rows, edges), n_bins))
    run.save("bin_report", diagnostics.bin_report(cells).drop("predicted", "hit"))
    run.save("bin_summary", diagnostics.bin_summary(cells, best, n_bins))


def run_walk_forward(run: Run) -> None:
    config = run.config
    scores = walkforward.walk_forward(
        run.clean, walk_forward_folds(run.clean, config.n_folds), config.fold_families,
        policy.mainline_policy(run.clean.schema), min_rows=config.fold_min_rows)
    run.save("walk_forward", walkforward.family_stability(scores))
    run.save("folds_won", walkforward.folds_won(scores))


def run_benchmark(run: Run) -> None:
    test = run.rows_of("test")
    scored = run.save("external_benchmark", metrics.benchmark_columns(test, VENDOR_COLUMNS))
    if scored.isEmpty():
        raise ValueError("no benchmark column has enough rows")


def run_assisted(run: Run) -> None:
    """The vendor-assisted track on the same split."""
    matrix = compare.prepare_matrix(run.clean, run.bounds, policy.assisted_policy(run.clean.schema))
    try:
        found = compare.compare_models(matrix, run.config.assisted_models)
        predictions = run.save("assisted_predictions", found.predictions)
    finally:
        matrix.release()
    wide = metrics.wide_results(metrics.regression_metrics(predictions))
    run.save("assisted_results", wide.select(
        "model", "val_mae", "val_rmse", "test_mae", "test_rmse").orderBy("test_rmse", "model"))


def run_report(run: Run) -> None:
    """Decision tables and report facts from the result tables that exist."""
    tracks = governance.Tracks(
        results=run.load("model_results"), walk_forward=run.load("walk_forward"),
        benchmark=run.load("external_benchmark"), assisted=run.load("assisted_results"),
        segments=run.load("segment_metrics"), bins=run.load("bin_summary"))
    bests, thresholds = governance.read_bests(tracks), run.config.thresholds
    for name, table in (
            ("track_comparison", governance.track_comparison(run.spark, bests)),
            ("decision", governance.decision(run.spark, bests))):
        if table is not None:
            run.save(name, table)
    run.save("release_gates", governance.release_gates(run.spark, tracks, bests, thresholds))
    if tracks.segments is not None and bests.primary is not None:
        run.save("segment_blockers", governance.blocker_actions(
            tracks.segments, bests.primary["model"], bests.score("primary"), thresholds))
    run.save("report_facts", governance.report_facts(run.spark, tracks, thresholds))
    if run.config.publish_to is not None:
        publish_snapshot(run.spark, run.config.output, run.config.publish_to, PUBLISHED, utc_stamp())
    if run.config.csv_to is not None:
        for name in PUBLISHED:
            table = run.load(name)
            if table is not None:
                write_table(table, run.config.csv_to, name, "csv")


_STEPS: dict[str, Callable[[Run], None]] = {
    "baseline": run_baseline, "walk_forward": run_walk_forward, "benchmark": run_benchmark,
    "assisted": run_assisted, "report": run_report,
}


def evaluate(spark: SparkSession, config: RunConfig, tasks: Sequence[str] = ()) -> dict[str, str]:
    """Run the chosen tasks, all of them by default; the report always follows.

    Returns the path of every table written.
    """
    unknown = set(tasks) - set(TASKS)
    if unknown:
        raise ValueError(f"unknown tasks: {', '.join(sorted(unknown))}")
    wanted = {*(tasks or TASKS), "report"}
    run = Run(spark, config)
    for task in TASKS:
        if task in wanted:
            _STEPS[task](run)
    return run.artifacts
