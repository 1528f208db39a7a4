from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark import workspace as ws
from tidemark.operators import governance, learners
from tidemark.plans import run
from tidemark.sources import records, tables, upserts


def write_csv(path, lines):
    path.write_text("\n".join(lines) + "\n")


def test_csv_row_ids_follow_file_order(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    # The later file is larger, so the scheduler would read it first.
    write_csv(folder / "a.csv", ["history_price,history_date,n"] + [f"{i},2020-01-01,{i}" for i in range(50)])
    write_csv(folder / "b.csv", ["history_price,history_date,n"] + [f"{i},2020-01-01,{i}" for i in range(50, 4000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = tables.read_transactions(spark, str(folder))
        rows = df.select("row_id", F.col("n").cast("int")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 4000 and all(r.row_id == r.n for r in rows)


def test_csv_missing_markers_and_inference(spark, tmp_path):
    path = tmp_path / "x.csv"
    write_csv(path, ["history_price,history_date,a,b,c,empty,flag,gap", '1,2020-01-01,NA,1.5,"say ""hi"", ok",,True,true', "2,bad,n/a,x,None,null,false,"])
    df = tables.read_transactions(spark, str(path), infer=True)
    assert dict(df.dtypes)["history_price"] == "double" and dict(df.dtypes)["b"] == "string"
    assert dict(df.dtypes)["a"] == dict(df.dtypes)["empty"] == "double"
    assert dict(df.dtypes)["flag"] == "boolean" and dict(df.dtypes)["gap"] == "string"
    got = df.orderBy("row_id").collect()
    assert [r.flag for r in got] == [True, False]
    assert [(r.row_id, r.a, r.b, r.c) for r in got] == [(0, None, "1.5", 'say "hi", ok'), (1, None, "x", None)]


def test_required_columns(spark, tmp_path):
    path = tmp_path / "x.csv"
    write_csv(path, ["history_price", "1"])
    with pytest.raises(ValueError, match="history_date"):
        tables.read_transactions(spark, str(path))


def test_optional_table(spark, tmp_path):
    assert tables.read_optional(spark, str(tmp_path), "nothing") is None
    tables.write_table(spark.range(3), str(tmp_path), "some")
    tables.write_table(spark.range(4), str(tmp_path), "some")
    assert tables.read_optional(spark, str(tmp_path), "some").count() == 4
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        tables.read_optional(spark, str(tmp_path), "broken").count()


def test_clean_table_prunes_by_year(spark, sales, tmp_path):
    from tidemark.functions.features import with_calendar

    path = tables.write_clean(with_calendar(sales), str(tmp_path / "clean"))
    df = spark.read.parquet(path)
    years = sorted(d for d in os.listdir(path) if d.startswith("history_year="))
    assert len(years) == sales.select(F.year("history_date")).distinct().count()
    plan = df.where("history_year = 1996")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(history_year" in plan
    assert df.count() == sales.count()


def test_split_and_fold_filters_prune_years(spark, sales, tmp_path):
    from tidemark.functions.features import with_calendar
    from tidemark.operators import temporal

    df = spark.read.parquet(tables.write_clean(with_calendar(sales), str(tmp_path / "clean")))
    bounds, folds = temporal.fit_calendar_split(df), temporal.walk_forward_folds(df)
    filters = [(bounds.rows_of(s), bounds.rows_of(s, year="history_year")) for s in temporal.SPLITS]
    filters += [(f.val_rows(), f.val_rows(year="history_year")) for f in folds]
    filters += [(f.train_rows(), f.train_rows(year="history_year")) for f in folds]
    for plain, pruned in filters:
        rows = df.where(pruned)
        assert df.where(plain).count() == rows.count()
        assert "PartitionFilters: [isnotnull(history_year" in rows._jdf.queryExecution().executedPlan().toString()


def test_upsert_rows(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "model string, test_rmse double")
    new = spark.createDataFrame([("b", 0.5, 7)], "model string, test_rmse double, extra int")
    got = upserts.sort_results(upserts.upsert_rows(base, new)).collect()
    assert [tuple(r) for r in got] == [("b", 0.5, 7), ("a", 1.0, None)]
    assert upserts.upsert_rows(None, new) is new


def test_upsert_predictions_without_a_name(spark):
    schema = "row_id int, model string, y_pred double"
    base = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, None, 1.0)], schema)
    new = spark.createDataFrame([(1, "a", 9.0), (1, None, 8.0)], schema)
    got = {r.model: r.y_pred for r in upserts.upsert_predictions(base, new).collect()}
    assert got == {"a": 9.0, "b": 1.0, None: 8.0}


def test_upsert_predictions(spark):
    schema = "row_id int, model string, y_pred double"
    base = spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (1, "b", 1.0), (2, "b", 1.0)], schema)
    new = spark.createDataFrame([(1, "b", 9.0), (2, "b", 9.0)], schema)
    got = {(r.row_id, r.model): r.y_pred for r in upserts.upsert_predictions(base, new).collect()}
    assert got == {(1, "a"): 1.0, (2, "a"): 1.0, (1, "b"): 9.0, (2, "b"): 9.0}
    # As many rows, but other ones: the old predictions are stale.
    moved = spark.createDataFrame([(1, "b", 9.0), (3, "b", 9.0)], schema)
    assert {r.model for r in upserts.upsert_predictions(base, moved).collect()} == {"b"}


def test_manifest_and_snapshot(spark, tmp_path):
    manifest = records.run_manifest(spark, "r1", {"results": "/x/results"})
    path = records.write_manifest(manifest, str(tmp_path / "manifest"))
    facts = {r.key: r.value for r in spark.read.json(path).collect()}
    assert facts["target"] == "history_price" and facts["artifact.results"] == "/x/results"
    tables.write_table(spark.range(2), str(tmp_path), "one")
    done = records.publish_snapshot(spark, str(tmp_path), str(tmp_path / "frozen"), ["one", "two"], "2026-01-01T00-00-00Z")
    assert done == ["one"]
    assert spark.read.parquet(str(tmp_path / "frozen" / "run_stamp=2026-01-01T00-00-00Z" / "one")).count() == 2
    index = records.snapshot_index(spark, done, "s").first()
    assert (index.name, index.published) == ("one", 1)


def test_staging_uses_the_checkpoint_folder(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert ws.shared_root(spark) == root
    space = ws.Workspace(spark)
    staged = space.stage(spark.range(7), "seven")
    assert staged.count() == space.rows["seven"] == 7
    assert staged.inputFiles()[0].startswith(f"file://{root}/run-")


class Session:
    """A session without a checkpoint folder."""

    def __init__(self, master):
        self.conf = self.sparkContext = self
        self.master, self.applicationId = master, "app-1"

    def get(self, key, default=None):
        return default

    def getConf(self):
        return self


def test_only_a_local_master_may_use_a_temporary_folder():
    first = ws.shared_root(Session("local[2]"))
    assert os.path.isdir(first) and ws.shared_root(Session("local[2]")) == first
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ws.shared_root(Session("yarn"))


# ---- decisions

# Published best scores of the tracks and their segments.
PRIMARY, BENCHMARK, ASSISTED = 393489.2706136952, 350168.20942803303, 304436.22230686987
SEGMENTS = [
    ("propertyType", "Semi-Detached Property", "HistGBR", 223, 1.0, 825627.4951889581),
    ("price_band", "(1000000.0, 4400000.0]", "HistGBR", 26061, 1.0, 768250.5869241105),
    ("propertyType", "Detached House", "HistGBR", 3733, 1.0, 746635.1696911864),
    ("propertyType", "Tiny", "HistGBR", 199, 1.0, 9e9), ("propertyType", "Other model", "Ridge", 9999, 1.0, 9e9),
    ("propertyType", "Fine", "HistGBR", 9999, 1.0, 1.8 * PRIMARY)]


def tracks(spark, assisted=ASSISTED, primary=PRIMARY):
    from tests.test_models import fold_table

    cells = ("model string, test_mae double, test_rmse double, test_rmse_improvement_vs_naive_pct double, test_r2 double,"
             " test_mape double, test_within_10pct_rate double")
    return governance.Tracks(
        results=spark.createDataFrame([("Ridge", 1.0, 9e9, 0.0, 0.0, 0.0, 0.0), ("HistGBR", 216082.64, primary, 57.58, 0.7197, 0.338, 0.2427)], cells),
        walk_forward=fold_table(spark),
        benchmark=spark.createDataFrame([("saleEstimate_lowerPrice", 130196, 105702.66, BENCHMARK)], "benchmark string, test_rows_used bigint, test_mae double, test_rmse double"),
        assisted=None if assisted is None else spark.createDataFrame([("AssistedHistGBR", 158399.33, assisted)], "model string, test_mae double, test_rmse double"),
        segments=spark.createDataFrame(SEGMENTS, "segment_type string, segment_value string, model string, rows bigint, mae double, rmse double"))


def test_published_decision(spark):
    bests = governance.read_bests(tracks(spark))
    row = governance.decision(spark, bests).first()
    assert row.delta_rmse == pytest.approx(43321.06118566217)
    assert (row.recommendation, row.governance_recommendation) == ("open_assisted_track", "deploy_assisted")
    compared = governance.track_comparison(spark, bests).first()
    assert compared.delta_assisted_vs_mainline_rmse == pytest.approx(-89053.04830682534)
    assert compared.preferred_track_rmse == "assisted"


@pytest.mark.parametrize("primary, assisted, want", [
    (100.0, 200.0, "deploy_mainline"), (100.0, 100.0, "deploy_mainline"), (400000.0, 360000.0, "pilot_assisted_only"),
    (100.0, None, "pilot_assisted_only"), (PRIMARY, BENCHMARK, "deploy_assisted")])
def test_decision_rules(spark, primary, assisted, want):
    bests = governance.read_bests(tracks(spark, assisted, primary))
    assert governance.decision(spark, bests).first().governance_recommendation == want


def test_published_gates_and_blockers(spark):
    found = tracks(spark)
    bests = governance.read_bests(found)
    gates = {r.gate: (r.passed, r.value) for r in governance.release_gates(spark, found, bests).collect()}
    assert gates["artifacts"] == (True, 1.0) and gates["primary_rmse"] == (True, PRIMARY)
    assert gates["walk_forward_cv"][0] and gates["walk_forward_cv"][1] == pytest.approx(24.39555021162072)
    assert gates["segment_rmse"] == (False, 3.0)
    gate = governance.segment_gate(found.segments, "HistGBR", PRIMARY).first()
    assert gate.threshold == pytest.approx(708280.687, abs=1e-3) and gate.failing == 3 and not gate.passed
    blockers = governance.blocker_actions(found.segments, "HistGBR", PRIMARY).collect()
    assert [(r.segment_value, r.status, r.action_owner, r.mitigation_plan) for r in blockers] == [
        ("Semi-Detached Property", "accept_with_business_signoff", "product_owner", "business_risk_acceptance"),
        ("(1000000.0, 4400000.0]", "mitigate_in_model", "ml_team", "segment_features_or_calibration"),
        ("Detached House", "mitigate_in_model", "ml_team", "segment_features_or_calibration")]


def test_report_of_an_empty_run(spark):
    facts = {(r.section, r.key): r.value for r in governance.report_facts(spark, governance.Tracks()).collect()}
    assert facts["baseline", "status"] == facts["walk_forward", "status"] == "not found"
    assert facts["gates", "artifacts"] == facts["gates", "segment_rmse"] == "FAIL"
    assert ("blockers", "segment_rmse") in facts and ("decision", "status") in facts


def test_report_facts(spark):
    facts = {(r.section, r.key): r.value for r in governance.report_facts(spark, tracks(spark)).collect()}
    assert facts["baseline", "best_model"] == "HistGBR" and facts["baseline", "test_rmse"] == "393489.27"
    assert facts["walk_forward", "RandomForest.cv_pct"] == "24.40" and facts["benchmark", "test_rows_used"] == "130196"
    assert facts["blockers", "propertyType:Detached House"] == "rmse=746635.17, rows=3733, mitigate_in_model"
    lone = {(r.section, r.key): r.value for r in governance.report_facts(spark, tracks(spark, assisted=None)).collect()}
    assert lone["tracks", "assisted_rmse"] == "n/a" and lone["assisted", "status"] == "not found"


# ---- whole runs


@pytest.fixture(scope="module")
def config(spark, sales, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    source = tables.write_table(sales.drop("row_id"), str(folder), "source", "csv")
    trees = {"max_depth": 3, "max_iter": 2, "min_samples_leaf": 5, "max_bins": 32}
    forest = {"n_estimators": 4, "max_depth": 4, "max_bins": 32}
    return run.RunConfig(
        source, str(folder / "out"), segment_min_rows=20, fold_min_rows=100,
        models=[learners.naive_median(), learners.boosted_trees(**trees), learners.random_forest(**forest), learners.ridge()],
        assisted_models=[learners.random_forest("AssistedRandomForest", **forest)],
        fold_families=[learners.random_forest(**forest), learners.ridge()], publish_to=str(folder / "frozen"), csv_to=str(folder / "csv"))


def test_whole_run(spark, config, sales):
    artifacts = run.evaluate(spark, config)
    assert {"clean", "model_results", "predictions", "feature_importance", "test_rmse_by_year", "segment_metrics",
            "bin_summary", "walk_forward", "external_benchmark", "assisted_results", "decision", "report_facts",
            "loss_curve", "release_gates", "segment_blockers"} <= set(artifacts)
    board = spark.read.parquet(artifacts["model_results"])
    assert board.count() == 4 and board.columns[0] == "model"
    assert spark.read.parquet(artifacts["clean"]).count() == sales.where("history_price IS NOT NULL").count()
    facts = {(r.section, r.key): r.value for r in spark.read.parquet(artifacts["report_facts"]).collect()}
    assert facts["gates", "artifacts"] == "PASS" and facts["baseline", "price_bins"] == "5"
    predictions = spark.read.parquet(artifacts["predictions"])
    assert predictions.groupBy("row_id", "model").count().where("count > 1").isEmpty()
    stamp = os.listdir(config.publish_to)
    assert len(stamp) == 1 and "model_results" in os.listdir(os.path.join(config.publish_to, stamp[0]))
    exported = spark.read.option("header", True).csv(os.path.join(config.csv_to, "model_results"))
    assert exported.columns == board.columns and exported.count() == 4
    manifest = [json.loads(r.value) for r in spark.read.text(f"{config.output}/manifest").collect()]
    assert "artifact.model_results" in {m["key"] for m in manifest}


def test_single_tasks(spark, config):
    assert set(run.evaluate(spark, config, ["report"])) >= {"report_facts", "release_gates"}
    with pytest.raises(ValueError, match="unknown"):
        run.evaluate(spark, config, ["everything"])
