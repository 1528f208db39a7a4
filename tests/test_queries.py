"""A cross-section of the registered queries against DuckDB.

``python -m tests.compare <sf_dir>`` checks all of them.
"""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences
from tests.conftest import SF_SMALL, SF_TINY
from tidemark.plans import catalog

SAMPLE = (
    "model_naive", "src_scan", "upsert_predictions", "profile_missing", "profile_log_hist", "clean_dedup",
    "clean_clip_quantile", "feat_ratios", "split_calendar", "wf_members", "prep_onehot", "metric_mae_rmse", "leaderboard",
    "segment_metrics", "bin_edges", "bin_report", "external_benchmark", "early_stop", "even_sample", "gov_decision",
)
#: These need folds of 1000 rows, or a segment that fails, which the smallest scale does not have.
NEED_ROWS = (
    "wf_eval", "wf_status", "wf_support", "wf_stability", "wf_winner", "wf_fold_winner", "gov_gates", "gov_stability", "gov_blockers",
    "report_facts",
)


@pytest.fixture(scope="module")
def duck():
    return connect(SF_SMALL)


@pytest.fixture(scope="module")
def tiny_duck():
    return connect(SF_TINY)


@pytest.mark.parametrize("name", SAMPLE + NEED_ROWS)
def test_query_matches_its_twin(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    assert differences(df, duck, entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - {*SAMPLE, *NEED_ROWS}))
def test_every_twin_at_the_smallest_scale(spark, tiny_duck, name):
    assert differences(catalog.queries()[name](spark, SF_TINY), tiny_duck, catalog.oracle_sql()[name]) == []


def test_entry(spark):
    assert {r.split for r in entry.entry(spark).collect()} == {"train", "val", "test"}


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 85


def test_survey_golden(spark):
    """The documented flagship numbers at this scale."""
    got = {r.split: (r.n_rows, r.mae, r.rmse, r.r2, r.mape, r.within_10pct_rate)
           for r in entry.queries()["model_naive"](spark, SF_SMALL).collect()}
    assert got == {
        "train": (10210, 89651.5157, 112699.1056, -0.0176, 0.8735, 0.1341),
        "val": (1566, 89353.8162, 113023.4292, -0.0122, 0.8674, 0.1437),
        "test": (2967, 88480.3311, 112127.1354, -0.0156, 0.8418, 0.1422)}


def test_early_stop_golden_with_events_as_epochs(spark):
    from tidemark.operators import history
    from tidemark.plans.fixtures import table

    rows = table(spark, SF_SMALL, "events").selectExpr(
        "event_type AS run_id", "value AS val_rmse",
        "cast(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS int) AS epoch")
    got = {r.run_id: (r.best_epoch, r.stop_epoch) for r in history.early_stop(rows, chunk=500).collect()}
    assert got == {"click": (4, 14), "error": (9, 19), "purchase": (11, 21), "signup": (10, 20), "view": (1, 11)}
