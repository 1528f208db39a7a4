from __future__ import annotations

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import features, parsing
from tidemark.operators import clean, policy
from tidemark.operators.metrics import regression_metrics
from tidemark.operators.temporal import fit_calendar_split


@pytest.mark.parametrize("text, want", [
    ("12", 12.0), (" 12 ", 12.0), ("1e3", 1000.0), ("-.5", -0.5), ("NaN", None), ("abc", None), ("", None),
    ("1,000", None), ("12d", None), ("0x10", None), ("inf", math.inf), ("-Infinity", -math.inf), (None, None)])
def test_parse_number(spark, text, want):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(parsing.parse_number(F.col("c"))).first()[0] == want


@pytest.mark.parametrize("text, want", [
    ("2020-01-02", datetime(2020, 1, 2)), ("2020-1-2", datetime(2020, 1, 2)), ("02/01/2020", None), ("bad", None)])
def test_parse_instant(spark, text, want):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(parsing.parse_instant(F.col("c"))).first()[0] == want


def test_parse_instant_extra_format(spark):
    df = spark.createDataFrame([("02/01/2020",), ("2020-05-06",)], "c string")
    got = [r[0] for r in df.select(parsing.parse_instant(F.col("c"), ["dd/MM/yyyy"])).collect()]
    assert got == [datetime(2020, 1, 2), datetime(2020, 5, 6)]


def test_column_name_with_dot(spark):
    df = spark.createDataFrame([("7", float("nan"))], "`a.b` string, `c.d` double")
    row = df.select(parsing.double_of(df, "a.b"), parsing.double_of(df, "c.d"), parsing.col_or_null(df, "zz")).first()
    assert list(row) == [7.0, None, None]


def test_dedup_keeps_first_and_treats_null_keys_as_equal(spark):
    rows = [(5, None, "d", 1.0), (3, None, "d", 1.0), (4, "x", "d", 1.0), (9, "x", "d", 1.0), (1, "x", "e", 1.0)]
    df = spark.createDataFrame(rows, "row_id int, fullAddress string, history_date string, history_price double")
    assert sorted(r.row_id for r in clean.dedup_keep_first(df).collect()) == [1, 3, 4]
    assert clean.dedup_keep_first(df.drop("fullAddress")).count() == 5


def test_dedup_limits_rows_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "a", "d", 1.0)], "row_id int, fullAddress string, history_date string, history_price double")
    plan = clean.dedup_keep_first(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_clip_is_idempotent_and_keeps_null(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)] + [(None,)], "history_price double")
    bounds = clean.fit_quantile_clip(df)
    assert (bounds.lo, bounds.hi) == (1.0, 99.0)
    once = clean.apply_clip(df, bounds)
    twice = clean.apply_clip(once, bounds)
    assert once.exceptAll(twice).isEmpty()
    assert once.where("history_price IS NULL").count() == 1
    iqr = clean.fit_iqr_clip(df)
    assert (iqr.lo, iqr.hi) == (25 - 75, 75 + 75)


def test_clip_with_a_condition_leaves_other_rows(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False)], "history_price double, train boolean")
    got = clean.apply_clip(df, clean.ClipBounds(2.0, None), where=F.col("train")).collect()
    assert {r.train: r.history_price for r in got} == {True: 2.0, False: 1.0}


def test_policy_comparison_matches_single_runs(spark, sales):
    rows = clean.drop_missing(sales)
    bounds = fit_calendar_split(rows)
    policies = {"none": clean.NO_CLIP, "quantile": clean.fit_quantile_clip(rows)}
    got = {r.policy: r.rmse for r in clean.compare_clip_policies(rows, policies, bounds).collect()}
    for name, limits in policies.items():
        clipped = clean.apply_clip(rows, limits)
        y = np.array([r[0] for r in clipped.where(bounds.rows_of("train")).select("history_price").collect()])
        val = clipped.where(bounds.rows_of("val")).select(
            F.lit("m").alias("model"), F.col("history_price").alias("y_true"), F.lit(float(np.median(y))).alias("y_pred"))
        assert got[name] == pytest.approx(regression_metrics(val, by=("model",)).first().rmse)


def test_ratios_and_rooms(spark):
    df = spark.createDataFrame(
        [(2.0, 0.0, None, 50.0), (None, None, None, 10.0), (4.0, 2.0, 1.0, None)],
        "bedrooms double, bathrooms double, livingRooms double, floorAreaSqM double")
    rows = features.with_ratios(features.with_rooms(df)).collect()
    got = [(r.total_rooms, r.floor_area_per_room, r.bed_bath_ratio, r.living_bed_ratio) for r in rows]
    assert got == [(2.0, 25.0, None, None), (0.0, None, None, None), (7.0, None, 2.0, 0.25)]


def test_features_without_optional_columns(spark):
    df = spark.createDataFrame([(1, "2020-05-06")], "row_id int, history_date string")
    row = features.with_features(clean.typed(df, numbers=())).first()
    assert (row.history_year, row.history_quarter, row.outcode, row.geo_radial) == (2020, 2, None, None)


@pytest.mark.parametrize("outcode, area", [("SW1A", "SW"), ("1A", None), (None, None), ("e14", "e")])
def test_outcode_area(spark, outcode, area):
    df = spark.createDataFrame([(outcode,)], "outcode string")
    assert features.with_location(df).first().outcode_area == area


WIDE = (
    "row_id bigint, fullAddress string, postcode string, outcode string, country string, bedrooms double, propertyType string,"
    " history_date timestamp_ntz, history_price double, history_percentageChange double, history_numericChange double,"
    " saleEstimate_lowerPrice double, saleEstimate_confidenceLevel string, `saleEstimate_valueChange.numericChange` double,"
    " saleEstimate_ingestedAt string, rentEstimate_currentPrice double, history_year string, flag boolean")


def test_feature_policies(spark):
    schema = spark.createDataFrame([], WIDE).schema
    main = policy.mainline_policy(schema)
    assert main.numeric == ("bedrooms", "history_year", "flag") and main.categorical == ("propertyType",)
    assisted = policy.assisted_policy(schema)
    assert assisted.numeric == ("bedrooms", "saleEstimate_lowerPrice", "rentEstimate_currentPrice", "flag")
    assert assisted.categorical == ("propertyType", "saleEstimate_confidenceLevel", "history_year")
    narrow = policy.assisted_policy(schema, rent_estimates=False, vendor_categories=False)
    assert "rentEstimate_currentPrice" not in narrow.columns and "saleEstimate_confidenceLevel" not in narrow.columns
    with pytest.raises(ValueError, match="forbidden"):
        policy.assert_mainline(assisted)


def test_date_profile_moves_offsets_to_utc(spark):
    from tidemark.operators.profile import date_profile

    rows = spark.createDataFrame([("2020-01-01T00:00:00+05:00",), ("2020-01-01 00:00:00",), ("2020-03-01",), (None,)], "d string")
    got = date_profile(rows, ["d", "absent"]).first()
    assert (got.non_null, got.distinct_values, str(got.min_date), str(got.max_date)) == (3, 3, "2019-12-31 19:00:00", "2020-03-01 00:00:00")
    assert date_profile(rows, ["absent"]).collect() == []


def test_boolean_columns_are_numbers(spark):
    from tidemark.functions.parsing import double_of

    rows = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r[0] for r in rows.select(double_of(rows, "b")).collect()] == [1.0, 0.0, None]
