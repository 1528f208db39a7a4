"""Queries over sources, profiles, cleaning, features, splits and preprocessing."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.functions import features
from tidemark.operators import clean, fold_states, policy, prep, profile, temporal
from tidemark.operators.metrics import regression_metrics
from tidemark.plans import fixtures
from tidemark.plans.inputs import KEYS, SCORED, Inputs
from tidemark.plans.oracles import twin
from tidemark.plans.registry import query, rounded
from tidemark.sources import records, tables, upserts, versions

# ---- sources and sinks -------------------------------------------------


@query(twin("""
SELECT row_id, fullAddress, history_date, CAST(nullif(history_price, 'n/a') AS DOUBLE) AS history_price FROM dirty"""))
def src_scan(spark, sf_dir):
    """Text scan with missing markers; the file is written from the tables first."""
    q = Inputs(spark, sf_dir)
    path = tables.write_table(q.dirty, q.workspace.root, "dirty", "csv")
    return clean.typed(tables.read_transactions(spark, path), dates=()).select(
        "row_id", "fullAddress", "history_date", "history_price")


@query("""
SELECT name, found, n_rows FROM (
  SELECT 'orders' AS name, true AS found, (SELECT count(*) FROM orders) AS n_rows
  UNION ALL SELECT 'lineitem', true, (SELECT count(*) FROM lineitem)
  UNION ALL SELECT 'not_there', false, CAST(0 AS BIGINT)) t""")
def src_optional(spark, sf_dir):
    rows = []
    for name in ("orders", "lineitem", "not_there"):
        found = tables.read_optional(spark, sf_dir, f"{name}.parquet")
        counted = spark.range(0) if found is None else found
        rows.append(counted.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("name"), F.lit(found is not None).alias("found"), "n_rows"))
    return profile.union_all(rows)


@query(twin("""
SELECT row_id, history_date, round(history_price, 6) AS history_price, total_rooms, outcode_area FROM clean"""))
def sink_roundtrip(spark, sf_dir):
    q = Inputs(spark, sf_dir, (*KEYS, "outcode", "bedrooms", "bathrooms", "livingRooms"))
    tables.write_table(q.clean, q.workspace.root, "clean")
    back = tables.read_optional(spark, q.workspace.root, "clean")
    return rounded(back.select("row_id", "history_date", "history_price", "total_rooms", "outcode_area"), 6)


@query(twin("""
SELECT history_year, count(*) AS n_rows, round(sum(history_price), 2) AS total_price
FROM clean GROUP BY history_year"""))
def write_clean(spark, sf_dir):
    """Year-partitioned clean table, read back whole."""
    q = Inputs(spark, sf_dir, KEYS)
    path = tables.write_clean(q.clean, q.workspace.path("clean-by-year"))
    years = spark.read.parquet(path)
    return rounded(years.groupBy("history_year").agg(
        F.count("*").alias("n_rows"), F.sum("history_price").alias("total_price")), 2)


@query(twin("""
SELECT '2026-01-01T00-00-00Z' AS run_stamp, history_year, count(*) AS n_rows FROM clean GROUP BY history_year"""))
def publish_snapshot(spark, sf_dir):
    """A frozen copy of one result table; names that do not exist are skipped."""
    q = Inputs(spark, sf_dir, KEYS)
    stamp, frozen = "2026-01-01T00-00-00Z", q.workspace.path("frozen")
    tables.write_table(q.clean.groupBy("history_year").agg(F.count("*").alias("n_rows")), q.workspace.root, "by_year")
    names = records.publish_snapshot(spark, q.workspace.root, frozen, ["by_year", "not_there"], stamp)
    copies = [
        spark.read.parquet(f"{frozen}/run_stamp={stamp}/{n}").select(F.lit(stamp).alias("run_stamp"), "*") for n in names]
    return profile.union_all(copies)


@query(twin("""
SELECT model, n_rows, round(rmse, 4) AS rmse FROM metrics
WHERE split = 'test' AND model IN ('NaiveMedian', 'saleEstimate_lowerPrice')
UNION ALL
SELECT model, n_rows, round(rmse, 4) FROM metrics
WHERE split = 'val' AND model IN ('saleEstimate_currentPrice', 'saleEstimate_upperPrice')"""))
def upsert_rows(spark, sf_dir):
    scores = regression_metrics(Inputs(spark, sf_dir, SCORED).predictions()).select("model", "split", "n_rows", "rmse")
    base = scores.where("split = 'test' AND model IN ('NaiveMedian', 'saleEstimate_lowerPrice', 'saleEstimate_currentPrice')")
    new = scores.where("split = 'val' AND model IN ('saleEstimate_currentPrice', 'saleEstimate_upperPrice')")
    return rounded(upserts.upsert_rows(base, new).drop("split"))


@query(twin("""
SELECT row_id, model, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred FROM preds
WHERE split = 'test' AND model IN ('NaiveMedian', 'saleEstimate_lowerPrice')
UNION ALL
SELECT row_id, 'saleEstimate_currentPrice', round(y_true, 6), round(y_pred, 6) FROM preds
WHERE split = 'test' AND model = 'RoomRate'"""))
def upsert_predictions(spark, sf_dir):
    q = Inputs(spark, sf_dir, SCORED)
    rows = q.workspace.stage(q.predictions("test").select("row_id", "model", "y_true", "y_pred"), "predictions")
    base = rows.where("model IN ('NaiveMedian', 'saleEstimate_lowerPrice', 'saleEstimate_currentPrice')")
    new = rows.where("model = 'RoomRate'").withColumn("model", F.lit("saleEstimate_currentPrice"))
    return rounded(upserts.upsert_predictions(base, new), 6)


@query(twin("""
SELECT row_id, model, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred FROM preds WHERE model = 'RoomRate'"""))
def upsert_predictions_stale(spark, sf_dir):
    """The stored predictions cover other rows, so none of them survives."""
    q = Inputs(spark, sf_dir, SCORED)
    rows = q.workspace.stage(q.predictions().select("row_id", "split", "model", "y_true", "y_pred"), "predictions")
    base = rows.where("split = 'test' AND model IN ('NaiveMedian', 'saleEstimate_lowerPrice')").drop("split")
    return rounded(upserts.upsert_predictions(base, rows.where("model = 'RoomRate'").drop("split")), 6)


@query(twin("""
SELECT row_id, CASE WHEN model = 'RoomRate' THEN NULL ELSE model END AS model, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred FROM preds
WHERE split = 'test' AND model IN ('NaiveMedian', 'saleEstimate_lowerPrice', 'RoomRate')"""))
def upsert_predictions_null_name(spark, sf_dir):
    """New rows without a model name replace only old rows without one."""
    q = Inputs(spark, sf_dir, SCORED)
    rows = q.workspace.stage(q.predictions("test").select("row_id", "model", "y_true", "y_pred"), "predictions")
    base = rows.where("model IN ('NaiveMedian', 'saleEstimate_lowerPrice')")
    new = rows.where("model = 'RoomRate'").withColumn("model", F.lit(None).cast("string"))
    return rounded(upserts.upsert_predictions(base, new), 6)


@query(twin("""
SELECT 1 AS version, row_id, model, round(y_pred, 6) AS y_pred FROM preds
WHERE split = 'test' AND model IN ('NaiveMedian', 'saleEstimate_lowerPrice')
UNION ALL
SELECT 2, row_id, CASE WHEN model = 'RoomRate' THEN 'NaiveMedian' ELSE model END, round(y_pred, 6) FROM preds
WHERE split = 'test' AND model IN ('RoomRate', 'saleEstimate_lowerPrice')
UNION ALL
SELECT 3, row_id, CASE WHEN model = 'RoomRate' THEN 'NaiveMedian' ELSE model END, round(y_pred, 6) FROM preds
WHERE split = 'test' AND model IN ('RoomRate', 'saleEstimate_lowerPrice', 'saleEstimate_upperPrice')"""))
def upsert_versions(spark, sf_dir):
    """A stored prediction table after its first write and two upserts; every version stays readable."""
    q = Inputs(spark, sf_dir, SCORED)
    rows = q.workspace.stage(q.predictions("test").select("row_id", "model", "y_pred"), "predictions")
    stored = versions.VersionedTable(spark, q.workspace.path("stored"))
    stored.publish(rows.where("model IN ('NaiveMedian', 'saleEstimate_lowerPrice')"))
    stored.upsert_predictions(rows.where("model = 'RoomRate'").withColumn("model", F.lit("NaiveMedian")))
    stored.upsert_predictions(rows.where("model = 'saleEstimate_upperPrice'"))
    return rounded(profile.union_all([
        stored.read(n).select(F.lit(n).alias("version"), "row_id", "model", "y_pred") for n in sorted(stored.versions())]), 6)


# ---- profiles ----------------------------------------------------------

_SALES_COLUMNS = (
    ("row_id", "bigint"), ("fullAddress", "string"), ("outcode", "string"), ("postcode", "string"),
    ("latitude", "double"), ("longitude", "double"), ("bedrooms", "double"), ("bathrooms", "double"),
    ("livingRooms", "double"), ("floorAreaSqM", "double"), ("propertyType", "string"),
    ("saleEstimate_lowerPrice", "double"), ("saleEstimate_currentPrice", "double"),
    ("saleEstimate_upperPrice", "double"), ("history_date", "timestamp_ntz"), ("history_price", "double"))


@query(twin("\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(100*avg(CASE WHEN {c} IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS missing_pct FROM sales"
    for c, _ in _SALES_COLUMNS)))
def profile_missing(spark, sf_dir):
    return rounded(profile.missing_profile(Inputs(spark, sf_dir).sales), 6)


@query(twin("\nUNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null, count(*) AS \"rows\" FROM sales"
    for i, (c, t) in enumerate(_SALES_COLUMNS))))
def profile_schema(spark, sf_dir):
    return profile.schema_profile(Inputs(spark, sf_dir).sales)


@query(twin("""
SELECT 'history_date' AS column_name, count(history_date) AS non_null, count(DISTINCT history_date) AS distinct_values,
       min(history_date) AS min_date, max(history_date) AS max_date FROM parsed"""))
def profile_dates(spark, sf_dir):
    return profile.date_profile(
        Inputs(spark, sf_dir).dirty, ["history_date", "saleEstimate_ingestedAt", "saleEstimate_valueChange.saleDate"])


@query(twin("""
SELECT count(CASE WHEN history_date IS NOT NULL AND history_price IS NOT NULL THEN 1 END) AS rows_with_both,
       count(*) AS total_rows FROM sales"""))
def profile_coverage(spark, sf_dir):
    return profile.coverage(Inputs(spark, sf_dir).sales)


@query(twin("SELECT count(DISTINCT history_date) AS distinct_values FROM sales"))
def profile_distinct(spark, sf_dir):
    return profile.distinct_count(Inputs(spark, sf_dir).sales, "history_date")


@query(twin("""
SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS duplicate_rows,
       CAST(sum(n - 1) AS BIGINT) AS removable_rows
FROM (SELECT count(*) AS n FROM dirty GROUP BY fullAddress, history_date, history_price) g"""))
def profile_duplicates(spark, sf_dir):
    return profile.duplicate_membership(Inputs(spark, sf_dir).dirty, clean.DEDUP_KEY)


@query(twin("""
SELECT CAST(i AS INTEGER) AS bin, round(lo + i*((hi-lo)/50), 4) AS edge_left, round(lo + (i+1)*((hi-lo)/50), 4) AS edge_right,
       count(b.bin) AS n
FROM range(0, 50) AS r(i) CROSS JOIN lg LEFT JOIN b ON b.bin = i GROUP BY i, lo, hi""",
    "x AS (SELECT ln(1 + history_price) AS v FROM sales WHERE history_price IS NOT NULL)",
    "lg AS (SELECT min(v) AS lo, max(v) AS hi FROM x)",
    "b AS (SELECT least(CAST(floor((v - lo)/((hi-lo)/50)) AS BIGINT), 49) AS bin FROM x CROSS JOIN lg)"))
def profile_log_hist(spark, sf_dir):
    q = Inputs(spark, sf_dir)
    return rounded(profile.log_histogram(q.workspace.stage(q.sales.select("history_price"), "prices")))


@query(twin("""
SELECT split, count(*) AS n_rows, round(100*count(*)/CAST((SELECT count(*) FROM sp) AS DOUBLE), 2) AS row_pct
FROM sp GROUP BY split"""))
def profile_split_share(spark, sf_dir):
    return profile.split_profile(Inputs(spark, sf_dir, KEYS).split)


# ---- cleaning ----------------------------------------------------------


@query(twin("SELECT * FROM parsed"))
def clean_parse(spark, sf_dir):
    return clean.typed(Inputs(spark, sf_dir).dirty)


@query(twin("SELECT * FROM parsed WHERE history_date IS NOT NULL AND history_price IS NOT NULL"))
def clean_dropna(spark, sf_dir):
    return clean.drop_missing(clean.typed(Inputs(spark, sf_dir).dirty))


@query(twin("""
SELECT row_id, fullAddress, history_date, history_price FROM (
  SELECT *, row_number() OVER (PARTITION BY fullAddress, history_date, history_price ORDER BY row_id) AS rn
  FROM parsed WHERE history_date IS NOT NULL AND history_price IS NOT NULL) k WHERE rn = 1"""))
def clean_dedup(spark, sf_dir):
    return clean.deduplicated(Inputs(spark, sf_dir).dirty)


@query(twin("SELECT row_id, round(history_price, 6) AS history_price FROM clean"))
def clean_clip_quantile(spark, sf_dir):
    rows = Inputs(spark, sf_dir, KEYS).deduplicated
    return rounded(clean.apply_clip(rows, clean.fit_quantile_clip(rows)).select("row_id", "history_price"), 6)


@query(twin("""
SELECT row_id, round(least(greatest(history_price, q1 - 1.5*(q3-q1)), q3 + 1.5*(q3-q1)), 6) AS history_price
FROM dd CROSS JOIN (SELECT quantile_cont(history_price, 0.25) AS q1, quantile_cont(history_price, 0.75) AS q3 FROM dd) q"""))
def clean_clip_iqr(spark, sf_dir):
    rows = Inputs(spark, sf_dir, KEYS).deduplicated
    return rounded(clean.apply_clip(rows, clean.fit_iqr_clip(rows)).select("row_id", "history_price"), 6)


@query(twin("""
SELECT row_id, round(CASE WHEN epoch_us(history_date) <= c1 THEN least(greatest(history_price, ql), qh) ELSE history_price END, 6) AS history_price
FROM dd CROSS JOIN cuts CROSS JOIN tq""",
    """tq AS (SELECT quantile_cont(history_price, 0.01) AS ql, quantile_cont(history_price, 0.99) AS qh
  FROM dd CROSS JOIN cuts WHERE epoch_us(history_date) <= c1)"""))
def clean_clip_train_only(spark, sf_dir):
    """Leak-safe variant: limits from train rows, evaluation labels untouched."""
    rows = Inputs(spark, sf_dir, KEYS).deduplicated
    train = temporal.fit_calendar_split(rows).rows_of("train")
    clipped = clean.apply_clip(rows, clean.fit_quantile_clip(rows.where(train)), where=train)
    return rounded(clipped.select("row_id", "history_price"), 6)


@query(twin("""
SELECT policy, count(*) AS n_rows, round(avg(abs(y-p)),4) AS mae, round(sqrt(avg((y-p)*(y-p))),4) AS rmse,
       round(1 - sum((y-p)*(y-p))/nullif(var_pop(y)*count(*),0),4) AS r2,
       round(avg(CASE WHEN abs(y)>100 THEN abs((y-p)/y) END),4) AS mape,
       round(avg(CASE WHEN abs(y)>100 THEN CASE WHEN abs((y-p)/y) < 0.10 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END),4) AS within_10pct_rate
FROM (SELECT policy, y, (SELECT median(t.y) FROM policies t WHERE t.policy = policies.policy AND t.split = 'train') AS p
      FROM policies WHERE split = 'val') v GROUP BY policy""",
    """policies AS (
  SELECT policy, CASE WHEN epoch_us(history_date) <= c1 THEN 'train' WHEN epoch_us(history_date) <= c2 THEN 'val' ELSE 'test' END AS split, y
  FROM (SELECT 'none' AS policy, history_date, history_price AS y FROM dd
        UNION ALL SELECT 'quantile', history_date, least(greatest(history_price, ql), qh) FROM dd CROSS JOIN qb
        UNION ALL SELECT 'iqr', history_date, least(greatest(history_price, q1 - 1.5*(q3-q1)), q3 + 1.5*(q3-q1)) FROM dd
          CROSS JOIN (SELECT quantile_cont(history_price, 0.25) AS q1, quantile_cont(history_price, 0.75) AS q3 FROM dd) q) u
  CROSS JOIN cuts)"""))
def clean_policy_compare(spark, sf_dir):
    rows = Inputs(spark, sf_dir, KEYS).deduplicated
    policies = {"none": clean.NO_CLIP, "quantile": clean.fit_quantile_clip(rows), "iqr": clean.fit_iqr_clip(rows)}
    return rounded(clean.compare_clip_policies(rows, policies, temporal.fit_calendar_split(rows)))


# ---- features ----------------------------------------------------------


@query(twin("""
SELECT row_id, CAST(year(history_date) AS INTEGER) AS history_year, CAST(month(history_date) AS INTEGER) AS history_month,
       CAST(quarter(history_date) AS INTEGER) AS history_quarter FROM sales"""))
def feat_calendar(spark, sf_dir):
    return features.with_calendar(Inputs(spark, sf_dir).sales).select(
        "row_id", "history_year", "history_month", "history_quarter")


@query(twin("SELECT row_id, coalesce(bedrooms,0) + coalesce(bathrooms,0) + coalesce(livingRooms,0) AS total_rooms FROM sales"))
def feat_rooms(spark, sf_dir):
    return features.with_rooms(Inputs(spark, sf_dir).sales).select("row_id", "total_rooms")


@query(twin("""
SELECT row_id, round(floorAreaSqM / nullif(coalesce(bedrooms,0) + coalesce(bathrooms,0) + coalesce(livingRooms,0), 0), 6) AS floor_area_per_room,
       round(bedrooms / nullif(bathrooms, 0), 6) AS bed_bath_ratio, round(livingRooms / nullif(bedrooms, 0), 6) AS living_bed_ratio
FROM sales"""))
def feat_ratios(spark, sf_dir):
    rows = features.with_ratios(features.with_rooms(Inputs(spark, sf_dir).sales))
    return rounded(rows.select("row_id", "floor_area_per_room", "bed_bath_ratio", "living_bed_ratio"), 6)


@query(twin("""
SELECT row_id, round(sqrt(pow(latitude - CAST(51.5074 AS DOUBLE), 2) + pow(longitude + CAST(0.1278 AS DOUBLE), 2)), 6) AS geo_radial
FROM sales"""))
def feat_geo_radial(spark, sf_dir):
    return rounded(features.with_geo_radial(Inputs(spark, sf_dir).sales).select("row_id", "geo_radial"), 6)


@query(twin("""
SELECT row_id, outcode, postcode, nullif(regexp_extract(outcode, '^([A-Za-z]+)', 1), '') AS outcode_area FROM sales"""))
def feat_outcode_area(spark, sf_dir):
    return features.with_location(Inputs(spark, sf_dir).sales).select("row_id", "outcode", "postcode", "outcode_area")


@query(twin("""
SELECT row_id, round(ln(1 + history_price), 6) AS log_price, round(exp(ln(1 + history_price)) - 1, 4) AS back FROM sales"""))
def feat_log_target(spark, sf_dir):
    rows = Inputs(spark, sf_dir).sales.select("row_id", F.log1p("history_price").alias("log_price"))
    back = F.round(F.expm1("log_price"), 4)
    return rows.select("row_id", F.round("log_price", 6).alias("log_price"), back.alias("back"))


_MAINLINE_SQL = """latitude, longitude, bedrooms, bathrooms, livingRooms, floorAreaSqM, history_year, history_month,
       history_quarter, total_rooms, round(floor_area_per_room, 8) AS floor_area_per_room, round(bed_bath_ratio, 8) AS bed_bath_ratio,
       round(living_bed_ratio, 8) AS living_bed_ratio, round(geo_radial, 8) AS geo_radial, propertyType, outcode_area"""


@query(twin(f"SELECT row_id, {_MAINLINE_SQL} FROM clean"))
def policy_mainline(spark, sf_dir):
    rows = Inputs(spark, sf_dir).clean
    return rounded(rows.select("row_id", *policy.mainline_policy(rows.schema).columns), 8)


@query(twin(f"""
SELECT row_id, saleEstimate_lowerPrice, saleEstimate_currentPrice, saleEstimate_upperPrice, {_MAINLINE_SQL} FROM clean"""))
def policy_assisted(spark, sf_dir):
    rows = Inputs(spark, sf_dir).clean
    return rounded(rows.select("row_id", *policy.assisted_policy(rows.schema).columns), 8)


# ---- splits and folds --------------------------------------------------


@query(twin("SELECT row_id, split FROM sp"))
def split_calendar(spark, sf_dir):
    return Inputs(spark, sf_dir, KEYS).split.select("row_id", "split")


@query(twin("""
SELECT *, train_max <= val_min AND val_max <= test_min AS pure FROM (
  SELECT min(CASE WHEN split='train' THEN history_date END) AS train_min, max(CASE WHEN split='train' THEN history_date END) AS train_max,
         min(CASE WHEN split='val' THEN history_date END) AS val_min, max(CASE WHEN split='val' THEN history_date END) AS val_max,
         min(CASE WHEN split='test' THEN history_date END) AS test_min, max(CASE WHEN split='test' THEN history_date END) AS test_max
  FROM sp) r"""))
def split_purity(spark, sf_dir):
    return temporal.split_ranges(Inputs(spark, sf_dir, KEYS).split)


@query(twin("""
SELECT make_timestamp(lo) AS t_min, make_timestamp(hi) AS t_max, make_timestamp(c1) AS cut_train_end, make_timestamp(c2) AS cut_val_end
FROM cuts"""))
def split_bounds(spark, sf_dir):
    return temporal.bounds_table(spark, Inputs(spark, sf_dir, KEYS).bounds)


@query(twin("SELECT fold, val_start, val_end, label FROM labelled"))
def wf_folds(spark, sf_dir):
    return temporal.folds_table(spark, temporal.walk_forward_folds(Inputs(spark, sf_dir, KEYS).clean))


@query(twin("""
SELECT row_id, fold, CASE WHEN history_date < val_start THEN 'train' ELSE 'val' END AS role
FROM clean JOIN folds ON history_date < val_end"""))
def wf_members(spark, sf_dir):
    rows = Inputs(spark, sf_dir, KEYS).clean
    return temporal.fold_members(rows.select("row_id", "history_date"), temporal.walk_forward_folds(rows)).drop("history_date")


@query(twin("""
SELECT fold, label, train_rows, val_rows FROM (
  SELECT fold, label, count(CASE WHEN history_date < val_start THEN 1 END) AS train_rows,
         count(CASE WHEN history_date >= val_start THEN 1 END) AS val_rows
  FROM labelled JOIN clean ON history_date < val_end GROUP BY fold, label) s
WHERE train_rows >= 1000 AND val_rows >= 1000"""))
def wf_support(spark, sf_dir):
    rows = Inputs(spark, sf_dir, KEYS).clean
    return temporal.fold_support(rows, temporal.walk_forward_folds(rows))


def _fold_numbers(column: str) -> str:
    return f"""
SELECT f.fold, '{column}' AS name, round(m, 4) AS median, round(avg(coalesce({column}, m)), 4) AS mean,
       round(coalesce(nullif(stddev_pop(coalesce({column}, m)), 0), 1), 4) AS scale, CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS INTEGER) AS n_values
FROM folds f JOIN clean c ON c.history_date < f.val_start
JOIN (SELECT g.fold, median({column}) AS m FROM folds g JOIN clean c ON c.history_date < g.val_start GROUP BY g.fold) s ON s.fold = f.fold
GROUP BY f.fold, m"""


_FOLD_NUMBERS = ("bedrooms", "floorAreaSqM", "saleEstimate_lowerPrice")


@query(twin(" UNION ALL ".join(_fold_numbers(c) for c in _FOLD_NUMBERS) + """
UNION ALL
SELECT fold, 'propertyType', NULL, NULL, NULL, value, CAST(n_values AS INTEGER) FROM (
  SELECT fold, value, row_number() OVER (PARTITION BY fold ORDER BY n DESC, value) AS rn, count(*) OVER (PARTITION BY fold) AS n_values FROM (
    SELECT f.fold, c.propertyType AS value, count(*) AS n FROM folds f JOIN clean c ON c.history_date < f.val_start
    WHERE c.propertyType IS NOT NULL GROUP BY f.fold, c.propertyType)) WHERE rn = 1"""))
def wf_fold_stats(spark, sf_dir):
    """Train medians, scales and modes of every fold from one set of slice states."""
    q = Inputs(spark, sf_dir, (*KEYS, *_FOLD_NUMBERS, "propertyType"))
    folds = temporal.walk_forward_folds(q.clean)
    found = fold_states.fold_statistics(q.clean, folds, policy.FeatureSpec(_FOLD_NUMBERS, ("propertyType",)), rows=q.size)
    rows = []
    for fold, s in zip(folds, found, strict=True):
        rows += [(fold.fold, c, s.medians[c], *s.scaler[c], None, None) for c in s.medians]
        rows += [(fold.fold, c, None, None, None, s.modes[c], len(s.categories[c])) for c in s.modes]
    return rounded(spark.createDataFrame(
        rows, "fold int, name string, median double, mean double, scale double, mode string, n_values int"))


# ---- preprocessing -----------------------------------------------------

_IMPUTED = ("floorAreaSqM", "saleEstimate_lowerPrice", "saleEstimate_currentPrice", "saleEstimate_upperPrice")


@query(twin("SELECT row_id, " + ", ".join(
    f"round(coalesce({c}, (SELECT median({c}) FROM train)), 6) AS {c}" for c in _IMPUTED) + " FROM clean"))
def prep_median_impute(spark, sf_dir):
    q = Inputs(spark, sf_dir, (*KEYS, *_IMPUTED))
    medians = prep.fit_medians(q.rows_of("train"), _IMPUTED, rows=q.size)
    return rounded(prep.impute(q.clean, medians).select("row_id", *_IMPUTED), 6)


_LOCATED = (*KEYS, "bedrooms", "livingRooms", "floorAreaSqM", "latitude", "longitude", "propertyType")
_SCALED = ("bedrooms", "floorAreaSqM", "geo_radial", "living_bed_ratio")


@query(twin("SELECT row_id, " + ", ".join(
    f"round((coalesce({c}, m_{c}) - (SELECT avg(coalesce({c}, m_{c})) FROM train CROSS JOIN med))"
    f" / (SELECT coalesce(nullif(stddev_pop(coalesce({c}, m_{c})), 0), 1) FROM train CROSS JOIN med), 6) AS {c}" for c in _SCALED)
    + " FROM clean CROSS JOIN med",
    "med AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in _SCALED) + " FROM train)"))
def prep_standard_scale(spark, sf_dir):
    q = Inputs(spark, sf_dir, _LOCATED)
    train = q.rows_of("train")
    medians = prep.fit_medians(train, _SCALED, rows=q.size)
    scaled = prep.standardize(prep.impute(q.clean, medians), prep.fit_scaler(train, medians))
    return rounded(scaled.select("row_id", *_SCALED), 6)


_MODE = "(SELECT {c} FROM train WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(twin("SELECT row_id, " + ", ".join(
    f"coalesce({c}, {_MODE.format(c=c)}) AS {c}" for c in ("propertyType", "outcode")) + " FROM clean"))
def prep_mode_impute(spark, sf_dir):
    q = Inputs(spark, sf_dir, (*KEYS, "outcode", "propertyType"))
    modes, _ = prep.fit_categories(q.rows_of("train"), ["propertyType", "outcode"])
    filled = [F.coalesce(c, F.lit(m)).alias(c) for c, m in modes.items()]
    return q.clean.select("row_id", *filled)


def _fitted(q: Inputs, spec: policy.FeatureSpec) -> prep.Preprocessor:
    return prep.fit_preprocessor(q.rows_of("train"), spec, rows=q.size)


@query(twin(f"""
SELECT row_id, concat('propertyType_', v) AS category, CAST(1 AS DOUBLE) AS value FROM (
  SELECT row_id, coalesce(propertyType, {_MODE.format(c='propertyType')}) AS v FROM clean) p
WHERE v IN (SELECT propertyType FROM train)
UNION ALL
SELECT row_id, concat('outcode_', v), CAST(1 AS DOUBLE) FROM (
  SELECT row_id, coalesce(outcode, {_MODE.format(c='outcode')}) AS v FROM clean) o
WHERE v IN (SELECT outcode FROM train)"""))
def prep_onehot(spark, sf_dir):
    """Non-zero one-hot cells; a value unseen in train gives none."""
    q = Inputs(spark, sf_dir, (*KEYS, "outcode", "propertyType"))
    fitted = _fitted(q, policy.FeatureSpec((), ("propertyType", "outcode")))
    cells = F.arrays_zip(F.array(*[F.lit(n) for n in fitted.feature_names]).alias("category"),
                         vector_to_array("features").alias("value"))
    hot = F.filter(cells, lambda c: c["value"] != 0)
    return fitted.transform(q.clean).select("row_id", F.inline(hot))


_MATRIX = policy.FeatureSpec(("bedrooms", "floorAreaSqM", "geo_radial"), ("propertyType",))
_HOT = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(twin("SELECT row_id, " + ", ".join(
    [f"round((coalesce({c}, m_{c}) - a_{c}) / s_{c}, 6) AS f{i}" for i, c in enumerate(_MATRIX.numeric)]
    + [f"CASE WHEN coalesce(propertyType, {_MODE.format(c='propertyType')}) = '{v}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f{i}"
       for i, v in enumerate(_HOT, start=3)])
    + " FROM clean CROSS JOIN med CROSS JOIN sc",
    "med AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in _MATRIX.numeric) + " FROM train)",
    "sc AS (SELECT " + ", ".join(
        f"avg(coalesce({c}, m_{c})) AS a_{c}, stddev_pop(coalesce({c}, m_{c})) AS s_{c}" for c in _MATRIX.numeric)
    + " FROM train CROSS JOIN med)"))
def prep_matrix(spark, sf_dir):
    """The dense view of the assembled vector, one column per feature."""
    q = Inputs(spark, sf_dir, _LOCATED)
    fitted = _fitted(q, _MATRIX)
    dense = fitted.transform(q.clean).select("row_id", vector_to_array("features").alias("x"))
    return rounded(dense.select(
        "row_id", *[F.get("x", F.lit(i)).alias(f"f{i}") for i in range(fitted.feature_dim)]), 6)


@query(twin("""
SELECT CAST(row_number() OVER (ORDER BY kind, feature) - 1 AS INTEGER) AS position, feature FROM (
  SELECT 0 AS kind, 'bedrooms' AS feature UNION ALL SELECT 0, 'floorAreaSqM' UNION ALL SELECT 0, 'geo_radial'
  UNION ALL SELECT DISTINCT 1, concat('propertyType_', propertyType) FROM train WHERE propertyType IS NOT NULL) n"""))
def prep_feature_names(spark, sf_dir):
    fitted = _fitted(Inputs(spark, sf_dir, _LOCATED), _MATRIX)
    return spark.createDataFrame(list(enumerate(fitted.feature_names)), "position int, feature string")


@query("SELECT event_type AS run_id, count(DISTINCT date_trunc('hour', ts)) AS epochs FROM events GROUP BY event_type")
def history_epochs(spark, sf_dir):
    """Epochs of the histories that the early-stop query replays."""
    return fixtures.hourly_history(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("epochs"))
