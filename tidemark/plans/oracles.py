"""SQL building blocks of the query twins (DuckDB dialect).

``PRELUDE`` derives, step by step and independently of the operators, the
sales table, the clean table, the calendar split and a set of predictions that
need no training.  A twin is the prelude plus its own select.
"""

from __future__ import annotations

_SALES = """
li AS (
  SELECT l_orderkey, round(sum(l_extendedprice*(1-l_discount)),4) AS revenue,
         count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_supp,
         sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS n_ret, sum(l_quantity) AS qty
  FROM lineitem GROUP BY l_orderkey),
sales AS (
  SELECT o.o_orderkey AS row_id, c.c_name AS fullAddress,
       concat(substr(c.c_mktsegment,1,2), c.c_nationkey) AS outcode,
       concat(substr(c.c_mktsegment,1,2), c.c_nationkey, ' ', o.o_custkey % 10) AS postcode,
       round(51.5 + c.c_acctbal/CAST(100000 AS DOUBLE),7) AS latitude,
       round(CAST(-0.13 AS DOUBLE) + c.c_nationkey/CAST(100 AS DOUBLE),2) AS longitude,
       CAST(li.n_lines AS DOUBLE) AS bedrooms, CAST(li.n_supp AS DOUBLE) AS bathrooms,
       CAST(li.n_ret AS DOUBLE) AS livingRooms,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE li.qty END AS floorAreaSqM,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE o.o_orderpriority END AS propertyType,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE round(li.revenue*(80+o.o_orderkey % 31)/CAST(100 AS DOUBLE),6) END AS saleEstimate_lowerPrice,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE round(li.revenue*(90+o.o_orderkey % 31)/CAST(100 AS DOUBLE),6) END AS saleEstimate_currentPrice,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE round(li.revenue*(105+o.o_orderkey % 31)/CAST(100 AS DOUBLE),6) END AS saleEstimate_upperPrice,
       o.o_orderdate AS history_date, li.revenue AS history_price
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN li ON li.l_orderkey = o.o_orderkey)"""

_DIRTY = """
raw AS (
  SELECT 2*row_id AS row_id, fullAddress,
         CASE WHEN row_id % 97 = 0 THEN 'not-a-date' ELSE CAST(CAST(history_date AS DATE) AS STRING) END AS history_date,
         CASE WHEN row_id % 89 = 0 THEN 'n/a' ELSE CAST(history_price AS STRING) END AS history_price
  FROM sales),
dirty AS (
  SELECT * FROM raw
  UNION ALL
  SELECT row_id+1, fullAddress, history_date, history_price FROM raw WHERE (row_id/2) % 10 = 0),
parsed AS (
  SELECT row_id, fullAddress, TRY_CAST(history_date AS TIMESTAMP) AS history_date,
         TRY_CAST(history_price AS DOUBLE) AS history_price FROM dirty)"""

_CLEAN = """
dd AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY fullAddress, history_date, history_price ORDER BY row_id) AS rn
    FROM sales WHERE history_date IS NOT NULL AND history_price IS NOT NULL) q
  WHERE rn = 1),
qb AS (SELECT quantile_cont(history_price, 0.01) AS ql, quantile_cont(history_price, 0.99) AS qh FROM dd),
clean AS (
  SELECT dd.* EXCLUDE (history_price), least(greatest(history_price, ql), qh) AS history_price,
         CAST(year(history_date) AS INTEGER) AS history_year,
         CAST(month(history_date) AS INTEGER) AS history_month,
         CAST(quarter(history_date) AS INTEGER) AS history_quarter,
         coalesce(bedrooms,0) + coalesce(bathrooms,0) + coalesce(livingRooms,0) AS total_rooms,
         floorAreaSqM / nullif(coalesce(bedrooms,0) + coalesce(bathrooms,0) + coalesce(livingRooms,0), 0) AS floor_area_per_room,
         bedrooms / nullif(bathrooms, 0) AS bed_bath_ratio,
         livingRooms / nullif(bedrooms, 0) AS living_bed_ratio,
         sqrt(pow(latitude - CAST(51.5074 AS DOUBLE), 2) + pow(longitude + CAST(0.1278 AS DOUBLE), 2)) AS geo_radial,
         nullif(regexp_extract(outcode, '^([A-Za-z]+)', 1), '') AS outcode_area
  FROM dd CROSS JOIN qb)"""

_SPLIT = """
span AS (SELECT min(epoch_us(history_date)) AS lo, max(epoch_us(history_date)) AS hi FROM clean),
cuts AS (
  SELECT lo, hi, lo + CAST(round(0.7*(hi-lo)) AS BIGINT) AS c1, lo + CAST(round(0.8*(hi-lo)) AS BIGINT) AS c2 FROM span),
sp AS (
  SELECT clean.*, CASE WHEN epoch_us(history_date) <= c1 THEN 'train'
                       WHEN epoch_us(history_date) <= c2 THEN 'val' ELSE 'test' END AS split
  FROM clean CROSS JOIN cuts),
train AS (SELECT * FROM sp WHERE split = 'train'),
folds AS (
  SELECT CAST(i AS INTEGER) AS fold, make_timestamp(lo + CAST(round(i*(hi-lo)/CAST(5 AS DOUBLE)) AS BIGINT)) AS val_start,
         make_timestamp(lo + CAST(round((i+1)*(hi-lo)/CAST(5 AS DOUBLE)) AS BIGINT)) AS val_end
  FROM span CROSS JOIN range(1, 5) AS r(i)),
labelled AS (
  SELECT *, concat('fold_', fold, '_', CAST(CAST(val_start AS DATE) AS VARCHAR), '_', CAST(CAST(val_end AS DATE) AS VARCHAR)) AS label
  FROM folds)"""

_PREDICTIONS = """
fit AS (SELECT median(history_price) AS med, median(history_price / bedrooms) AS rate FROM train),
scored AS (SELECT sp.*, med, bedrooms * rate AS by_rooms FROM sp CROSS JOIN fit WHERE split <> 'train'),
preds AS (
  SELECT row_id, split, history_date, outcode_area, propertyType, history_price AS y_true, model, y_pred FROM (
    SELECT *, 'NaiveMedian' AS model, med AS y_pred FROM scored
    UNION ALL SELECT *, 'RoomRate', by_rooms FROM scored
    UNION ALL SELECT *, 'saleEstimate_lowerPrice', saleEstimate_lowerPrice FROM scored
    UNION ALL SELECT *, 'saleEstimate_currentPrice', saleEstimate_currentPrice FROM scored
    UNION ALL SELECT *, 'saleEstimate_upperPrice', saleEstimate_upperPrice FROM scored) u),
ok AS (SELECT * FROM preds WHERE y_true IS NOT NULL AND y_pred IS NOT NULL),
test AS (SELECT * FROM ok WHERE split = 'test'),
metrics AS (
  SELECT model, split, count(*) AS n_rows, avg(abs(y_true-y_pred)) AS mae,
         sqrt(avg((y_true-y_pred)*(y_true-y_pred))) AS rmse,
         1 - sum((y_true-y_pred)*(y_true-y_pred))/nullif(var_pop(y_true)*count(*),0) AS r2,
         avg(CASE WHEN abs(y_true)>100 THEN abs((y_true-y_pred)/y_true) END) AS mape,
         avg(CASE WHEN abs(y_true)>100 THEN CASE WHEN abs((y_true-y_pred)/y_true) < 0.10
             THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END) AS within_10pct_rate
  FROM ok GROUP BY model, split),
wide AS (
  SELECT t.model, v.mae AS val_mae, v.rmse AS val_rmse, v.r2 AS val_r2, v.mape AS val_mape,
         v.within_10pct_rate AS val_within_10pct_rate, t.mae AS test_mae, t.rmse AS test_rmse, t.r2 AS test_r2,
         t.mape AS test_mape, t.within_10pct_rate AS test_within_10pct_rate
  FROM metrics t JOIN metrics v ON t.model = v.model AND t.split = 'test' AND v.split = 'val'),
board AS (
  SELECT wide.*, 100*(1 - test_rmse/(SELECT test_rmse FROM wide WHERE model = 'NaiveMedian')) AS test_rmse_improvement_vs_naive_pct
  FROM wide)"""

_BANDS = """
edges AS (
  SELECT list_sort(list_distinct(quantile_cont(history_price, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM sp WHERE split = 'test'),
bands AS (
  SELECT i AS band, CASE WHEN i = 1 THEN concat('(', CAST(round(e[i],3) - 0.001 AS VARCHAR), ', ', CAST(round(e[i+1],3) AS VARCHAR), ']')
              ELSE concat('(', CAST(round(e[i],3) AS VARCHAR), ', ', CAST(round(e[i+1],3) AS VARCHAR), ']') END AS price_band
  FROM edges CROSS JOIN range(1, 6) AS r(i) WHERE i < len(e)),
banded AS (
  SELECT t.*, b.price_band FROM (
    SELECT test.*, greatest(1, len(list_filter(e, lambda x: x < y_true))) AS band FROM test CROSS JOIN edges) t
  JOIN bands b ON t.band = b.band),
segments AS (
  SELECT segment_type, segment_value, model, count(*) AS "rows", avg(abs(y_true-y_pred)) AS mae,
         sqrt(avg((y_true-y_pred)*(y_true-y_pred))) AS rmse
  FROM (SELECT 'outcode_area' AS segment_type, outcode_area AS segment_value, model, y_true, y_pred FROM banded
        UNION ALL SELECT 'propertyType', propertyType, model, y_true, y_pred FROM banded
        UNION ALL SELECT 'price_band', price_band, model, y_true, y_pred FROM banded) u
  WHERE segment_value IS NOT NULL
  GROUP BY segment_type, segment_value, model HAVING count(*) >= 50)"""

_BINS = """
ranked AS (
  SELECT history_price AS y, row_number() OVER (ORDER BY history_price) AS rk, count(*) OVER () AS n FROM sp WHERE split = 'test'),
cutat AS (
  SELECT i, CASE WHEN (i*n) % 5 = 0 THEN greatest(i*n//5, 1) ELSE i*n//5 + 1 END AS a,
         CASE WHEN (i*n) % 5 = 0 THEN least(i*n//5 + 1, n) ELSE i*n//5 + 1 END AS b
  FROM range(0, 6) AS r(i) CROSS JOIN (SELECT max(n) AS n FROM ranked) m),
rawedge AS (
  SELECT i, (x.y + z.y)/2 AS edge FROM cutat JOIN ranked x ON x.rk = a JOIN ranked z ON z.rk = b),
edge AS (
  SELECT edge, row_number() OVER (ORDER BY i) - 1 AS k FROM (
    SELECT i, edge, edge - lag(edge) OVER (ORDER BY i) AS width FROM rawedge) w WHERE width IS NULL OR width > 1e-8),
inner_edges AS (SELECT list(edge ORDER BY k) AS e FROM edge WHERE k > 0 AND k < (SELECT max(k) FROM edge)),
binned AS (
  SELECT row_id, model, y_true, y_pred, CAST(len(list_filter(e, lambda x: x <= y_true)) AS INTEGER) AS true_bin,
         CAST(len(list_filter(e, lambda x: x <= y_pred)) AS INTEGER) AS pred_bin
  FROM test CROSS JOIN inner_edges WHERE model = 'saleEstimate_currentPrice'),
cells AS (
  SELECT CAST(t.i AS INTEGER) AS true_bin, CAST(p.i AS INTEGER) AS pred_bin, count(b.row_id) AS n
  FROM range(0, 5) AS t(i) CROSS JOIN range(0, 5) AS p(i)
  LEFT JOIN binned b ON b.true_bin = t.i AND b.pred_bin = p.i GROUP BY 1, 2),
report AS (
  SELECT k.i AS bin,
         (SELECT sum(n) FROM cells WHERE true_bin = k.i) AS support,
         (SELECT sum(n) FROM cells WHERE pred_bin = k.i) AS predicted,
         (SELECT sum(n) FROM cells WHERE true_bin = k.i AND pred_bin = k.i) AS hit
  FROM range(0, 5) AS k(i)),
scores AS (
  SELECT CAST(bin AS INTEGER) AS bin, coalesce(hit/nullif(predicted,0), 0) AS "precision",
         coalesce(hit/nullif(support,0), 0) AS recall, coalesce(2*hit/nullif(predicted+support,0), 0) AS f1,
         CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(hit AS BIGINT) AS hit
  FROM report)"""

_TRACKS = """
benchmark_rows AS (
  SELECT model AS benchmark, n_rows AS test_rows_used, mae AS test_mae, rmse AS test_rmse
  FROM metrics WHERE split = 'test' AND model LIKE 'saleEstimate%' AND n_rows >= 100),
assisted_preds AS (
  SELECT 'AssistedBlend' AS model, split, history_price AS y, (saleEstimate_lowerPrice + saleEstimate_upperPrice)/2 AS p FROM scored
  UNION ALL SELECT 'AssistedMix', split, history_price, (saleEstimate_lowerPrice + saleEstimate_currentPrice)/2 FROM scored),
assisted AS (
  SELECT model, avg(abs(y-p)) AS test_mae, sqrt(avg((y-p)*(y-p))) AS test_rmse
  FROM assisted_preds WHERE split = 'test' AND p IS NOT NULL GROUP BY model),
mainline AS (SELECT * FROM board WHERE model IN ('NaiveMedian', 'RoomRate')),
bm AS (SELECT * FROM mainline ORDER BY test_rmse, model LIMIT 1),
be AS (SELECT * FROM benchmark_rows ORDER BY test_rmse, benchmark LIMIT 1),
ba AS (SELECT * FROM assisted ORDER BY test_rmse, model LIMIT 1),
fold_metrics AS (
  SELECT f.label AS fold, m.family AS model_family,
         (SELECT count(*) FROM clean c WHERE c.history_date < f.val_start) AS train_rows,
         (SELECT count(*) FROM clean c WHERE c.history_date >= f.val_start AND c.history_date < f.val_end) AS val_rows,
         (SELECT sqrt(avg((c.history_price-m.p)*(c.history_price-m.p))) FROM clean c
          WHERE c.history_date >= f.val_start AND c.history_date < f.val_end) AS rmse
  FROM labelled f JOIN (
    SELECT g.fold, 'NaiveMedian' AS family, median(c.history_price) AS p
    FROM folds g JOIN clean c ON c.history_date < g.val_start GROUP BY g.fold
    UNION ALL
    SELECT g.fold, 'NaiveMean', avg(c.history_price)
    FROM folds g JOIN clean c ON c.history_date < g.val_start GROUP BY g.fold) m ON m.fold = f.fold),
stability AS (
  SELECT *, avg(rmse) OVER w AS rmse_mean, stddev_pop(rmse) OVER w AS rmse_std,
         100*stddev_pop(rmse) OVER w / avg(rmse) OVER w AS cv_pct
  FROM fold_metrics WINDOW w AS (PARTITION BY model_family)),
critical AS (
  SELECT s.* FROM segments s JOIN bm ON s.model = bm.model
  WHERE s."rows" >= 200 AND s.rmse > 1.05 * bm.test_rmse)"""

PRELUDE = "WITH " + ",".join((_SALES, _DIRTY, _CLEAN, _SPLIT, _PREDICTIONS, _BANDS, _BINS, _TRACKS))


def twin(select: str, *ctes: str) -> str:
    """The prelude, further steps, and the final select."""
    return ",\n".join((PRELUDE, *ctes)) + "\n" + select
