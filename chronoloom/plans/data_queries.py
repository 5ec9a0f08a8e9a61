"""Queries of the four general data problems, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import grid, hotkeys, late, rolling
from chronoloom.plans.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.fillable_periods(table(spark, d, "samples"), table(spark, d, "rules"))


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    g = grid.regular_grid(table(spark, d, "samples"), table(spark, d, "rules"))
    return g.select("dest_key", "agg", "bucket_ms", "period_start", "state", "gap_ms", "n", F.round("value", 6).alias("value"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.heavy_pairs(table(spark, d, "samples"), table(spark, d, "series_labels"))


def p2_pair_totals(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.pair_totals(table(spark, d, "samples"), table(spark, d, "series_labels"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.busy_weeks(table(spark, d, "samples"))


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_totals(table(spark, d, "samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return late.corrections(table(spark, d, "ingest"), table(spark, d, "series"))


def p4_hours(spark: SparkSession, d: str) -> DataFrame:
    return late.corrected_hours(table(spark, d, "ingest"), table(spark, d, "series"))


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_pair_totals, p3_found, p3_rolling, p4_found, p4_hours)}

_READINGS = "readings AS (SELECT DISTINCT series_key, ts, value FROM samples WHERE NOT isnan(value))"
_RULES = "r AS (SELECT DISTINCT source_key AS series_key, dest_key, lower(trim(agg)) AS agg, bucket_ms, coalesce(CAST(align_ms AS BIGINT), 0) AS align_ms FROM rules WHERE bucket_ms > 0)"
_FLOOR = "({t}) - ((({t}) - ({a})) % ({w}) + ({w})) % ({w})"


def _floor(t: str, w: str, a: str = "0") -> str:
    return _FLOOR.format(t=t, w=w, a=a)


_DAY = "CAST(floor(ts / 86400000.0) AS BIGINT)"
_ROLL = f"""WITH {_READINGS},
daily AS (SELECT series_key, {_DAY} AS day, sum(value) AS total, count(*) AS n FROM readings GROUP BY ALL),
span AS (SELECT series_key, min(day) AS lo, max(day) AS hi FROM daily GROUP BY ALL),
cal AS (SELECT series_key, unnest(generate_series(lo, hi)) AS day FROM span),
j AS (SELECT c.series_key, c.day, coalesce(d.total, 0.0) AS total, CAST(coalesce(d.n, 0) AS BIGINT) AS n, CAST(d.n IS NOT NULL AS BIGINT) AS active
      FROM cal c LEFT JOIN daily d USING (series_key, day)),
roll AS (SELECT series_key, day, total, n,
  sum(total) OVER w7 AS total_7, CAST(sum(n) OVER w7 AS BIGINT) AS n_7, CAST(sum(active) OVER w7 AS BIGINT) AS active_7,
  sum(total) OVER w30 AS total_30, CAST(sum(n) OVER w30 AS BIGINT) AS n_30, CAST(sum(active) OVER w30 AS BIGINT) AS active_30
  FROM j WINDOW w7 AS (PARTITION BY series_key ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW),
                w30 AS (PARTITION BY series_key ORDER BY day RANGE BETWEEN 29 PRECEDING AND CURRENT ROW))
"""
_LATE = f"""WITH log AS (SELECT DISTINCT series_key, seq, ts, value FROM ingest WHERE value IS NOT NULL AND ts IS NOT NULL AND seq IS NOT NULL AND series_key IS NOT NULL),
c AS (SELECT series_key, max(last_timestamp) AS last_timestamp, max(retention_ms) AS retention_ms FROM series GROUP BY ALL),
w AS (SELECT log.*, c.retention_ms, greatest(c.last_timestamp, max(ts) OVER (PARTITION BY log.series_key ORDER BY seq RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS last
      FROM log LEFT JOIN c USING (series_key)),
k AS (SELECT series_key, seq, ts, value, {_floor("ts", "3600000")} AS period_start,
  CASE WHEN last IS NOT NULL AND retention_ms > 0 AND last - ts > retention_ms THEN 'beyond'
       WHEN last IS NOT NULL AND {_floor("ts", "3600000")} < {_floor("last", "3600000")} THEN 'correction' ELSE 'on_time' END AS kind FROM w)
"""
ORACLES = {
    "p1_found": f"""WITH {_READINGS}, {_RULES},
b AS (SELECT DISTINCT dest_key, series_key, bucket_ms, align_ms, ts, {_floor("ts", "bucket_ms", "align_ms")} AS p
      FROM readings JOIN (SELECT DISTINCT dest_key, series_key, bucket_ms, align_ms FROM r) USING (series_key)),
n AS (SELECT *, lead(ts) OVER w AS nts, lead(p) OVER w AS np FROM b WINDOW w AS (PARTITION BY dest_key, bucket_ms, align_ms ORDER BY ts))
SELECT DISTINCT dest_key, unnest(generate_series(p + bucket_ms, np - bucket_ms, bucket_ms)) AS period_start
FROM n WHERE np - p > bucket_ms AND nts - ts <= 259200000""",
    "p1_grid": f"""WITH {_READINGS}, {_RULES},
j AS (SELECT dest_key, agg, bucket_ms, align_ms, ts, value, {_floor("ts", "bucket_ms", "align_ms")} AS p FROM readings JOIN r USING (series_key)),
pt AS (SELECT dest_key, agg, bucket_ms, align_ms, p, ts, max(value) AS value FROM j GROUP BY ALL),
nb AS (SELECT *, lag(ts) OVER w AS pts, lag(value) OVER w AS pv, lead(ts) OVER w AS nts, lead(value) OVER w AS nv FROM pt WINDOW w AS (PARTITION BY dest_key, agg, bucket_ms, align_ms ORDER BY ts)),
ar AS (SELECT dest_key, agg, bucket_ms, align_ms, p,
  CASE WHEN pts IS NULL THEN 0 WHEN pts >= p THEN (pv + value) / 2 * (ts - pts) ELSE (pv + (value - pv) * (p - pts) / (ts - pts) + value) / 2 * (ts - p) END
  + CASE WHEN nts >= p + bucket_ms THEN (value + value + (nv - value) * (p + bucket_ms - ts) / (nts - ts)) / 2 * (p + bucket_ms - ts) ELSE 0 END AS area,
  CASE WHEN pts IS NULL THEN 0 ELSE ts - greatest(pts, p) END + CASE WHEN nts >= p + bucket_ms THEN p + bucket_ms - ts ELSE 0 END AS width FROM nb),
tw AS (SELECT dest_key, agg, bucket_ms, align_ms, p, CASE WHEN sum(width) > 0 THEN sum(area) / sum(width) END AS tw FROM ar GROUP BY ALL),
l AS (SELECT dest_key, agg, bucket_ms, align_ms, p, first(value ORDER BY ts, value DESC) AS fv, first(value ORDER BY ts DESC, value DESC) AS lv FROM pt GROUP BY ALL),
b AS (SELECT dest_key, agg, bucket_ms, align_ms, p, count(*) AS n, min(ts) AS ft, max(ts) AS lt, min(value) AS lo, max(value) AS hi, sum(value) AS total, avg(value) AS mean, stddev_pop(value) AS sp, var_pop(value) AS vp FROM j GROUP BY ALL),
e AS (SELECT dest_key, agg, bucket_ms, align_ms, min(p) AS p0, max(p) AS p1 FROM b GROUP BY ALL),
g AS (SELECT dest_key, agg, bucket_ms, align_ms, unnest(generate_series(p0, p1, bucket_ms)) AS p FROM e),
x AS (SELECT g.*, n, ft, lt, lv, CASE agg WHEN 'min' THEN lo WHEN 'max' THEN hi WHEN 'sum' THEN total WHEN 'avg' THEN mean WHEN 'count' THEN CAST(n AS DOUBLE) WHEN 'countall' THEN CAST(n AS DOUBLE)
    WHEN 'first' THEN fv WHEN 'last' THEN lv WHEN 'range' THEN hi - lo WHEN 'std.p' THEN sp WHEN 'var.p' THEN vp WHEN 'twa' THEN coalesce(tw, lv) END AS v
  FROM g LEFT JOIN b USING (dest_key, agg, bucket_ms, align_ms, p) LEFT JOIN l USING (dest_key, agg, bucket_ms, align_ms, p) LEFT JOIN tw USING (dest_key, agg, bucket_ms, align_ms, p)),
y AS (SELECT *, last_value(lt IGNORE NULLS) OVER w AS pt, last_value(lv IGNORE NULLS) OVER w AS pv, first_value(ft IGNORE NULLS) OVER d AS nt FROM x
  WINDOW w AS (PARTITION BY dest_key, agg, bucket_ms, align_ms ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         d AS (PARTITION BY dest_key, agg, bucket_ms, align_ms ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT dest_key, agg, bucket_ms, p AS period_start, CASE WHEN n > 0 THEN 'read' WHEN nt - pt <= 259200000 THEN 'filled' ELSE 'missing' END AS state,
  CASE WHEN n IS NULL THEN nt - pt END AS gap_ms, coalesce(n, 0) AS n, round(CASE WHEN n > 0 THEN v WHEN nt - pt <= 259200000 THEN pv END, 6) AS value FROM y""",
    "p2_found": """WITH l AS (SELECT DISTINCT series_key, label_key, label_value FROM series_labels WHERE label_key <> '' AND label_value <> ''),
s AS (SELECT series_key, count(*) AS n FROM samples GROUP BY ALL)
SELECT label_key, label_value FROM l JOIN s USING (series_key) GROUP BY ALL HAVING sum(n) * 20 >= (SELECT count(*) FROM samples)""",
    "p2_pair_totals": """WITH l AS (SELECT DISTINCT series_key, label_key, label_value FROM series_labels WHERE label_key <> '' AND label_value <> '')
SELECT label_key, label_value, count(*) AS n, count(*) FILTER (NOT isnan(value)) AS numbers, sum(value) FILTER (NOT isnan(value)) AS total,
       min(value) FILTER (NOT isnan(value)) AS least, max(value) FILTER (NOT isnan(value)) AS greatest
FROM samples JOIN l USING (series_key) GROUP BY ALL""",
    "p3_found": _ROLL + "SELECT series_key, strftime(DATE '1970-01-01' + CAST(day AS INTEGER), '%Y-%m-%d') AS active_day FROM roll WHERE 2 * total_7 > total_30 AND active_30 >= 20",
    "p3_rolling": _ROLL
    + """SELECT series_key, day, total, n, total_7, n_7, active_7, total_7 / 7.0 AS per_day_7, CASE WHEN n_7 > 0 THEN total_7 / n_7 END AS mean_7,
total_30, n_30, active_30, total_30 / 30.0 AS per_day_30, CASE WHEN n_30 > 0 THEN total_30 / n_30 END AS mean_30 FROM roll""",
    "p4_found": _LATE + "SELECT DISTINCT seq, period_start FROM k WHERE kind = 'correction'",
    "p4_hours": _LATE
    + """SELECT series_key, period_start, count(*) FILTER (kind <> 'beyond') AS n, count(*) FILTER (kind <> 'beyond' AND NOT isnan(value)) AS n_numbers,
sum(value) FILTER (kind <> 'beyond' AND NOT isnan(value)) AS total, count(*) FILTER (kind = 'on_time') AS n_first,
sum(value) FILTER (kind = 'on_time' AND NOT isnan(value)) AS total_first, count(*) FILTER (kind = 'correction') AS corrections,
count(*) FILTER (kind = 'beyond') AS beyond,
sum(value) FILTER (kind <> 'beyond' AND NOT isnan(value)) / nullif(count(*) FILTER (kind <> 'beyond' AND NOT isnan(value)), 0) AS mean
FROM k GROUP BY ALL""",
}
