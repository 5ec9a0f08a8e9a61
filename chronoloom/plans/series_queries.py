"""Queries of the series operators, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.aggregates import column_name
from chronoloom.model import EngineConfig, alter, copy_series, create, rename_series
from chronoloom.operators import ingest, multi, rules, select
from chronoloom.operators.ranges import limited, range_query, range_rows
from chronoloom.plans.specs import Buckets, MultiRangeSpec, RangeSpec
from chronoloom.plans.tables import table
from chronoloom.session import checkpointed
from chronoloom.sources import project

HOUR, DAY = 3_600_000, 86_400_000
#: 2024-01-05, 2024-01-15 and 2024-01-20, UTC.
LO, MID, HI = 1704412800000, 1705276800000, 1705708800000
ONE = "events:click:7"
ALL = ("measurement=events",)
CLICKS = ("measurement=events", "event_type=click")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_S = """s AS (SELECT 'events:' || event_type || ':' || CAST(user_id AS VARCHAR) AS series_key, event_type, CAST(user_id AS VARCHAR) AS user_id,
epoch_us(ts) // 1000 AS ts, value FROM events)"""
_M = "m AS (SELECT series_key, ts, max(value) AS value FROM samples GROUP BY ALL)"


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _plain(df: DataFrame, flags: bool = False) -> DataFrame:
    """Doubles rounded to six digits for a comparison by value, NaN as null; with `flags` a column `…_nan` tells NaN from null."""
    out = []
    for c, kind in df.dtypes:
        out.append(F.when(~F.isnan(c), F.round(F.col(c), 6)).alias(c) if kind == "double" else F.col(c))
        if flags and kind == "double":
            out.append(F.isnan(c).alias(f"{c}_nan"))
    return df.select(*out)


def _floor(t: str, w: int, a: int = 0) -> str:
    return f"({t} - ((({t} - {a}) % {w} + {w}) % {w}))"


def _many(spec: RangeSpec, filters: tuple[str, ...] = ALL, retention_ms: int = 0, flags: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        ts = project.events(spark, d, retention_ms)
        rows = range_rows(ts, select.select_series(ts.series, filters), spec)
        return _plain(limited(rows, ["series_key"], spec.count, spec.reverse), flags)

    return run


# --- scans and filters
_query("range_scan", f"WITH {_S} SELECT ts, round(value, 6) AS value FROM s WHERE series_key = '{ONE}' AND ts BETWEEN {LO} AND {HI}")(
    lambda spark, d: _plain(range_query(project.events(spark, d), ONE, RangeSpec(LO, HI)))
)
_query("revrange_limit", f"WITH {_S} SELECT ts, round(value, 6) AS value FROM s WHERE series_key = '{ONE}' ORDER BY ts DESC LIMIT 5")(
    lambda spark, d: _plain(range_query(project.events(spark, d), ONE, RangeSpec(count=5, reverse=True)))
)
_query(
    "retention_clip",
    f"WITH {_S}, l AS (SELECT series_key, max(ts) AS last FROM s GROUP BY ALL) SELECT series_key, ts, round(value, 6) AS value FROM s JOIN l USING (series_key) WHERE ts >= last - {5 * DAY}",
)(_many(RangeSpec(), retention_ms=5 * DAY))
_query("multi_scan", f"WITH {_S} SELECT series_key, ts, round(value, 6) AS value FROM s WHERE event_type = 'click' AND ts BETWEEN {LO} AND {HI}")(_many(RangeSpec(LO, HI), CLICKS))


@_query(
    "filter_by_ts",
    f"WITH {_S}, t AS (SELECT DISTINCT ts FROM (SELECT ts FROM s WHERE series_key = '{ONE}' ORDER BY ts LIMIT 4)) SELECT series_key, ts, round(value, 6) AS value FROM s WHERE ts IN (SELECT ts FROM t)",
)
def filter_by_ts(spark: SparkSession, d: str) -> DataFrame:
    ts = project.events(spark, d)
    times = tuple(r.ts for r in ts.samples.where(F.col("series_key") == ONE).select("ts").orderBy("ts").limit(4).collect())
    return _plain(range_rows(ts, ts.series, RangeSpec(times=times)))


_query("filter_by_value", f"WITH {_S} SELECT series_key, ts, round(value, 6) AS value FROM s WHERE value BETWEEN 20 AND 60.5")(_many(RangeSpec(values=(20.0, 60.5))))
_query(
    "filter_then_aggregate",
    f"WITH {_S} SELECT series_key, {_floor('ts', DAY)} AS ts, CAST(count(*) AS DOUBLE) AS value FROM s WHERE value BETWEEN 20 AND 60.5 AND ts BETWEEN {LO} AND {HI} GROUP BY ALL",
)(_many(RangeSpec(LO, HI, values=(20.0, 60.5), buckets=Buckets(("count",), DAY))))

# --- matchers and listings
for _name, _filters, _sql in (
    ("match_eq", ("event_type=click",), "event_type = 'click'"),
    ("match_neq", ("measurement=events", "event_type!=click"), "event_type <> 'click'"),
    ("match_list", ("user_id=(1,2,3)",), "user_id IN ('1', '2', '3')"),
    ("match_notlist", ("measurement=events", "user_id!=(1,2,3)", "event_type=(click,view)"), "user_id NOT IN ('1', '2', '3') AND event_type IN ('click', 'view')"),
    ("match_nothing", ("event_type=()",), "false"),
):
    _query(_name, f"WITH {_S} SELECT DISTINCT series_key FROM s WHERE {_sql}")(lambda spark, d, f=_filters: select.query_index(project.events(spark, d).series, list(f)))

_L = "l AS (SELECT series_key, unnest(map_keys(labels)) AS k, unnest(map_values(labels)) AS v FROM series WHERE labels IS NOT NULL)"
for _name, _filters, _sql in (("match_missing", ["unit=pct", "team="], "NOT IN"), ("match_present", ["unit=pct", "team!="], "IN")):
    _query(_name, f"WITH {_L} SELECT DISTINCT series_key FROM l WHERE k = 'unit' AND v = 'pct' AND series_key {_sql} (SELECT series_key FROM l WHERE k = 'team' AND v IS NOT NULL)")(
        lambda spark, d, f=_filters: select.query_index(table(spark, d, "series"), f)
    )
_query("querylabels_all", f"WITH {_L} SELECT DISTINCT k AS label FROM l")(lambda spark, d: select.label_names(table(spark, d, "series")))
_query("queryindex", f"WITH {_L} SELECT DISTINCT series_key FROM l WHERE k = 'unit' AND v = 'pct' AND series_key NOT IN (SELECT series_key FROM l WHERE k = 'measurement' AND v = 'cpu')")(
    lambda spark, d: select.query_index(table(spark, d, "series"), ["unit=pct", "measurement!=cpu"])
)
_query("querylabels_labels", f"WITH {_L} SELECT DISTINCT k AS label FROM l WHERE series_key IN (SELECT series_key FROM l WHERE k = 'unit' AND v = 'pct')")(
    lambda spark, d: select.label_names(table(spark, d, "series"), ["unit=pct"])
)
_query("querylabels_values", f"WITH {_L} SELECT DISTINCT v AS value FROM l WHERE k = 'region'")(lambda spark, d: select.label_values(table(spark, d, "series"), "region"))
_query("with_labels", f"WITH {_S} SELECT series_key, ts, round(value, 6) AS value, 'events' AS measurement, event_type, user_id FROM s WHERE user_id = '3'")(
    lambda spark, d: _plain(
        multi.multi_range(project.events(spark, d), MultiRangeSpec(("user_id=3",), with_labels=True, exclude_empty=True)).select(
            "series_key", "ts", "value", *[F.col("labels")[x].alias(x) for x in ("measurement", "event_type", "user_id")]
        )
    )
)
_query("selected_labels", f"WITH {_S} SELECT series_key, ts, round(value, 6) AS value, event_type AS kind, NULL AS team FROM s WHERE user_id = '3'")(
    lambda spark, d: _plain(
        multi.multi_range(project.events(spark, d), MultiRangeSpec(("user_id=3",), selected_labels=("EVENT_type", "team"))).select(
            "series_key", "ts", "value", F.col("labels")["EVENT_type"].alias("kind"), F.col("labels")["team"].alias("team")
        )
    )
)

# --- last points, tail reads, info
_query("get", f"WITH {_S} SELECT ts, round(value, 6) AS value FROM s WHERE series_key = '{ONE}' ORDER BY ts DESC LIMIT 1")(lambda spark, d: _plain(multi.get(project.events(spark, d), ONE)))
_query("mget", f"WITH {_S} SELECT series_key, max(ts) AS ts, round(max_by(value, ts), 6) AS value FROM s GROUP BY ALL")(
    lambda spark, d: _plain(multi.multi_get(project.events(spark, d), ALL))
)
_query(
    "mget_unsampled",
    f"WITH {_L}, {_M} SELECT p.series_key, max(ts) AS ts, CASE WHEN NOT isnan(max_by(value, ts)) THEN round(max_by(value, ts), 6) END AS value FROM (SELECT DISTINCT series_key FROM l WHERE k = 'unit' AND v = 'pct') p LEFT JOIN m USING (series_key) GROUP BY ALL",
)(lambda spark, d: _plain(multi.multi_get(project.monitoring(spark, d), ("unit=pct",))))
_query("read_tail", f"WITH {_S} SELECT ts, round(value, 6) AS value FROM s WHERE series_key = '{ONE}' AND ts >= {MID} ORDER BY ts LIMIT 7")(
    lambda spark, d: _plain(multi.tail_read(project.events(spark, d), ONE, MID, 7))
)
_query("read_last", f"WITH {_S} SELECT ts, round(value, 6) AS value FROM s WHERE series_key = '{ONE}' ORDER BY ts DESC LIMIT 1")(
    lambda spark, d: _plain(multi.tail_read(project.events(spark, d), ONE, "+"))
)
_query(
    "series_info",
    f"""WITH {_M}, c AS (SELECT series_key, coalesce(CAST(retention_ms AS BIGINT), 0) AS retention_ms FROM series),
l AS (SELECT series_key, max(ts) AS last FROM m GROUP BY ALL),
b AS (SELECT c.series_key, retention_ms, last, CASE WHEN retention_ms > 0 AND last > retention_ms THEN last - retention_ms ELSE 0 END AS lo FROM c LEFT JOIN l USING (series_key))
SELECT b.series_key, retention_ms, count(m.ts) AS total_samples, coalesce(min(m.ts), 0) AS first_timestamp, coalesce(any_value(last), 0) AS last_timestamp
FROM b LEFT JOIN m ON m.series_key = b.series_key AND m.ts >= lo GROUP BY ALL""",
)(lambda spark, d: multi.info(project.monitoring(spark, d)).select("series_key", "retention_ms", "total_samples", "first_timestamp", "last_timestamp"))

# --- buckets
_SQL_AGG = {
    "min": "min(value)", "max": "max(value)", "sum": "sum(value)", "avg": "avg(value)", "count": "CAST(count(*) AS DOUBLE)", "first": "min_by(value, ts)", "last": "max_by(value, ts)",
    "range": "max(value) - min(value)", "std.p": "stddev_pop(value)", "std.s": "coalesce(stddev_samp(value), 0.0)", "var.p": "var_pop(value)", "var.s": "coalesce(var_samp(value), 0.0)",
    "countall": "CAST(count(*) AS DOUBLE)",
}
for _n, _e in _SQL_AGG.items():
    _query(f"bucket_{column_name(_n)}", f"WITH {_S} SELECT series_key, {_floor('ts', DAY)} AS ts, round({_e}, 6) AS value FROM s GROUP BY series_key, {_floor('ts', DAY)}")(
        _many(RangeSpec(buckets=Buckets((_n,), DAY)))
    )
_query(
    "bucket_countnan",
    f"WITH {_M}, {_L} SELECT series_key, {_floor('ts', DAY)} AS ts, CAST(count(*) AS DOUBLE) AS value FROM m WHERE isnan(value) AND series_key IN (SELECT series_key FROM series) GROUP BY ALL",
)(lambda spark, d: range_rows(project.monitoring(spark, d), table(spark, d, "series"), RangeSpec(buckets=Buckets(("countnan",), DAY), retention=False)))
_TWA = f"""n AS (SELECT *, lag(ts) OVER w AS pt, lag(value) OVER w AS pv, lead(ts) OVER w AS nt, lead(value) OVER w AS nv, {_floor('ts', DAY)} AS b FROM s WINDOW w AS (PARTITION BY series_key ORDER BY ts)),
k AS (SELECT *, greatest(b, {{lo}}) AS ta, least(b + {DAY}, {{hi}}) AS tb FROM n WHERE ts BETWEEN {{lo}} AND {{hi}}),
a AS (SELECT series_key, b, ts, value,
 CASE WHEN pt IS NULL THEN 0 WHEN pt >= ta THEN (pv + value) / 2 * (ts - pt) ELSE (pv + (value - pv) * (ta - pt) / (ts - pt) + value) / 2 * (ts - ta) END
 + CASE WHEN nt IS NOT NULL AND (nt >= b + {DAY} OR nt > {{hi}}) THEN (value + value + (nv - value) * (tb - ts) / (nt - ts)) / 2 * (tb - ts) ELSE 0 END AS area,
 CASE WHEN pt IS NULL THEN 0 ELSE ts - greatest(pt, ta) END + CASE WHEN nt IS NOT NULL AND (nt >= b + {DAY} OR nt > {{hi}}) THEN tb - ts ELSE 0 END AS width FROM k)"""
_query(
    "bucket_twa",
    f"WITH {_S}, {_TWA.format(lo=LO, hi=HI)} SELECT series_key, b AS ts, round(CASE WHEN sum(width) > 0 THEN sum(area) / sum(width) ELSE max_by(value, ts) END, 6) AS value FROM a GROUP BY series_key, b",
)(_many(RangeSpec(LO, HI, buckets=Buckets(("twa",), DAY))))
_query("bucket_align_start", f"WITH {_S} SELECT series_key, {_floor('ts', 7 * DAY, LO + 12345)} AS ts, round(sum(value), 6) AS value FROM s WHERE ts BETWEEN {LO + 12345} AND {HI} GROUP BY ALL")(
    _many(RangeSpec(LO + 12345, HI, buckets=Buckets(("sum",), 7 * DAY, "start")))
)
_query("bucket_align_end", f"WITH {_S} SELECT series_key, {_floor('ts', 7 * DAY, HI)} AS ts, round(sum(value), 6) AS value FROM s WHERE ts BETWEEN {LO} AND {HI} GROUP BY ALL")(
    _many(RangeSpec(LO, HI, buckets=Buckets(("sum",), 7 * DAY, "end")))
)
for _l, _add in (("mid", DAY // 2), ("end", DAY)):
    _query(f"bucket_ts_{_l}", f"WITH {_S} SELECT series_key, {_floor('ts', DAY)} + {_add} AS ts, round(max(value), 6) AS value FROM s GROUP BY ALL")(
        _many(RangeSpec(buckets=Buckets(("max",), DAY, label=_l)))
    )
_query(
    "multi_agg",
    f"WITH {_S} SELECT series_key, {_floor('ts', DAY)} AS ts, round(max(value), 6) AS value, round(min(value), 6) AS value_2, CAST(count(*) AS DOUBLE) AS value_3, round(max(value), 6) AS value_4 FROM s GROUP BY ALL",
)(_many(RangeSpec(buckets=Buckets(("max", "min", "count", "MAX"), DAY))))
_query(
    "mixed_nan_agg",
    f"""WITH {_M}, {_L} SELECT series_key, {_floor('ts', DAY)} AS ts, coalesce(round(sum(value) FILTER (NOT isnan(value)), 6), 0) AS value,
CAST(count(*) FILTER (isnan(value)) AS DOUBLE) AS value_2, CAST(count(*) AS DOUBLE) AS value_3, round(min(value) FILTER (NOT isnan(value)), 6) AS value_4,
false AS value_nan, false AS value_2_nan, false AS value_3_nan, bool_and(isnan(value)) AS value_4_nan
FROM m WHERE series_key IN (SELECT series_key FROM series) GROUP BY ALL""",
)(lambda spark, d: _plain(range_rows(project.monitoring(spark, d), table(spark, d, "series"), RangeSpec(buckets=Buckets(("sum", "countnan", "countall", "min"), DAY), retention=False)), flags=True))

# --- gap filling
_GAP = f"""b AS (SELECT series_key, {_floor('ts', DAY)} AS b, sum(value) AS total, avg(value) AS mean, max_by(value, ts) AS lastv, min(ts) AS ft, min_by(value, ts) AS fv, max(ts) AS lt FROM s WHERE ts BETWEEN {LO} AND {HI} GROUP BY ALL),
e AS (SELECT series_key, min(ts) AS n0, max(ts) AS n1, max(CASE WHEN ts < {LO} THEN ts END) AS ot, max_by(value, ts) FILTER (ts < {LO}) AS ov, min(CASE WHEN ts > {HI} THEN ts END) AS nt, min_by(value, ts) FILTER (ts > {HI}) AS nv FROM s GROUP BY ALL),
v AS (SELECT series_key, min(b) AS b0, max(b) AS b1 FROM b GROUP BY ALL),
p AS (SELECT e.*, CASE WHEN n0 < {LO} AND n1 >= {LO} THEN {_floor(str(LO), DAY)} ELSE b0 END AS f,
  CASE WHEN b0 IS NULL AND n0 < {LO} AND n1 >= {LO} THEN {_floor(str(HI), DAY)} WHEN n0 < b1 + {DAY} AND n1 >= b1 + {DAY} THEN greatest({_floor(str(HI), DAY)}, b1) ELSE b1 END AS l
  FROM e LEFT JOIN v USING (series_key)),
g AS (SELECT series_key, unnest(generate_series(f, l, {DAY})) AS b FROM p WHERE f IS NOT NULL AND l IS NOT NULL AND f <= l),
j AS (SELECT g.series_key, g.b, total, mean, lastv, ft, fv, lt, ot, ov, nt, nv FROM g LEFT JOIN b USING (series_key, b) JOIN e ON e.series_key = g.series_key)"""
_UP = "(PARTITION BY series_key ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_query("empty_sum", f"WITH {_S}, {_GAP} SELECT series_key, b AS ts, round(coalesce(total, 0), 6) AS value FROM j")(_many(RangeSpec(LO, HI, buckets=Buckets(("sum",), DAY, empty=True))))
_query("empty_avg", f"WITH {_S}, {_GAP} SELECT series_key, b AS ts, round(mean, 6) AS value, mean IS NULL AS value_nan FROM j")(_many(RangeSpec(LO, HI, buckets=Buckets(("avg",), DAY, empty=True)), flags=True))
_query("empty_last", f"WITH {_S}, {_GAP} SELECT series_key, b AS ts, round(coalesce(last_value(lastv IGNORE NULLS) OVER {_UP}, ov), 6) AS value FROM j")(
    _many(RangeSpec(LO, HI, buckets=Buckets(("last",), DAY, empty=True)))
)
_DOWN = "(PARTITION BY series_key ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_query(
    "empty_twa",
    f"""WITH {_S}, {_GAP}, {_TWA.format(lo=LO, hi=HI)},
t AS (SELECT series_key, b, CASE WHEN sum(width) > 0 THEN sum(area) / sum(width) ELSE max_by(value, ts) END AS tw FROM a GROUP BY series_key, b),
u AS (SELECT j.series_key, j.b, lt, tw, coalesce(last_value(lt IGNORE NULLS) OVER {_UP}, ot) AS t0, coalesce(last_value(lastv IGNORE NULLS) OVER {_UP}, ov) AS v0,
  coalesce(first_value(ft IGNORE NULLS) OVER {_DOWN}, nt) AS t1, coalesce(first_value(fv IGNORE NULLS) OVER {_DOWN}, nv) AS v1 FROM j LEFT JOIN t ON t.series_key = j.series_key AND t.b = j.b)
SELECT series_key, b AS ts, round(CASE WHEN lt IS NOT NULL THEN tw WHEN t0 IS NOT NULL AND t1 IS NOT NULL
  THEN v0 + (v1 - v0) * (greatest(b, {LO}) - t0 + least(b + {DAY}, {HI}) - t0) / 2 / (t1 - t0) END, 6) AS value FROM u""".replace("(PARTITION BY series_key ORDER BY b", "(PARTITION BY j.series_key ORDER BY j.b"),
)(_many(RangeSpec(LO, HI, buckets=Buckets(("twa",), DAY, empty=True))))

# --- limits, empty series
_query(
    "mrange_count",
    f"WITH {_S}, b AS (SELECT series_key, {_floor('ts', DAY)} AS ts, round(sum(value), 6) AS value FROM s GROUP BY ALL) SELECT series_key, ts, value FROM b QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ts) <= 3",
)(_many(RangeSpec(buckets=Buckets(("sum",), DAY), count=3)))
_query("mrevrange_count", f"WITH {_S} SELECT series_key, ts, round(value, 6) AS value FROM s QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) <= 2")(
    _many(RangeSpec(count=2, reverse=True))
)
_EMPTY = f"WITH {_S}, k AS (SELECT DISTINCT series_key FROM s WHERE event_type = 'click') SELECT k.series_key, s.ts, round(s.value, 6) AS value FROM k {{how}} JOIN s ON s.series_key = k.series_key AND s.ts BETWEEN {LO} AND {LO + DAY}"
_query("mrange_lists_empty", _EMPTY.format(how="LEFT"))(lambda spark, d: _plain(multi.multi_range(project.events(spark, d), MultiRangeSpec(CLICKS, RangeSpec(LO, LO + DAY)))))
_query("exclude_empty", _EMPTY.format(how=""))(lambda spark, d: _plain(multi.multi_range(project.events(spark, d), MultiRangeSpec(CLICKS, RangeSpec(LO, LO + DAY), exclude_empty=True))))

# --- group and reduce: over the greatest values of each hour, which are exact
for _n, _e in _SQL_AGG.items():
    if _n in ("first", "last"):
        continue
    _query(
        f"groupby_reduce_{column_name(_n)}",
        f"WITH {_S}, b AS (SELECT series_key, event_type, {_floor('ts', HOUR)} AS ts, max(value) AS value FROM s GROUP BY ALL) SELECT 'event_type=' || event_type AS group_name, ts, round({_e}, 6) AS value FROM b GROUP BY event_type, ts",
    )(lambda spark, d, r=_n: _plain(multi.multi_range(project.events(spark, d), MultiRangeSpec(ALL, RangeSpec(buckets=Buckets(("max",), HOUR)), group_by="event_type", reduce=r))))
_UNIT = f"u AS (SELECT m.series_key, ts, value, v AS unit FROM m JOIN l ON m.series_key = l.series_key AND k = 'unit')"
for _n, _e in (("countnan", "CAST(count(*) FILTER (isnan(value)) AS DOUBLE)"), ("sum", "sum(value) FILTER (NOT isnan(value))"), ("min", "min(value) FILTER (NOT isnan(value))"), ("countall", "CAST(count(*) AS DOUBLE)")):
    # raw samples with NaN: left out of a reduction unless there is nothing else
    _query(
        f"groupby_reduce_{_n}" if _n == "countnan" else f"groupby_nan_{_n}",
        f"WITH {_M}, {_L}, {_UNIT} SELECT 'unit=' || unit AS group_name, ts, round({_e}, 6) AS value, {_e} IS NULL AS value_nan FROM u GROUP BY unit, ts",
    )(lambda spark, d, r=_n: _plain(_by_unit(spark, d, r), flags=True))


def _by_unit(spark: SparkSession, d: str, reduce: str) -> DataFrame:
    ts = project.monitoring(spark, d)
    every = [r.value for r in select.label_values(ts.series, "unit").collect()]  # a few units
    return multi.multi_range(ts, MultiRangeSpec((f"unit=({','.join(every)})",), RangeSpec(retention=False), group_by="unit", reduce=reduce))


_query("groupby_raw_sum", f"WITH {_S} SELECT 'user_id=' || user_id AS group_name, ts, round(sum(value), 6) AS value FROM s GROUP BY user_id, ts")(
    lambda spark, d: _plain(multi.multi_range(project.events(spark, d), MultiRangeSpec(ALL, group_by="user_id", reduce="sum")))
)
_query(
    "groupby_limit",
    f"WITH {_S}, b AS (SELECT series_key, event_type, {_floor('ts', HOUR)} AS ts, max(value) AS value FROM s GROUP BY ALL), g AS (SELECT event_type, ts, max(value) AS value FROM b GROUP BY ALL) SELECT 'event_type=' || event_type AS group_name, ts, round(value, 6) AS value FROM g QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) <= 5",
)(lambda spark, d: _plain(multi.multi_range(project.events(spark, d), MultiRangeSpec(ALL, RangeSpec(buckets=Buckets(("max",), HOUR), count=5, reverse=True), group_by="event_type", reduce="max"))))
_query(
    "group_identity",
    f"WITH {_S} SELECT 'event_type=' || event_type AS group_name, event_type, 'max' AS reducer, string_agg(DISTINCT series_key, ',' ORDER BY series_key) AS sources FROM s GROUP BY event_type",
)(
    lambda spark, d: multi.group_labels(project.events(spark, d), MultiRangeSpec(ALL, group_by="event_type", reduce="max")).select(
        "group_name", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["__reducer__"].alias("reducer"), F.col("labels")["__source__"].alias("sources")
    )
)

# --- pivot
_KEYS = [ONE, "events:view:7", "events:purchase:7", ONE]
_query(
    "nrange_raw",
    f"WITH {_S} SELECT ts, " + ", ".join(f"round(max(value) FILTER (series_key = '{k}'), 6) AS c{i}, max(value) FILTER (series_key = '{k}') IS NULL AS c{i}_nan" for i, k in enumerate(_KEYS)) + f" FROM s WHERE series_key IN ('{ONE}', 'events:view:7', 'events:purchase:7') GROUP BY ts",
)(lambda spark, d: _plain(multi.pivot_range(project.events(spark, d), _KEYS, RangeSpec()), flags=True))
_query(
    "nrange_agg",
    f"WITH {_S}, b AS (SELECT series_key, {_floor('ts', 7 * DAY)} AS ts, max(value) AS hi, min(value) AS lo, sum(value) AS total FROM s GROUP BY ALL) SELECT ts, round(max(hi) FILTER (series_key = '{ONE}'), 6) AS c0, round(max(lo) FILTER (series_key = '{ONE}'), 6) AS c1, round(max(total) FILTER (series_key = 'events:view:7'), 6) AS c2 FROM b WHERE series_key IN ('{ONE}', 'events:view:7') GROUP BY ts",
)(lambda spark, d: _plain(multi.pivot_range(project.events(spark, d), [ONE, "events:view:7"], RangeSpec(buckets=Buckets(("sum",), 7 * DAY)), ["max,min", "sum"])))

# --- two-step and newest-first queries
_query(
    "times_where",
    f"WITH {_S}, t AS (SELECT DISTINCT ts FROM s WHERE series_key = '{ONE}' AND value > 20) SELECT series_key, ts, round(value, 6) AS value FROM s WHERE event_type = 'click' AND ts IN (SELECT ts FROM t)",
)(lambda spark, d: _plain(multi.times_where(project.events(spark, d), ONE, 20.0, CLICKS)))
_query("newest_rows", f"WITH {_S} SELECT series_key, ts, round(value, 6) AS value FROM s WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY ts DESC) <= 1")(
    lambda spark, d: _plain(multi.newest_rows(project.events(spark, d), CLICKS, 1))
)

# --- duplicate policies
for _p, _e in (("last", "max_by(value, seq)"), ("first", "min_by(value, seq)"), ("min", "min(value)"), ("max", "max(value)"), ("sum", "sum(value)")):
    _query(
        f"dup_{_p}",
        f"WITH l AS (SELECT 'supplier:' || CAST(l_suppkey AS VARCHAR) AS series_key, epoch_us(l_shipdate) // 1000 AS ts, l_quantity AS value, l_orderkey * 100 + l_linenumber AS seq FROM lineitem) SELECT series_key, ts, {_e} AS value FROM l GROUP BY series_key, ts",
    )(lambda spark, d, p=_p: ingest.fold(project.shipments(spark, d), spark.createDataFrame([], "series_key string"), config=EngineConfig(p)))
_query(
    "dup_block_fold",
    "WITH l AS (SELECT 'supplier:' || CAST(l_suppkey AS VARCHAR) AS series_key, epoch_us(l_shipdate) // 1000 AS ts, l_quantity AS value, l_orderkey * 100 + l_linenumber AS seq FROM lineitem) SELECT series_key, ts, min_by(value, seq) AS value FROM l GROUP BY series_key, ts",
)(lambda spark, d: ingest.fold(project.shipments(spark, d), spark.createDataFrame([], "series_key string")))


_LOG = """i AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY seq) AS rn FROM (
  SELECT DISTINCT g.series_key, g.ts, g.value, g.seq, lower(coalesce(g.on_duplicate, c.p, 'block')) AS p, coalesce(c.ret, 0) AS ret, coalesce(c.dt, 0) AS dt, coalesce(c.dv, 0.0) AS dv,
    greatest(f.t0, c.lt) AS t0, CASE WHEN c.lt IS NULL OR f.t0 >= c.lt THEN f.v0 END AS v0
  FROM ingest g LEFT JOIN (SELECT series_key, max(duplicate_policy) AS p, max(CAST(retention_ms AS BIGINT)) AS ret, max(CAST(ignore_max_time_diff AS BIGINT)) AS dt, max(ignore_max_val_diff) AS dv,
      max(last_timestamp) AS lt FROM series GROUP BY ALL) c USING (series_key)
    LEFT JOIN (SELECT series_key, max(ts) AS t0, max_by(value, ts) AS v0 FROM m GROUP BY ALL) f USING (series_key)
  WHERE g.value IS NOT NULL)),
w AS (SELECT series_key, 0 AS rn, any_value(t0) AS lt, any_value(v0) AS lv, '' AS status FROM i GROUP BY ALL
  UNION ALL SELECT series_key, rn,
    CASE WHEN status = 'accepted' AND (lt IS NULL OR ts > lt) THEN ts ELSE lt END,
    CASE WHEN status <> 'accepted' OR ts < lt THEN lv WHEN lt IS NULL OR ts > lt OR lv IS NULL THEN value
         WHEN p = 'block' THEN lv WHEN isnan(lv) <> isnan(value) THEN CASE WHEN p IN ('first', 'last') AND isnan(lv) THEN value ELSE lv END
         WHEN p = 'first' THEN lv WHEN p = 'last' THEN value WHEN p = 'sum' THEN lv + value WHEN p = 'min' THEN least(lv, value) ELSE greatest(lv, value) END, status
  FROM (SELECT i.series_key, i.rn, i.ts, i.value, i.p, w.lt, w.lv,
      CASE WHEN ret > 0 AND w.lt > ts AND w.lt - ts > ret THEN 'rejected'
           WHEN p = 'last' AND ts >= w.lt AND ts - w.lt <= dt AND NOT isnan(value) AND NOT isnan(w.lv) AND abs(value - w.lv) <= dv THEN 'ignored' ELSE 'accepted' END AS status
    FROM w JOIN i ON i.series_key = w.series_key AND i.rn = w.rn + 1)),
s AS (SELECT i.series_key, i.ts, i.value, i.seq, i.p, w.status FROM i JOIN w USING (series_key, rn))"""


def _arrivals(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The distinct rows of the arrival log, the catalog, and the samples stored before."""
    ts = project.monitoring(spark, d)
    return table(spark, d, "ingest").dropDuplicates(), ts.series, ts.samples


_FOLD = f"""a AS (SELECT series_key, ts, -1 AS seq, value, 'last' AS p FROM m UNION ALL SELECT series_key, ts, seq, value, p FROM s WHERE status = 'accepted'),
g AS (SELECT series_key, ts, list({{'v': value, 'p': p}} ORDER BY seq) AS r FROM a GROUP BY ALL),
f AS (SELECT series_key, ts, list_reduce(r, lambda x, y: {{'v': CASE WHEN y.p = 'block' THEN x.v WHEN isnan(x.v) <> isnan(y.v) THEN CASE WHEN y.p IN ('first', 'last') AND isnan(x.v) THEN y.v ELSE x.v END
  WHEN y.p = 'first' THEN x.v WHEN y.p = 'last' THEN y.v WHEN y.p = 'sum' THEN x.v + y.v WHEN y.p = 'min' THEN least(x.v, y.v) ELSE greatest(x.v, y.v) END, 'p': y.p}}).v AS value FROM g)"""


@_query(
    "ingest_fold",
    f"""WITH RECURSIVE {_M}, {_LOG}, {_FOLD}
SELECT series_key, ts, CASE WHEN NOT isnan(value) THEN round(value, 6) END AS value, isnan(value) AS value_nan FROM f""",
)
def ingest_fold(spark: SparkSession, d: str) -> DataFrame:
    """The arrival log folded into the stored samples by all ingest rules."""
    return _plain(ingest.fold(*_arrivals(spark, d)), flags=True)


@_query(
    "ingest_outcomes",
    f"WITH RECURSIVE {_M}, {_LOG} SELECT series_key, status, count(*) AS n FROM (SELECT series_key, status FROM s UNION ALL SELECT series_key, 'unreadable' FROM (SELECT DISTINCT * FROM ingest) WHERE value IS NULL) GROUP BY ALL",
)
def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.outcomes(*_arrivals(spark, d)).groupBy("series_key", "status").agg(F.count("*").alias("n"))


_query(
    "increments",
    "WITH l AS (SELECT 'supplier:' || CAST(l_suppkey AS VARCHAR) AS series_key, l_orderkey * 100 + l_linenumber AS seq, l_quantity AS delta FROM lineitem), r AS (SELECT series_key, seq AS ts, sum(delta) OVER (PARTITION BY series_key ORDER BY seq) AS value FROM l) SELECT DISTINCT series_key, ts, value FROM r",
)(lambda spark, d: ingest.increments(project.shipments(spark, d).select("series_key", F.col("seq").alias("ts"), F.col("value").alias("delta"), "seq")))
_query("delete_range", f"WITH {_S} SELECT series_key, ts, round(value, 6) AS value FROM s WHERE NOT (series_key = '{ONE}' AND ts BETWEEN {LO} AND {MID})")(
    lambda spark, d: _plain(ingest.delete_range(project.events(spark, d).samples, ONE, LO, MID))
)

# --- downsampling rules
_RULE = f"""r AS (SELECT DISTINCT source_key AS series_key, dest_key, lower(trim(agg)) AS agg, bucket_ms, coalesce(CAST(align_ms AS BIGINT), 0) AS align_ms FROM rules),
j AS (SELECT r.*, m.ts, m.value, m.ts - ((m.ts - align_ms) % bucket_ms + bucket_ms) % bucket_ms AS b FROM r JOIN m USING (series_key) WHERE agg <> 'twa'),
l AS (SELECT dest_key, bucket_ms, align_ms, agg, max(b) AS ob FROM j GROUP BY ALL),
g AS (SELECT dest_key, bucket_ms, align_ms, agg, b, CASE agg WHEN 'min' THEN min(v) WHEN 'max' THEN max(v) WHEN 'sum' THEN sum(v) WHEN 'avg' THEN avg(v) WHEN 'count' THEN CAST(count(v) AS DOUBLE)
  WHEN 'range' THEN max(v) - min(v) WHEN 'std.p' THEN stddev_pop(v) WHEN 'last' THEN max_by(v, ts) FILTER (v IS NOT NULL) WHEN 'first' THEN min_by(v, ts) FILTER (v IS NOT NULL) WHEN 'var.p' THEN var_pop(v) END AS value
  FROM (SELECT *, CASE WHEN NOT isnan(value) THEN value END AS v FROM j) GROUP BY dest_key, bucket_ms, align_ms, agg, b HAVING count(v) > 0)"""
_query("rule_closed_buckets", f"WITH {_M}, {_RULE} SELECT g.dest_key, g.b AS ts, round(g.value, 6) AS value FROM g JOIN l USING (dest_key, bucket_ms, align_ms, agg) WHERE g.b < ob")(
    lambda spark, d: _plain(rules.closed_buckets(project.monitoring(spark, d).samples, table(spark, d, "rules").where(F.lower(F.trim("agg")) != "twa")))
)
_query("rule_latest", f"WITH {_M}, {_RULE} SELECT g.dest_key AS series_key, g.b AS ts, round(g.value, 6) AS value FROM g JOIN l USING (dest_key, bucket_ms, align_ms, agg) WHERE g.b = ob AND dest_key IN (SELECT series_key FROM series) AND dest_key NOT IN (SELECT series_key FROM m WHERE ts >= ob)")(
    lambda spark, d: _plain(_latest(spark, d, F.lower(F.trim("agg")) != "twa"))
)
_TWA = f"""WITH {_M}, r AS (SELECT DISTINCT source_key AS series_key, dest_key, bucket_ms, coalesce(CAST(align_ms AS BIGINT), 0) AS align_ms FROM rules WHERE lower(trim(agg)) = 'twa'),
n AS (SELECT *, lag(ts) OVER w AS pt, lag(value) OVER w AS pv, lead(ts) OVER w AS nt, lead(value) OVER w AS nv FROM m WHERE NOT isnan(value) WINDOW w AS (PARTITION BY series_key ORDER BY ts)),
j AS (SELECT r.dest_key, bucket_ms AS d, align_ms, n.*, ts - ((ts - align_ms) % bucket_ms + bucket_ms) % bucket_ms AS b FROM n JOIN r USING (series_key)),
l AS (SELECT dest_key, bucket_ms AS d, align_ms, max(ts - ((ts - align_ms) % bucket_ms + bucket_ms) % bucket_ms) AS ob FROM m JOIN r USING (series_key) GROUP BY ALL),
a AS (SELECT dest_key, d, align_ms, b, ts, value,
 CASE WHEN pt IS NULL THEN 0 WHEN pt >= b THEN (pv + value) / 2 * (ts - pt) ELSE (pv + (value - pv) * (b - pt) / (ts - pt) + value) / 2 * (ts - b) END
 + CASE WHEN nt >= b + d THEN (value + value + (nv - value) * (b + d - ts) / (nt - ts)) / 2 * (b + d - ts) ELSE 0 END AS area,
 CASE WHEN pt IS NULL THEN 0 ELSE ts - greatest(pt, b) END + CASE WHEN nt >= b + d THEN b + d - ts ELSE 0 END AS width FROM j)"""
_query(
    "rule_twa_buckets",
    f"""{_TWA}
SELECT dest_key, b AS ts, round(CASE WHEN sum(width) > 0 THEN sum(area) / sum(width) ELSE max_by(value, ts) END, 6) AS value
FROM a JOIN l USING (dest_key, d, align_ms) WHERE b < ob GROUP BY dest_key, d, align_ms, b""",
)(lambda spark, d: _plain(rules.closed_buckets(project.monitoring(spark, d).samples, table(spark, d, "rules").where(F.lower(F.trim("agg")) == "twa"))))
_query(
    "rule_latest_twa",
    f"""{_TWA}
SELECT dest_key AS series_key, b AS ts, round(CASE WHEN sum(width) > 0 THEN sum(area) / sum(width) ELSE max_by(value, ts) END, 6) AS value
FROM a JOIN l USING (dest_key, d, align_ms) WHERE b = ob AND dest_key IN (SELECT series_key FROM series) AND dest_key NOT IN (SELECT series_key FROM m WHERE m.ts >= ob) GROUP BY dest_key, d, align_ms, b""",
)(lambda spark, d: _plain(_latest(spark, d, F.lower(F.trim("agg")) == "twa")))


_CLOSED = f"WITH {_RULE} SELECT g.dest_key AS series_key, g.b AS ts, g.value FROM g JOIN l USING (dest_key, bucket_ms, align_ms, agg) WHERE g.b < ob"
_CLOSED_TWA = _TWA.replace(f"{_M}, ", "", 1) + """ SELECT dest_key AS series_key, b AS ts, CASE WHEN sum(width) > 0 THEN sum(area) / sum(width) ELSE max_by(value, ts) END AS value
FROM a JOIN l USING (dest_key, d, align_ms) WHERE b < ob GROUP BY dest_key, d, align_ms, b"""
_OPEN = f"WITH {_RULE} SELECT g.dest_key AS series_key, g.b AS ts, g.value FROM g JOIN l USING (dest_key, bucket_ms, align_ms, agg) WHERE g.b = ob AND dest_key IN (SELECT series_key FROM series) AND dest_key NOT IN (SELECT series_key FROM m WHERE ts >= ob)"
_OPEN_TWA = _TWA.replace(f"{_M}, ", "", 1) + """ SELECT dest_key AS series_key, b AS ts, CASE WHEN sum(width) > 0 THEN sum(area) / sum(width) ELSE max_by(value, ts) END AS value
FROM a JOIN l USING (dest_key, d, align_ms) WHERE b = ob AND dest_key IN (SELECT series_key FROM series) AND dest_key NOT IN (SELECT series_key FROM m WHERE m.ts >= ob) GROUP BY dest_key, d, align_ms, b"""
_query("rule_latest_all", f"WITH {_M} SELECT series_key, ts, round(value, 6) AS value FROM (SELECT * FROM ({_OPEN}) UNION ALL SELECT * FROM ({_OPEN_TWA}))")(
    lambda spark, d: _plain(_latest(spark, d, F.lit(True)))
)
_query("rule_closed_all", f"WITH {_M} SELECT series_key, ts, round(value, 6) AS value FROM (SELECT * FROM ({_CLOSED}) UNION ALL SELECT * FROM ({_CLOSED_TWA}))")(
    lambda spark, d: _plain(rules.closed_buckets(project.monitoring(spark, d).samples, table(spark, d, "rules")).withColumnRenamed("dest_key", "series_key"))
)


def _latest(spark: SparkSession, d: str, which: Column) -> DataFrame:
    ts = project.monitoring(spark, d)
    return rules.open_buckets(type(ts)(ts.samples, ts.series, ts.rules.where(which)), ts.series)


#: What all rules have written once the log is folded into the stored samples.
_STORED = _M.replace("m AS", "m0 AS", 1)
_AFTER = ", ".join(x.replace("FROM m ", "FROM m0 ") for x in (_LOG, _FOLD))
_REFRESHED = f"""WITH RECURSIVE {_STORED}, {_AFTER}, m AS (SELECT series_key, ts, value FROM f)
SELECT series_key, ts, round(value, 6) AS value FROM (SELECT * FROM ({_CLOSED}) UNION ALL SELECT * FROM ({_CLOSED_TWA}))"""


@_query("rule_refresh", _REFRESHED)
def rule_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Destinations after the arrival log came on top of the stored samples: only touched buckets are made anew."""
    ts = project.monitoring(spark, d)
    log = table(spark, d, "ingest").dropDuplicates()
    after = checkpointed(ingest.fold(log, ts.series, ts.samples))
    before = rules.closed_buckets(ts.samples, ts.rules).withColumnRenamed("dest_key", "series_key")
    return _plain(rules.refresh(before, after, ts.rules, log.select("series_key", "ts")))


# --- options, rules and policies of the catalog
_CREATED = f"SELECT '{ONE}' AS source_key, '{ONE}_' || a AS dest_key, g AS agg, b AS bucket_ms, c AS align_ms FROM (VALUES"


@_query("create_rules", f"{_CREATED} ('one', 'sum', {HOUR}, 0), ('two', 'twa', {DAY}, 5)) v(a, g, b, c)")
def create_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules that were created, without one that was deleted again."""
    ts = project.events(spark, d)
    for name, agg, width, align in (("one", "SUM", HOUR, 0), ("two", "twa", DAY, 5), ("three", "max", DAY, 0)):
        ts = rules.create_rule(create(ts, f"{ONE}_{name}"), ONE, f"{ONE}_{name}", agg, width, align)
    return rules.delete_rule(ts, ONE, f"{ONE}_three").rules.select("source_key", "dest_key", "agg", "bucket_ms", "align_ms")


@_query("default_policies", f"{_CREATED} ('MAX_60000_60000', 'max', 60000, 60000), ('MIN_10000', 'min', 10000, 0), ('LAST_300000', 'last', 300000, 0)) v(a, g, b, c)")
def default_policies(spark: SparkSession, d: str) -> DataFrame:
    """Rules and destinations that a string of policies asks for; those without a destination in the catalog are left out."""
    ts = rules.apply_policies(project.events(spark, d), ONE, "max:1M:1h:1M;min:10s:10d:0m;last:5M:10m")
    made = ts.rules.join(ts.series.select(F.col("series_key").alias("dest_key")), "dest_key")
    return made.select("source_key", "dest_key", "agg", "bucket_ms", "align_ms")


_query("alter_series", f"WITH {_S}, l AS (SELECT max(ts) AS last FROM s WHERE series_key = '{ONE}') SELECT ts, round(value, 6) AS value FROM s, l WHERE series_key = '{ONE}' AND ts >= last - {3 * DAY}")(
    lambda spark, d: _plain(range_query(alter(project.events(spark, d), ONE, retention_ms=3 * DAY), ONE, RangeSpec()))
)
_query("copy_and_rename", f"WITH {_S} SELECT 'copied' AS series_key, ts, round(value, 6) AS value FROM s WHERE series_key = '{ONE}' UNION ALL SELECT 'renamed', ts, round(value, 6) FROM s WHERE series_key = '{ONE}'")(
    lambda spark, d: _plain(rename_series(copy_series(project.events(spark, d), ONE, "copied"), ONE, "renamed").samples.where(F.col("series_key").isin("copied", "renamed", ONE)))
)
