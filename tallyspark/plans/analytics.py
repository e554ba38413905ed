"""Queries on daily and event facts, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import filters as FI
from tallyspark.operators import insights as I
from tallyspark.operators import joins as J
from tallyspark.operators import pricing as P
from tallyspark.operators import rollup as R
from tallyspark.operators import series as W
from tallyspark.operators import topk as K
from tallyspark.operators import totals as A
from tallyspark.plans import adapter as U
from tallyspark.plans.adapter import BASE, dbl

QUERIES: dict = {}
ORACLE_SQL: dict = {}

START, END = date(2024, 1, 8), date(2024, 1, 20)
P0, P1 = date(2023, 12, 26), date(2024, 1, 7)
SOURCES = ["click", "error", "purchase", "signup", "view"]
_IN = "usage_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-20'"
_BEFORE = "usage_date BETWEEN DATE '2023-12-26' AND DATE '2024-01-07'"
_SPINE = "spine AS (SELECT CAST(unnest(generate_series(DATE '2024-01-08', DATE '2024-01-20', INTERVAL 1 DAY)) AS DATE) AS usage_date)"
_PER_DAY = f"per_day AS (SELECT s.usage_date, CAST(coalesce(sum(d.total_tokens), 0) AS BIGINT) AS value FROM spine s LEFT JOIN daily d ON d.usage_date = s.usage_date GROUP BY 1)"
_L = lambda x: f"CAST(coalesce(sum({x}), 0) AS BIGINT)"
_PCT = lambda a, b: f"CASE WHEN {b} <> 0 THEN CAST({a} AS DOUBLE) / {b} * 100 ELSE 0.0 END"


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = BASE + sql
        return f

    return put


def _period(spark: SparkSession, d: str) -> DataFrame:
    return FI.filter_period(U.daily(spark, d), START, END)


def _prior(spark: SparkSession, d: str) -> DataFrame:
    return FI.filter_period(U.daily(spark, d), P0, P1)


def _series(spark: SparkSession, d: str) -> DataFrame:
    return A.daily_series(_period(spark, d), A.spine(spark, START, END))


_TOTALS = f"""{_L('total_tokens')} AS total, {_L('input_tokens')} AS input, {_L('output_tokens')} AS output, {_L('cache_read_tokens')} AS cache_read, {_L('cache_creation_tokens')} AS cache_creation,
 {_L('cache_read_tokens')} + {_L('cache_creation_tokens')} AS cache, {_L('reasoning_output_tokens')} AS reasoning, {dbl('coalesce(sum(cost), 0)')} AS cost_usd, {_PCT(_L('cache_read_tokens'), _L('total_tokens'))} AS hit_rate"""


_SAVED = f"{dbl('coalesce(sum(saved), 0)')} AS saved_usd"


@query("A06_totals_by_source", f"{U.SAVED} SELECT source, {_TOTALS}, {_SAVED} FROM daily_saved GROUP BY source")
def totals_by_source(spark, d):
    return A.totals(U.daily_saved(spark, d), ["source"])


@query("A06_totals", f"{U.SAVED} SELECT {_TOTALS}, {_SAVED} FROM daily_saved WHERE {_IN}")
def totals(spark, d):
    return A.totals(FI.filter_period(U.daily_saved(spark, d), START, END))


@query("A07_sum_field", f"SELECT {_L('cache_read_tokens')} AS value FROM daily")
def sum_field(spark, d):
    return A.sum_field(U.daily(spark, d), "cache_read_tokens")


_KEYED = lambda k: f"SELECT {k} AS key, {_L('total_tokens')} AS total, {_L('cache_read_tokens')} AS cache_read, {dbl('sum(cost)')} AS cost_usd, count(DISTINCT usage_date) AS days, count(DISTINCT source) AS sources, count(DISTINCT model) AS models, {_PCT(_L('cache_read_tokens'), _L('total_tokens'))} AS hit_rate FROM daily WHERE {_IN} GROUP BY 1"


@query("A08_aggregate_by_key", _KEYED("model"))
def aggregate_by_key(spark, d):
    return A.aggregate_by_key(_period(spark, d), "model")


@query("A09_by_source_device", f"SELECT source, device, {_L('total_tokens')} AS total, {dbl('sum(cost)')} AS cost_usd, count(DISTINCT model) AS models, CAST({_L('total_tokens')} AS DOUBLE) / CAST(sum(sum(total_tokens)) OVER () AS BIGINT) * 100 AS share FROM daily GROUP BY 1, 2")
def by_source_device(spark, d):
    return A.by_source_device(U.daily(spark, d))


@query("A10_by_source_model", f"SELECT source, model, {_L('total_tokens')} AS total, {dbl('sum(cost)')} AS cost_usd, count(DISTINCT usage_date) AS days FROM daily GROUP BY 1, 2")
def by_source_model(spark, d):
    return A.by_source_model(U.daily(spark, d))


@query("A11_by_date_dimension", f"SELECT usage_date, device AS key, {_L('total_tokens')} AS total FROM daily GROUP BY 1, 2")
def by_date_dimension(spark, d):
    return A.by_date_dimension(U.daily(spark, d), "device")


@query("A12_trend_pivot", f", {_SPINE} SELECT s.usage_date, " + ", ".join(f"CAST(coalesce(sum(total_tokens) FILTER (source = '{x}'), 0) AS BIGINT) AS {x}" for x in SOURCES) + " FROM spine s LEFT JOIN daily d ON d.usage_date = s.usage_date GROUP BY 1")
def trend_pivot(spark, d):
    return A.trend_pivot(_period(spark, d), A.spine(spark, START, END), SOURCES)


@query("A13_daily_totals_map", f", {_SPINE}, g AS (SELECT usage_date, source, CAST(sum(total_tokens) AS BIGINT) AS t, sum(cost) AS c FROM daily GROUP BY 1, 2) SELECT s.usage_date, CAST(coalesce(sum(t), 0) AS BIGINT) AS total, {dbl('coalesce(sum(c), 0)')} AS cost_usd, string_agg(source || '=' || CAST(t AS VARCHAR), ',' ORDER BY source) AS by_tool FROM spine s LEFT JOIN g ON g.usage_date = s.usage_date GROUP BY 1")
def daily_totals_map(spark, d):
    out = A.daily_totals_map(_period(spark, d), A.spine(spark, START, END))
    text = F.array_join(F.transform(F.map_entries("by_tool"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("by_tool", text)


@query("A14_metric_spark_series", f", {_SPINE} SELECT s.usage_date, {_L('d.output_tokens')} AS value FROM spine s LEFT JOIN daily d ON d.usage_date = s.usage_date GROUP BY 1")
def metric_spark_series(spark, d):
    return A.daily_series(_period(spark, d), A.spine(spark, START, END), "output_tokens")


@query("A15_hit_rate_series", f"SELECT usage_date, {_PCT('sum(cache_read_tokens)', 'sum(total_tokens)')} AS hit_rate FROM daily GROUP BY 1 HAVING sum(total_tokens) > 0")
def hit_rate_series(spark, d):
    return A.hit_rate_series(U.daily(spark, d))


_EFF = f"{_PCT(_L('cache_read_tokens'), _L('total_tokens'))} AS hit_rate, CASE WHEN {_L('output_tokens')} > 0 THEN CAST({_L('input_tokens')} AS DOUBLE) / {_L('output_tokens')} ELSE 0.0 END AS io_ratio, {_PCT(_L('reasoning_output_tokens'), _L('total_tokens'))} AS reasoning_share"


@query("A16_efficiency_series", f", {_SPINE} SELECT s.usage_date, {_EFF} FROM spine s LEFT JOIN daily d ON d.usage_date = s.usage_date GROUP BY 1")
def efficiency_series(spark, d):
    return A.efficiency_series(_period(spark, d), A.spine(spark, START, END))


@query("A17_efficiency_totals", f"SELECT {_EFF} FROM daily WHERE {_IN}")
def efficiency_totals(spark, d):
    return A.efficiency(_period(spark, d))


@query("A18_source_share", f"SELECT source, total, CAST(total AS DOUBLE) / CAST(sum(total) OVER () AS BIGINT) * 100 AS share, CAST(max(total) OVER () AS DOUBLE) / CAST(sum(total) OVER () AS BIGINT) * 100 AS top_share FROM (SELECT source, {_L('total_tokens')} AS total FROM daily GROUP BY 1)")
def source_share(spark, d):
    return A.source_share(U.daily(spark, d))


@query("A19_unit_cost", f"SELECT source, {_L('total_tokens')} AS total, {dbl('sum(cost)')} AS cost_usd, {dbl('sum(cost)')} / (CAST({_L('total_tokens')} AS DOUBLE) / CAST(1000000 AS DOUBLE)) AS per_million FROM daily GROUP BY 1")
def unit_cost(spark, d):
    return A.unit_cost(U.daily(spark, d))


_HOUR = "CAST(hour(event_time + INTERVAL 8 HOUR) AS INTEGER)"


@query("A20_hour_of_day_marginal", f", h AS (SELECT {_HOUR} AS hour, {_L('total_tokens')} AS total FROM usage GROUP BY 1) SELECT hour, total, (SELECT hour FROM h ORDER BY total DESC, hour LIMIT 1) AS peak_hour FROM h")
def hour_marginal(spark, d):
    return A.hour_marginal(FI.valid_hours(R.hourly_cube(U.usage(spark, d), U.ZONE)))


@query(
    "A21_weekday_distribution",
    f", w AS (SELECT CAST(isodow(usage_date) - 1 AS INTEGER) AS weekday, {_L('total_tokens')} AS total FROM daily GROUP BY 1), x AS (SELECT CAST(round(CAST(sum(total) FILTER (weekday < 5) AS DOUBLE) / CAST(sum(total) AS DOUBLE) * 100) AS INTEGER) AS workdays FROM w) "
    "SELECT weekday, total, CAST(round(CAST(total AS DOUBLE) / CAST((SELECT sum(total) FROM w) AS DOUBLE) * 100) AS INTEGER) AS share, workdays, 100 - workdays AS weekend FROM w, x",
)
def weekday_distribution(spark, d):
    return A.weekday_distribution(U.daily(spark, d))


@query(
    "A22_hero_stats",
    f", g AS (SELECT usage_date, sum(total_tokens) AS t FROM daily WHERE {_IN} GROUP BY 1), s AS (SELECT source, sum(total_tokens) AS t FROM daily WHERE {_IN} GROUP BY 1), c AS (SELECT count(DISTINCT project_path) AS projects, count(DISTINCT source) AS sources, {dbl('sum(cost)')} AS cost_usd FROM daily WHERE {_IN}), n AS (SELECT CAST(sum(CASE WHEN t > 0 THEN 1 ELSE 0 END) AS BIGINT) AS active_days FROM g) "
    "SELECT active_days, (SELECT usage_date FROM g ORDER BY t DESC, usage_date LIMIT 1) AS peak_day, (SELECT source FROM s ORDER BY t DESC, source DESC LIMIT 1) AS top_source, (SELECT CAST(max(t) AS DOUBLE) / CAST(sum(t) AS DOUBLE) * 100 FROM s) AS top_share, projects, sources, cost_usd, cost_usd / active_days AS cost_per_day FROM c, n",
)
def hero_stats(spark, d):
    return A.hero_stats(_period(spark, d))


_SUMS = ", ".join(f"{_L(c)} AS {c}" for c in (*S.COUNTERS, "total_tokens"))


def _publish(df: DataFrame) -> DataFrame:
    return df.withColumn("cost_usd", P.as_double(F.col("cost"))).drop("cost")


@query("A01_rollup_daily", f"SELECT device, source, usage_date, model, {_SUMS}, {dbl('sum(cost)')} AS cost_usd, min(project_path) AS project_path FROM usage GROUP BY 1, 2, 3, 4")
def rollup_daily(spark, d):
    return _publish(U.daily(spark, d))


@query("A02_rollup_workspace_model", f"SELECT device, source, project_path, model, {_SUMS}, {dbl('sum(cost)')} AS cost_usd, arg_min(session_id, (event_time, event_id)) AS first_session, max(event_time) AS last_activity FROM usage GROUP BY 1, 2, 3, 4")
def rollup_workspace_model(spark, d):
    return _publish(R.rollup_workspace_model(U.usage(spark, d)))


@query("A03_rollup_flat_repriced", f", g AS (SELECT device, source, usage_date, model, provider, {_SUMS} FROM usage GROUP BY 1, 2, 3, 4, 5), p AS (SELECT g.*, {U.cost_sql(tiered=False)} AS cost FROM g LEFT JOIN rates r ON r.model = g.model AND r.provider IS NOT DISTINCT FROM g.provider) SELECT device, source, usage_date, model, {_SUMS}, {dbl('sum(cost)')} AS cost_usd FROM p GROUP BY 1, 2, 3, 4")
def rollup_flat(spark, d):
    named = U.named(spark, d)
    return _publish(R.rollup_flat_repriced(named, U.resolved(spark, d)))


@query("A04_hourly_cube", f"SELECT device, source, usage_date, {_HOUR} AS hour, model, count(*) AS calls, {_L('total_tokens')} AS total_tokens, {dbl('sum(cost)')} AS cost_usd FROM usage GROUP BY 1, 2, 3, 4, 5")
def hourly_cube(spark, d):
    return _publish(R.hourly_cube(U.usage(spark, d), U.ZONE))


@query("A05_event_sums_by_day", f"SELECT device, source, usage_date, model, count(*) AS n, {_L('total_tokens')} AS event_tokens, {dbl('sum(cost)')} AS event_cost FROM usage GROUP BY 1, 2, 3, 4")
def event_sums(spark, d):
    return R.event_sums_by_day(U.usage(spark, d)).withColumn("event_cost", P.as_double(F.col("event_cost")))


_DAY = f"SELECT device, source, usage_date, model, total_tokens FROM daily"


@query("F01_filter_daily", f"{_DAY} WHERE {_IN} AND source IN ('click', 'view') AND device = 'dev-1'")
def filter_daily(spark, d):
    return FI.filter_daily(U.daily(spark, d), START, END, ["click", "view"], ["dev-1"]).select("device", "source", "usage_date", "model", "total_tokens")


@query("F02_filter_time", "SELECT event_key, event_time FROM usage WHERE event_time >= TIMESTAMP '2024-01-08 00:00:00' AND event_time <= TIMESTAMP '2024-01-20 23:59:00' AND source = 'error'")
def filter_time(spark, d):
    return FI.filter_time(U.usage(spark, d), datetime(2024, 1, 8), datetime(2024, 1, 20, 23, 59), ["error"]).select("event_key", "event_time")


@query("F03_filter_period", f"{_DAY} WHERE {_IN}")
def filter_period(spark, d):
    return _period(spark, d).select("device", "source", "usage_date", "model", "total_tokens")


@query("F04_filter_sessions_runs", f"SELECT session_id, {_L('total_tokens')} AS total_tokens FROM usage WHERE source = 'view' AND device = 'dev-2' GROUP BY 1")
def filter_sessions(spark, d):
    return FI.filter_members(R.rollup_sessions(U.usage(spark, d)), ["view"], ["dev-2"]).select("session_id", "total_tokens")


@query("F05_search_any_column", f"{_DAY} WHERE lower(device || chr(1) || source || chr(1) || model) LIKE '%gamma%'")
def search(spark, d):
    return FI.search_any_column(U.daily(spark, d), " GAMMA ", ["device", "source", "model"]).select("device", "source", "usage_date", "model", "total_tokens")


@query("F06_focus_source", f"{_DAY} WHERE {_IN} AND source = 'purchase'")
def focus_source(spark, d):
    return FI.filter_daily(U.daily(spark, d), START, END, ["purchase"]).select("device", "source", "usage_date", "model", "total_tokens")


@query("F07_drill_filter", f"{_DAY} WHERE source = 'click' AND model = 'm-delta'")
def drill(spark, d):
    return FI.drill_filter(U.daily(spark, d), "model", source="click", model="m-delta").select("device", "source", "usage_date", "model", "total_tokens")


@query("F08_valid_hour_rows", f"SELECT usage_date, {_HOUR} AS hour, {_L('total_tokens')} AS total_tokens FROM usage GROUP BY 1, 2")
def valid_hours(spark, d):
    return FI.valid_hours(R.hourly_cube(U.usage(spark, d), U.ZONE)).groupBy("usage_date", "hour").agg(F.sum("total_tokens").alias("total_tokens"))


@query("F09_unpriced_rows", f"{_DAY} WHERE total_tokens > 0 AND cost = 0")
def unpriced(spark, d):
    return FI.unpriced_rows(U.daily(spark, d)).select("device", "source", "usage_date", "model", "total_tokens")


@query("F10_filter_options", "SELECT DISTINCT model FROM usage")
def filter_options(spark, d):
    return FI.filter_options(U.named(spark, d), "model")


@query("F10_date_range", "SELECT min(usage_date) AS first_day, max(usage_date) AS last_day FROM usage")
def date_range(spark, d):
    return FI.date_range(U.named(spark, d))


@query("F11_present_runs", "SELECT event_id AS id, trim(regexp_replace('  run ' || chr(10) || raw_model || '   of ' || source, '\\s+', ' ', 'g')) AS message, CASE WHEN length(x) > 12 THEN substr(x, 1, 12) || '…' ELSE x END AS device FROM (SELECT *, device || '-' || source AS x FROM usage_raw)")
def present_runs(spark, d):
    runs = U.usage_raw(spark, d).select(F.col("event_id").alias("id"), F.concat(F.lit("  run \n"), "raw_model", F.lit("   of "), "source").alias("message"), F.concat_ws("-", "device", "source").alias("device"))
    return FI.present_runs(runs.withColumn("device", F.concat("device", F.lit(".local"))), most=12)


@query("F12_present_sessions", "SELECT session_id, CAST(max(event_time) AS DATE) AS last_activity, CASE WHEN min(user_id) % 3 = 0 THEN 'x' || session_id ELSE min(project_path) END AS project_path FROM usage_raw GROUP BY session_id")
def present_sessions(spark, d):
    s = U.usage_raw(spark, d).groupBy("session_id").agg(F.max("event_time").alias("last_activity"), F.min("project_path").alias("project_path"), F.min("user_id").alias("u"))
    s = s.withColumn("project_path", F.when(F.col("u") % 3 == 0, "Unknown Project").otherwise(F.col("project_path"))).withColumn("session_id", F.when(F.col("u") % 3 == 0, F.concat(F.lit("a/b/x"), "session_id")).otherwise(F.col("session_id")))
    return FI.present_sessions(s).select(F.regexp_replace("session_id", "^a/b/x", "").alias("session_id"), "last_activity", "project_path")


@query("J02_join_price", f"SELECT event_key, model, {dbl('cost')} AS cost_usd FROM usage")
def join_price(spark, d):
    return U.usage(spark, d).select("event_key", "model", P.as_double(F.col("cost")).alias("cost_usd"))


@query(
    "J03_enrich_dominant_project",
    ", s AS (SELECT device, source, session_id, min(project_path) AS project_path, sum(total_tokens) AS t FROM usage GROUP BY 1, 2, 3), m AS (SELECT device, source, max(t) AS t FROM s GROUP BY 1, 2), p AS (SELECT s.device, s.source, min(project_path) AS dominant_project FROM s JOIN m ON s.device = m.device AND s.source = m.source AND s.t = m.t GROUP BY 1, 2) "
    "SELECT d.device, d.source, d.usage_date, d.model, p.dominant_project FROM daily d LEFT JOIN p ON p.device = d.device AND p.source = d.source",
)
def dominant_project(spark, d):
    u = U.usage(spark, d)
    return J.enrich_dominant_project(R.rollup_daily(u), R.rollup_sessions(u)).select("device", "source", "usage_date", "model", "dominant_project")


@query("J04_join_daily_event_sums", "SELECT device, source, usage_date, model, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(total_tokens) AS BIGINT) AS event_tokens, count(*) AS n FROM usage GROUP BY 1, 2, 3, 4")
def daily_event_sums(spark, d):
    u = U.usage(spark, d)
    return J.join_daily_event_sums(R.rollup_daily(u), R.event_sums_by_day(u)).select("device", "source", "usage_date", "model", "total_tokens", "event_tokens", "n")


_KEY2 = lambda k: f", a AS (SELECT {k} AS key, {_L('total_tokens')} AS total FROM daily WHERE {_IN} GROUP BY 1), b AS (SELECT {k} AS key, {_L('total_tokens')} AS before FROM daily WHERE {_BEFORE} GROUP BY 1), ab AS (SELECT a.key, total, coalesce(before, 0) AS before, CASE WHEN coalesce(before, 0) <> 0 THEN CAST(total - before AS DOUBLE) / before * 100 END AS delta FROM a LEFT JOIN b ON a.key = b.key)"


@query("J05_join_prior_period", f"{_KEY2('project_path')} SELECT * FROM ab")
def prior_period(spark, d):
    return I.prior_period(_period(spark, d), _prior(spark, d), "project_path")


@query("J06_date_spine_join", f", {_SPINE}, {_PER_DAY} SELECT * FROM per_day")
def date_spine(spark, d):
    return _series(spark, d)


_GRID = f", {_SPINE}, h AS (SELECT usage_date, {_HOUR} AS hour, sum(total_tokens) AS v FROM usage GROUP BY 1, 2), grid AS (SELECT s.usage_date, CAST(n AS INTEGER) AS hour, CAST(coalesce(v, 0) AS BIGINT) AS value FROM spine s CROSS JOIN range(24) t(n) LEFT JOIN h ON h.usage_date = s.usage_date AND h.hour = n)"


@query("J07_hour_grid_join", f"{_GRID} SELECT * FROM grid")
def hour_grid(spark, d):
    return W.hour_grid(R.hourly_cube(U.usage(spark, d), U.ZONE), A.spine(spark, START, END))


@query("J08_period_overlay_join", f", a AS (SELECT usage_date, {_L('total_tokens')} AS value, row_number() OVER (ORDER BY usage_date) AS place FROM daily WHERE {_IN} GROUP BY 1), s0 AS (SELECT CAST(unnest(generate_series(DATE '2023-12-26', DATE '2024-01-07', INTERVAL 1 DAY)) AS DATE) AS usage_date), b AS (SELECT s0.usage_date, {_L('total_tokens')} AS before, row_number() OVER (ORDER BY s0.usage_date) AS place FROM s0 LEFT JOIN daily d ON d.usage_date = s0.usage_date GROUP BY 1) SELECT CAST(a.place AS INTEGER) AS place, a.usage_date, value, coalesce(before, 0) AS before FROM a LEFT JOIN b ON a.place = b.place")
def period_overlay(spark, d):
    return W.period_overlay(_series(spark, d), A.daily_series(_prior(spark, d), A.spine(spark, P0, P1)))


@query("W02_rolling_mean", f", {_SPINE}, {_PER_DAY} SELECT usage_date, value, CAST(sum(value) OVER w AS DOUBLE) / count(value) OVER w AS mean FROM per_day WINDOW w AS (ORDER BY usage_date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)")
def rolling_mean(spark, d):
    return W.rolling_mean(_series(spark, d), 13)


@query(
    "W03_growth",
    f", g AS (SELECT usage_date, CAST(sum(total_tokens) AS BIGINT) AS t, row_number() OVER (ORDER BY usage_date DESC) AS r FROM usage GROUP BY 1), x AS (SELECT sum(t) FILTER (r = 1) AS d1, sum(t) FILTER (r = 2) AS d0, sum(t) FILTER (r <= 7) AS w1, sum(t) FILTER (r BETWEEN 8 AND 14) AS w0, sum(t) FILTER (r <= 30) AS m1, sum(t) FILTER (r BETWEEN 31 AND 60) AS m0, CAST(round(CAST(sum(t) AS DOUBLE) / count(*)) AS BIGINT) AS mean FROM g) "
    "SELECT CASE WHEN d0 <> 0 THEN CAST(d1 - d0 AS DOUBLE) / CAST(d0 AS DOUBLE) * 100 END AS day, CASE WHEN w0 <> 0 THEN CAST(w1 - w0 AS DOUBLE) / CAST(w0 AS DOUBLE) * 100 END AS week, CASE WHEN m0 <> 0 THEN CAST(m1 - m0 AS DOUBLE) / CAST(m0 AS DOUBLE) * 100 END AS month, mean, (SELECT usage_date FROM g ORDER BY t DESC, usage_date LIMIT 1) AS best_day FROM x",
)
def growth(spark, d):
    return W.growth(U.named(spark, d))


@query("W04_delta_pct", f"{_KEY2('source')} SELECT key, delta FROM ab")
def delta_pct(spark, d):
    return I.prior_period(_period(spark, d), _prior(spark, d), "source").select("key", "delta")


@query("W05_delta_class", f"{_KEY2('model')} SELECT key, CASE WHEN delta IS NULL THEN 'none' WHEN delta > 0.05 THEN 'up' WHEN delta < -0.05 THEN 'down' ELSE 'flat' END AS trend FROM ab")
def delta_class(spark, d):
    return I.prior_period(_period(spark, d), _prior(spark, d), "model").select("key", S.delta_class(F.col("delta")).alias("trend"))


@query("W06_compare_days", f", x AS (SELECT CAST(coalesce(sum(total_tokens) FILTER ({_IN}), 0) AS BIGINT) AS total, CAST(coalesce(sum(total_tokens) FILTER ({_BEFORE}), 0) AS BIGINT) AS before FROM daily) SELECT total, before, CASE WHEN before <> 0 THEN CAST(total - before AS DOUBLE) / before * 100 END AS delta, CASE WHEN before = 0 THEN 'none' WHEN CAST(total - before AS DOUBLE) / before * 100 > 0.05 THEN 'up' WHEN CAST(total - before AS DOUBLE) / before * 100 < -0.05 THEN 'down' ELSE 'flat' END AS trend FROM x")
def compare_days(spark, d):
    return W.compare_days(U.daily(spark, d), START, END)


@query("W07_compare_instants", "SELECT CAST(coalesce(sum(total_tokens) FILTER (event_time >= TIMESTAMP '2024-01-10 06:00:00' AND event_time <= TIMESTAMP '2024-01-12 05:59:00'), 0) AS BIGINT) AS total, CAST(coalesce(sum(total_tokens) FILTER (event_time >= TIMESTAMP '2024-01-08 06:00:00' AND event_time <= TIMESTAMP '2024-01-10 05:59:00'), 0) AS BIGINT) AS before FROM usage")
def compare_instants(spark, d):
    return W.compare_instants(U.named(spark, d), datetime(2024, 1, 10, 6), datetime(2024, 1, 12, 5, 59))


@query(
    "W08_streaks",
    f", {_SPINE}, v AS (SELECT s.usage_date, coalesce(sum(CASE WHEN day(event_time) IN (4, 5, 11, 18, 19) THEN 0 ELSE total_tokens END), 0) AS value FROM spine s LEFT JOIN usage u ON u.usage_date = s.usage_date GROUP BY 1), i AS (SELECT usage_date, usage_date - CAST(row_number() OVER (ORDER BY usage_date) AS INTEGER) AS island FROM v WHERE value > 0), r AS (SELECT count(*) AS n, max(usage_date) AS last_day FROM i GROUP BY island) "
    "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS active, coalesce(max(n), 0) AS longest, coalesce(max(n) FILTER (last_day = DATE '2024-01-20'), 0) AS current FROM r",
)
def streaks(spark, d):
    """Events of some days count nothing, which makes the gaps."""
    rows = U.named(spark, d).withColumn("total_tokens", F.when(F.dayofmonth("event_time").isin(4, 5, 11, 18, 19), 0).otherwise(F.col("total_tokens")))
    return W.streaks(W.series(spark, rows, START, END))


@query("W09_peak_day", f", {_SPINE}, {_PER_DAY} SELECT usage_date, value FROM per_day ORDER BY value DESC, usage_date LIMIT 1")
def peak_day(spark, d):
    return W.peak_day(_series(spark, d))


@query("W10_heat_level", f"{_GRID} SELECT usage_date, hour, value, CASE WHEN value <= 0 THEN 0 ELSE CAST(least(4, greatest(1, ceil(pow(CAST(value AS DOUBLE) / CAST(greatest(max(value) OVER (), 1) AS DOUBLE), 0.55) * 4))) AS INTEGER) END AS level FROM grid")
def heat_level(spark, d):
    return W.heat_level(W.hour_grid(R.hourly_cube(U.usage(spark, d), U.ZONE), A.spine(spark, START, END)))


@query("W11_calendar_grid", f", days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) SELECT CAST(date_trunc('month', day) AS DATE) AS month, day, CAST(floor((day(day) - 1 + dayofweek(date_trunc('month', day))) / 7) AS INTEGER) AS week, CAST(dayofweek(day) AS INTEGER) AS cell, day BETWEEN DATE '2024-01-08' AND DATE '2024-01-20' AS inside, CAST(coalesce((SELECT sum(total_tokens) FROM daily x WHERE x.usage_date = day), 0) AS BIGINT) AS value FROM days")
def calendar_grid(spark, d):
    per_day = U.daily(spark, d).groupBy(F.col("usage_date").alias("day")).agg(F.sum("total_tokens").alias("v"))
    return W.calendar_grid(spark, START, END).join(per_day, "day", "left").select("month", "day", "week", "cell", "inside", F.coalesce("v", F.lit(0)).alias("value"))


@query("W12_share_of_total", f"SELECT model, {_L('total_tokens')} AS total, CAST({_L('total_tokens')} AS DOUBLE) / CAST(sum(sum(total_tokens)) OVER () AS BIGINT) * 100 AS share FROM daily GROUP BY 1")
def share_of_total(spark, d):
    return A.with_share(U.daily(spark, d).groupBy("model").agg(A.zero("total_tokens").alias("total")))


@query("K01_top_models", f"SELECT model, {_L('total_tokens')} AS total, {dbl('sum(cost)')} AS cost_usd, count(*) AS n, min(source) AS first_source FROM daily GROUP BY 1 ORDER BY total DESC, model LIMIT 5")
def top_models(spark, d):
    return K.top_models(U.daily(spark, d))


_TOP = lambda g: f"(SELECT {g}, model, total FROM (SELECT {g}, model, {_L('total_tokens')} AS total, row_number() OVER (PARTITION BY {g} ORDER BY sum(total_tokens) DESC, model) AS p FROM daily GROUP BY 1, 2) WHERE p = 1)"


@query("K02_top_model_per_group", f"SELECT * FROM {_TOP('project_path')}")
def top_model_per_group(spark, d):
    return K.top_model_per_group(U.daily(spark, d), "project_path")


@query("K03_top_n_with_rest", f", s AS (SELECT session_id AS key, {_L('total_tokens')} AS total, sum(cost) AS c, row_number() OVER (ORDER BY sum(total_tokens) DESC, session_id) AS p FROM usage GROUP BY 1) SELECT CASE WHEN (SELECT count(*) FROM s) <= 8 OR p < 8 THEN key ELSE 'rest' END AS key, CAST(sum(total) AS BIGINT) AS total, {dbl('sum(c)')} AS cost_usd, count(*) AS members FROM s GROUP BY 1")
def top_n_with_rest(spark, d):
    return K.top_n_with_rest(U.usage(spark, d), "session_id")


@query("K04_peak_days", f", {_SPINE}, {_PER_DAY} SELECT * FROM per_day WHERE value > 0 ORDER BY value DESC, usage_date LIMIT 3")
def peak_days(spark, d):
    return K.peak_days(_series(spark, d))


@query("K05_peak_day_drivers", f", g AS (SELECT usage_date, {_L('total_tokens')} AS value FROM daily GROUP BY 1 ORDER BY value DESC, usage_date LIMIT 3), s AS (SELECT usage_date, source, row_number() OVER (PARTITION BY usage_date ORDER BY sum(total_tokens) DESC, source) AS p FROM daily GROUP BY 1, 2), j AS (SELECT usage_date, project_path, row_number() OVER (PARTITION BY usage_date ORDER BY sum(total_tokens) DESC, project_path) AS p FROM daily GROUP BY 1, 2) SELECT g.usage_date, value, s.source AS top_source, j.project_path AS top_project FROM g JOIN s ON s.usage_date = g.usage_date AND s.p = 1 JOIN j ON j.usage_date = g.usage_date AND j.p = 1")
def peak_day_drivers(spark, d):
    return K.peak_day_drivers(U.daily(spark, d))


@query("K06_sessions_by_tokens", f"SELECT device, source, session_id, {_L('total_tokens')} AS total_tokens FROM usage GROUP BY 1, 2, 3 ORDER BY total_tokens DESC, session_id LIMIT 50")
def sessions_by_tokens(spark, d):
    return K.by_tokens(R.rollup_sessions(U.usage(spark, d)), 50).select("device", "source", "session_id", "total_tokens")


@query("K07_latest_runs", "SELECT event_id AS id, device FROM usage_raw ORDER BY id DESC LIMIT 500")
def latest_runs(spark, d):
    return K.latest_runs(U.usage_raw(spark, d).select(F.col("event_id").alias("id"), "device"))


@query("K08_sort_any_column", "SELECT event_key, raw_model, row_number() OVER (ORDER BY lower(raw_model) DESC, event_key) AS place FROM usage_raw")
def sort_any_column(spark, d):
    rows = U.usage_raw(spark, d).select("event_key", "raw_model")
    return K.numbered(K.sort_any_column(rows, "raw_model", True, "event_key"))


@query("K09_latest_sync", "SELECT arg_max(event_time, event_id) AS collected_at FROM usage_raw")
def latest_sync(spark, d):
    return K.latest_sync(U.usage_raw(spark, d).select(F.col("event_id").alias("id"), F.col("event_time").alias("collected_at")))


@query("I01_insight_spike_day", f", g AS (SELECT usage_date, CAST(sum(total_tokens) AS BIGINT) AS t FROM daily GROUP BY 1 HAVING sum(total_tokens) > 0), p AS (SELECT usage_date, t, CAST(t AS DOUBLE) / (CAST((SELECT sum(t) FROM g) AS DOUBLE) / (SELECT count(*) FROM g)) AS ratio FROM g ORDER BY t DESC, usage_date LIMIT 1), s AS (SELECT usage_date, source, sum(total_tokens) AS st, row_number() OVER (PARTITION BY usage_date ORDER BY sum(total_tokens) DESC, source) AS r FROM daily GROUP BY 1, 2) SELECT p.usage_date, t AS total, ratio, source, CAST(st AS DOUBLE) / t * 100 AS source_share FROM p JOIN s ON s.usage_date = p.usage_date AND r = 1 WHERE ratio > 1.05")
def spike_day(spark, d):
    return I.insight_spike_day(U.daily(spark, d), factor=1.05)


_GAP = f", s AS (SELECT source, CAST(sum(total_tokens) AS BIGINT) AS t, {dbl('sum(cost)')} AS c FROM daily GROUP BY 1), q AS (SELECT *, c / (CAST(t AS DOUBLE) / CAST(1000000 AS DOUBLE)) AS rate, row_number() OVER (ORDER BY c DESC, source) AS p FROM s WHERE c > 0 AND t > 0)"


@query("I02_insight_unit_cost_gap", f"{_GAP} SELECT a.source, b.source AS cheaper, a.rate, b.rate AS cheaper_rate, a.c - CAST(a.t AS DOUBLE) / CAST(1000000 AS DOUBLE) * b.rate AS saving FROM q a, q b WHERE a.p = 1 AND b.p = 2 AND a.rate > CAST(0.9 AS DOUBLE) * b.rate")
def unit_cost_gap(spark, d):
    return I.insight_unit_cost_gap(U.daily(spark, d), factor=0.9)


@query("I03_insight_cache_shift", f", x AS (SELECT {_L('cache_read_tokens')} AS r1, {_L('total_tokens')} AS t1 FROM daily WHERE {_IN}), y AS (SELECT {_L('cache_read_tokens')} AS r0, {_L('total_tokens')} AS t0 FROM daily WHERE {_BEFORE}) SELECT {_PCT('r1', 't1')} AS hit_rate, {_PCT('r0', 't0')} AS before, r1 - r0 AS cached_delta FROM x, y WHERE t0 > 0 AND abs({_PCT('r1', 't1')} - {_PCT('r0', 't0')}) > 0.001")
def cache_shift(spark, d):
    return I.insight_cache_shift(_period(spark, d), _prior(spark, d), points=0.001)


@query("I04_insight_growth_project", f"{_KEY2('project_path')} SELECT ab.key, total, before, delta, days, CAST(total AS DOUBLE) / days AS per_day FROM ab JOIN (SELECT project_path AS key, count(DISTINCT usage_date) AS days FROM daily WHERE {_IN} GROUP BY 1) c ON c.key = ab.key WHERE before > 0 AND delta > 50 AND total > 100000 ORDER BY delta DESC, ab.key LIMIT 1")
def growth_project(spark, d):
    return I.insight_growth_project(_period(spark, d), _prior(spark, d))


_FINDINGS = (
    f", now AS (SELECT * FROM daily WHERE {_IN}), g AS (SELECT usage_date, CAST(sum(total_tokens) AS BIGINT) AS t FROM now GROUP BY 1 HAVING sum(total_tokens) > 0), "
    "spike AS (SELECT 1 AS ord, 'spike_day' AS kind, CAST(usage_date AS VARCHAR) AS subject, ratio AS value FROM (SELECT usage_date, CAST(t AS DOUBLE) / (CAST((SELECT sum(t) FROM g) AS DOUBLE) / (SELECT count(*) FROM g)) AS ratio FROM g ORDER BY t DESC, usage_date LIMIT 1) WHERE ratio > 2.2), "
    f"s AS (SELECT source, CAST(sum(total_tokens) AS BIGINT) AS t, {dbl('sum(cost)')} AS c FROM now GROUP BY 1), q AS (SELECT *, c / (CAST(t AS DOUBLE) / CAST(1000000 AS DOUBLE)) AS rate, row_number() OVER (ORDER BY c DESC, source) AS p FROM s WHERE c > 0 AND t > 0), "
    "gap AS (SELECT 2, 'unit_cost_gap', a.source, a.rate FROM q a, q b WHERE a.p = 1 AND b.p = 2 AND a.rate > CAST(1.6 AS DOUBLE) * b.rate), "
    f"x AS (SELECT {_L('cache_read_tokens')} AS r1, {_L('total_tokens')} AS t1 FROM now), y AS (SELECT {_L('cache_read_tokens')} AS r0, {_L('total_tokens')} AS t0 FROM daily WHERE {_BEFORE}), "
    f"shift AS (SELECT 3, 'cache_shift', 'all', {_PCT('r1', 't1')} - {_PCT('r0', 't0')} FROM x, y WHERE t0 > 0 AND abs({_PCT('r1', 't1')} - {_PCT('r0', 't0')}) > 2.0), "
    f"{_KEY2('project_path').strip().removeprefix(',')}, growth AS (SELECT 4, 'growth_project', key, delta FROM ab WHERE before > 0 AND delta > 50 AND total > 100000 ORDER BY delta DESC, key LIMIT 1) "
    "SELECT * FROM (SELECT * FROM spike UNION ALL SELECT * FROM gap UNION ALL SELECT * FROM shift UNION ALL SELECT * FROM growth) ORDER BY ord LIMIT 4"
)


@query("I05_insights", _FINDINGS)
def insights(spark, d):
    return I.insights(_period(spark, d), _prior(spark, d))


@query("I06_project_narrative", f", k AS ({_KEYED('project_path')}) SELECT k.key, k.total, CAST(k.total AS DOUBLE) / CAST((SELECT sum(total) FROM k) AS DOUBLE) * 100 AS share, hit_rate, CASE WHEN hit_rate > 60 THEN 'high' WHEN hit_rate < 30 THEN 'low' ELSE 'middle' END AS band, t.model AS top_model FROM k JOIN {_TOP('project_path').replace('FROM daily', f'FROM daily WHERE {_IN}')} t ON t.project_path = k.key ORDER BY k.total DESC, k.key LIMIT 1")
def project_narrative(spark, d):
    return I.project_narrative(_period(spark, d))


@query("I07_source_cards", f", k AS ({_KEYED('source')}) SELECT k.key, k.total, cost_usd, CAST(k.total AS DOUBLE) / CAST((SELECT sum(total) FROM k) AS DOUBLE) * 100 AS share, hit_rate, t.model AS top_model FROM k JOIN {_TOP('source').replace('FROM daily', f'FROM daily WHERE {_IN}')} t ON t.source = k.key")
def source_cards(spark, d):
    return I.source_cards(_period(spark, d))


@query("I08_drill_detail", f"SELECT usage_date, {_TOTALS} FROM daily WHERE source = 'view' AND device = 'dev-3' GROUP BY 1")
def drill_detail(spark, d):
    return A.totals(FI.drill_filter(U.daily(spark, d), "source", source="view", device="dev-3"), ["usage_date"])
