"""Queries on raw events: names and times, prices, de-duplication, incremental filters, merges, readers and streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import merge as M
from tallyspark.operators import normalize as D
from tallyspark.operators import pricing as P
from tallyspark.operators import rollup as R
from tallyspark.operators.stages import scratch
from tallyspark.plans import adapter as U
from tallyspark.plans.adapter import BASE, dbl
from tallyspark.sources import readers

QUERIES: dict = {}
ORACLE_SQL: dict = {}

TODAY = date(2024, 1, 20)
_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_L = lambda x: f"CAST(coalesce(sum({x}), 0) AS BIGINT)"
C5 = ", ".join(S.COUNTERS)


def query(name: str, sql: str | None, base: bool = True):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (BASE if base else "") + sql
        return f

    return put


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


# --- names, times, keys -------------------------------------------------------------------------------------------------


@query("N01_token_total", "SELECT event_key, total_tokens FROM usage")
def token_total(spark, d):
    return U.named(spark, d).select("event_key", "total_tokens")


@query("X01_normalise_model", "SELECT DISTINCT raw_model, model FROM named")
def normalise_model(spark, d):
    return U.named(spark, d).select("raw_model", "model").distinct()


def _named(parts: list[list[str]]) -> str:
    """SQL for a name put together from the event's number: one of each list, in any combination."""
    factors = (1, 31, 17, 7)
    pick = lambda words, k: "CASE (event_id * {}) % {} {} END".format(factors[k], len(words), " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)))
    return " || ".join(pick(words, k) for k, words in enumerate(parts))


_PROVIDER = _named([["x-ai", "Vertex_AI", "unknown", " Gemini ", "m1", "Vendor", ""], ["/", "."], ["some-1", "openai", "Mistral", " x ", "unknown"]])
_MODEL = _named([["my-", "X/", "", "pro", "v2-"], ["claude-5", "Opus", "gpt-4", "o3", "Gemini-2", "grok", "deepseek", "mimo", "mixtral", "llama", "meta", "qwen", "glm-4", "other"], ["", "-model", "x", " beta"]])


def _provider_sql() -> str:
    known = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.ALIASES.items()) + " WHEN '' THEN NULL WHEN 'unknown' THEN NULL ELSE CASE WHEN NOT regexp_matches(p, '[0-9]') THEN p END END"
    parts = "list_transform(string_split_regex(replace(trim(raw), '-', '_'), '[/.]'), lambda p: lower(trim(p)))"
    return f"SELECT event_key, list_filter(list_transform({parts}, lambda p: {known}), lambda p: p IS NOT NULL)[1] AS provider FROM (SELECT event_key, {_PROVIDER} AS raw FROM usage_raw)"


@query("X02_canonical_provider", _provider_sql())
def canonical_provider(spark, d):
    return U.usage_raw(spark, d).select("event_key", S.canonical_provider(F.expr(_PROVIDER)).alias("provider"))


@query("X03_infer_provider", f"SELECT event_key, CASE {' '.join(f'WHEN regexp_matches(lower(raw), {chr(39)}{p}{chr(39)}) THEN {chr(39)}{v}{chr(39)}' for p, v in S.FAMILIES)} END AS provider FROM (SELECT event_key, {_MODEL} AS raw FROM usage_raw)")
def infer_provider(spark, d):
    return U.usage_raw(spark, d).select("event_key", S.infer_provider(F.expr(_MODEL)).alias("provider"))


@query("X04_source_label", "SELECT DISTINCT source, CASE source WHEN 'click' THEN 'Click tool' WHEN 'view' THEN 'Viewer' ELSE source END AS label FROM usage_raw")
def source_label(spark, d):
    return U.usage_raw(spark, d).select("source", S.source_label("source", {"click": "Click tool", "view": "Viewer"}).alias("label")).distinct()


@query("X05_local_date", "SELECT event_key, CAST(event_time + INTERVAL 8 HOUR AS DATE) AS local_date FROM usage_raw")
def local_date(spark, d):
    seconds = F.unix_timestamp(F.col("event_time").cast("timestamp"))
    epoch = F.when(F.col("event_id") % 2 == 0, seconds * 1000).otherwise(seconds)
    return U.usage_raw(spark, d).select("event_key", S.local_date(epoch, U.ZONE).alias("local_date"))


@query("X06_event_instant", "SELECT event_key, date_trunc('second', event_time) AS instant FROM usage_raw")
def event_instant(spark, d):
    seconds = F.unix_timestamp(F.col("event_time").cast("timestamp"))
    text = F.when(F.col("event_id") % 3 == 0, (seconds * 1000).cast("string")).when(F.col("event_id") % 3 == 1, seconds.cast("string")).otherwise(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss"))
    return U.usage_raw(spark, d).select("event_key", S.event_instant(text).cast("timestamp_ntz").alias("instant"))


@query("X07_local_hour", "SELECT event_key, CAST(hour(event_time + INTERVAL 8 HOUR) AS INTEGER) AS hour FROM usage_raw")
def local_hour(spark, d):
    return U.usage_raw(spark, d).select("event_key", S.local_hour("event_time", U.ZONE).alias("hour"))


@query("X08_display_today", "SELECT event_key, CAST(event_time + INTERVAL 8 HOUR AS DATE) AS today FROM usage_raw")
def display_today(spark, d):
    return U.usage_raw(spark, d).select("event_key", S.display_today(F.col("event_time"), U.ZONE).alias("today"))


@query("X09_period_bounds", "SELECT 'week' AS period, CAST(count(*) AS BIGINT) AS n FROM usage WHERE usage_date BETWEEN DATE '2024-01-14' AND DATE '2024-01-20' UNION ALL SELECT 'month', count(*) FROM usage WHERE usage_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' UNION ALL SELECT 'prev', count(*) FROM usage WHERE usage_date BETWEEN DATE '2023-12-01' AND DATE '2023-12-31' UNION ALL SELECT '90d', count(*) FROM usage WHERE usage_date BETWEEN DATE '2023-10-23' AND DATE '2024-01-20'")
def period_bounds(spark, d):
    from tallyspark.operators.series import period_bounds as bounds

    rows = U.named(spark, d)
    parts = {p: bounds(p, TODAY)[0] for p in ("week", "month", "prev", "90d")}
    return readers.union_sources([rows.where(F.col("usage_date").between(F.lit(a), F.lit(b))).agg(F.count("*").alias("n")).select(F.lit(p).alias("period"), "n") for p, (a, b) in parts.items()])


@query("X10_range_presets", "SELECT '7d' AS preset, CAST(count(*) AS BIGINT) AS n FROM usage WHERE usage_date BETWEEN DATE '2024-01-14' AND DATE '2024-01-20' UNION ALL SELECT 'today', count(*) FROM usage WHERE usage_date = DATE '2024-01-20' UNION ALL SELECT 'all', count(*) FROM usage WHERE usage_date <= DATE '2024-01-20'")
def range_presets(spark, d):
    from tallyspark.operators.series import range_preset

    rows = U.named(spark, d)
    return readers.union_sources([rows.where(F.col("usage_date").between(*map(F.lit, range_preset(p, TODAY)))).agg(F.count("*").alias("n")).select(F.lit(p).alias("preset"), "n") for p in ("7d", "today", "all")])


@query("X11_workspace_label", "SELECT event_key, CASE WHEN event_id % 2 = 0 THEN '/home/' || project_path ELSE project_path END AS label FROM usage_raw")
def workspace_label(spark, d):
    folder = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("%2Fhome%2F"), "project_path")).otherwise(F.col("project_path"))
    return U.usage_raw(spark, d).select("event_key", S.workspace_label(folder).alias("label"))


@query("X12_positive_number", "SELECT event_key, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE CAST(input_tokens AS DOUBLE) / 2 END AS number, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE floor(CAST(input_tokens AS DOUBLE) / 2) END AS BIGINT) AS whole FROM usage_raw")
def positive_number(spark, d):
    x = F.when(F.col("event_id") % 3 == 0, F.lit("-4.5")).otherwise((F.col("input_tokens").cast("double") / 2).cast("string"))
    return U.usage_raw(spark, d).select("event_key", S.positive_number(x).alias("number"), S.positive_int(x).alias("whole"))


@query("X13_row_key_sha256", "SELECT event_key, sha256(device || chr(0) || source || chr(0) || '') AS row_key FROM usage_raw")
def row_key(spark, d):
    return U.usage_raw(spark, d).select("event_key", S.row_key("device", "source", F.lit(None)).alias("row_key"))


@query("X14_row_id_concat", "SELECT event_key, device || ':' || source || ':' || CAST(usage_date AS VARCHAR) AS row_id FROM usage_raw")
def row_id(spark, d):
    return U.usage_raw(spark, d).select("event_key", S.row_id("device", "source", "usage_date").alias("row_id"))


@query("X16_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", base=False)
def json_fields(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select("event_id", F.coalesce(F.get_json_object("props", "$.key"), F.get_json_object("props", "$.k")).cast("long").alias("k"))


@query("X17_mask_email", "SELECT event_key, substr(session_id, 1, 4) || '***@' || project_path || '.com' AS masked FROM usage_raw")
def mask_email(spark, d):
    return U.usage_raw(spark, d).select("event_key", S.mask_email(F.concat("session_id", F.lit("@"), "project_path", F.lit(".com"))).alias("masked"))


@query("X18_project_label", "SELECT event_key, CASE WHEN event_id % 2 = 0 THEN project_path ELSE session_id END AS label FROM usage_raw")
def project_label(spark, d):
    return U.usage_raw(spark, d).select("event_key", S.project_label(F.when(F.col("event_id") % 2 == 0, F.col("project_path")).otherwise(""), "session_id").alias("label"))


@query("X19_display_time", "SELECT event_key, strftime(event_time + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS shown FROM usage_raw")
def display_time(spark, d):
    return U.usage_raw(spark, d).select("event_key", S.display_time("event_time", U.ZONE).alias("shown"))


_SHOWN = lambda by, sign: f"regexp_replace(printf('%.1f', CASE WHEN x / {by} * 4 % 2 = 1 THEN x / {by} + 0.01 ELSE x / {by} END), '\\.0$', '') || '{sign}'"


@query("X15_compact_number", f"SELECT event_key, CASE WHEN x >= 1e9 THEN {_SHOWN('1e9', 'B')} WHEN x >= 1e6 THEN {_SHOWN('1e6', 'M')} WHEN x >= 1e3 THEN {_SHOWN('1e3', 'K')} ELSE printf('%.0f', x) END AS shown FROM (SELECT event_key, CAST(cache_read_tokens AS DOUBLE) AS x FROM usage_raw)")
def compact_number(spark, d):
    return U.usage_raw(spark, d).select("event_key", S.compact_number("cache_read_tokens").alias("shown"))


# --- prices -------------------------------------------------------------------------------------------------------------


_BARE = lambda x: f"string_split({x}, '/')[-1]"
_DOTTED = lambda x: f"regexp_replace({x}, '(^|[^0-9])([0-9])-([0-9])($|[^0-9])', '\\1\\2.\\3\\4', 'g')"
#: The provider that a name tells, for the names that are asked for.
_HINT = "coalesce(CASE provider WHEN 'z.ai' THEN 'z' WHEN 'together' THEN 'together_ai' ELSE provider END, CASE WHEN m LIKE '%gpt%' THEN 'openai' WHEN m LIKE '%grok%' THEN 'xai' WHEN m LIKE '%mixtral%' THEN 'mistral' WHEN m LIKE '%llama%' THEN 'meta' WHEN m LIKE '%glm%' THEN 'zai' END)"


def _candidates_sql() -> str:
    """The rules for listed names as list functions: whole and bare name, dotted versions, then shorter and later parts; each with its provider, as it is, and bare."""
    parts = lambda x: f"string_split({x}, '-')"
    long = lambda x: f"list_filter({x}, lambda y: length(y) >= 2)"
    shorter = lambda x: long(f"list_transform(range(1, least(len({parts(x)}) - 1, 4) + 1), lambda k: array_to_string({parts(x)}[1:len({parts(x)}) - k], '-'))")
    later = lambda x: long(f"list_transform(range(1, least(len({parts(x)}) - 1, 2) + 1), lambda k: array_to_string({parts(x)}[k + 1:len({parts(x)})], '-'))")
    tails = lambda x: f"flatten(list_transform({later(x)}, lambda t: list_concat([t], {shorter('t')})))"
    names = f"list_concat([m, b, {_DOTTED('m')}, {_DOTTED('b')}], {shorter('m')}, {shorter('b')}, {tails('m')}, {tails('b')})"
    first = lambda x: f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"
    named = f"CASE WHEN prefix IS NULL THEN [c, {_BARE('c')}] ELSE [prefix || '/' || {_BARE('c')}, c, {_BARE('c')}] END"
    return (
        f", asked AS ({U.ASKED}), low AS (SELECT model, provider, lower(model) AS m FROM asked), hinted AS (SELECT *, {_BARE('m')} AS b, {_HINT} AS hint FROM low), all_ids AS (SELECT *, {names} AS l FROM hinted), ids AS (SELECT model, provider, hint, {first('l')} AS l FROM all_ids), "
        "prefixed AS (SELECT i.*, dataset, CASE WHEN hint = 'xai' THEN 'x-ai' WHEN hint = 'zai' AND dataset = 'd2' THEN 'z-ai' ELSE hint END AS prefix FROM ids i, (VALUES ('d1'), ('d2')) AS t(dataset)), "
        f"forms AS (SELECT dataset, model, provider, flatten(list_transform(l, lambda c: {named})) AS l FROM prefixed), kept AS (SELECT dataset, model, provider, list_filter({first('l')}, lambda y: y <> '') AS l FROM forms), "
        "cands AS (SELECT dataset, model, provider, CAST(unnest(range(len(l))) AS INTEGER) AS rank, unnest(l) AS candidate FROM kept) "
    )


@query("P01_model_candidates", f"{_candidates_sql()} SELECT * FROM cands")
def model_candidates(spark, d):
    return P.model_candidates(U.asked(spark, d))


_KEYS = f", dim AS ({U.ASKED_DIM}), keys AS (SELECT *, lower(model_key) AS low, {_DOTTED(_BARE('lower(model_key)'))} AS known FROM dim WHERE model_key NOT LIKE 'github_copilot/%' AND (input IS NOT NULL OR output IS NOT NULL))"
_SCORE = "length(low) + CASE WHEN regexp_extract(candidate, '^[^-.]*') <> '' AND starts_with(low, regexp_extract(candidate, '^[^-.]*') || '/') THEN 10000 ELSE 0 END + CASE WHEN low LIKE '%/%' THEN 100 ELSE 0 END - CASE WHEN low LIKE 'openrouter/%' THEN 5000 WHEN low LIKE 'vertex_ai/%' OR low LIKE 'bedrock/%' THEN 2000 ELSE 0 END"
_RELATED = (
    f", wanted AS (SELECT *, {_DOTTED('candidate')} AS w FROM cands WHERE length(candidate) >= 5), related AS (SELECT c.model, c.provider, c.dataset, c.rank, k.model_key, k.low, {_SCORE} AS score FROM wanted c JOIN keys k ON k.dataset = c.dataset AND length(known) >= 5 "
    "AND (known = w OR starts_with(known, w || '-') OR starts_with(w, known || '-'))), fuzzy AS (SELECT * FROM related QUALIFY row_number() OVER (PARTITION BY model, provider ORDER BY dataset, rank, score DESC, low DESC) = 1) "
)


@query("P05_price_fuzzy_match", f"{_candidates_sql()}{_KEYS}{_RELATED} SELECT model, provider, model_key FROM fuzzy")
def fuzzy(spark, d):
    """All models that prices are asked for, those with exact hits too."""
    return P.fuzzy_match(P.model_candidates(U.asked(spark, d)), U.asked_dim(spark)).select("model", "provider", F.col("rates.model_key").alias("model_key"))


_FIRST = "SELECT 'o' AS dataset, k AS model_key, 7 AS input, 7 AS output FROM (VALUES ('m-alpha-4.5')) AS t(k)"
_LATER = "SELECT 'o' AS dataset, k AS model_key, 5 AS input, 5 AS output FROM (VALUES ('m-unpriced'), ('m-beta'), ('tiny-next')) AS t(k)"


@query(
    "P06_resolve_prices_by_rule",
    f"{_candidates_sql()}{_KEYS}{_RELATED}, hits AS (SELECT c.model, c.provider, c.dataset, k.model_key, k.cache_read > 0 OR k.cache_write > 0 AS cached FROM cands c JOIN (SELECT *, low AS name, 0 AS kind FROM keys UNION ALL SELECT *, low[8:], 1 FROM keys WHERE low LIKE 'openai/%' UNION ALL SELECT *, {_BARE('low')}, 2 FROM keys WHERE dataset = 'd2') k ON k.dataset = c.dataset AND k.name = c.candidate "
    "QUALIFY row_number() OVER (PARTITION BY c.model, c.provider, c.dataset ORDER BY rank, kind, k.model_key) = 1), "
    "given AS (SELECT model, provider, unnest(l) AS id FROM ids), over AS (SELECT DISTINCT model, provider, 'm-alpha-4.5' AS model_key FROM given WHERE string_split(id, '/')[-1] = 'm-alpha-4.5'), "
    "late AS (SELECT model, provider, id AS model_key FROM (SELECT model, provider, unnest(l) AS id, unnest(range(len(l))) AS r FROM ids) WHERE id IN ('m-unpriced', 'm-beta', 'tiny-next') QUALIFY row_number() OVER (PARTITION BY model, provider ORDER BY r) = 1) "
    "SELECT a.model, a.provider, coalesce(o.model_key, CASE WHEN h1.model_key IS NULL OR (NOT h1.cached AND h2.cached) THEN h2.model_key ELSE h1.model_key END, l.model_key, f.model_key) AS model_key, CASE WHEN o.model_key IS NOT NULL THEN 'first' WHEN coalesce(h1.model_key, h2.model_key) IS NOT NULL THEN 'listed' WHEN l.model_key IS NOT NULL THEN 'late' WHEN f.model_key IS NOT NULL THEN 'listed' END AS kind "
    + "FROM asked a "
    + " ".join(f"LEFT JOIN {t} {n} ON {n}.model = a.model AND {n}.provider IS NOT DISTINCT FROM a.provider{x}" for t, n, x in (("over", "o", ""), ("hits", "h1", " AND h1.dataset = 'd1'"), ("hits", "h2", " AND h2.dataset = 'd2'"), ("late", "l", ""), ("fuzzy", "f", ""))),
)
def resolve_by_rule(spark, d):
    """The whole chain on all models that are asked for: overrides by any name, exact hits of both lists, late overrides, related names."""
    out = P.resolve_prices(U.asked(spark, d), U.asked_dim(spark), first=spark.sql(_FIRST), late=spark.sql(_LATER))
    kind = F.when(F.col("rates.input") == 7, "first").when(F.col("rates.input") == 5, "late").when(F.col("rates").isNotNull(), "listed")
    return out.select("model", "provider", F.col("rates.model_key").alias("model_key"), kind.alias("kind"))


@query("P06_resolve_prices", "SELECT DISTINCT n.model, n.provider, k.model_key FROM named n LEFT JOIN " + U.RATE_KEYS + " ON k.model = n.model AND k.provider IS NOT DISTINCT FROM n.provider")
def resolve_prices(spark, d):
    return U.resolved(spark, d).select("model", "provider", F.col("rates.model_key").alias("model_key"))


@query("P08_event_cost", f"SELECT event_key, {dbl('cost')} AS cost_usd FROM usage")
def event_cost(spark, d):
    return U.usage(spark, d).select("event_key", P.as_double(F.col("cost")).alias("cost_usd"))


@query("P09_flat_cost", f"SELECT event_key, {dbl(U.cost_sql(tiered=False))} AS cost_usd FROM named n LEFT JOIN rates r ON r.model = n.model AND r.provider IS NOT DISTINCT FROM n.provider")
def flat_cost(spark, d):
    named = U.named(spark, d)
    return P.join_prices(named, U.resolved(spark, d)).select("event_key", P.as_double(P.cost(tiered=False)).alias("cost_usd"))


@query("P10_effective_cost", f"SELECT event_key, {dbl('CASE WHEN event_id % 3 = 0 THEN cost WHEN cost > 0 THEN cost ELSE 0.5 END')} AS computed_first, {dbl('CASE WHEN event_id % 3 = 0 THEN cost ELSE 0.5 END')} AS recorded_first FROM usage")
def effective_cost(spark, d):
    rec = F.when(F.col("event_id") % 3 == 0, 0).otherwise(0.5).cast("decimal(31,12)")
    return U.usage(spark, d).select("event_key", P.as_double(P.effective_cost(F.col("cost"), rec, "computed-first")).alias("computed_first"), P.as_double(P.effective_cost(F.col("cost"), rec, "recorded-first")).alias("recorded_first"))


@query("P11_daily_cache_savings", f"{U.SAVED} SELECT device, source, usage_date, model, {dbl('saved')} AS saved_usd FROM daily_saved")
def daily_cache_savings(spark, d):
    """As it is served: on the day's sums of a model, with tiers."""
    return U.daily_saved(spark, d).select(*M.DAILY_KEYS, P.as_double(F.col("saved")).alias("saved_usd"))


@query("P11_cache_savings", f"SELECT event_key, {dbl('CASE WHEN cache_read_tokens + cache_creation_tokens > 0 THEN greatest(' + U.cost_sql(i='(input_tokens + cache_read_tokens + cache_creation_tokens)', r='0', w='0') + ' - ' + U.cost_sql() + ', 0) ELSE 0 END')} AS saved_usd FROM named n LEFT JOIN rates r ON r.model = n.model AND r.provider IS NOT DISTINCT FROM n.provider")
def cache_savings(spark, d):
    named = U.named(spark, d)
    return P.join_prices(named, U.resolved(spark, d)).select("event_key", P.as_double(P.cache_savings()).alias("saved_usd"))


# --- de-duplication and incremental filters -----------------------------------------------------------------------------


@query("D01_collapse_snapshots_max", f"SELECT session_id AS file_path, CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 4 AS VARCHAR) AS ident, max(input_tokens) AS input_tokens, max(cache_read_tokens) AS cache_read_tokens, min(event_time) AS event_time FROM usage_raw GROUP BY 1, 2")
def collapse_snapshots(spark, d):
    raw = U.usage_raw(spark, d)
    ident = F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 4).cast("string"))
    rows = raw.select(F.col("session_id").alias("file_path"), F.unix_micros(F.col("event_time").cast("timestamp")).alias("line_no"), ident.alias("message_id"), F.lit(None).cast("string").alias("request_id"), "event_time", F.col("raw_model").alias("model"), *S.COUNTERS, F.lit(0.0).alias("recorded_cost"))
    out = D.collapse_snapshots_max(rows)
    return out.select("file_path", F.regexp_replace("message_key", "^message:", "").alias("ident"), "input_tokens", "cache_read_tokens", "event_time")


@query("D02_keep_last_version", "SELECT session_id, event_id % 3 AS turn, max(event_id) AS event_id FROM usage_raw GROUP BY 1, 2")
def keep_last(spark, d):
    rows = U.usage_raw(spark, d).select("session_id", (F.col("event_id") % 3).alias("turn"), "event_id")
    return D.keep_last_version(rows, "session_id", "turn", "event_id")


def _cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Counter lines whose totals add up each session's events; every tenth line is repeated."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    raw = U.usage_raw(spark, d)
    use = {"input": F.col("input_tokens") + 1, "cached": F.col("cache_read_tokens") % (F.col("input_tokens") + 1), "output": F.col("output_tokens"), "reasoning": F.col("reasoning_output_tokens")}
    total = F.struct(*(F.sum(v).over(w).alias(k) for k, v in use.items()))
    last = F.when(F.col("event_id") % 2 == 0, F.struct(*(v.alias(k) for k, v in use.items())))
    lines = raw.select(F.col("user_id").cast("string").alias("file_path"), (F.col("event_id") * 2).alias("line_no"), F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.col("raw_model").alias("model"), F.lit(False).alias("replay"), last.alias("last"), total.alias("total"))
    return lines.unionByName(lines.where("line_no % 20 = 0").withColumn("line_no", F.col("line_no") + 1))


@query("D03_counter_increments", "SELECT CAST(user_id AS VARCHAR) AS file_path, event_id * 2 AS line_no, input_tokens + 1 - cache_read_tokens % (input_tokens + 1) AS input_tokens, output_tokens, cache_read_tokens % (input_tokens + 1) AS cache_read_tokens, reasoning_output_tokens FROM usage_raw")
def counter_increments(spark, d):
    return D.counter_increments(_cumulative(spark, d)).select("file_path", "line_no", "input_tokens", "output_tokens", "cache_read_tokens", "reasoning_output_tokens")


@query("D04_skip_replayed_history", "SELECT CAST(user_id AS VARCHAR) AS file_path, event_id * 2 AS line_no FROM usage_raw WHERE date_trunc('second', event_time) <> (SELECT date_trunc('second', arg_min(event_time, event_id)) FROM usage_raw f WHERE f.user_id = usage_raw.user_id)")
def skip_replayed(spark, d):
    return D.counter_increments(_cumulative(spark, d).withColumn("replay", F.lit(True))).select("file_path", "line_no")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Coarse times and few counters, so that different events share them; every tenth event is copied to another file; a third have no time."""
    rows = U.named(spark, d).withColumns({"event_time": F.when(F.col("event_id") % 3 != 0, F.date_trunc("day", "event_time")), "output_tokens": F.col("output_tokens") % 2, "file": F.col("user_id") % 5, "line": F.col("event_id")})
    return rows.unionByName(rows.where("event_id % 10 = 0").withColumn("file", F.col("file") + 5))


_CALL_ROWS = ", calls AS (SELECT event_key, event_id, model, user_id, project_path, CASE WHEN event_id % 3 <> 0 THEN date_trunc('day', event_time) END AS t, output_tokens % 2 AS o, user_id % 5 AS file FROM named), twice AS (SELECT * FROM calls UNION ALL SELECT * REPLACE (file + 5 AS file) FROM calls WHERE event_id % 10 = 0)"


@query("D05_dedupe_events_global", f"{_CALL_ROWS} SELECT event_key, file FROM twice WHERE t IS NULL UNION ALL SELECT * FROM (SELECT event_key, file FROM twice WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t, model, o ORDER BY file, event_id) = 1)")
def dedupe_global(spark, d):
    """Different events share a day, model and counter, so most of them are dropped; events without a time all stay, copies too."""
    return D.dedupe_events_global(_calls(spark, d), ["event_time", "model", "output_tokens"], ["file", "line"]).select("event_key", "file")


@query(
    "D06_dedupe_fingerprint_merge",
    f"{_CALL_ROWS} SELECT t AS event_time, model, o AS output_tokens, user_id % 50 AS agent, arg_min(event_key, event_id) AS event_key, CASE WHEN count(DISTINCT CASE WHEN event_id % 4 > 0 THEN project_path END) = 1 THEN max(CASE WHEN event_id % 4 > 0 THEN project_path END) END AS project_path FROM twice GROUP BY 1, 2, 3, 4",
)
def dedupe_fingerprint(spark, d):
    """Rows with one day, model, counter and agent merge: workspaces that are missing, agree or differ."""
    rows = _calls(spark, d).withColumns({"agent": F.col("user_id") % 50, "project_path": F.when(F.col("event_id") % 4 > 0, F.col("project_path"))})
    return D.dedupe_fingerprint_merge(rows, ["event_time", "model", "output_tokens", "agent"], "event_id", "project_path").select("event_time", "model", "output_tokens", "agent", "event_key", "project_path")


@query(
    "D07_dedupe_cross_store",
    f"{_CALL_ROWS}, keyed AS (SELECT *, CASE WHEN event_id % 7 > 1 THEN 'id ' || CAST(event_id % 400 AS VARCHAR) ELSE 'print ' || coalesce(CAST(t AS VARCHAR), '') || model || CAST(o AS VARCHAR) END AS k, CASE WHEN file >= 5 THEN 0 ELSE 1 END AS store FROM twice) SELECT event_key, store FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY store, event_id) = 1",
)
def dedupe_cross_store(spark, d):
    """Messages of two stores by their id, which several share, or by a fingerprint where they have none; the database comes before the files."""
    rows = _calls(spark, d).withColumn("store", F.when(F.col("file") >= 5, 0).otherwise(1))
    message = F.when(F.col("event_id") % 7 > 1, F.concat(F.lit("id "), (F.col("event_id") % 400).cast("string")))
    print_ = F.concat(F.lit("print "), F.coalesce(F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"), F.lit("")), "model", F.col("output_tokens").cast("string"))
    return D.dedupe_cross_store(rows, F.coalesce(message, print_), "store", "event_id").select("event_key", "store")


@query("D08_occurrence_suffix_keys", "SELECT event_id, CAST(user_id AS VARCHAR) || CASE WHEN row_number() OVER w > 1 THEN '#' || CAST(row_number() OVER w - 1 AS VARCHAR) ELSE '' END AS event_key FROM usage_raw WINDOW w AS (PARTITION BY device, source, user_id ORDER BY event_id)")
def occurrence_suffix(spark, d):
    return D.occurrence_suffix_keys(U.usage_raw(spark, d).withColumn("event_key", F.col("user_id").cast("string")), ["event_id"]).select("event_id", "event_key")


@query("D09_split_cached_input", "SELECT event_key, input_tokens - least(cache_read_tokens, input_tokens) AS input_tokens, least(cache_read_tokens, input_tokens) AS cache_read_tokens FROM usage_raw")
def split_cached(spark, d):
    i, r = S.split_cached(F.col("input_tokens"), F.col("cache_read_tokens"))
    return U.usage_raw(spark, d).select("event_key", i.alias("input_tokens"), r.alias("cache_read_tokens"))


@query("D10_split_cached_with_total_check", "SELECT event_key, CASE WHEN event_id % 3 = 0 THEN input_tokens WHEN event_id % 3 = 2 AND cache_read_tokens = 0 THEN input_tokens ELSE input_tokens - least(cache_read_tokens, input_tokens) END AS input_tokens, cache_read_tokens FROM usage_raw")
def split_cached_checked(spark, d):
    c = F.col
    inside = c("input_tokens") + c("output_tokens") + c("reasoning_output_tokens")
    total = F.when(c("event_id") % 3 == 0, inside + c("cache_read_tokens") + 1).when(c("event_id") % 3 == 2, inside)
    i, r = S.split_cached_checked(c("input_tokens"), c("cache_read_tokens"), c("output_tokens"), c("reasoning_output_tokens"), F.lit(0), total)
    return U.usage_raw(spark, d).select("event_key", i.alias("input_tokens"), r.alias("cache_read_tokens"))


@query("D11_normalise_event_rows", "SELECT event_key, total_tokens FROM usage WHERE event_id % 7 <> 0")
def normalise_events(spark, d):
    rows = U.named(spark, d).withColumn("event_time", F.when(F.col("event_id") % 7 != 0, F.col("event_time")))
    return D.normalise_event_rows(rows, U.is_counter_log()).select("event_key", "total_tokens")


@query("D12_normalise_daily_rows", "SELECT device, source, usage_date, CASE WHEN model = 'm-delta' THEN 'unknown' ELSE model END AS model, input_tokens FROM daily")
def normalise_daily(spark, d):
    rows = U.daily(spark, d).withColumn("model", F.when(F.col("model") == "m-delta", "").otherwise(F.col("model")))
    return D.normalise_daily_rows(rows).select("device", "source", "usage_date", "model", "input_tokens")


@query("D13_normalise_session_rows", "SELECT DISTINCT 'local:' || source || ':' || CASE WHEN project_path = 'proj-0' THEN 'no-workspace' ELSE project_path END || ':' || model AS session_id FROM usage")
def normalise_sessions(spark, d):
    rows = U.named(spark, d).withColumn("project_path", F.when(F.col("project_path") == "proj-0", "").otherwise(F.col("project_path")))
    return D.normalise_session_rows(rows, _now()).select("session_id").distinct()


@query("D14_recent_event_filter", f"SELECT event_key FROM usage WHERE event_time >= {_NOW} - INTERVAL 14 DAY")
def recent_events(spark, d):
    return D.recent_events(U.usage_raw(spark, d), _now(), 14).select("event_key")


@query("D15_source_watermark", "SELECT device, source, max(event_time) AS watermark FROM usage GROUP BY 1, 2")
def watermark(spark, d):
    return D.source_watermark(U.usage_raw(spark, d))


@query("D16_watermark_cutoff", "SELECT device, source, max(event_time) - INTERVAL 48 HOUR AS cutoff FROM usage GROUP BY 1, 2")
def cutoff(spark, d):
    return D.source_watermark(U.usage_raw(spark, d)).select("device", "source", D.watermark_cutoff(F.col("watermark")).alias("cutoff"))


def _cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return D.source_watermark(U.usage_raw(spark, d).where("usage_date <= DATE '2024-01-15' AND source <> 'view'")).select("device", "source", D.watermark_cutoff(F.col("watermark")).alias("cutoff"))


_CUT = ", c AS (SELECT device, source, max(event_time) - INTERVAL 48 HOUR AS cutoff FROM usage WHERE usage_date <= DATE '2024-01-15' AND source <> 'view' GROUP BY 1, 2)"


@query("D17_filter_new_events", f"{_CUT} SELECT event_key FROM usage u LEFT JOIN c ON c.device = u.device AND c.source = u.source WHERE cutoff IS NULL OR event_time > cutoff")
def new_events(spark, d):
    return D.filter_new_events(U.usage_raw(spark, d), _cutoffs(spark, d)).select("event_key")


@query("D18_filter_new_days", f"{_CUT} SELECT u.device, u.source, usage_date, model FROM daily u LEFT JOIN c ON c.device = u.device AND c.source = u.source WHERE cutoff IS NULL OR usage_date >= CAST(cutoff AS DATE)")
def new_days(spark, d):
    return D.filter_new_days(U.daily(spark, d), _cutoffs(spark, d)).select("device", "source", "usage_date", "model")


@query(
    "D19_incremental_or_full_plan",
    "SELECT DISTINCT flag, device, source, flag OR source IN ('view', 'purchase') AS \"full\" FROM usage, (VALUES (true), (false)) AS t(flag) WHERE source <> 'signup' "
    "UNION ALL SELECT DISTINCT flag, device, source || '-idle', true FROM usage, (VALUES (true), (false)) AS t(flag) WHERE source = 'signup'",
)
def rebuild_plan(spark, d):
    """With and without the flag: sources without a mark (view), with rows but no events (purchase), and not in the batch at all (signup)."""
    rows = U.usage_raw(spark, d)
    named = F.when(F.col("source") == "signup", F.lit("signup-idle")).otherwise(F.col("source"))
    sources = rows.select("device", named.alias("source"))
    marks = D.source_watermark(rows.where("source <> 'view'"))
    batch = rows.where("source <> 'signup'").withColumn("event_time", F.when(F.col("source") != "purchase", F.col("event_time")))
    out = [D.needs_rebuild(batch, marks, flag, sources).withColumn("flag", F.lit(flag)) for flag in (True, False)]
    return out[0].unionByName(out[1])


# --- merges -------------------------------------------------------------------------------------------------------------


def _two_batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events up to the 15th; then all, with one output token more."""
    rows = U.usage(spark, d).select("device", "source", "event_key", "event_time", "usage_date", "model", "session_id", *S.COUNTERS, "total_tokens", "cost")
    return rows.where("usage_date <= DATE '2024-01-15'"), rows.withColumn("total_tokens", F.col("total_tokens") + 1)


@query("M01_merge_events", "SELECT device, source, event_key, total_tokens + 1 AS total_tokens FROM usage")
def merge_events(spark, d):
    a, b = _two_batches(spark, d)
    return M.merge_events(M.merge_events(a, b), b).select("device", "source", "event_key", "total_tokens")


@query("M02_merge_daily_price_locked", f"SELECT device, source, usage_date, model, CAST(sum(total_tokens) + count(*) AS BIGINT) AS total_tokens, {dbl('sum(cost) + CASE WHEN usage_date < DATE ' + chr(39) + '2024-01-15' + chr(39) + ' THEN 0 ELSE 1 END')} AS cost_usd, usage_date < DATE '2024-01-20' AS locked FROM usage GROUP BY 1, 2, 3, 4")
def merge_daily(spark, d):
    a, b = _two_batches(spark, d)
    day = lambda x, extra: x.groupBy(*M.DAILY_KEYS).agg(F.sum("total_tokens").alias("total_tokens"), (F.sum("cost").cast("decimal(30,12)") + F.lit(extra).cast("decimal(1,0)")).cast("decimal(38,12)").alias("cost"))
    old = M.lock_past_prices(day(a.where("usage_date < DATE '2024-01-15'"), 0).withColumn("pricing_locked_at", F.lit(None).cast("timestamp_ntz")), TODAY, _now())
    out = M.merge_daily_price_locked(old, day(b, 1), TODAY, _now())
    return out.select(*M.DAILY_KEYS, "total_tokens", P.as_double(F.col("cost")).alias("cost_usd"), F.col("pricing_locked_at").isNotNull().alias("locked"))


@query("M03_merge_sessions", f"SELECT device, source, session_id, CAST(sum(total_tokens) + count(*) AS BIGINT) AS total_tokens FROM usage GROUP BY 1, 2, 3")
def merge_sessions(spark, d):
    a, b = _two_batches(spark, d)
    s = lambda x: x.groupBy(*M.SESSION_KEYS).agg(F.sum("total_tokens").alias("total_tokens"))
    return M.merge_sessions(s(a), s(b))


@query("M04_replace_source_partition", "SELECT event_key, total_tokens FROM usage WHERE source <> 'click' AND usage_date <= DATE '2024-01-15' UNION ALL SELECT event_key, total_tokens + 1 FROM usage WHERE source = 'click' AND usage_date > DATE '2024-01-15'")
def replace_sources(spark, d):
    a, b = _two_batches(spark, d)
    pairs = b.where("source = 'click' AND usage_date > DATE '2024-01-15'")
    return M.replace_sources(a, pairs).select("event_key", "total_tokens")


@query("M05_lock_past_prices", "SELECT device, source, usage_date, model, usage_date < DATE '2024-01-20' AS locked FROM daily")
def lock_past(spark, d):
    rows = M.lock_past_prices(U.daily(spark, d).withColumn("pricing_locked_at", F.lit(None).cast("timestamp_ntz")), TODAY, _now())
    return rows.select(*M.DAILY_KEYS, F.col("pricing_locked_at").isNotNull().alias("locked"))


@query("M06_append_run_log", "SELECT device, source, 'ok' AS status, CAST(count(*) AS VARCHAR) || ' events, ' || CAST(count(DISTINCT usage_date) AS VARCHAR) || ' days' AS message FROM usage GROUP BY 1, 2")
def run_log(spark, d):
    return M.run_log(U.usage_raw(spark, d), F.lit(1), _now()).select("device", "source", "status", "message")


@query("M07_retain_newest_n", "SELECT device, event_id AS id FROM usage_raw QUALIFY row_number() OVER (PARTITION BY device ORDER BY event_id DESC) <= 25")
def retain(spark, d):
    return M.retain_newest(U.usage_raw(spark, d).select("device", F.col("event_id").alias("id")), 25, by="device")


@query("M08_export_csv", "SELECT event_key, device || ', \"' || source || '\"' AS label, total_tokens FROM usage")
def export_csv(spark, d):
    rows = U.named(spark, d).select("event_key", F.concat("device", F.lit(', "'), "source", F.lit('"')).alias("label"), "total_tokens")
    path = scratch(spark, "csv")
    M.export_csv(rows, path)
    return spark.read.option("header", True).option("escape", '"').schema("event_key string, label string, total_tokens long").csv(path)


_PAID_FLAT = U.cost_sql("d.input_tokens", "(d.output_tokens + d.reasoning_output_tokens)", "d.cache_read_tokens", "d.cache_creation_tokens", tiered=False)


@query(
    "M09_backfill_daily_cost",
    f"SELECT d.device, d.source, usage_date, d.model, {dbl('CASE WHEN d.source = ' + chr(39) + 'click' + chr(39) + ' THEN ' + _PAID_FLAT + ' ELSE cost END')} AS cost_usd FROM daily d LEFT JOIN rates r ON r.model = d.model AND r.provider IS NULL",
)
def backfill(spark, d):
    """Two sources lost their cost: one gets its events' cost back, the other, whose events are not complete, the flat price."""
    u = U.usage(spark, d)
    daily = R.rollup_daily(u).withColumn("cost", F.when(F.col("source").isin("view", "click"), F.lit(0).cast("decimal(38,12)")).otherwise(F.col("cost")))
    sums = R.event_sums_by_day(u).withColumn("event_tokens", F.when(F.col("source") == "click", F.col("event_tokens") - 1).otherwise(F.col("event_tokens")))
    out = M.backfill_daily_cost(P.join_prices(daily, U.resolved(spark, d)), sums, P.cost(tiered=False))
    return out.select(*M.DAILY_KEYS, P.as_double(F.col("cost")).alias("cost_usd"))


@query("M10_reconcile_copy", "SELECT 'events' AS name, count(*) AS source_rows, count(*) AS target_rows, true AS ok FROM usage UNION ALL SELECT 'daily', (SELECT count(*) FROM daily), (SELECT count(*) FROM daily WHERE source <> 'view'), false")
def reconcile(spark, d):
    e, x = U.named(spark, d), U.daily(spark, d)
    return M.reconcile({"events": e, "daily": x}, {"events": e, "daily": x.where("source <> 'view'")})


_RUNS = "SELECT row_number() OVER (ORDER BY device, source) AS id, device, source FROM (SELECT DISTINCT device, source FROM usage)"


def store(spark: SparkSession, d: str, root: str) -> None:
    """The facts and a run log as a store: a folder for each table."""
    u = U.usage(spark, d)
    runs = u.groupBy("device", "source").agg(F.count("*").alias("n")).orderBy("device", "source").select(F.lit("ok").alias("status"), "device", "source", F.concat(F.lit("time="), F.col("n").cast("string"), F.lit("\nend")).alias("message"))
    tables = {"daily": R.rollup_daily(u), "time": u.drop("usage_date"), "sessions": R.rollup_sessions(u), "runs": runs.withColumn("id", F.row_number().over(_by_source()))}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/{name}")


def _by_source():
    from pyspark.sql import Window

    return Window.orderBy("device", "source")  # a row for each device and source


@query(
    "M10_verified_copy",
    "SELECT step, name, n AS source_rows, n AS target_rows, true AS ok, CASE step WHEN 1 THEN 'copied' ELSE 'kept' END AS runs FROM (VALUES (1), (2)) AS t(step), (SELECT 'daily' AS name, count(*) AS n FROM daily UNION ALL SELECT 'time', count(*) FROM usage UNION ALL SELECT 'sessions', count(*) FROM (SELECT DISTINCT device, source, session_id FROM usage)) UNION ALL SELECT 3, 'runs in the store', least(count(*), 10), least(count(*), 10), true, 'kept' FROM (SELECT DISTINCT device, source FROM usage)",
)
def verified(spark, d):
    """A store copied into an empty one, then once more: the facts again, the run log not."""
    source, target = scratch(spark, "source"), scratch(spark, "target")
    store(spark, d, source)
    one = M.verified_copy(spark, source, target, keep_runs=10).withColumn("step", F.lit(1))
    two = M.verified_copy(spark, source, target, keep_runs=99).withColumn("step", F.lit(2))
    runs = spark.read.parquet(f"{target}/v=1/runs").agg(F.count("*").alias("source_rows"), F.count("*").alias("target_rows")).select(F.lit(3).alias("step"), F.lit("runs in the store").alias("name"), "*", F.lit(True).alias("ok"), F.lit("kept").alias("runs"))
    return one.unionByName(two).unionByName(runs)


@query("M11_audit_tables", f"SELECT 'time_usage' AS name, count(*) AS n, {_L('total_tokens')} AS total, {dbl('sum(cost)')} AS cost_usd FROM usage UNION ALL SELECT 'daily_usage', count(*), {_L('total_tokens')}, {dbl('sum(cost)')} FROM daily")
def audit(spark, d):
    return M.audit({"time_usage": U.usage(spark, d), "daily_usage": U.daily(spark, d)})


@query("S16_copy_usage_tables", "SELECT device, source, usage_date, model, total_tokens, true AS unlocked FROM daily")
def copy_tables(spark, d):
    out = M.copy_table(U.daily(spark, d), [*M.DAILY_KEYS, "total_tokens", "pricing_locked_at", "updated_at"], _now())
    return out.select(*M.DAILY_KEYS, "total_tokens", F.col("pricing_locked_at").isNull().alias("unlocked"))


# --- readers: written in the raw format, read back ----------------------------------------------------------------------


def _round_trip(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """lines: session_id, ord, value. Files in a folder for each session, with a blank and a broken line in each."""
    path = scratch(spark, name)
    noise = lines.groupBy("session_id").agg(F.min("ord").alias("ord")).select("session_id", (F.col("ord") - 1).alias("ord"), F.explode(F.array(F.lit(""), F.lit("{broken"))).alias("value"))
    rows = lines.unionByName(noise).repartition("session_id").sortWithinPartitions("session_id", "ord")
    rows.select("session_id", "value").write.mode("overwrite").partitionBy("session_id").text(path)
    return path


LANDED = "part-*.txt"  # what Spark's text writer calls its files
LINES, DOCUMENTS = 20_000, 5_000  # of a landed file, about: more rows make more files, not larger ones


def files_for(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def file_of(key: str, files: int) -> Column:
    """The number of the file that a key's rows land in."""
    return F.pmod(F.hash(key), F.lit(files))


def _documents(spark: SparkSession, rows: DataFrame, name: str, files: int) -> str:
    """rows: key, document. Files that hold an array of documents each, a key's documents in one."""
    path = scratch(spark, name)
    packed = rows.groupBy(file_of("key", files).alias("file")).agg(F.to_json(F.collect_list("document")).alias("value"))
    packed.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return path


_TS = "date_format(event_time, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"


@query("S02_read_assistant_usage", "SELECT event_key, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, reasoning_output_tokens FROM usage_raw")
def read_assistant(spark, d):
    usage = "named_struct('input_tokens', input_tokens, 'output_tokens', output_tokens, 'cache_read_input_tokens', cache_read_tokens, 'cache_creation_input_tokens', cache_creation_tokens, 'reasoning_tokens', reasoning_output_tokens)"
    value = f"to_json(named_struct('type', 'assistant', 'timestamp', {_TS}, 'message', named_struct('id', event_key, 'model', raw_model, 'usage', {usage}))) AS value"
    lines = U.usage_raw(spark, d).selectExpr("CAST(user_id AS STRING) AS session_id", "event_id AS ord", value)
    out = readers.read_assistant_usage(spark, [_round_trip(spark, lines, "assistant")], LANDED)
    return out.select(F.col("message_id").alias("event_key"), *S.COUNTERS)


@query("S01_scan_session_lines", "SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(count(*) + 1 AS BIGINT) AS n FROM usage_raw GROUP BY 1")
def scan_lines(spark, d):
    lines = U.usage_raw(spark, d).selectExpr("CAST(user_id AS STRING) AS session_id", "event_id AS ord", "event_key AS value")
    out = readers.scan_session_lines(spark, [_round_trip(spark, lines, "lines")], LANDED)
    return out.groupBy(F.regexp_extract("file_path", "session_id=([^/]+)", 1).alias("session_id")).agg(F.count("*").alias("n"))


@query("S03_read_counter_log", "SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS n, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage_raw GROUP BY 1")
def read_counter(spark, d):
    use = "named_struct('input_tokens', input_tokens + 1, 'cached_input_tokens', cache_read_tokens, 'output_tokens', output_tokens, 'reasoning_output_tokens', reasoning_output_tokens)"
    value = f"to_json(named_struct('timestamp', {_TS}, 'type', 'event_msg', 'payload', named_struct('type', 'token_count', 'info', named_struct('last_token_usage', {use})))) AS value"
    lines = U.usage_raw(spark, d).selectExpr("CAST(user_id AS STRING) AS session_id", "event_id AS ord", value)
    out = D.counter_increments(readers.read_counter_log(spark, [_round_trip(spark, lines, "counter")], LANDED))
    return out.groupBy(F.regexp_extract("file_path", "session_id=([^/]+)", 1).alias("session_id")).agg(F.count("*").alias("n"), F.sum("output_tokens").alias("output_tokens"))


@query("S04_read_message_store", "SELECT event_key, CASE WHEN user_id % 2 = 0 THEN project_path END AS project_path, input_tokens FROM usage_raw")
def read_store(spark, d):
    tokens = "named_struct('input', input_tokens, 'output', output_tokens, 'reasoning', reasoning_output_tokens, 'cache', named_struct('read', cache_read_tokens, 'write', cache_creation_tokens))"
    data = f"to_json(named_struct('role', 'assistant', 'modelID', raw_model, 'time', named_struct('created', unix_millis(CAST(event_time AS TIMESTAMP))), 'tokens', {tokens})) AS data"
    raw = U.usage_raw(spark, d)
    messages = raw.selectExpr("event_key AS id", "session_id", data)
    sessions = raw.groupBy(F.col("session_id").alias("id")).agg(F.min(F.when(F.col("user_id") % 2 == 0, F.col("project_path")).otherwise("")).alias("directory"))
    return readers.read_message_store(messages, sessions).select("event_key", "project_path", "input_tokens")


_NET = "CAST(sum(greatest(input_tokens - least(cache_read_tokens, input_tokens), 0)) AS BIGINT)"


@query("S08_read_turn_stream", f"SELECT session_id, model, count(*) AS n, {_NET} AS input_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(reasoning_output_tokens) AS BIGINT) AS reasoning_output_tokens FROM named GROUP BY 1, 2")
def read_turns(spark, d):
    """A file for each user: turns, and for every fifth event statistics, by model or flat, under either spelling of the session."""
    from pyspark.sql import Window

    raw = U.usage_raw(spark, d).withColumn("file", F.col("user_id").cast("string")).withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("session_id", "event_id")))
    raw = raw.withColumn("new", ~F.col("session_id").eqNullSafe(F.lag("session_id").over(Window.partitionBy("user_id").orderBy("session_id", "event_id"))))
    turn = "named_struct('type', 'gemini', 'id', event_key, 'model', raw_model, 'timestamp', {ts}, 'tokens', named_struct('input', input_tokens, 'output', output_tokens, 'cached', cache_read_tokens, 'thoughts', reasoning_output_tokens))".format(ts=_TS)
    flat = "named_struct('prompt_tokens', input_tokens, 'output_tokens', output_tokens, 'cached_tokens', cache_read_tokens, 'thoughts_tokens', reasoning_output_tokens)"
    each = "named_struct('models', map(raw_model, named_struct('tokens', named_struct('input', input_tokens, 'candidates', output_tokens, 'cached', cache_read_tokens, 'reasoning', reasoning_output_tokens)), 'idle', NULL))"
    value = f"CASE WHEN event_id % 5 > 0 THEN to_json({turn}) WHEN event_id % 10 = 0 THEN to_json(named_struct('type', 'result', 'result', named_struct('stats', {each}))) ELSE to_json(named_struct('stats', {flat})) END"
    lines = raw.selectExpr("file AS session_id", "place * 2 AS ord", f"{value} AS value")
    begin = "CASE WHEN user_id % 2 = 0 THEN to_json(named_struct('type', 'init', 'session_id', CASE WHEN new THEN session_id END, 'model', raw_model)) ELSE to_json(named_struct('type', 'init', 'sessionId', CASE WHEN new THEN session_id END, 'model', raw_model)) END"
    init = raw.where("new OR event_id % 5 = 0").selectExpr("file AS session_id", "place * 2 - 1 AS ord", f"{begin} AS value")
    out = readers.read_turn_stream(spark, [_round_trip(spark, lines.unionByName(init), "turns")], LANDED)
    return out.groupBy("session_id", "model").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("input_tokens", "cache_read_tokens", "reasoning_output_tokens")))
