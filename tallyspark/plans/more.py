"""Further queries: readers and joins on data derived from the tables, price rules one by one, stateful streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import joins as J
from tallyspark.operators import merge as M
from tallyspark.operators import pricing as P
from tallyspark.operators import rollup as R
from tallyspark.operators import series as W
from tallyspark.plans import adapter as U
from tallyspark.plans.adapter import BASE, dbl
from tallyspark.plans.events import _TS, DOCUMENTS, LANDED, _documents, _round_trip, files_for, scratch, store
from tallyspark.sources import collect, readers

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None, base: bool = True):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (BASE if base else "") + sql
        return f

    return put


def _values(spark: SparkSession, d: str, expression: str, by: str = "event_id") -> DataFrame:
    return U.usage_raw(spark, d).selectExpr(by, f"to_json({expression}) AS value")


@query("J01_join_message_session", "SELECT event_key, CASE WHEN user_id % 2 = 0 THEN project_path END AS directory FROM usage_raw")
def message_session(spark, d):
    raw = U.usage_raw(spark, d)
    sessions = raw.groupBy(F.col("session_id").alias("id")).agg(F.min(F.when(F.col("user_id") % 2 == 0, F.col("project_path")).otherwise("")).alias("directory"))
    return J.join_message_session(raw.select("event_key", "session_id"), sessions).select("event_key", "directory")


@query("J09_exclude_indexed_files", "SELECT DISTINCT '/logs/' || session_id || '.jsonl' AS path FROM usage_raw WHERE user_id % 3 <> 0")
def indexed_files(spark, d):
    files = U.usage_raw(spark, d).select(F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl")).alias("path"), "user_id").distinct()
    return J.exclude_indexed_files(files.select("path"), files.where("user_id % 3 = 0"))


@query("S10_list_transcript_files", "SELECT DISTINCT '/logs/' || session_id || '.jsonl' AS path, CASE WHEN user_id % 3 = 0 THEN 'named-' || session_id ELSE session_id END AS session_id FROM usage_raw")
def transcript_files(spark, d):
    files = U.usage_raw(spark, d).select(F.concat(F.lit("/logs/"), "session_id", F.lit(".jsonl")).alias("path"), "session_id", "user_id").distinct()
    index = files.where("user_id % 3 = 0").select("path", F.concat(F.lit("named-"), "session_id").alias("session_id"))
    return readers.list_transcript_files(files.select("path"), index)


@query("U01_union_sources", "SELECT event_key, source FROM usage_raw")
def union_sources(spark, d):
    raw = U.usage_raw(spark, d).select("event_key", "source")
    return readers.union_sources([raw.where("source = 'click'"), raw.where("source <> 'click'").withColumn("extra", F.lit(1))]).drop("extra")


@query("U02_distinct_paths", "SELECT DISTINCT project_path AS path FROM usage_raw")
def distinct_paths(spark, d):
    return readers.distinct_paths(U.usage_raw(spark, d).select(F.col("project_path").alias("path")))


@query("W01_carry_forward", "SELECT event_id, last_value(CASE WHEN event_id % 5 = 0 THEN raw_model END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS model FROM usage_raw")
def carry_forward(spark, d):
    rows = U.usage_raw(spark, d).select("event_id", "user_id", F.when(F.col("event_id") % 5 == 0, F.col("raw_model")).alias("model"))
    return W.carry_forward(rows, ["model"], "user_id", ["event_id"]).select("event_id", "model")


@query("S15_read_usage_tables", "SELECT 'daily' AS name, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, min(device || ':' || source || ':' || CAST(usage_date AS VARCHAR) || ':' || model) AS first_id FROM daily UNION ALL SELECT 'time', count(*), CAST(sum(total_tokens) AS BIGINT), min(device || ':' || source || ':' || event_key) FROM usage UNION ALL SELECT 'sessions', count(*), CAST(sum(t) AS BIGINT), min(id) FROM (SELECT device || ':' || source || ':' || session_id AS id, sum(total_tokens) AS t FROM usage GROUP BY 1) UNION ALL SELECT 'runs', least(n, 7), NULL, min(m) FROM (SELECT count(*) OVER () AS n, 'time=' || CAST(count(*) AS VARCHAR) || ' end' AS m FROM usage GROUP BY device, source ORDER BY device DESC, source DESC LIMIT 7) GROUP BY n")
def usage_tables(spark, d):
    """The four tables of a store read back with the ids that their rows go by, of the run log the newest rows."""
    root = scratch(spark, "store")
    store(spark, d, root)
    read = readers.read_usage_tables(spark, root, runs=7)
    facts = [t.agg(F.count("*").alias("n"), F.sum("total_tokens").alias("total_tokens"), F.min("row_id").alias("first_id")).select(F.lit(name).alias("name"), "*") for name, t in read.items() if name != "runs"]
    runs = read["runs"].agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("total_tokens"), F.min("message").alias("first_id")).select(F.lit("runs").alias("name"), "*")
    return readers.union_sources([*facts, runs])


@query("S05_read_message_json", "SELECT event_key, input_tokens FROM usage_raw")
def message_json(spark, d):
    """A file for each user, an array of the user's messages in it."""
    one = "named_struct('id', event_key, 'role', 'assistant', 'modelID', raw_model, 'tokens', named_struct('input', input_tokens, 'output', output_tokens)) AS m"
    rows = U.usage_raw(spark, d).selectExpr("user_id", one).groupBy("user_id").agg(F.to_json(F.collect_list("m")).alias("value"))
    root = scratch(spark, "messages")
    rows.repartition("user_id").write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("user_id").text(root)
    return readers.read_message_json(spark, [root], LANDED).select("event_key", "input_tokens")


@query("S06_read_session_document", "SELECT session_id, model, count(*) AS n, CAST(sum(greatest(input_tokens - least(cache_read_tokens, input_tokens), 0)) AS BIGINT) AS input_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(reasoning_output_tokens) AS BIGINT) AS reasoning_output_tokens FROM named GROUP BY 1, 2")
def session_document(spark, d):
    """A document for each session of a user, many to a file; its turns are an array in it, among turns of others."""
    tokens = "named_struct('input', input_tokens, 'output', output_tokens, 'cached', cache_read_tokens, 'thoughts', reasoning_output_tokens)"
    raw = U.usage_raw(spark, d).selectExpr("user_id", "session_id", f"named_struct('type', 'gemini', 'timestamp', {_TS}, 'model', raw_model, 'tokens', {tokens}) AS m")
    other = F.struct(F.lit("user").alias("type"), F.lit(None).cast("string").alias("timestamp"), F.lit("m").alias("model"), F.lit(None).cast(raw.schema["m"].dataType["tokens"].dataType).alias("tokens"))
    docs = raw.groupBy("user_id", "session_id").agg(F.concat(F.array(other), F.collect_list("m")).alias("messages"))
    docs = docs.select(F.col("session_id").alias("key"), F.struct(F.col("session_id").alias("sessionId"), "messages").alias("document"))
    root = _documents(spark, docs, "documents", files_for(raw.count(), DOCUMENTS))
    out = readers.read_session_document(spark, [root], LANDED)
    return out.groupBy("session_id", "model").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("input_tokens", "cache_read_tokens", "reasoning_output_tokens")))


@query("S07_read_stats_document", "SELECT model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM named WHERE input_tokens + output_tokens > 0 GROUP BY 1")
def stats_document(spark, d):
    tokens = "named_struct('tokens', named_struct('prompt', input_tokens, 'candidates', output_tokens))"
    per_model = f"CASE WHEN event_id % 2 = 0 THEN map(raw_model, {tokens}) END"
    rows = _values(spark, d, f"named_struct('model', raw_model, 'stats', named_struct('models', {per_model}, 'input_tokens', input_tokens, 'output_tokens', output_tokens))")
    return readers.read_stats_document(rows).groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


@query("S09_read_agent_transcript", "SELECT model, count(*) AS n, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM named GROUP BY 1")
def agent_transcript(spark, d):
    raw = U.usage_raw(spark, d)
    use = "named_struct('input', input_tokens, 'output', output_tokens, 'cacheRead', cache_read_tokens, 'cacheWrite', cache_creation_tokens)"
    change = raw.selectExpr("CAST(user_id AS STRING) AS session_id", "event_id * 2 AS ord", "to_json(named_struct('type', 'model_change', 'modelId', raw_model, 'provider', 'p')) AS value")
    turn = raw.selectExpr("CAST(user_id AS STRING) AS session_id", "event_id * 2 + 1 AS ord", f"to_json(named_struct('type', 'message', 'message', named_struct('role', 'assistant', 'usage', {use}))) AS value")
    out = readers.read_agent_transcript(spark, [_round_trip(spark, change.unionByName(turn), "agent")], LANDED)
    return out.groupBy("model").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("output_tokens"))


@query("S11_read_session_summary", "SELECT session_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM usage_raw GROUP BY 1 HAVING min(user_id) % 4 <> 0")
def session_summary(spark, d):
    raw = U.usage_raw(spark, d).groupBy("session_id", "user_id").agg(*(F.sum(c).alias(c) for c in S.COUNTERS), F.min("event_time").cast("string").alias("started_at"))
    model = F.when(F.col("user_id") % 4 == 0, " ").otherwise("m")
    table = raw.select(F.col("session_id").alias("id"), model.alias("model"), F.lit("openai").alias("billing_provider"), "started_at", "input_tokens", "output_tokens", "cache_read_tokens", F.col("cache_creation_tokens").alias("cache_write_tokens"), F.col("reasoning_output_tokens").alias("reasoning_tokens"), F.lit(None).cast("double").alias("actual_cost_usd"), F.lit(0.5).alias("estimated_cost_usd"))
    return readers.read_session_summary(table).select("session_id", "input_tokens")


@query("S12_read_price_table", "SELECT DISTINCT raw_model AS model_key, CAST(length(raw_model) AS DOUBLE) AS input FROM usage_raw")
def price_table(spark, d):
    rows = U.usage_raw(spark, d).selectExpr("to_json(named_struct('data', map(raw_model, named_struct('input_cost_per_token', length(raw_model))))) AS value")
    out = readers.read_price_table(rows, "d1").select("model_key", "input").distinct()
    return out.withColumn("input", F.col("input").cast("double"))


@query("S13_normalise_price_feed", "SELECT DISTINCT 'v/' || raw_model AS model_key, CAST(CASE WHEN event_id % 8 % 2 = 0 THEN 3 ELSE 1 END AS DOUBLE) AS input FROM usage_raw")
def price_feed(spark, d):
    own = "CASE WHEN event_id % 8 % 2 = 0 THEN array(named_struct('provider_name', 'V', 'prompt', '3', 'completion', '4')) ELSE array(named_struct('provider_name', 'W', 'prompt', '9', 'completion', '9')) END AS endpoints"
    feed = U.usage_raw(spark, d).selectExpr("'v/' || raw_model AS model_key", "'1' AS list_prompt", "'2' AS list_completion", own)
    return P.normalise_price_feed(feed).select("model_key", F.col("input").cast("double").alias("input")).distinct()


@query("S17_normalise_quota_snapshots", "SELECT event_key AS tool, CASE WHEN event_id % 2 = 0 THEN 'five_hour' ELSE 'seven_day' END AS \"window\", CASE WHEN event_id % 101 >= 90 THEN 'bad' WHEN event_id % 101 >= 70 THEN 'warn' ELSE 'ok' END AS tone FROM usage_raw")
def quota(spark, d):
    used = "CAST(event_id % 101 AS DOUBLE)"
    windows = f"CASE WHEN event_id % 2 = 0 THEN map('five_hour', named_struct('utilization', {used})) END"
    listed = f"CASE WHEN event_id % 2 = 1 THEN array(named_struct('window_seconds', 604800, 'used_percent', {used})) END"
    rows = U.usage_raw(spark, d).selectExpr("event_key AS tool", f"to_json(named_struct('windows', {windows}, 'list', {listed})) AS value")
    return readers.normalise_quota_snapshots(rows).select("tool", "window", "tone")


@query("P02_price_exact_match", "SELECT DISTINCT n.model, n.provider, k.model_key FROM named n JOIN (VALUES ('m-alpha-4-5', NULL, 'm-alpha-4.5'), ('m-beta-2', NULL, 'openai/m-beta-2'), ('m-beta-2', 'resold', 'resold/m-beta-2'), ('vendor/m-gamma-1', NULL, 'm-gamma-1'), ('m-gamma-1-preview', NULL, 'm-gamma-1'), ('m-delta', NULL, 'm-delta')) AS k(model, provider, model_key) ON k.model = n.model AND k.provider IS NOT DISTINCT FROM n.provider")
def exact_match(spark, d):
    dim = P.read_price_dim(U.price_dim(spark)).where("dataset = 'd1'")
    return P.exact_match(P.model_candidates(U.named(spark, d).select("model", "provider")), dim).select("model", "provider", F.col("rates.model_key").alias("model_key"))


@query("P03_price_choose_dataset", "SELECT DISTINCT model, CASE WHEN model LIKE '%gamma%' THEN 'd2' ELSE 'd1' END AS dataset FROM named WHERE model <> 'm-unpriced'")
def choose_dataset(spark, d):
    out = U.resolved(spark, d).where("rates IS NOT NULL").select("model", F.col("rates.model_key").alias("model_key"))
    return out.join(U.price_dim(spark).select("dataset", "model_key"), "model_key").select("model", "dataset").distinct()


@query("P04_price_overrides", "SELECT DISTINCT n.model, CASE n.model WHEN 'm-delta' THEN CAST(7 AS DOUBLE) WHEN 'm-unpriced' THEN CAST(5 AS DOUBLE) ELSE NULL END AS override FROM named n")
def overrides(spark, d):
    models = U.named(spark, d).select("model").distinct().withColumn("provider", F.lit(None).cast("string"))
    given = "SELECT 'o' AS dataset, m AS model_key, i AS input, 7 AS output FROM VALUES {} AS t(m, i)"
    first, late = spark.sql(given.format("('m-delta', 7)")), spark.sql(given.format("('m-unpriced', 5), ('m-beta-2', 5)"))
    out = P.resolve_prices(models, P.read_price_dim(U.price_dim(spark)), first=first, late=late)
    i = F.col("rates.input").cast("double")
    return out.select("model", F.when(i >= 5, i).alias("override"))


_MANY = {"input": "input_tokens * 8", "output": "output_tokens * 100", "cache_read": "cache_read_tokens * 2", "cache_write": "cache_creation_tokens * 20"}


@query("P07_tiered_cost", "SELECT event_key, " + ", ".join(f"{dbl(U.tiered_sql(f'({n})', k))} AS {k}_usd" for k, n in _MANY.items()) + f" FROM named n JOIN rates r ON {U.SAME}")
def tiered(spark, d):
    """Counts high enough to pass every tier."""
    named = U.named(spark, d)
    rows = P.join_prices(named, U.resolved(spark, d)).where("rates IS NOT NULL")
    return rows.select("event_key", *(P.as_double(P._part(F.expr(n), "rates", k, True)).alias(f"{k}_usd") for k, n in _MANY.items()))


@query("E01_source_registry", "SELECT event_key, input_tokens FROM usage_raw")
def registry(spark, d):
    """The registered assistant reader on files derived from the events."""
    use = "named_struct('input_tokens', input_tokens, 'output_tokens', output_tokens)"
    lines = U.usage_raw(spark, d).selectExpr("CAST(user_id AS STRING) AS session_id", "event_id AS ord", f"to_json(named_struct('type', 'assistant', 'message', named_struct('id', event_key, 'model', raw_model, 'usage', {use}))) AS value")
    out = collect.REGISTRY["assistant"].read(spark, [_round_trip(spark, lines, "registry")], LANDED)
    return out.select(F.regexp_replace("event_key", "^message:", "").alias("event_key"), "input_tokens")


@query("M01_merge_events_versions", "SELECT event_key, total_tokens FROM usage")
def merge_versions(spark, d):
    """Two batches written as two versions; the reader takes the second."""
    root = scratch(spark, "versions")
    rows = U.named(spark, d).select("device", "source", "event_key", "total_tokens")
    M.write_version(rows.where("event_key LIKE '%1'").withColumn("total_tokens", F.lit(0).cast("long")), root, 0)
    M.write_version(M.merge_events(spark.read.parquet(f"{root}/v=0"), rows), root, 1)
    return spark.read.parquet(f"{root}/v=1").select("event_key", "total_tokens")
