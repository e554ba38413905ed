"""Usage facts and prices from the driver's tables.

The `events` table plays the raw usage log: the same SQL text runs in Spark and in the comparison engine, so the queries and
their SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import pricing as P

COUNTER_SOURCE = "error"  # plays the source whose output already holds reasoning
TODAY = "2024-01-20"
ZONE = "Asia/Shanghai"

USAGE_RAW = """
SELECT 'dev-' || CAST(user_id % 4 AS STRING) AS device, event_type AS source, CAST(event_id AS STRING) AS event_key,
  ts AS event_time, CAST(ts AS DATE) AS usage_date, event_id,
  CASE event_id % 8 WHEN 0 THEN 'm-alpha-4-5-20250101' WHEN 1 THEN 'M-Alpha-4-5' WHEN 2 THEN 'm-beta-2(high)' WHEN 3 THEN 'm-beta-2'
    WHEN 4 THEN 'vendor/m-gamma-1' WHEN 5 THEN 'm-gamma-1-preview' WHEN 6 THEN 'm-unpriced' ELSE 'm-delta' END AS raw_model,
  CASE WHEN event_id % 16 = 3 THEN 'resold' END AS provider,
  'proj-' || CAST(user_id % 7 AS STRING) AS project_path,
  'sess-' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id, user_id,
  CAST(floor(value * 100) AS BIGINT) AS input_tokens, (event_id * 7919) % 5000 AS output_tokens,
  (event_id * 1299709) % 20000 AS cache_creation_tokens, (event_id * 104729) % 300000 AS cache_read_tokens,
  (event_id * 15485863) % 1500 AS reasoning_output_tokens
FROM events"""

#: Prices above a tier, by listed key; all tiers occur, some with others left out between.
TIERED = {
    "m-delta": {"input_above_128k": "0.00000087", "input_above_256k": "0.0000011", "cache_read_above_200k": "0.00000000725", "output_above_128k": "0.0000017", "output_above_256k": "0.000002"},
    "m-alpha-4.5": {"cache_read_above_200k": "0.0000006", "cache_read_above_272k": "0.0000009", "cache_write_above_200k": "0.0000075", "input_above_200k": "0.000006", "input_above_272k": "0.000009"},
    "openai/m-beta-2": {"output_above_200k": "0.000021", "output_above_272k": "0.000028", "cache_read_above_272k": "0.00000035"},
}


def _tier_columns() -> str:
    out = []
    for c in (f"{k}_above_{t}" for k, ts in P.TIERS.items() for t in ts):
        listed = " ".join(f"WHEN '{key}' THEN '{prices[c]}'" for key, prices in TIERED.items() if c in prices)
        out.append(f"CAST({f'CASE model_key {listed} END' if listed else 'NULL'} AS DECIMAL(18,12)) AS {c}")
    return ", ".join(out)


PRICE_DIM = f"""
SELECT dataset, model_key, CAST(i AS DECIMAL(18,12)) AS input, CAST(o AS DECIMAL(18,12)) AS output, CAST(cr AS DECIMAL(18,12)) AS cache_read,
  CAST(cw AS DECIMAL(18,12)) AS cache_write, {_tier_columns()}
FROM (VALUES
  ('d1', 'm-alpha-4.5', '0.000003', '0.000015', '0.0000003', '0.00000375'),
  ('d1', 'openai/m-beta-2', '0.00000175', '0.000014', '0.000000175', '0'),
  ('d1', 'resold/m-beta-2', '0.000002', '0.000016', '0.0000002', '0.0000025'),
  ('d1', 'm-gamma-1', '0.00000125', '0.00001', '0', '0'),
  ('d2', 'vendor/m-gamma-1', '0.0000012', '0.0000096', '0.00000012', '0.0000015'),
  ('d1', 'm-delta', '0.000000435', '0.00000087', '0.000000003625', '0'),
  ('d1', 'github_copilot/m-unpriced', '0', '0', '0', '0')
) AS t(dataset, model_key, i, o, cr, cw)"""

#: Models that prices are asked for beside those in use: families that a provider is inferred for, aliases, related names.
ASKED = """
SELECT DISTINCT CASE event_id % 24 WHEN 1 THEN 'glm-4-5-air' WHEN 5 THEN 'GLM-4.5' WHEN 7 THEN 'grok-code-1' WHEN 9 THEN 'reseller/gpt-five-mini-2026' WHEN 11 THEN 'ultra-gpt-five' WHEN 13 THEN 'mixtral-tiny-next'
    WHEN 17 THEN 'm-gamma-11' WHEN 19 THEN 'fast-m-delta' WHEN 21 THEN 'm-odd' WHEN 23 THEN 'llama-x-9-chat' ELSE model END AS model,
  CASE event_id % 48 WHEN 13 THEN 'z.ai' WHEN 9 THEN 'together' ELSE provider END AS provider
FROM named"""

ASKED_DIM = """
SELECT dataset, model_key, CAST(i AS DECIMAL(18,12)) AS input, CAST(o AS DECIMAL(18,12)) AS output, CAST(cr AS DECIMAL(18,12)) AS cache_read, CAST(cw AS DECIMAL(18,12)) AS cache_write
FROM (VALUES
  ('d1', 'm-alpha-4.5', '0.000003', '0.000015', '0.0000003', '0.00000375'), ('d1', 'openai/m-beta-2', '0.00000175', '0.000014', '0.000000175', '0'), ('d1', 'm-gamma-1', '0.00000125', '0.00001', '0', '0'),
  ('d2', 'vendor/m-gamma-1', '0.0000012', '0.0000096', '0.00000012', '0.0000015'), ('d1', 'm-delta-large', '0.000001', '0.000002', '0', '0'), ('d2', 'm-delta', '0.000003', '0.000004', '0.000001', '0'),
  ('d1', 'zai/glm-4.5', '0.000006', '0.000007', '0', '0'), ('d2', 'z-ai/glm-4.5', '0.000006', '0.000008', '0.000001', '0'), ('d2', 'z-ai/glm-4.5-air', '0.000005', '0.000008', '0', '0'), ('d1', 'github_copilot/grok-code-1', '0', '0', '0', '0'),
  ('d2', 'x-ai/grok-code', '0.0000002', '0.0000015', '0.00000002', '0'), ('d1', 'gpt-five', '0.00000125', '0.00001', '0.000000125', '0'), ('d1', 'openrouter/gpt-five-mini', '0.0000003', '0.000002', '0', '0'),
  ('d1', 'together_ai/gpt-five-mini', '0.00000025', '0.000002', '0', '0'), ('d2', 'mistral/mixtral-tiny', '0.0000001', '0.0000003', '0', '0'), ('d1', 'bedrock/llama-x-9-chat-v2', '0.0000004', '0.0000006', '0', '0'),
  ('d1', 'meta/llama-x-9-chat-v1', '0.0000005', '0.0000006', '0', '0'), ('d1', 'm-odd', NULL, NULL, '0.1', '0.1')
) AS t(dataset, model_key, i, o, cr, cw)"""

MODEL_SQL = r"""regexp_replace(regexp_replace(lower(trim(raw_model)), '\((minimal|low|medium|high|xhigh|none|auto)\)$', ''), '-[0-9]{8}$', '')"""
TOTAL_SQL = "input_tokens + output_tokens + cache_creation_tokens + cache_read_tokens + CASE WHEN source = 'error' THEN 0 ELSE reasoning_output_tokens END"
#: The listed price that each grouped model resolves to; worked out by hand from the rules.
RATE_KEYS = "(VALUES ('m-alpha-4-5', NULL, 'd1', 'm-alpha-4.5'), ('m-beta-2', NULL, 'd1', 'openai/m-beta-2'), ('m-beta-2', 'resold', 'd1', 'resold/m-beta-2'), ('vendor/m-gamma-1', NULL, 'd2', 'vendor/m-gamma-1'), ('m-gamma-1-preview', NULL, 'd2', 'vendor/m-gamma-1'), ('m-delta', NULL, 'd1', 'm-delta')) AS k(model, provider, dataset, model_key)"
#: One model can have several providers, each with its own price.
SAME = "r.model = n.model AND r.provider IS NOT DISTINCT FROM n.provider"


def tiered_sql(n: str, kind: str) -> str:
    """What n tokens of a kind cost: each part between two tiers at the last price listed at or below it."""
    d = lambda x: f"CAST({x} AS DECIMAL(19,0))"
    prices, parts, low = [f"r.{kind}"], [], 0
    for name in (*P.TIERS[kind], None):
        high = P.TIER_SIZES.get(name)
        part = f"greatest(least({n}, {high}) - {low}, 0)" if high else f"greatest({n} - {low}, 0)"
        parts.append(f"CAST({d(part)} * coalesce({', '.join(prices)}) AS DECIMAL(31,12))")
        if name:
            prices.insert(0, f"r.{kind}_above_{name}")
            low = high
    return f"({' + '.join(parts)})"


def cost_sql(i: str = "input_tokens", o: str = "(output_tokens + reasoning_output_tokens)", r: str = "cache_read_tokens", w: str = "cache_creation_tokens", tiered: bool = True) -> str:
    flat = lambda n, kind: f"CAST({n} AS DECIMAL(19,0)) * r.{kind}"
    one = tiered_sql if tiered else flat
    return f"coalesce({one(i, 'input')} + {one(o, 'output')} + {one(r, 'cache_read')} + {one(w, 'cache_write')}, 0)"


#: Start of every comparison query: usage_raw, price_dim, rates, usage (with model, total_tokens, cost), daily, session.
BASE = f"""WITH usage_raw AS ({USAGE_RAW}), price_dim AS ({PRICE_DIM}),
rates AS (SELECT k.model, k.provider, p.* EXCLUDE (dataset, model_key) FROM {RATE_KEYS} JOIN price_dim p ON p.dataset = k.dataset AND p.model_key = k.model_key),
named AS (SELECT *, {MODEL_SQL} AS model, {TOTAL_SQL} AS total_tokens FROM usage_raw),
usage AS (SELECT n.*, {cost_sql()} AS cost FROM named n LEFT JOIN rates r ON {SAME}),
daily AS (SELECT device, source, usage_date, model, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  CAST(sum(reasoning_output_tokens) AS BIGINT) AS reasoning_output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(cost) AS cost,
  min(project_path) AS project_path FROM usage GROUP BY ALL)
"""


def dbl(x: str) -> str:
    """SQL for published money."""
    return f"CAST(CAST(CAST({x} AS DECIMAL(38,12)) AS VARCHAR) AS DOUBLE)"


def usage_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    columns = USAGE_RAW.strip().removeprefix("SELECT").rsplit("FROM events", 1)[0]
    depth, start, parts = 0, 0, []
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(columns[start:i])
            start = i + 1
    return events.selectExpr(*parts, columns[start:])


def price_dim(spark: SparkSession) -> DataFrame:
    return spark.sql(PRICE_DIM)


def is_counter_log() -> Column:
    return F.col("source") == COUNTER_SOURCE


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_raw(spark, sf_dir).withColumn("model", S.normalise_model("raw_model")).withColumn("total_tokens", S.token_total(is_counter_log()))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ASKED.replace("FROM named", "FROM {named}"), named=named(spark, sf_dir))


def asked_dim(spark: SparkSession) -> DataFrame:
    return P.read_price_dim(spark.sql(ASKED_DIM))


_PRICES: dict[tuple, DataFrame] = {}


def _stamp(spark: SparkSession, path: str) -> tuple:
    """What tells one state of a file or folder from another."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(at).getLength(), fs.getFileStatus(at).getModificationTime()


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices of all models in use, by provider and without one; worked out once for a session and a state of the events."""
    path = f"{sf_dir}/events.parquet"
    key = (spark.sparkContext.applicationId, path, *_stamp(spark, path))
    if key not in _PRICES:
        _PRICES.clear()
        models = named(spark, sf_dir).select("model", F.explode(F.array("provider", F.lit(None).cast("string"))).alias("provider")).distinct()
        _PRICES[key] = P.price_table(P.resolve_prices(models, P.read_price_dim(price_dim(spark))))
    return _PRICES[key]


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events with model, total and exact cost."""
    return P.join_prices(named(spark, sf_dir), resolved(spark, sf_dir)).withColumn("cost", P.cost()).drop("rates")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.operators.rollup import rollup_daily

    return rollup_daily(usage(spark, sf_dir))


def daily_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows with `saved`: what caching saved on the day's sums, at the model's price with tiers."""
    days = daily(spark, sf_dir)
    return P.join_prices(days, resolved(spark, sf_dir)).withColumn("saved", P.cache_savings()).drop("rates", "provider")


_SAVED_ROWS = cost_sql(i="(n.input_tokens + n.cache_read_tokens + n.cache_creation_tokens)", o="(n.output_tokens + n.reasoning_output_tokens)", r="0", w="0")
_PAID_ROWS = cost_sql("n.input_tokens", "(n.output_tokens + n.reasoning_output_tokens)", "n.cache_read_tokens", "n.cache_creation_tokens")
#: Continues BASE with the table daily_saved.
SAVED = f", daily_saved AS (SELECT n.*, CASE WHEN n.cache_read_tokens + n.cache_creation_tokens > 0 THEN greatest({_SAVED_ROWS} - {_PAID_ROWS}, 0) ELSE 0 END AS saved FROM daily n LEFT JOIN rates r ON r.model = n.model AND r.provider IS NULL)"
