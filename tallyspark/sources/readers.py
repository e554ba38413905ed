"""Readers of session logs and usage stores. Schemas are declared, never inferred; bad lines become rows of nulls and go."""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators.pricing import TIERS
from tallyspark.operators.series import carry_forward

_N = "bigint"
ASSISTANT = f"type string, timestamp string, requestId string, costUSD double, model string, message struct<id:string,model:string,usage:struct<input_tokens:{_N},output_tokens:{_N},cache_read_input_tokens:{_N},cache_creation_input_tokens:{_N},reasoning_tokens:{_N},thinking_tokens:{_N}>>"
_USE = f"struct<input_tokens:{_N},cached_input_tokens:{_N},cache_read_input_tokens:{_N},output_tokens:{_N},reasoning_output_tokens:{_N}>"
COUNTER = f"timestamp string, type string, payload struct<id:string,cwd:string,forked_from_id:string,thread_source:string,source:struct<subagent:struct<thread_spawn:string>>,type:string,model:string,model_name:string,model_info:struct<slug:string>,info:struct<model:string,last_token_usage:{_USE},total_token_usage:{_USE}>>"
MESSAGE_FIELDS = f"id:string,sessionID:string,role:string,modelID:string,providerID:string,cost:double,agent:string,path:struct<root:string>,time:struct<created:{_N},completed:{_N}>,tokens:struct<input:{_N},output:{_N},reasoning:{_N},cache:struct<read:{_N},write:{_N}>>"
MESSAGE = f"struct<{MESSAGE_FIELDS}>"

TURN_TOKENS = f"struct<input:{_N},output:{_N},cached:{_N},thoughts:{_N},tool:{_N},total:{_N}>"
DOCUMENT = f"sessionId string, messages array<struct<id:string,type:string,timestamp:string,model:string,tokens:{TURN_TOKENS}>>"
_STAT = f"struct<prompt:{_N},input:{_N},input_tokens:{_N},candidates:{_N},output:{_N},output_tokens:{_N},cached:{_N},cached_tokens:{_N},thoughts:{_N},reasoning:{_N}>"
STATS_FIELDS = f"struct<models:map<string,struct<tokens:{_STAT}>>,input_tokens:{_N},prompt_tokens:{_N},output_tokens:{_N},candidates_tokens:{_N},cached_tokens:{_N},thoughts_tokens:{_N},reasoning_tokens:{_N}>"
STATS = f"model string, timestamp string, session_id string, sessionId string, stats {STATS_FIELDS}"
TURN = f"type string, id string, model string, session_id string, sessionId string, timestamp string, tokens {TURN_TOKENS}, stats {STATS_FIELDS}, result struct<stats:{STATS_FIELDS}>"
AGENT = f"type string, customType string, modelId string, provider string, timestamp string, data struct<modelId:string,provider:string>, message struct<role:string,model:string,provider:string,timestamp:{_N},usage:struct<input:{_N},output:{_N},cacheRead:{_N},cacheWrite:{_N},cost:struct<total:double>>>"
#: Our names of the rates, and the price table's.
RATE_NAMES = {"input": "input_cost_per_token", "output": "output_cost_per_token", "cache_read": "cache_read_input_token_cost", "cache_write": "cache_creation_input_token_cost"}
RATE_NAMES |= {f"{k}_above_{t}": f"{RATE_NAMES[k]}_above_{t}_tokens" for k, ts in TIERS.items() for t in ts}
RATES = "struct<" + ",".join(f"{k}:decimal(18,12)" for k in RATE_NAMES.values()) + ">"
#: A payload's field names, and ours.
PUSHED = {"device": "string", "source": "string", "usageDate": "date", "model": "string", "sessionId": "string", "eventKey": "string", "eventTime": "string", "lastActivity": "string", "projectPath": "string"}
PUSHED_COUNTS = ["inputTokens", "outputTokens", "cacheCreationTokens", "cacheReadTokens", "reasoningOutputTokens", "totalTokens"]
PUSHED_FIELDS = {
    "daily": ["device", "source", "usageDate", "model"],
    "time": ["device", "source", "eventKey", "eventTime", "usageDate", "model", "projectPath", "sessionId"],
    "sessions": ["device", "source", "sessionId", "lastActivity", "projectPath"],
}
_RUN = "struct<device:string,source:string,status:string,message:string,collectedAt:string,command:string>"


def _push_schema() -> str:
    counts = ",".join(f"{c}:{_N}" for c in PUSHED_COUNTS)
    arrays = [f"{name} array<struct<{','.join(f'{c}:{PUSHED[c]}' for c in fields)},{counts},costUSD:decimal(38,12)>>" for name, fields in PUSHED_FIELDS.items()]
    return f"device string, mode string, collectedAt string, {', '.join(arrays)}, runs array<{_RUN}>"


PUSH = _push_schema()


def _not_zero(*columns: str) -> Column:
    """The first that is neither null nor 0, else 0."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit(0)) for c in columns), F.lit(0)).cast("long")


def line_in_task() -> Column:
    """The place of a line among those of its scan task."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def scan_session_lines(spark: SparkSession, roots: list[str], glob: str = "*.jsonl") -> DataFrame:
    """file_path, line_no and value of the trimmed lines that aren't blank; files stay splittable and nothing is shuffled.

    line_no grows in the order of the file, with gaps: the byte at which the line's block begins and the line's place in its
    scan task. A block has more bytes than its task has lines before its end, so a later block's lines come later.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(sorted(set(roots)))
    lines = lines.select(F.col("_metadata.file_path").alias("file_path"), (F.col("_metadata.file_block_start") + line_in_task()).alias("line_no"), F.col("_metadata.file_modification_time").alias("modified"), F.trim("value").alias("value"))
    return lines.where("value <> ''")


def distinct_paths(paths: DataFrame) -> DataFrame:
    return paths.select("path").distinct()


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    return lines.withColumn("j", F.from_json("value", schema)).drop("value")


def read_assistant_usage(spark: SparkSession, roots: list[str], glob: str = "*.jsonl") -> DataFrame:
    """Assistant lines with usage."""
    rows = parsed(scan_session_lines(spark, roots, glob), ASSISTANT).where("j.type = 'assistant' AND j.message.usage IS NOT NULL")
    u = "j.message.usage."
    return rows.select(
        "file_path", "line_no", F.col("j.message.id").alias("message_id"), F.col("j.requestId").alias("request_id"), S.event_instant("j.timestamp").alias("event_time"),
        S.normalise_model(F.coalesce(F.nullif("j.message.model", F.lit("")), F.nullif("j.model", F.lit("")), F.lit("unknown"))).alias("model"),
        S.positive_int(u + "input_tokens").alias("input_tokens"), S.positive_int(u + "output_tokens").alias("output_tokens"), S.positive_int(u + "cache_creation_input_tokens").alias("cache_creation_tokens"),
        S.positive_int(u + "cache_read_input_tokens").alias("cache_read_tokens"), _not_zero(u + "reasoning_tokens", u + "thinking_tokens").alias("reasoning_output_tokens"), F.coalesce("j.costUSD", F.lit(0.0)).alias("recorded_cost"),
    )


def read_counter_log(spark: SparkSession, roots: list[str], glob: str = "*.jsonl") -> DataFrame:
    """Token-count lines with the session's model, workspace and whether it copies its parent's history."""
    rows = parsed(scan_session_lines(spark, roots, glob), COUNTER).where("j.type IS NOT NULL").select("file_path", "line_no", "j.*")
    p = lambda c: F.col(f"payload.{c}")
    meta, turn = F.col("type") == "session_meta", F.col("type") == "turn_context"
    replay = p("forked_from_id").isNotNull() | p("source.subagent.thread_spawn").isNotNull() | F.coalesce(p("thread_source") == "subagent", F.lit(False))
    named = F.when(turn, F.coalesce(*(F.nullif(F.trim(p(c)), F.lit("")) for c in ("model", "model_name", "model_info.slug"))))
    rows = rows.withColumn("model", named).withColumn("workspace", F.when(meta, p("cwd"))).withColumn("replay", F.when(meta, replay))
    rows = carry_forward(rows, ["model", "workspace", "replay"], "file_path", ["line_no"])

    def use(c: str) -> Column:
        g = lambda k: S.positive_int(f"{c}.{k}")
        return F.when(F.col(c).isNotNull(), F.struct(g("input_tokens").alias("input"), F.greatest(g("cached_input_tokens"), g("cache_read_input_tokens")).alias("cached"), g("output_tokens").alias("output"), g("reasoning_output_tokens").alias("reasoning")))

    rows = rows.where("type = 'event_msg' AND payload.type = 'token_count' AND payload.info IS NOT NULL")
    model = S.normalise_model(F.coalesce(p("model"), p("info.model"), F.col("model"), F.lit("unknown")))
    return rows.select("file_path", "line_no", F.col("timestamp").alias("ts"), model.alias("model"), "workspace", F.coalesce("replay", F.lit(False)).alias("replay"), use("payload.info.last_token_usage").alias("last"), use("payload.info.total_token_usage").alias("total"))


def read_message_store(messages: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """Assistant messages of a relational store (id, session_id, data) with their session's workspace."""
    rows = messages.withColumn("j", F.from_json("data", MESSAGE))
    if sessions is not None:
        s = sessions.select(F.col("id").alias("session_id"), F.nullif("directory", F.lit("")).alias("directory"))
        rows = rows.join(s, "session_id", "left")
    else:
        rows = rows.withColumn("directory", F.lit(None).cast("string"))
    return _messages(rows, F.col("id"), F.col("session_id"))


def _messages(rows: DataFrame, ident: Column, session: Column) -> DataFrame:
    rows = rows.where("j.role = 'assistant' AND j.tokens IS NOT NULL AND trim(j.modelID) <> ''")
    t = lambda c: S.positive_int(f"j.tokens.{c}")
    return rows.select(
        F.coalesce("j.id", ident).alias("event_key"), F.coalesce("j.sessionID", session).alias("session_id"), S.event_instant("j.time.created").alias("event_time"), S.normalise_model("j.modelID").alias("model"),
        S.canonical_provider("j.providerID").alias("provider"), F.coalesce("directory", "j.path.root").alias("project_path"), t("input").alias("input_tokens"), t("output").alias("output_tokens"),
        t("cache.write").alias("cache_creation_tokens"), t("cache.read").alias("cache_read_tokens"), t("reasoning").alias("reasoning_output_tokens"), F.coalesce("j.cost", F.lit(0.0)).alias("recorded_cost"),
    )


def _whole_files(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(sorted(set(roots)), wholetext=True)


def read_message_json(spark: SparkSession, roots: list[str], glob: str = "*.json") -> DataFrame:
    """A message document, or an array of them, in each file; the file's stem is the fallback id."""
    rows = _whole_files(spark, roots, glob).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.[^.]*$", 1).alias("stem"), F.explode(F.from_json("value", f"array<struct<{MESSAGE_FIELDS}>>")).alias("j"), F.lit(None).cast("string").alias("directory"))
    return _messages(rows, F.col("stem"), F.col("j.sessionID"))


def read_session_document(spark: SparkSession, roots: list[str], glob: str = "*.json") -> DataFrame:
    """Turns of whole-session documents, one or an array of them in each file; the file's time stands in for a missing one."""
    rows = _whole_files(spark, roots, glob).select(F.col("_metadata.file_modification_time").alias("modified"), F.explode(F.from_json("value", f"array<struct<{DOCUMENT}>>")).alias("j"))
    rows = rows.select("modified", F.col("j.sessionId").alias("session_id"), F.explode("j.messages").alias("m")).where("m.type = 'gemini' AND trim(m.model) <> '' AND m.tokens IS NOT NULL")
    return _turns(rows, "m")


def _turns(rows: DataFrame, m: str) -> DataFrame:
    t = lambda c: F.greatest(F.coalesce(F.col(f"{m}.tokens.{c}"), F.lit(0)), F.lit(0))
    i, read = S.split_cached_checked(t("input"), t("cached"), t("output"), t("thoughts"), t("tool"), F.col(f"{m}.tokens.total"))
    return rows.select("session_id", F.coalesce(S.event_instant(f"{m}.timestamp"), "modified").alias("event_time"), S.normalise_model(f"{m}.model").alias("model"), (i + t("tool")).alias("input_tokens"), t("output").alias("output_tokens"), F.lit(0).cast("long").alias("cache_creation_tokens"), read.alias("cache_read_tokens"), t("thoughts").alias("reasoning_output_tokens"))


def _statistics(rows: DataFrame) -> DataFrame:
    """Usage of statistics (session_id, event_time, model as a hint, stats): by model; only where no model has tokens, the flat counters."""
    some = lambda v, *names: S.positive_int(F.coalesce(*(v[n] for n in names)))
    tokens = lambda v: {"i": some(v, "prompt", "input", "input_tokens"), "o": some(v, "candidates", "output", "output_tokens"), "c": some(v, "cached", "cached_tokens"), "r": some(v, "thoughts", "reasoning")}
    counted = F.transform(F.map_entries("stats.models"), lambda e: F.struct(e["key"].alias("model"), *(x.alias(k) for k, x in tokens(e["value"]["tokens"]).items())))
    live = F.coalesce(F.filter(counted, lambda x: x["i"] + x["o"] + x["c"] + x["r"] > 0), F.array().cast("array<struct<model:string,i:bigint,o:bigint,c:bigint,r:bigint>>"))
    stats = F.col("stats")
    flat = {"i": some(stats, "input_tokens", "prompt_tokens"), "o": some(stats, "output_tokens", "candidates_tokens"), "c": some(stats, "cached_tokens"), "r": some(stats, "thoughts_tokens", "reasoning_tokens")}
    alone = F.struct(F.coalesce("model", F.lit("unknown")).alias("model"), *(x.alias(k) for k, x in flat.items()))
    rows = rows.withColumn("live", live)
    found = rows.withColumn("x", F.explode(F.when(F.size("live") > 0, F.col("live")).otherwise(F.array(alone)))).where("x.i + x.o + x.c + x.r > 0")
    return found.select("session_id", "event_time", S.normalise_model("x.model").alias("model"), (F.col("x.i") - F.least("x.c", "x.i")).alias("input_tokens"), F.col("x.o").alias("output_tokens"), F.lit(0).cast("long").alias("cache_creation_tokens"), F.col("x.c").alias("cache_read_tokens"), F.col("x.r").alias("reasoning_output_tokens"))


def read_stats_document(rows: DataFrame) -> DataFrame:
    """Per-model statistics (value: JSON text, a document or an array of them); only where no model has tokens, the flat counters with the model hint."""
    rows = rows.select(F.explode(F.from_json("value", f"array<struct<{STATS}>>")).alias("j")).where("j.stats IS NOT NULL")
    return _statistics(rows.select(F.coalesce("j.session_id", "j.sessionId").alias("session_id"), S.event_instant("j.timestamp").alias("event_time"), F.col("j.model").alias("model"), F.col("j.stats").alias("stats")))


def read_stats_files(spark: SparkSession, roots: list[str], glob: str = "*.json") -> DataFrame:
    """Documents of statistics, one or an array of them in each file."""
    return read_stats_document(_whole_files(spark, roots, glob).select("value"))


def read_turn_stream(spark: SparkSession, roots: list[str], glob: str = "*.jsonl") -> DataFrame:
    """Turns and statistics of files that mix them.

    A line belongs to the session that it or the last line before it names, else to the file's stem; a repeated turn id keeps
    its last version. Statistics (`stats` or `result.stats`) without models are those of the last model that was named.
    """
    rows = parsed(scan_session_lines(spark, roots, glob), TURN).where("j IS NOT NULL")
    named = F.col("j.type").isin("init", "gemini")
    rows = rows.withColumn("session_id", F.coalesce("j.session_id", "j.sessionId")).withColumn("hint", F.when(named, F.col("j.model")))
    rows = carry_forward(rows, ["session_id", "hint"], "file_path", ["line_no"])
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    rows = rows.withColumn("session_id", F.coalesce("session_id", F.url_decode(stem)))
    turns = rows.where("j.type = 'gemini' AND trim(j.model) <> '' AND j.tokens IS NOT NULL").withColumn("turn", F.col("j.id"))
    place = F.row_number().over(Window.partitionBy("file_path", "turn").orderBy(F.desc("line_no")))
    turns = turns.withColumn("p", F.when(F.col("turn").isNull(), 1).otherwise(place)).where("p = 1")
    stats = rows.where("j.type IS NULL OR j.type NOT IN ('init', 'gemini')").withColumn("stats", F.coalesce("j.stats", "j.result.stats")).where("stats IS NOT NULL")
    stats = stats.select("session_id", F.coalesce(S.event_instant("j.timestamp"), "modified").alias("event_time"), F.col("hint").alias("model"), "stats")
    return _turns(turns, "j").unionByName(_statistics(stats))


def read_agent_transcript(spark: SparkSession, roots: list[str], glob: str = "*.jsonl*") -> DataFrame:
    """Assistant messages with the model and provider that the last change or snapshot line set."""
    rows = parsed(scan_session_lines(spark, roots, glob), AGENT).where("j.type IS NOT NULL")
    snap = F.col("j.customType") == "model-snapshot"
    rows = rows.withColumn("m", F.when(F.col("j.type") == "model_change", F.col("j.modelId")).when(snap, F.col("j.data.modelId"))).withColumn("pv", F.when(F.col("j.type") == "model_change", F.col("j.provider")).when(snap, F.col("j.data.provider")))
    rows = carry_forward(rows, ["m", "pv"], "file_path", ["line_no"]).where("j.type = 'message' AND j.message.role = 'assistant' AND j.message.usage IS NOT NULL")
    t = lambda c: S.positive_int(f"j.message.usage.{c}")
    out = rows.select(
        session_from_file(F.element_at(F.split("file_path", "/"), -1)).alias("session_id"), F.coalesce(S.event_instant("j.message.timestamp"), S.event_instant("j.timestamp"), "modified").alias("event_time"),
        F.coalesce("j.message.model", "m").alias("model"), F.coalesce("j.message.provider", "pv", F.lit("unknown")).alias("provider"), t("input").alias("input_tokens"), t("output").alias("output_tokens"), t("cacheWrite").alias("cache_creation_tokens"),
        t("cacheRead").alias("cache_read_tokens"), F.lit(0).cast("long").alias("reasoning_output_tokens"), F.greatest(F.coalesce("j.message.usage.cost.total", F.lit(0.0)), F.lit(0.0)).alias("recorded_cost"),
    )
    return out.where("trim(model) <> ''").withColumn("model", S.normalise_model("model"))


def session_from_file(name: Column) -> Column:
    return F.substring_index(name, ".jsonl", 1)


def list_transcript_files(files: DataFrame, index: DataFrame) -> DataFrame:
    """path, session_id: indexed files under the index's id, others that look like transcripts under their own; none twice."""
    name = F.element_at(F.split("path", "/"), -1)
    mine = files.where(name.rlike(r"\.jsonl($|\.deleted\.|\.reset\.)")).select("path").distinct().join(index.select("path"), "path", "left_anti")
    return mine.select("path", session_from_file(name).alias("session_id")).unionByName(index.select("path", "session_id"))


def read_session_summary(table: DataFrame) -> DataFrame:
    """Rows of a store that is already aggregated by session, with tokens or cost."""
    cost = F.coalesce("actual_cost_usd", "estimated_cost_usd", F.lit(0.0))
    some = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens") + F.col("reasoning_tokens")
    rows = table.where(F.trim("model") != "").where((some > 0) | (cost > 0))
    return rows.select(F.col("id").alias("session_id"), S.normalise_model("model").alias("model"), S.canonical_provider("billing_provider").alias("provider"), S.event_instant("started_at").alias("event_time"), "input_tokens", "output_tokens", F.col("cache_write_tokens").alias("cache_creation_tokens"), "cache_read_tokens", F.col("reasoning_tokens").alias("reasoning_output_tokens"), cost.alias("recorded_cost"))


def read_price_table(rows: DataFrame, dataset: str) -> DataFrame:
    """Price JSON ({"data": {key: rates}}) as rows; entries with neither price are none."""
    data = rows.select(F.explode(F.from_json("value", f"data map<string,{RATES}>")["data"]).alias("model_key", "r"))
    data = data.where("r.input_cost_per_token IS NOT NULL OR r.output_cost_per_token IS NOT NULL")
    return data.select(F.lit(dataset).alias("dataset"), "model_key", *(F.col(f"r.{v}").alias(k) for k, v in RATE_NAMES.items()))


def snake(name: str) -> str:
    """The name of a payload's field among our columns."""
    return "cost" if name == "costUSD" else re.sub("(?<=[a-z])([A-Z])", r"_\1", name).lower()


def read_push_payload(rows: DataFrame) -> dict[str, DataFrame]:
    """Payload JSON (value, one each row) as daily, time, session and run rows.

    Every row has from_device and mode (all but `incremental` is a full one) of its payload, `at`, by which payloads are
    ordered (time of collection, then `place` where rows have one), and pos, its place among the payload's rows. A missing
    array has no rows, a broken line none at all; counters and costs that are missing are 0.
    """
    place = F.col("place") if "place" in rows.columns else F.lit(None).cast("struct<file_path:string,line_no:bigint>")
    j = rows.select(F.from_json("value", PUSH).alias("j"), place.alias("place")).where("j IS NOT NULL")
    mode = F.when(F.col("j.mode") == "incremental", "incremental").otherwise("full")
    j = j.withColumns({"from_device": F.col("j.device"), "mode": mode, "at": F.struct(S.event_instant("j.collectedAt").alias("collected_at"), "place")})

    def branch(name: str) -> DataFrame:
        return j.select("from_device", "mode", "at", F.posexplode(f"j.{name}").alias("pos", "r"))

    out = {}
    for name, fields in PUSHED_FIELDS.items():
        columns = [(S.event_instant(f"r.{c}") if c in ("eventTime", "lastActivity") else F.col(f"r.{c}")).alias(snake(c)) for c in fields]
        counts = [F.coalesce(f"r.{c}", F.lit(0).cast("long")).alias(snake(c)) for c in PUSHED_COUNTS]
        out[name] = branch(name).select("from_device", "mode", "at", "pos", *columns, *counts, F.coalesce("r.costUSD", F.lit(0).cast("decimal(38,12)")).alias("cost"))
    collected = F.coalesce(S.event_instant("r.collectedAt"), F.col("at.collected_at")).alias("collected_at")
    out["runs"] = branch("runs").select("from_device", "mode", "at", "pos", "r.device", "r.source", "r.status", "r.message", collected, "r.command")
    return out


def read_usage_tables(spark: SparkSession, root: str, runs: int = 500) -> dict[str, DataFrame]:
    """The stored daily, time and session facts and the newest runs, each row with the id it goes by; event days follow from their times."""
    keys = {"daily": ("device", "source", "usage_date", "model"), "time": ("device", "source", "event_key"), "sessions": ("device", "source", "session_id")}
    tables = {name: spark.read.parquet(f"{root}/{name}").withColumn("row_id", S.row_id(*columns)) for name, columns in keys.items()}
    if "usage_date" not in tables["time"].columns:
        tables["time"] = tables["time"].withColumn("usage_date", F.to_date("event_time"))
    log = spark.read.parquet(f"{root}/runs").select(F.col("id").cast("string").alias("row_id"), "*").orderBy(F.desc("id")).limit(runs)
    return tables | {"runs": log.withColumn("message", F.regexp_replace("message", r"[\r\n]+", " "))}


def normalise_quota_snapshots(rows: DataFrame) -> DataFrame:
    """tool, window, utilization (0 to 1), tone from landed JSON: a map of windows, or a list with window_seconds and used_percent."""
    j = rows.select("tool", F.from_json("value", "windows map<string,struct<utilization:double,resets_at:string>>, list array<struct<window_seconds:bigint,used_percent:double,resets_at:string>>").alias("j"))
    a = j.select("tool", F.explode("j.windows").alias("window", "w")).where("window <> 'extra_usage' AND w.utilization IS NOT NULL").select("tool", "window", (F.col("w.utilization") / 100).alias("utilization"), F.col("w.resets_at").alias("resets_at"))
    b = j.select("tool", F.explode("j.list").alias("w")).where("w.used_percent IS NOT NULL")
    s = F.col("w.window_seconds")
    name = F.when(s == 18000, "five_hour").when(s == 604800, "seven_day").when(s % 86400 == 0, F.concat((s / 86400).cast("long").cast("string"), F.lit("_day"))).otherwise(F.concat((s / 3600).cast("long").cast("string"), F.lit("_hour")))
    b = b.select("tool", name.alias("window"), (F.col("w.used_percent") / 100).alias("utilization"), F.col("w.resets_at").alias("resets_at"))
    return a.unionByName(b).withColumn("tone", F.when(F.col("utilization") >= 0.9, "bad").when(F.col("utilization") >= 0.7, "warn").otherwise("ok"))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
