"""Streams on the driver's tables: what lands in several batches, and the rows that the same operator gives at once."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyspark.functions import scalars as S
from tallyspark.operators import merge as M
from tallyspark.operators import normalize as D
from tallyspark.operators import pricing as P
from tallyspark.operators import rollup as R
from tallyspark.operators.stages import checkpointed, scratch
from tallyspark.plans import adapter as U
from tallyspark.plans.adapter import BASE, dbl
from tallyspark.plans.events import LINES, TODAY, _cumulative, file_of, files_for
from tallyspark.sources import readers
from tallyspark.streaming import facts, jobs

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None, base: bool = True):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = (BASE if base else "") + sql
        return f

    return put


def _now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = U.usage(spark, d).select("device", "source", "event_key", F.col("event_time").cast("timestamp").alias("event_time"), "usage_date", "model", "total_tokens", F.col("cost").cast("decimal(38,12)").alias("cost"))
    return checkpointed(rows)


#: Of a file stream: a batch takes all that has landed.
WHOLE = {"files_per_batch": None}


def in_turn(frames: list[DataFrame], name: str, start: Callable[[str], DataStreamWriter], text: bool = False) -> None:
    """Lands one frame after the other in one folder and runs the stream after each.

    A frame is one batch, however many files it takes, if the stream bounds no batch (WHOLE): what follows from the order
    of batches, as their numbers and watermarks, must not depend on how a frame was cut into files.
    """
    spark = frames[0].sparkSession
    path, mark = scratch(spark, f"{name}-landing"), scratch(spark, f"{name}-mark")
    for frame in frames:
        writer = frame.write.mode("append")
        writer.text(path) if text else writer.parquet(path)
        jobs.run_available(start(path), mark)


#: The landing of an event: by ten days, but a third of each last day's events come one batch late.
WAVE = "CASE WHEN usage_date < DATE '2024-01-09' THEN 0 WHEN usage_date = DATE '2024-01-09' THEN CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END WHEN usage_date < DATE '2024-01-19' THEN 1 WHEN usage_date = DATE '2024-01-19' THEN CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END ELSE 2 END"


def _waves(rows: DataFrame) -> list[DataFrame]:
    wave = rows.withColumn("event_id", F.col("event_key").cast("long")).withColumn("wave", F.expr(WAVE)).drop("event_id")
    return [wave.where(f"wave = {i}").drop("wave") for i in range(3)]


@query("T01_stream_log_lines", "SELECT event_key FROM usage")
def stream_lines(spark, d):
    """Text segments in three batches; a further run finds nothing new."""
    rows = U.named(spark, d)
    waves = [w.select(F.to_json(F.struct("event_key", "total_tokens")).alias("value")) for w in _waves(rows)]
    out = scratch(spark, "lines-out")
    keep = lambda batch, number: jobs.placed(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
    in_turn([*waves, waves[0].limit(0)], "lines", lambda path: jobs.stream_text_lines(spark, path, **WHOLE).writeStream.foreachBatch(keep), text=True)
    return spark.read.parquet(out).dropDuplicates(["file_path", "line_no"]).select(F.get_json_object("value", "$.event_key").alias("event_key"))




@query(
    "T01_changed_log_files",
    "SELECT 'line' AS kind, event_key AS name, CASE WHEN user_id % 4 = 1 THEN 'new' ELSE 'old' END AS state FROM usage WHERE user_id % 4 <> 2 AND (user_id % 4 <> 0 OR event_id % 2 = 0) "
    "UNION ALL SELECT DISTINCT 'done', 'user-' || CAST(user_id AS VARCHAR) || CASE user_id % 4 WHEN 1 THEN ' changed' WHEN 2 THEN ' gone' WHEN 3 THEN ' new' ELSE ' changed' END, 'run 2' FROM usage "
    "UNION ALL SELECT 'done', 'files of the last run', '0'",
)
def changed_files(spark, d):
    """A file for some users each, collected three times: between the first two runs files change, get shorter, go or come; then nothing.

    What happened to a file happened to every user whose lines it held before or holds now. More events make more files, and
    a file's users have one remainder by four.
    """
    rows = U.named(spark, d).select("user_id", "event_id", "event_key")
    file = F.concat_ws("-", F.pmod("user_id", F.lit(4)), file_of("user_id", files_for(rows.count(), LINES)))
    rows = checkpointed(rows.withColumn("file", file))
    landing, root = scratch(spark, "changing"), scratch(spark, "changing-facts")

    def write(part: DataFrame, state: str, mode: str, kept: str = "true") -> None:
        """Lines that aren't kept are left blank, so a file that loses all of them is still there."""
        line = F.to_json(F.struct(F.concat(F.lit("user-"), "user_id").alias("user"), "event_key", F.lit(state).alias("state")))
        lines = part.select("file", F.when(F.expr(kept), line).otherwise("").alias("value"))
        lines.repartition("file").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("file").text(landing)

    write(rows.where("user_id % 4 <> 3"), "old", "overwrite")
    facts.collect_changed(spark, landing, root, 0, "part-*")
    write(rows.where("user_id % 4 = 1"), "new", "overwrite")
    write(rows.where("user_id % 4 = 0"), "old", "overwrite", "event_id % 2 = 0")
    write(rows.where("user_id % 4 = 3"), "old", "append")
    write_gone = rows.where("user_id % 4 = 2").select(F.concat(F.lit("file="), "file").alias("name")).distinct()
    folder = spark._jvm.org.apache.hadoop.fs.Path(landing).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in write_gone.toLocalIterator():
        folder.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{landing}/{r.name}"), True)
    second = facts.collect_changed(spark, landing, root, 1, "part-*")
    third = facts.collect_changed(spark, landing, root, 2, "part-*")
    name = F.regexp_extract("file_path", "file=([0-9]+-[0-9]+)", 1).alias("file")
    # Spark gives a rewritten file another name, so a changed one is one gone and one new
    kind = F.when(F.count_distinct("what") == 2, "changed").otherwise(F.max("what"))
    held = readers.union_sources([facts.current(spark, root, "lines", number).select(name, F.get_json_object("value", "$.user").alias("user")) for number in (1, 2)])
    done = second.groupBy(name).agg(kind.alias("what")).join(held.distinct(), "file").select(F.lit("done").alias("kind"), F.concat_ws(" ", "user", "what").alias("name"), F.lit("run 2").alias("state"))
    last = third.agg(F.count("*").cast("string").alias("state")).select(F.lit("done").alias("kind"), F.lit("files of the last run").alias("name"), "state")
    lines = facts.stored(spark, root, "lines").select(F.lit("line").alias("kind"), F.get_json_object("value", "$.event_key").alias("name"), F.get_json_object("value", "$.state").alias("state"))
    return lines.unionByName(done).unionByName(last)


@query("T02_stream_dedupe_events", "SELECT device, source, event_key FROM usage")
def stream_dedupe(spark, d):
    """Three batches; every tenth event comes twice in its batch and once more in the next."""
    a, b, c = _waves(_events(spark, d))
    again = lambda x: x.where("event_key LIKE '%0'")
    late = again(a).where("usage_date >= DATE '2024-01-08'")  # within the overlap; older copies are for a merge
    out = scratch(spark, "deduped")
    frames = [a.unionByName(again(a)), b.unionByName(again(b)).unionByName(late), c.unionByName(again(c))]
    in_turn(frames, "deduped", lambda path: jobs.stream_dedupe_events(jobs.stream_log_lines(spark, path, a.schema, **WHOLE)).writeStream.outputMode("append").format("parquet").option("path", out))
    return spark.read.parquet(out).select("device", "source", "event_key")


@query("T03_stream_hourly_usage", "SELECT date_trunc('hour', event_time) AS hour_start, device, source, model, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM usage GROUP BY 1, 2, 3, 4")
def stream_hourly(spark, d):
    """Three batches that touch the same hours; an hour's row takes the place of its earlier one."""
    waves, root = _waves(_events(spark, d)), scratch(spark, "hourly")
    keep = facts.keep_newest(spark, root, "hours", ["hour_start", "device", "source", "model"], F.to_date("hour_start"))
    in_turn(waves, "hourly", lambda path: jobs.stream_hourly_usage(jobs.stream_log_lines(spark, path, waves[0].schema, **WHOLE)).writeStream.outputMode("update").foreachBatch(keep))
    return facts.stored(spark, root, "hours").withColumn("hour_start", F.col("hour_start").cast("timestamp_ntz"))


@query("T04_stream_daily_usage", "SELECT usage_date, device, source, model, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM usage GROUP BY 1, 2, 3, 4")
def stream_daily(spark, d):
    waves, root = _waves(_events(spark, d)), scratch(spark, "daily")
    keep = facts.keep_newest(spark, root, "days", ["usage_date", "device", "source", "model"], F.col("usage_date"))
    in_turn(waves, "daily", lambda path: jobs.stream_daily_usage(jobs.stream_log_lines(spark, path, waves[0].schema, **WHOLE)).writeStream.outputMode("update").foreachBatch(keep))
    return facts.stored(spark, root, "days")


@query("T05_stream_counter_increments", "SELECT CAST(user_id AS VARCHAR) AS file_path, event_id * 2 AS line_no, output_tokens FROM usage_raw")
def stream_counters(spark, d):
    """Every session's lines in four segments; the third lands before the second."""
    lines = checkpointed(_cumulative(spark, d))
    place = F.percent_rank().over(_by_line())
    cut = checkpointed(lines.withColumn("segment", F.least(F.floor(place * 4), F.lit(3)).cast("int")))
    first = cut.groupBy("file_path").agg(F.sort_array(F.collect_set("segment")).alias("all"))
    cut = checkpointed(cut.join(first, "file_path").withColumn("segment", F.array_position("all", F.col("segment")).cast("int") - 1).drop("all"))
    out = scratch(spark, "counters")
    frames = [cut.where("segment = 0"), cut.where("segment = 2"), cut.where("segment = 1"), cut.where("segment > 2")]
    in_turn(frames, "counters", lambda path: jobs.stream_counter_increments(jobs.stream_log_lines(spark, path, cut.schema, **WHOLE).withColumn("landed", F.col("_metadata.file_modification_time"))).writeStream.outputMode("append").format("parquet").option("path", out))
    return spark.read.parquet(out).select("file_path", "line_no", "output_tokens")


def _by_line():
    from pyspark.sql import Window

    return Window.partitionBy("file_path").orderBy("line_no")


@query("T06_stream_merge_daily", f"SELECT device, source, usage_date, model, total_tokens, {dbl('CASE WHEN usage_date < DATE ' + chr(39) + '2024-01-20' + chr(39) + ' THEN cost + 1 ELSE cost END')} AS cost_usd, usage_date < DATE '2024-01-20' AS locked FROM daily")
def stream_merge_daily(spark, d):
    """Three batches: early counts at a cost that locks past days, the same again, then all counts at the final cost."""
    root = scratch(spark, "daily-merged")
    rows = checkpointed(U.daily(spark, d).select(*M.DAILY_KEYS, "total_tokens", F.col("cost").cast("decimal(38,12)").alias("cost")))
    early = rows.withColumn("total_tokens", F.lit(1).cast("long")).withColumn("cost", (F.col("cost").cast("decimal(36,12)") + 1).cast("decimal(38,12)"))
    in_turn([early, early, rows], "daily", lambda path: jobs.stream_merge_daily(spark, jobs.stream_log_lines(spark, path, rows.schema, **WHOLE), root, TODAY, _now()))
    out = jobs.stored_days(spark, root)
    return out.select(*M.DAILY_KEYS, "total_tokens", P.as_double(F.col("cost")).alias("cost_usd"), F.col("pricing_locked_at").isNotNull().alias("locked"))


@query("T07_stream_ingest_events", "SELECT event_key, total_tokens FROM usage")
def stream_ingest(spark, d):
    """Three batches: a part with stale totals, the other part, then the first part again as it ends up."""
    root = scratch(spark, "events-merged")
    rows = checkpointed(U.named(spark, d).select("device", "source", "event_key", "usage_date", "total_tokens"))
    odd = F.crc32(F.col("event_key").cast("binary")) % 2 == 1
    frames = [rows.where(odd).withColumn("total_tokens", F.lit(0).cast("long")), rows.where(~odd), rows.where(odd)]
    in_turn(frames, "events", lambda path: jobs.stream_merge_events(spark, jobs.stream_log_lines(spark, path, rows.schema, **WHOLE), root))
    return jobs.stored_days(spark, root).select("event_key", "total_tokens")


# --- device payloads ----------------------------------------------------------------------------------------------------


def _camel(name: str) -> str:
    return "costUSD" if name == "cost" else "".join(w.capitalize() if i else w for i, w in enumerate(name.split("_")))


def push_payloads(rows: DataFrame, mode, collected_at) -> DataFrame:
    """Payloads as devices send them (value): a device is a user here, so more events make more payloads, not larger ones."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    packed = lambda table, columns: table.groupBy("device").agg(F.collect_list(F.struct(*(F.col(c).alias(_camel(c)) for c in columns))).alias("x"))
    counts = [*S.COUNTERS, "total_tokens", "cost"]
    time = packed(rows.withColumn("event_time", iso("event_time")), ["device", "source", "event_key", "event_time", "usage_date", "model", "project_path", "session_id", *counts])
    daily = packed(R.rollup_daily(rows), [*M.DAILY_KEYS, *counts])
    sessions = packed(R.rollup_sessions(rows).withColumn("last_activity", iso("last_activity")), [*M.SESSION_KEYS, "last_activity", "project_path", *counts])
    counted = rows.groupBy("device", "source").agg(F.count("*").alias("n"))
    run = F.struct("device", "source", F.lit("ok").alias("status"), F.concat(F.lit("time="), F.col("n").cast("string")).alias("message"))
    runs = counted.groupBy("device").agg(F.sort_array(F.collect_list(run)).alias("runs"))
    out = time.withColumnRenamed("x", "time").join(daily.withColumnRenamed("x", "daily"), "device").join(sessions.withColumnRenamed("x", "sessions"), "device").join(runs, "device")
    return out.select(F.to_json(F.struct("device", mode.alias("mode"), iso(collected_at).alias("collectedAt"), "daily", "time", "sessions", "runs")).alias("value"))


def _pushed(spark: SparkSession, d: str) -> DataFrame:
    """The events with a device for each user, whose number it holds whole."""
    number = F.col("user_id").cast("string")
    digits = F.when(F.char_length(number) < 9, F.lpad(number, 9, "0")).otherwise(number)
    rows = U.usage(spark, d).withColumns({"device": F.concat(F.lit("user-"), digits), "cost": F.col("cost").cast("decimal(38,12)")})
    return checkpointed(rows.select("device", "source", "event_key", "event_time", "usage_date", "model", "project_path", "session_id", "user_id", "event_id", *S.COUNTERS, "total_tokens", "cost"))


def _user():
    return F.regexp_extract("device", "[0-9]+", 0).cast("long")


def _label(device: str):
    """A device as it is shown: of a long number the first nine digits, which several devices may share."""
    return F.substring(device, 1, len("user-") + 9).alias(device)


def _at(day: int):
    """Every device collects at its own millisecond, so that payloads have one order."""
    return F.timestamp_millis(F.unix_timestamp(F.lit(f"2024-02-0{day} 00:00:00")) * 1000 + _user())


_PUSHED_SQL = ", pushed AS (SELECT 'user-' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS dev, u.* FROM usage u)"


@query(
    "S14_read_push_payload",
    f"{_PUSHED_SQL} SELECT 'time' AS name, dev AS from_device, CASE WHEN user_id % 3 = 0 THEN 'full' ELSE 'incremental' END AS mode, count(*) AS n, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(input_tokens + 2 * output_tokens + 3 * cache_creation_tokens + 4 * cache_read_tokens + 5 * reasoning_output_tokens) AS BIGINT) AS counters FROM pushed GROUP BY ALL "
    "UNION ALL SELECT 'daily', dev, CASE WHEN user_id % 3 = 0 THEN 'full' ELSE 'incremental' END, count(DISTINCT (source, usage_date, model)), CAST(sum(total_tokens) AS BIGINT), CAST(sum(input_tokens + 2 * output_tokens + 3 * cache_creation_tokens + 4 * cache_read_tokens + 5 * reasoning_output_tokens) AS BIGINT) FROM pushed GROUP BY ALL "
    "UNION ALL SELECT 'sessions', dev, CASE WHEN user_id % 3 = 0 THEN 'full' ELSE 'incremental' END, count(DISTINCT (source, session_id)), CAST(sum(total_tokens) AS BIGINT), CAST(sum(input_tokens + 2 * output_tokens + 3 * cache_creation_tokens + 4 * cache_read_tokens + 5 * reasoning_output_tokens) AS BIGINT) FROM pushed GROUP BY ALL "
    "UNION ALL SELECT 'runs', dev, CASE WHEN user_id % 3 = 0 THEN 'full' ELSE 'incremental' END, count(DISTINCT source), NULL, NULL FROM pushed GROUP BY ALL",
)
def read_push(spark, d):
    rows = _pushed(spark, d)
    sent = push_payloads(rows, F.when(_user() % 3 == 0, "anything").otherwise("incremental"), _at(1))
    broken = rows.limit(1).select(F.lit('{"device": "broken", "time": [').alias("value"))
    counters = sum((i + 1) * F.col(c) for i, c in enumerate(("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "reasoning_output_tokens")))
    out = []
    for name, table in readers.read_push_payload(sent.unionByName(broken)).items():
        sums = [F.lit(None).cast("long")] * 2 if name == "runs" else [F.sum("total_tokens"), F.sum(counters)]
        out.append(table.groupBy(_label("from_device"), "mode").agg(F.count("*").alias("n"), sums[0].alias("total_tokens"), sums[1].alias("counters")).withColumn("name", F.lit(name)))
    return readers.union_sources(out)


_FULL = "user_id % 3 = 0"
_LATE_PAIR = "EXISTS (SELECT 1 FROM pushed l WHERE l.dev = p.dev AND l.source = p.source AND l.usage_date > DATE '2024-01-10')"


@query(
    "T07_stream_ingest_payloads",
    f"{_PUSHED_SQL}, runs AS (SELECT DISTINCT user_id, dev, source, 2 AS wave FROM pushed WHERE {_FULL} AND usage_date > DATE '2024-01-10' UNION ALL SELECT DISTINCT user_id, dev, source, 2 FROM pushed WHERE NOT {_FULL} UNION ALL SELECT DISTINCT user_id, dev, source, 1 FROM pushed WHERE usage_date <= DATE '2024-01-15' UNION ALL SELECT DISTINCT user_id, dev, source, 3 FROM pushed WHERE NOT {_FULL}), "
    "kept AS (SELECT * FROM runs ORDER BY wave DESC, user_id DESC, source DESC LIMIT 500) "
    f"SELECT 'time' AS name, dev AS device, source, event_key AS key, total_tokens, {dbl('cost')} AS cost_usd, CAST(NULL AS BOOLEAN) AS locked FROM pushed p WHERE CASE WHEN NOT {_FULL} THEN true WHEN {_LATE_PAIR} THEN usage_date > DATE '2024-01-10' ELSE true END "
    f"UNION ALL SELECT 'daily', dev, source, CAST(usage_date AS VARCHAR) || ' ' || model, CAST(sum(total_tokens) AS BIGINT), {dbl('sum(cost) + CASE WHEN usage_date <= DATE ' + chr(39) + '2024-01-15' + chr(39) + ' THEN count(*) ELSE 0 END')}, usage_date < DATE '2024-01-20' FROM pushed GROUP BY user_id, dev, source, usage_date, model "
    f"UNION ALL SELECT 'sessions', dev, source, session_id, CAST(sum(total_tokens) AS BIGINT), {dbl('sum(cost) + CASE WHEN ' + _FULL + ' AND min(usage_date) <= DATE ' + chr(39) + '2024-01-10' + chr(39) + ' THEN count(*) ELSE 0 END')}, NULL FROM pushed GROUP BY user_id, dev, source, session_id "
    "UNION ALL SELECT 'runs', dev, source, 'batch ' || CAST(wave AS VARCHAR), NULL, NULL, NULL FROM kept",
)
def stream_payloads(spark, d):
    """Device pushes in three batches, two of them with full and incremental payloads for one and the same table.

    First every device sends what it has up to the 15th, each event a dollar too dear. Then every third device sends a full
    payload of the days after the 10th, the others all they have; then those others send the same again. The events of a full
    payload's sources from before the 11th are gone, daily rows keep the cost that the first batch locked.
    """
    rows, root = _pushed(spark, d), scratch(spark, "ingested")
    full = _user() % 3 == 0
    dear = rows.where("usage_date <= DATE '2024-01-15'").withColumn("cost", (F.col("cost").cast("decimal(36,12)") + 1).cast("decimal(38,12)"))
    one = push_payloads(dear, F.lit("incremental"), _at(1))
    two = push_payloads(rows.where(~full | (F.col("usage_date") > "2024-01-10")), F.when(full, "full").otherwise("incremental"), _at(2))
    three = push_payloads(rows.where(~full), F.lit("incremental"), _at(3))
    ingest = facts.ingest_payloads(spark, root, TODAY, _now())
    in_turn([one, two, three], "payloads", lambda path: jobs.stream_text_lines(spark, path, **WHOLE).writeStream.foreachBatch(ingest), text=True)
    usd, null = P.as_double(F.col("cost")).alias("cost_usd"), F.lit(None).cast("boolean").alias("locked")
    time = facts.stored(spark, root, "time").select(F.lit("time").alias("name"), _label("device"), "source", F.col("event_key").alias("key"), "total_tokens", usd, null)
    daily = facts.stored(spark, root, "daily").select(F.lit("daily").alias("name"), _label("device"), "source", F.concat_ws(" ", F.col("usage_date").cast("string"), "model").alias("key"), "total_tokens", usd, F.col("pricing_locked_at").isNotNull().alias("locked"))
    sessions = facts.stored(spark, root, "sessions").select(F.lit("sessions").alias("name"), _label("device"), "source", F.col("session_id").alias("key"), "total_tokens", usd, null)
    wave = F.concat(F.lit("batch "), (F.col("batch_no") + 1).cast("string"))
    runs = facts.stored(spark, root, "runs").select(F.lit("runs").alias("name"), _label("device"), "source", wave.alias("key"), F.lit(None).cast("long").alias("total_tokens"), F.lit(None).cast("double").alias("cost_usd"), null)
    return time.unionByName(daily).unionByName(sessions).unionByName(runs)


@query("T08_stream_trigger", "SELECT device, source, event_key FROM usage")
def stream_trigger(spark, d):
    """Batches at a fixed pace, none before the one ahead of it ends, until all that has landed is in."""
    rows, path, out = _events(spark, d), scratch(spark, "paced"), scratch(spark, "paced-out")
    rows.write.mode("overwrite").parquet(path)
    writer = jobs.stream_log_lines(spark, path, rows.schema, files_per_batch=2).select("device", "source", "event_key").writeStream.format("parquet").option("path", out)
    jobs.run_scheduled(writer, scratch(spark, "paced-mark"), every=0.5, least=0.1)
    return spark.read.parquet(out)


#: The batch in which an event lands: most by ten days, some a day or two late, some a week.
_LANDS = "CASE WHEN usage_date <= DATE '2024-01-10' THEN 0 WHEN usage_date <= DATE '2024-01-20' THEN 1 ELSE 2 END"
_LATE = "(usage_date <= DATE '2024-01-10' AND event_id % 11 = 0)"


@query(
    "T09_late_data_policy",
    f", landed AS (SELECT *, CASE WHEN {_LATE} THEN 1 ELSE {_LANDS} END AS wave FROM usage), marks AS (SELECT device, source, max(event_time) - INTERVAL 48 HOUR AS cutoff FROM landed WHERE wave = 0 GROUP BY 1, 2) "
    f"SELECT l.event_key, CASE WHEN {_LATE} AND event_time <= cutoff THEN 'late' ELSE 'merged' END AS outcome, true AS there_after_repair FROM landed l LEFT JOIN marks m ON m.device = l.device AND m.source = l.source",
)
def late_data(spark, d):
    """Some events of the first ten days land a batch late: those within the overlap are merged, others go to their own table until the repair."""
    rows = checkpointed(U.named(spark, d).select("device", "source", "event_key", "event_time", "usage_date", "event_id", "total_tokens"))
    root = scratch(spark, "late-facts")
    wave = rows.withColumn("wave", F.expr(f"CASE WHEN {_LATE} THEN 1 ELSE {_LANDS} END"))
    cutoffs = lambda marks: marks.select("device", "source", (F.col("watermark") - F.lit(timedelta(hours=48))).alias("cutoff"))
    split = facts.split_late(spark, root, cutoffs)
    in_turn([wave.where(f"wave = {i}").drop("wave") for i in range(3)], "late", lambda path: jobs.stream_log_lines(spark, path, rows.schema, **WHOLE).writeStream.foreachBatch(split))
    merged = checkpointed(facts.stored(spark, root, "time").select("event_key", F.lit("merged").alias("outcome")))
    late = checkpointed(facts.stored(spark, root, "late").select("event_key", F.lit("late").alias("outcome")))
    facts.repair_late(spark, root, 3, rows)
    after = facts.stored(spark, root, "time").select("event_key", F.lit(True).alias("there_after_repair"))
    left = facts.stored(spark, root, "late").count()
    return merged.unionByName(late).join(after, "event_key", "full_outer").select("event_key", "outcome", (F.coalesce("there_after_repair", F.lit(False)) & F.lit(left == 0)).alias("there_after_repair"))


@query(
    "T10_stream_run_log",
    f", registered AS (SELECT DISTINCT device, source FROM usage UNION SELECT DISTINCT device, 'idle' FROM usage), landed AS (SELECT device, source, {WAVE} AS wave, count(*) AS n, count(DISTINCT usage_date) AS days FROM usage GROUP BY 1, 2, 3) "
    "SELECT t.wave AS batch, r.device, r.source, CASE WHEN n > 0 THEN 'ok' ELSE 'empty' END AS status, CAST(coalesce(n, 0) AS VARCHAR) || ' events, ' || CAST(coalesce(days, 0) AS VARCHAR) || ' days' AS message FROM registered r CROSS JOIN (VALUES (0), (1), (2)) AS t(wave) LEFT JOIN landed l ON l.device = r.device AND l.source = r.source AND l.wave = t.wave "
    "UNION ALL SELECT 1, device, source, 'error', 'the store is away' FROM registered",
)
def stream_run_log(spark, d):
    """Three batches over all registered sources, one of which never has events; the second batch fails at first."""
    rows = _events(spark, d)
    waves, out, failures = _waves(rows), scratch(spark, "runs-out"), []
    sources = checkpointed(rows.select("device", "source").distinct())
    sources = sources.unionByName(sources.select("device", F.lit("idle").alias("source")).distinct())

    def work(batch: DataFrame, number: int) -> None:
        if number == 1 and not failures:
            failures.append(number)
            raise ValueError("the store is away")

    path, mark = scratch(spark, "runs-landing"), scratch(spark, "runs-mark")
    for wave in waves:
        wave.write.mode("append").parquet(path)
        start = lambda: jobs.run_available(jobs.stream_run_log(jobs.stream_log_lines(spark, path, rows.schema, **WHOLE), out, sources, work), mark)
        try:
            start()
        except StreamingQueryException:
            start()
    return spark.read.parquet(out).select(F.col("batch").cast("int").alias("batch"), "device", "source", "status", "message")
