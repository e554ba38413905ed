"""Continuous collection with Structured Streaming: closed segments land in a folder, facts are merged batch by batch."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter
from pyspark.sql.streaming.state import GroupStateTimeout

from tallyspark.operators import counters
from tallyspark.operators import merge as M
from tallyspark.operators.stages import checkpointed
from tallyspark.sources.readers import line_in_task

OVERLAP = "48 hours"
EVERY_SECONDS, LEAST_SECONDS = 300.0, 10.0  # between batches; no less than the least


def _file_stream(spark: SparkSession, files_per_batch: int | None) -> DataStreamReader:
    return spark.readStream if files_per_batch is None else spark.readStream.option("maxFilesPerTrigger", files_per_batch)


def stream_log_lines(spark: SparkSession, folder: str, schema, files_per_batch: int | None = 1000) -> DataFrame:
    """Landed segments; each file is seen once, so segments have to be closed and never grow. files_per_batch None: a batch takes all that has landed."""
    return _file_stream(spark, files_per_batch).schema(schema).parquet(folder)


def stream_text_lines(spark: SparkSession, folder: str, files_per_batch: int | None = 1000, glob: str = "*") -> DataFrame:
    """Lines of landed text segments: value, file_path, modified, and block, the byte at which the line's block begins."""
    lines = _file_stream(spark, files_per_batch).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(folder)
    meta = {"file_path": "file_path", "modified": "file_modification_time", "block": "file_block_start"}
    return lines.select(F.trim("value").alias("value"), *(F.col(f"_metadata.{v}").alias(k) for k, v in meta.items())).where("value <> ''")


def placed(batch: DataFrame) -> DataFrame:
    """A micro-batch of stream_text_lines with line_no, which grows along each file. Within foreachBatch, before any shuffle."""
    return batch.withColumn("line_no", F.col("block") + line_in_task()).drop("block")


def stream_dedupe_events(events: DataFrame) -> DataFrame:
    """The first copy of each event key; copies later than the overlap are new again. Where a later copy may correct an earlier one, merge instead."""
    return events.withWatermark("event_time", OVERLAP).dropDuplicatesWithinWatermark(["device", "source", "event_key"])


def stream_hourly_usage(events: DataFrame) -> DataFrame:
    w = F.window("event_time", "1 hour")
    return events.withWatermark("event_time", OVERLAP).groupBy(w, "device", "source", "model").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("total_tokens")).select(F.col("window.start").alias("hour_start"), "device", "source", "model", "calls", "total_tokens")


def stream_daily_usage(events: DataFrame, offset: str = "0 hours") -> DataFrame:
    """Days of a zone with a fixed offset; zones with changing offsets roll up the hours."""
    w = F.window("event_time", "1 day", "1 day", offset)
    return events.withWatermark("event_time", OVERLAP).groupBy(w, "device", "source", "model").agg(F.sum("total_tokens").alias("total_tokens")).select(F.to_date("window.start").alias("usage_date"), "device", "source", "model", "total_tokens")


def daily_of_hours(hours: DataFrame, zone: str) -> DataFrame:
    """Hourly usage (hour_start in UTC) as days of a zone, whose offset may change: such a day has 23 or 25 hours."""
    day = F.to_date(F.from_utc_timestamp("hour_start", zone)).alias("usage_date")
    return hours.groupBy(day, "device", "source", "model").agg(F.sum("calls").alias("calls"), F.sum("total_tokens").alias("total_tokens"))


def merge_into_versions(read: Callable[[int], DataFrame | None], root: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: merges a batch into the version before it. A repeated batch writes the same version again."""

    def run(batch: DataFrame, number: int) -> None:
        merged = merge(read(number - 1), batch)
        merged.write.mode("overwrite").parquet(f"{root}/v={number}")

    return run


def version_reader(spark: SparkSession, root: str) -> Callable[[int], DataFrame | None]:
    return lambda number: spark.read.parquet(f"{root}/v={number}") if number >= 0 else None


def merge_into_days(spark: SparkSession, root: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: merges a batch into facts that are stored by day, and rewrites the batch's days only.

    The merged days are checkpointed first, as the files that they are read from are the ones that are replaced. A batch that
    comes again after a failure merges to the same rows, so it also mends days that were replaced in part. Facts of one key
    keep their day.
    """

    def run(batch: DataFrame, number: int) -> None:
        stored = stored_days(spark, root, batch)
        days = F.broadcast(batch.select("usage_date").distinct())  # a calendar's days at most
        merged = checkpointed(merge(stored.join(days, "usage_date", "left_semi"), batch))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("usage_date").parquet(root)

    return run


def stored_days(spark: SparkSession, root: str, like: DataFrame | None = None) -> DataFrame:
    """The facts stored by day; before the first batch an empty table like the batch."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    if like is not None and not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return like.limit(0)
    return spark.read.parquet(root).withColumn("usage_date", F.col("usage_date").cast("date"))


def stream_merge_daily(spark: SparkSession, daily: DataFrame, root: str, today: date, now) -> DataStreamWriter:
    """Daily rows merged with price locks."""

    def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
        if "pricing_locked_at" not in stored.columns:
            stored = stored.withColumn("pricing_locked_at", F.lit(None).cast("timestamp"))
        return M.merge_daily_price_locked(stored, batch, today, now)

    return daily.writeStream.foreachBatch(merge_into_days(spark, root, merge))


def stream_merge_events(spark: SparkSession, events: DataFrame, root: str, full: bool = False) -> DataStreamWriter:
    """Events (with usage_date) upserted by key into their days; with `full` a batch replaces all of its devices and sources.

    Late events beyond the overlap need `full`, which may empty days and therefore writes whole versions.
    """
    if full:
        return events.writeStream.foreachBatch(merge_into_versions(version_reader(spark, root), root, lambda t, b: b if t is None else M.replace_sources(t, b)))
    return events.writeStream.foreachBatch(merge_into_days(spark, root, M.merge_events))


def newest_version(spark: SparkSession, root: str) -> DataFrame:
    """What the last batch left: the folder with the highest number that was written to its end."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{root}/v={max(int(n.partition('=')[2]) for n in names)}")


def pace(every: float = EVERY_SECONDS, least: float = LEAST_SECONDS) -> str:
    """The trigger's interval: what is asked for, but not below the least."""
    return f"{round(max(every, least) * 1000)} milliseconds"


def run_scheduled(writer: DataStreamWriter, checkpoint: str, every: float = EVERY_SECONDS, least: float = LEAST_SECONDS) -> None:
    """Batches every so many seconds; Spark starts none while one runs. Returns when all that has landed so far is in."""
    query = writer.option("checkpointLocation", checkpoint).trigger(processingTime=pace(every, least)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """All that has landed, then stop; the scheduled form is run_scheduled."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


COUNTER_STATE = "base array<bigint>, leading boolean, second string, due int, held array<string>"


def stream_counter_increments(lines: DataFrame, late: str = "1 hour", keep: timedelta = timedelta(days=7)) -> DataFrame:
    """Counter increments across micro-batches, with the baseline of each session as state.

    lines: those of counter_increments with `segment`, the number of the session's segment that a line is from, and `landed`,
    when it came. A segment that comes before its turn is held back until those ahead of it came, more of one that
    was folded already is folded at once. A session that nothing came
    for in `keep` ends: what was held back is folded as it is, and its state goes.
    """
    names = [c.split()[0] for c in counters.OUT.split(", ")]

    def unpacked(held: list[str]) -> dict[int, list]:
        return {number: rows for number, rows in map(json.loads, held)}

    def run(key, frames, state):
        base, leading, second, due, held = state.get if state.exists else (None, True, None, 0, [])
        now: counters.State = (None if base is None else tuple(base), leading, second)
        waiting, newest, out = unpacked(held), 0, []
        if not state.hasTimedOut:
            for frame in frames:
                newest = max(newest, int(frame["landed"].max().timestamp() * 1000))
                four = lambda x: None if x is None else [int(x[p]) for p in counters.PARTS]
                columns = [frame[c].tolist() for c in ("segment", "line_no", "ts", "model", "replay")]
                for number, *line, last, total in zip(*columns, map(four, frame["last"]), map(four, frame["total"]), strict=True):
                    waiting.setdefault(number, []).append([*line, last, total])
        while waiting and (min(waiting) <= due or state.hasTimedOut):
            number = min(waiting)
            for no, ts, model, replay, last, total in sorted(waiting.pop(number), key=lambda r: r[0]):
                use, now = counters.step(now, ts, replay, last and tuple(last), total and tuple(total))
                if use:
                    out.append(counters.row((key[0], no, ts, model), use))
            due = max(due, number + 1)
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((None if now[0] is None else list(now[0]), now[1], now[2], due, [json.dumps(x) for x in waiting.items()]))
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + round(keep.total_seconds() * 1000) + 1)
        yield pd.DataFrame(out, columns=names)

    timed = lines.withWatermark("landed", late)
    return timed.groupBy("file_path").applyInPandasWithState(run, counters.OUT, COUNTER_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def stream_run_log(events: DataFrame, out: str, sources: DataFrame, work: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
    """A run row for each registered device and source and batch, after `work` took the batch: ok, empty, or error.

    A batch that fails leaves its error rows, and the failure ends the query; when it comes again its good rows stand beside them.
    """

    def run(batch: DataFrame, number: int) -> None:
        log = lambda kind, error=None: M.run_log(batch, F.lit(number), F.current_timestamp(), sources, error).write.mode("overwrite").parquet(f"{out}/batch={number}/try={kind}")
        try:
            if work:
                work(batch, number)
        except Exception as error:
            log("failed", str(error).split("\n")[0][:500])
            raise
        log("done")

    return events.writeStream.foreachBatch(run)
