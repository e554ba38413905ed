"""Normalisation, de-duplication and incremental filters of usage events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators.counters import counter_increments as counter_increments

def collapse_snapshots_max(rows: DataFrame, scope: str = "file_path") -> DataFrame:
    """Lines of one message in a scope become one: largest counters and cost, first time, first known model.

    rows: scope column, line_no, message_id, request_id, event_time, model, counters, recorded_cost. Lines without id stay.
    """
    ident = F.when(F.col("message_id").isNull(), F.concat(F.lit("row:"), F.col("line_no").cast("string"))).otherwise(F.concat_ws(":", F.coalesce(F.when(F.col("request_id").isNull(), F.lit("message"))), "message_id", "request_id"))
    kept = [F.max(c).alias(c) for c in (*S.COUNTERS, "recorded_cost")]
    first_time = F.min_by("event_time", F.when(F.col("event_time").isNotNull(), F.col("line_no"))).alias("event_time")
    first_model = F.min_by("model", F.struct(F.col("model") == "unknown", "line_no")).alias("model")
    return rows.groupBy(scope, ident.alias("message_key")).agg(*kept, first_time, first_model, F.min("line_no").alias("line_no"))


def keep_last_version(rows: DataFrame, scope: str, ident: str, order: str) -> DataFrame:
    """The last row of each id in a scope; rows without an id stay."""
    place = F.row_number().over(Window.partitionBy(scope, ident).orderBy(F.desc(order)))
    return rows.withColumn("_p", F.when(F.col(ident).isNull(), 1).otherwise(place)).where("_p = 1").drop("_p")


def dedupe_events_global(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with the same time, model and counters the first by file and line; rows without a time stay."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    timed = rows.where("event_time IS NOT NULL").withColumn("_p", place).where("_p = 1").drop("_p")
    return timed.unionByName(rows.where("event_time IS NULL"))


def dedupe_fingerprint_merge(rows: DataFrame, fingerprint: list[str], order: str, workspace: str) -> DataFrame:
    """Rows equal on the fingerprint merge; the workspace stays only if all that have one agree."""
    one = F.when(F.count_distinct(workspace) == 1, F.max(workspace)).alias(workspace)
    return rows.groupBy(*fingerprint).agg(F.min_by("event_key", order).alias("event_key"), F.min(order).alias(order), one)


def dedupe_cross_store(rows: DataFrame, ident: Column, store_rank: str, order: str) -> DataFrame:
    """The first copy by store, then order, of each message id (or fingerprint where there is none)."""
    place = F.row_number().over(Window.partitionBy("_ident").orderBy(store_rank, order))
    return rows.withColumn("_ident", ident).withColumn("_p", place).where("_p = 1").drop("_p", "_ident")


def occurrence_suffix_keys(rows: DataFrame, order: list[str]) -> DataFrame:
    """Repeated event keys get #1, #2, ... in source order; the first stays as it is."""
    n = F.row_number().over(Window.partitionBy("device", "source", "event_key").orderBy(*order))
    return rows.withColumn("_n", n).withColumn("event_key", F.when(F.col("_n") > 1, F.concat("event_key", F.lit("#"), (F.col("_n") - 1).cast("string"))).otherwise(F.col("event_key"))).drop("_n")


def normalise_event_rows(rows: DataFrame, counter_log: Column) -> DataFrame:
    """Clamped counters, total, default event key; rows without time, date or tokens go."""
    out = rows.withColumns({c: S.positive_int(c) for c in S.COUNTERS}).withColumn("total_tokens", S.token_total(counter_log))
    default = S.row_id("source", "event_time", "session_id", "model", "total_tokens")
    out = out.withColumn("event_key", F.coalesce("event_key", default)).withColumn("project_path", F.coalesce("project_path", F.lit("")))
    return out.where("event_time IS NOT NULL AND usage_date IS NOT NULL AND total_tokens > 0")


def normalise_daily_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("model", F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown"))).withColumns({c: S.positive_int(c) for c in S.COUNTERS})


def normalise_session_rows(rows: DataFrame, run_time: Column) -> DataFrame:
    """Sessions of workspace and model: local:<source>:<workspace or no-workspace>:<model>; the activity is the run's time."""
    ident = F.concat_ws(":", F.lit("local"), "source", F.coalesce(F.nullif("project_path", F.lit("")), F.lit("no-workspace")), "model")
    return rows.withColumn("session_id", ident).withColumn("last_activity", run_time)


def recent_events(rows: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return rows.where(F.col("event_time") >= now - F.expr(f"INTERVAL {days} DAYS"))


def source_watermark(rows: DataFrame) -> DataFrame:
    return rows.groupBy("device", "source").agg(F.max("event_time").alias("watermark"))


def watermark_cutoff(watermark: Column, overlap: timedelta = timedelta(hours=48)) -> Column:
    return watermark - F.lit(overlap)


def filter_new_events(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Events after their source's cutoff; a source without one keeps all. cutoffs: a row for each device and source."""
    return rows.join(cutoffs, ["device", "source"], "left").where("cutoff IS NULL OR event_time > cutoff").drop("cutoff")


def filter_new_days(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    return rows.join(cutoffs, ["device", "source"], "left").where("cutoff IS NULL OR usage_date >= CAST(cutoff AS DATE)").drop("cutoff")


def needs_rebuild(batch: DataFrame, watermarks: DataFrame, full: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """For each device and source whether it takes the full path: by the flag, without a watermark, or without any events.

    sources: every device and source that is collected; those that are not in the batch have no events. Without it, those of the batch.
    """
    seen = batch.groupBy("device", "source").agg(F.count("event_time").alias("events"))
    if sources is not None:
        seen = sources.select("device", "source").distinct().join(seen, ["device", "source"], "left")
    whole = F.col("watermark").isNull() | (F.coalesce("events", F.lit(0)) == 0) | F.lit(full)
    return seen.join(watermarks, ["device", "source"], "left").select("device", "source", whole.alias("full"))
