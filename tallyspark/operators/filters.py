"""Filters as predicates that reach the scan, and small presentations of session and run rows."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _member(column: str, values: list | None) -> Column:
    return F.col(column).isin(*values) if values else F.lit(True)


def filter_daily(rows: DataFrame, start: date, end: date, sources: list | None = None, devices: list | None = None, models: list | None = None) -> DataFrame:
    """Inclusive days and members of the sets; no set means all."""
    return rows.where(F.col("usage_date").between(F.lit(start), F.lit(end)) & _member("source", sources) & _member("device", devices) & _member("model", models))


def filter_time(rows: DataFrame, start: datetime, end: datetime, sources: list | None = None, devices: list | None = None, minute_precision: bool = True) -> DataFrame:
    """Instants between two minutes, both included: the last minute counts only at its first instant. Without minute_precision half open."""
    last = F.col("event_time") <= F.lit(end) if minute_precision else F.col("event_time") < F.lit(end)
    return rows.where((F.col("event_time") >= F.lit(start)) & last & _member("source", sources) & _member("device", devices))


def filter_period(rows: DataFrame, start: date, end: date) -> DataFrame:
    return rows.where(F.col("usage_date").between(F.lit(start), F.lit(end)))


def filter_members(rows: DataFrame, sources: list | None = None, devices: list | None = None) -> DataFrame:
    """Sessions and runs are filtered by source and device, never by date or model."""
    return rows.where(_member("source", sources) & _member("device", devices))


def search_any_column(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    joined = F.lower(F.concat_ws("\u0001", *(F.col(c).cast("string") for c in columns)))
    return rows.where(joined.contains(text.strip().lower()))


def drill_filter(daily: DataFrame, kind: str, source: str | None = None, device: str | None = None, model: str | None = None) -> DataFrame:
    """source: source and device; model: source and model; session: source; run: no rows are dropped."""
    keep = {"source": {"source": source, "device": device}, "model": {"source": source, "model": model}, "session": {"source": source}, "run": {}}[kind]
    for c, v in keep.items():
        if v is not None:
            daily = daily.where(F.col(c) == v)
    return daily


def valid_hours(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("usage_date").isNotNull() & F.col("hour").between(0, 23))


def unpriced_rows(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("total_tokens") > 0) & (F.col("cost") == 0))


def filter_options(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull() & (F.trim(column) != "")).select(column).distinct()


def date_range(rows: DataFrame) -> DataFrame:
    return rows.agg(F.min("usage_date").alias("first_day"), F.max("usage_date").alias("last_day"))


def present_runs(runs: DataFrame, most: int = 30) -> DataFrame:
    """One-line messages; device names without .local, cut with an ellipsis."""
    device = F.regexp_replace("device", r"\.local$", "")
    device = F.when(F.char_length(device) > most, F.concat(F.substring(device, 1, most), F.lit("…"))).otherwise(device)
    return runs.withColumn("message", F.trim(F.regexp_replace(F.coalesce("message", F.lit("")), r"\s+", " "))).withColumn("device", device)


def present_sessions(sessions: DataFrame) -> DataFrame:
    """Activity as a date; without a project the last part of the session id."""
    known = F.when((F.col("project_path") != "") & (F.col("project_path") != "Unknown Project"), F.col("project_path"))
    return sessions.withColumn("last_activity", F.to_date("last_activity")).withColumn("project_path", F.coalesce(known, F.element_at(F.split("session_id", "/"), -1)))
