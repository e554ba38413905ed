"""Roll-ups of usage events to the daily, session and hourly facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import pricing as P

SUMMED = [*S.COUNTERS, "total_tokens"]


def sums(extra: tuple[str, ...] = ("cost",)) -> list:
    return [F.sum(c).alias(c) for c in (*SUMMED, *extra)]


def rollup_daily(usage: DataFrame) -> DataFrame:
    """Counters and cost for each device, source, day and model; the project is the least one's."""
    return usage.groupBy("device", "source", "usage_date", "model").agg(*sums(), F.min("project_path").alias("project_path"))


def rollup_workspace_model(usage: DataFrame) -> DataFrame:
    """Counters and cost for each device, source, workspace and model; the label is the one first seen."""
    order = F.struct("event_time", "event_id")
    return usage.groupBy("device", "source", "project_path", "model").agg(*sums(), F.min_by("session_id", order).alias("first_session"), F.max("event_time").alias("last_activity"))


def rollup_sessions(usage: DataFrame) -> DataFrame:
    return usage.groupBy("device", "source", "session_id").agg(*sums(), F.max("event_time").alias("last_activity"), F.min("project_path").alias("project_path"))


def rollup_flat_repriced(usage: DataFrame, resolved: DataFrame) -> DataFrame:
    """Daily roll-up whose cost is the flat price of the summed tokens of each provider, not the sum of event costs."""
    keys = ["device", "source", "usage_date", "model"]
    days = P.join_prices(usage.groupBy(*keys, "provider").agg(*sums(())), resolved).withColumn("cost", P.cost(tiered=False))
    return days.groupBy(*keys).agg(*sums())


def hourly_cube(usage: DataFrame, zone: str) -> DataFrame:
    """Calls, tokens and cost by device, source, date, local hour and model."""
    return usage.groupBy("device", "source", "usage_date", S.local_hour("event_time", zone).alias("hour"), "model").agg(F.count("*").alias("calls"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost").alias("cost"))


def event_sums_by_day(usage: DataFrame) -> DataFrame:
    return usage.groupBy("device", "source", "usage_date", "model").agg(F.count("*").alias("n"), F.sum("total_tokens").alias("event_tokens"), F.sum("cost").alias("event_cost"))
