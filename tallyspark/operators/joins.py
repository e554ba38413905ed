"""Joins that carry a rule of their own; price, period and spine joins live with their operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_message_session(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages with their session's directory; a blank directory is none."""
    s = sessions.select(F.col("id").alias("session_id"), F.nullif("directory", F.lit("")).alias("directory"))
    return messages.join(s, "session_id", "left")


def enrich_dominant_project(daily: DataFrame, sessions: DataFrame) -> DataFrame:
    """Daily rows with the project of the largest single session of their device and source; the first by name among equals."""
    some = sessions.where("total_tokens > 0")
    best = some.groupBy("device", "source").agg(F.max("total_tokens").alias("most"))
    top = some.join(best, ["device", "source"]).where("total_tokens = most").groupBy("device", "source").agg(F.min("project_path").alias("dominant_project"))
    return daily.join(top, ["device", "source"], "left")


def join_daily_event_sums(daily: DataFrame, event_sums: DataFrame) -> DataFrame:
    return daily.join(event_sums, ["device", "source", "usage_date", "model"], "left")


def exclude_indexed_files(files: DataFrame, index: DataFrame) -> DataFrame:
    """Listed files that the index doesn't name."""
    return files.join(index.select("path"), "path", "left_anti")
