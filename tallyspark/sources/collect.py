"""Collection driven by a registry: every source is read, normalised, priced by its own policy and rolled up to daily facts.

A source that fails or has nothing leaves a run row that says so, and the others go on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import counters
from tallyspark.operators import normalize as D
from tallyspark.operators import pricing as P
from tallyspark.operators import rollup as R
from tallyspark.sources import readers

#: Columns of a usage event as every source gives it.
EVENT = "session_id string, event_key string, event_time timestamp, model string, provider string, project_path string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, reasoning_output_tokens long, recorded_cost double"
RUN = "device string, source string, status string, message string, events long, collected_at timestamp"


def _stem(path: str = "file_path") -> Column:
    return F.regexp_replace(F.url_decode(F.element_at(F.split(path, "/"), -1)), r"(?<=.)\.[^.]*$", "")


def assistant_events(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    """Snapshots of a message count once, at their largest."""
    return D.collapse_snapshots_max(readers.read_assistant_usage(spark, roots, glob)).withColumns({"event_key": F.col("message_key"), "session_id": _stem()})


def counter_events(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    """Increments of the sessions' counters; what a copied file repeats of another counts once."""
    rows = counters.counter_increments(readers.read_counter_log(spark, roots, glob)).withColumns({"session_id": _stem(), "event_time": S.event_instant("ts")})
    return D.dedupe_events_global(rows, ["event_time", "model", *S.COUNTERS], ["file_path", "line_no"])


def store_events(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    """Landed tables `messages` and `sessions` of a store."""
    return readers.union_sources([readers.read_message_store(spark.read.parquet(f"{r}/messages"), spark.read.parquet(f"{r}/sessions")) for r in roots])


def summary_events(spark: SparkSession, roots: list[str], glob: str) -> DataFrame:
    return readers.read_session_summary(spark.read.parquet(*roots)).withColumn("event_key", F.col("session_id"))


@dataclass(frozen=True)
class Source:
    """A reader with its label, its files, which of computed and recorded cost counts, whether a day costs the flat price of its tokens, and whether output holds reasoning."""

    read: Callable[[SparkSession, list[str], str], DataFrame]
    glob: str = "*"
    policy: str = "computed-only"
    flat: bool = False
    counter_log: bool = False


REGISTRY: dict[str, Source] = {
    "assistant": Source(assistant_events, "*.jsonl", "computed-first"),
    "counter": Source(counter_events, "*.jsonl", flat=True, counter_log=True),
    "message_store": Source(store_events, policy="recorded-first"),
    "message_json": Source(readers.read_message_json, "*.json", "recorded-first"),
    "session_document": Source(readers.read_session_document, "*.json", flat=True),
    "stats_document": Source(readers.read_stats_files, "*.json", flat=True),
    "turn_stream": Source(readers.read_turn_stream, "*.jsonl", flat=True),
    "agent": Source(readers.read_agent_transcript, "*.jsonl*", "computed-first"),
    "session_summary": Source(summary_events, policy="recorded-first"),
}


@dataclass(frozen=True)
class Task:
    """One source of one device: where its files lie. glob: in place of the source's own."""

    source: str
    device: str
    roots: list[str]
    glob: str | None = None


def events_of(spark: SparkSession, task: Task, zone: str) -> DataFrame:
    """A source's events with every column of EVENT, device, source, the day in the display zone, and the total."""
    kind = REGISTRY[task.source]
    rows = kind.read(spark, task.roots, task.glob or kind.glob)
    have = set(rows.columns)
    columns = [(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in EVENT.split(", "))]
    rows = rows.select(F.lit(task.device).alias("device"), F.lit(task.source).alias("source"), *columns)
    rows = rows.withColumn("usage_date", F.to_date(F.from_utc_timestamp("event_time", zone)))
    return D.normalise_event_rows(rows.withColumn("model", S.normalise_model("model")), F.lit(kind.counter_log))


def collect(spark: SparkSession, tasks: list[Task], root: str, now: datetime, zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Events of all sources, written below root, and a run row for each: ok or empty with the events it counted on the way, or error with the message."""
    written, runs = [], []
    for task in tasks:
        counted, path = Observation(f"{task.source}-{uuid.uuid4().hex}"), f"{root}/source={task.source}/device={task.device}"
        try:
            rows = events_of(spark, task, zone).observe(counted, F.count("*").alias("n"))
            rows.drop("device", "source").write.mode("overwrite").parquet(path)
        except (PySparkException, ValueError, KeyError) as error:
            runs.append((task.device, task.source, "error", str(error).split("\n")[0][:500], 0, now))
            continue
        n = counted.get["n"]
        runs.append((task.device, task.source, "ok" if n else "empty", f"time={n}", n, now))
        if n:
            written.append((task, path))
    frames = [spark.read.parquet(path).withColumns({"device": F.lit(task.device), "source": F.lit(task.source)}) for task, path in written]
    events = readers.union_sources(frames) if frames else spark.createDataFrame([], f"{EVENT}, usage_date date, total_tokens long, device string, source string")
    return events, spark.createDataFrame(runs, RUN)


def daily_facts(events: DataFrame, dim: DataFrame) -> DataFrame:
    """Daily facts of collected events: each source at its grain and by its policy."""
    prices = P.price_table(P.resolve_prices(events.select("model", F.explode(F.array("provider", F.lit(None).cast("string"))).alias("provider")).distinct(), P.read_price_dim(dim)))
    flat = F.col("source").isin([n for n, s in REGISTRY.items() if s.flat])
    recorded = F.greatest(F.coalesce("recorded_cost", F.lit(0.0)), F.lit(0.0)).cast(P.MONEY)
    of = lambda policy: F.col("source").isin([n for n, s in REGISTRY.items() if s.policy == policy])
    # effective_cost of every policy in one expression
    cost = F.coalesce(F.when(of("recorded-first") & (recorded > 0), recorded), F.when((F.col("computed") > 0) | of("computed-only"), F.col("computed")), recorded)
    priced = P.join_prices(events.where(~flat), prices).withColumn("computed", P.cost())
    by_event = R.rollup_daily(priced.withColumn("cost", cost.cast(P.MONEY))).drop("project_path")
    return by_event.unionByName(R.rollup_flat_repriced(events.where(flat), prices))
