"""Merges of new facts into fact tables. Plain files have no MERGE: the merged state is computed and written as a new version."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_KEYS = ["device", "source", "event_key"]
DAILY_KEYS = ["device", "source", "usage_date", "model"]
SESSION_KEYS = ["device", "source", "session_id"]


def merge_replace(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch replace those with the same keys; idempotent."""
    return target.join(batch.select(*keys), keys, "left_anti").unionByName(batch, allowMissingColumns=True)


def merge_events(target: DataFrame, batch: DataFrame) -> DataFrame:
    return merge_replace(target, batch, EVENT_KEYS)


def merge_sessions(target: DataFrame, batch: DataFrame) -> DataFrame:
    return merge_replace(target, batch, SESSION_KEYS)


def merge_daily_price_locked(target: DataFrame, batch: DataFrame, today: date, now: Column) -> DataFrame:
    """Counters are replaced. A past day keeps its cost and its lock (or gets one now); an open day takes the new cost, unlocked.

    A past day that is new is locked at once. target: daily facts with pricing_locked_at; batch: daily facts.
    """
    values = [c for c in batch.columns if c not in DAILY_KEYS]
    new = batch.select(*DAILY_KEYS, F.struct(*values).alias("n"))
    old = target.select(*DAILY_KEYS, F.struct(*values, "pricing_locked_at").alias("o"))
    past = F.col("usage_date") < F.lit(today)
    both = old.join(new, DAILY_KEYS, "full_outer")
    fresh, had = F.col("n").isNotNull(), F.col("o").isNotNull()
    out = {c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in values}
    out["cost"] = F.when(had & (~fresh | past), F.col("o.cost")).otherwise(F.col("n.cost"))
    lock = F.when(~fresh, F.col("o.pricing_locked_at")).when(past, F.coalesce(F.col("o.pricing_locked_at"), now))
    return both.select(*DAILY_KEYS, *(v.alias(c) for c, v in out.items()), lock.alias("pricing_locked_at"))


def replace_sources(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Full rebuild: all rows of the devices and sources in the batch go, then the batch is added."""
    pairs = batch.select("device", "source").distinct()
    return target.join(pairs, ["device", "source"], "left_anti").unionByName(batch, allowMissingColumns=True)


def lock_past_prices(daily: DataFrame, today: date, now: Column) -> DataFrame:
    return daily.withColumn("pricing_locked_at", F.when(F.col("usage_date") < F.lit(today), F.coalesce("pricing_locked_at", now)).otherwise(F.col("pricing_locked_at")))


def run_log(batch: DataFrame, ident: Column, now: Column, sources: DataFrame | None = None, error: str | None = None) -> DataFrame:
    """One status row for each device and source: ok with its counts, empty where the batch has none of its rows, or error with the message.

    sources: every device and source that is collected; without it those of the batch, and none can be empty.
    """
    counts = batch.groupBy("device", "source").agg(F.count("*").alias("n"), F.count_distinct("usage_date").alias("days"))
    if sources is not None:
        counts = sources.select("device", "source").distinct().join(counts, ["device", "source"], "left").fillna(0, ["n", "days"])
    message = F.concat(F.col("n").cast("string"), F.lit(" events, "), F.col("days").cast("string"), F.lit(" days"))
    status = F.when(F.col("n") > 0, "ok").otherwise("empty")
    if error is not None:
        status, message = F.lit("error"), F.lit(error)
    return counts.select(ident.alias("id"), "device", "source", status.alias("status"), message.alias("message"), now.alias("collected_at"))


def append_runs(runs: DataFrame, path: str) -> None:
    """Run rows of one collection, one of each source, added to the log."""
    runs.coalesce(1).write.mode("append").parquet(path)


def retain_newest(runs: DataFrame, n: int = 500, by: str | None = None) -> DataFrame:
    """The newest n rows by id, of all or of each value of `by`."""
    if by is None:
        return runs.orderBy(F.desc("id")).limit(n)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("id")))
    return runs.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def backfill_daily_cost(daily: DataFrame, event_sums: DataFrame, flat: Column) -> DataFrame:
    """Cost for daily rows that have tokens and none: the events' cost where their tokens agree, else the flat price (of any columns of daily)."""
    both = daily.join(event_sums, DAILY_KEYS, "left").withColumn("_flat", flat)
    agree = (F.col("event_tokens") == F.col("total_tokens")) & (F.col("event_cost") > 0)
    found = F.when(agree, F.col("event_cost")).otherwise(F.col("_flat"))
    missing = (F.col("total_tokens") > 0) & (F.col("cost") == 0)
    return both.withColumn("cost", F.when(missing & (found > 0), found).otherwise(F.col("cost"))).select(*daily.columns)


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, tokens and cost of each fact table."""
    out = None
    for name, t in tables.items():
        row = t.agg(F.count("*").alias("n"), F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("total"), F.coalesce(F.sum("cost"), F.lit(0)).cast("string").cast("double").alias("cost_usd")).withColumn("name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def reconcile(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """Row counts of a copy against its source; ok where none are missing."""
    counts = lambda tables, side: [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), F.lit(side).alias("side"), "n") for name, t in tables.items()]
    rows = None
    for one in [*counts(source, "source"), *counts({n: target[n] for n in source}, "target")]:
        rows = one if rows is None else rows.unionByName(one)
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("n"))).alias(f"{side}_rows")
    return rows.groupBy("name").agg(of("source"), of("target")).withColumn("ok", F.col("target_rows") >= F.col("source_rows"))


FACT_TABLES = {"daily": DAILY_KEYS, "time": EVENT_KEYS, "sessions": SESSION_KEYS}


def verified_copy(spark: SparkSession, source: str, target: str, keep_runs: int = 500) -> DataFrame:
    """Copies stored tables (one folder each: daily, time, sessions, runs) into a store: facts are upserted, the run log goes into an empty one only.

    A table that comes out with fewer rows than its source fails the job, before the new version becomes the store. Returns the
    counts and what was done with the run log. Each copy is a new version; readers take the newest one that has its mark.
    """
    versions = stored_versions(spark, target)
    number, before = (versions[-1] + 1 if versions else 0), (f"{target}/v={versions[-1]}" if versions else None)
    root, merged = f"{target}/v={number}", {}
    rows = {name: spark.read.parquet(f"{source}/{name}") for name in FACT_TABLES}
    for name, keys in FACT_TABLES.items():
        new = rows[name] if before is None else merge_replace(spark.read.parquet(f"{before}/{name}"), rows[name], keys)
        new.write.mode("overwrite").parquet(f"{root}/{name}")
        merged[name] = spark.read.parquet(f"{root}/{name}")
    counts = reconcile(rows, merged)
    short = counts.where("NOT ok").collect()  # a row for each of three tables
    if short:
        raise ValueError("rows are missing: " + ", ".join(f"{r.name} {r.target_rows} of {r.source_rows}" for r in sorted(short, key=lambda r: r["name"])))
    had = None if before is None else spark.read.parquet(f"{before}/runs")
    copied = had is None or had.isEmpty()
    runs = retain_newest(spark.read.parquet(f"{source}/runs"), keep_runs) if copied else had
    runs.write.mode("overwrite").parquet(f"{root}/runs")
    spark.range(1).select(F.lit(number).alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{root}/_done")
    return counts.withColumn("runs", F.lit("copied" if copied else "kept"))


def stored_versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the versions of a store that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(root)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path(root))]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(path(f"{root}/{n}/_done/_SUCCESS")))


def export_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, quotes only where needed and doubled inside, nulls empty."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_version(rows: DataFrame, root: str, version: int) -> str:
    """A merged table as its next version; a reader takes the newest folder with a success mark."""
    path = f"{root}/v={version}"
    rows.write.mode("error").parquet(path)
    return path


def copy_table(rows: DataFrame, required: list[str], now: Column) -> DataFrame:
    """Rows of an older table: a missing lock is null, a missing update time now; other missing columns fail."""
    for c, v in (("pricing_locked_at", F.lit(None).cast("timestamp")), ("updated_at", now)):
        if c not in rows.columns:
            rows = rows.withColumn(c, v)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return rows.select(*required)
