"""Automatic findings from daily facts: spikes, unit cost gaps, cache shifts, growing projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import pricing as P
from tallyspark.operators.topk import top_model_per_group
from tallyspark.operators.totals import aggregate_by_key, with_share, zero


def insight_spike_day(rows: DataFrame, factor: float = 2.2) -> DataFrame:
    """The peak day if it exceeds the mean of active days by the factor, with its main source and that source's share."""
    days = rows.groupBy("usage_date").agg(zero("total_tokens").alias("t")).where("t > 0")
    peak = days.agg(F.max_by("usage_date", F.struct("t", -F.datediff("usage_date", F.lit("1970-01-01")))).alias("usage_date"), F.max("t").alias("t"), F.sum("t").alias("s"), F.count("*").alias("n"))
    peak = peak.withColumn("ratio", F.col("t").cast("double") / (F.col("s").cast("double") / F.col("n"))).where(F.col("ratio") > factor)
    by = rows.groupBy("usage_date", "source").agg(zero("total_tokens").alias("st"))
    top = by.withColumn("p", F.row_number().over(Window.partitionBy("usage_date").orderBy(F.desc("st"), "source"))).where("p = 1")
    return peak.join(top, "usage_date").select("usage_date", F.col("t").alias("total"), "ratio", "source", (F.col("st").cast("double") / F.col("t") * 100).alias("source_share"))


def insight_unit_cost_gap(rows: DataFrame, factor: float = 1.6) -> DataFrame:
    """The two costliest sources, if the first's price of a million tokens exceeds the second's by the factor."""
    s = rows.groupBy("source").agg(zero("total_tokens").alias("t"), P.as_double(F.sum("cost")).alias("c")).where("c > 0 AND t > 0")
    s = s.withColumn("rate", F.col("c") / (F.col("t") / 1e6)).withColumn("p", F.row_number().over(Window.orderBy(F.desc("c"), "source"))).where("p <= 2")
    pick = lambda c, p: F.max(F.when(F.col("p") == p, F.col(c)))
    two = s.agg(*(pick(c, p).alias(f"{c}{p}") for c in ("source", "t", "c", "rate") for p in (1, 2)))
    two = two.where(F.col("rate1") > factor * F.col("rate2"))
    return two.select(F.col("source1").alias("source"), F.col("source2").alias("cheaper"), F.col("rate1").alias("rate"), F.col("rate2").alias("cheaper_rate"), (F.col("c1") - F.col("t1") / 1e6 * F.col("rate2")).alias("saving"))


def insight_cache_shift(now: DataFrame, before: DataFrame, points: float = 2.0) -> DataFrame:
    """A change of the hit rate by more than the points, against a period that isn't empty."""
    one = lambda rows, p: rows.agg(zero("cache_read_tokens").alias(f"r{p}"), zero("total_tokens").alias(f"t{p}"))
    both = one(now, 1).crossJoin(one(before, 0)).where("t0 > 0")
    out = both.select(S.percent(F.col("r1"), F.col("t1")).alias("hit_rate"), S.percent(F.col("r0"), F.col("t0")).alias("before"), (F.col("r1") - F.col("r0")).alias("cached_delta"))
    return out.where(F.abs(F.col("hit_rate") - F.col("before")) > points)


def prior_period(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Totals of each key in two periods; the change is null where there was nothing before."""
    a = now.groupBy(F.col(key).alias("key")).agg(zero("total_tokens").alias("total"))
    b = before.groupBy(F.col(key).alias("key")).agg(zero("total_tokens").alias("before"))
    out = a.join(b, "key", "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return out.withColumn("delta", S.delta_pct(F.col("total"), F.col("before")))


def insight_growth_project(now: DataFrame, before: DataFrame, least: float = 50.0, tokens: int = 100_000) -> DataFrame:
    """The fastest growing project with more than `tokens` tokens and growth above `least` per cent; tokens for each active day."""
    days = now.groupBy(F.col("project_path").alias("key")).agg(F.count_distinct("usage_date").alias("days"))
    out = prior_period(now, before, "project_path").where((F.col("before") > 0) & (F.col("delta") > least) & (F.col("total") > tokens))
    return out.join(days, "key").withColumn("per_day", F.col("total").cast("double") / F.col("days")).orderBy(F.desc("delta"), "key").limit(1)


def insights(now: DataFrame, before: DataFrame, most: int = 4) -> DataFrame:
    """The findings in order as (ord, kind, subject, value)."""
    rows = [
        insight_spike_day(now).select(F.lit(1).alias("ord"), F.lit("spike_day").alias("kind"), F.col("usage_date").cast("string").alias("subject"), F.col("ratio").alias("value")),
        insight_unit_cost_gap(now).select(F.lit(2).alias("ord"), F.lit("unit_cost_gap").alias("kind"), F.col("source").alias("subject"), F.col("rate").alias("value")),
        insight_cache_shift(now, before).select(F.lit(3).alias("ord"), F.lit("cache_shift").alias("kind"), F.lit("all").alias("subject"), (F.col("hit_rate") - F.col("before")).alias("value")),
        insight_growth_project(now, before).select(F.lit(4).alias("ord"), F.lit("growth_project").alias("kind"), F.col("key").alias("subject"), F.col("delta").alias("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy("ord").limit(most)


def project_narrative(rows: DataFrame) -> DataFrame:
    """The top project with share, top model, hit rate and its band: high above 60, low below 30."""
    p = with_share(aggregate_by_key(rows, "project_path"))
    top = p.orderBy(F.desc("total"), "key").limit(1)
    best = top_model_per_group(rows, "project_path").select(F.col("project_path").alias("key"), F.col("model").alias("top_model"))
    band = F.when(F.col("hit_rate") > 60, "high").when(F.col("hit_rate") < 30, "low").otherwise("middle")
    return top.join(best, "key").select("key", "total", "share", "hit_rate", band.alias("band"), "top_model")


def source_cards(rows: DataFrame) -> DataFrame:
    cards = with_share(aggregate_by_key(rows, "source"))
    best = top_model_per_group(rows, "source").select(F.col("source").alias("key"), F.col("model").alias("top_model"))
    return cards.join(best, "key").select("key", "total", "cost_usd", "share", "hit_rate", "top_model")
