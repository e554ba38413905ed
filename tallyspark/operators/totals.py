"""Totals, shares and series of daily facts. All reduce to day or key grain before any window without partitions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import pricing as P

def whole():
    """All rows: for results that are already few."""
    return Window.partitionBy()



def spine(spark: SparkSession, start: date, end: date) -> DataFrame:
    """A row for each day; made from the parameters, so that empty days are there."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("usage_date"))


def _money(*columns: str) -> list[Column]:
    return [P.as_double(F.coalesce(F.sum(c), F.lit(0))).alias(f"{c}_usd") for c in columns]


def zero(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def totals(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All sums, cache = read + creation, and the share of cache reads in the total."""
    out = rows.groupBy(*(by or [])).agg(
        zero("total_tokens").alias("total"),
        zero("input_tokens").alias("input"),
        zero("output_tokens").alias("output"),
        zero("cache_read_tokens").alias("cache_read"),
        zero("cache_creation_tokens").alias("cache_creation"),
        (zero("cache_read_tokens") + zero("cache_creation_tokens")).alias("cache"),
        zero("reasoning_output_tokens").alias("reasoning"),
        *_money("cost"),
        *(_money("saved") if "saved" in rows.columns else []),
    )
    return out.withColumn("hit_rate", S.percent(F.col("cache_read"), F.col("total")))


def sum_field(rows: DataFrame, field: str) -> DataFrame:
    return rows.agg(zero(field).alias("value"))


def aggregate_by_key(rows: DataFrame, key: str) -> DataFrame:
    """Totals of each value of a dimension, with the days, sources and models it has; blank keys are skipped."""
    out = rows.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(F.col(key).alias("key")).agg(
        zero("total_tokens").alias("total"),
        zero("cache_read_tokens").alias("cache_read"),
        *_money("cost"),
        F.count_distinct("usage_date").alias("days"),
        F.count_distinct("source").alias("sources"),
        F.count_distinct("model").alias("models"),
    )
    return out.withColumn("hit_rate", S.percent(F.col("cache_read"), F.col("total")))


def with_share(rows: DataFrame, column: str = "total") -> DataFrame:
    """Per cent of the sum over all rows: one row with the sum goes to all, no window holds them."""
    total = rows.agg(F.sum(column).alias("_sum"))
    share = F.col(column).cast("double") / F.when(F.col("_sum") == 0, 1).otherwise(F.col("_sum")) * 100
    return rows.crossJoin(F.broadcast(total)).withColumn("share", share).drop("_sum")


def by_source_device(rows: DataFrame) -> DataFrame:
    return with_share(rows.groupBy("source", "device").agg(zero("total_tokens").alias("total"), *_money("cost"), F.count_distinct("model").alias("models")))


def by_source_model(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "model").agg(zero("total_tokens").alias("total"), *_money("cost"), F.count_distinct("usage_date").alias("days"))


def by_date_dimension(rows: DataFrame, dimension: str) -> DataFrame:
    return rows.groupBy("usage_date", F.col(dimension).alias("key")).agg(zero("total_tokens").alias("total"))


def trend_pivot(rows: DataFrame, days: DataFrame, sources: list[str]) -> DataFrame:
    """A row for each spine day, a column for each source, zero filled."""
    wide = rows.groupBy("usage_date").pivot("source", sources).agg(F.sum("total_tokens"))
    return days.join(wide, "usage_date", "left").na.fill(0, subset=sources)


def daily_series(rows: DataFrame, days: DataFrame, metric: str = "total_tokens") -> DataFrame:
    per_day = rows.groupBy("usage_date").agg(F.sum(metric).alias("value"))
    return days.join(per_day, "usage_date", "left").select("usage_date", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def daily_totals_map(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Per spine day total, cost and a map of each source's tokens."""
    one = rows.groupBy("usage_date", "source").agg(F.sum("total_tokens").alias("t"), F.sum("cost").alias("c"))
    per_day = one.groupBy("usage_date").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "t")))).alias("by_tool"))
    return days.join(per_day, "usage_date", "left").select("usage_date", F.coalesce("t", F.lit(0)).alias("total"), P.as_double(F.coalesce("c", F.lit(0))).alias("cost_usd"), "by_tool")


def hit_rate_series(rows: DataFrame) -> DataFrame:
    """Hit rate of active days; days without tokens are left out."""
    per_day = rows.groupBy("usage_date").agg(zero("cache_read_tokens").alias("r"), zero("total_tokens").alias("t"))
    return per_day.where("t > 0").select("usage_date", S.percent(F.col("r"), F.col("t")).alias("hit_rate"))


def efficiency(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hit rate, input to output ratio and share of reasoning; zero where the denominator is."""
    s = rows.groupBy(*(by or [])).agg(*(zero(c).alias(c) for c in ("cache_read_tokens", "total_tokens", "input_tokens", "output_tokens", "reasoning_output_tokens")))
    ratio = F.when(F.col("output_tokens") > 0, F.col("input_tokens").cast("double") / F.col("output_tokens")).otherwise(F.lit(0.0))
    return s.select(
        *(by or []), S.percent(F.col("cache_read_tokens"), F.col("total_tokens")).alias("hit_rate"), ratio.alias("io_ratio"), S.percent(F.col("reasoning_output_tokens"), F.col("total_tokens")).alias("reasoning_share")
    )


def efficiency_series(rows: DataFrame, days: DataFrame) -> DataFrame:
    return days.join(efficiency(rows, ["usage_date"]), "usage_date", "left").na.fill(0.0)


def source_share(rows: DataFrame) -> DataFrame:
    out = with_share(rows.groupBy("source").agg(zero("total_tokens").alias("total")))
    return out.withColumn("top_share", F.max("share").over(whole()))


def unit_cost(rows: DataFrame) -> DataFrame:
    """Cost of a million tokens by source."""
    s = rows.groupBy("source").agg(zero("total_tokens").alias("total"), *_money("cost"))
    return s.withColumn("per_million", F.when(F.col("total") > 0, F.col("cost_usd") / (F.col("total") / 1e6)))


def hour_marginal(hours: DataFrame) -> DataFrame:
    """Tokens of each hour of the day; the peak is the first largest."""
    s = hours.groupBy("hour").agg(zero("total_tokens").alias("total"))
    return s.withColumn("peak_hour", F.max_by("hour", F.struct("total", -F.col("hour"))).over(whole()))


def weekday_distribution(rows: DataFrame) -> DataFrame:
    """Tokens of each weekday from Monday (0), rounded share; workdays' share and 100 minus it."""
    s = with_share(rows.groupBy(F.weekday("usage_date").alias("weekday")).agg(zero("total_tokens").alias("total")))
    work = F.round(F.sum(F.when(F.col("weekday") < 5, F.col("total")).otherwise(0)).over(whole()).cast("double") / F.sum("total").over(whole()) * 100).cast("int")
    return s.withColumn("share", F.round("share").cast("int")).withColumn("workdays", work).withColumn("weekend", 100 - F.col("workdays"))


def hero_stats(rows: DataFrame) -> DataFrame:
    """Active days, projects, sources, peak day, top source with share, cost per active day: one row."""
    days = rows.groupBy("usage_date").agg(F.sum("total_tokens").alias("t")).agg(F.sum(F.when(F.col("t") > 0, 1).otherwise(0)).alias("active_days"), F.max_by("usage_date", F.struct("t", -F.datediff("usage_date", F.lit("1970-01-01")))).alias("peak_day"))
    top = source_share(rows).agg(F.max_by("source", F.struct("total", "source")).alias("top_source"), F.max("top_share").alias("top_share"))
    rest = rows.agg(F.count_distinct("project_path").alias("projects"), F.count_distinct("source").alias("sources"), *_money("cost"))
    return days.crossJoin(top).crossJoin(rest).withColumn("cost_per_day", F.when(F.col("active_days") > 0, F.col("cost_usd") / F.col("active_days")).otherwise(0.0))
