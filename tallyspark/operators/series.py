"""Windows over day series: rolling means, growth, period comparison, streaks, heat levels, calendars."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators.totals import spine, whole, zero

def in_days():
    """Day rows in order; they are few however many events there are."""
    return Window.orderBy("usage_date")



def carry_forward(rows: DataFrame, columns: list[str], by: str, order: list[str]) -> DataFrame:
    """Each column's last value that isn't null up to the row."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def rolling_mean(series: DataFrame, n_days: int) -> DataFrame:
    """Trailing mean over min(7, max(2, n/8)) days, partial at the start."""
    width = min(7, max(2, n_days // 8))
    return series.withColumn("mean", F.sum("value").over(in_days().rowsBetween(-(width - 1), 0)).cast("double") / F.count("value").over(in_days().rowsBetween(-(width - 1), 0)))


def growth(rows: DataFrame) -> DataFrame:
    """Last day, 7 and 30 days against those before, over days that have rows; mean and best day. One row."""
    days = rows.groupBy("usage_date").agg(zero("total_tokens").alias("t")).withColumn("r", F.row_number().over(Window.orderBy(F.desc("usage_date"))))
    part = lambda a, b: F.sum(F.when(F.col("r").between(a, b), F.col("t")))
    out = days.agg(
        part(1, 1).alias("d1"), part(2, 2).alias("d0"), part(1, 7).alias("w1"), part(8, 14).alias("w0"), part(1, 30).alias("m1"), part(31, 60).alias("m0"),
        F.round(F.sum("t").cast("double") / F.count("*")).cast("long").alias("mean"),
        F.max_by("usage_date", F.struct("t", -F.datediff("usage_date", F.lit("1970-01-01")))).alias("best_day"),
    )
    return out.select(S.delta_pct(F.col("d1"), F.col("d0")).alias("day"), S.delta_pct(F.col("w1"), F.col("w0")).alias("week"), S.delta_pct(F.col("m1"), F.col("m0")).alias("month"), "mean", "best_day")


def compare_days(rows: DataFrame, start: date, end: date) -> DataFrame:
    """Totals of a period and of as many days before it, in one scan."""
    before = start - timedelta(days=(end - start).days + 1)
    now = F.col("usage_date").between(F.lit(start), F.lit(end))
    near = rows.where(F.col("usage_date").between(F.lit(before), F.lit(end)))
    out = near.agg(F.coalesce(F.sum(F.when(now, F.col("total_tokens"))), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(~now, F.col("total_tokens"))), F.lit(0)).alias("before"))
    delta = S.delta_pct(F.col("total"), F.col("before"))
    return out.select("total", "before", delta.alias("delta"), S.delta_class(delta).alias("trend"))


def compare_instants(rows: DataFrame, start, end) -> DataFrame:
    """As compare_days for instants: the earlier span ends a minute before the start."""
    last = start - timedelta(seconds=60)
    first = last - (end - start)
    t = F.col("event_time")
    part = lambda a, b: F.coalesce(F.sum(F.when((t >= F.lit(a)) & (t <= F.lit(b)), F.col("total_tokens"))), F.lit(0))
    return rows.where((t >= F.lit(first)) & (t <= F.lit(end))).agg(part(start, end).alias("total"), part(first, last).alias("before"))


def streaks(series: DataFrame) -> DataFrame:
    """Active days, longest run of them and the run that ends on the last day. series: usage_date, value for each day of a spine."""
    n = F.datediff("usage_date", F.lit("1970-01-01"))
    active = series.where("value > 0").withColumn("island", n - F.row_number().over(in_days()))
    runs = active.groupBy("island").agg(F.count("*").alias("n"), F.max("usage_date").alias("last_day"))
    last = series.agg(F.max("usage_date").alias("end_day"))
    return runs.crossJoin(last).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("active"), F.coalesce(F.max("n"), F.lit(0)).alias("longest"), F.coalesce(F.max(F.when(F.col("last_day") == F.col("end_day"), F.col("n"))), F.lit(0)).alias("current"))


def peak_day(series: DataFrame) -> DataFrame:
    return series.agg(F.max_by("usage_date", F.struct("value", -F.datediff("usage_date", F.lit("1970-01-01")))).alias("usage_date"), F.max("value").alias("value"))


def heat_level(cells: DataFrame) -> DataFrame:
    """0 for nothing, else 1 to 4 by the 0.55th power of the share of the largest cell."""
    top = F.greatest(F.max("value").over(whole()), F.lit(1)).cast("double")
    level = F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(F.pow(F.col("value") / top, F.lit(0.55)) * 4)))
    return cells.withColumn("level", F.when(F.col("value") <= 0, 0).otherwise(level).cast("int"))


def hour_grid(hours: DataFrame, days: DataFrame) -> DataFrame:
    """Every hour of every spine day, zero filled."""
    cells = days.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    have = hours.groupBy("usage_date", "hour").agg(F.sum("total_tokens").alias("v"))
    return cells.join(have, ["usage_date", "hour"], "left").select("usage_date", "hour", F.coalesce("v", F.lit(0)).cast("long").alias("value"))


def calendar_grid(spark: SparkSession, start: date, end: date) -> DataFrame:
    """The days of every month that a period touches, with week and Sunday-first cell."""
    first = start.replace(day=1)
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.last_day(F.lit(end)))).alias("day"))
    month = F.trunc("day", "month").cast("date")
    lead = F.dayofweek(month) - 1
    return days.select(month.alias("month"), "day", F.floor((F.dayofmonth("day") - 1 + lead) / 7).cast("int").alias("week"), (F.dayofweek("day") - 1).alias("cell"), F.col("day").between(F.lit(start), F.lit(end)).alias("inside"))


def period_overlay(now: DataFrame, before: DataFrame) -> DataFrame:
    """Two day series side by side by position, not by date."""
    place = F.row_number().over(in_days())
    a = now.select(place.alias("place"), "usage_date", "value")
    b = before.select(place.alias("place"), F.col("value").alias("before"))
    return a.join(b, "place", "left").select("place", "usage_date", "value", F.coalesce("before", F.lit(0)).cast("long").alias("before"))


def period_bounds(name: str, today: date) -> tuple[tuple[date, date], tuple[date, date] | None]:
    """Bounds of a named period and of the one before it: week, month, prev, 90d, all (open start: all history)."""
    month = today.replace(day=1)
    before = (month - timedelta(days=1)).replace(day=1)
    if name == "week":
        return (today - timedelta(days=6), today), (today - timedelta(days=13), today - timedelta(days=7))
    if name == "month":
        return (month, today), (before, month - timedelta(days=1))
    if name == "prev":
        return (before, month - timedelta(days=1)), ((before - timedelta(days=1)).replace(day=1), before - timedelta(days=1))
    if name == "90d":
        return (today - timedelta(days=89), today), None
    return (date(1970, 1, 1), today), None


def range_preset(name: str, today: date) -> tuple[date, date]:
    days = {"today": 1, "7d": 7, "14d": 14, "30d": 30, "90d": 90}.get(name)
    return (today - timedelta(days=days - 1), today) if days else (date(1970, 1, 1), today)


def series(spark: SparkSession, rows: DataFrame, start: date, end: date) -> DataFrame:
    from tallyspark.operators.totals import daily_series

    return daily_series(rows.where(F.col("usage_date").between(F.lit(start), F.lit(end))), spine(spark, start, end))


def share_column(column: str) -> Column:
    return F.col(column).cast("double") / F.greatest(F.sum(column).over(whole()), F.lit(1)) * 100
