"""Top-k, sorting and ranking. Every order ends in a name or a date, so ties have one result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators import pricing as P
from tallyspark.operators.stages import checkpointed
from tallyspark.operators.totals import zero


def top_models(rows: DataFrame, k: int = 5) -> DataFrame:
    out = rows.where("model IS NOT NULL").groupBy("model").agg(zero("total_tokens").alias("total"), P.as_double(F.sum("cost")).alias("cost_usd"), F.count("*").alias("n"), F.min("source").alias("first_source"))
    return out.orderBy(F.desc("total"), "model").limit(k)


def top_model_per_group(rows: DataFrame, group: str) -> DataFrame:
    """The model with most tokens in each group; the first by name among equals."""
    s = rows.groupBy(group, "model").agg(zero("total_tokens").alias("total"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("total"), "model"))
    return s.withColumn("place", place).where("place = 1").select(group, "model", "total")


def top_n_with_rest(rows: DataFrame, key: str, most: int = 8) -> DataFrame:
    """All keys if there are at most `most`; else the first most-1 and one row for the rest."""
    s = rows.groupBy(F.col(key).alias("key")).agg(zero("total_tokens").alias("total"), F.sum("cost").alias("c"))
    # the first keys and one more, which tells whether there is a rest; all others are never put in order
    first = s.orderBy(F.desc("total"), "key").limit(most + 1).agg(F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("t"), "key"))).alias("x"))
    named = first.select(F.explode(F.when(F.size("x") <= most, F.col("x")).otherwise(F.slice("x", 1, most - 1))).alias("x")).select(F.col("x.key").alias("_named"), F.lit(True).alias("_is"))
    s = s.join(F.broadcast(named), F.col("key").eqNullSafe(F.col("_named")), "left")
    name = F.when(F.col("_is"), F.col("key")).otherwise("rest")
    return s.groupBy(name.alias("key")).agg(F.sum("total").alias("total"), P.as_double(F.sum("c")).alias("cost_usd"), F.count("*").alias("members"))


def peak_days(series: DataFrame, n: int = 3) -> DataFrame:
    return series.where("value > 0").orderBy(F.desc("value"), "usage_date").limit(n)


def peak_day_drivers(rows: DataFrame, n: int = 3) -> DataFrame:
    """Top source and top project of each of the n largest days."""
    days = peak_days(rows.groupBy("usage_date").agg(zero("total_tokens").alias("value")), n)
    out = days
    for c, name in (("source", "top_source"), ("project_path", "top_project")):
        s = rows.groupBy("usage_date", c).agg(zero("total_tokens").alias("t"))
        s = s.withColumn("place", F.row_number().over(Window.partitionBy("usage_date").orderBy(F.desc("t"), c))).where("place = 1").select("usage_date", F.col(c).alias(name))
        out = out.join(s, "usage_date", "left")
    return out


def by_tokens(rows: DataFrame, k: int) -> DataFrame:
    return rows.orderBy(F.desc("total_tokens"), "session_id").limit(k)


def latest_runs(runs: DataFrame, k: int = 500) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(k)


def sort_any_column(rows: DataFrame, column: str, descending: bool = False, tie: str | None = None) -> DataFrame:
    """Numbers by value, texts without case."""
    kind = dict(rows.dtypes)[column]
    key = F.lower(column) if kind == "string" else F.col(column)
    return rows.orderBy(key.desc() if descending else key.asc(), *([tie] if tie else []))


def numbered(rows: DataFrame, name: str = "place") -> DataFrame:
    """Sorted rows with their place from 1: each partition's rows before it are summed, so no window holds all rows.

    The order is checkpointed first, as ranges sampled anew could fall otherwise.
    """
    inside = F.lit((1 << 33) - 1)  # of a row's id: its place in its partition; the partition stands above
    rows = checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()))
    parts = rows.groupBy(F.shiftright("_row", 33).alias("_part")).count()
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.withColumn("_part", F.shiftright("_row", 33)).join(F.broadcast(parts), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_row").bitwiseAND(inside) + 1).drop("_row", "_part", "_before")


def latest_sync(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by("collected_at", "id").alias("collected_at"))
