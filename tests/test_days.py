"""Merges into facts stored by day, places in a sorted table, and the order of log lines."""

from pathlib import Path

from pyspark.sql import functions as F

from tallyspark.operators import merge as M
from tallyspark.operators import topk
from tallyspark.sources import readers
from tallyspark.streaming import jobs

EVENTS = "device string, source string, event_key string, usage_date date, total_tokens long"


def events(spark, *rows):
    return spark.createDataFrame([("d", "s", *r) for r in rows], "device string, source string, event_key string, day string, total_tokens long").selectExpr("device", "source", "event_key", "CAST(day AS DATE) AS usage_date", "total_tokens")


def files(root):
    return {p.parent.name: p.name for p in Path(root).glob("usage_date=*/part-*")}


def test_only_touched_days_are_rewritten(spark, tmp_path):
    root = str(tmp_path / "facts")
    merge = jobs.merge_into_days(spark, root, M.merge_events)
    merge(events(spark, ("a", "2024-01-01", 1), ("b", "2024-01-02", 2)), 0)
    before = files(root)
    second = events(spark, ("b", "2024-01-02", 20), ("c", "2024-01-03", 3))
    merge(second, 1)
    merge(second, 1)  # the same batch again
    got = sorted((r.event_key, str(r.usage_date), r.total_tokens) for r in jobs.stored_days(spark, root).collect())
    assert got == [("a", "2024-01-01", 1), ("b", "2024-01-02", 20), ("c", "2024-01-03", 3)]
    after = files(root)
    assert after["usage_date=2024-01-01"] == before["usage_date=2024-01-01"] and after["usage_date=2024-01-02"] != before["usage_date=2024-01-02"]


def test_whole_sources_are_replaced(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "facts")
    for i, rows in enumerate(([("a", "2024-01-01", 1), ("b", "2024-01-02", 2)], [("c", "2024-01-02", 3)])):
        events(spark, *rows).coalesce(1).write.parquet(f"{landing}/batch={i}")
    stream = jobs.stream_log_lines(spark, landing, EVENTS, files_per_batch=1)
    jobs.run_available(jobs.stream_merge_events(spark, stream, root, full=True), str(tmp_path / "mark"))
    assert [r.event_key for r in jobs.newest_version(spark, root).collect()] == ["c"]


def test_pace():
    assert jobs.pace() == "300000 milliseconds" and jobs.pace(1) == "10000 milliseconds"


def test_places(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = topk.numbered(topk.sort_any_column(rows, "v")).collect()
    assert sorted((r.place, r.v) for r in got) == [(i + 1, i) for i in range(1000)]


def test_lines_keep_their_order_without_a_shuffle(spark, tmp_path):
    """Files cut into many blocks: the places of lines grow as in the file."""
    for name, n in (("a", 5000), ("b", 17), ("c", 2500)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{i}\n\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        lines = readers.scan_session_lines(spark, [str(tmp_path)])
        assert "Exchange" not in lines._jdf.queryExecution().toString()
        rows = lines.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len({r.task for r in rows}) > 5
    for name, n in (("a", 5000), ("b", 17), ("c", 2500)):
        mine = sorted((r.line_no, int(r.value)) for r in rows if r.file_path.endswith(f"/{name}.jsonl"))
        assert [v for _, v in mine] == list(range(n)) and len({p for p, _ in mine}) == n


def test_days_of_a_zone_that_changes_its_offset(spark):
    """The last Sunday of March in Berlin has 23 hours, that of October 25."""
    hours = spark.sql("SELECT explode(sequence(TIMESTAMP '2024-03-29 00:00:00', TIMESTAMP '2024-11-01 00:00:00', INTERVAL 1 HOUR)) AS hour_start").selectExpr("hour_start", "'d' AS device", "'s' AS source", "'m' AS model", "1L AS calls", "2L AS total_tokens")
    got = {str(r.usage_date): (r.calls, r.total_tokens) for r in jobs.daily_of_hours(hours, "Europe/Berlin").collect()}
    assert (got["2024-03-30"], got["2024-03-31"], got["2024-10-27"], got["2024-10-28"]) == ((24, 48), (23, 46), (25, 50), (24, 48))
