"""Stores that micro-batches merge into, device payloads, changed files, and counters in parts and segments."""

import json
import os
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import counters as C
from tallyspark.operators import merge as M
from tallyspark.plans.streams import in_turn
from tallyspark.sources import readers
from tallyspark.streaming import facts, jobs

TODAY = date(2024, 1, 20)


def payload(at, mode, *events, device="d", source="s", runs=()):
    time = [{"device": device, "source": source, "eventKey": k, "eventTime": f"{day}T01:00:00Z", "usageDate": day, "model": "m", "inputTokens": n, "totalTokens": n, "costUSD": 0.1} for k, day, n in events]
    daily = [{"device": device, "source": source, "usageDate": day, "model": "m", "totalTokens": n, "costUSD": n / 10} for _, day, n in events]
    return json.dumps({"device": device, "mode": mode, "collectedAt": f"2024-02-01T00:00:{at:02d}Z", "daily": daily, "time": time, "runs": [{"device": device, "source": source, "status": r} for r in runs]})


def lines(spark, *values):
    return spark.createDataFrame([(v, "f", 0) for v in values], "value string, file_path string, block long").coalesce(1)


def times(spark, root):
    return sorted((r.source, r.event_key, str(r.usage_date), r.total_tokens) for r in facts.stored(spark, root, "time").collect())


def test_full_and_incremental_payloads_in_one_batch(spark, tmp_path):
    root = str(tmp_path / "facts")
    ingest = facts.ingest_payloads(spark, root, TODAY, F.current_timestamp(), keep_runs=3)
    ingest(lines(spark, payload(1, "incremental", ("a", "2024-01-01", 1), ("b", "2024-01-02", 2), runs=("ok", "ok")), payload(2, "incremental", ("x", "2024-01-01", 5), source="other")), 0)
    second = lines(
        spark,
        payload(5, "full", ("c", "2024-01-03", 3), runs=("ok",)),  # the days of a and b are emptied
        payload(4, "incremental", ("a", "2024-01-01", 9)),  # collected before the full one, so gone with it
        payload(6, "incremental", ("c", "2024-01-03", 4), ("d", "2024-01-25", 7), runs=("error",)),
        payload(7, "full", source="other"),  # a full payload without events of a source leaves them
        '{"device": "broken',
    )
    for _ in range(2):  # the batch comes again after a failure
        ingest(second, 1)
        assert times(spark, root) == [("other", "x", "2024-01-01", 5), ("s", "c", "2024-01-03", 4), ("s", "d", "2024-01-25", 7)]
    ingest(lines(spark, payload(9, "incremental", ("d", "2024-01-25", 8))), 2)
    assert times(spark, root)[-1] == ("s", "d", "2024-01-25", 8)
    daily = {(r.source, str(r.usage_date)): (r.total_tokens, float(r.cost), r.pricing_locked_at is not None) for r in facts.stored(spark, root, "daily").collect()}
    # a past day keeps its first cost, an open day takes the last
    assert daily == {("s", "2024-01-01"): (9, 0.1, True), ("s", "2024-01-02"): (2, 0.2, True), ("s", "2024-01-03"): (4, 0.3, True), ("s", "2024-01-25"): (8, 0.8, False), ("other", "2024-01-01"): (5, 0.5, True)}
    assert Counter((r.batch_no, r.status) for r in facts.stored(spark, root, "runs").collect()) == Counter([(1, "error"), (1, "ok"), (0, "ok")])


def test_a_group_that_later_batches_touch_has_one_row(spark, tmp_path):
    root = str(tmp_path / "hours")
    rows = lambda *x: spark.createDataFrame([(datetime(2024, 1, d, h), "m", n) for d, h, n in x], "hour_start timestamp, model string, calls long")
    keep = facts.keep_newest(spark, root, "hours", ["hour_start", "model"], F.to_date("hour_start"))
    for number, batch in enumerate((rows((1, 1, 1), (1, 2, 1)), rows((1, 2, 5), (2, 0, 1)), rows((1, 1, 7)))):
        keep(batch, number)
    keep(rows((1, 1, 7)), 2)
    assert sorted((r.hour_start.day, r.hour_start.hour, r.calls) for r in facts.stored(spark, root, "hours").collect()) == [(1, 1, 7), (1, 2, 5), (2, 0, 1)]


def test_changed_files_take_the_place_of_what_they_had(spark, tmp_path):
    logs, root = tmp_path / "logs", str(tmp_path / "facts")
    logs.mkdir()
    (logs / "a.jsonl").write_text("1\n2\n")
    (logs / "b.jsonl").write_text("3\n")
    run = lambda n: {r.file_path.rsplit("/")[-1]: r.what for r in facts.collect_changed(spark, str(logs), root, n).collect()}
    values = lambda: sorted((r.file_path.rsplit("/")[-1], r.value) for r in facts.stored(spark, root, "lines").collect())
    assert run(0) == {"a.jsonl": "new", "b.jsonl": "new"}
    assert run(1) == {} and values() == [("a.jsonl", "1"), ("a.jsonl", "2"), ("b.jsonl", "3")]
    (logs / "a.jsonl").write_text("1\n2\n\n4\n")
    (logs / "c.jsonl").write_text("5\n")
    assert run(2) == {"a.jsonl": "changed", "c.jsonl": "new"}
    (logs / "b.jsonl").unlink()
    later = datetime.now().timestamp() + 60
    (logs / "c.jsonl").write_text("6\n")
    os.utime(logs / "c.jsonl", (later, later))  # the same size, another time
    assert run(3) == {"b.jsonl": "gone", "c.jsonl": "changed"}
    assert values() == [("a.jsonl", "1"), ("a.jsonl", "2"), ("a.jsonl", "4"), ("c.jsonl", "6")]


LINES = "file_path string, line_no long, ts string, model string, replay boolean, last struct<input:bigint,cached:bigint,output:bigint,reasoning:bigint>, total struct<input:bigint,cached:bigint,output:bigint,reasoning:bigint>"


def counter_lines(seed, files=6, most=120):
    rnd = random.Random(seed)
    for f in range(files):
        total, replay = [0] * 4, rnd.random() < 0.3
        for i in range(rnd.randint(1, most)):
            add = [rnd.randint(0, 50) for _ in range(4)]
            kind = rnd.random()
            if kind < 0.7:
                total = [a + b for a, b in zip(total, add, strict=True)]
            elif kind < 0.75:
                total = list(add)
            shown = [max(0, t - rnd.randint(0, 3)) for t in total] if kind > 0.9 else total
            yield (f"f{f}", i, f"2024-01-01T00:00:{i // 5:02d}", "m", replay, tuple(add) if rnd.random() < 0.6 else None, tuple(shown) if rnd.random() < 0.8 else None)


def folded(rows):
    out, states = [], {}
    for path, no, ts, model, replay, last, total in sorted(rows, key=lambda r: r[:2]):
        use, states[path] = C.step(states.get(path, C.FRESH), ts, replay, last, total)
        if use:
            out.append(C.row((path, no, ts, model), use))
    return Counter(out)


def test_sessions_cut_over_partitions(spark):
    """Parts start from the state that the part before ends in, stale totals across their borders included."""
    stale = [("g", i, "2024-01-01T00:00:00", "m", False, (1, 0, 0, 0), (1000 - i % 3, 0, 0, 0)) for i in range(300)]
    rows = [*counter_lines(1), *stale]
    for partitions in (1, 7, 40):
        got = C.counter_increments(spark.createDataFrame(rows, LINES).repartition(5), partitions)
        assert Counter(tuple(r) for r in got.collect()) == folded(rows)


def test_a_long_session(spark):
    rows = spark.range(300_000).selectExpr("'f' AS file_path", "id AS line_no", "'2024-01-01T00:00:00' AS ts", "'m' AS model", "false AS replay", "CAST(NULL AS struct<input:bigint,cached:bigint,output:bigint,reasoning:bigint>) AS last", "named_struct('input', id + 1, 'cached', 0L, 'output', 2 * id, 'reasoning', 0L) AS total")
    got = C.counter_increments(rows, 8)
    assert got.agg(F.count("*"), F.sum("input_tokens"), F.sum("output_tokens")).first() == (300_000, 300_000, 599_998)


def test_segments_out_of_order_and_sessions_that_end(spark, tmp_path):
    rows = [r for r in counter_lines(3, files=3, most=40)]
    begin = datetime(2024, 3, 1)
    schema = LINES + ", segment int, landed timestamp"
    part = lambda k, when, which: spark.createDataFrame([(*r, r[1] % 40 // 10, begin + when) for r in which if r[1] % 40 // 10 == k], schema)
    hour, out, states = timedelta(hours=1), str(tmp_path / "out"), []
    only = [r for r in rows if r[0] == "f0"] + [("late", 15, "2024-01-01T00:00:00", "m", False, (1, 1, 1, 1), None)]
    frames = [part(0, hour, rows), part(2, 2 * hour, rows), part(1, 3 * hour, [*rows, *only[-1:]]), part(3, 4 * hour, rows)]
    # long after: the other sessions' states fall, and the segment whose forerunner never came is folded as it is
    frames += [spark.createDataFrame([("new", i, "2024-01-01T00:00:00", "m", False, (1, 0, 0, 0), None, 0, begin + timedelta(days=30 + i))], schema) for i in range(3)]

    def start(path):
        stream = jobs.stream_counter_increments(jobs.stream_log_lines(spark, path, frames[0].schema), keep=timedelta(days=7))
        return stream.writeStream.outputMode("append").format("parquet").option("path", out)

    for i in range(len(frames)):
        if i == 0:
            path, mark = str(tmp_path / "landing"), str(tmp_path / "mark")
        frames[i].write.mode("append").parquet(path)
        query = start(path).option("checkpointLocation", mark).trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress and query.lastProgress["stateOperators"] else None)
    got = Counter(tuple(r) for r in spark.read.parquet(out).collect())
    new = [("new", i, "2024-01-01T00:00:00", "m", False, (1, 0, 0, 0), None) for i in range(3)]
    assert got == folded([*rows, only[-1], *new])
    assert max(s for s in states if s is not None) >= 4 and states[-1] <= 1


def test_late_events_are_kept_apart_until_the_repair(spark, tmp_path):
    root = str(tmp_path / "facts")
    rows = lambda *x: spark.createDataFrame([("d", s, k, datetime(2024, 1, d), date(2024, 1, d)) for s, k, d in x], "device string, source string, event_key string, event_time timestamp, usage_date date")
    cutoffs = lambda marks: marks.select("device", "source", (F.col("watermark") - F.expr("INTERVAL 48 HOURS")).alias("cutoff"))
    split = facts.split_late(spark, root, cutoffs)
    split(rows(("a", "1", 10), ("b", "2", 10)), 0)
    second = rows(("a", "3", 9), ("a", "4", 5), ("c", "5", 1))
    split(second, 1)
    split(second, 1)
    keys = lambda table: sorted(r.event_key for r in facts.stored(spark, root, table).collect())
    assert keys("time") == ["1", "2", "3", "5"] and keys("late") == ["4"]
    everything = rows(("a", "1", 10), ("b", "2", 10), ("a", "3", 9), ("a", "4", 5), ("c", "5", 1))
    assert [r.source for r in facts.repair_late(spark, root, 2, everything).collect()] == ["a"]
    assert keys("time") == ["1", "2", "3", "4", "5"] and keys("late") == []


def test_batches_come_in_turn(spark, tmp_path):
    seen = []
    frames = [spark.range(3).repartition(2), spark.range(4)]
    in_turn(frames, "turns", lambda path: jobs.stream_log_lines(spark, path, frames[0].schema).writeStream.foreachBatch(lambda b, n: seen.append((n, b.count()))))
    assert seen == [(0, 3), (1, 4)]


def test_a_copy_that_checks_itself(spark, tmp_path):
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    facts_ = spark.createDataFrame([("d", "s", date(2024, 1, 1), "m", "k1", "x", 1), ("d", "s", date(2024, 1, 2), "m", "k2", "y", 2)], "device string, source string, usage_date date, model string, event_key string, session_id string, total_tokens long")
    runs = spark.range(5).withColumn("status", F.lit("ok"))
    for name in M.FACT_TABLES:
        facts_.write.parquet(f"{source}/{name}")
    runs.write.parquet(f"{source}/runs")
    assert {(r.source_rows, r.target_rows, r.ok, r.runs) for r in M.verified_copy(spark, source, target, keep_runs=3).collect()} == {(2, 2, True, "copied")}
    # two rows with one key cannot both be there
    facts_.unionByName(facts_).write.mode("overwrite").parquet(f"{source}/twice")
    (tmp_path / "source" / "time").rename(tmp_path / "source" / "was")
    (tmp_path / "source" / "twice").rename(tmp_path / "source" / "time")
    assert {r.runs for r in M.verified_copy(spark, source, target).collect()} == {"kept"}
    assert M.stored_versions(spark, target) == [0, 1] and spark.read.parquet(f"{target}/v=1/runs").count() == 3
    short = {"time": facts_.limit(1)}
    assert [r.ok for r in M.reconcile({"time": facts_}, short).collect()] == [False]


def test_a_short_copy_fails_and_is_no_version(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "source"), str(tmp_path / "target")
    rows = spark.createDataFrame([("d", "s", date(2024, 1, 1), "m", "k", "x", 1)], "device string, source string, usage_date date, model string, event_key string, session_id string, total_tokens long")
    for name in M.FACT_TABLES:
        rows.write.parquet(f"{source}/{name}")
    spark.range(1).write.parquet(f"{source}/runs")
    M.verified_copy(spark, source, target)
    monkeypatch.setattr(M, "merge_replace", lambda old, new, keys: old.limit(0))
    with pytest.raises(ValueError, match="daily 0 of 1"):
        M.verified_copy(spark, source, target)
    assert M.stored_versions(spark, target) == [0]


def test_mixed_turn_files(spark, tmp_path):
    lines_ = [
        {"type": "gemini", "model": "g-1", "id": "a", "timestamp": "2024-01-01T00:00:00Z", "tokens": {"input": 10, "output": 1}},
        {"stats": {"prompt_tokens": 7, "candidates_tokens": 2, "cached_tokens": 3}},  # the last model named, the file's stem
        {"type": "init", "sessionId": "s1", "model": "g-2"},
        {"type": "gemini", "model": "g-2", "id": "a", "tokens": {"input": 20, "output": 1}},  # a later version of a
        {"type": "result", "result": {"stats": {"models": {"g-3": {"tokens": {"prompt": 5, "candidates": 1}}, "g-4": {"tokens": {}}}, "input_tokens": 99}}},
        {"session_id": "s2", "stats": {"models": {}, "input_tokens": 4, "output_tokens": 4}},
        {"type": "gemini", "tokens": {"input": 1}},  # no model, no turn
        {"type": "user", "stats": {"input_tokens": 0}},
    ]
    (tmp_path / "stem.of.file.jsonl").write_text("\n".join(["{broken", *map(json.dumps, lines_)]))
    got = sorted((r.session_id, r.model, r.input_tokens, r.output_tokens, r.cache_read_tokens) for r in readers.read_turn_stream(spark, [str(tmp_path)]).collect())
    assert got == [("s1", "g-2", 20, 1, 0), ("s1", "g-3", 5, 1, 0), ("s2", "g-2", 4, 4, 0), ("stem.of.file", "g-1", 4, 2, 3)]
