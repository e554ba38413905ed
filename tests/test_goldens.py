"""Expected results that are fixed by the rules, on tiny inputs."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import scalars as S
from tallyspark.operators import merge as M
from tallyspark.operators import normalize as D
from tallyspark.operators import pricing as P
from tallyspark.operators import series as W
from tallyspark.operators import totals as A
from tallyspark.sources import readers


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "raw,want",
    [("gpt-5-codex(high)", "gpt-5-codex"), ("claude-sonnet-4-5-20250101", "claude-sonnet-4-5"), ("claude-3.5-sonnet", "claude-3-5-sonnet"), ("", "unknown"), (None, "unknown"), ("model(beta)", "model(beta)")],
)
def test_normalise_model(spark, raw, want):
    assert one(spark, S.normalise_model(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("openai", "openai"), ("x-ai", "xai"), ("anthropic/claude-sonnet", "anthropic"), ("unknown", None), (None, None)])
def test_canonical_provider(spark, raw, want):
    assert one(spark, S.canonical_provider(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("claude-sonnet-4", "anthropic"), ("gpt-4o", "openai"), ("gemini-2.0-flash", "google"), ("grok-2", "xai"), ("deepseek-chat", "deepseek"), ("totally-unknown", None)])
def test_infer_provider(spark, raw, want):
    assert one(spark, S.infer_provider(F.lit(raw))) == want


@pytest.mark.parametrize("n,want", [(None, "—"), (5, "5"), (999, "999"), (1000, "1K"), (1250, "1.3K"), (-1250, "-1.3K"), (1150, "1.1K"), (1350, "1.4K"), (1450, "1.4K"), (2_000_000, "2M"), (3_450_000_000, "3.5B")])
def test_compact_number(spark, n, want):
    assert one(spark, S.compact_number(F.lit(n).cast("double"))) == want


def test_zone_and_dates(spark):
    assert S.valid_zone("Asia/Shanghai") == "Asia/Shanghai" and S.valid_zone("'; DROP TABLE x") == "UTC"
    a, b = (one(spark, S.local_date(F.lit(n), "UTC")) for n in (1_700_000_000, 1_700_000_000_000))
    assert a == b == date(2023, 11, 14)
    assert one(spark, S.event_instant(F.lit("not-a-date"))) is None


def test_token_total(spark):
    row = spark.createDataFrame([(25, 4, 0, 5, 1)], ", ".join(f"{c} long" for c in S.COUNTERS))
    assert row.select(S.token_total(F.lit(True)).alias("x")).first().x == 34
    assert row.select(S.token_total(F.lit(False)).alias("x")).first().x == 35


def test_mask_email(spark):
    assert one(spark, S.mask_email(F.lit("abcdef@x.org"))) == "abcd***@x.org"
    assert one(spark, S.mask_email(F.lit("@x.org"))) is None


def use(i, c, o, r):
    return {"input": i, "cached": c, "output": o, "reasoning": r}


LINES = "file_path string, line_no long, ts string, model string, replay boolean, last struct<input:long,cached:long,output:long,reasoning:long>, total struct<input:long,cached:long,output:long,reasoning:long>"


def test_copied_history_is_skipped(spark):
    rows = [("f", 1, "2026-07-01T09:18:30.1Z", "m", True, use(1, 0, 1, 0), None), ("f", 2, "2026-07-01T09:18:30.9Z", "m", True, use(2, 0, 1, 0), None), ("f", 3, "2026-07-01T09:18:44Z", "m", True, use(30, 5, 4, 1), None)]
    got = [tuple(r)[4:] for r in D.counter_increments(spark.createDataFrame(rows, LINES)).collect()]
    assert got == [(25, 4, 0, 5, 1)]
    plain = [(*r[:4], False, *r[5:]) for r in rows]
    assert D.counter_increments(spark.createDataFrame(plain, LINES)).count() == 3


def fold(lines):
    """The counter rules as a plain loop."""
    out, prev = [], None
    for n, last, total in lines:
        low = prev and total and any(total[k] < prev[k] for k in total)
        if prev and total and total == prev:
            continue
        if low and last and (sum(total.values()) * 100 >= sum(prev.values()) * 98 or sum(total.values()) + 2 * sum(last.values()) >= sum(prev.values())) and min(map(lambda x: sum(x.values()), (last, total, prev))) > 0:
            continue
        d = last or (None if low else {k: total[k] - prev[k] for k in total} if total and prev else total)
        prev = total or prev
        if d and sum(d.values()):
            out.append((n, d["output"]))
    return out


def test_increments_against_a_loop(spark):
    import random

    rnd = random.Random(8)
    files, want = [], {}
    for f in range(60):
        total, lines = use(0, 0, 0, 0), []
        for n in range(rnd.randint(1, 14)):
            step = use(*(rnd.randint(0, 9) for _ in range(4)))
            kind = rnd.random()
            if kind < 0.15:
                total = {k: max(0, v - rnd.randint(0, 3)) for k, v in total.items()}
            elif kind < 0.25:
                total = use(*(rnd.randint(0, 3) for _ in range(4)))
            elif kind > 0.35:
                total = {k: v + step[k] for k, v in total.items()}
            lines.append((n, step if rnd.random() < 0.5 else None, dict(total) if rnd.random() < 0.8 else None))
        files += [(str(f), n, f"2026-01-01T00:00:{n:02d}", "m", False, a, b) for n, a, b in lines]
        want[str(f)] = fold(lines)
    got = {str(f): [] for f in range(60)}
    for r in D.counter_increments(spark.createDataFrame(files, LINES)).orderBy("file_path", "line_no").collect():
        got[r.file_path].append((r.line_no, r.output_tokens))
    assert got == want


def test_occurrence_suffix(spark):
    df = spark.createDataFrame([("d", "s", k, i) for i, k in enumerate("abaa")], "device string, source string, event_key string, line_no long")
    assert [r.event_key for r in D.occurrence_suffix_keys(df, ["line_no"]).orderBy("line_no").collect()] == ["a", "b", "a#1", "a#2"]


def test_cutoffs(spark):
    rows = spark.createDataFrame([("d", s, datetime(2026, 7, 17, 12, 0, 0) + timedelta(seconds=k)) for s in "xy" for k in (-1, 0, 1)], "device string, source string, event_time timestamp")
    cut = spark.createDataFrame([("d", "x", datetime(2026, 7, 17, 12))], "device string, source string, cutoff timestamp")
    got = D.filter_new_events(rows, cut).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in got} == {"x": 1, "y": 3}


PRICES = [("d1", "m", 1e-6, 2e-6, 1e-7, 1.25e-6)]


def priced(spark, i, o, w, r, think=0, model="m"):
    dim = P.read_price_dim(spark.createDataFrame(PRICES, "dataset string, model_key string, input double, output double, cache_read double, cache_write double"))
    facts = spark.createDataFrame([(model, i, o, w, r, think)], "model string, " + ", ".join(f"{c} long" for c in S.COUNTERS))
    resolved = P.resolve_prices(facts.select("model", F.lit(None).cast("string").alias("provider")), dim)
    return P.join_prices(facts, resolved).select(P.cost().cast("double").alias("cost"), P.cache_savings().cast("double").alias("saved")).first()


def test_cost_and_savings(spark):
    assert priced(spark, 1000, 500, 2000, 100_000).saved == pytest.approx(0.0895)
    assert priced(spark, 1000, 500, 0, 0).saved == 0
    assert priced(spark, 10, 10, 10, 10, model="nothing").cost == 0
    assert priced(spark, 0, 0, 0, 0).cost == 0


def test_price_lock(spark):
    schema = "device string, source string, usage_date date, model string, total_tokens long, cost double"
    past, today = date(2026, 7, 1), date(2026, 7, 10)
    old = spark.createDataFrame([("d", "s", past, "m", 12, 1.0), ("d", "s", today, "m", 12, 1.0)], schema).withColumn("pricing_locked_at", F.lit(None).cast("timestamp"))
    new = spark.createDataFrame([("d", "s", past, "m", 20, 99.0), ("d", "s", today, "m", 20, 2.0)], schema)
    out = {r.usage_date: r for r in M.merge_daily_price_locked(old, new, today, F.current_timestamp()).collect()}
    assert (out[past].total_tokens, out[past].cost, out[past].pricing_locked_at is None) == (20, 1.0, False)
    assert (out[today].total_tokens, out[today].cost, out[today].pricing_locked_at) == (20, 2.0, None)


def test_merges_are_idempotent(spark):
    rows = spark.range(401).selectExpr("'d' AS device", "'s' AS source", "CAST(id AS STRING) AS event_key", "id AS total_tokens")
    assert M.merge_events(M.merge_events(rows.limit(0), rows), rows).count() == 401
    runs = spark.range(1, 11).selectExpr("id")
    assert sorted(r.id for r in M.retain_newest(runs, 3).collect()) == [8, 9, 10]


def test_copy_of_older_tables(spark):
    old = spark.createDataFrame([("d", 1)], "device string, total_tokens long")
    out = M.copy_table(old, ["device", "total_tokens", "pricing_locked_at", "updated_at"], F.current_timestamp()).first()
    assert out.pricing_locked_at is None and out.updated_at is not None
    with pytest.raises(ValueError):
        M.copy_table(old, ["device", "source"], F.current_timestamp())


def test_totals_with_missing_savings(spark):
    rows = spark.createDataFrame([(100, 1.5), (50, 1.0), (0, None)], "total_tokens long, saved double")
    for c in S.COUNTERS:
        rows = rows.withColumn(c, F.lit(0).cast("long"))
    out = A.totals(rows.withColumn("cost", F.lit(0).cast("decimal(31,12)"))).first()
    assert (out.total, out.saved_usd) == (150, 2.5)


def test_streaks(spark):
    days = [(date(2024, 1, 1) + timedelta(days=i), int(c)) for i, c in enumerate("1101110011")]
    out = W.streaks(spark.createDataFrame(days, "usage_date date, value long")).first()
    assert (out.active, out.longest, out.current) == (7, 3, 2)


def test_periods():
    today = date(2024, 3, 15)
    assert W.period_bounds("month", today) == ((date(2024, 3, 1), today), (date(2024, 2, 1), date(2024, 2, 29)))
    assert W.period_bounds("week", today) == ((date(2024, 3, 9), today), (date(2024, 3, 2), date(2024, 3, 8)))
    assert W.period_bounds("prev", today)[0] == (date(2024, 2, 1), date(2024, 2, 29))
    assert W.range_preset("30d", today) == (date(2024, 2, 15), today)


def write(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    return str(folder)


def test_message_json_and_documents(spark, tmp_path):
    tokens = {"input": 10, "output": 2, "reasoning": 1, "cache": {"read": 3, "write": 4}}
    root = write(tmp_path / "a", "m1.json", [{"role": "assistant", "modelID": "M-X", "providerID": "x-ai", "sessionID": "s", "time": {"created": 1_700_000_000_000}, "tokens": tokens}])
    r = readers.read_message_json(spark, [root]).first()
    assert (r.event_key, r.session_id, r.model, r.provider, r.input_tokens, r.cache_read_tokens) == ("m1", "s", "m-x", "xai", 10, 3)
    doc = {"sessionId": "q", "messages": [{"type": "user"}, {"type": "gemini", "model": "g", "timestamp": "2026-01-01T00:00:00Z", "tokens": {"input": 100, "cached": 30, "output": 5, "thoughts": 2, "tool": 1, "total": 108}}]}
    r = readers.read_session_document(spark, [write(tmp_path / "b", "d.json", [doc])]).first()
    assert (r.session_id, r.input_tokens, r.cache_read_tokens, r.reasoning_output_tokens) == ("q", 71, 30, 2)


def test_stats_documents(spark):
    a = {"model": "h", "session_id": "s", "stats": {"models": {"m": {"tokens": {"prompt": 9, "candidates": 1, "cached": 4}}, "z": {"tokens": {}}}, "input_tokens": 99}}
    b = {"model": "h", "stats": {"models": {}, "input_tokens": 7, "output_tokens": 3}}
    rows = spark.createDataFrame([(json.dumps(x),) for x in (a, b)], "value string")
    assert sorted((r.model, r.input_tokens, r.output_tokens) for r in readers.read_stats_document(rows).collect()) == [("h", 7, 3), ("m", 5, 1)]


def test_agent_transcripts(spark, tmp_path):
    use_ = {"input": 5, "output": 6, "cacheRead": 7, "cacheWrite": 8, "cost": {"total": -1}}
    lines = [{"type": "model_change", "modelId": "a-1", "provider": "p"}, "", "{oops", {"type": "message", "message": {"role": "assistant", "timestamp": 1_700_000_000_000, "usage": use_}}, {"type": "custom", "customType": "model-snapshot", "data": {"modelId": "b-2"}}, {"type": "message", "message": {"role": "assistant", "usage": use_}}]
    rows = readers.read_agent_transcript(spark, [write(tmp_path / "c", "sess.jsonl.reset.1", lines)]).collect()
    assert sorted((r.session_id, r.model, r.provider, r.cache_read_tokens, r.recorded_cost) for r in rows) == [("sess", "a-1", "p", 7, 0.0), ("sess", "b-2", "p", 7, 0.0)]


def test_transcript_list(spark):
    files = spark.createDataFrame([("/r/a.jsonl",), ("/r/b.jsonl.deleted.2",), ("/r/c.txt",), ("/r/a.jsonl",)], "path string")
    index = spark.createDataFrame([("/r/a.jsonl", "named")], "path string, session_id string")
    assert sorted(tuple(r) for r in readers.list_transcript_files(files, index).collect()) == [("/r/a.jsonl", "named"), ("/r/b.jsonl.deleted.2", "b")]


def test_price_tables_and_feeds(spark):
    data = {"data": {"a": {"input_cost_per_token": 1e-6, "output_cost_per_token": 2e-6}, "none": {}}}
    got = readers.read_price_table(spark.createDataFrame([(json.dumps(data),)], "value string"), "d1").collect()
    assert [(r.model_key, float(r.input)) for r in got] == [("a", 1e-6)]
    feed = spark.createDataFrame([("v/m", "0.000001", "0.000002", [("V", "0.000003", "0.000004")]), ("v/n", "-1", "0.1", [])], "model_key string, list_prompt string, list_completion string, endpoints array<struct<provider_name:string,prompt:string,completion:string>>")
    assert [(r.model_key, float(r.input)) for r in P.normalise_price_feed(feed).collect()] == [("v/m", 3e-6)]


def test_quota_snapshots(spark):
    a = {"windows": {"five_hour": {"utilization": 95}, "extra_usage": {"utilization": 1}}}
    b = {"list": [{"window_seconds": 604800, "used_percent": 70}, {"window_seconds": 7200, "used_percent": 1}]}
    rows = spark.createDataFrame([("x", json.dumps(a)), ("y", json.dumps(b))], "tool string, value string")
    assert sorted((r.tool, r.window, r.tone) for r in readers.normalise_quota_snapshots(rows).collect()) == [("x", "five_hour", "bad"), ("y", "2_hour", "ok"), ("y", "seven_day", "warn")]


def test_session_summaries(spark):
    schema = "id string, model string, billing_provider string, started_at string, input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, reasoning_tokens long, actual_cost_usd double, estimated_cost_usd double"
    rows = spark.createDataFrame([("a", "m", "openai", "2026-01-01", 1, 0, 0, 0, 0, None, 0.5), ("b", " ", "x", None, 1, 0, 0, 0, 0, None, None), ("c", "m", "x", None, 0, 0, 0, 0, 0, None, None)], schema)
    assert [(r.session_id, r.recorded_cost) for r in readers.read_session_summary(rows).collect()] == [("a", 0.5)]
