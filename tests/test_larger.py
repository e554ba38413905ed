"""Tables with more rows and larger numbers than the smallest ones, and work that must not follow from how they are cut into files."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark import catalog
from tallyspark.plans import events, streams
from tallyspark.sources import readers
from tallyspark.streaming import facts, jobs
from tests.test_queries import SF, rows


def against_sql(spark, name, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    got = con.execute(catalog.ORACLE_SQL[name])
    want, have = rows([c[0] for c in got.description], got.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])


def copies(folder, select):
    duckdb.connect().execute(f"COPY (SELECT {select} FROM '{SF}/events.parquet' e, range(3) t(r)) TO '{folder}/events.parquet'")
    return folder


def test_payloads_of_devices_with_long_numbers(spark, tmp_path):
    """Users whose numbers share the nine digits that a device shows are devices of their own."""
    folder = copies(tmp_path, "event_id + r * 1000000000 AS event_id, ts, user_id + r * 1000000000 AS user_id, event_type, value, props")
    against_sql(spark, "T07_stream_ingest_payloads", folder)


@pytest.mark.parametrize("text", [True, False])
def test_a_frame_of_many_files_is_one_batch(spark, text):
    seen = []
    frames = [spark.range(1005).select(F.col("id").cast("string").alias("value")).repartition(1005)]
    read = (lambda path: jobs.stream_text_lines(spark, path, **streams.WHOLE)) if text else (lambda path: jobs.stream_log_lines(spark, path, frames[0].schema, **streams.WHOLE))
    streams.in_turn(frames, "files", lambda path: read(path).writeStream.foreachBatch(lambda b, n: seen.append((n, b.count()))), text=text)
    assert seen == [(0, 1005)]


def test_files_of_one_or_many_session_documents(spark, tmp_path):
    turn = lambda n: {"type": "gemini", "model": "g", "timestamp": "2024-01-01T00:00:00Z", "tokens": {"input": n, "output": 1}}
    files = {"one": {"sessionId": "a", "messages": [turn(1), {"type": "user"}]}, "many": [{"sessionId": "b", "messages": [turn(2)]}, {"sessionId": "c", "messages": [turn(3), turn(4)]}, {"sessionId": "d"}], "none": [], "odd": [{"sessionId": 5, "messages": 7}, {"sessionId": "e", "messages": [turn(5)]}]}
    for name, value in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=1))
    (tmp_path / "broken.json").write_text('[{"sessionId": "f", "messages": [')
    got = sorted((r.session_id, r.input_tokens) for r in readers.read_session_document(spark, [str(tmp_path)]).collect())
    assert got == [("a", 1), ("b", 2), ("c", 3), ("c", 4), ("e", 5)]


def test_session_documents_land_in_few_files(spark, tmp_path, monkeypatch):
    """As many files as the rows need, not one for every session."""
    monkeypatch.setattr("tallyspark.plans.more.DOCUMENTS", 300)
    monkeypatch.setattr(events, "scratch", lambda spark, name: str(tmp_path / name))
    against_sql(spark, "S06_read_session_document", SF)
    assert 2 <= len(list((tmp_path / "documents").glob("part-*.txt"))) <= 4  # of 1,000 events


def test_events_that_share_time_model_and_counters_are_all_collected(spark, tmp_path):
    """Different events, though the counter's reader takes lines that agree in all of these for one."""
    folder = copies(tmp_path, "event_id + r * 900000 AS event_id, ts, user_id, event_type, value, props")
    against_sql(spark, "E01_collect_sources", folder)


def test_collected_sources_land_in_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tallyspark.plans.collection.DOCUMENTS", 40)
    monkeypatch.setattr("tallyspark.plans.collection.LINES", 40)
    for module in ("events", "collection"):
        monkeypatch.setattr(f"tallyspark.plans.{module}.scratch", lambda spark, name: str(tmp_path / name))
    against_sql(spark, "E01_collect_sources", SF)
    for name in ("assistant", "counter", "messages", "documents", "stats", "turns", "agents"):
        assert 2 <= len(list((tmp_path / name).rglob("part-*.txt"))) <= 3, name  # of 111 events


def test_idle_lines_land_in_files_of_their_number(spark, tmp_path, monkeypatch):
    """A source without events whose lines grow with the table is no single file, and so no single task."""
    monkeypatch.setattr("tallyspark.plans.collection.LINES", 300)
    for module in ("events", "collection"):
        monkeypatch.setattr(f"tallyspark.plans.{module}.scratch", lambda spark, name: str(tmp_path / name))
    against_sql(spark, "M06_run_outcomes", SF)
    files = list((tmp_path / "idle").rglob("part-*.txt"))
    assert len(files) == 4 and sum(f.read_text().count("user") for f in files) == 1000


def test_changed_files_are_read_some_at_a_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(facts, "PATHS", 2)
    reads, scan = [], readers.scan_session_lines
    monkeypatch.setattr(readers, "scan_session_lines", lambda spark, roots, glob: reads.append(len(roots)) or scan(spark, roots, glob))
    logs, root = tmp_path / "logs", str(tmp_path / "facts")
    logs.mkdir()
    for i in range(5):
        (logs / f"{i}.jsonl").write_text(f"{i}\n{i}\n")
    for _ in range(2):  # the batch comes again after a failure
        assert facts.collect_changed(spark, str(logs), root, 0).count() == 5
        assert sorted(r.value for r in facts.stored(spark, root, "lines").collect()) == sorted("0011223344")
    assert reads == [2, 2, 1] * 2
    (logs / "3.jsonl").write_text("7\n")
    assert facts.collect_changed(spark, str(logs), root, 1).count() == 1 and reads[-1] == 1
    assert sorted(r.value for r in facts.stored(spark, root, "lines").collect()) == sorted("001122447")


def test_changed_files_of_many_users(spark, tmp_path, monkeypatch):
    """Few files for many users, one of whom loses the only line."""
    monkeypatch.setattr(streams, "LINES", 300)
    monkeypatch.setattr(streams, "scratch", lambda spark, name: str(tmp_path / name))
    duckdb.connect().execute(f"COPY (SELECT * FROM '{SF}/events.parquet' UNION ALL BY NAME SELECT * REPLACE (event_id + 1001 AS event_id, 400 AS user_id) FROM '{SF}/events.parquet' WHERE event_id = 0) TO '{tmp_path}/events.parquet'")
    against_sql(spark, "T01_changed_log_files", tmp_path)
    assert len(list((tmp_path / "changing").rglob("part-*.txt"))) <= 12
