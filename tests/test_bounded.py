"""Work that is bounded by keys or sessions, not by the whole input."""

from pyspark.sql import functions as F

from tallyspark.operators import topk as K
from tallyspark.plans import streams

SF = "/root/testdata/sf0.001"


def test_top_n_with_rest_puts_no_window_over_all_keys(spark):
    rows = spark.range(1000).selectExpr("CAST(id % 100 AS STRING) AS k", "CAST(id % 100 % 50 AS BIGINT) AS total_tokens", "CAST(1 AS DECIMAL(38, 12)) AS cost")
    out = K.top_n_with_rest(rows, "k", 8)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.key: (r.total, r.cost_usd, r.members) for r in out.collect()}
    named = ["49", "99", "48", "98", "47", "97", "46"]
    assert {k: got[k] for k in named} == {k: (int(k) % 50 * 10, 10.0, 1) for k in named}
    assert got.keys() == {*named, "rest"} and got["rest"] == (24500 - sum(got[k][0] for k in named), 930.0, 93)
    assert {r.key for r in K.top_n_with_rest(rows.where("k IN ('1', '2')"), "k", 2).collect()} == {"1", "2"}


def test_push_payloads_hold_a_device_each(spark):
    rows = streams._pushed(spark, SF)
    sent = streams.push_payloads(rows, F.lit("full"), F.current_timestamp())
    assert sent.count() == rows.select("device").distinct().count() == rows.select("user_id").distinct().count()
