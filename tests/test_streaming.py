from __future__ import annotations

from fathomline.operators import index
from fathomline.streaming import refresh


def test_index_stream_takes_the_latest_state(spark, tmp_path):
    schema = "key string, name string, text string, mtime double"
    inbox, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([("a", "a", "alpha beta", 1.0), ("b", "b", "gamma", 1.0), ("c", "c", None, 1.0)], schema).write.parquet(inbox)
    refresh.index_stream(refresh.arriving(spark, inbox, schema), out, mark).awaitTermination()
    spark.createDataFrame([("a", "a", "delta", 2.0)], schema).write.mode("append").parquet(inbox)
    refresh.index_stream(refresh.arriving(spark, inbox, schema), out, mark).awaitTermination()
    got = {(r["key"], r["term"]) for r in index.load(spark, out).postings.collect()}
    assert ("a", "delta") in got and ("b", "gamma") in got and ("a", "alpha") not in got
    # a batch that is run again or comes late changes nothing, and refresh() goes on from the same index
    number = index._manifest(spark, out)["newest"]
    assert index.upsert(spark, out, spark.createDataFrame([("a", "a", "alpha", 1.0), ("b", "b", "gamma", 1.0)], schema)) == number
    live = spark.createDataFrame([("a", "a", "delta", 2.0), ("b", "b", "gamma", 1.0)], schema)
    assert index.index_state(spark, out, live)["pending"] == 1 and index.refresh(spark, out, live)["state"] == "ready"
    assert [r["status"] for r in index.unreadable(spark, out).collect()] == []


def test_sessions_and_windows(spark):
    rows = [(1, "2026-01-01 10:00:00", "x", 1.0), (1, "2026-01-01 10:20:00", "x", 2.0), (1, "2026-01-01 11:00:00", "y", 3.0)]
    events = spark.createDataFrame(rows, "user_id long, t string, event_type string, value double").selectExpr("user_id", "cast(t as timestamp) ts", "event_type", "value")
    assert sorted(r["n"] for r in refresh.sessions(events).collect()) == [1, 2]
    assert {(r["event_type"], r["n"], r["total"]) for r in refresh.windowed_activity(events).collect()} == {("x", 2, 3.0), ("y", 1, 3.0)}
