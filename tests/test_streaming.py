"""Streams give what the batch forms give."""

import datetime as dt

import pytest

from millrace.operators import state
from millrace.streaming import stateful


def drain(frame, name, mode="append"):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return frame.sparkSession.table(name)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i * 7 % 60 + i), f"u{i % 3}", i % 5 > 1) for i in range(120)]
    path = str(tmp_path_factory.mktemp("events"))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user string, success boolean").coalesce(1)
    df.write.mode("overwrite").parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def test_rate_limit(events):
    batch, stream = events
    got = {r.event_id: r.allowed for r in drain(stateful.rate_limit(stream, "user", 0.2, 3), "limit").collect()}
    assert got == {r.event_id: r.allowed for r in state.rate_limit(batch, ["user"], 0.2, 3).collect()}


def test_breaker(events):
    batch, stream = events
    got = {r.event_id: (r.state, r.allowed) for r in drain(stateful.circuit_breaker(stream, "user", 2, 10.0), "breaker").collect()}
    assert got == {r.event_id: (r.state, r.allowed) for r in state.circuit_breaker(batch, ["user"], 2, 10.0).collect()}


def test_repeats_and_windows(events):
    _, stream = events
    assert drain(stateful.drop_repeats(stream, ["user"]), "repeats").count() == 3
    assert drain(stateful.windowed_counts(stream, "1 minute", "user"), "windows", "append").columns == ["start", "user", "total"]


def test_tool_calls(spark, tmp_path):
    text = "x <start_function_call>f{a:1}<end_function_call> y <start_function_call>g{}<end_function_call>"
    rows = [(k, i, text[i : i + 4]) for k in (1, 2) for i in range(0, len(text), 4)]
    df = spark.createDataFrame(rows, "id long, pos int, token string")
    df.where("pos < 40").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stateful.tool_calls(stream).writeStream.outputMode("append").format("memory").queryName("tools").start()
    q.processAllAvailable()
    df.where("pos >= 40").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("tools").collect()) == [(k, n, a) for k in (1, 2) for n, a in (("f", '{"a":1}'), ("g", "{}"))]


def test_a_key_of_many_frames(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i * 7919 % 25_000), "u", i * 31 % 7 > 2) for i in range(25_000)]
    batch = spark.createDataFrame(rows, "event_id long, ts timestamp, user string, success boolean").coalesce(1)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = {r.event_id: r.allowed for r in drain(stateful.rate_limit(stream, "user", 0.2, 3), "limit_many").collect()}
    assert got == {r.event_id: r.allowed for r in state.rate_limit(batch, ["user"], 0.2, 3).collect()}
    got = {r.event_id: (r.state, r.allowed) for r in drain(stateful.circuit_breaker(stream, "user", 2, 10.0), "breaker_many").collect()}
    assert got == {r.event_id: (r.state, r.allowed) for r in state.circuit_breaker(batch, ["user"], 2, 10.0).collect()}


def test_states_end(events, spark):
    _, stream = events
    out = stateful.rate_limit(stream, "user", 5.0, 3, delay="0 seconds")
    q = out.writeStream.outputMode("append").format("memory").queryName("ending").start()
    q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    assert spark.table("ending").count() == 120 and left < 3
