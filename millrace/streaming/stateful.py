"""Structured Streaming forms of the stateful operators.

State is keyed and small: a buffer of text, a bucket of tokens, a breaker. Rows of a
key within a micro-batch are taken in order of (time, tie); across micro-batches in
the order of arrival, as a stream gives no other."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.generation import ToolParser, ToolTokens


def in_order(frames, by: list[str]):
    """The rows of a key in a micro-batch as one frame in order; Spark hands them over in
    frames of spark.sql.execution.arrow.maxRecordsPerBatch rows, sorted or not."""
    frames = list(frames)
    if frames:
        yield pd.concat(frames, ignore_index=True).sort_values(by, kind="stable")


def drop_repeats(events: DataFrame, keys: list[str], ts_col: str = "ts", delay: str = "2 minutes") -> DataFrame:
    """The first event of each key; state lives for ``delay`` of event time."""
    return events.withWatermark(ts_col, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, width: str, *labels: str, ts_col: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """(start, labels, total) of tumbling windows, late events up to ``delay``."""
    counted = events.withWatermark(ts_col, delay).groupBy(F.window(ts_col, width).alias("w"), *labels).agg(F.count("*").alias("total"))
    return counted.select(F.col("w.start").alias("start"), *labels, "total")


def rate_limit(events: DataFrame, key: str, rate: float, burst: float, ts_col: str = "ts", tie: str = "event_id", delay: str | None = None) -> DataFrame:
    """(key, tie, ts, allowed) by a token bucket for each key.

    With ``delay`` events may be that late (later ones are dropped, as by any watermark),
    and a key's state ends when its bucket would be full again, which changes no result.
    Without it every event counts and a key keeps its two numbers for ever."""
    kinds = dict(events.dtypes)

    ends = delay is not None and rate > 0

    def step(name, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (float(burst), None)
        for frame in in_order(frames, [ts_col, tie]):
            allowed = []
            for at in frame[ts_col].astype("datetime64[ns]").astype("int64") / 1e9:
                tokens = min(float(burst), tokens + (0.0 if last is None else max(at - last, 0.0) * rate))
                last = at if last is None else max(at, last)
                allowed.append(tokens >= 1)
                tokens -= tokens >= 1
            yield pd.DataFrame({key: frame[key], tie: frame[tie], ts_col: frame[ts_col], "allowed": allowed})
        state.update((float(tokens), last))
        if ends and last is not None:
            state.setTimeoutTimestamp(max(int((last + burst / rate) * 1000) + 1, state.getCurrentWatermarkMs() + 1))

    out = f"{key} {kinds[key]}, {tie} {kinds[tie]}, {ts_col} timestamp, allowed boolean"
    rows = events.select(key, tie, ts_col)
    rows = rows.withWatermark(ts_col, delay) if ends else rows
    return rows.groupBy(key).applyInPandasWithState(step, out, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout if ends else GroupStateTimeout.NoTimeout)


def tool_calls(tokens: DataFrame, key: str = "id", pos_col: str = "pos", token_col: str = "token", marks: ToolTokens = ToolTokens()) -> DataFrame:
    """(key, name, arguments) of each call as soon as its last token comes; a key's text
    that may still become part of a call waits in its state, which ends when there is none."""

    def step(name, frames, state: GroupState):
        parser = ToolParser(marks)
        parser.buffer = state.get[0] if state.exists else ""
        for frame in in_order(frames, [pos_col]):
            calls = [c for t in frame[token_col] for c in parser.feed(t)]
            yield pd.DataFrame({key: [name[0]] * len(calls), "name": [c[0] for c in calls], "arguments": [c[1] for c in calls]})
        if parser.buffer:
            state.update((parser.buffer,))
        elif state.exists:
            state.remove()

    out = f"{key} {dict(tokens.dtypes)[key]}, name string, arguments string"
    return tokens.groupBy(key).applyInPandasWithState(step, out, "buffer string", "append", GroupStateTimeout.NoTimeout)


def circuit_breaker(calls: DataFrame, key: str, failures: int = 5, timeout: float = 30.0, success_col: str = "success", ts_col: str = "ts", tie: str = "event_id") -> DataFrame:
    """(key, tie, state, allowed) of each endpoint's calls. An endpoint that is closed and
    without failures has no state."""
    kinds = dict(calls.dtypes)

    def step(name, frames, state: GroupState):
        mode, count, since = state.get if state.exists else ("closed", 0, 0.0)
        for frame in in_order(frames, [ts_col, tie]):
            seen, allowed = [], []
            for now, good in zip(frame[ts_col].astype("datetime64[ns]").astype("int64") / 1e9, frame[success_col]):
                at = "half_open" if mode == "open" and now - since > timeout else mode
                seen.append(at)
                allowed.append(at != "open")
                if at != "open":
                    if good:
                        mode, count = "closed", 0
                    else:
                        count, since = count + 1, now
                        mode = "open" if count >= failures or at == "half_open" else mode
            yield pd.DataFrame({key: frame[key], tie: frame[tie], "state": seen, "allowed": allowed})
        if mode != "closed" or count:
            state.update((mode, count, float(since)))
        elif state.exists:
            state.remove()

    out = f"{key} {kinds[key]}, {tie} {kinds[tie]}, state string, allowed boolean"
    return calls.select(key, tie, ts_col, success_col).groupBy(key).applyInPandasWithState(step, out, "mode string, count int, since double", "append", GroupStateTimeout.NoTimeout)


def emit_events(chunks: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each micro-batch of stream chunks to ``send`` in order of id and index."""
    return chunks.writeStream.foreachBatch(lambda batch, epoch: send(batch.sortWithinPartitions("id", "index"), epoch)).option("checkpointLocation", checkpoint).start()
