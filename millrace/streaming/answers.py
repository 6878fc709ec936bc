"""Answers as streams: tokens with their end, errors, cancels and stalls; endpoints that fall silent.

Both keep one small value a key and act on event time: what has to happen without any
row (a stall, a silent endpoint) is done by a timer of the key once the watermark has
passed, and by the next row of the key if that comes first, with the same result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Rows of an answer that comes in: kind is token, end, error or cancel; other kinds only move the clock.
INCOMING = "id string, ts timestamp, pos int, kind string, text string"
#: Rows that go out: delta, then one of done, error or cancelled.
OUTGOING = "id string, index int, kind string, text string"
#: Rows of changes of an endpoint's models; ``gone`` where it was silent for too long.
CHANGE = "endpoint string, ts timestamp, added array<string>, removed array<string>, gone boolean"


def use_state_store(spark: SparkSession) -> None:
    """Timers and typed state need the RocksDB state store in this session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(column: pd.Series) -> list[int]:
    return (column.astype("datetime64[ns]").astype("int64") // 1_000_000).tolist()


def _column(values: list) -> pd.Series:
    """Values as they are, whatever pandas would make of them."""
    return pd.Series(values, dtype=object)


class _Timed(StatefulProcessor):
    """Holds one JSON value a key and its next timer."""

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "value string")

    def _load(self):
        held = self.held.get()  # a call to the state store each; exists() would be one more
        return None if held is None else json.loads(held[0])

    def _save(self, value, timer: int, new: bool = False) -> None:
        """Holds the value and a timer in place of the key's other one; a new key has none."""
        for old in [] if new else list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.held.update((json.dumps(value),))
        self.handle.registerTimer(timer)

    def close(self) -> None:
        pass


class _Answer(_Timed):
    def __init__(self, stall: int, keep: int):
        self.stall, self.keep = stall, keep

    def _late(self, a: dict, out: list) -> None:
        """The error in place of silence."""
        why = f"token {a['next']} is missing" if a["ahead"] else f"no token for {self.stall / 1000:g} s"
        out.append((a["next"], "error", why))
        a["closed"] = True

    def _step(self, a: dict, at: int, pos, kind: str, text, out: list) -> None:
        if a["closed"]:
            return
        if a["at"] is not None and at - a["at"] > self.stall:
            self._late(a, out)
            return
        if kind in ("error", "cancel"):
            out.append((a["next"], "error" if kind == "error" else "cancelled", text if kind == "error" else None))
            a["closed"] = True
        elif kind in ("token", "end") and pos is not None and pos >= a["next"]:
            a["ahead"].setdefault(str(int(pos)), [kind, text])
            while not a["closed"] and (now := a["ahead"].pop(str(a["next"]), None)):
                out.append((a["next"], "done" if now[0] == "end" else "delta", now[1]))
                a["closed"] = now[0] == "end"
                a["next"] += now[0] != "end"
        a["at"] = at if a["at"] is None else max(a["at"], at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._load(), []
        a = held or {"next": 0, "ahead": {}, "closed": False, "at": None}
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "pos", "kind"], kind="stable")
        frame = frame[frame["kind"].isin(["token", "end", "error", "cancel"])]
        if frame.empty:
            return
        for at, pos, kind, text in zip(_millis(frame["ts"]), frame["pos"], frame["kind"], frame["text"]):
            self._step(a, at, None if pd.isna(pos) else int(pos), kind, text, out)
        last = a["at"] if a["at"] is not None else 0
        self._save(a, last + (self.keep if a["closed"] else self.stall) + 1, held is None)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        a, out = self._load(), []
        if a is None or a["closed"]:
            self.held.clear()
            return
        self._late(a, out)
        self._save(a, a["at"] + self.stall + self.keep + 1)
        yield self._rows(key, out)

    @staticmethod
    def _rows(key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"id": _column([key[0]] * len(out)), "index": pd.array([o[0] for o in out], "Int32"), "kind": _column([o[1] for o in out]), "text": _column([o[2] for o in out])})


def answer_stream(rows: DataFrame, stall_seconds: float = 30, keep_seconds: float = 600, delay: str = "10 seconds") -> DataFrame:
    """Rows of OUTGOING of a stream of INCOMING rows, which come in any order within ``delay``.

    Tokens leave in order of ``pos`` from 0, each once, whatever the order in which they come;
    one that comes before its turn waits. An answer ends with its end row, with an error row
    (its text is passed on), with a cancel, or with an error of its own once nothing came for
    ``stall_seconds`` of event time (or a missing token kept others waiting for so long).
    What comes after the end is ignored; that an answer has ended is known for ``keep_seconds``.
    Rows of null id are left out; a token without ``pos`` is no token."""
    use_state_store(rows.sparkSession)
    given = rows.where("id is not null").select("id", "ts", "pos", "kind", "text").withWatermark("ts", delay)
    step = _Answer(int(stall_seconds * 1000), int(keep_seconds * 1000))
    return given.groupBy("id").transformWithStateInPandas(statefulProcessor=step, outputStructType=OUTGOING, outputMode="Append", timeMode="EventTime")


class _Endpoint(_Timed):
    def __init__(self, ttl: int):
        self.ttl = ttl

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, out = self._load(), []
        new = state is None
        frame = pd.concat(list(rows), ignore_index=True)
        frame["_m"] = [sorted({m for m in (ms if ms is not None else []) if m is not None}) for ms in frame["models"]]
        frame["_t"] = _millis(frame["ts"])
        for at, models in sorted(zip(frame["_t"], frame["_m"])):
            if state is not None and at - state[0] > self.ttl:
                out.append((state[0] + self.ttl, [], state[1], True))
                state = None
            known = state[1] if state is not None else []
            added, removed = [m for m in models if m not in known], [m for m in known if m not in models]
            if state is None or added or removed:
                out.append((at, added, removed, False))
            state = (at if state is None else max(at, state[0]), models)
        self._save(state, state[0] + self.ttl + 1, new)
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if (state := self._load()) is not None:
            self.held.clear()
            yield self._rows(key, [(state[0] + self.ttl, [], state[1], True)])

    @staticmethod
    def _rows(key, out: list) -> pd.DataFrame:
        return pd.DataFrame({"endpoint": _column([key[0]] * len(out)), "ts": pd.to_datetime([o[0] for o in out], unit="ms"), "added": _column([o[1] for o in out]), "removed": _column([o[2] for o in out]), "gone": [o[3] for o in out]})


def endpoint_models(reports: DataFrame, ttl_seconds: float, delay: str = "10 seconds") -> DataFrame:
    """Rows of CHANGE of a stream of reports (endpoint, ts, models): what each report adds and
    takes away, and all of an endpoint's models once it has not reported for ``ttl_seconds``.

    Every first report is a row (it may add nothing); later ones are rows only if something
    changes. Null models are none, null endpoints are left out, equal times are taken in order
    of the models. State is the last report of an endpoint and goes with it."""
    use_state_store(reports.sparkSession)
    given = reports.where("endpoint is not null").select("endpoint", "ts", F.col("models").cast("array<string>").alias("models")).withWatermark("ts", delay)
    return given.groupBy("endpoint").transformWithStateInPandas(statefulProcessor=_Endpoint(int(ttl_seconds * 1000)), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime")
