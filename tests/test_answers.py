"""Streams of answers, endpoints and events against plain folds over all rows."""

import datetime as dt
import glob
import os
import random
import shutil

import pandas as pd
import pytest

from millrace.streaming import answers, event_log

START = dt.datetime(2024, 1, 1)
at = lambda s: START + dt.timedelta(seconds=s)


def replay(spark, tmp_path, rows, schema, parts):
    """A stream of files, one a micro-batch, over rows in order of time."""
    rows = sorted(rows, key=lambda r: r[1])
    cut = [len(rows) * k // parts for k in range(parts + 1)]
    for k in range(parts):
        spark.createDataFrame(rows[cut[k] : cut[k + 1]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def drain(stream, path):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/out").collect()


def plain_answers(rows, stall, clock):
    out = {}
    for key in {r[0] for r in rows if r[0] is not None}:
        got, ahead, nxt, last, closed = [], {}, 0, None, False
        own = sorted([r for r in rows if r[0] == key and r[3] in ("token", "end", "error", "cancel")], key=lambda r: (r[1], -1 if r[2] is None else r[2], r[3]))
        for _, ts, pos, kind, text in [*own, (key, clock, None, "clock", None)]:
            if closed:
                break
            if last is not None and (ts - last).total_seconds() > stall:
                got.append((nxt, "error", f"token {nxt} is missing" if ahead else f"no token for {stall:g} s"))
                closed = True
            elif kind == "error" or kind == "cancel":
                got.append((nxt, "error" if kind == "error" else "cancelled", text if kind == "error" else None))
                closed = True
            elif kind in ("token", "end") and pos is not None and pos >= nxt:
                ahead.setdefault(pos, (kind, text))
                while not closed and nxt in ahead:
                    k, t = ahead.pop(nxt)
                    got.append((nxt, "done" if k == "end" else "delta", t))
                    closed = k == "end"
                    nxt += k != "end"
            last = ts
        out[key] = got
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("parts", [1, 4])
def test_answers(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = []
    for k in range(40):
        begin, n = rng.randrange(200), rng.randrange(1, 9)
        order = list(range(n))
        if rng.random() < 0.4:
            rng.shuffle(order)
        times = sorted(rng.uniform(0, 60) * (k % 3) + begin for _ in order)
        rows += [(f"a{k}", at(round(t, 3)), p, "token", f"w{p}") for t, p in zip(times, order) if rng.random() > 0.08]
        rows += [(f"a{k}", at(round(times[0], 3)), 0, "token", "again")] if rng.random() < 0.3 else []
        tail = rng.choice(["end", "end", "error", "cancel", None])
        if tail:
            rows.append((f"a{k}", at(round(rng.choice(times) + rng.choice([0.5, 2]), 3)), n if tail == "end" else None, tail, "broken" if tail == "error" else None))
    rows += [("a1", at(400), None, "token", "no place"), (None, at(3), 0, "token", "x"), ("clock", at(900), None, "clock", None), ("clock", at(2000), None, "clock", None)]
    got = {}
    for r in drain(answers.answer_stream(replay(spark, tmp_path, rows, answers.INCOMING, parts), 30, 5000), tmp_path):
        got.setdefault(r.id, []).append((r["index"], r.kind, r.text))
    want = plain_answers(rows, 30, at(1990))
    order = lambda v: sorted(v, key=lambda x: (x[0], x[1] != "delta"))
    assert {k: order(v) for k, v in got.items()} == want
    kinds = {v[-1][1] for v in want.values()}
    assert kinds >= {"done", "error", "cancelled"} and any("missing" in str(v[-1][2]) for v in want.values())


def test_ended_answers_are_forgotten(spark, tmp_path):
    rows = [(f"a{k}", at(k), 0, "end", None) for k in range(50)] + [("clock", at(900), None, "clock", None), ("clock", at(5000), None, "clock", None)]
    q = answers.answer_stream(replay(spark, tmp_path, rows, answers.INCOMING, 3), 30, 60).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


@pytest.mark.parametrize("parts", [1, 5])
def test_endpoints(spark, tmp_path, parts):
    rng = random.Random(parts)
    kind = "endpoint string, ts timestamp, models array<string>"
    rows = [(f"e{rng.randrange(4)}", at(rng.randrange(4000)), rng.choice([None, [], rng.sample(["a", "b", "c"], rng.randint(1, 3)), ["a", "a", None]])) for _ in range(80)] + [("late", at(10_000), ["z"]), ("late", at(10_500), ["z"]), (None, at(5), ["n"])]
    got = sorted((r.endpoint, r.ts, tuple(r.added), tuple(r.removed), r.gone) for r in drain(answers.endpoint_models(replay(spark, tmp_path, rows, kind, parts), 300), tmp_path))
    want = []
    for e in ("e0", "e1", "e2", "e3", "late"):
        last, known = None, []
        for ts, models in [*sorted((ts, sorted({m for m in ms or [] if m})) for k, ts, ms in rows if k == e), (at(10_490), None)]:
            if last is not None and (ts - last).total_seconds() > 300:
                want.append((e, last + dt.timedelta(seconds=300), (), tuple(known), True))
                last, known = None, []
            if models is None:
                break
            added, removed = tuple(m for m in models if m not in known), tuple(m for m in known if m not in models)
            if last is None or added or removed:
                want.append((e, ts, added, removed, False))
            last, known = ts, models
    want = [w for w in want if not (w[0] == "late" and w[4] and w[1] > at(10_490))]
    assert got == sorted(want)


def events(spark, tmp_path, k):
    spark.createDataFrame([(f"e{k}", i, f"data: {k}é\n\n") for i in range(5)], event_log.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")


def run_log(spark, tmp_path):
    stream = spark.readStream.schema(event_log.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    event_log.log_events(stream, f"{tmp_path}/log", f"{tmp_path}/cp").awaitTermination()
    return sorted((r.id, r["index"], r.data) for r in event_log.read_log(spark, f"{tmp_path}/log").collect())


def forget_last_commit(tmp_path):
    os.remove(max(glob.glob(f"{tmp_path}/cp/commits/[0-9]*"), key=lambda p: int(os.path.basename(p))))
    for crc in glob.glob(f"{tmp_path}/cp/commits/.*.crc"):
        os.remove(crc)


def test_a_restart_repeats_and_loses_nothing(spark, tmp_path):
    (tmp_path / "log").mkdir()
    assert event_log.read_log(spark, f"{tmp_path}/log").count() == 0
    want = []
    for k in range(3):
        events(spark, tmp_path, k)
        want += [(f"e{k}", i, f"data: {k}é\n\n") for i in range(5)]
        assert run_log(spark, tmp_path) == want
    # killed after the sink's commit and before Spark's: the batch runs again
    forget_last_commit(tmp_path)
    assert run_log(spark, tmp_path) == want
    # killed before the sink's commit, with rubbish of tasks that never committed
    forget_last_commit(tmp_path)
    shutil.rmtree(max(glob.glob(f"{tmp_path}/log/epoch-*")))
    (tmp_path / "log/_staged/epoch-000000000002-x").mkdir(parents=True)
    (tmp_path / "log/_staged/part-dead.jsonl").write_text("{}")
    assert len(event_log.read_log(spark, f"{tmp_path}/log").collect()) == 10
    assert run_log(spark, tmp_path) == want
    assert os.listdir(tmp_path / "log/_staged") == []


def test_a_new_key_asks_for_no_timers():
    class Handle:
        value, asked, timers = None, 0, []

        def getValueState(self, *_):
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def listTimers(self):
            self.asked += 1
            return iter(self.timers)

        def deleteTimer(self, at):
            self.timers.remove(at)

        def registerTimer(self, at):
            self.timers.append(at)

    step, handle = answers._Endpoint(1000), Handle()
    step.init(handle)
    for second, asked in ((1, 0), (2, 1)):
        rows = pd.DataFrame({"endpoint": ["a"], "ts": [pd.Timestamp(second, unit="s")], "models": [["m"]]})
        list(step.handleInputRows(("a",), iter([rows]), None))
        assert handle.asked == asked and handle.timers == [second * 1000 + 1001]
