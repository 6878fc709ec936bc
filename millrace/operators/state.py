"""Caches, admission, rate limits and circuit breakers as ordered folds over events.

Each function replays one key's events in order. Keys are the partitions: rows of a
key are sorted by (time, tie) and streamed, so that a long key needs no more memory
than its state."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replay(events: DataFrame, make: Callable[[], Callable[[dict], dict]], keys: list[str], order: list[str], inputs: list[str], outputs: str) -> DataFrame:
    """Events with the outputs of a state machine of each key: ``make`` gives a new one, which
    is called with the inputs of each event in order and returns the outputs."""
    from pyspark.sql.types import StructType

    names, added = events.columns, StructType.fromDDL(outputs)
    partitions = max(1, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not keys:
        raise ValueError("a state machine needs keys: without them all events would be one task's")
    dealt = events.repartition(partitions, *keys).sortWithinPartitions(*keys, *order)

    def work(batches: Iterator):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(added)
        before, step = None, None
        for batch in batches:
            key_columns = [batch.column(names.index(k)).to_pylist() for k in keys]
            columns = [batch.column(names.index(c)).to_pylist() for c in inputs]
            out = []
            for row in range(batch.num_rows):
                key = tuple(c[row] for c in key_columns)
                if step is None or key != before:
                    before, step = key, make()
                out.append(step({n: c[row] for n, c in zip(inputs, columns)}))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([o[f.name] for o in out], f.type) for f in kinds)], names=[*names, *kinds.names])

    return dealt.mapInArrow(work, StructType([*events.schema.fields, *added.fields]))


def seconds(ts: Column) -> Column:
    """A timestamp as seconds with microseconds."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


# --- result cache -----------------------------------------------------------


def ttl_cache(ttl: float):
    """Machine of one cache key: a hit while the entry written at the last miss lives."""

    def make():
        written = None

        def step(e):
            nonlocal written
            hit = written is not None and e["at"] - written <= ttl
            if not hit:
                written = e["at"]
            return {"hit": hit}

        return step

    return make


def cache_hits(events: DataFrame, keys: list[str], ttl: float = 120.0, ts_col: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events with ``hit``: whether the key's result was still kept (reading keeps 300 s)."""
    timed = events.withColumn("at", seconds(F.col(ts_col)))
    return replay(timed, ttl_cache(ttl), keys, ["at", tie], ["at"], "hit boolean").drop("at")


def hit_rates(hits: DataFrame, *by: str) -> DataFrame:
    """(…, hits, misses, hit_rate in percent); the rate is 0 without calls."""
    n = F.sum(F.when(F.col("hit"), 1).otherwise(0))
    m = F.sum(F.when(F.col("hit"), 0).otherwise(1))
    return hits.groupBy(*by).agg(n.alias("hits"), m.alias("misses"), F.coalesce(F.try_divide(100.0 * n, n + m), F.lit(0.0)).alias("hit_rate"))


def compute_once(rows: DataFrame, key: Column, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with the result of ``compute`` on the distinct keys' first rows: equal work is
    shared. ``compute`` keeps the column ``_key``."""
    keyed = rows.withColumn("_key", key)
    first = keyed.groupBy("_key").agg(F.first(F.struct(*rows.columns)).alias("r")).select("_key", "r.*")
    done = compute(first)
    extra = [c for c in done.columns if c not in rows.columns]
    return keyed.join(done.select(*extra), "_key").drop("_key")


def result_key(model: Column, parts: Column) -> Column:
    """Key of a model and content parts: text as it is, bytes by type and SHA-256."""
    one = lambda p: F.when(p["data"].isNotNull(), F.concat(F.lit("b:"), F.coalesce(p["mime_type"], F.lit("")), F.lit(":"), F.sha2(p["data"], 256))).otherwise(F.concat(F.lit("t:"), F.coalesce(p["text"], F.lit(""))))
    return F.sha2(F.concat(model, F.lit("|"), F.array_join(F.transform(parts, lambda p: F.concat(one(p), F.lit("|"))), ""), F.lit("||")), 256)


# --- loaded models ----------------------------------------------------------


def model_pool(capacity: int, keep_alive: float, pinned: tuple[str, ...] = ()):
    """Machine of a server's loaded models: (loaded, evicted) of each use. Models idle for
    keep_alive go, beyond the capacity the least recently used goes; pinned ones and
    those in use (a use lasts ``busy`` seconds) stay."""

    def make():
        last: OrderedDict[str, tuple[float, float]] = OrderedDict()

        def step(e):
            now, name = e["at"], e["model"]
            free = lambda m: m not in pinned and last[m][1] <= now
            gone = [m for m in last if free(m) and keep_alive > 0 and now - last[m][0] > keep_alive]
            for m in gone:
                del last[m]
            loaded = name not in last
            busy = now + (e["busy"] or 0.0)
            last[name] = (now, max(busy, last[name][1] if not loaded else busy))
            last.move_to_end(name)
            while capacity > 0 and len(last) > capacity:
                out = next((m for m in last if m != name and free(m)), None)
                if out is None:
                    break
                del last[out]
                gone.append(out)
            return {"loaded": loaded, "evicted": sorted(gone)}

        return step

    return make


def model_loads(events: DataFrame, keys: list[str], capacity: int = 0, keep_alive: float = 300.0, pinned: tuple[str, ...] = (), ts_col: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events (…, model[, busy]) with loaded and evicted."""
    timed = events.withColumn("at", seconds(F.col(ts_col)))
    timed = timed if "busy" in events.columns else timed.withColumn("busy", F.lit(0.0))
    out = replay(timed, model_pool(capacity, keep_alive, pinned), keys, ["at", tie], ["at", "model", "busy"], "loaded boolean, evicted array<string>")
    return out.select(*events.columns, "loaded", "evicted")


def in_use(events: DataFrame, key: str, delta: str = "delta", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Events with ``count``: uses of the key after each acquire (+1) or release (-1),
    never below zero. The floor is the running sum less its least value so far."""
    line = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("_s", F.sum(delta).over(line)).withColumn("count", F.col("_s") - F.least(F.min("_s").over(line), F.lit(0))).drop("_s")


# --- admission --------------------------------------------------------------


def admission(active: int, queued: int, timeout: float):
    """Machine of a server's queue: outcome, start and end of requests (at, service). At most
    ``active`` run (0: any number), at most ``queued`` wait (0: any number), and no one
    waits longer than ``timeout`` (0: for ever)."""

    def make():
        running: list[float] = []  # ends
        waiting: list[float] = []  # when those who wait will stop waiting

        def step(e):
            now, service = e["at"], e["service"]
            if active <= 0:
                return {"outcome": "processed", "start": now, "end": now + service}
            while running and running[0] <= now and len(running) >= active:
                heappop(running)
            while waiting and waiting[0] <= now:
                heappop(waiting)
            if len(running) < active:
                start = now
            else:
                if queued > 0 and len(waiting) >= queued:
                    return {"outcome": "rejected", "start": None, "end": None}
                start = running[0]
                if timeout > 0 and start - now > timeout:
                    heappush(waiting, now + timeout)
                    return {"outcome": "timed_out", "start": None, "end": None}
                heappop(running)
                heappush(waiting, start)
            heappush(running, start + service)
            return {"outcome": "processed", "start": start, "end": start + service}

        return step

    return make


def admit(events: DataFrame, keys: list[str], active: int, queued: int = 0, timeout: float = 0.0, service_col: str = "service", ts_col: str = "ts", tie: str = "event_id") -> DataFrame:
    """Requests with outcome (processed, rejected, timed_out), start and end."""
    timed = events.withColumn("at", seconds(F.col(ts_col))).withColumn("service", F.col(service_col).cast("double"))
    out = replay(timed, admission(active, queued, timeout), keys, ["at", tie], ["at", "service"], "outcome string, start double, end double")
    return out.drop("at") if "service" in events.columns else out.drop("at", "service")


# --- limits and breakers ----------------------------------------------------


def token_bucket(rate: float, burst: float):
    """Machine of one limit: full at first, refilled by the time passed, one token a request."""

    def make():
        tokens, last = float(burst), None

        def step(e):
            nonlocal tokens, last
            tokens = min(float(burst), tokens + (0.0 if last is None else (e["at"] - last) * rate))
            last = e["at"]
            allowed = tokens >= 1
            tokens -= allowed
            return {"allowed": allowed, "tokens": tokens}

        return step

    return make


def rate_limit(events: DataFrame, keys: list[str], rate: float, burst: float, ts_col: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events with allowed and the tokens left."""
    timed = events.withColumn("at", seconds(F.col(ts_col)))
    return replay(timed, token_bucket(rate, burst), keys, ["at", tie], ["at"], "allowed boolean, tokens double").drop("at")


def breaker(failures: int = 5, timeout: float = 30.0):
    """Machine of one endpoint: (state before, allowed) of calls with their success. After
    ``failures`` failed calls in a row it opens; after ``timeout`` one call tries; its
    success closes, its failure opens again."""

    def make():
        state, count, since = "closed", 0, 0.0

        def step(e):
            nonlocal state, count, since
            now, seen = e["at"], state
            if state == "open" and now - since > timeout:
                seen = "half_open"
            allowed = seen != "open"
            if allowed and e["success"]:
                state, count = "closed", 0
            elif allowed:
                count, since = count + 1, now
                if count >= failures or seen == "half_open":
                    state = "open"
            return {"state": seen, "allowed": allowed}

        return step

    return make


def circuit_breaker(events: DataFrame, keys: list[str], failures: int = 5, timeout: float = 30.0, success_col: str = "success", ts_col: str = "ts", tie: str = "event_id") -> DataFrame:
    """Calls with the breaker's state and whether they were let through."""
    timed = events.withColumn("at", seconds(F.col(ts_col)))
    out = replay(timed, lambda: _renamed(breaker(failures, timeout)(), success_col), keys, ["at", tie], ["at", success_col], "state string, allowed boolean")
    return out.drop("at")


def _renamed(step, success_col):
    return lambda e: step({"at": e["at"], "success": e[success_col]})
