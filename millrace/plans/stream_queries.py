"""Queries over replayed streams: a table's rows as a stream that is run until it has no more."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import generation
from millrace.plans.registry import query, table
from millrace.sources.stores import new_folder
from millrace.streaming import answers, event_log


def _replayed(rows):
    spark, path = rows.sparkSession, new_folder(rows.sparkSession, "replay")
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _run(spark, start):
    """Start a query with a state partition a core (a stream keeps their number) and wait for its end."""
    key, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    before = spark.conf.get(key)
    spark.conf.set(key, str(cores))
    try:
        running = start()
    finally:
        spark.conf.set(key, before)
    running.awaitTermination()


def _logged(stream):
    spark = stream.sparkSession
    path, checkpoint = new_folder(spark, "log"), new_folder(spark, "log-checkpoint")
    _run(spark, lambda: event_log.log_events(stream, path, checkpoint))
    return event_log.read_log(spark, path)


@query("""WITH t AS (SELECT conv_id || '-' || turn AS id, role AS model, string_split(replace(replace(replace(coalesce(text, ''), chr(10), ' '), '"', ''), '\\', ''), ' ') AS w FROM conversations),
    e AS (SELECT id, 0 AS index, '{"id":"' || id || '","object":"chat.completion.chunk","created":0,"model":"' || model || '","choices":[{"index":0,"delta":{"role":"assistant"}}]}' AS d FROM t
        UNION ALL SELECT id, CAST(i + 1 AS INTEGER), '{"id":"' || id || '","object":"chat.completion.chunk","created":0,"model":"' || model || '","choices":[{"index":0,"delta":{"content":"' || w[i + 1] || '"}}]}' FROM t, unnest(range(len(w))) r(i)
        UNION ALL SELECT id, CAST(len(w) + 1 AS INTEGER), '{"id":"' || id || '","object":"chat.completion.chunk","created":0,"model":"' || model || '","choices":[{"index":0,"delta":{},"finish_reason":"stop"}]}' FROM t
        UNION ALL SELECT id, CAST(len(w) + 2 AS INTEGER), '[DONE]' FROM t)
    SELECT id, index, 'data: ' || d || chr(10) || chr(10) AS data FROM e""")
def r016_event_log(spark, sf_dir):
    """Turns as events of streamed answers, committed by a sink and read back."""
    clean = F.regexp_replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), r'["\\]', "")
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("model"), clean.alias("text"))
    stream = _replayed(rows).select("id", "model", F.split("text", " ", -1).alias("tokens"))
    return _logged(generation.stream_chunks(stream))


#: Seconds without a token after which an answer has stalled, what an endpoint may be silent.
STALL, SILENCE = 30, 6 * 3600


@query(f"""WITH t AS (SELECT conv_id || '-' || turn AS id, conv_id % 5 AS c, string_split(coalesce(text, ''), ' ') AS w FROM conversations),
    n AS (SELECT id, c, w, len(w) AS n, len(w) // 2 AS k FROM t),
    m AS (SELECT *, CASE WHEN c IN (1, 2) THEN k + 1 WHEN c = 3 THEN k ELSE n END AS sent FROM n),
    e AS (SELECT id, unnest(range(sent)) AS index, unnest(list_transform(w[:sent], lambda x: 'delta:' || x)) AS data FROM m
        UNION ALL SELECT id, sent, CASE c WHEN 0 THEN 'done:' WHEN 1 THEN 'cancelled:' WHEN 2 THEN 'error:out of memory' WHEN 3 THEN 'error:token ' || k || ' is missing' ELSE 'error:no token for {STALL} s' END FROM m)
    SELECT id, CAST(index AS INTEGER) AS index, data FROM e""")
def r149_answer_stream(spark, sf_dir):
    """Every turn is an answer, a word a token: whole, cancelled or broken half way, with a token lost,
    or with each token twice and no end."""
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    c, n = F.col("conv_id") % 5, F.size("w")
    base = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), c.alias("c"), words.alias("w")).withColumn("k", F.floor(n / 2).cast("int"))
    after = lambda millis: F.timestamp_millis(F.lit(1_704_067_200_000) + millis)
    row = lambda at, pos, kind, text: F.struct(after(at).alias("ts"), pos.cast("int").alias("pos"), F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    token = lambda w, i: row(i * 10, i, "token", w)
    none = F.lit(None)
    tokens = F.filter(F.transform("w", token), lambda t: (F.col("c") != 3) | (t["pos"] != F.col("k")))
    tail = (F.when(c_is(0) | c_is(3), F.array(row(n * 10, n, "end", none))).when(c_is(1), F.array(row(F.col("k") * 10 + 5, none, "cancel", none)))
            .when(c_is(2), F.array(row(F.col("k") * 10 + 5, none, "error", F.lit("out of memory")))).otherwise(tokens))
    rows = base.select("id", F.explode(F.concat(tokens, tail)).alias("r")).select("id", "r.*")
    clock = spark.range(1).select(F.lit("clock").alias("id"), F.lit("2100-01-01").cast("timestamp").alias("ts"), none.cast("int").alias("pos"), F.lit("clock").alias("kind"), none.cast("string").alias("text"))
    out = answers.answer_stream(_replayed(rows.unionByName(clock)), STALL)
    return _logged(out.select("id", "index", F.concat("kind", F.lit(":"), F.coalesce("text", F.lit(""))).alias("data")))


def c_is(value: int):
    return F.col("c") == value


@query(f"""WITH r AS (SELECT 'u' || user_id AS endpoint, date_trunc('second', ts) AS ts, list_sort([event_type, 'v' || event_id % 3]) AS models FROM events WHERE user_id IS NOT NULL),
    o AS (SELECT *, lag(ts) OVER w AS last, lag(models) OVER w AS had, lead(ts) OVER w AS next FROM r WINDOW w AS (PARTITION BY endpoint ORDER BY ts, models)),
    k AS (SELECT *, last IS NULL OR ts - last > to_seconds({SILENCE}) AS fresh FROM o),
    c AS (SELECT endpoint, ts, fresh, list_filter(models, lambda m: fresh OR NOT list_contains(had, m)) AS added, CASE WHEN fresh THEN [] ELSE list_filter(had, lambda m: NOT list_contains(models, m)) END AS removed FROM k)
    SELECT endpoint, ts, added, removed, FALSE AS gone FROM c WHERE fresh OR len(added) > 0 OR len(removed) > 0
    UNION ALL SELECT endpoint, ts + to_seconds({SILENCE}), [], models, TRUE FROM o WHERE coalesce(next, (SELECT max(ts) - to_seconds(10) FROM r)) - ts > to_seconds({SILENCE})""")
def r139_endpoint_stream(spark, sf_dir):
    """Events as reports of what their users have; users that are silent for too long drop out."""
    ts = F.date_trunc("second", "ts")
    reports = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("endpoint"), ts.alias("ts"), F.array("event_type", F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string"))).alias("models"))
    stream = answers.endpoint_models(_replayed(reports), SILENCE)
    path, checkpoint = new_folder(spark, "changes"), new_folder(spark, "changes-checkpoint")
    _run(spark, lambda: stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(path)
