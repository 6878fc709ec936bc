"""Queries over request events: routes, destinations, endpoints, limits, caches, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import routing as R
from millrace.operators import catalogue, routing, state
from millrace.plans.registry import query, table

#: Requests in closed form from events.
REQUESTS = """req AS (SELECT event_id AS request_id, ts, user_id, (['embed', 'chunk', 'rerank', 'generate'])[event_id % 4 + 1] AS operation, event_type || '-v' || event_id % 3 AS model,
    'u' || user_id % 4 AS tier, CASE WHEN event_id % 5 = 0 THEN 'docs' END AS source_table FROM events)"""


def _requests(spark, sf_dir):
    k = F.col("event_id")
    operation = F.get(F.array(*[F.lit(x) for x in ("embed", "chunk", "rerank", "generate")]), (k % 4).cast("int"))
    return table(spark, sf_dir, "events").select(
        k.alias("request_id"), "ts", "user_id", operation.alias("operation"), F.concat("event_type", F.lit("-v"), (k % 3).cast("string")).alias("model"),
        F.create_map(F.lit("tier"), F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string"))).alias("headers"), F.when(k % 5 == 0, "docs").alias("source_table"))


#: (name, priority, operations, models, headers, tables, window)
ROUTES = [
    ("night", 200, ["embed"], ["*"], None, None, (22 * 60, 6 * 60, [])),
    ("views", 100, [], ["view*", "c*-v2"], {"tier": ("u1", None, None)}, None, None),
    ("prefix", 100, ["chunk", "rerank"], [], {"tier": (None, "u", "^u[23]$")}, None, (8 * 60, 20 * 60 + 30, [1, 2, 3, 4, 5])),
    ("docs", 90, [], [], None, ["docs"], None),
    ("regex", 90, [], ["*-v1"], {"tier": (None, None, "[02]")}, None, None),
]
MATCHED = """matched AS (SELECT *, CASE
    WHEN operation = 'embed' AND (m >= 1320 OR m < 360) THEN 'night'
    WHEN operation IN ('chunk', 'rerank') AND d BETWEEN 1 AND 5 AND m >= 480 AND m < 1230 THEN 'prefix'
    WHEN (model LIKE 'view%' OR (model LIKE 'c%' AND model LIKE '%-v2')) AND tier = 'u1' THEN 'views'
    WHEN source_table = 'docs' THEN 'docs'
    WHEN model LIKE '%-v1' AND tier IN ('u0', 'u2') THEN 'regex' END AS route
    FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m, dayofweek(ts) AS d FROM req))"""


def _routes(spark):
    return spark.createDataFrame(ROUTES, routing.ROUTE)


@query(f"WITH {REQUESTS}, {MATCHED} SELECT request_id, route FROM matched")
def r127_r128_r129_r130_route_match(spark, sf_dir):
    return routing.match_routes(_requests(spark, sf_dir), _routes(spark)).select("request_id", "route")


@query("""SELECT DISTINCT event_type, event_type LIKE 'c%' AS glob, event_type = 'click' OR event_type LIKE 'pur%' OR regexp_matches(event_type, 'in$') AS matched FROM events""")
def r128_r129_matchers(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_type", R.glob_match(e, F.lit("c*")).alias("glob"), R.string_match(e, F.lit("click"), F.lit("pur"), F.lit("in$")).alias("matched")).distinct()


@query("""SELECT event_id, (['>=', '<', '>', '<=', '==', '=='])[event_id % 6 + 1] AS op, round(CASE WHEN event_id % 3 = 0 THEN event_id / 1000.0 ELSE event_id END, 6) AS value,
    CASE event_id % 6 WHEN 0 THEN 50 >= v WHEN 1 THEN 50 < v WHEN 2 THEN 50 > v WHEN 3 THEN 50 <= v ELSE 50 = v END AS holds
    FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id / 1000.0 ELSE event_id END AS v FROM events)""")
def r131_thresholds(spark, sf_dir):
    text = F.expr("concat(element_at(array('>=', '< ', '>', '<=', '==', ''), cast(event_id % 6 + 1 as int)), event_id, case event_id % 3 when 0 then 'ms' when 1 then 's' else '' end)")
    rows = table(spark, sf_dir, "events").select("event_id", R.threshold(text).alias("t"))
    return rows.select("event_id", "t.op", F.round("t.value", 6).alias("value"), R.holds(F.col("t"), F.lit(50.0)).alias("holds"))


#: (address, pool, models, queue_depth, connections, healthy)
ENDPOINTS = [(f"http://10.0.{p}.{i}:8080", f"pool{p}", [f"{m}-v{v}" for v in range(3) for m in models], depth, c, ok) for p, i, models, depth, c, ok in (
    (0, 1, ["view"], 10, 3, True), (0, 2, ["view", "click"], 60, 1, True), (1, 1, ["click", "purchase"], 55, 2, True), (1, 2, [], 51, 2, True),
    (1, 3, ["view"], 0, 0, False), (2, 1, ["signup", "purchase"], 5, 7, True), (2, 2, ["view"], 80, 4, True), (2, 3, ["click"], 20, 9, True))]
#: (route, pos, pool, weight, queue_depth, replicas, latency, model_loaded, window)
DESTINATIONS = [
    ("night", 0, "pool0", 50, ("<", 30.0), None, None, False, None), ("night", 1, "pool1", 40, None, (">=", 2.0), None, False, None),
    ("views", 0, "pool2", 80, None, None, None, True, None), ("views", 1, "pool0", 80, None, None, None, True, None), ("views", 2, "pool3", 99, None, None, None, False, None),
    ("prefix", 0, "pool1", 10, None, None, None, False, (0, 720, [])), ("prefix", 1, "pool2", 5, None, None, ("<", 0.1), False, None),
    ("docs", 0, "pool2", 10, (">", 50.0), None, None, False, None),
]


def _endpoints(spark):
    return spark.createDataFrame(ENDPOINTS, "address string, pool string, models array<string>, queue_depth int, connections int, healthy boolean")


@query(f"""WITH {REQUESTS}, {MATCHED} SELECT request_id, route, CASE route WHEN 'night' THEN 'pool1'
    WHEN 'views' THEN CASE WHEN model LIKE 'view-%' OR model LIKE 'click-%' OR model LIKE 'signup-%' OR model LIKE 'purchase-%' THEN 'pool2' END
    WHEN 'prefix' THEN CASE WHEN m < 720 THEN 'pool1' ELSE 'pool2' END END AS pool FROM matched""")
def r132_destinations(spark, sf_dir):
    matched = routing.match_routes(_requests(spark, sf_dir), _routes(spark))
    out = routing.select_destinations(matched, spark.createDataFrame(DESTINATIONS, routing.DESTINATION), _endpoints(spark))
    return out.select("request_id", "route", "pool")




@query()
def r136_hash_choice(spark, sf_dir):
    models = _requests(spark, sf_dir).select("model").distinct().crossJoin(F.broadcast(_endpoints(spark).agg(F.collect_list(F.struct("address", "connections", R.fnv1a(F.col("address")).alias("hash"))).alias("e"))))
    near = routing.nearest_by_hash(F.col("e"), F.col("model"))
    return models.select("model", R.fnv1a(F.col("model")).alias("hash"), F.transform(near, lambda x: x["address"]).alias("nearest"), routing.least_loaded(near)["address"].alias("chosen"))


@query("SELECT event_type, CAST(0 AS BIGINT) + list_reduce(list_transform(range(strlen(event_type)), lambda i: CAST(ascii(event_type[i + 1]) AS HUGEINT)), lambda h, b: xor(h, b) * 16777619 % 4294967296, CAST(2166136261 AS HUGEINT)) AS hash FROM (SELECT DISTINCT event_type FROM events)")
def r136_fnv(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type").distinct().select("event_type", R.fnv1a(F.col("event_type")).alias("hash"))


LIVE = f"""ep AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{p}', {m}, {d}, {c})" if m else f"('{a}', '{p}', CAST([] AS VARCHAR[]), {d}, {c})" for a, p, m, d, c, ok in ENDPOINTS if ok)}) e(address, pool, models, depth, connections))"""


@query("""WITH e AS (SELECT 'u' || user_id AS address, 'pool' || user_id % 7 AS pool, count(*) FILTER (event_type = 'click') AS connections, 4 * count(*) FILTER (event_type = 'view') AS depth FROM events GROUP BY user_id)
    SELECT pool, arg_min(address, (connections, address)) AS least, coalesce(arg_min(address, address) FILTER (depth < 50), arg_min(address, (connections, address))) AS queue_aware, CAST(sum(depth) AS BIGINT) AS queue_depth FROM e GROUP BY pool""")
def r135_r137_r162_endpoints(spark, sf_dir):
    """Users as endpoints: their clicks are connections, their views fill queues."""
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1)).cast("int")
    live = table(spark, sf_dir, "events").groupBy("user_id").agg(n("click").alias("connections"), (4 * n("view")).alias("queue_depth")).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("address"), F.concat(F.lit("pool"), (F.col("user_id") % 7).cast("string")).alias("pool"), "connections", "queue_depth")
    e = F.array_sort(F.collect_list(F.struct("address", "connections", "queue_depth")))
    rows = live.groupBy("pool").agg(e.alias("e")).join(routing.queue_gauges(live), "pool")
    return rows.select("pool", routing.least_loaded(F.col("e"))["address"].alias("least"), routing.queue_aware(F.col("e"))["address"].alias("queue_aware"), "queue_depth")


@query(f"""WITH {REQUESTS}, {LIVE},
    r AS (SELECT request_id, model, CASE WHEN request_id % 3 = 0 THEN 'burst' ELSE 'general' END AS work, CASE WHEN request_id % 2 = 0 THEN 'pool1' ELSE 'pool2' END AS pool FROM req),
    c AS (SELECT r.*, e.*, e.pool AS epool, list_contains(e.models, model) AS has FROM r, ep e),
    f AS (SELECT *, count(*) FILTER (has) OVER w AS n, count(*) FILTER (has AND epool = pool) OVER w AS here FROM c WINDOW w AS (PARTITION BY request_id)),
    g AS (SELECT * FROM f WHERE CASE WHEN here > 0 THEN has AND epool = pool WHEN n > 0 THEN has ELSE epool = pool END)
    SELECT request_id, CASE WHEN any_value(work) = 'burst' THEN coalesce(min(address) FILTER (depth < 50), arg_min(address, (connections, address))) ELSE arg_min(address, (connections, address)) END AS address FROM g GROUP BY request_id""")
def r138_route_requests(spark, sf_dir):
    k = F.col("request_id")
    rows = _requests(spark, sf_dir).withColumns({"workload": F.when(k % 3 == 0, "burst").otherwise("general"), "pool": F.when(k % 2 == 0, "pool1").otherwise("pool2")})
    return routing.route_requests(rows, _endpoints(spark)).select("request_id", "address")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'p' WHEN event_id % 4 = 2 THEN 'other' END AS pool, CASE WHEN event_id % 4 = 1 THEN CASE WHEN event_id % 8 = 1 THEN 429 ELSE 503 END END AS status,
    CASE WHEN event_id % 4 = 1 THEN 'no healthy endpoints available' END AS message FROM events""")
def r138_fallback(spark, sf_dir):
    k = F.col("event_id")
    action = F.when(k % 4 == 1, "reject").when(k % 4 == 2, "redirect").otherwise("queue")
    out = routing.fallback(action, F.when(k % 4 == 0, "p"), F.lit("other"), F.when(k % 8 == 1, 429).otherwise(0), F.lit(""))
    return table(spark, sf_dir, "events").select("event_id", out.alias("f")).select("event_id", "f.pool", "f.status", "f.message")


@query("""SELECT user_id AS address, CASE user_id % 3 WHEN 0 THEN ['b'] WHEN 1 THEN [] ELSE ['b', 'c'] END AS added, CASE user_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['a'] ELSE [] END AS removed FROM (SELECT DISTINCT user_id FROM events)""".replace("[]", "CAST([] AS VARCHAR[])"))
def r139_model_changes(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("address")).distinct()
    a, ab = F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))
    old = users.where("address % 3 <> 2").withColumn("models", a)
    new = users.where("address % 3 <> 1").withColumn("models", F.when(F.col("address") % 3 == 0, ab).otherwise(F.array(F.lit("b"), F.lit("c"))))
    return routing.model_changes(old, new)


def _specs(spark, sf_dir):
    """Route resources of the users, their parts by the user's number and number of events."""
    spec = F.expr("""concat('{', if(u % 4 > 0, concat('"priority":', u, ','), ''), '"match":{"operations":["', if(u % 6 = 5, 'fly', 'embed'), '"]',
        if(u % 3 = 0, concat(',"timeWindow":{"start":"', u % 30, ':', lpad(c % 60, 2, '0'), '","end":"6:05","days":[0,', u % 8, ']}'), ''), if(u % 7 = 0, concat(',"headers":{"h":{', if(c % 2 = 0, '"prefix":"p"', ''), '}}'), ''), '},"route":[',
        if(u % 10 > 0, concat('{"pool":"', if(u % 11 = 0, '', 'p'), '"},{"pool":"', if(u % 5 = 0, 'p', 'q'), '","weight":', c % 130, if(u % 2 = 0, concat(',"condition":{"queueDepth":"<', c, 'ms","modelLoaded":true}'), ''), '}'), ''), ']',
        case u % 4 when 1 then concat(',"fallback":{"action":"redirect"', if(c % 3 = 0, ',"redirectPool":"z"', ''), '}') when 2 then ',"fallback":{"action":"reject","errorResponse":{"message":"no"}}' when 3 then ',"fallback":{"action":"drop"}' else '' end,
        if(u % 5 < 2, concat(',"rateLimiting":{"requestsPerSecond":', c % 4, '}'), ''), if(u % 3 = 1, concat(',"retry":{"attempts":', c % 5 - 1, ',"retryOn":["', u % 9, 'xx","reset"]}'), ''), '}')""")
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u")).agg(F.count("*").alias("c"))
    return users.select(F.lit("ns").alias("namespace"), F.concat(F.lit("u"), F.col("u").cast("string")).alias("name"), spec.alias("spec"))


ROUTES_OF_USERS = "s AS (SELECT user_id AS u, count(*) AS c FROM events GROUP BY user_id)"


@query(f"""WITH {ROUTES_OF_USERS} SELECT 'ns/u' || u AS name, CAST(CASE WHEN u % 4 > 0 THEN u ELSE 100 END AS INTEGER) AS priority, CAST(CASE WHEN u % 3 = 0 THEN u % 30 * 60 + c % 60 END AS INTEGER) AS start, CASE WHEN u % 3 = 0 THEN 365 END AS "end",
    CASE WHEN u % 10 > 0 THEN 2 ELSE 0 END AS destinations, CAST(CASE WHEN u % 10 > 0 THEN c % 130 END AS INTEGER) AS second_weight, CASE WHEN u % 10 > 0 AND u % 2 = 0 THEN round(c / 1000.0, 6) END AS second_limit,
    CASE u % 4 WHEN 1 THEN 'redirect' WHEN 2 THEN 'reject' WHEN 3 THEN 'drop' END AS action, CASE WHEN u % 4 = 2 THEN 503 END AS status, CAST(CASE WHEN u % 5 < 2 AND c % 4 > 0 THEN c % 4 END AS INTEGER) AS rate, CAST(CASE WHEN u % 5 < 2 AND c % 4 > 0 THEN c % 4 END AS INTEGER) AS burst,
    CAST(CASE WHEN u % 3 = 1 THEN c % 5 - 1 END AS INTEGER) AS attempts, CAST(CASE WHEN u % 3 = 1 THEN u % 9 * 100 END AS INTEGER) AS retry_from FROM s""")
def r140_read_routes(spark, sf_dir):
    out = routing.read_routes(_specs(spark, sf_dir))
    second = F.get("destinations", F.lit(1))
    return out.select("name", "priority", "window.start", "window.end", F.size("destinations").alias("destinations"), second["weight"].alias("second_weight"), F.round(second["queue_depth"]["value"], 6).alias("second_limit"),
                      "fallback.action", "fallback.status", "limit.rate", "limit.burst", "attempts", F.get("retry_from", F.lit(0)).alias("retry_from"))


@query(f"""WITH {ROUTES_OF_USERS} SELECT 'u' || u AS name, list_filter([
        CASE WHEN u % 10 = 0 THEN 'route must have at least one destination' WHEN u % 11 = 0 THEN 'pool is required' WHEN u % 5 = 0 AND u % 2 = 1 THEN 'duplicate pool without conditions' WHEN c % 130 > 100 THEN 'weight must be between 0 and 100' END,
        CASE WHEN u % 6 = 5 THEN 'invalid operation' WHEN u % 3 = 0 AND u % 30 > 23 THEN 'time is not in HH:MM format' WHEN u % 3 = 0 AND u % 8 = 7 THEN 'invalid day' WHEN u % 7 = 0 AND c % 2 = 1 THEN 'header matcher must specify a match' END,
        CASE WHEN u % 4 = 3 THEN 'invalid fallback action' WHEN u % 4 = 1 AND c % 3 <> 0 THEN 'redirectPool is required' END, CASE WHEN u % 5 < 2 AND c % 4 = 0 THEN 'requestsPerSecond must be > 0' END,
        CASE WHEN u % 3 = 1 AND c % 5 = 0 THEN 'attempts must be >= 0' WHEN u % 3 = 1 AND u % 9 <> 5 THEN 'invalid retry condition' END], lambda x: x IS NOT NULL) AS errors FROM s""")
def r141_route_errors(spark, sf_dir):
    return _specs(spark, sf_dir).select("name", routing.route_errors(F.from_json("spec", routing.SPEC)).alias("errors"))


@query("""SELECT user_id AS name, CASE user_id % 5 WHEN 1 THEN ['compute class needs a managed cluster'] WHEN 2 THEN ['spot conflicts with a managed cluster'] WHEN 3 THEN ['class Accelerator requires GPU resources', 'min cannot be greater than max'] WHEN 4 THEN ['invalid compute class'] ELSE [] END AS errors,
    CASE user_id % 5 WHEN 2 THEN ['compute class is immutable'] WHEN 1 THEN ['managed is immutable'] ELSE [] END AS changes FROM (SELECT DISTINCT user_id FROM events)""".replace("ELSE []", "ELSE CAST([] AS VARCHAR[])"))
def r141_pool_errors(spark, sf_dir):
    k = F.col("name") % 5
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("name")).distinct()
    pools = users.withColumns({
        "min": F.when(k == 3, 9).otherwise(1), "max": F.lit(4), "spot": k == 2, "gpu": F.lit(False), "managed": (k == 2) | (k == 3),
        "compute_class": F.when(k == 1, "Balanced").when(k == 2, "Performance").when(k == 3, "Accelerator").when(k == 4, "other")})
    old = pools.withColumn("managed", F.when(k == 1, True).otherwise(F.col("managed"))).withColumn("compute_class", F.when(k == 2, "Balanced").otherwise(F.col("compute_class")))
    return routing.pool_errors(pools).select("name", "errors").join(routing.immutable_errors(old, pools).withColumnRenamed("errors", "changes"), "name")


@query("""WITH s AS (SELECT user_id AS u, count(*) AS c FROM events GROUP BY user_id), m AS (SELECT u, c, (['eager', 'bounded', 'lazy', ''])[u % 4 + 1] AS loading, u % 3 AS k, CASE WHEN u % 5 = 0 THEN c || 'm' END AS alive FROM s)
    SELECT 'u' || u AS name, CASE loading WHEN 'eager' THEN '0' WHEN '' THEN NULL ELSE coalesce(alive, '5m') END AS keep_alive, CASE k WHEN 1 THEN '["m' || c || ':i8","n"]' WHEN 2 THEN '["n"]' END AS preload, CASE k WHEN 1 THEN '{"m' || c || '-i8":"eager"}' END AS strategies,
        CASE WHEN loading = 'bounded' AND u % 8 = 1 THEN CAST(c AS VARCHAR) END AS most, CASE WHEN u % 2 = 0 THEN '/own/' || u ELSE '/models/embedders' END AS folder FROM m""")
def r142_pool_config(spark, sf_dir):
    u, count = F.col("u"), F.col("c")
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u")).agg(F.count("*").alias("c"))
    model = lambda name, variant, strategy: F.struct(name.alias("name"), F.lit(variant).cast("string").alias("variant"), F.lit(strategy).cast("string").alias("strategy"))
    n = model(F.lit("n"), "", None)
    preload = F.when(u % 3 == 1, F.array(model(F.concat(F.lit("m"), count.cast("string")), "i8", "eager"), n)).when(u % 3 == 2, F.array(n)).otherwise(F.array().cast("array<struct<name:string,variant:string,strategy:string>>"))
    own = F.when(u % 2 == 0, F.create_map(F.lit("embedder_models_dir"), F.concat(F.lit("/own/"), u.cast("string"))))
    loading = F.get(F.array(F.lit("eager"), F.lit("bounded"), F.lit("lazy"), F.lit("")), (u % 4).cast("int"))
    pools = users.select(F.concat(F.lit("u"), u.cast("string")).alias("name"), own.alias("config"), preload.alias("preload"), loading.alias("loading"), F.when(u % 5 == 0, F.concat(count.cast("string"), F.lit("m"))).alias("keep_alive"), F.when(u % 8 == 1, count.cast("int")).alias("max_loaded"))
    c = F.col("config")
    return routing.pool_config(pools).select("name", c["keep_alive"].alias("keep_alive"), c["preload"].alias("preload"), c["model_strategies"].alias("strategies"), c["max_loaded_models"].alias("most"), c["embedder_models_dir"].alias("folder"))


@query("""SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 4 WHEN 1 THEN (event_id % 9) * 2 ELSE 4 END AS INTEGER) AS chips, sha256('{"a":' || event_id || '}')[:16] AS hash,
    CASE WHEN event_id % 4 = 3 THEN 'Running' WHEN event_id % 4 > 0 THEN 'Scaling' ELSE 'Pending' END AS phase FROM events""")
def r143_r163_topology(spark, sf_dir):
    k = F.col("event_id")
    topology = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat((k % 9).cast("string"), F.lit("x2"))).otherwise("2x2x1")
    return table(spark, sf_dir, "events").select("event_id", R.topology_product(topology).alias("chips"), R.template_hash(F.concat(F.lit('{"a":'), k.cast("string"), F.lit("}"))).alias("hash"), routing.pool_phase(k % 4, F.lit(3)).alias("phase"))


# --- state ------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT user_id, event_type, k, event_id, ts, ts AS written, FALSE AS hit FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.event_type, e.k, e.event_id, e.ts, CASE WHEN e.ts - f.written <= INTERVAL 2 DAY THEN f.written ELSE e.ts END, e.ts - f.written <= INTERVAL 2 DAY
        FROM f JOIN e ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.k = f.k + 1)
    SELECT event_id, hit FROM f""")
def r119_cache_hits(spark, sf_dir):
    return state.cache_hits(table(spark, sf_dir, "events"), ["user_id", "event_type"], 2 * 86400.0).select("event_id", "hit")


@query("""SELECT event_type, CAST(count(*) FILTER (event_id % 3 = 0) AS BIGINT) AS hits, CAST(count(*) FILTER (event_id % 3 <> 0) AS BIGINT) AS misses, round(100.0 * count(*) FILTER (event_id % 3 = 0) / count(*), 6) AS hit_rate FROM events GROUP BY event_type""")
def r123_hit_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 3 == 0).alias("hit"))
    return state.hit_rates(rows, "event_type").withColumn("hit_rate", F.round("hit_rate", 6))


@query("""SELECT event_id, sha256('m|' || CASE WHEN event_id % 2 = 0 THEN 't:' || event_type || '|' ELSE 'b:image/png:' || sha256(event_type) || '|t:x|' END || '||') AS key FROM events""")
def r122_result_keys(spark, sf_dir):
    null = lambda t: F.lit(None).cast(t)
    text = lambda c: F.struct(c.alias("text"), null("string").alias("mime_type"), null("binary").alias("data"))
    image = F.struct(null("string").alias("text"), F.lit("image/png").alias("mime_type"), F.encode("event_type", "utf-8").alias("data"))
    parts = F.when(F.col("event_id") % 2 == 0, F.array(text(F.col("event_type")))).otherwise(F.array(image, text(F.lit("x"))))
    return table(spark, sf_dir, "events").select("event_id", state.result_key(F.lit("m"), parts).alias("key"))


@query()
def r118_model_loads(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 20).alias("server"), F.col("event_type").alias("model"))
    return state.model_loads(rows, ["server"], 2, 6 * 3600.0, ("click",)).select("event_id", "loaded", "evicted")


@query("""WITH d AS (SELECT event_id, ts, event_type, CASE WHEN event_id % 5 < 2 THEN -1 ELSE 1 END AS x FROM events),
    s AS (SELECT *, sum(x) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS s FROM d)
    SELECT event_id, CAST(s - least(min(s) OVER (PARTITION BY event_type ORDER BY ts, event_id), 0) AS BIGINT) AS count FROM s""")
def r155_in_use(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.when(F.col("event_id") % 5 < 2, -1).otherwise(1).alias("delta"))
    return state.in_use(rows, "event_type").select("event_id", "count")


@query()
def r124_admission(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 10).alias("server"), (F.col("value").cast("double") * 100).alias("service"))
    return state.admit(rows, ["server"], 2, 3, 7200.0)


@query("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    f AS (SELECT user_id, k, event_id, ts, CAST(2.0 AS DOUBLE) AS t, TRUE AS allowed FROM e WHERE k = 1
        UNION ALL SELECT user_id, k, event_id, ts, x - CASE WHEN x >= 1 THEN 1 ELSE 0 END, x >= 1
        FROM (SELECT e.*, least(3.0, f.t + (epoch_us(e.ts) - epoch_us(f.ts)) / 1e6 * 0.000005) AS x FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1))
    SELECT event_id, allowed FROM f""")
def r133_token_bucket(spark, sf_dir):
    return state.rate_limit(table(spark, sf_dir, "events"), ["user_id"], 0.000005, 3).select("event_id", "allowed")


@query()
def r134_circuit_breaker(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", (F.col("user_id") % 10).alias("endpoint"), (F.col("event_id") % 7 > 2).alias("success"))
    return state.circuit_breaker(rows, ["endpoint"], 3, 3 * 3600.0)


@query("""SELECT event_type, le, CAST(count(*) FILTER (value / 100 <= le) AS BIGINT) AS count FROM events, (SELECT unnest([0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, CAST('inf' AS DOUBLE)]) AS le) GROUP BY ALL""")
def r125_histogram(spark, sf_dir):
    return catalogue.histogram(table(spark, sf_dir, "events"), F.col("value") / 100, "event_type")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS total FROM events GROUP BY ALL""")
def r125_windowed_counters(spark, sf_dir):
    return catalogue.by_window(table(spark, sf_dir, "events"), "1 day", "event_type")
