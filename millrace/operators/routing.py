"""Matching requests to routes, pools and endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import routing as R

#: Routes as rows. Empty or null conditions always hold.
ROUTE = """name string, priority int, operations array<string>, models array<string>,
    headers map<string,struct<exact:string,prefix:string,regex:string>>, tables array<string>,
    window struct<start:int,end:int,days:array<int>>"""
#: Destinations of routes, in order of ``pos``.
DESTINATION = """route string, pos int, pool string, weight int, queue_depth struct<op:string,value:double>,
    replicas struct<op:string,value:double>, latency struct<op:string,value:double>, model_loaded boolean,
    window struct<start:int,end:int,days:array<int>>"""
#: Fixed value: queue depth from on which an endpoint counts as full.
FULL = 50


def _within(window: Column, ts: Column) -> Column:
    return window.isNull() | R.in_window(ts, window["start"], window["end"], window["days"])


def route_index(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """(operation, model, source_table, candidates): for each combination that requests have the
    routes that fit it, in order of priority, up to the first that asks nothing more.

    A glob can only fit models that begin with what stands before its first star, so
    combinations and routes meet by that, by operation and by table, each a value or
    'any'. What is left to each request are the conditions on headers and time."""
    names = ["operation", "model", "source_table"]
    any_of = lambda a: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.col(a)).otherwise(F.array(F.lit(None).cast("string")))
    row = routes.select((-F.col("priority")).alias("rank"), "name", any_of("operations").alias("operations"), any_of("models").alias("models"), any_of("tables").alias("tables"),
                        F.map_entries("headers").alias("headers"), "window")
    row = row.withColumn("open", (F.coalesce(F.size("headers"), F.lit(0)) <= 0) & F.col("window").isNull())
    keyed = row.select("rank", "name", "headers", "window", "open", "tables", "models", F.explode("operations").alias("op")).withColumn("tab", F.explode("tables")).withColumn("glob", F.explode("models"))
    keyed = keyed.withColumn("stem", F.coalesce(F.substring_index("glob", "*", 1), F.lit(""))).drop("tables", "models")
    sizes = keyed.agg(F.sort_array(F.collect_set(F.char_length("stem"))).alias("sizes"))  # one row, at most as many as the longest glob has letters
    combos = requests.select(*names).distinct()
    stems = F.transform(F.filter("sizes", lambda n: n <= F.char_length(F.coalesce("model", F.lit("")))), lambda n: F.substring(F.coalesce("model", F.lit("")), F.lit(1), n))
    asked = combos.crossJoin(F.broadcast(sizes)).select(*names, F.explode(stems).alias("stem"))
    none = F.lit(None).cast("string")
    asked = asked.withColumn("op", F.explode(F.array_distinct(F.array(F.col("operation"), none)))).withColumn("tab", F.explode(F.array_distinct(F.array(F.col("source_table"), none))))
    met = asked.alias("a").join(keyed.alias("k"), (F.col("a.stem") == F.col("k.stem")) & F.col("a.op").eqNullSafe(F.col("k.op")) & F.col("a.tab").eqNullSafe(F.col("k.tab")))
    met = met.where(F.col("glob").isNull() | F.coalesce(R.glob_match(F.col("model"), F.col("glob")), F.lit(False)))
    place = F.struct("rank", "name")
    stop = F.min(F.when(F.col("open"), place)).over(Window.partitionBy(*names))
    met = met.select(*names, "rank", "name", "headers", "window", stop.alias("stop")).where(F.col("stop").isNull() | (place <= F.col("stop")))
    # maps cannot be ordered: rank and name are compared alone
    in_order = lambda a, b: F.when(a["rank"] != b["rank"], a["rank"] - b["rank"]).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)
    return met.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("rank", "name", "headers", "window")), in_order).alias("candidates"))


def match_routes(requests: DataFrame, routes: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Requests (id, operation, model, headers, source_table, ts) with ``route``: the
    first that matches by falling priority, then name; null for none.

    Each request looks through the candidates of its operation, model and table alone (see
    route_index), so that the number of routes hardly matters to it. A null operation, model
    or table fits only routes that do not ask for one."""
    names = ["operation", "model", "source_table"]

    def fits(x):
        heads = F.coalesce(F.size(x["headers"]) <= 0, F.lit(True)) | F.forall(x["headers"], lambda e: R.string_match(F.try_element_at(F.col("headers"), e["key"]), e["value"]["exact"], e["value"]["prefix"], e["value"]["regex"]))
        return heads & _within(x["window"], F.col("ts"))

    row = requests.select(F.struct("*").alias("_row"), *names, "headers", "ts")
    index = route_index(requests, routes).select(*[F.col(c).alias(f"_{c}") for c in names], "candidates")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    found = row.join(index, same, "left").select("_row", F.try_element_at(F.filter("candidates", fits), F.lit(1))["name"].alias("_route"))
    return found.select("_row.*", F.col("_route").alias("route"))


def pool_stats(endpoints: DataFrame) -> DataFrame:
    """(pool, replicas, queue_depth mean, models) of healthy endpoints."""
    return endpoints.where("healthy").groupBy("pool").agg(
        F.count("*").alias("replicas"), F.avg("queue_depth").alias("mean_depth"), F.array_distinct(F.flatten(F.collect_list("models"))).alias("loaded"))


def select_destinations(requests: DataFrame, destinations: DataFrame, endpoints: DataFrame, id_col: str = "request_id") -> DataFrame:
    """Requests (id, route, model, ts) with ``pool``: of the route's destinations whose
    conditions hold the one of most weight, the first on ties; null for none. Latency
    is not judged."""
    rules = destinations.withColumnRenamed("replicas", "replica_rule").withColumnRenamed("queue_depth", "depth_rule")
    options = rules.join(pool_stats(endpoints), "pool")  # pools without endpoints are no option
    option = F.struct((-F.col("weight")).alias("rank"), "pos", "pool", "depth_rule", "replica_rule", "replicas", "mean_depth", "loaded", "model_loaded", "window")
    per = options.groupBy("route").agg(F.array_sort(F.collect_list(option)).alias("all"))

    def fits(d):
        loaded = ~F.coalesce(d["model_loaded"], F.lit(False)) | F.coalesce(F.array_contains(d["loaded"], F.col("model")), F.lit(False))
        return R.holds(d["depth_rule"], d["mean_depth"]) & R.holds(d["replica_rule"], d["replicas"]) & loaded & _within(d["window"], F.col("ts"))

    return requests.join(per, "route", "left").withColumn("pool", F.try_element_at(F.filter("all", fits), F.lit(1))["pool"]).drop("all")


# --- endpoints --------------------------------------------------------------


def least_loaded(endpoints: Column) -> Column:
    """Of array<struct<address, connections, …>> the one with fewest connections, then by address."""
    return F.try_element_at(F.array_sort(endpoints, lambda a, b: F.when(a["connections"] != b["connections"], a["connections"] - b["connections"]).when(a["address"] < b["address"], -1).when(a["address"] > b["address"], 1).otherwise(0)), F.lit(1))


def nearest_by_hash(endpoints: Column, model: Column, count: int = 3) -> Column:
    """The ``count`` endpoints whose address hash is nearest to the model's by exclusive or."""
    key = R.fnv1a(model)
    scored = F.transform(endpoints, lambda e: F.struct(F.coalesce(e["hash"], R.fnv1a(e["address"])).bitwiseXOR(key).alias("s"), e["address"].alias("address"), e["connections"].alias("connections")))
    return F.slice(F.array_sort(scored, lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).when(a["address"] < b["address"], -1).when(a["address"] > b["address"], 1).otherwise(0)), 1, count)


def queue_aware(endpoints: Column, full: int = FULL) -> Column:
    """The first endpoint whose queue is below ``full``, else the least loaded."""
    return F.coalesce(F.try_element_at(F.filter(endpoints, lambda e: e["queue_depth"] < full), F.lit(1)), least_loaded(endpoints))


def workload(operation: Column, asked: Column) -> Column:
    """The workload asked for, else by the operation."""
    by = F.when(operation.isin("embed", "rerank"), "read-heavy").when(operation == "chunk", "write-heavy").otherwise("general")
    return F.when(F.coalesce(asked, F.lit("")) != "", asked).otherwise(by)


def route_requests(requests: DataFrame, endpoints: DataFrame, default_pool: str = "default") -> DataFrame:
    """Requests (…, model, pool, operation, workload) with ``address``: endpoints that have
    the model, those of the pool if any of them; else the pool's; then by workload.
    Null where no endpoint is healthy. Endpoints are few; they come along by model and
    by pool as arrays in order of address."""
    healthy = endpoints.where("healthy").withColumn("hash", R.fnv1a(F.col("address")))
    e = F.struct("address", "connections", "queue_depth", "pool", "hash")
    by_model = healthy.select(F.explode("models").alias("_m"), e.alias("e")).groupBy("_m").agg(F.array_sort(F.collect_list("e")).alias("_have"))
    by_pool = healthy.groupBy(F.col("pool").alias("_p")).agg(F.array_sort(F.collect_list(e)).alias("_in"))
    pool = F.coalesce(F.nullif("pool", F.lit("")), F.lit(default_pool))
    rows = requests.withColumn("_pool", pool).join(by_model, F.col("model") == F.col("_m"), "left").join(by_pool, F.col("_pool") == F.col("_p"), "left")
    here = F.filter("_have", lambda x: x["pool"] == F.col("_pool"))
    found = F.when(F.size(here) > 0, here).when(F.size("_have") > 0, F.col("_have")).otherwise(F.col("_in"))
    rows = rows.withColumn("_e", found).withColumn("_w", workload(F.col("operation"), F.col("workload")))
    near = F.filter("_e", lambda x: F.array_contains(F.transform(nearest_by_hash(F.col("_e"), F.col("model")), lambda n: n["address"]), x["address"]))
    chosen = F.when(F.col("_w") == "read-heavy", least_loaded(near)).when(F.col("_w") == "burst", queue_aware(F.col("_e"))).otherwise(least_loaded(F.col("_e")))
    return rows.withColumn("address", chosen["address"]).drop("_pool", "_m", "_have", "_p", "_in", "_e", "_w")


def fallback(action: Column, pool: Column, redirect: Column, status: Column, message: Column) -> Column:
    """struct(pool, status, message) where a route has no destination: a rejection, or another pool."""
    return (
        F.when(pool.isNotNull(), F.struct(pool.alias("pool"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("message")))
        .when(action == "reject", F.struct(F.lit(None).cast("string").alias("pool"), F.when(F.coalesce(status, F.lit(0)) == 0, 503).otherwise(status).alias("status"), F.when(F.coalesce(message, F.lit("")) == "", "no healthy endpoints available").otherwise(message).alias("message")))
        .when(action == "redirect", F.struct(redirect.alias("pool"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("message")))
    )


def model_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(address, added, removed) of tables (address, models) of endpoints."""
    none = F.array().cast("array<string>")
    both = old.select("address", F.col("models").alias("_o")).join(new.select("address", F.col("models").alias("_n")), "address", "full_outer")
    o, n = F.coalesce("_o", none), F.coalesce("_n", none)
    return both.select("address", F.array_sort(F.array_except(n, o)).alias("added"), F.array_sort(F.array_except(o, n)).alias("removed"))


# --- resources --------------------------------------------------------------

_WINDOW = "struct<start:string,end:string,days:array<int>>"
SPEC = f"""struct<priority:int,
  match:struct<operations:array<string>,models:array<string>,headers:map<string,struct<exact:string,prefix:string,regex:string>>,source:struct<tables:array<string>>,timeWindow:{_WINDOW}>,
  route:array<struct<pool:string,weight:int,condition:struct<queueDepth:string,availableReplicas:string,latency:string,modelLoaded:boolean,timeOfDay:{_WINDOW}>>>,
  fallback:struct<action:string,redirectPool:string,errorResponse:struct<statusCode:int,message:string,retryAfter:int>>,
  rateLimiting:struct<requestsPerSecond:int,burstSize:int,perModel:boolean>,
  retry:struct<attempts:int,retryOn:array<string>>>"""


def _parsed(window: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.when(window.isNotNull(), F.struct(R.minutes(window["start"]).alias("start"), R.minutes(window["end"]).alias("end"), F.coalesce(window["days"], none).alias("days")))


def read_routes(resources: DataFrame) -> DataFrame:
    """Typed routes of (namespace, name, spec JSON): priority and weights default to 100,
    the status of a rejection to 503, the burst to the rate, attempts to 3."""
    s = F.from_json(F.col("spec"), SPEC)
    rows = resources.withColumn("s", s)
    limit = F.col("s.rateLimiting")
    rps = F.coalesce(limit["requestsPerSecond"], F.lit(0))
    rule = lambda c: F.when(c.isNotNull(), R.threshold(c))
    destinations = F.transform("s.route", lambda d, i: F.struct(
        i.alias("pos"), d["pool"].alias("pool"), F.coalesce(d["weight"], F.lit(100)).alias("weight"), rule(d["condition"]["queueDepth"]).alias("queue_depth"),
        rule(d["condition"]["availableReplicas"]).alias("replicas"), rule(d["condition"]["latency"]).alias("latency"),
        F.coalesce(d["condition"]["modelLoaded"], F.lit(False)).alias("model_loaded"), _parsed(d["condition"]["timeOfDay"]).alias("window")))
    fall = F.col("s.fallback")
    retry = F.filter("s.retry.retryOn", lambda r: r.endswith("xx"))
    return rows.select(
        F.concat("namespace", F.lit("/"), "name").alias("name"), F.coalesce("s.priority", F.lit(100)).alias("priority"),
        F.col("s.match.operations").alias("operations"), F.col("s.match.models").alias("models"), F.col("s.match.headers").alias("headers"),
        F.col("s.match.source.tables").alias("tables"), _parsed(F.col("s.match.timeWindow")).alias("window"), destinations.alias("destinations"),
        F.when(fall.isNotNull(), F.struct(fall["action"].alias("action"), fall["redirectPool"].alias("redirect_pool"),
               F.when(fall["errorResponse"].isNotNull(), F.coalesce(fall["errorResponse"]["statusCode"], F.lit(503))).alias("status"), fall["errorResponse"]["message"].alias("message"))).alias("fallback"),
        F.when(rps > 0, F.struct(rps.alias("rate"), F.coalesce(limit["burstSize"], rps).alias("burst"), F.coalesce(limit["perModel"], F.lit(False)).alias("per_model"))).alias("limit"),
        F.when(F.col("s.retry").isNotNull(), F.coalesce("s.retry.attempts", F.lit(3))).alias("attempts"),
        F.transform(retry, lambda r: F.substring_index(r, "xx", 1).try_cast("int") * 100).alias("retry_from"))


#: What resources may say.
OPERATIONS = ("embed", "chunk", "rerank")
FALLBACKS = ("queue", "reject", "redirect")
RETRY_ON = ("5xx", "reset", "connect-failure", "retriable-4xx", "refused-stream", "cancelled", "deadline-exceeded", "resource-exhausted")
COMPUTE_CLASSES = ("Accelerator", "Balanced", "Performance", "Scale-Out", "autopilot", "autopilot-spot")


def route_errors(spec: Column) -> Column:
    """array<string> of what is wrong with a parsed route spec; one finding a group of rules."""
    route, m, fall, limit, retry = (spec[k] for k in ("route", "match", "fallback", "rateLimiting", "retry"))
    clock = F.lit(r"^([01]?[0-9]|2[0-3]):([0-5][0-9])$")
    bad_time = lambda t: F.coalesce((t != "") & ~F.regexp(t, clock), F.lit(False))
    free = F.transform(F.filter(route, lambda d: d["condition"].isNull()), lambda d: d["pool"])
    weight = lambda d: F.coalesce(d["weight"], F.lit(0))
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    none = F.lit(False)
    return F.array_compact(F.array(
        F.when(F.coalesce(F.size(route), F.lit(0)) <= 0, "route must have at least one destination")
        .when(F.exists(route, lambda d: empty(d["pool"])), "pool is required")
        .when(F.size(free) != F.size(F.array_distinct(free)), "duplicate pool without conditions")
        .when(F.exists(route, lambda d: (weight(d) < 0) | (weight(d) > 100)), "weight must be between 0 and 100"),
        F.when(F.coalesce(F.exists(m["operations"], lambda o: ~o.isin(*OPERATIONS)), none), "invalid operation")
        .when(F.coalesce(F.exists(m["models"], lambda p: p == ""), none), "model pattern cannot be empty")
        .when(bad_time(m["timeWindow"]["start"]) | bad_time(m["timeWindow"]["end"]), "time is not in HH:MM format")
        .when(F.coalesce(F.exists(m["timeWindow"]["days"], lambda d: (d < 0) | (d > 6)), none), "invalid day")
        .when(F.coalesce(F.exists(F.map_entries(m["headers"]), lambda e: empty(e["value"]["exact"]) & empty(e["value"]["prefix"]) & empty(e["value"]["regex"])), none), "header matcher must specify a match"),
        F.when(fall.isNotNull() & ~F.coalesce(fall["action"], F.lit("")).isin(*FALLBACKS), "invalid fallback action")
        .when((fall["action"] == "redirect") & empty(fall["redirectPool"]), "redirectPool is required"),
        F.when(limit.isNotNull() & (F.coalesce(limit["requestsPerSecond"], F.lit(0)) <= 0), "requestsPerSecond must be > 0")
        .when(limit["burstSize"] < 0, "burstSize must be >= 0"),
        F.when(retry["attempts"] < 0, "attempts must be >= 0").when(F.coalesce(F.exists(retry["retryOn"], lambda r: ~r.isin(*RETRY_ON)), none), "invalid retry condition"),
    ))


def pool_errors(pools: DataFrame) -> DataFrame:
    """Pools (name, min, max, spot, gpu, managed, compute_class) with ``errors``. ``managed``
    is null without cluster settings."""
    c, managed = F.coalesce("compute_class", F.lit("")), F.coalesce("managed", F.lit(False))
    return pools.withColumn("errors", F.array_compact(F.array(
        F.when((c != "") & ~c.isin(*COMPUTE_CLASSES), "invalid compute class").when((c != "") & ~managed, "compute class needs a managed cluster").when((c == "Accelerator") & ~F.col("gpu"), "class Accelerator requires GPU resources"),
        F.when(managed & F.col("spot"), "spot conflicts with a managed cluster"),
        F.when(F.col("min") < 0, "min must be >= 0").when(F.col("max") <= 0, "max must be > 0").when(F.col("min") > F.col("max"), "min cannot be greater than max"))))


def immutable_errors(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, errors) of pools in both tables (name, managed, compute_class)."""
    both = new.select("name", F.col("managed").alias("n"), F.coalesce("compute_class", F.lit("")).alias("nc")).join(
        old.select("name", F.col("managed").alias("o"), F.coalesce("compute_class", F.lit("")).alias("oc")), "name")
    have = F.col("n").isNotNull() & F.col("o").isNotNull()
    return both.select("name", F.array_compact(F.array(
        F.when(have & (F.col("n") != F.col("o")), "managed is immutable"),
        F.when(have & F.col("n") & (F.col("nc") != F.col("oc")), "compute class is immutable"),
        F.when(F.col("n").isNull() & F.coalesce("o", F.lit(False)), "cannot remove cluster settings"))).alias("errors"))


def pool_phase(ready: Column, desired: Column) -> Column:
    """Running when all are ready, Scaling when some are, else Pending (also when unknown)."""
    return F.when(ready == desired, "Running").when(ready > 0, "Scaling").otherwise("Pending")


def pool_config(pools: DataFrame) -> DataFrame:
    """(name, config map<string,string>) of (name, config map, preload array<struct<name,
    variant, strategy>>, loading, keep_alive, max_loaded): the user's settings over those
    derived; lists and maps are JSON."""
    preload = F.transform("preload", lambda m: F.concat(m["name"], F.when(F.coalesce(m["variant"], F.lit("")) != "", F.concat(F.lit(":"), m["variant"])).otherwise("")))
    chosen = F.filter("preload", lambda m: F.coalesce(m["strategy"], F.lit("")) != "")
    strategies = F.map_from_entries(F.transform(chosen, lambda m: F.struct(F.concat(m["name"], F.when(F.coalesce(m["variant"], F.lit("")) != "", F.concat(F.lit("-"), m["variant"])).otherwise("")), m["strategy"])))
    some = lambda key, value, when: F.when(when, F.create_map(F.lit(key), value)).otherwise(F.create_map().cast("map<string,string>"))
    alive = F.when(F.col("loading") == "eager", "0").otherwise(F.coalesce("keep_alive", F.lit("5m")))
    derived = [
        F.create_map(*[F.lit(x) for k in ("embedder", "chunker", "reranker") for x in (f"{k}_models_dir", f"/models/{k}s")]),
        some("preload", F.to_json(preload), F.size("preload") > 0),
        some("model_strategies", F.to_json(strategies), F.size(chosen) > 0),
        some("keep_alive", alive, F.col("loading").isin("eager", "lazy", "bounded")),
        some("max_loaded_models", F.col("max_loaded").cast("string"), (F.col("loading") == "bounded") & F.col("max_loaded").isNotNull()),
    ]
    user = F.coalesce("config", F.create_map().cast("map<string,string>"))
    rest = F.map_filter(F.map_concat(*derived), lambda k, v: ~F.array_contains(F.map_keys(user), k))
    return pools.select("name", F.map_concat(user, rest).alias("config"))


def queue_gauges(endpoints: DataFrame) -> DataFrame:
    """(pool, queue_depth) summed over the endpoints."""
    return endpoints.groupBy("pool").agg(F.sum("queue_depth").alias("queue_depth"))
