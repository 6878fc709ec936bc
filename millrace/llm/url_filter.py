"""URL filters by a sort-merge range join, with DataFrame functions only.

Reversed hosts turn a host and its subdomains into one interval of keys. URLs and
rule hosts are sorted together and swept once; what is open at a URL is the stack
of nested rule hosts that the last rule host before it stands on. The sort is by
range, so that a host with a third of all URLs is split; what is open where a range
begins is carried over from the ranges before it, a row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import written

#: URLs in one range of the sweep.
RANGE_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def reversed_host(host: Column) -> Column:
    """``a.example.net`` as ``net.example.a.``: hosts below another share its prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row.

    ``rules`` has (host, path, verdict), path with its leading slash; a rule fits
    its host and all subdomains where the path starts with its own. The longest
    rule wins, ties by its text; without any, rule is null and verdict ``default``.
    Null or malformed URLs have empty host and path and fit no rule. Repeated rows
    stay. A rule host holds at most its own rules: their number bounds a stack."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", F.when(F.col("host") == "", F.lit("")).otherwise(reversed_host(F.col("host"))))
    # what each rule host stands on: the rules of all rule hosts that are prefixes of it
    own = rules.groupBy(reversed_host(F.translate("host", UPPER, LOWER)).alias("key")).agg(
        F.collect_list(F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "path", "verdict")).alias("rules"))
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), "\\.")
    steps = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.array_join(F.slice(labels, F.lit(1), k), "."), F.lit(".")))).alias("under"))
    stacks = steps.join(own.select(F.col("key").alias("under"), "rules"), "under").groupBy("key").agg(F.collect_list(F.struct("under", "rules")).alias("stack"))
    events = urls.select("key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")).unionByName(
        stacks.select("key", F.lit(0).alias("kind"), "stack"), allowMissingColumns=True)
    count = pages.select(id_col).count()
    ranges = max(pages.sparkSession.sparkContext.defaultParallelism, -(-count // RANGE_ROWS))
    dealt = written(events.repartitionByRange(ranges, "key", "kind", "id", "path").withColumn("part", F.spark_partition_id()), "sweep")
    line = Window.partitionBy("part").orderBy("key", "kind")
    # the sorted ranges: what is open at the start of each, one row a range
    last = dealt.groupBy("part").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("key"))).alias("stack"))
    carried = written(last.select("part", F.last("stack", ignorenulls=True).over(
        Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried")), "carried")
    swept = dealt.withColumn("open", F.last("stack", ignorenulls=True).over(line)).where("kind = 1")
    swept = swept.join(F.broadcast(carried), "part").withColumn("open", F.coalesce("open", "carried"))
    active = F.filter("open", lambda s: F.startswith(F.col("key"), s["under"]))
    fitting = F.filter(F.flatten(F.transform(active, lambda s: s["rules"])), lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.coalesce(fitting, F.slice(fitting, F.lit(1), F.lit(0))))
    out = swept.select("id", "host", "path", best.alias("best"))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
