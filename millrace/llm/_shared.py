"""Shared-folder tables and connected components used by several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where nothing names one and the session is local (tests) a temporary folder is
    set; on a cluster, whose executors would not see it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the input has fewer splits than there are (a small
    file of one row group would be one task of long texts); else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Bytes of a batch of rows on its way to Python; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on in this session whole texts travel to Python in batches of BATCH_BYTES at most,
    which both sides hold several copies of."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def written(df: DataFrame, tag: str, partitions: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a
    lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_resident: dict = {}


def resident(key, make):
    """A worker process's one large object (a tokenizer, a model's tables): made at its
    first use, dropped as soon as another is asked for. ``key`` None only drops."""
    if key not in _resident:
        _resident.clear()
        tidy()
        if key is None:
            return None
        _resident[key] = make()
    return _resident[key]


def tidy() -> None:
    """Give freed memory of this worker process back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(own := ctypes.CDLL(None), "malloc_trim"):
        own.malloc_trim(0)


def _local_forests(batches):
    """Replace each batch of links by links to the smallest member of its component."""
    import pyarrow as pa

    for batch in batches:
        parent: dict[int, int] = {}

        def root(x):
            while (p := parent.get(x, x)) != x:
                parent[x] = parent.get(p, p)
                x = p
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["v", "u"])


def local_forests(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links (v > u) with the same components as (a, b), at most one a node and batch.

    Self links vanish; null ends are dropped (they link nothing)."""
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    return ends.mapInArrow(_local_forests, "v long, u long")


def _settled(edges: DataFrame) -> bool:
    """Whether links (v > u) are stars: every v has one link and is no other's u."""
    ends = edges.select(F.col("v").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select("u", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


#: Links (16 bytes each) that one task finishes at once; more go round by round.
LINKS_AT_ONCE = 1 << 19


def _forest(batches):
    """(node, component) of all links of one task."""
    import numpy as np
    import pyarrow as pa

    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if not parts:
        return
    ids, ends = np.unique(np.concatenate([np.concatenate(c) for c in zip(*parts)]), return_inverse=True)
    u, v = ends.reshape(2, -1)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, label[u], low)
        np.minimum.at(after, label[v], low)
        while (after != (further := after[after])).any():
            after = further
        if (after == label).all():
            break
        label = after
    for k in range(0, len(ids), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + (1 << 16)]), pa.array(ids[label[k : k + (1 << 16)]])], names=["node", "component"])


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node with a link to another node the smallest
    node reachable. Nodes without links are absent.

    Up to LINKS_AT_ONCE links (counted once tasks have made forests of theirs) are one
    task's work. More alternate large and small stars until all links are stars, whose
    middles are the smallest nodes as every link leads down; every round is a written table
    and each join is with a table of one row a node, so that a hub's rows can be split. The
    driver sees a count, or one bit a round."""
    edges = written(local_forests(links, a, b).distinct(), "links")
    if edges.count() <= LINKS_AT_ONCE:
        return written(edges.coalesce(1).mapInArrow(_forest, "node long, component long"), "components")
    while not _settled(edges):
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).union(edges.select("v", "u"))
        least = written(both.groupBy("n").agg(F.least("n", F.min("w")).alias("m")), "least")
        large = both.where("w > n").join(least, "n").select(F.col("w").alias("v"), F.col("m").alias("u"))
        large = written(large.where("u < v").distinct(), "large")
        least = written(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v")
        edges = written(small.union(least.select("v", F.col("m").alias("u"))).distinct(), "small")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
