"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the leading bits of a key's hash. It starts with one
bucket; only buckets over the byte limit split on one more bit. The sizes of all
prefixes up to some depth come from one aggregation; only buckets still too large
at that depth are looked at again, deeper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import written

#: Bits of hash that the directory can use.
BITS = 60
#: Bits looked at in one aggregation.
STEP = 12
#: Directories of up to this many shards are broadcast (about 3 MB); larger ones are joined.
SMALL = 50_000


def hash_bits(key: Column) -> Column:
    """60 bits of a key's MD5 as a long; a null key has its own."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\0null")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows) of the shards of rows (h, n_bytes).

    A leaf is at most ``limit`` bytes, or a single hash, which no further bit can
    split (a row longer than the limit has a shard of its own)."""
    open_rows, base, found = rows, 0, None
    while True:
        top = min(BITS, base + STEP)
        deepest = open_rows.groupBy(_prefix(F.col("h"), F.lit(top)).alias("p")).agg(
            F.sum("n_bytes").alias("b"), F.count("*").alias("r"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        levels = F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")
        at = F.call_function("shiftright", F.col("p"), (F.lit(top) - F.col("depth")).cast("int")).alias("prefix")
        sizes = deepest.select(levels, "*").select("depth", at, "b", "r", "lo", "hi").groupBy("depth", "prefix").agg(
            F.sum("b").alias("shard_bytes"), F.sum("r").alias("shard_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        sizes = written(sizes.withColumn("splits", (F.col("shard_bytes") > limit) & (F.col("lo") < F.col("hi"))), "sizes")
        above = sizes.where("splits").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        leaves = sizes.where(f"not splits and depth > {base}").withColumn("up", F.call_function("shiftright", "prefix", F.lit(1))).join(
            above, ["depth", "up"], "left_semi")
        if base == 0:
            leaves = leaves.unionByName(sizes.where("not splits and depth = 0").withColumn("up", F.lit(0).cast("long")))
        leaves = leaves.select("depth", "prefix", "shard_bytes", "shard_rows")
        found = leaves if found is None else found.unionByName(leaves)
        large = sizes.where(f"splits and depth = {top}").select("prefix")
        if top == BITS or large.isEmpty():
            return written(found, "directory")
        open_rows = written(open_rows.withColumn("prefix", _prefix(F.col("h"), F.lit(top))).join(large, "prefix", "left_semi").select("h", "n_bytes"), "open")
        base = top


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, shard, depth, shard_bytes) of every row.

    ``shard`` is the hash prefix as bits (empty for a directory of one bucket).
    Null texts count 0 bytes; a null id hashes as a key of its own; rows of equal
    id share a hash and so a shard, above the limit if they must. An empty table
    has no shards and no rows. Ids are unique in the intended tables, so that a
    hot source or text cannot make a bucket large."""
    rows = written(_hashed(docs, id_col, text_col).select(F.col("row." + f"`{id_col}`").alias("id"), "n_bytes", "h"), "shard-rows")
    hit = _placed(rows, directory(rows.select("h", "n_bytes"), limit))
    return hit.select(F.col("id").alias(id_col), "n_bytes", _bits().alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes")


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, n_bytes, h) of every row, all its columns in one."""
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    return docs.select(F.struct("*").alias("row"), size.alias("n_bytes"), hash_bits(F.col(id_col)).alias("h"))


def _placed(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Rows with a hash ``h`` beside the leaf that their hash falls in."""
    count, least = shards.agg(F.count("*"), F.min("depth")).first()
    # all leaves lie at or below the least depth: rows meet the few leaves under their prefix of that many bits
    least = least or 0
    entries = shards.select("depth", F.col("prefix"), "shard_bytes",
                            F.call_function("shiftright", "prefix", (F.col("depth") - F.lit(least)).cast("int")).alias("entry"))
    entries = F.broadcast(entries) if count <= SMALL else entries
    keyed = rows.withColumn("entry", _prefix(F.col("h"), F.lit(least)))
    return keyed.join(entries, "entry").where(_prefix(F.col("h"), F.col("depth")) == F.col("prefix"))


def _bits() -> Column:
    return F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth").cast("int"), F.lit("0")))


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all rows as Parquet, one folder a shard (named b and its bits, so that readers
    take it for text); the name of the folders' column, ``shard_bits`` with underscores
    behind while the table has a column of that name.

    Every row carries its shard along, so that null and repeated ids, repeated rows and any
    other columns stay as they are. An empty table writes no shard."""
    column = "shard_bits"
    while column in [c.lower() for c in docs.columns]:
        column += "_"
    rows = _hashed(docs, id_col, text_col)
    shards = directory(written(rows.select("h", "n_bytes"), "shard-rows"), limit)
    placed = _placed(rows, shards).select("row.*", F.concat(F.lit("b"), _bits()).alias(column))
    placed.repartition(F.col(column)).write.partitionBy(column).parquet(path)
    return column
