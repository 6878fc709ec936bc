"""Prefix trie of conversations by smallest-member ownership.

Every distinct sequence of first turns is a node; its owner is the smallest of the
conversations that begin with it. Down a conversation's path members only get fewer, so
each conversation owns a suffix of its path, and (owner, depth) names a node. What a
subtree holds is then a sum over members: the tokens of each member's path below the
node, minus those of the nodes it owns there, and a flag of the leaf it may own. One
grouping by node adds both up; nothing walks the tree.

Texts stay in the scan: turns travel as digests. A prefix is known by four running sums
of its turns' digests with their places, 128 bits in all; running sums can be carried
over from block to block, so that a conversation of any length is many tasks' work.
Owners and sums come from aggregates that are joined back, not from a window over a
node's members, as the root has all conversations and a common first turn many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import written

#: Turns of one conversation that one task sums up.
BLOCK = 4096
#: Conversation ids in one piece of text on the way to a digest.
PIECE = 50_000
LANES = ("k0", "k1", "k2", "k3")


def ordered_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos from 1, digest, n_bytes) of every turn, written to the shared folder.

    Turns are ordered by number, null first, equal numbers by their digest (SHA-256 of
    role and text); null role or text is empty. Rows without conversation belong to none
    and are left out. The sort is by range: a conversation of many rows is split, and its
    later parts count on from the earlier ones."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(part(role_col)).cast("string"), F.lit(":"), part(role_col), part(text_col)), 256))
    turns = rows.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), digest.alias("digest"),
        F.octet_length(part(text_col)).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "row"]
    ranges = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranges = written(ranges.select("conv_id", "at", F.shiftright("at", 33).alias("part"), "digest", "n_bytes"), "turns")
    parts = ranges.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("conv_id", "part", (F.col("first") - F.coalesce(earlier, F.lit(0)) - 1).alias("start"))
    return written(ranges.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("start")).alias("pos"), "digest", "n_bytes"), "ordered")


def with_shared_heads(turns: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """((conv_id, pos, digest, n_bytes), (conv_id, size)) of conversations that begin with the
    first h turns of the conversation ``conv_id - conv_id % group`` (all if it has fewer,
    none if it is absent) instead of their own first h; h is the CRC-32 of the id as text
    modulo ``most``. A conversation may be left without turns: its size is 0."""
    sizes = written(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "sizes")
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % most).alias("h")
    heads = sizes.select(F.col("conv_id").alias("head"), F.col("own").alias("head_size"))
    plan = sizes.select("conv_id", "own", h, (F.col("conv_id") - F.col("conv_id") % group).alias("head")).join(heads, "head", "left")
    taken = F.least("h", F.coalesce("head_size", F.lit(0)))
    plan = written(plan.select("conv_id", "head", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "heads")
    first = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "head")
    first = plan.where("taken > 0").select("conv_id", "head", "taken").join(first, "head").where("pos <= taken").select("conv_id", "pos", "digest", "n_bytes")
    rest = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "n_bytes")
    return first.unionByName(rest), plan.select("conv_id", "size")


def paths(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, size, n_bytes, before, up0 to up3, k0 to k3), a row for each conversation and
    depth from 0: bytes of its last text and of the texts before, keys of parent and node."""
    hexed = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), F.hex("digest")), 256)
    lane = lambda k: F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long")
    steps = turns.select("conv_id", "pos", "n_bytes", F.floor((F.col("pos") - 1) / BLOCK).alias("block"), *[lane(k).alias(f"x{k}") for k in range(4)])
    summed = ["n_bytes", "x0", "x1", "x2", "x3"]
    line = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    inside = steps.select("conv_id", "pos", "block", *summed, *[F.sum(c).over(line).alias(f"s_{c}") for c in summed])
    # only conversations of several blocks have rows here
    blocks = steps.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in summed])
    so_far = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", *[F.sum(c).over(so_far).alias(f"c_{c}") for c in summed]).where("block > 0")
    both = inside.join(written(carried, "carried"), ["conv_id", "block"], "left")
    total = {c: F.col(f"s_{c}") + F.coalesce(F.col(f"c_{c}"), F.lit(0)) for c in summed}
    deep = both.select("conv_id", F.col("pos").alias("depth"), "n_bytes", (total["n_bytes"] - F.col("n_bytes")).alias("before"),
                       *[(total[f"x{k}"] - F.col(f"x{k}")).alias(f"up{k}") for k in range(4)], *[total[f"x{k}"].alias(f"k{k}") for k in range(4)])
    none = F.lit(None).cast("long")
    top = members.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("before"),
                         *[none.alias(f"up{k}") for k in range(4)], *[F.lit(0).cast("long").alias(k) for k in LANES])
    return deep.unionByName(top).join(members.select("conv_id", "size"), "conv_id")


def _id_texts(batches):
    """Decimal ids of sorted (key, id) rows as comma-joined pieces of at most PIECE ids."""
    import pyarrow as pa

    def rows(key, ids):
        columns = [[v] for v in key] + [[ids[0]], [",".join(map(str, ids))]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1])], names=["depth", *LANES, "first", "piece"])

    key, ids = None, []
    for batch in batches:
        for *now, conv in zip(*(batch.column(k).to_pylist() for k in range(6))):
            if ids and (now != key or len(ids) == PIECE):
                yield rows(key, ids)
                ids = []
            key = now
            ids.append(conv)
    if ids:
        yield rows(key, ids)


def _digests(batches):
    """SHA-256 over the pieces of each key, which come in order."""
    import hashlib

    import pyarrow as pa

    key, state, done = None, None, []

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*(d[0] for d in done))] + [pa.array([d[1] for d in done])], names=["depth", *LANES, "ends_sha256"])

    for batch in batches:
        for *now, _, piece in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if now != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                    if len(done) >= 4096:
                        yield rows()
                        done.clear()
                key, state = now, hashlib.sha256(piece.encode())
            else:
                state.update(b",")
                state.update(piece.encode())
    if state is not None:
        done.append((key, state.hexdigest()))
        yield rows()


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k0 to k3, ends_sha256): SHA-256 of the ascending comma-joined decimal ids that
    end at each node. The ids are sorted by range and turned into text there, so that a
    node at which very many end is many tasks' work; one task then reads only the pieces
    of a node one by one (SHA-256 takes them in order)."""
    node = ["depth", *LANES]
    kind = "depth long, k0 long, k1 long, k2 long, k3 long"
    ids = ends.select(*node, "conv_id").repartitionByRange(*node, "conv_id").sortWithinPartitions(*node, "conv_id")
    pieces = ids.mapInArrow(_id_texts, f"{kind}, first long, piece string")
    return pieces.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(_digests, f"{kind}, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``turns`` (conv_id, pos from 1 without gaps, digest, n_bytes), ``members`` one row
    (conv_id, size) a conversation, those of size 0 included. conv_id is the smallest
    member, parent_conv_id that of the parent (null for the root). n_leaves counts nodes
    without children in the subtree, saved_tokens sums over it the bytes of each node's
    last text times its members but one. Equal conversations share all nodes. No member,
    no node: an empty table has no rows."""
    node = ["depth", *LANES]
    up = [f"up{k}" for k in range(4)]
    steps = written(paths(turns, members), "paths")
    nodes = written(steps.groupBy(*node).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("size").alias("longest"),
                                             F.min("n_bytes").alias("n_bytes"), *[F.min(u).alias(u) for u in up]), "nodes")
    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.sum("n_bytes").alias("owned"), F.max((F.col("depth") == F.col("longest")).cast("long")).alias("leaf"))
    whole = steps.groupBy("conv_id").agg(F.sum("n_bytes").alias("total"))
    # bytes on the path above what a conversation owns, and whether it owns a leaf
    shares = written(whole.join(owned, "conv_id", "left").select("conv_id", (F.col("total") - F.coalesce("owned", F.lit(0))).alias("above"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "shares")
    again = steps.select("conv_id", "before", *node).join(shares, "conv_id")
    sums = again.groupBy(*node).agg(F.sum(F.greatest(F.col("above") - F.col("before"), F.lit(0))).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(k).alias(u) for k, u in zip(LANES, up)], F.col("owner").alias("parent_conv_id"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(u).alias(k) for k, u in zip(LANES, up)]).agg(F.count("*").alias("n_children"))
    ends = end_digests(steps.where("depth = size"))
    out = nodes.join(sums, node).join(children, node, "left").join(ends, node, "left").join(parents, ["depth", *up], "left")
    return out.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
