"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors at cosine >= c lie within epsilon = sqrt(2 - 2c) of each other. With P on
the leading principal dimensions and r = v - Pv, |u - v|^2 is at least
|Pu - Pv|^2 + (|ru| - |rv|)^2. Vectors are sorted by their grid cells (of side epsilon)
in the leading dimensions; intervals of the sorted sequence are joined recursively, and
a pair of sequences whose boxes of (Pv, |rv|) lie further apart than epsilon is skipped.
Equal vectors are one node with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import connected_components, written

#: Leading dimensions with grid cells; vectors that the dimensions are fitted on.
LEADING, SAMPLE = 6, 8192
#: Vectors of a block; of an interval at least, and bytes of one at most (a task holds two);
#: intervals at most (whose boxes are broadcast, 8 MB); blocks joined as doubles at once.
BLOCK, INTERVAL, INTERVAL_BYTES, INTERVALS = 256, 4096, 32 << 20, 1 << 16
LEAF = 8


def _unit(batches: Iterator):
    """(id, vec): the vector's bytes, a letter for its kind before them (f: all its numbers are
    floats, d: doubles); null where it links with nothing."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for x in batch.column(1):
            v = x.as_py()
            v = None if not v or None in v else np.array(v, np.float64)
            if v is None or not np.isfinite(v).all() or not v.any():
                out.append(None)
                continue
            v += 0.0  # one zero
            with np.errstate(over="ignore"):
                short = v.astype(np.float32)
            out.append(b"f" + short.tobytes() if (short == v).all() else b"d" + v.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])


def _normalised(raw: bytes) -> np.ndarray:
    v = np.frombuffer(raw, np.float32 if raw[:1] == b"f" else np.float64, offset=1).astype(np.float64)
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


def principal(sample: list[bytes]) -> dict[int, np.ndarray]:
    """By length of vector: [length, <= LEADING] orthonormal leading directions."""
    by: dict[int, list[np.ndarray]] = {}
    for raw in sample:
        v = _normalised(raw)
        by.setdefault(len(v), []).append(v)
    out = {}
    for n, vs in by.items():
        x = np.array(vs)
        out[n] = np.linalg.eigh((x - x.mean(0)).T @ (x - x.mean(0)))[1][:, ::-1][:, :LEADING]
    return out


def _far(a: np.ndarray, b: np.ndarray, epsilon: float) -> np.ndarray:
    """Whether boxes [..., 2, LEADING + 2] (the first: the length of the vectors, which must
    be equal) lie further apart than epsilon."""
    gap = np.maximum(np.maximum(a[..., 0, :] - b[..., 1, :], b[..., 0, :] - a[..., 1, :]), 0.0)
    return (gap[..., 0] > 0) | ((gap[..., 1:] ** 2).sum(-1) > epsilon**2)


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links with the components of a bipartite matrix: (node, smallest node), columns after rows."""
    rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    part = linked[np.ix_(rows, cols)]
    most = linked.shape[0] + linked.shape[1]
    a = rows.copy()
    while True:
        b = np.where(part, a[:, None], most).min(0)
        after = np.where(part, b[None], most).min(1)
        after = np.minimum(a, after)
        if (after == a).all():
            break
        a = after
    return list(zip(rows.tolist(), a.tolist())) + list(zip((cols + linked.shape[0]).tolist(), b.tolist()))


class _Block:
    def __init__(self, row: dict):
        self.box = np.array([row["low"], row["high"]])
        self.reps = np.frombuffer(row["reps"], np.int64)
        self.weights = np.frombuffer(row["weights"], np.int64)
        self.raw = row["vecs"]  # as they came: half the bytes of doubles where they were floats
        self.links = np.zeros(len(self.reps), np.int64)

    def unit(self) -> np.ndarray:
        width = int(self.box[0, 0])
        if self.raw[:1] == b"f":
            x = np.frombuffer(self.raw, np.float32, offset=1).astype(np.float64).reshape(-1, width)
            x = x / np.abs(x).max(1, keepdims=True)
            return x / np.sqrt((x * x).sum(1, keepdims=True))
        return np.frombuffer(self.raw, np.float64, offset=1).reshape(-1, width)


class _Join:
    """Recursive join of two sequences of blocks; counts links and keeps a forest."""

    def __init__(self, least: float, epsilon: float):
        self.least, self.epsilon, self.parent = least, epsilon, {}

    def root(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(p, p)
            x = p
        return x

    def blocks(self, a: _Block, x: np.ndarray, b: _Block, y: np.ndarray) -> None:
        linked = x @ y.T >= self.least
        if a is b:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        a.links += linked @ b.weights
        if a is not b:
            b.links += a.weights @ linked
        n = len(a.reps)
        name = lambda k: int(a.reps[k]) if k < n else int(b.reps[k - n])
        for x, y in _forest(linked):
            x, y = self.root(name(x)), self.root(name(y))
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def run(self, a: list[_Block], b: list[_Block]) -> None:
        if not a or not b:
            return
        box = lambda s: np.stack([np.min([x.box[0] for x in s], 0), np.max([x.box[1] for x in s], 0)])
        if _far(box(a), box(b), self.epsilon):
            return
        if len(a) <= LEAF and len(b) <= LEAF:
            xs = [x.unit() for x in a]
            ys = xs if a is b else [y.unit() for y in b]
            for i, (p, x) in enumerate(zip(a, xs)):
                for q, y in list(zip(b, ys))[i if a is b else 0 :]:
                    if not _far(p.box, q.box, self.epsilon):
                        self.blocks(p, x, q, y)
        elif a is b:
            k = len(a) // 2
            first, second = a[:k], a[k:]
            self.run(first, first)
            self.run(first, second)
            self.run(second, second)
        elif len(a) >= len(b):
            self.run(a[: len(a) // 2], b)
            self.run(a[len(a) // 2 :], b)
        else:
            self.run(a, b[: len(b) // 2])
            self.run(a, b[len(b) // 2 :])


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept): links at cosine >= ``cosine`` in double precision.

    Null, zero and empty vectors and those with null or non-finite components
    link with nothing, nor do vectors of different lengths. Equal vectors under
    repeated ids count as other vectors. Rows with a null id count as vectors and link
    like any other but name no component: where no id can be reached component_id is
    null, and such a row is kept. An empty table gives no rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    rows = written(rows.mapInArrow(_unit, "id long, vec binary"), "vectors")
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # numbered once: no two share a number
    count, width = classes.agg(F.count("*"), F.avg(F.octet_length("vec"))).first()
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9)
    axes = principal([bytes(r[0]) for r in classes.select("vec").orderBy(F.xxhash64("vec"), "rep").limit(SAMPLE).collect()])  # bounded by SAMPLE
    cells = [f"c{k}" for k in range(LEADING + 1)]

    def celled(batches):
        import pyarrow as pa

        for batch in batches:
            at, raws = np.zeros((batch.num_rows, LEADING + 2)), batch.column(0).to_pylist()
            for k, raw in enumerate(raws):
                v = _normalised(raw)
                p = v @ axes[len(v)] if len(v) in axes else v[:LEADING]
                at[k, 0], at[k, 1 : 1 + len(p)], at[k, -1] = len(v), p, np.sqrt(max(0.0, 1 - p @ p))
            out = np.floor(at[:, :-1] / np.array([1.0] + [epsilon] * LEADING)).astype(np.int32)
            place = pa.array(list(at), pa.list_(pa.float64()))
            kinds = pa.array([raw[:1].decode() for raw in raws])
            yield pa.RecordBatch.from_arrays([*batch.columns, kinds, place, *(pa.array(out[:, k]) for k in range(LEADING + 1))], names=["vec", "rep", "weight", "kind", "place", *cells])

    def blocked(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), *((n, pa.binary()) for n in ("reps", "weights", "vecs"))])

        def block(taken):
            nonlocal k
            places, k = np.array([r[3] for r in taken]), k + 1
            if all(r[0][:1] == b"f" for r in taken):
                vecs = b"f" + b"".join(r[0][1:] for r in taken)
            else:
                vecs = b"d" + b"".join(_normalised(r[0]).tobytes() for r in taken)
            margin = 1e-9 * (np.arange(places.shape[1]) > 0)
            return {"part": part, "block": k, "low": (places.min(0) - margin).tolist(), "high": (places.max(0) + margin).tolist(), "reps": np.array([r[1] for r in taken], np.int64).tobytes(),
                    "weights": np.array([r[2] for r in taken], np.int64).tobytes(), "vecs": vecs}

        kept: list = []
        for batch in batches:
            ready = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if kept and (len(kept) == BLOCK or kept[-1][3][0] != r[3][0]):  # full, or another length
                    ready.append(block(kept))
                    kept = []
                kept.append(r)
            yield pa.RecordBatch.from_pylist(ready, schema)
        if kept:
            yield pa.RecordBatch.from_pylist([block(kept)], schema)

    # as few intervals as keep all cores in pairs of them, of bounded size: each travels to every other it may touch
    cores = spark.sparkContext.defaultParallelism
    least = min(-(-count // INTERVAL), round((6 * cores) ** 0.5))
    parts = max(1, least, -(-int(count * (width or 0)) // INTERVAL_BYTES))
    if parts > INTERVALS:
        raise ValueError(f"more than {INTERVALS} intervals of {INTERVAL_BYTES} bytes")
    ordered = classes.select("vec", "rep", "weight").mapInArrow(celled, "vec binary, rep long, weight long, kind string, place array<double>, " + ", ".join(f"{c} int" for c in cells))
    ordered = ordered.repartitionByRange(parts, *cells, "rep").sortWithinPartitions(*cells, "rep").select("vec", "rep", "weight", "place")
    block = "part int, block int, low array<double>, high array<double>, reps binary, weights binary, vecs binary"
    blocks = written(ordered.mapInArrow(blocked, block), "blocks")
    edge = lambda name, fold: F.array(*[fold(F.col(name)[k]) for k in range(LEADING + 2)])
    boxes = blocks.groupBy("part").agg(edge("low", F.min).alias("low"), edge("high", F.max).alias("high")).orderBy("part").collect()  # a row for each interval
    sent = spark.sparkContext.broadcast(([r[0] for r in boxes], np.array([[r[1], r[2]] for r in boxes]).reshape(-1, 2, LEADING + 2)))

    def dealt(batches):
        import pyarrow as pa

        names, grid = sent.value
        for batch in batches:
            for k, (part, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
                others = [names[i] for i in np.flatnonzero(~_far(grid, np.array([low, high]), epsilon))]
                row = batch.slice(k, 1)
                for s in range(0, len(others), 64):
                    some = others[s : s + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([min(part, o) for o in some], pa.int32()), pa.array([max(part, o) for o in some], pa.int32()),
                         *(c.take(pa.array([0] * len(some), pa.int64())) for c in row.columns)], names=["a", "b", *batch.schema.names])

    def joined(batches):
        import pyarrow as pa

        def finish(key, sides):
            join = _Join(cosine, epsilon)
            first, second = sides
            join.run(first, first if key[0] == key[1] else second)
            rows = [(int(r), int(n), None) for x in first + second for r, n in zip(x.reps, x.links) if n]
            rows += [(x, 0, y) for x in list(join.parent) if (y := join.root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                               pa.array([r[2] for r in rows], pa.int64())], names=["rep", "links", "other"])

        key, sides = None, ([], [])
        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["a"], row["b"]):
                    if key is not None:
                        yield finish(key, sides)
                    key, sides = (row["a"], row["b"]), ([], [])
                sides[row["part"] != key[0]].append(_Block(row))
        if key is not None:
            yield finish(key, sides)

    tasks = max(len(boxes) * (len(boxes) + 1) // 2 if len(boxes) < 64 else 32 * len(boxes), cores)
    pairs = blocks.mapInArrow(dealt, "a int, b int, " + block).repartition(tasks, "a", "b").sortWithinPartitions("a", "b", "part", "block")
    found = written(pairs.mapInArrow(joined, "rep long, links long, other long"), "met")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parents = connected_components(found.where("other is not null"), "rep", "other")
    named = classes.join(links, "rep", "left").join(parents, F.col("rep") == F.col("node"), "left")
    named = written(named.select("vec", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "named")
    firsts = written(named.groupBy("component").agg(F.min("first").alias("component_id")), "firsts")
    named = named.select("vec", "n_links", "component").join(firsts, "component").withColumn("linked", F.lit(True))
    out = rows.join(named, "vec", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                                                 F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
