"""SimHash near-duplicates by anchor-point covering.

Links at two or fewer differing bits (exact): of the two halves of a fingerprint
one differs in at most one bit. Each half is covered by the Hamming code on 31
bits (covering radius 1) times the free 32nd bit. A fingerprint is replicated to
every anchor within covering radius plus threshold (1 + 1) of its half and
compared per anchor with those whose own nearest anchor it is; nothing is missed.

Near duplicates by similarity (five-word shingles, 0.8): the same anchors idea with
the trivial code on 20 and more of 1024 fingerprint bits, in 153 and more choices of
bits. What meets at an anchor and is near by 64 bits falls into one family; families
(of bounded size, larger ones by anchor) are decided by their sets of shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import connected_components, local_forests, resident, tidy, written

SEED = 42
#: Shingles hashed at once.
BLOCK = 1 << 16
#: 64-bit words of a wide fingerprint.
WIDE = 16
#: Least bits of an anchor choice (more for more texts, so that strangers seldom meet); odds
#: that a pair at the bound meets; differing bits of 64 beyond which two texts do not meet
#: (at 0.8 9.7 are expected and over 21 have odds of 1 in 8,000).
CHOICE, MEET, NEAR64 = 20, 0.997, 21
#: How far a pair's estimate may be below the bound to be decided by its shingles: four
#: standard errors (0.025 at 0.8).
SLACK = 0.1
#: Up to so many shingles, texts also meet by their least shingle hashes and are not estimated.
SHORT = 40
#: Entries of one task in the per-anchor comparison.
ENTRIES = 1 << 20
#: Entries of an anchor that are compared with those next to them; beyond CROWD they are one family unseen.
FEW, CROWD = 64, 8192
#: Links of families that are merged at once; keys of texts that are broadcast (8 MB).
FOREST, SENT = 1 << 20, 1 << 20
#: Texts, and bytes of their shingle hashes, that one task compares as one family or block.
MEMBERS, SETS = 4096, 8 << 20
#: Blocks of a family whose pairs are compared as they are; a larger family's texts meet at each anchor, of which a text has some dozens.
PAIRED = 16
#: Least anchor that is a shingle hash of a short text.
LEAST = 1 << 62
#: Pairs compared at once inside an anchor; shingles looked up at once.
WORDS = 1 << 20
#: Fingerprints dealt out at once.
SLICE = 2000
#: Fingerprints in a task that deals them out.
PART = 10_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8, dtype=np.uint16) * 256)[None]


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the space-joined shingles of ASCII-lower-cased words, in blocks."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()  # splits at 09-0D and 20 only
    n = len(found) - words + 1
    if n <= 1:
        if found:
            yield np.array([xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
        return
    for k in range(0, n, BLOCK):
        stop = min(n, k + BLOCK)
        shingles = map(b" ".join, zip(*(found[k + j : stop + j] for j in range(words))))
        yield np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, stop - k)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of 64 bits set."""
    raw = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 512:
        return np.unpackbits(raw, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return (np.bincount((raw + _LANES).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()


def majority(counts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint words from counts of bits: 1 where over half are set."""
    return np.packbits(counts * 2 > n, bitorder="little").view("<u8")


def fingerprint(text: str, words: int = 3) -> int:
    n, counts = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, words):
        n += len(h)
        counts += bit_counts(h)
    return int(majority(counts, n)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row; repeats of a shingle count, no words give 0 (as do null texts)."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or "", words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, fp long")


def _masks() -> list[list[int]]:
    """By syndrome: what turns a half into each anchor within distance 2, the nearest first."""
    out = []
    for s in range(32):
        home = 1 << (s - 1) if s else 0
        pairs = [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if s and i < i ^ s]
        out.append([home, home ^ 1 << 31, *pairs])
    return out


def _syndrome(half: Column) -> Column:
    """XOR of the numbers (1 to 31) of the set bits of the lower 31."""
    checks = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]
    return sum((F.bit_count(half.bitwiseAND(F.lit(m).cast("long"))) % 2 * (1 << k) for k, m in enumerate(checks)), F.lit(0)).cast("int")


def links_within_two(groups: DataFrame) -> DataFrame:
    """(v, u) links with the components of all pairs of fingerprints at most two bits
    apart, of rows (fp, rep) with distinct fp: every pair is met, and each batch of
    pairs is handed on as a spanning forest.

    The join is a sort-merge join at every size: Spark sizes the 34 and more rows that
    each row becomes as one, and would send them all through the driver."""
    low = F.lit(0xFFFFFFFF).cast("long")
    halves = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("side"), F.col("fp").bitwiseAND(low).alias("y")),
                               F.struct(F.lit(1 << 32).cast("long").alias("side"), F.shiftrightunsigned("fp", 32).alias("y")))).alias("half")
    masks = _masks()
    rows = groups.select("fp", "rep", halves).select("fp", "rep", "half.*").withColumn("s", _syndrome(F.col("y")))
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in masks])
    anchors = F.explode(F.get(table, F.col("s"))).alias("m")
    every = rows.select("fp", "rep", "side", "y", anchors).select(
        F.col("side").bitwiseOR(F.col("y").bitwiseXOR(F.col("m"))).alias("anchor"), F.col("fp").alias("fp_b"), F.col("rep").alias("rep_b"))
    homes = F.get(F.array(*[F.lit(row[0]).cast("long") for row in masks]), F.col("s"))
    nearest = rows.select(F.col("side").bitwiseOR(F.col("y").bitwiseXOR(homes)).alias("anchor"), "fp", "rep")
    pairs = nearest.join(every.hint("merge"), "anchor").where((F.col("fp") < F.col("fp_b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= 2))
    return local_forests(pairs, "rep", "rep_b")


def components(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): documents linked at two or fewer bits, directly or in turn.

    Equal fingerprints are one node, so copies cost nothing; texts without words
    have fingerprint 0 and link like any other. Repeated ids keep their rows; a
    null id never names a component (of null ids alone the component is null)."""
    fps = written(fingerprints(docs, words, id_col, text_col), "fps")
    groups = written(fps.groupBy("fp").agg(F.min("id").alias("rep")), "groups")
    found = connected_components(links_within_two(groups.where("rep is not null")), "v", "u")
    named = written(groups.join(found, groups.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "named")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near duplicates by similarity -----------------------------------------


def wide_fingerprint(text: str, words: int) -> tuple[int, np.ndarray]:
    """(number of distinct shingles, WIDE words): each word is a SimHash under another mix of the hashes."""
    return _wide(shingle_set(text, words))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def _wide(h: np.ndarray) -> tuple[int, np.ndarray]:
    if not len(h):
        return 0, np.zeros(WIDE, "<u8")
    counts = np.zeros((WIDE, 64), np.int64)
    for k in range(WIDE):
        x = h
        if k:
            x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x1000193 & 0xFFFFFFFFFFFFFFFF)
            x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            x = x ^ x >> np.uint64(32)
        counts[k] = bit_counts(x)
    return len(h), majority(counts.ravel(), len(h))


def _width(texts: int) -> int:
    return max(CHOICE, (texts - 1).bit_length())


def _choices(width: int, similarity: float) -> np.ndarray:
    """[choices, width] bit numbers: shuffles of all bits, cut into choices. So many that two
    texts of this similarity agree on all bits of one with odds of MEET."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    count = math.ceil(math.log(1 - MEET) / math.log1p(-max((1 - share) ** width, 1e-9)))
    rng, per = np.random.default_rng(7), WIDE * 64 // width
    return np.concatenate([rng.permutation(WIDE * 64)[: per * width].reshape(per, width) for _ in range(-(-count // per))])[:count]


def _stars(key: np.ndarray, rep: np.ndarray, fp: np.ndarray):
    """Entries sorted by (key, rep): (links to heads, heads). A head is the first entry of
    an anchor; entries far from it get the next head among themselves, and so on."""
    order = np.lexsort((rep, key))
    key, rep, fp = key[order], rep[order], fp[order]
    links, heads = [], []
    while len(key):
        first = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        near = np.bitwise_count(fp ^ fp[head]) <= NEAR64
        other = near & ~first & (rep != rep[head])
        links.append(np.stack([rep[other], rep[head[other]]], 1))
        heads.append(np.stack([key[first], rep[first], fp[first].view(np.int64)], 1))
        key, rep, fp = key[~near], rep[~near], fp[~near]
    empty = np.zeros((0, 3), np.int64)
    return np.unique(np.concatenate(links or [empty[:, :2]]), axis=0), np.concatenate(heads or [empty])


def _keys(wide: np.ndarray, choices: np.ndarray) -> np.ndarray:
    """Anchors of the fingerprints, all of the first choice before those of the second."""
    bits = np.unpackbits(wide, axis=1, bitorder="little")
    weights = 1 << np.arange(choices.shape[1], dtype=np.int64)
    return np.concatenate([bits[:, c] @ weights | k << choices.shape[1] for k, c in enumerate(choices)])


def _dealt(keys: np.ndarray, buckets: int):
    """(order, ends): positions of the keys by bucket, and where each bucket ends."""
    place = (keys * 0x9E3779B1 >> 12) % buckets
    order = np.argsort(place, kind="stable")
    return order, np.searchsorted(place[order], np.arange(buckets + 1))


def _candidates(buckets: int, choices: np.ndarray):
    def work(batches):
        import pyarrow as pa

        resident(None, None)
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            n = batch.num_rows
            rep = np.array(batch.column(0))
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, WIDE * 8)
            fp = wide[:, :8].copy().view("<u8").ravel()
            links, heads = _stars(_keys(wide, choices), np.tile(rep, len(choices)), np.tile(fp, len(choices)))
            rows = [(-1 - int(rep[0]) % buckets, links.tobytes())]
            order, ends = _dealt(heads[:, 0], buckets)
            rows += [(k, heads[order[ends[k] : ends[k + 1]]].tobytes()) for k in range(buckets) if ends[k] < ends[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "packed"])
        tidy()

    return work


def _met(batches):
    import pyarrow as pa

    resident(None, None)

    def out(links):
        for k in range(0, len(links), 1 << 16):
            part = links[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["a", "b"])

    held = []
    for batch in batches:
        for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = np.frombuffer(packed.as_buffer(), np.int64)
            if bucket < 0:
                yield from out(rows.reshape(-1, 2))
            else:
                held.append(rows.reshape(-1, 3))
    if held:
        rows = np.concatenate(held)
        yield from out(_stars(rows[:, 0], rows[:, 1], rows[:, 2].copy().view(np.uint64))[0])
        del rows
        tidy()


def _entries(buckets: int, choices: np.ndarray):
    """Every anchor of every node: a row a slice and bucket, with each node once."""

    def work(batches):
        import pyarrow as pa

        resident(None, None)
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            n = batch.num_rows
            wide = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, WIDE * 8)
            nodes = np.stack([np.array(batch.column(0)), np.array(batch.column(1)), wide[:, :8].copy().view("<i8").ravel()], 1)
            keys, place = _keys(wide, choices), np.tile(np.arange(n), len(choices))
            least = [np.frombuffer(x or b"", np.int64) for x in batch.column(3).to_pylist()]
            keys = np.concatenate([keys, *least])
            place = np.concatenate([place, np.repeat(np.arange(n), [len(x) for x in least])])
            order, ends = _dealt(keys, buckets)
            rows = []
            for k in range(buckets):
                if ends[k] < ends[k + 1]:
                    at = order[ends[k] : ends[k + 1]]
                    used, where = np.unique(place[at], return_inverse=True)
                    low, high = (keys[at] & 0xFFFFFFFF).astype("<u4"), (keys[at] >> 32).astype("<i4")
                    rows.append((k, nodes[used].tobytes(), low.tobytes() + high.tobytes(), where.astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "nodes", "keys", "places"])
        tidy()

    return work


def _merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the classes of x and y; a label is the least member of its class."""
    while len(x):
        lx, ly = label[x], label[y]
        apart = lx != ly
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(lx, ly)[apart], np.minimum(lx, ly)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def _families(members: bool):
    """Packed links of nodes that meet at an anchor, are near by 64 bits and of different
    components: no more than nodes in a bucket, with the same families as all pairs. With
    ``members`` the rows (a, b) of what meets at each anchor instead: (node, anchor)."""

    def work(batches):
        import pyarrow as pa

        resident(None, None)
        held, n = [[], [], []], 0
        for batch in batches:
            for nodes, keys, places in zip(*(batch.column(k) for k in (1, 2, 3))):
                held[0].append(np.frombuffer(nodes.as_buffer(), np.int64).reshape(-1, 3))
                low, high = np.frombuffer(keys.as_buffer(), "<u4").reshape(2, -1)
                held[1].append(low.astype(np.int64) | high.view("<i4").astype(np.int64) << 32)
                held[2].append(np.frombuffer(places.as_buffer(), "<u2").astype(np.int32) + n)
                n += len(held[0][-1])
        if not n:
            return
        nodes, key, at = (np.concatenate(h) for h in held)
        held.clear()
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        rep, comp, fp = nodes[:, 0], nodes[:, 1], nodes[:, 2].view(np.uint64)
        label, met = np.arange(n), np.zeros(len(key), bool)

        def join(i, j):
            met[i] = met[j] = True
            if not members:
                _merge(label, at[i], at[j])

        small = np.flatnonzero(np.repeat((size > 1) & (size <= FEW), size))
        for d in range(1, FEW):
            i = small[: len(small) - d]
            i = i[key[i] == key[small[d:]]]
            if not len(i):
                break
            x, y = at[i], at[i + d]
            good = (comp[x] != comp[y]) & ((key[i] >= LEAST) | (np.bitwise_count(fp[x] ^ fp[y]) <= NEAR64))
            join(i[good], i[good] + d)
        for start, m in zip(first[size > FEW], size[size > FEW]):
            x = at[start : start + m]
            c, f, short = comp[x], fp[x], key[start] >= LEAST
            if (c == c[0]).all():
                continue
            if m > CROWD or short:
                join(np.full(m - 1, start), np.arange(start + 1, start + m))
                continue
            step = max(1, WORDS // m)
            for k in range(0, m, step):
                i, j = np.nonzero((np.bitwise_count(f[k : k + step, None] ^ f) <= NEAR64) & (c[k : k + step, None] != c))
                join(start + k + i, start + j)
        if members:
            out = rep[at[met]], key[met]
            for k in range(0, len(out[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in out], names=["a", "b"])
        else:
            of = np.flatnonzero(label != np.arange(n))
            for k in range(0, len(of), 1 << 16):
                some = of[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([np.stack([rep[some], rep[label[some]]], 1).tobytes()], pa.binary())], names=["links"])
        del nodes, key, at, label, met, small
        tidy()

    return work


def _merged(batches):
    """Links (a, b) with the families of packed links of many buckets, up to FOREST of them at once."""
    import pyarrow as pa

    def out():
        ends, at = np.unique(np.concatenate(held), return_inverse=True)
        held.clear()
        label = np.arange(len(ends))
        _merge(label, *at.reshape(-1, 2).T)
        of = np.flatnonzero(label != np.arange(len(ends)))
        return pa.RecordBatch.from_arrays([pa.array(ends[of]), pa.array(ends[label[of]])], names=["a", "b"])

    held: list = []
    for batch in batches:
        for x in batch.column(0):
            held.append(np.frombuffer(x.as_py(), np.int64))
            if sum(map(len, held)) > 2 * FOREST:
                yield out()
    if held:
        yield out()
    tidy()


def _estimate(x: np.ndarray, y: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard of shingle sets of these sizes by all bits of their fingerprints."""
    share = np.bitwise_count(x ^ y).sum(-1) / (WIDE * 64)
    common = np.cos(np.pi * share) * np.sqrt(na * nb)
    return common / (na + nb - common)


def linked(sets: list[np.ndarray], comps: np.ndarray, sides: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links with the components of all pairs of sets of at least this Jaccard similarity, of
    different components and (where both occur) sides.

    Two such sets share one of their n - ceil(similarity * n) + 1 rarest members; what does
    is counted in full unless a link joins it already."""
    n = np.array([len(x) for x in sets])
    names, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum(n)
    begins, owner = ends - n, np.repeat(np.arange(len(n)), n)
    order = np.lexsort((ids, counts[ids], owner))  # each set from its rarest member on
    prefix = (n - np.ceil(np.round(similarity * n, 9)).astype(np.int64) + 1)[owner]
    rare = order[(np.arange(len(order)) - begins[owner] < prefix) & (counts[ids[order]] > 1)]
    doc, token = owner[rare], ids[rare]
    by = np.argsort(token, kind="stable")
    posted, heads = doc[by], token[by]
    start, stop = (np.searchsorted(heads, token, side) for side in ("left", "right"))
    firsts = np.searchsorted(doc, np.arange(len(n) + 1))
    root, both, mark, out = comps.copy(), len(set(sides.tolist())) > 1, np.zeros(len(names), bool), []
    for i in range(len(n)):
        lists = [posted[a:b] for a, b in zip(start[firsts[i] : firsts[i + 1]], stop[firsts[i] : firsts[i + 1]]) if b - a > 1]
        if not lists:
            continue
        other = np.unique(np.concatenate(lists))
        other = other[(other < i) & (np.minimum(n[other], n[i]) >= similarity * np.maximum(n[other], n[i]) - 1e-6)]
        if both:
            other = other[sides[other] != sides[i]]
        mark[ids[begins[i] : ends[i]]] = True
        while len(other := other[root[other] != root[i]]):
            some, sizes = other, n[other]
            if sizes.sum() > WORDS:
                some = other[: max(1, int(np.searchsorted(np.cumsum(sizes), WORDS)))]
                sizes = n[some]
            other, cuts = other[len(some) :], np.cumsum(sizes) - sizes
            common = np.add.reduceat(mark[ids[np.arange(sizes.sum()) + np.repeat(begins[some] - cuts, sizes)]], cuts, dtype=np.int64)
            for j in some[common / (sizes + n[i] - common) >= similarity].tolist():
                if root[j] != root[i]:
                    out.append((i, j))
                    root[root == root[j]] = root[i]
        mark[ids[begins[i] : ends[i]]] = False
    return out


def _compared(similarity: float):
    """Links (a, b) found in each family or block, of rows (family, side, key, comp, set) sorted by family."""

    def work(batches):
        import pyarrow as pa

        resident(None, None)
        held = []

        def links():
            rows = pa.Table.from_batches(held)
            key, sets = np.array(rows.column(2)), [np.frombuffer(x.as_buffer(), np.uint64) for c in rows.column(4).chunks for x in c]
            comps = np.unique(np.array(rows.column(3)), return_inverse=True)[1]
            found = linked(sets, comps, np.array(rows.column(1)), similarity) if len(sets) > 1 and comps.any() else []
            held.clear()
            i, j = np.array(found, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(key[i]), pa.array(key[j])], names=["a", "b"])

        for batch in batches:
            family = np.array(batch.column(0))
            cuts = [0, *(np.flatnonzero(family[1:] != family[:-1]) + 1), len(family)]
            for a, b in zip(cuts, cuts[1:]):
                if held and b > a and held[-1].column(0)[0].as_py() != family[a]:
                    yield links()
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield links()
        tidy()

    return work


def _least(h: np.ndarray, similarity: float) -> bytes | None:
    """Anchors of a short text: two sets of at least this similarity have one in common."""
    if not 0 < len(h) <= SHORT:
        return None
    prefix = h[: len(h) - math.ceil(round(similarity * len(h), 9)) + 1]
    return (prefix >> np.uint64(2) | np.uint64(LEAST)).astype("<u8").tobytes()


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int(np.count_nonzero(y[place] == x))
    return common / (len(x) + len(y) - common) >= similarity


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, group_id): documents joined by links of a shingle Jaccard of at least
    ``similarity``; group_id is the smallest id of the group.

    Equal shingle sets are one node. Texts without words are one group of their
    own, null texts with them. Links are decided by the sets of shingle hashes. A
    pair at exactly ``similarity`` meets at some anchor with computed odds of MEET."""
    fps, named, _ = _grouped(docs, words, similarity, id_col, text_col)
    return fps.join(named, ["n", "wide"], "left").select(F.col("id").alias(id_col), "group_id")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What a row is known by: its id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def first_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key) of one row of each group of near duplicates: that of the smallest id, of
    a null id only where the group has no other; of several texts of that id, the one of
    the smallest row_key."""
    return _grouped(docs, words, similarity, id_col, text_col)[2]


def _grouped(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fingerprints, group_id by n and wide, row_key of each group's first row)."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for x in batch.column(1):
                h = shingle_set(x.as_py() or "", words)
                found.append((*_wide(h), _least(h, similarity)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in found], pa.int64()), pa.array([r[1].tobytes() for r in found], pa.binary()), pa.array([r[2] for r in found], pa.binary()), batch.column(2)],
                names=["id", "n", "wide", "least", "key"])
        tidy()

    # a row is known by its id and text: where ids repeat, different texts are different nodes
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    fps = written(rows.mapInArrow(work, "id long, n long, wide binary, least binary, key long"), "wide")
    groups = written(fps.groupBy("n", "wide").agg(F.min("key").alias("rep"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"), F.min("least").alias("least")), "wide-groups")
    nodes, many = groups.where("n > 0"), groups.where("n > 0").count()
    cores = docs.sparkSession.sparkContext.defaultParallelism

    def least(x, y, na, nb):
        small, large = np.minimum(na, nb), np.maximum(na, nb)
        return (small >= similarity * large - 1e-6) & ((small <= SHORT) | (_estimate(x, y, na, nb) >= similarity - SLACK))

    def possible(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, WIDE) for k in (3, 5))
            na, nb = (np.array(batch.column(k)).astype(float) for k in (2, 4))
            good = pa.array(least(x, y, na, nb))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])

    def exact(batches):
        import pyarrow as pa

        sets = lambda column: (np.frombuffer(x.as_buffer(), np.uint64) for x in column)
        for batch in batches:
            good = pa.array([_alike(x, y, similarity) for x, y in zip(sets(batch.column(2)), sets(batch.column(3)))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])
        tidy()

    def shingle_sets(wanted):
        """(key, set and the other columns) of the texts of keys; one of each repeated row."""
        keys = written(wanted.select("key").distinct(), "keys")
        keys = F.broadcast(keys) if keys.count() <= SENT else keys  # else all texts are shuffled
        texts = rows.join(keys, "key", "left_semi").dropDuplicates(["key"])
        texts = texts.join(wanted, "key") if len(wanted.columns) > 1 else texts
        names = [c for c in wanted.columns if c != "key"]

        def sets(batches):
            import pyarrow as pa

            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    found = pa.array([shingle_set(x.as_py() or "", words).tobytes() for x in part.column(len(names) + 1)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names) + 1], found], names=[*names, "key", "set"])
            tidy()

        kinds = dict(wanted.dtypes)
        return texts.select(*names, "key", "text").mapInArrow(sets, "".join(f"{c} {kinds[c]}, " for c in names) + "key long, set binary")

    def checked(pairs):
        a = nodes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
        b = nodes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
        both = pairs.join(a, "a").join(b, "b").select("a", "b", "na", "wa", "nb", "wb")
        left = written(both.mapInArrow(possible, "a long, b long"), "possible")
        ends = left.select(F.col("a").alias("key")).union(left.select("b")).distinct()
        sets = written(shingle_sets(ends), "sets")
        x, y = (sets.select(F.col("key").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
        whole = left.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b")
        return written(whole.mapInArrow(exact, "a long, b long"), "near")

    def met(some, members=False):
        buckets = max(cores, -(-many * len(choices) // ENTRIES))
        sent = some.select("rep", "comp", "wide", "least").mapInArrow(_entries(buckets, choices), "bucket int, nodes binary, keys binary, places binary")
        sent = sent.repartition(buckets, "bucket")
        if members:
            return sent.mapInArrow(_families(True), "a long, b long")
        return written(sent.mapInArrow(_families(False), "links binary"), "families").mapInArrow(_merged, "a long, b long")

    # large groups of near copies are joined by links to heads, at the choices of one shuffle
    # the slices that find heads together are the same in every run
    choices = _choices(_width(many), similarity)
    first = choices[: WIDE * 64 // choices.shape[1]]
    buckets = max(cores, -(-many * len(first) // ENTRIES))
    dealt = nodes.select("rep", "wide").repartition(max(1, -(-many // PART)), "rep").sortWithinPartitions("rep")
    sent = dealt.mapInArrow(_candidates(buckets, first), "bucket int, packed binary").repartition(buckets, "bucket")
    links = checked(written(sent.mapInArrow(_met, "a long, b long").distinct(), "met"))
    joined = connected_components(links)
    # then all that are still apart meet each other at every anchor, in families
    parts = written(nodes.join(joined, nodes.rep == joined.node, "left").select("rep", F.coalesce("component", "rep").alias("comp"), "n", "wide", "least"), "parts")
    families = connected_components(met(parts)).withColumnRenamed("component", "family")
    of = written(families.join(parts, families.node == parts.rep).select("rep", "comp", "n", "family"), "families")
    sizes = of.groupBy("family").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("texts") / MEMBERS, F.col("shingles") * 8 / SETS))
    sizes = written(sizes.select("family", blocks.alias("blocks")), "family-sizes")
    groups_ = of.join(sizes.where("blocks = 1"), "family").select("family", F.lit(0).alias("side"), F.col("rep").alias("key"), "comp")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("own")
    paired = lambda rows, name: rows.select(F.xxhash64(name, F.least("own", "other"), F.greatest("own", "other")), (F.col("own") > F.col("other")).cast("int"), F.col("rep"), F.col("comp"))
    each = F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other")
    # in pairs of blocks
    inside = of.join(sizes.where(f"blocks > 1 and blocks <= {PAIRED}"), "family")
    groups_ = groups_.union(paired(inside.select("family", "rep", "comp", own, each), "family"))
    if not (large := sizes.where(f"blocks > {PAIRED}")).isEmpty():
        # by anchor, and where even that is too large in pairs of blocks
        inside = parts.join(of.join(large, "family").select("rep"), "rep", "left_semi")
        at = written(met(inside, members=True).select(F.col("a").alias("rep"), F.col("b").alias("anchor")), "anchors").join(of, "rep")
        total = at.groupBy("anchor").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles")).select("anchor", blocks.cast("int").alias("blocks"))
        groups_ = groups_.union(paired(at.join(total, "anchor").select("anchor", "rep", "comp", own, each), "anchor"))
    groups_ = written(groups_, "compared")
    volume = groups_.join(of.select(F.col("rep").alias("key"), "n"), "key").agg(F.sum("n")).first()[0] or 0
    dealt = shingle_sets(groups_).select("family", "side", "key", "comp", "set").repartition(max(cores, -(-volume * 8 // (4 * SETS))), "family")
    more = written(dealt.sortWithinPartitions("family").mapInArrow(_compared(similarity), "a long, b long"), "near")
    found = connected_components(links.union(more))
    named = written(groups.join(found, groups.rep == found.node, "left").select("n", "wide", F.coalesce("component", "rep").alias("comp"), "first"), "near-named")
    firsts = written(named.groupBy("comp").agg(F.min("first").alias("first")), "near-firsts")
    named = written(named.select("n", "wide", "comp").join(firsts, "comp").select("n", "wide", F.col("first.id").alias("group_id")), "near-groups")
    return fps, named, firsts.select(F.col("first.key").alias("row_key"))
