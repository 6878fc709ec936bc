"""Repeated passages by a logarithmic family of suffix arrays.

A byte goes when a string of LENGTH bytes that covers it also starts in a document
with a smaller id. Every such string holds LENGTH - K + 1 strings of K bytes; the
one with the least hash is its anchor, equal strings have equal anchors, and a run
of neighbouring strings shares one, so that runs can be dealt by anchor:

1. Anchors are dealt by hash; those of one document only drop out.
2. The bytes of the remaining runs are dealt by anchor. A task drops runs that its
   own rows repeat (they are decided); anchors of very many documents are dealt
   string by string instead, by the string's own hash.
3. In each bucket batches come in ascending order of id. A batch gets a suffix
   array (the order of its suffixes by LENGTH bytes), is merge-scanned against the
   levels before it, and becomes a level; levels of equal size merge, so that a
   bucket has logarithmically many.
4. What was found is laid over the texts.

Documents are told apart by a key: the id where every id has one text, else a number of id
and text, so that texts that share an id are judged each by the smaller ids.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import resident, tidy, written

LENGTH, K = 50, 20
#: Most strings in one run.
RUN = 200
#: Bytes of text that a task looks at together; of text for each bucket of anchors; of runs for each bucket of strings.
TOGETHER, ANCHOR_BYTES, RUN_BYTES = 3 << 20, 16 << 20, 3 << 19
#: Bytes of text whose findings one task gathers.
PLACE_BYTES = 32 << 20
#: Bytes hashed at once.
HASHED = 1 << 19
#: Strings of runs that a task remembers.
REMEMBERED = 100_000
#: An anchor is frequent from so many documents on, and at least the anchors over this number.
FREQUENT, MOST_FREQUENT = 4096, 1_000_000
#: Strings of a batch.
BATCH = 1 << 17

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX[3]
    return x ^ x >> np.uint64(29)


def _eights(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as an integer."""
    out = np.empty(len(x) - 7, "<u8")
    for k in range(8):
        part = x[k : k + (len(x) - k) // 8 * 8]
        out[k::8] = part.view("<u8")[: len(out[k::8])]
    return out


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(anchor, text number, start, strings) of all runs of strings of LENGTH bytes;
    texts are hashed HASHED bytes at a time (a longer one at once)."""
    parts, first, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= HASHED or i == len(texts) - 1:
            anchor, number, start, strings = _runs(texts[first : i + 1])
            parts.append((anchor, number + first, start, strings))
            first, size = i + 1, 0
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else _runs([])


def _runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    long = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    if not long:
        return none
    x = np.frombuffer(b"".join(texts[i] for i in long) + b"\0" * 8, np.uint8)
    sizes = np.array([len(texts[i]) for i in long])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    e = _eights(x)
    n = sizes.sum() - K + 1
    h = _mixed(e[:n] * _MIX[0] + e[8 : 8 + n] * _MIX[1] + (e[16 : 16 + n] & np.uint64(0xFFFFFFFF)) * _MIX[2])
    width = LENGTH - K + 1
    least, have = h, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: len(h) - width + 1], least[width - have : len(h) - have + 1])
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.unique(np.concatenate([change, begins[begins < len(least)]]))
    owner = np.searchsorted(begins, starts, "right") - 1
    last = begins[owner] + sizes[owner] - LENGTH + 1  # no string starts from here on
    ends = np.minimum(np.append(starts[1:], len(least)), last)
    keep = ends > starts
    starts, ends, owner = starts[keep], ends[keep], owner[keep]
    cuts = -(-(ends - starts) // RUN)
    if (cuts > 1).any():
        index = np.repeat(np.arange(len(starts)), cuts)
        step = np.arange(len(index)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        owner, ends, starts = owner[index], np.minimum(ends[index], starts[index] + (step + 1) * RUN), starts[index] + step * RUN
    return least[starts], np.array(long)[owner], starts - begins[owner], ends - starts


@lru_cache
def _coders():
    """A worker's compressor and decompressor; making them costs more than most rows."""
    from zstandard import ZstdCompressor, ZstdDecompressor

    return ZstdCompressor(level=1), ZstdDecompressor()


def _packed(*columns) -> bytes:
    return _coders()[0].compress(b"".join(c if isinstance(c, bytes) else np.ascontiguousarray(c).tobytes() for c in columns))


def _unpacked(raw, kinds: list[str], n: int):
    raw, at, out = _coders()[1].decompress(raw), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out, raw[at:]


def _together(batches: Iterator, columns: int):
    """Rows in lists of about TOGETHER bytes of text (the second column)."""
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(k) for k in range(columns))):
            row = tuple(v.as_py() for v in row)
            rows.append(row)
            size += len(row[1] or "")
            if size >= TOGETHER:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _groups(key: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values of sorted keys."""
    if not len(key):
        return []
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
    return list(zip(first, [*first[1:], len(key)]))


def _by_id(places: int, ids: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """(place, rows, packed keys and columns): a key always has the same place."""
    at = (ids.astype(np.uint64) * _MIX[0] >> np.uint64(33)).astype(np.int64) % places
    order = np.argsort(at, kind="stable")
    return [(int(at[order[a]]), b - a, _packed(ids[order[a:b]].astype("<i8"), *(c[order[a:b]] for c in columns))) for a, b in _groups(at[order])]


_PLACED = "place int, n long, packed binary"


def _rows(rows: list[tuple], kinds: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds.values())], names=list(kinds))


def _gathered(kinds: list[str]):
    """One row a key: (key, packed columns in order of arrival). Rows of place -1 pass with a null key."""

    def work(batches):
        import pyarrow as pa

        held, names = [], {"key": pa.int64(), "packed": pa.binary()}
        for batch in batches:
            passed = []
            for place, n, packed in zip(*(batch.column(k) for k in range(3))):
                if place.as_py() < 0:
                    passed.append((None, packed.as_py()))
                else:
                    held.append(_unpacked(packed.as_buffer(), ["<i8", *kinds], n.as_py())[0])
            if passed:
                yield _rows(passed, names)
        if not held:
            return
        ids, *columns = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.argsort(ids, kind="stable")
        ids, columns = ids[order], [c[order] for c in columns]
        groups = _groups(ids)
        for k in range(0, len(groups), 4096):
            yield _rows([(int(ids[a]), b"".join(c[a:b].tobytes() for c in columns)) for a, b in groups[k : k + 4096]], names)
        del ids, columns
        tidy()

    return work


_ENTRY = ["<u8", "<i8", "<u4", "<u2", "<u4"]  # anchor, key, start, strings (0: decided), documents


def _anchors(buckets: int):
    def work(batches):
        import pyarrow as pa

        resident(None, None)
        for rows in _together(batches, 2):
            ids = np.array([r[0] for r in rows], np.int64)
            anchor, text, start, strings = runs([(r[1] or "").encode("utf-8", "surrogatepass") for r in rows])
            doc = ids[text]
            order = np.lexsort((doc, anchor))
            anchor, doc, start, strings = anchor[order], doc[order], start[order], strings[order]
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(anchor)))
            fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]) if len(anchor) else np.zeros(0, bool)
            docs = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else first
            many = np.repeat(docs > 1, sizes)
            # repeated here already: decided; one entry stands for them
            stands = first[docs > 1]
            e = [np.concatenate([c[~many], c[stands]]) for c in (anchor, doc, start, strings)]
            e[3] = np.concatenate([strings[~many], np.zeros(len(stands), np.int64)])
            e.append(np.concatenate([np.ones(int((~many).sum()), np.int64), docs[docs > 1]]))
            place = (e[0] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            e, place = [c[order] for c in e], place[order]
            out = [(int(place[a]), 0, b - a, _packed(*(c[a:b].astype(t) for c, t in zip(e, _ENTRY)))) for a, b in _groups(place)]
            out += _by_doc(doc[many], start[many], strings[many], anchor[many], buckets)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["bucket", "key", "n", "packed"])
        tidy()

    return work


def _by_doc(doc, start, strings, anchor, buckets: int) -> list[tuple]:
    """(-1 - bucket, key, runs, packed) for each document."""
    order = np.argsort(doc, kind="stable")
    doc, start, strings, anchor = doc[order], start[order].astype("<u4"), strings[order].astype("<u2"), anchor[order].astype("<u8")
    return [(-1 - int(doc[a]) % buckets, int(doc[a]), b - a, start[a:b].tobytes() + strings[a:b].tobytes() + anchor[a:b].tobytes()) for a, b in _groups(doc)]


def _repeated(frequent: int, places: int):
    """Runs of anchors of two and more documents, dealt by key; place -1: frequent anchors."""

    def finish(held, names):
        anchor, doc, start, strings, docs = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.argsort(anchor, kind="stable")
        anchor, doc, start, strings, docs = anchor[order], doc[order], start[order], strings[order], docs[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        sizes = np.diff(np.append(first, len(anchor)))
        total = np.add.reduceat(docs, first)
        several = (np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)) | (np.maximum.reduceat(docs, first) > 1)
        keep = np.repeat(several, sizes) & (strings > 0)
        out = _by_id(places, doc[keep], start[keep], strings[keep], anchor[keep])
        hot = anchor[first[several & (total >= frequent)]]
        if len(hot):
            out.append((-1, len(hot), hot.astype("<u8").tobytes()))
        return _rows(out, names)

    def work(batches):
        import pyarrow as pa

        held, names, now = [], {"place": pa.int32(), "n": pa.int64(), "packed": pa.binary()}, None
        for batch in batches:
            passed = []
            for bucket, doc, n, packed in zip(*(batch.column(k) for k in range(4))):
                bucket = bucket.as_py()
                if bucket < 0:
                    n, raw = n.as_py(), packed.as_py()
                    passed.append((np.full(n, doc.as_py()), np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<u2", n, 4 * n), np.frombuffer(raw, "<u8", n, 6 * n)))
                    continue
                if held and bucket != now:  # rows come bucket by bucket
                    yield finish(held, names)
                now = bucket
                held.append(_unpacked(packed.as_buffer(), _ENTRY, n.as_py())[0])
            if passed:
                yield _rows(_by_id(places, *(np.concatenate(c) for c in zip(*passed))), names)
        if held:
            yield finish(held, names)
        tidy()

    return work


_STRING = ["<i8", "<i8", "<u4", "<u2"]  # id, key, start, strings


def _strings(buckets: int, sent):
    """Rows (id, text, runs, key) to the bytes of their runs by bucket; spans that are decided go with the key."""

    def work(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        hot, seen = set(sent.value.tolist()), {}
        for rows in _together(batches, 4):
            rows.sort(key=lambda r: r[0])
            if len(seen) > REMEMBERED:
                seen.clear()
            out: list[list[tuple]] = [[] for _ in range(buckets)]
            found = []

            def send(doc, key, start, strings, part, bucket, done):
                if seen.setdefault(part, doc) < doc:
                    done.append((start, start + strings + LENGTH - 1))
                else:
                    out[bucket].append((doc, key, start, strings, part))

            for doc, text, packs, key in rows:
                raw, done = text.encode("utf-8", "surrogatepass"), []
                for packed in packs:
                    n = len(packed) // 14  # start, strings, anchor
                    starts, strings = np.frombuffer(packed, "<u4", n).tolist(), np.frombuffer(packed, "<u2", n, 4 * n).tolist()
                    for start, m, anchor in zip(starts, strings, np.frombuffer(packed, "<u8", n, 6 * n).tolist()):
                        if anchor in hot:
                            for s in range(start, start + m):
                                part = raw[s : s + LENGTH]
                                send(doc, key, s, 1, part, xxh3_64_intdigest(part) % buckets, done)
                        else:
                            send(doc, key, start, m, raw[start : start + m + LENGTH - 1], anchor // 7 % buckets, done)
                if done:
                    found.append((-1 - key % buckets, key, len(done), np.array(done, "<u4").tobytes()))
            for k, entries in enumerate(out):
                if entries:
                    columns = [np.array([e[j] for e in entries], t) for j, t in enumerate(_STRING)]
                    found.append((k, 0, len(entries), _packed(*columns, b"".join(e[-1] for e in entries))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["bucket", "key", "n", "packed"])
        tidy()

    return work


class IndexFamily:
    """Levels of sorted distinct strings of LENGTH bytes; each string with its least id."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _distinct(keys: np.ndarray, ids: np.ndarray, order: np.ndarray):
        keys, ids = keys[order], ids[order]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        return keys[first], np.minimum.reduceat(ids, np.flatnonzero(first)), np.cumsum(first) - 1

    def add(self, strings: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which strings of a batch also start in a document of smaller id, in it or
        in batches before (whose ids are not larger)."""
        order = np.argsort(strings, kind="stable")  # the batch's suffix array
        keys, least, group = self._distinct(strings, ids, order)
        before = least.copy()
        for level, level_ids in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            before = np.where(level[at] == keys, np.minimum(before, level_ids[at]), before)
        hit = np.zeros(len(strings), bool)
        hit[order] = before[group] < ids[order]
        self.levels.append((keys, least))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            keys, ids = np.concatenate([b, a]), np.concatenate([y, x])
            self.levels.append(self._distinct(keys, ids, np.argsort(keys, kind="stable"))[:2])  # a merge of two sorted runs
        return hit


def _judged(batches, places: int = 1):
    """Spans of strings that a document of smaller id holds, dealt by key; rows come bucket by bucket."""
    import pyarrow as pa

    resident(None, None)
    names = {"place": pa.int32(), "n": pa.int64(), "packed": pa.binary()}
    held, now = [], None
    for batch in batches:
        passed = []
        for bucket, key, n, packed in zip(*(batch.column(k) for k in range(4))):
            bucket = bucket.as_py()
            if bucket < 0:
                passed.append((np.full(n.as_py(), key.as_py()), np.frombuffer(packed.as_py(), "<u8")))
                continue
            if held and bucket != now:
                yield from _judged_bucket(held, places, names)
            now = bucket
            held.append(_unpacked(packed.as_buffer(), _STRING, n.as_py()))
        if passed:
            yield _rows(_by_id(places, *(np.concatenate(c) for c in zip(*passed))), names)
    if held:
        yield from _judged_bucket(held, places, names)
    tidy()


def _judged_bucket(held: list, places: int, names: dict):
    """The spans of one bucket, whose rows are then dropped."""
    doc, key, start, strings = (np.concatenate(c) for c in zip(*(h[0] for h in held)))
    text = np.frombuffer(b"".join(h[1] for h in held), np.uint8)
    held.clear()
    strings = strings.astype(np.int64)
    begins = np.cumsum(strings + LENGTH - 1) - (strings + LENGTH - 1)
    order = np.argsort(doc, kind="stable")
    cuts = np.searchsorted(np.cumsum(strings[order]), np.arange(BATCH, strings.sum() + BATCH, BATCH))
    windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    family, a = IndexFamily(), 0
    for cut in cuts:
        some, a = order[a : cut + 1], max(a, cut + 1)
        if not len(some):
            continue
        m = strings[some]
        owner = np.repeat(np.arange(len(some)), m)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
        keys = np.ascontiguousarray(windows[begins[some][owner] + within]).view(f"S{LENGTH}").ravel()
        hit = family.add(keys, doc[some][owner])
        # runs of hits within one entry
        edge = np.concatenate([[True], owner[1:] != owner[:-1]])
        opens = np.flatnonzero(hit & (edge | ~np.concatenate([[False], hit[:-1]])))
        closes = np.flatnonzero(hit & np.concatenate([edge[1:] | ~hit[1:], [True]]))
        ids = key[some][owner[opens]]
        at = start[some][owner].astype(np.int64) + within
        spans = np.stack([at[opens], at[closes] + LENGTH], 1).astype("<u4").view("<u8").ravel()
        yield _rows(_by_id(places, ids, spans), names)


def _release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished steps: its cleaner acts on plans that are
    garbage, which takes the collector two rounds to see."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _keyed(docs: DataFrame, id_col: str, text_col: str, *others) -> tuple[DataFrame, int]:
    """((id, text, others, key) of all rows, bytes of those that are searched): the key is the id,
    or where some id has several texts a number of id and text (SHA-256)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *others)
    digest = F.xxhash64("text")
    per = _searched(rows).groupBy("id").agg(F.sum(F.octet_length("text")).alias("bytes"), (F.min(digest) < F.max(digest)).alias("several"))
    size, several = per.agg(F.sum("bytes"), F.max("several")).first()
    if not several:
        return rows.withColumn("key", F.col("id")), size or 0
    known = _searched(rows).select("id", F.sha2("text", 256).alias("sha")).distinct()
    known = written(known.withColumn("key", F.monotonically_increasing_id()), "keys")
    return rows.withColumn("sha", F.sha2("text", 256)).join(known, ["id", "sha"], "left").drop("sha"), size or 0


def _searched(rows: DataFrame) -> DataFrame:
    return rows.where(F.octet_length("text") >= LENGTH).where("id is not null")


def _spans(keyed: DataFrame, size: int) -> DataFrame:
    """(key, spans): for documents with any, the byte spans found, as arrays of packed
    (start, end) pairs that may overlap."""
    spark, rows = keyed.sparkSession, _searched(keyed)
    least = spark.sparkContext.defaultParallelism
    buckets, places = max(least, -(-size // ANCHOR_BYTES)), max(least, -(-size // PLACE_BYTES))
    dealt = rows.select("key", "text").mapInArrow(_anchors(buckets), "bucket int, key long, n long, packed binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    frequent = max(FREQUENT, size // MOST_FREQUENT)
    runs_ = dealt.mapInArrow(_repeated(frequent, places), _PLACED).repartition(places, "place")
    found = written(runs_.mapInArrow(_gathered(["<u4", "<u2", "<u8"]), "key long, packed binary"), "repeated")
    del dealt, runs_  # or their shuffle files stay
    _release(spark)
    hot = [np.frombuffer(r[0], "<u8") for r in found.where("key is null").select("packed").collect()]  # at most MOST_FREQUENT
    sent = spark.sparkContext.broadcast(np.concatenate(hot) if hot else np.zeros(0, np.uint64))
    of = found.where("key is not null")
    total = of.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    total //= 14
    buckets = max(least, -(-total * 64 // RUN_BYTES))
    texts = of.select("key", F.array("packed").alias("runs")).join(rows, "key")
    strings = texts.select("id", "text", "runs", "key").mapInArrow(_strings(buckets, sent), "bucket int, key long, n long, packed binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    judged = strings.mapInArrow(lambda batches: _judged(batches, places), _PLACED).repartition(places, "place")
    spans = written(judged.mapInArrow(_gathered(["<u8"]), "key long, packed binary"), "spans")
    del texts, strings, judged, of, found
    _release(spark)
    return spans.select("key", F.array("packed").alias("spans"))


def kept_bytes(raw: bytes, spans: list[bytes] | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    if not spans:
        return raw, 0, 0
    cover = np.zeros(len(raw) + 1, np.int32)
    pairs = np.minimum(np.frombuffer(b"".join(spans), "<u4").reshape(-1, 2), len(raw))
    np.add.at(cover, pairs[:, 0], 1)
    np.add.at(cover, pairs[:, 1], -1)
    gone = np.cumsum(cover)[:-1] > 0
    count = int((gone[1:] & ~gone[:-1]).sum()) + int(len(gone) > 0 and gone[0])
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), count


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) of every row.

    Null texts count as empty; texts under LENGTH bytes and rows without id lose
    nothing. Rows of one id never remove from each other: repeated rows get equal
    results, different texts under one id are judged each by the smaller ids."""
    return _laid(docs, id_col, text_col, digest=False)


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """remove_repeats() with (…, kept_sha256) instead of the bytes."""
    return _laid(docs, id_col, text_col, digest=True)


def _laid(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    def work(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            ids, sizes, removed, counts, kept = batch.column(0), [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                left, n, count = kept_bytes(raw, spans.as_py())
                sizes.append(len(raw))
                removed.append(n)
                counts.append(count)
                kept.append(hashlib.sha256(left).hexdigest() if digest else left)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in (sizes, removed, counts)), pa.array(kept, pa.string() if digest else pa.binary())],
                                             names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows, size = _keyed(docs, id_col, text_col)
    out = rows.join(_spans(rows, size), "key", "left").select("id", "text", "spans").mapInArrow(
        work, f"id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("kept", "kept_sha256" if digest else "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with remove_repeats() applied to the texts; bytes of
    characters cut in the middle go as well, null texts stay null."""
    names = docs.columns
    at = names.index(text_col)

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(at), batch.column(len(names))):
                t, s = text.as_py(), spans.as_py()
                texts.append(kept_bytes(t.encode("utf-8", "surrogatepass"), s)[0].decode("utf-8", "ignore") if t and s else t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 : len(names)]], names=names)

    kept = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]  # numbered: no name of the rows can clash
    rows, size = _keyed(docs, id_col, text_col, *kept)
    joined = rows.join(_spans(rows, size), "key", "left").select(*[f"c{k}" for k in range(len(names))], "spans")
    return joined.mapInArrow(work, docs.schema)
