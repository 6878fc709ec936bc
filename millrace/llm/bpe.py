"""Byte-level BPE encoding and decoding.

Merges of one pre-token are driven by a queue over merge ranks: a bucket for each
rank holds positions of a linked list of parts, a hierarchical bitmap marks the
buckets that are not empty, find-first-set gives the next rank, and entries whose
pair has changed meanwhile are skipped. A pre-token of n bytes costs O(n log n)
however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import resident

#: Pre-tokens whose ids a worker remembers, in each of two generations.
REMEMBERED = 400_000
#: Pre-tokens or ids handled at once, which bounds memory on very long texts.
CHUNK = 1 << 16


#: The common pattern of byte-level tokenizers, and its letters, numbers and spaces below U+0100.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Splitter:
    """Matches of a pattern; texts within Latin-1 take a faster one that matches the same."""

    def __init__(self, pattern: str):
        import regex

        self.own, self.latin = regex.compile(pattern), _LATIN if pattern == BYTE_LEVEL else None

    def _for(self, text: str):
        if self.latin is not None:
            try:
                text.encode("latin-1")
                return self.latin
            except UnicodeEncodeError:
                pass
        return self.own

    def findall(self, text: str) -> list[str]:
        return self._for(text).findall(text)

    def finditer(self, text: str):
        return self._for(text).finditer(text)


class RankQueue:
    """Buckets by rank under a bitmap of two levels: words of 256 ranks and a summary of the words."""

    BIT = [1 << k for k in range(256)]

    def __init__(self, ranks: int):
        self.words = [0] * (-(-ranks // 256))
        self.summary = 0
        self.buckets: dict[int, list[int]] = {}

    def fill(self, pairs: list[int]) -> None:
        """Put all positions of an empty queue, -1 for pairs without rank."""
        buckets, words, bit, summary = self.buckets, self.words, self.BIT, 0
        for position, rank in enumerate(pairs):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(position)  # ascending, so a heap
                else:
                    buckets[rank] = [position]
                    words[rank >> 8] |= bit[rank & 255]
                    summary |= 1 << (rank >> 8)
        self.summary = summary

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.words[rank >> 8] |= self.BIT[rank & 255]
            self.summary |= 1 << (rank >> 8)
        else:
            heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position; only while summary is not 0."""
        word = (self.summary & -self.summary).bit_length() - 1
        bits = self.words[word]
        rank = word << 8 | (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.words[word] = bits = bits & (bits - 1)
        if not bits:
            self.summary &= self.summary - 1
        return rank, bucket[0]


class BytePairEncoder(dict):
    """Ids of texts under a rank file; as a dict it maps pre-tokens to packed ids."""

    def __init__(self, rank_path: str, pattern: str):
        super().__init__()
        with open(rank_path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, self.ranks))
        self.split = Splitter(pattern)
        self.pairs = {(a, b): self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)}
        self.queue = RankQueue(size)
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks, longest, queue, n = self.ranks, self.longest, self.queue, len(piece)
        push, pop = queue.push, queue.pop
        if n <= longest and (whole := ranks.get(piece)) is not None:
            return [whole]
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = list(map(self.pairs.__getitem__, zip(piece, piece[1:])))
        pair.append(-1)
        queue.fill(pair)
        while queue.summary:
            rank, i = pop()
            if pair[i] != rank:
                continue  # stale
            j = following[i]
            after = following[j]
            following[i] = after
            pair[j] = pair[i] = -1
            if after < n:
                before[after] = i
                stop = following[after]
                if stop - i <= longest and (rank := ranks.get(piece[i:stop])) is not None:
                    pair[i] = rank
                    push(rank, i)
            if (p := before[i]) >= 0:
                pair[p] = -1
                if after - p <= longest and (rank := ranks.get(piece[p:after])) is not None:
                    pair[p] = rank
                    push(rank, p)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : following[i]]])
            i = following[i]
        return ids

    def __missing__(self, piece: str) -> bytes:
        if (packed := self.older.get(piece)) is not None:
            self[piece] = packed
            return packed
        raw = piece.encode("utf-8", "surrogatepass")
        packed = b"".join([x.to_bytes(4, "little") for x in self.merge(raw)])
        if len(raw) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def pack(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        look = self.__getitem__
        if len(text) <= CHUNK:
            return b"".join(map(look, self.split.findall(text)))
        pieces, out = (m.group() for m in self.split.finditer(text)), []
        while part := b"".join(map(look, islice(pieces, CHUNK))):
            out.append(part)
        return b"".join(out)

    def unpack(self, packed: bytes) -> bytes:
        """Bytes of packed ids."""
        ids = memoryview(packed).cast("I")
        look = self.tokens.__getitem__
        return b"".join(b"".join(map(look, ids[i : i + CHUNK])) for i in range(0, len(ids), CHUNK))


def encoder(rank_path: str, pattern: str) -> BytePairEncoder:
    """This process's encoder for a rank file."""
    return resident(("ranks", rank_path, pattern), lambda: BytePairEncoder(rank_path, pattern))


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary) of every text: ids packed as little-endian uint32.

    A null text counts as empty and gives empty ids; repeated rows and ids stay as
    they are; other columns are not carried. No shuffle: each scan task encodes
    its rows."""

    def work(batches: Iterator):
        import pyarrow as pa

        own = encoder(rank_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([own.pack(x.as_py() or "") for x in batch.column(1)], pa.binary())], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) of packed ids; null ids give empty bytes."""

    def work(batches: Iterator):
        import pyarrow as pa

        own = encoder(rank_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([own.unpack(x.as_py() or b"") for x in batch.column(1)], pa.binary())], names=["id", "bytes"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and of decoding again: (id, n_tokens, ids_sha256, decoded_sha256).

    Same rules as encode() and decode(), fused in one pass so that ids stay in the worker."""

    def work(batches: Iterator):
        import pyarrow as pa

        own = encoder(rank_path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column(1):
                packed = own.pack(x.as_py() or "")
                n.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(own.unpack(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)
