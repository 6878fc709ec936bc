"""Packing of token sequences by bounded-space online best fit.

A packer holds a fixed number of open bins in a bitset keyed by free space. A
piece goes to the fullest bin that takes it; where there is none a bin opens, and
beyond the fixed number the fullest closes first. Tasks pack disjoint streams of
pieces in the order of a hash; what their open bins still hold is packed again by fewer
tasks, until one is left, so that unfilled bins remain at the very end only.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import resident, tidy, written
from millrace.llm.bpe import BYTE_LEVEL, Splitter

#: Pre-tokens whose ids a worker remembers; beyond, the memory starts anew.
REMEMBERED = 400_000
#: Open bins of a packer.
OPEN_BINS = 1024
#: Pieces that one task packs in the first round.
STREAM = 1 << 16
#: Each round has fewer tasks by this factor.
FEWER = 16
CHUNK = 1 << 16


def _byte_chars() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 characters
    stand for themselves, the other bytes for U+0100 and on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(own)))}


class Tokens(dict):
    """Packed ids of texts by a tokenizers file. Its byte-level pre-tokenizer splits
    by a fixed pattern; each distinct pre-token is encoded once and remembered. Where ids
    are in the order of the merges the ranks alone give them. Special tokens of the file
    that occur in a text are one id, or ordinary text if ``special_as_text``."""

    def __init__(self, path: str, special_as_text: bool = False):
        import json
        import re

        super().__init__()
        self.path, self.library, self.ranks = path, None, None
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        splits, model = read["pre_tokenizer"] or {}, read["model"]
        if splits.get("type") != "ByteLevel" or splits.get("add_prefix_space") or not splits.get("use_regex") or read["normalizer"]:
            raise ValueError("a byte-level tokenizer without normaliser or prefix blank is needed")
        added = read["added_tokens"]
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(special_as_text and not t["special"] for t in added):
            raise ValueError("added tokens are taken as they are written only")
        self.added = {} if special_as_text else {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made == sorted(set(made)) and not model.get("dropout") and not model.get("ignore_merges"):
            import tiktoken

            byte, names = _byte_chars(), {t["content"] for t in added}
            ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in names}
            self.ranks = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
            del ranks
        del read, model, made
        tidy()
        self.split = Splitter(BYTE_LEVEL)  # what such a pre-tokenizer splits at

    def _library(self):
        if self.library is None:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True  # pieces hold none
        return self.library

    def __missing__(self, piece: str) -> bytes:
        if len(piece) <= 64:
            ids = self.ranks.encode_ordinary(piece) if self.ranks else self._library().encode(piece, add_special_tokens=False).ids
            packed = array("I", ids).tobytes()
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = packed
            return packed
        return array("I", self._library().encode(piece, add_special_tokens=False).ids).tobytes()

    def pack(self, text: str) -> bytes:
        if self.marks and any(mark in text for mark in self.added):
            return b"".join(self.added[part] if part in self.added else self._plain(part) for part in self.marks.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        look = self.__getitem__
        if len(text) <= CHUNK:
            return b"".join(map(look, self.split.findall(text)))
        pieces, out = (m.group() for m in self.split.finditer(text)), []
        while part := b"".join(map(look, islice(pieces, CHUNK))):
            out.append(part)
        return b"".join(out)


def tokens(path: str, special_as_text: bool = False) -> Tokens:
    return resident(("tokens", path, special_as_text), lambda: Tokens(path, special_as_text))


class BestFit:
    """Online best fit into bins of ``size`` with at most ``most`` open ones."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.free, self.count, self.made = size, most, 0, 0, 0
        self.bins: dict[int, list[int]] = defaultdict(list)
        self.closed: list[int] = []

    def _take(self, space: int) -> int:
        bins = self.bins[space]
        chosen = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.count -= 1
        return chosen

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``size`` tokens; bins that close are in ``closed``."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.count >= self.most:
                self.closed.append(self._take((self.free & -self.free).bit_length() - 1))
            space, chosen, self.made = self.size, self.made, self.made + 1
        left = space - length
        if left:
            self.bins[left].append(chosen)
            self.free |= 1 << left
            self.count += 1
        else:
            self.closed.append(chosen)
        return chosen, self.size - space


def cut(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """Pieces of every document: (id, piece, start, length, ids_crc32[, ids]).

    A document is its ids and then ``end_id``; null texts are empty. A special token that is
    written out in a text is that token's id unless ``special_as_text``. Documents over
    ``size`` tokens are cut into pieces of ``size``, of which the first may be
    shorter. Repeated rows give repeated pieces."""

    def work(batches: Iterator):
        import pyarrow as pa

        own, last = tokens(tokenizer, special_as_text), end_id.to_bytes(4, "little")
        for batch in batches:
            at, columns = [], [[], [], [], [], []]
            for row, x in enumerate(batch.column(1)):
                packed = own.pack(x.as_py() or "") + last
                n, start, piece = len(packed) // 4, 0, 0
                while start < n:
                    stop = start + ((n - 1) % size + 1 if start == 0 else size)
                    part = packed[4 * start : 4 * stop]
                    for column, value in zip(columns, (piece, start, stop - start, zlib.crc32(part), part)):
                        column.append(value)
                    at.append(row)
                    start, piece = stop, piece + 1
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, k) for c, k in zip(columns, kinds)]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names=names[: 5 + with_ids])
            del batch, arrays, columns
        tidy()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def _packed(pieces: DataFrame, size: int, stage: int, last: bool) -> DataFrame:
    """Pieces with (sequence_id, offset, done). Not done: in bins still open at the end of a task."""

    def work(batches: Iterator):
        import pyarrow as pa
        from pyspark import TaskContext

        resident(None, None)
        base = stage << 56 | TaskContext.get().partitionId() << 28
        packer, held = BestFit(size, OPEN_BINS), defaultdict(list)

        def out(rows, done, schema):
            columns = list(zip(*rows)) or [()] * (len(schema) + 2)
            kinds = [*schema.types, pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.array([done] * len(rows), pa.bool_())]
            return pa.RecordBatch.from_arrays(arrays, names=[*schema.names, "sequence_id", "offset", "done"])

        schema = None
        for batch in batches:
            schema = batch.schema
            length, ready = schema.names.index("length"), []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                chosen, offset = packer.put(row[length])
                held[chosen].append((*row, base + chosen, offset))
                if packer.closed:
                    for b in packer.closed:
                        ready += held.pop(b)
                    packer.closed.clear()
            yield out(ready, True, schema)
        rest = [r for rows in held.values() for r in rows]
        for k in range(0, len(rest), 4096):
            yield out(rest[k : k + 4096], last, schema)

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long, done boolean"
    return pieces.mapInArrow(work, schema)


def pack(pieces: DataFrame, size: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Pieces with (sequence_id, offset): sequences of at most ``size`` tokens without gaps.

    Pieces of ``size`` tokens are sequences of their own. Pieces of equal id
    and number (repeated rows) are packed each. No pieces, no sequences."""
    names = pieces.columns
    pieces = written(pieces, "pieces")
    full, part = pieces.where(F.col("length") == size), pieces.where(F.col("length") < size)
    count = part.count()
    tasks, stage, found = max(1, -(-count // STREAM)), 1, []
    while True:
        dealt = part.repartition(tasks, id_col, "piece").sortWithinPartitions(F.xxhash64(id_col, "piece"))
        result = written(_packed(dealt, size, stage, tasks == 1), "packed")
        found.append(result.where("done").drop("done"))
        if tasks == 1:
            break
        part, stage, tasks = result.where("not done").select(*names), stage + 1, -(-tasks // FEWER)
    own = full.withColumns({"sequence_id": F.monotonically_increasing_id() - F.lit((1 << 63) - 1) - 1, "offset": F.lit(0).cast("long")})
    for result in found:
        own = own.unionByName(result)
    return own


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed ids of each sequence; ``packed`` holds ids (a group is at
    most one sequence long). Null ids of documents and repeated rows make no difference, as
    each piece has its own place; of no pieces there are no sequences."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece of every document (see cut)."""
    return pack(cut(docs, tokenizer, size, end_id, id_col, text_col, with_ids, special_as_text), size, id_col)
