"""The binary form of vectors: count, dimension, values, all little-endian."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
                                    LessThan, LessThanOrEqual)

from millrace.sources.stores import Staged, Staging, files_below, store


def serialize(vectors: list) -> bytes:
    """Count and dimension as unsigned 64-bit integers, then 32-bit floats; the dimension
    is the first vector's and left out for none."""
    if not vectors:
        return struct.pack("<Q", 0)
    return struct.pack("<QQ", len(vectors), len(vectors[0])) + np.concatenate([np.asarray(v, "<f4") for v in vectors]).tobytes()


def deserialize(raw: bytes) -> list[list[float]]:
    """The inverse; ValueError for truncated input."""
    if len(raw) < 8:
        raise ValueError("reading number of vectors: unexpected end")
    (count,) = struct.unpack_from("<Q", raw)
    if count == 0:
        return []
    if len(raw) < 16:
        raise ValueError("reading dimension: unexpected end")
    (width,) = struct.unpack_from("<Q", raw, 8)
    if len(raw) < 16 + 4 * count * width:
        raise ValueError("reading vectors: unexpected end")
    return np.frombuffer(raw, "<f4", count * width, 16).reshape(count, width).tolist()


def pack_batches(vectors: DataFrame, per_batch: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(batch, ids, data): each task's vectors in batches of at most per_batch rows, in the
    task's order; batches are numbered by their first id. Vectors of one length."""

    def work(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k in range(0, batch.num_rows, per_batch):
                ids = batch.column(0).slice(k, per_batch).to_pylist()
                rows.append((ids[0], ids, serialize(batch.column(1).slice(k, per_batch).to_pylist())))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.binary()))], names=["batch", "ids", "data"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(work, "batch long, ids array<long>, data binary")


def unpack_batches(packed: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vector) of batches; truncated data is an error."""

    def work(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            ids = [i for x in batch.column(0).to_pylist() for i in x]
            vectors = [v for x in batch.column(1).to_pylist() for v in deserialize(x)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "v"])

    return packed.select("ids", "data").mapInArrow(work, "id long, v array<float>").select(F.col("id").alias(id_col), F.col("v").alias(vec_col))


# --- files ------------------------------------------------------------------

#: A vector of a file, by its place there.
FOUND = "path string, pos long, vector array<float>"
#: Bytes that one task reads of a file, and of a file that is written.
RANGE_BYTES, FILE_BYTES = 64 << 20, 64 << 20
#: Values of a result batch.
BATCH_VALUES = 1 << 20


class _Range(InputPartition):
    """The k-th of n equal parts of a file's rows."""

    def __init__(self, path: str, k: int, n: int):
        super().__init__((path, k, n))


def _header(file) -> tuple[int, int, int]:
    """(count, width, offset of the values); ValueError for truncated files."""
    head = file.read_at(16, 0)
    if len(head) < 8:
        raise ValueError("reading number of vectors: unexpected end")
    (count,) = struct.unpack_from("<Q", head)
    if count == 0:
        return 0, 0, 8
    if len(head) < 16:
        raise ValueError("reading dimension: unexpected end")
    (width,) = struct.unpack_from("<Q", head, 8)
    if file.size() < 16 + 4 * count * width:
        raise ValueError("reading vectors: unexpected end")
    return count, width, 16


class _VectorReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes, self.tests = path, range_bytes, []

    def pushFilters(self, filters):
        """Files are chosen by their paths, rows by the bounds of their places, before they are read."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if (name == "path" and isinstance(f, (EqualTo, In))) or (name == "pos" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))):
                self.tests.append((name, type(f).__name__, f.value))
            elif not (name in ("path", "pos") and isinstance(f, IsNotNull)):  # neither is ever null
                yield f

    def partitions(self):
        wanted = lambda p: all(p == v if k == "EqualTo" else p in v for name, k, v in self.tests if name == "path")
        parts = [(p, max(1, -(-size // self.range_bytes))) for p, size in files_below(self.path) if wanted(p)]
        return [_Range(p, k, n) for p, n in parts for k in range(n)]

    def _rows(self, first: int, last: int) -> tuple[int, int]:
        for name, kind, v in self.tests:
            if name == "pos":
                first = max(first, {"EqualTo": v, "GreaterThan": v + 1, "GreaterThanOrEqual": v}.get(kind, first))
                last = min(last, {"EqualTo": v + 1, "LessThan": v, "LessThanOrEqual": v + 1}.get(kind, last))
        return first, last

    def read(self, partition):
        import pyarrow as pa

        if partition is None:  # no file at all
            return
        path, k, n = partition.value
        with store(self.path)[0].open_input_file(path) as file:
            count, width, offset = _header(file)
            at, last = self._rows(count * k // n, count * (k + 1) // n)
            step = max(1, BATCH_VALUES // max(1, width))
            while at < last:
                rows = min(step, last - at)
                values = np.frombuffer(file.read_at(4 * rows * width, offset + 4 * at * width), "<f4").astype(np.float32)
                ends = pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32))
                vectors = pa.ListArray.from_arrays(ends, pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([path] * rows), pa.array(np.arange(at, at + rows)), vectors], names=["path", "pos", "vector"])
                at += rows


class _VectorWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int):
        self.staging, self.file_bytes = Staging(path), file_bytes

    def write(self, iterator):
        """Files of at most ``file_bytes`` (or one vector); one is held until its count is known."""
        import uuid

        names, held, size, width = [], [], 0, None

        def flush():
            names.append(f"vectors-{uuid.uuid4().hex}.bin")
            with self.staging.open(names[-1]) as out:
                out.write(struct.pack("<QQ", sum(len(x) for x in held), width))
                for x in held:
                    out.write(x.tobytes())

        for batch in iterator:
            column = batch.column(0)
            if column.null_count or column.flatten().null_count:
                raise ValueError("the binary form has no nulls")
            lengths = np.diff(np.asarray(column.offsets))
            if len(lengths) and (lengths != (width := lengths[0] if width is None else width)).any():
                raise ValueError("vectors of different lengths")
            values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), "<f4").reshape(len(column), -1 if width else 0)
            for at in range(0, len(values), step := max(1, (self.file_bytes - 16) // (4 * max(1, int(width))))):
                piece = values[at : at + step]
                if held and size + piece.nbytes > self.file_bytes - 16:
                    flush()
                    held, size = [], 0
                held.append(piece)
                size += piece.nbytes
        if held:
            flush()
        return Staged(names)

    def commit(self, messages):
        self.staging.publish({n: n for m in messages if m for n in m.names})

    def abort(self, messages):
        self.staging.discard()


class VectorFiles(DataSource):
    """``format("binary_vectors")``: files of the binary form. Options: path, rangeBytes, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "binary_vectors"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema):
        return _VectorReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite):
        return _VectorWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)))


def read_vectors(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of FOUND of all files under a folder, or of one. A large file is read in parts, each from
    its offset; filters on path and on bounds of pos choose what is read. A truncated file is
    an error. Lets Python sources take filters in this session."""
    spark.dataSource.register(VectorFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("binary_vectors").option("rangeBytes", range_bytes).load(path)


def write_vectors(vectors: DataFrame, path: str, vec_col: str = "embedding", file_bytes: int = FILE_BYTES) -> None:
    """Write a column of vectors as files of the binary form; each file has vectors of one length.
    Nulls and, within a task, different lengths are errors, which leave nothing behind."""
    vectors.sparkSession.dataSource.register(VectorFiles)
    vectors.select(F.col(vec_col).cast("array<float>").alias("vector")).write.format("binary_vectors").option("fileBytes", file_bytes).mode("append").save(path)
