"""Indexes of models as a source and a sink: a partition a file, filters on type and name pushed down."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringStartsWith

from millrace.sources.stores import Staged, Staging, files_below, store

#: An entry of an index, and the index that it is from; ``error`` alone for an index that cannot be used.
ENTRY = "name string, source string, owner string, type string, description string, capabilities array<string>, size long, variants array<string>, backends array<string>"
FOUND = f"index string, {ENTRY}, error string"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]
#: Versions of the format that are understood; the last is written.
VERSIONS = (1, 2)
#: Bytes of entries of an index that is written. A reader holds an index whole.
INDEX_BYTES = 8 << 20


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def _texts(value) -> list[str] | None:
    return [v for v in value if isinstance(v, str)] if isinstance(value, list) else None


def read_index(raw: bytes) -> tuple[list[tuple], str | None]:
    """(entries in order of ENTRY, what is wrong). Fields of another type are null."""
    try:
        index = json.loads(raw)
    except ValueError:
        return [], "invalid JSON"
    if not isinstance(index, dict):
        return [], "invalid JSON"
    version = index.get("schemaVersion", 0)
    if version not in VERSIONS or isinstance(version, bool):
        return [], "unsupported schema version"
    rows = []
    for m in index.get("models") or []:
        if isinstance(m, dict):
            size = m.get("size", 0)
            rows.append((_text(m.get("name")), _text(m.get("source")), _text(m.get("owner")), _text(m.get("type")), _text(m.get("description")),
                         _texts(m.get("capabilities")), size if isinstance(size, int) and not isinstance(size, bool) else None, _texts(m.get("variants")), _texts(m.get("backends"))))
    return rows, None


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, []

    def pushFilters(self, filters):
        """Equality, lists and beginnings of type and name are decided here; Spark keeps the rest."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("type", "name") and isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)):
                self.tests.append((NAMES.index(column), type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        return [_File(path) for path, _ in files_below(self.path) if path.endswith(".json")]

    def _wanted(self, row: tuple) -> bool:
        for at, kind, value in self.tests:
            own = row[at]
            if own is None or not (own == value if kind == "EqualTo" else own in value if kind == "In" else kind == "IsNotNull" or own.startswith(value)):
                return False
        return True

    def read(self, partition):
        if partition is None:  # no index at all
            return
        system, _ = store(self.path)
        with system.open_input_file(partition.value) as file:
            rows, error = read_index(file.read())
        if error and not self.tests:  # an index without entries has no type or name that could match
            yield (partition.value, *[None] * len(NAMES), error)
        for row in rows:
            if self._wanted(row):
                yield (partition.value, *row, None)


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.staging = Staging(path)

    def write(self, iterator):
        """Indexes of a task, written entry by entry; one of INDEX_BYTES is closed and another begun."""
        import uuid

        names, out, size = [], None, 0
        for row in iterator:
            entry = json.dumps({k: v for k, v in zip(NAMES, row) if v is not None}).encode()
            if out is not None and size + len(entry) > INDEX_BYTES:
                out.write(b"]}\n")
                out.close()
                out = None
            if out is None:
                names.append(f"index-{uuid.uuid4().hex}.json")
                out, size = self.staging.open(names[-1]), 0
                out.write(b'{"schemaVersion": %d, "models": [' % VERSIONS[-1])
            else:
                out.write(b",\n")
            out.write(entry)
            size += len(entry)
        if out is not None:
            out.write(b"]}\n")
            out.close()
        return Staged(names)

    def commit(self, messages):
        self.staging.publish({n: n for m in messages if m for n in m.names})

    def abort(self, messages):
        self.staging.discard()


class IndexSource(DataSource):
    """``format("model_index")`` over a folder of ``*.json`` indexes, or one file."""

    @classmethod
    def name(cls) -> str:
        return "model_index"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema):
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def read_indexes(spark: SparkSession, path: str) -> DataFrame:
    """Rows of FOUND of all indexes under a folder (hidden files are left out). Lets Python
    sources take filters in this session (spark.sql.python.filterPushdown.enabled)."""
    spark.dataSource.register(IndexSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("model_index").load(path)


def write_indexes(entries: DataFrame, path: str) -> None:
    """Write entries as indexes, one or more of INDEX_BYTES a partition of the rows; they appear when all are done.
    Missing columns of ENTRY are null, others are left out; null fields are not written."""
    entries.sparkSession.dataSource.register(IndexSource)
    columns = [F.col(c.split()[0]) if c.split()[0] in entries.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ENTRY.split(", ")]
    entries.select(*columns).write.format("model_index").mode("append").save(path)
