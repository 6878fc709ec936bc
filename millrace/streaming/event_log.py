"""A sink of stream events that commits each micro-batch once."""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter

from millrace.sources.stores import Staged, store

#: An event: whose, its place, its text.
EVENT = "id string, index int, data string"


class _Writer(DataSourceStreamWriter):
    """Tasks write files of their own under a hidden folder; a commit gathers those of the batch in
    a folder and renames that. A batch whose folder is there was committed before a restart:
    what it wrote again is dropped. One query writes a folder."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _at(self, *parts: str) -> str:
        return posixpath.join(store(self.path)[1], *parts)

    def write(self, iterator):
        system, _ = store(self.path)
        name, out = f"part-{uuid.uuid4().hex}.jsonl", None
        for row in iterator:
            if out is None:
                system.create_dir(self._at("_staged"), recursive=True)
                out = system.open_output_stream(self._at("_staged", name), compression=None)
            out.write(json.dumps({"id": row[0], "index": row[1], "data": row[2]}).encode() + b"\n")
        if out is None:
            return Staged([])
        out.close()
        return Staged([name])

    def commit(self, messages, batchId):
        from pyarrow.fs import FileType

        system, _ = store(self.path)
        names = [n for m in messages if m for n in m.names]
        target = self._at(f"epoch-{batchId:012d}")
        if names and system.get_file_info(target).type == FileType.NotFound:
            gathered = self._at("_staged", f"epoch-{batchId:012d}-{uuid.uuid4().hex}")
            system.create_dir(gathered)
            for n in names:
                system.move(self._at("_staged", n), posixpath.join(gathered, n))
            system.move(gathered, target)
        self._sweep()

    def abort(self, messages, batchId):
        self._sweep()

    def _sweep(self) -> None:
        """Only one batch runs at a time: what is still staged belongs to none."""
        from pyarrow.fs import FileSelector, FileType

        system, _ = store(self.path)
        for found in system.get_file_info(FileSelector(self._at("_staged"), allow_not_found=True)):
            (system.delete_dir if found.type == FileType.Directory else system.delete_file)(found.path)


class EventLog(DataSource):
    """``format("event_log")`` for streams of EVENT rows."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return EVENT

    def streamWriter(self, schema, overwrite):
        return _Writer(self.options["path"])


def log_events(events: DataFrame, path: str, checkpoint: str, **trigger):
    """Start a query that appends a stream of (id, index, data) to the log under ``path``. After a
    restart from its checkpoint no event is lost and none repeated."""
    events.sparkSession.dataSource.register(EventLog)
    rows = events.selectExpr("cast(id as string) as id", "cast(index as int) as index", "cast(data as string) as data")
    return rows.writeStream.format("event_log").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Committed events; none for a log that has not begun."""
    from pyarrow.fs import FileType

    system, root = store(path)
    begun = system.get_file_info(root).type != FileType.NotFound and any(i.base_name.startswith("epoch-") for i in system.get_file_info(_top(root)))
    return spark.read.schema(EVENT).json(f"{path.rstrip('/')}/epoch-*") if begun else spark.createDataFrame([], EVENT)


def _top(root: str):
    from pyarrow.fs import FileSelector

    return FileSelector(root)
