"""Files in the stores that pyarrow reaches (local, HDFS, S3, GCS), by the paths Spark uses.

Python data sources read and write through these: every task opens its files itself, and
what tasks write is staged beside the target until the driver publishes it.
"""

from __future__ import annotations

import posixpath
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import WriterCommitMessage

#: Files that are renamed at a time when a write is published.
RENAMES = 16


def store(path: str):
    """(file system, path inside it) of a path or URI."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def files_below(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a folder, or of one file, by name; hidden files and
    folders (a leading ``_`` or ``.``) are left out."""
    from pyarrow.fs import FileSelector, FileType

    system, root = store(path)
    if system.get_file_info(root).type == FileType.File:
        return [(root, system.get_file_info(root).size)]
    found = system.get_file_info(FileSelector(root, recursive=True))
    inside = [(i.path, i.size, i.path[len(root.rstrip("/")) :].strip("/").split("/")) for i in found if i.type == FileType.File]
    return sorted((p, n) for p, n, parts in inside if not any(x[:1] in ("_", ".") for x in parts))


@dataclass
class Staged(WriterCommitMessage):
    """Names of the files that one task has staged, and what else the driver should know."""

    names: list[str]
    facts: list[tuple] | None = None


class Staging:
    """Files of one write: under a hidden folder until published, gone if discarded.

    The driver makes the hidden folder; tasks only open files in it, so that a task that
    still runs after the write was given up finds no place to go on. A task's attempt has
    names of its own: a killed or repeated one leaves nothing that is ever published.
    Publishing is a rename a file, some at a time."""

    def __init__(self, folder: str):
        self.folder, self.token = folder.rstrip("/"), uuid.uuid4().hex
        store(self.folder)[0].create_dir(self._at().rstrip("/"), recursive=True)

    def _at(self, name: str = "") -> str:
        return posixpath.join(store(self.folder)[1], "_staged", self.token, name)

    def open(self, name: str):
        return store(self.folder)[0].open_output_stream(self._at(name), compression=None)

    def publish(self, moves: dict[str, str]) -> None:
        """Rename staged files to their names in the folder, RENAMES at a time, then drop what was
        staged besides. Each folder is made once."""
        system, root = store(self.folder)
        staged = self._at()
        for folder in {posixpath.dirname(posixpath.join(root, target)) for target in moves.values()}:
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(RENAMES) as pool:
            for _ in pool.map(lambda m: system.move(posixpath.join(staged, m[0]), posixpath.join(root, m[1])), moves.items()):
                pass
        self.discard()

    def discard(self) -> None:
        """Drop what is staged by this write, and the hidden folder once no other write uses it.
        A task that is just opening a file can disturb that once, not for long."""
        from pyarrow.fs import FileSelector, FileType

        system, root = store(self.folder)
        top = posixpath.join(root, "_staged")
        for pause in (0.1, 0.5, 2, None):
            try:
                if system.get_file_info(self._at().rstrip("/")).type != FileType.NotFound:
                    system.delete_dir(self._at().rstrip("/"))
                break
            except OSError:
                if pause is None:
                    raise
                time.sleep(pause)
        if system.get_file_info(top).type != FileType.NotFound and not system.get_file_info(FileSelector(top)):
            system.delete_dir(top)


def shared_folder(spark) -> str:
    """Folder that driver and executors share: the session's spark.checkpoint.dir. A local
    session that names none (a test) gets a temporary one; on a cluster that is an error."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark, tag: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark)}/millrace/{tag}-{uuid.uuid4().hex}"
