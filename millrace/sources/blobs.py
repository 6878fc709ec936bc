"""Artefacts by their digests: copies that are verified before anyone sees them."""

from __future__ import annotations

import hashlib
import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter

from millrace.sources.stores import Staged, Staging, store

#: What to write: under ``name`` in the folder, the bytes of ``content``, or where that is null those of the file ``source``.
WANTED = "name string, digest string, size long, content binary, source string"
#: Bytes copied at a time.
PIECE = 1 << 20


class Refused(ValueError):
    """An artefact that is not what its digest or size says, or has no place in the folder."""


def file_digest(path: str) -> str | None:
    """Digest of a file, read piece by piece; null where there is none."""
    from pyarrow.fs import FileType

    system, at = store(path)
    if system.get_file_info(at).type != FileType.File:
        return None
    state = hashlib.sha256()
    with system.open_input_file(at) as file:
        while piece := file.read(PIECE):
            state.update(piece)
    return "sha256:" + state.hexdigest()


def _pieces(content: bytes | None, source: str | None):
    if content is not None:
        yield from (content[k : k + PIECE] for k in range(0, len(content), PIECE))
        return
    if source is None:
        raise Refused("neither content nor source")
    system, at = store(source)
    with system.open_input_file(at) as file:
        while piece := file.read(PIECE):
            yield piece


class _Copier(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), Staging(path)

    def write(self, iterator):
        """Each artefact goes to a staged file of this attempt while it is hashed; one that
        is already there with its digest is not copied."""
        import uuid

        attempt, names, facts = uuid.uuid4().hex, [], []
        for k, (name, digest, size, content, source) in enumerate(iterator):
            parts = (name or "").split("/")
            if any(p in ("", ".", "..") for p in parts) or parts[0][:1] == "_":
                raise Refused(f"{name}: no name of a file in the folder")
            if digest is None or not digest.startswith("sha256:"):
                raise Refused(f"{name}: invalid digest")
            if file_digest(posixpath.join(self.path, name)) == digest:
                facts.append((name, digest, None))
                continue
            staged, state, copied = f"{attempt}-{k}", hashlib.sha256(), 0
            with self.staging.open(staged) as out:
                for piece in _pieces(content, source):
                    out.write(piece)
                    state.update(piece)
                    copied += len(piece)
            if size is not None and size > 0 and copied != size:
                raise Refused(f"{name}: size mismatch: expected {size}, got {copied}")
            if (own := "sha256:" + state.hexdigest()) != digest:
                raise Refused(f"{name}: hash mismatch: expected {digest}, got {own}")
            names.append(staged)
            facts.append((name, digest, staged))
        return Staged(names, facts)

    def commit(self, messages):
        """Renames what all tasks have verified. Two digests for one name are refused before any is."""
        moves: dict[str, str] = {}
        digests: dict[str, str] = {}
        taken: set[str] = set()
        for name, digest, staged in (f for m in messages if m for f in m.facts):
            if digests.setdefault(name, digest) != digest:
                self.staging.discard()
                raise Refused(f"{name}: two digests")
            if staged is not None and name not in taken:
                moves[staged] = name
                taken.add(name)
        self.staging.publish(moves)

    def abort(self, messages):
        self.staging.discard()


class BlobSink(DataSource):
    """``format("verified_copy")``: writes rows of WANTED as files."""

    @classmethod
    def name(cls) -> str:
        return "verified_copy"

    def writer(self, schema, overwrite):
        return _Copier(self.options["path"])


def copy_verified(wanted: DataFrame, path: str) -> None:
    """Write artefacts (see WANTED; missing columns are null) under a folder, all or none.

    Every byte is hashed on its way; a wrong digest, a wrong size (null or 0: unknown) or a
    name outside the folder fails the write, and a failed write, a killed task included,
    leaves the folder as it was. Files that are there with their digest stay untouched. Rows
    that repeat a name and digest are one file. The driver holds the names and digests of
    one write. Files land some at a time once all are verified."""
    wanted.sparkSession.dataSource.register(BlobSink)
    columns = [F.col(c.split()[0]) if c.split()[0] in wanted.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in WANTED.split(", ")]
    wanted.select(*columns).write.format("verified_copy").mode("append").save(path)
