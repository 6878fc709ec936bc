"""WARC archives as a source and a sink, with a reader that salvages damaged files.

Each record is checked: version line, headers, the end that its length promises, its
payload digest, and in compressed archives that its member decompresses. After a
failed check the reader looks for the next place where a whole record passes (the next
member, or version line), goes on from there and reports the bytes between as a gap.
An archive is read in one pass by one task, a record at a time.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from millrace.sources.stores import Staged, Staging, files_below, store

#: What goes into an archive. Null headers are left out.
RECORD = "record_type string, record_id string, target_uri string, refers_to string, date string, payload binary"
#: What comes out: a record with ``error`` null, or a quarantined gap of ``length`` bytes with only that set.
FOUND = "archive string, offset long, length long, error string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: The format's version line, the profile of revisits, the end of a record.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
REVISIT = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
#: Bytes that headers can have, that one read takes, that a result batch has about.
HEADERS, PIECE, BATCH = 1 << 16, 1 << 20, 1 << 24


def sha1(payload: bytes) -> str:
    """Upper-case base32 of SHA-1, as archives write it."""
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- writing ----------------------------------------------------------------


def record_bytes(kind: str, record_id: str, target: str | None, refers_to: str | None, date: str | None, payload: bytes, digest: str) -> bytes:
    """One record. Responses have the payload behind an HTTP header, revisits the header alone."""
    from urllib.parse import quote

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    headers = [VERSION, b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + record_id.encode() + b">", b"WARC-Date: " + (date or "1970-01-01T00:00:00Z").encode()]
    if target is not None:
        headers.append(b"WARC-Target-URI: " + quote(target, safe="!#$%&'()*+,/:;=?@[]~").encode())
    if refers_to is not None:
        headers += [b"WARC-Refers-To: <" + refers_to.encode() + b">", b"WARC-Profile: " + REVISIT]
    headers += [b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(headers) + END + block + END


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.staging = Staging(options["path"])
        self.packed, self.most = options.get("compression", "gzip") == "gzip", int(options.get("archiveBytes", 64 << 20))

    def write(self, iterator):
        """One or more archives a task; a new one begins once one has ``archiveBytes``."""
        import gzip

        names, out, size = [], None, 0
        for batch in iterator:
            columns = {c.name.lower(): batch.column(k) for k, c in enumerate(batch.schema)}
            for k in range(batch.num_rows):
                kind, record_id, target, refers_to, date, payload = (columns[c][k].as_py() for c in ("record_type", "record_id", "target_uri", "refers_to", "date", "payload"))
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                    names.append(f"archive-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}")
                    out, size = self.staging.open(names[-1]), 0
                raw = record_bytes(kind, record_id, target, refers_to, date, payload or b"", sha1(payload or b""))
                raw = gzip.compress(raw, 5, mtime=0) if self.packed else raw
                out.write(raw)
                size += len(raw)
        if out is not None:
            out.close()
        return Staged(names)

    def commit(self, messages):
        self.staging.publish({n: n for m in messages if m for n in m.names})

    def abort(self, messages):
        self.staging.discard()


# --- reading ----------------------------------------------------------------


class _Bad(Exception):
    """A check that failed."""


class _Window:
    """Bytes of a file by offset; holds the last piece read."""

    def __init__(self, file):
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def get(self, start: int, n: int) -> bytes:
        end = min(start + n, self.size)
        if start < self.at or end > self.at + len(self.held):
            self.at, self.held = start, self.file.read_at(max(n, PIECE), start)
        return self.held[start - self.at : max(start, end) - self.at]

    def find(self, what: re.Pattern, start: int, longest: int) -> int:
        """First match from ``start``, or the end of the file."""
        while start < self.size:
            if hit := what.search(piece := self.get(start, PIECE)):
                return start + hit.start()
            start += max(1, len(piece) - longest + 1)
        return self.size


def _plain(window: _Window, at: int, most: int):
    """(end, [record]) of the record at ``at``."""
    head = window.get(at, HEADERS)
    if not VERSION_LINE.match(head):
        raise _Bad("no version line")
    stop = head.find(END)
    if stop < 0:
        raise _Bad("headers without an end")
    lines = re.sub(rb"\r\n[ \t]+", b" ", head[:stop]).split(b"\r\n")[1:]
    if not all(b":" in line for line in lines):
        raise _Bad("a header without a value")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}
    if not headers.keys() >= {b"warc-type", b"warc-record-id", b"warc-date"}:
        raise _Bad("no type, id or date")
    length = headers.get(b"content-length", b"")
    if not re.fullmatch(rb"\d{1,18}", length):
        raise _Bad("no length")
    start, length = at + stop + len(END), int(length)
    if start + length + len(END) > window.size:
        raise _Bad("shorter than its length")
    if length > most:
        raise _Bad("longer than the limit")
    block = window.get(start, length + len(END))
    if block[length:] != END:
        raise _Bad("no end where its length says")
    block = block[:length]
    cut = block.find(END) if headers.get(b"content-type", b"").startswith(b"application/http") else -len(END)
    payload = block[cut + len(END) :] if cut != -1 else b""
    own, named = sha1(payload), headers.get(b"warc-payload-digest", b"").decode("latin-1")
    revisit = headers.get(b"warc-type") == b"revisit"
    if not revisit and named.startswith("sha1:") and named[5:].upper() != own:
        raise _Bad("another payload than its digest says")
    text = lambda key: headers[key].decode("utf-8", "replace").removeprefix("<").removesuffix(">") if key in headers else None
    record = {"record_type": text(b"warc-type"), "record_id": text(b"warc-record-id"), "target_uri": text(b"warc-target-uri"), "refers_to": text(b"warc-refers-to"),
              "payload_digest": named.removeprefix("sha1:") if revisit else own, "payload_bytes": None if revisit else len(payload), "payload": None if revisit else payload}
    return start + length + len(END), [record]


def _member(window: _Window, at: int, most: int):
    """(end, [records and inner gaps]) of the gzip member at ``at``."""
    import zlib

    import pyarrow as pa

    unpack, out, size, pos = zlib.decompressobj(31), [], 0, at
    while not unpack.eof:
        if not (piece := window.get(pos, PIECE)):
            raise _Bad("member without an end")
        try:
            out.append(unpack.decompress(piece, most + HEADERS - size + 1))
        except zlib.error:
            raise _Bad("member that does not decompress") from None
        size += len(out[-1])
        if size > most + HEADERS:
            raise _Bad("longer than the limit")
        pos += len(piece)
    inner = _Window(pa.BufferReader(b"".join(out)))
    found = [{"error": f"inside a member: {row['error']}"} if row.get("error") else row for row in scan(inner, False, most)]
    if all(row.get("error") for row in found):
        raise _Bad(found[0]["error"] if found else "empty member")
    return pos - len(unpack.unused_data), found


def _opens(window: _Window, at: int) -> bool:
    """Whether what begins at ``at`` decompresses to the beginning of a record."""
    import zlib

    try:
        return zlib.decompressobj(31).decompress(window.get(at, HEADERS), 7) == VERSION[:7]
    except zlib.error:
        return False


def scan(window: _Window, packed: bool, most: int):
    """Records and gaps of an archive, in order; offsets and lengths add up to its size."""
    parse, mark = (_member, re.compile(re.escape(MEMBER))) if packed else (_plain, VERSION_LINE)
    at, bad = 0, None
    while at < window.size:
        try:
            end, found = parse(window, at, most)
        except _Bad as why:
            bad = bad or (at, str(why))
            at = window.find(mark, at + 1, 10)
            while packed and at < window.size and not _opens(window, at):
                at = window.find(mark, at + 1, 10)
            continue
        if bad:
            yield {"offset": bad[0], "length": at - bad[0], "error": bad[1]}
            bad = None
        for row in found:
            yield row | {"offset": at, "length": end - at}
        at = end
    if bad:
        yield {"offset": bad[0], "length": window.size - bad[0], "error": bad[1]}


class _Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("recordBytes", 1 << 30))
        self.whole = options.get("payload", "true").lower() != "false"

    def partitions(self):
        return [_Archive(path) for path, _ in files_below(self.path)]

    def read(self, partition):
        import pyarrow as pa

        if partition is None:  # no archive at all
            return
        names = [c.split()[0] for c in FOUND.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        shape = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in FOUND.split(", ")])
        system, _ = store(self.path)
        rows, size = [], 0
        batch = lambda: pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, shape)
        with system.open_input_file(partition.value) as file:
            window = _Window(file)
            packed = partition.value.endswith(".gz") or window.get(0, 3) == MEMBER
            for row in scan(window, packed, self.most):
                row = row | {"archive": partition.value}
                size += len(row.get("payload") or b"") + 500
                if not self.whole:
                    row["payload"] = None
                rows.append(row)
                if size >= BATCH:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """``format("warc")``. Options: path; to write: compression (gzip or none), archiveBytes;
    to read: payload (false: digests and sizes only), recordBytes (longer ones are gaps)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return FOUND

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer({k: v for k, v in zip(("path", "compression", "archiveBytes"), (self.options.get("path"), self.options.get("compression", "gzip"), self.options.get("archiveBytes", 64 << 20)))})


def write_archives(records: DataFrame, path: str, compression: str = "gzip", archive_bytes: int = 64 << 20) -> None:
    """Write records (see RECORD; more columns are left out) as archives of about ``archive_bytes``.

    A null payload is empty. Archives appear when all tasks are done; a failed write leaves none.
    No record, no archive."""
    records.sparkSession.dataSource.register(WarcSource)
    rows = records.select(*[c.split()[0] for c in RECORD.split(", ")])
    rows.write.format("warc").option("compression", compression).option("archiveBytes", archive_bytes).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of FOUND of all archives under ``path``: every record that passes its checks, and every gap."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def gaps(found: DataFrame) -> DataFrame:
    """(archive, offset, length, error): the log of quarantined bytes; an error inside a whole
    member has the member's place."""
    return found.where("error is not null").select("archive", "offset", "length", "error")


def with_revisits(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records of pages: of equal payloads of at least ``least`` bytes the one of the largest id is
    a response and others revisit it; all else are responses.

    Null html is an empty payload. Rows that repeat that largest id are responses too; rows
    without id revisit as others do, and are responses where none has an id. Payloads are
    equal by SHA-256; only digests are grouped, a digest's rows stay in many tasks."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("same", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= least).groupBy("same").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("same", "first")
    judged = rows.join(shared, "same", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return judged.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), name("id").alias("record_id"), "target_uri",
                         F.when(revisit, name("first")).alias("refers_to"), F.lit(None).cast("string").alias("date"), "payload")


def resolved(found: DataFrame) -> DataFrame:
    """(record_id, target_uri, record_type, refers_to, payload_bytes, payload_digest) of read records, those
    of revisits from the response they refer to; null bytes where that was not recovered."""
    records = found.where("error is null").select("record_id", "target_uri", "record_type", "refers_to", "payload_bytes", "payload_digest")
    seen = records.where("record_type <> 'revisit' and record_id is not null").select(F.col("record_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full")).distinct()
    whole = records.where("coalesce(record_type, '') <> 'revisit'")
    again = records.where("record_type = 'revisit'").join(seen, ["refers_to", "payload_digest"], "left")
    return whole.unionByName(again.withColumn("payload_bytes", F.col("full")).drop("full"))
