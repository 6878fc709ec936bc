"""Archives: round trips, and what a damaged archive still gives."""

import base64
import gzip
import hashlib
import random

import pytest

from millrace.llm import warc
from millrace.llm.queries import ORACLE, op12_warc, page_records

PAGES = [(1, "http://a.example/x y?é=1", "<p>one</p>"), (2, None, None), (3, "http://a.example/", ""), (7, "u", "<p>one</p>"), (7, "v", "<p>one</p>"), (4, "w", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
         (None, "n", "<p>one</p>"), (None, "m", "alone"), (None, "m", "alone"), (9, "é", "ünï\r\n\r\n\x00" * 400), (10, "long", "z" * 3_000_000)]
KIND = "page_id long, url string, html string, record_type string, payload int"


def judged(pages, least=0):
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        ids = [j for j, _, h in pages if (h or "").encode() == raw and j is not None]
        size = sum((h or "").encode() == raw for _, _, h in pages)
        again = len(raw) >= least and size > 1 and ids and i != max(ids)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", max(ids) if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("compression, least, size", [("gzip", 0, 64 << 20), ("none", 0, 1), ("gzip", 3, 1)])
def test_round_trip(spark, tmp_path, compression, least, size):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], KIND)
    warc.write_archives(warc.with_revisits(pages, least), f"{tmp_path}/a", compression, size)
    found = warc.read_archives(spark, f"{tmp_path}/a")
    assert warc.gaps(found).count() == 0
    assert sorted([tuple(r) for r in page_records(found).collect()], key=repr) == judged(PAGES, least)
    texts = {r.record_id: bytes(r.payload) for r in found.where("record_type = 'response'").collect()}
    assert texts["urn:page:10"] == b"z" * 3_000_000 and texts["urn:page:4"] == PAGES[5][2].encode()
    assert {r.target_uri for r in found.where("record_id = 'urn:page:1'").collect()} == {"http://a.example/x%20y?%C3%A9=1"}


def test_nothing(spark, tmp_path):
    (tmp_path / "b").mkdir()
    assert warc.read_archives(spark, f"{tmp_path}/b").count() == 0
    none = spark.createDataFrame([], KIND)
    warc.write_archives(warc.with_revisits(none), f"file:{tmp_path}/b")
    assert page_records(warc.read_archives(spark, f"file:{tmp_path}/b")).count() == 0


def archive(n, packed):
    raw = [warc.record_bytes("response", f"urn:page:{i}", "u", None, None, p := b"payload %d " % i * 40, warc.sha1(p)) for i in range(n)]
    return [gzip.compress(r, 5, mtime=0) if packed else r for r in raw]


def scanned(data, packed, most=1 << 30):
    import pyarrow as pa

    rows = list(warc.scan(warc._Window(pa.BufferReader(data)), packed, most))
    at = 0
    for offset, length in dict.fromkeys((r["offset"], r["length"]) for r in rows):
        assert offset == at  # records and gaps cover the archive
        at += length
    assert at == len(data)
    return [r["record_id"] for r in rows if not r.get("error")], [(r["offset"], r["length"], r["error"]) for r in rows if r.get("error")]


@pytest.mark.parametrize("packed", [False, True])
def test_each_damage_costs_its_record(packed):
    parts = archive(9, packed)
    starts = [sum(map(len, parts[:k])) for k in range(10)]
    ids = [f"urn:page:{i}" for i in range(9)]
    whole = b"".join(parts)
    assert scanned(whole, packed) == (ids, [])
    rng = random.Random(5)
    for _ in range(60):
        k = rng.randrange(9)
        at = starts[k] + rng.randrange(len(parts[k]))
        kind = rng.choice(["flip", "drop", "add"])
        damaged = {"flip": whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :], "drop": whole[:at] + whole[at + 1 :], "add": whole[:at] + b"?" + whole[at:]}[kind]
        found, lost = scanned(damaged, packed)
        near = {ids[k], ids[k - 1]} if k else {ids[0]}  # a byte more or less also hides the end of the record before
        assert [i for i in found if i in ids and i not in near] == [i for i in ids if i not in near], (kind, k, lost)
        assert len(found) >= 7 and (packed or kind != "flip" or len(found) >= 8)
    # cut off, rubbish in front, between and behind
    found, lost = scanned(whole[: starts[5] + 20], packed)
    assert found == ids[:5] and lost == [(starts[5], 20, lost[0][2])]
    rubbish = bytes(rng.randrange(256) for _ in range(3000)) + warc.MEMBER + b"WARC/1.1\r\n"
    found, lost = scanned(rubbish + b"".join(parts[:3]) + rubbish + b"".join(parts[3:]) + rubbish, packed)
    assert found == ids and [x[1] for x in lost] == [len(rubbish)] * 3


def test_wrong_digest_length_and_limit():
    good, other = archive(2, False)
    wrong = good.replace(b"payload 0 payload 0", b"payload 0 pAyload 0")
    assert scanned(wrong + other, False) == (["urn:page:1"], [(0, len(wrong), "another payload than its digest says")])
    short = good.replace(b"Content-Length: ", b"Content-Length: 9", 2)
    assert scanned(short + other, False)[0] == ["urn:page:1"]
    assert scanned(good + other, False, most=10)[0] == []
    inside = gzip.compress(wrong + other)
    assert scanned(inside, True) == (["urn:page:1"], [(0, len(inside), "inside a member: another payload than its digest says")])


def test_gaps_are_logged(spark, tmp_path):
    parts = archive(4, True)
    (tmp_path / "x.warc.gz").write_bytes(parts[0] + b"\0" * 50 + parts[1] + parts[2][:-9] + parts[3])
    found = warc.read_archives(spark, str(tmp_path))
    assert {r.record_id for r in found.where("error is null").collect()} == {"urn:page:0", "urn:page:1", "urn:page:3"}
    assert [tuple(r)[1:3] for r in warc.gaps(found).orderBy("offset").collect()] == [(len(parts[0]), 50), (len(parts[0] + parts[1]) + 50, len(parts[2]) - 9)]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], KIND)
    bad = warc.with_revisits(pages).withColumn("date", F.when(F.col("record_id") == "urn:page:10", F.raise_error(F.lit("stop")).cast("string")))
    with pytest.raises(Exception, match="stop"):
        warc.write_archives(bad, f"{tmp_path}/c")
    assert list(tmp_path.rglob("*.warc*")) == []


def test_same_as_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    rel = con.sql(ORACLE["op12_warc"])
    out = op12_warc(spark, path)
    place = [rel.columns.index(c) for c in out.columns]
    assert {tuple(r) for r in out.collect()} == {tuple(r[i] for i in place) for r in rel.fetchall()}
