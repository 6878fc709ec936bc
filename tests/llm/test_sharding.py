"""Shards against plain extendible hashing."""

import hashlib
import random

import pytest

from millrace.llm import sharding


def bits(key) -> str:
    return f"{int(hashlib.md5(('\0null' if key is None else str(key)).encode()).hexdigest()[:15], 16):060b}"


def plain(rows, limit):
    """Insert one by one; a full bucket splits on its next bit."""
    todo, leaf = [("", rows)], {}
    while todo:
        prefix, inside = todo.pop()
        size = sum(n for _, n in inside)
        if size <= limit or len({k for k, _ in inside}) == 1:
            for k, _ in inside:
                leaf[k] = (prefix, size)
            continue
        for b in "01":
            part = [(k, n) for k, n in inside if bits(k).startswith(prefix + b)]
            if part:
                todo.append((prefix + b, part))
    return leaf


@pytest.mark.parametrize("limit, step", [(50, 12), (400, 2), (10**9, 12), (3, 3)])
def test_directory(spark, monkeypatch, limit, step):
    monkeypatch.setattr(sharding, "STEP", step)
    rng = random.Random(7)
    rows = [(i, "x" * rng.choice([0, 1, 5, 20, 90])) for i in range(150)] + [(900, "é" * 300), (900, "é" * 300), (None, "n"), (901, None)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, prefix string")
    want = plain([(i, len((t or "").encode())) for i, t in rows], limit)
    out = sharding.assign_shards(docs, limit).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.shard, r.shard_bytes) == want[r.doc_id] and r.depth == len(r.shard)


def test_join_beyond_small(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * 10) for i in range(200)], "doc_id long, text string")
    first = {r.doc_id: r.shard for r in sharding.assign_shards(docs, 60).collect()}
    monkeypatch.setattr(sharding, "SMALL", 0)
    assert {r.doc_id: r.shard for r in sharding.assign_shards(docs, 60).collect()} == first


def test_empty_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 10) for i in range(40)], "doc_id long, text string")
    assert sharding.assign_shards(docs.where("false"), 60).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), 100)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert again.count() == 40
    assert max(r.n for r in again.selectExpr("shard_bits", "octet_length(text) as n").groupBy("shard_bits").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()) <= 100


def test_written_shards_keep_every_row(spark, tmp_path):
    rows = [(None, "a", "x"), (None, "bb", "y"), (1, "ccc", "z"), (1, "ccc", "z"), (2, None, "w")] + [(i, "d" * i, "v") for i in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard_bits string")
    column = sharding.write_shards(docs, f"{tmp_path}/s", 200)
    assert column == "shard_bits_"
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(map(repr, (tuple(r[c] for c in docs.columns) for r in back.collect()))) == sorted(map(repr, rows))
    assert back.select(column).distinct().count() > 5
    where = {r.doc_id: (r.shard, r.shard_bytes) for r in sharding.assign_shards(docs, 200).collect()}
    assert {(r.doc_id, "b" + where[r.doc_id][0]) for r in back.collect()} == {(r.doc_id, r[column]) for r in back.collect()}
    sharding.write_shards(docs.where("false"), f"{tmp_path}/none", 200)
