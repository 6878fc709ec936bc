"""Indexes, verified copies and reads under limits: what is written, refused, left behind."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import catalogue
from millrace.sources import blobs, fetch, index, stores

digest = lambda raw: "sha256:" + hashlib.sha256(raw).hexdigest()
tree = lambda top: sorted(os.path.relpath(os.path.join(d, f), top) for d, _, fs in os.walk(top) for f in fs)


def test_index_files(spark, tmp_path):
    good = {"schemaVersion": 2, "models": [{"name": "a", "type": "embedder", "size": 5, "variants": ["f16", 3], "extra": 1}, {"name": "b", "type": "reader", "size": "x"}, 7, {"type": "embedder"}]}
    (tmp_path / "one.json").write_text(json.dumps(good))
    (tmp_path / "none.json").write_text('{"schemaVersion": 1}')
    (tmp_path / "old.json").write_text('{"schemaVersion": 3, "models": [{"name": "c", "type": "embedder"}]}')
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "_hidden.json").write_text(json.dumps(good))
    (tmp_path / "notes.txt").write_text("x")
    found = index.read_indexes(spark, str(tmp_path))
    rows = [(r["index"].rsplit("/", 1)[1], r.name, r.type, r.size, r.variants, r.error) for r in found.collect()]
    assert sorted(rows, key=repr) == sorted([("one.json", "a", "embedder", 5, ["f16"], None), ("one.json", "b", "reader", None, None, None), ("one.json", None, "embedder", 0, None, None),
                                             ("old.json", None, None, None, None, "unsupported schema version"), ("bad.json", None, None, None, None, "invalid JSON")], key=repr)
    one = found.where("type = 'embedder' and name = 'a'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and " Filter (" not in plan  # decided in the reader
    assert found.where("size > 1 and type like 'emb%'").count() == 1
    assert [tuple(r) for r in catalogue.remote_listing(found, "READERS").collect()] == [("b", "reader", "0 B", "", "")]
    with pytest.raises(ValueError):
        catalogue.remote_listing(found, "tables")


def test_index_partitions(spark, tmp_path):
    entries = spark.range(0, 50, 1, 5).select(F.col("id").cast("string").alias("name"), F.lit("reader").alias("type"), F.lit("é\n\"").alias("description"))
    index.write_indexes(entries, f"{tmp_path}/i")
    assert len(tree(tmp_path / "i")) == 5
    found = index.read_indexes(spark, f"{tmp_path}/i")
    assert found.rdd.getNumPartitions() == 5 and {(r.name, r.description, r.size) for r in found.collect()} == {(str(k), 'é\n"', 0) for k in range(50)}
    (tmp_path / "empty").mkdir()
    assert index.read_indexes(spark, f"{tmp_path}/empty").count() == 0


def wanted(spark, rows):
    return spark.createDataFrame(rows, "name string, digest string, size long, content binary")


def test_copies(spark, tmp_path):
    big = os.urandom(3 << 20)
    (tmp_path / "src").write_bytes(big)
    rows = [("a/x", digest(b"1"), 1, b"1"), ("a/x", digest(b"1"), None, b"1"), ("b", digest(b""), 0, b"")]
    blobs.copy_verified(wanted(spark, rows).repartition(3), f"{tmp_path}/to")
    blobs.copy_verified(spark.createDataFrame([("c", digest(big), len(big), f"file://{tmp_path}/src")], "name string, digest string, size long, source string"), f"{tmp_path}/to")
    assert tree(tmp_path / "to") == ["a/x", "b", "c"] and (tmp_path / "to/c").read_bytes() == big
    # what is there with its digest is left alone, and its source is not even opened
    before = os.stat(tmp_path / "to/c").st_mtime_ns
    blobs.copy_verified(spark.createDataFrame([("c", digest(big), "/nowhere")], "name string, digest string, source string"), f"{tmp_path}/to")
    assert os.stat(tmp_path / "to/c").st_mtime_ns == before
    # a file of other bytes is replaced
    (tmp_path / "to/b").write_bytes(b"spoilt")
    blobs.copy_verified(wanted(spark, rows), f"{tmp_path}/to")
    assert (tmp_path / "to/b").read_bytes() == b"" and tree(tmp_path / "to") == ["a/x", "b", "c"]


@pytest.mark.parametrize("row, why", [(("z", digest(b"2"), None, b"1"), "hash mismatch"), (("z", digest(b"1"), 2, b"1"), "size mismatch"), (("../z", digest(b"1"), None, b"1"), "no name"), (("a//z", digest(b"1"), None, b"1"), "no name"),
                                      ((None, digest(b"1"), None, b"1"), "no name"), (("z", "md5:1", None, b"1"), "invalid digest"), (("z", None, None, b"1"), "invalid digest"), (("z", digest(b"1"), None, None), "neither"), (("good0", digest(b"1"), None, b"1"), "two digests")])
def test_a_refused_copy_leaves_nothing(spark, tmp_path, row, why):
    rows = [(f"good{k}", digest(b"good"), 4, b"good") for k in range(8)]
    with pytest.raises(Exception, match=why):
        blobs.copy_verified(wanted(spark, [*rows, row]).repartition(4), f"{tmp_path}/to")
    assert tree(tmp_path) == []


def test_a_killed_task_leaves_nothing(spark, tmp_path):
    def dies(batches):
        for batch in batches:
            yield batch
            if 5 in batch.column(2).to_pylist():
                os._exit(1)

    rows = wanted(spark, [(f"f{k}", digest(b"x" * k), k, b"x" * k) for k in range(1, 9)]).repartition(4)
    with pytest.raises(Exception):
        blobs.copy_verified(rows.mapInArrow(dies, rows.schema), f"{tmp_path}/to")
    assert tree(tmp_path) == []
    blobs.copy_verified(rows, f"{tmp_path}/to")
    assert tree(tmp_path / "to") == [f"f{k}" for k in range(1, 9)]


def test_plans_by_size():
    files = [("a", 40), ("b", 70), ("c", 500), ("d", 30), ("e", 90), ("f", 1)]
    assert fetch.planned(files, 100, 100) == [[("a", 40)], [("b", 70), ("c", 500), ("d", 30)], [("e", 90), ("f", 1)]]
    assert fetch.planned([], 1, 1) == [] and sum(map(len, fetch.planned([("x", 9)] * 25_000, 1, 1))) == 25_000


def test_fetch(spark, tmp_path, monkeypatch):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a").write_bytes(b"a" * 10)
    (tmp_path / "in/sub/b").write_bytes(b"b" * 11)
    (tmp_path / "in/empty").write_bytes(b"")
    (tmp_path / "out").write_bytes(b"secret")
    root = f"{tmp_path}/in"
    want = {f"{root}/a": (b"a" * 10, None), f"file:{root}/a": (b"a" * 10, None), f"FILE://{root}/empty": (b"", None), f"{root}/sub/b": (None, "larger than 10 bytes"), f"{root}/c": (None, "not found"), f"{root}/../out": (None, "relative path"),
            f"{tmp_path}/out": (None, "outside the allowed folders"), "s3://bucket/key": (None, "outside the allowed folders"), "http://127.0.0.1/": (None, "address not allowed"), "https://example.org/x": (None, "no network here"), "": (None, "empty address"),
            None: (None, "empty address"), "data:,abc": (b"abc", None), "data:image/png;base64,AAAA": (b"\0\0\0", None), "data:;base64,!": (None, "invalid data URI"), "data:,12345678901": (None, "larger than 10 bytes")}
    rows = spark.createDataFrame([(u, i, "p") for i, u in enumerate([*want, *want])], "url string, content long, path string").withColumnRenamed("content", "n")
    for listed in (fetch.LISTED, 1):  # as a list of paths, and by reading all
        monkeypatch.setattr(fetch, "LISTED", listed)
        out = fetch.fetch(rows, [root], file_bytes=10).collect()
        assert len(out) == 2 * len(want)
        assert {r.url: (bytes(r.content) if r.content is not None else None, r.error) for r in out} == want
    assert fetch.fetch(rows.where("false"), [root]).count() == 0
    (tmp_path / "none").mkdir()
    assert fetch.read_files(spark, [f"{tmp_path}/none"]).count() == 0


def test_files_of_the_tables_are_named_when_refused(spark):
    found = fetch.read_files(spark, ["/root/testdata/sf0.001"], file_bytes=100_000, task_bytes=150_000)
    sizes = {p: os.path.getsize(p) for p, _ in stores.files_below("/root/testdata/sf0.001")}
    assert {(r.path, r.length, r.error) for r in found.drop("content").collect()} == {(p, n, f"larger than 100000 bytes" if n > 100_000 else None) for p, n in sizes.items()}
    assert all(digest(bytes(r.content)) == blobs.file_digest(r.path) for r in found.where("error is null").collect())


def test_vector_files(spark, tmp_path):
    import numpy as np

    from millrace.sources import vectors

    rows = np.random.default_rng(1).normal(size=(500, 6)).astype(np.float32)
    frame = spark.createDataFrame([(v.tolist(), i) for i, v in enumerate(rows)], "embedding array<float>, vec_id long").repartition(3)
    vectors.write_vectors(frame, f"{tmp_path}/v", file_bytes=16 + 24 * 50)
    assert len(tree(tmp_path / "v")) >= 10 and all(os.path.getsize(tmp_path / "v" / f) <= 16 + 24 * 50 for f in tree(tmp_path / "v"))
    order = lambda rows: sorted(map(tuple, rows))
    for size in (64 << 20, 100):
        found = vectors.read_vectors(spark, f"{tmp_path}/v", size)
        assert order(r.vector for r in found.collect()) == order(rows.tolist())
    # a file is the form that the codec reads, in parts or whole, and its places are known
    (tmp_path / "one").write_bytes(vectors.serialize(rows.tolist()))
    one = vectors.read_vectors(spark, f"{tmp_path}/one", 1000)
    assert one.rdd.getNumPartitions() == 13 and [r.vector for r in one.orderBy("pos").collect()] == rows.tolist()
    some = one.where("pos >= 20 and pos < 25")
    assert [r.pos for r in some.orderBy("pos").collect()] == list(range(20, 25)) and " Filter (" not in some._jdf.queryExecution().executedPlan().toString()
    assert one.where("pos = 499").first().vector == rows[499].tolist() and one.where("path = 'x'").count() == 0 and one.where("pos > 499 or vector is null").count() == 0


@pytest.mark.parametrize("cut, why", [(4, "number of vectors"), (12, "dimension"), (30, "reading vectors")])
def test_truncated_vector_files(spark, tmp_path, cut, why):
    from millrace.sources import vectors

    (tmp_path / "bad").write_bytes(vectors.serialize([[1.0, 2.0], [3.0, 4.0]])[:cut])
    with pytest.raises(Exception, match=why):
        vectors.read_vectors(spark, f"{tmp_path}/bad").collect()


def test_odd_vectors(spark, tmp_path):
    from millrace.sources import vectors

    (tmp_path / "none").write_bytes(vectors.serialize([]))
    (tmp_path / "flat").write_bytes(vectors.serialize([[], []]))
    assert vectors.read_vectors(spark, f"{tmp_path}/none").count() == 0
    assert [r.vector for r in vectors.read_vectors(spark, f"{tmp_path}/flat").collect()] == [[], []]
    for bad in ([[1.0], None], [[1.0], [2.0, 3.0]], [[1.0, None]]):
        frame = spark.createDataFrame([(b,) for b in bad], "embedding array<float>").coalesce(1)
        with pytest.raises(Exception, match="nulls|lengths"):
            vectors.write_vectors(frame, f"{tmp_path}/w")
        assert tree(tmp_path) == ["flat", "none"]
    vectors.write_vectors(spark.createDataFrame([], "embedding array<float>"), f"{tmp_path}/w")
    assert tree(tmp_path) == ["flat", "none"]


def test_the_driver_looks_a_name_up_once(tmp_path, monkeypatch):
    copier, moved, compared = blobs._Copier(str(tmp_path)), {}, 0

    class Name(str):
        def __eq__(self, other):
            nonlocal compared
            compared += 1
            return str.__eq__(self, other)

        __hash__ = str.__hash__

    monkeypatch.setattr(copier.staging, "publish", moved.update)
    facts = [(Name(f"n{k % 500}"), "sha256:0", f"s{k}") for k in range(1000)]
    copier.commit([stores.Staged([], facts)])
    assert moved == {f"s{k}": f"n{k}" for k in range(500)} and compared < 10_000  # 375,000 where each name is compared with all


def test_a_task_begins_indexes_anew(tmp_path, monkeypatch):
    monkeypatch.setattr(index, "INDEX_BYTES", 1000)
    writer = index._Writer(str(tmp_path))
    entries = [(f"m{k}", *[None] * 3, "x" * 5 * k, *[None] * 4) for k in range(100)]
    writer.commit([writer.write(iter(entries)), writer.write(iter([]))])
    files = [(tmp_path / f).read_bytes() for f in tree(tmp_path)]
    assert len(files) > 20 and max(map(len, files)) < 1100
    assert sorted(row[0] for f in files for row in index.read_index(f)[0]) == sorted(e[0] for e in entries)
