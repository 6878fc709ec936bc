"""SimHash against plain counting, all pairs and a plain union."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm import _shared, simhash
from millrace.llm._shared import connected_components


def plain(text):
    words = (text or "").encode().lower().split()
    h = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def union(n, pairs):
    label = {x: x for x in n}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_fingerprints():
    for text in ["", "one", "one two", "A b\tC\x0bd e", "x " * 2000, "é È ß   nbsp", "the quick brown fox " * 3]:
        assert simhash.fingerprint(text) == plain(text)


def test_components(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "  ", "one", "one"]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 150))]
        texts.append(" ".join(base))
        for _ in range(3):
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(" ".join(other))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    out = {r.doc_id: r for r in simhash.components(docs).collect()}
    fps = {i: plain(t) for i, t in enumerate(texts)}
    pairs = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2]
    label = union(fps, pairs)
    assert {i: (r.fingerprint, r.component_id) for i, r in out.items()} == {i: (f"{fps[i]:016x}", label[i]) for i in fps}
    assert simhash.components(docs.where("false")).count() == 0


def test_anchors_meet_all_pairs(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps |= {x, x ^ 1 << rng.randrange(64), x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)}
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(x), i) for i, x in enumerate(fps)], "fp long, rep long")
    found = {(r.node, r.component) for r in connected_components(simhash.links_within_two(rows), "v", "u").collect()}
    label = union(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2])
    assert found == {(a, m) for a, m in label.items() if list(label.values()).count(m) > 1}


def test_anchors_of_a_small_table_are_not_broadcast(spark, tmp_path):
    """Spark sizes the anchors like the rows that they come from."""
    path = str(tmp_path / "groups")
    spark.range(0, 1000, 1, 4).select(F.xxhash64("id").alias("fp"), F.col("id").alias("rep")).write.parquet(path)
    plan = simhash.links_within_two(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("at_once", [1 << 19, 0])
def test_connected_components_long_chain(spark, monkeypatch, at_once):
    monkeypatch.setattr(_shared, "LINKS_AT_ONCE", at_once)
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])) + [(1000, 1001), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in connected_components(links).collect()}
    assert found == {**{i: 0 for i in range(200)}, 1000: 1000, 1001: 1000}
    assert connected_components(links.where("false")).count() == 0


def test_components_of_one_task_are_those_of_rounds():
    import pyarrow as pa

    rng = random.Random(6)
    for n, m in ((1, 1), (50, 30), (300, 200), (2000, 1900)):
        pairs = [(rng.randrange(-n, n) * 7, rng.randrange(-n, n) * 7) for _ in range(m)]
        batches = [pa.RecordBatch.from_pydict({"v": [p[0] for p in pairs[k : k + 100]], "u": [p[1] for p in pairs[k : k + 100]]}, pa.schema([("v", pa.int64()), ("u", pa.int64())])) for k in range(0, m, 100)]
        got = {a: b for x in _shared._forest(iter(batches)) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
        assert got == union(sorted({i for p in pairs for i in p}), pairs)
    assert list(_shared._forest(iter([]))) == []


def test_near_duplicates(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    texts, family = ["", None], [-1, -1]
    for k in range(60):
        base = [rng.choice(vocabulary) for _ in range(200)]
        for edits in (0, 0, 1, 2, 3):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(200)] = rng.choice(vocabulary)
            texts.append(" ".join(other))
            family.append(k)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.group_id for r in simhash.near_duplicates(docs).collect()}
    firsts = {}
    for i, k in enumerate(family):
        firsts.setdefault(k, i)
    assert sum(out[i] == firsts[k] for i, k in enumerate(family)) >= 0.98 * len(texts)
    assert len({out[i] for i in out}) >= len(firsts)
    assert np.all(simhash.wide_fingerprint("a b c d e f", 5)[0] == 2)


def shingles(text, words=5):
    found = text.lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("members, paired", [(4096, 16), (200, 16), (200, 2)])
def test_near_copies_in_a_template_family(spark, monkeypatch, members, paired):
    """Texts that share most of a template are apart; a near copy of each is found among them, as one
    family, in pairs of its blocks, and by anchors."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(20000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    template, texts = draw(160), []
    for _ in range(600):
        base = template + draw(44)
        texts += [" ".join(base), " ".join(draw(17) + base[17:])]
    sets = [shingles(t) for t in texts]
    assert max(jaccard(sets[0], s) for s in sets[2:]) < 0.65
    assert min(jaccard(sets[i], sets[i + 1]) for i in range(0, len(sets), 2)) > 0.84
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.group_id for r in simhash.near_duplicates(docs).collect()}
    assert sum(out[i] == out[i + 1] for i in range(0, len(texts), 2)) >= 0.93 * len(texts) / 2
    assert len(set(out.values())) >= len(texts) / 2


def test_links_are_those_of_the_shingle_sets(spark):
    """Short and long pairs at and just below the bound, against their shingles."""
    rng = random.Random(8)
    draw = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n in (8, 9, 10, 19, 24, 49, 104, 204):
        for keep in (0.74, 0.76, 0.78, 0.8, 0.8, 0.8, 0.82):
            for _ in range(6):
                base, shingle_count = draw(n), n - 4
                new = min(shingle_count, round(shingle_count * (1 - keep)))
                texts += [" ".join(base), " ".join(base[: n - new])]  # a Jaccard of (shingles - new) / shingles
    sets = [shingles(t) for t in texts]
    near = [jaccard(sets[i], sets[i + 1]) >= 0.8 for i in range(0, len(texts), 2)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r.group_id for r in simhash.near_duplicates(docs).collect()}
    got = [out[i] == out[i + 1] for i in range(0, len(texts), 2)]
    assert not any(g and not w for g, w in zip(got, near))
    assert sum(g and w for g, w in zip(got, near)) >= 0.98 * sum(near)
