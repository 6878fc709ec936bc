"""Repeated passages against all strings of 50 bytes."""

import hashlib
import random

import pytest

from millrace.llm import suffix_dedup


def plain(rows):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - 49):
            first[raw[s : s + 50]] = min(i, first.get(raw[s : s + 50], i))
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - 49):
            if first[raw[s : s + 50]] < i:
                gone[s : s + 50] = [True] * 50
        left = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("sizes", [{}, {"TOGETHER": 3000, "ANCHOR_BYTES": 20_000, "RUN_BYTES": 10_000, "BATCH": 500}, {"FREQUENT": 3, "TOGETHER": 4000, "RUN": 7}])
def test_all_strings(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(suffix_dedup, name, value)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéß\x00") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (8, 9, 10, 12, 20, 60)]
    texts = [None, "", "a" * 49, "a" * 50, "a" * 400, "ab" * 100, "a" * 120, "x" + "a" * 60]
    for _ in range(150):
        t = prose(rng.randint(1, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            t = t[: len(t) // 2] + rng.choice(["", " "]) + p[cut:] + t[len(t) // 2 :]
        texts.append(t)
    texts += texts[20:40]
    rng.shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, packed string").repartition(5)
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_digests(df).collect()}
    assert out == plain(rows)


def test_small(spark):
    df = spark.createDataFrame([(1, "b" * 60), (1, "b" * 60), (2, "b" * 60), (None, "b" * 60)], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect())
    assert out == [(0, 0, b"b" * 60), (1, 0, b"b" * 60), (1, 0, b"b" * 60), (2, 60, b"")]
    assert suffix_dedup.removal_digests(df.where("false")).count() == 0


def test_texts_that_share_an_id(spark):
    """Each text is judged by the smaller ids; spans of one are not laid over another."""
    rows = [(1, "x" * 60), (2, "x" * 60 + "tail one"), (2, "y" * 80), (2, "y" * 80), (3, "y" * 55 + "z"), (None, "x" * 60)]
    names = "id long, text string, spans string, c0 string"
    df = spark.createDataFrame([(*r, "s", "c") for r in rows], names).repartition(3)
    out = sorted((r.id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df, "id").collect())
    assert out == [(0, 60, 0), (1, 60, 0), (2, 68, 60), (2, 80, 0), (2, 80, 0), (3, 56, 55)]
    kept = suffix_dedup.without_repeats(df, "id")
    assert kept.columns == df.columns
    assert sorted((r.id or 0, r.text, r.spans, r.c0) for r in kept.collect()) == sorted(
        (i or 0, t, "s", "c") for i, t in [(None, "x" * 60), (1, "x" * 60), (2, "tail one"), (2, "y" * 80), (2, "y" * 80), (3, "z")])


def test_levels_in_process(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "BATCH", 64)
    rng = random.Random(2)
    passages = ["".join(rng.choice("abc") for _ in range(70)) for _ in range(9)]
    rows = [(i, "".join(rng.choice([rng.choice(passages), rng.choice("xyz") * 3]) for _ in range(4))) for i in range(60)]
    sent = type("Sent", (), {"value": np.zeros(0, np.uint64)})
    anchor, text, start, strings = suffix_dedup.runs([t.encode() for _, t in rows])
    # the keys are the ids here
    packs = {i: [p[3]] for p in suffix_dedup._by_doc(text, start, strings, anchor, 1) for i in [p[1]]}
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t]), pa.array([packs[i]], pa.list_(pa.binary())), pa.array([i])], names=["id", "text", "runs", "key"]) for i, t in rows if i in packs]
    random.Random(1).shuffle(batches)
    sent_on = [b for x in batches for b in suffix_dedup._strings(1, sent)([x])]
    spans = {}
    for batch in suffix_dedup._gathered(["<u8"])(suffix_dedup._judged(iter(sent_on), 3)):
        for i, packed in zip(*(c.to_pylist() for c in batch.columns)):
            spans.setdefault(i, []).append(packed)
    want = plain(rows)
    for i, t in rows:
        left, n, count = suffix_dedup.kept_bytes(t.encode(), spans.get(i))
        assert (n, count, hashlib.sha256(left).hexdigest()) == want[i][1:]


def test_family_merges():
    import numpy as np

    family, seen = suffix_dedup.IndexFamily(), {}
    rng = np.random.default_rng(0)
    for batch in range(20):
        ids = np.sort(rng.integers(batch * 5, batch * 5 + 5, 40))
        keys = np.array([b"%050d" % k for k in rng.integers(0, 300, 40)], "S50")
        for i, k in zip(ids, keys):
            seen[k] = min(i, seen.get(k, i))
        assert family.add(keys, ids).tolist() == [seen[k] < i for i, k in zip(ids, keys)]
    assert len(family.levels) < 8
