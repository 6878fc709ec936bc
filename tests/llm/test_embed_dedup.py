"""Embedding near-duplicates against all pairs."""

import numpy as np
import pytest

from millrace.llm import embed_dedup


@pytest.mark.parametrize("sizes", [(256, 4096), (8, 40)])
def test_all_pairs(spark, monkeypatch, sizes):
    monkeypatch.setattr(embed_dedup, "BLOCK", sizes[0])
    monkeypatch.setattr(embed_dedup, "INTERVAL", sizes[1])
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(60):
        base = rng.normal(size=8)
        vectors += [(base + rng.normal(size=8) * s).tolist() for s in rng.choice([0, 0.05, 0.12, 0.2, 0.5], 5)]
    vectors += [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1e-300] * 8, [1e300] * 8, [1.0, 2.0], [2.0, 4.0], [-0.0] * 8]
    vectors += vectors[:3] * 4
    rows = [(2 * i, v, "x") for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")
    out = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    good = {i: np.array(v) / np.abs(v).max() for i, v, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    good = {i: v / np.sqrt(v @ v) for i, v in good.items()}
    linked = {i: [j for j in good if i != j and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.95] for i in good}
    label = {i: i for i, _, _ in rows}
    for _ in range(len(rows)):
        after = {i: min([label[i]] + [label[j] for j in linked.get(i, [])]) for i in label}
        if after == label:
            break
        label = after
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in out.items()} == {i: (len(linked.get(i, [])), label[i], label[i] == i) for i in label}


def test_small(spark):
    df = spark.createDataFrame([(5, [1.0, 2.0]), (5, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0
    assert [tuple(r) for r in embed_dedup.near_duplicates(df).collect()] == [(5, 1, 5, True)] * 2


def test_rows_without_id(spark):
    """Null ids link and count but name nothing; a component of null ids alone has none."""
    a, b, c = [1.0, 0.0, 0.01], [1.0, 0.02, 0.0], [0.0, 1.0, 0.0]
    rows = [(None, a), (7, b), (5, b), (None, c), (None, c), (None, None), (9, [0.0, 0.0, 0.0]), (None, [0.0, 0.0, 3.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, part string")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    out = sorted(map(key, embed_dedup.near_duplicates(df).collect()))
    assert out == sorted(map(key, [(None, 2, 5, False), (7, 2, 5, False), (5, 2, 5, True), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (9, 0, 9, True), (None, 0, None, True)]))


def test_many_intervals(spark, monkeypatch):
    """Floats and doubles, several lengths, structure in the leading dimensions: links are those of all pairs."""
    import numpy as np

    monkeypatch.setattr(embed_dedup, "INTERVAL", 60)
    monkeypatch.setattr(embed_dedup, "INTERVAL_BYTES", 4000)
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16)) * 2
    vecs = [centres[k % 6] + rng.normal(size=16) * 0.35 for k in range(400)]
    vecs = [v.astype(np.float32).astype(float) if k % 2 else v for k, v in enumerate(vecs)] + [rng.normal(size=5) for _ in range(20)]
    rows = [(k, v.tolist()) for k, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    unit = [v / np.linalg.norm(v) for v in vecs]
    links = {i: [j for j in range(len(unit)) if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(len(unit))}
    assert 500 < sum(map(len, links.values()))
    label = {}
    for i in range(len(unit)):
        stack = [i]
        while stack:
            if (x := stack.pop()) not in label:
                label[x] = i
                stack += links[x]
    assert out == {i: (len(links[i]), label[i]) for i in links}
