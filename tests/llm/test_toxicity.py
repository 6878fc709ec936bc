"""Ordinal regression and grading on planted words."""

import random

import numpy as np

from millrace.llm import toxicity


def test_fit_ordinal_orders_thresholds():
    rng = np.random.default_rng(0)
    rows = [sorted(set(rng.integers(0, 6, rng.integers(0, 5)).tolist())) for _ in range(800)]
    weight = np.array([2.0, 2.0, 2.0, 0, 0, 0])
    grades = np.array([int(weight[r].sum() > 1) + int(weight[r].sum() > 3) for r in rows])
    w, t = toxicity.fit_ordinal(rows, grades, 6)
    assert t[0] <= t[1] and w[:3].min() > w[3:].max() + 1
    p = toxicity.Model({}, w, t).above(rows)
    assert (np.diff(p, axis=1) <= 1e-12).all()
    assert ((p >= 0.5).sum(1) == grades).mean() > 0.95


def test_log_ratio():
    a, b = np.array([30, 5]), np.array([0, 5])
    g = toxicity.log_ratio(a, b, 100, 100)
    assert g[0] > 28 and abs(g[1]) < 1e-9


def corpus(n=1200):
    rng = random.Random(2)
    words = ["w%s" % "".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    bad = ["vilea", "vileb", "vilec"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(8, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 8)):
                text.insert(rng.randrange(len(text)), rng.choice(bad).title())
        rows.append((i, " ".join(text) + ".", "x"))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(toxic)))
    return rows, labels


def test_grade(spark):
    rows, labels = corpus()
    rows += [(5000, None, "x"), (5001, "", "x"), (5002, "vilea " * 30000, "x"), (5002, "vilea " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (9, None)], "doc_id long, toxic int"))
    out = toxicity.grade(docs, model).collect()
    assert len(out) == len(rows)
    wrong = [r for r in out if r.doc_id < 5000 and r.toxic != (r.doc_id % 5 == 0)]
    assert len(wrong) <= 12 and all(0 <= r.severity <= toxicity.GRADES - 1 for r in out)
    last = {r.doc_id: r.toxic for r in out if r.doc_id >= 5000}
    assert last == {5000: False, 5001: False, 5002: True}
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in out)


def test_without_labels(spark):
    docs = spark.createDataFrame(corpus(20)[0], "doc_id long, text string, x string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert toxicity.grade(docs, None).where("toxic").count() == 0
    assert toxicity.grade(docs.where("false"), None).count() == 0


def test_the_fit_is_the_least_loss():
    """Weights and thresholds against the penalised likelihood written out, by its slopes and by plain descent."""
    import numpy as np

    rng = np.random.default_rng(3)
    size, levels = 5, 3
    rows = [sorted(rng.choice(size, rng.integers(0, 4), replace=False).tolist()) for _ in range(120)]
    truth = np.array([2.0, 1.0, -1.0, 0.5, 0.0])
    grades = np.array([sum(truth[r].sum() + rng.logistic() > t for t in (0.0, 1.0, 2.5)) for r in rows])

    def loss(x):
        w, t = x[:size], x[size:]
        total = 0.0
        for r, g in zip(rows, grades):
            for k in range(levels):
                z = w[r].sum() - t[k]
                total += np.log1p(np.exp(-z)) if g > k else np.log1p(np.exp(z))
        return (total + toxicity.PENALTY * levels / 2 * (w @ w)) / len(rows)

    w, t = toxicity.fit_ordinal(rows, grades, size, steps=1500)
    x = np.concatenate([w, t])
    slope = np.array([(loss(x + e) - loss(x - e)) / 2e-4 for e in np.eye(len(x)) * 1e-4])
    assert np.abs(slope).max() < 5e-3 and (np.diff(t) >= 0).all()
    best = x.copy()
    for _ in range(60):
        best -= 2.0 * np.array([(loss(best + e) - loss(best - e)) / 2e-4 for e in np.eye(len(x)) * 1e-4])
    assert loss(x) <= loss(best) + 1e-4


def test_held_out_documents(spark):
    """Fitted on two thirds of the labelled documents of the small tables, judged on the others."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.fit(docs, labels.where(~third))
    judged = toxicity.grade(docs, model).join(labels.where(third & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").alias("label")), "doc_id")
    n = {(r.label, r.toxic): r["count"] for r in judged.groupBy("label", "toxic").count().collect()}
    print("held out", n)
    assert n.get((0, True), 0) <= 0.01 * (n[0, False] + n.get((0, True), 0)) and n[1, True] >= 0.8 * (n[1, True] + n.get((1, False), 0))
