"""Toxicity by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w.x - t_k): one weight vector w for all thresholds
t_0 <= t_1 <= ... . Features are the presence of words and of five-letter word
beginnings that the training sample ties to toxicity. Grades are 0 for documents
labelled clean; documents labelled toxic get 1 to GRADES - 1 by how many marked
words they hold. Fitted on the driver on a bounded sample, applied to whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import resident, written

#: Bound of the training sample: labelled documents (chosen by a hash of the id), with all their features.
SAMPLE_DOCS = 6_000
#: Features kept, the toxic documents of the sample that must hold one, how much likelier they
#: hold it, and by how much the log-likelihood ratio must exceed that of the best of so many
#: chance words (twice the logarithm of their number).
FEATURES, LEAST_DOCS, LEAST_RATIO, MARGIN = 4_000, 4, 4.0, 4.0
#: Severity grades, and the least number of marked words for each grade from 2 on.
GRADES, STEPS = 4, (3, 6)
#: Strength of the quadratic penalty on weights.
PENALTY = 0.02
#: Length of word beginnings.
STEM = 5

WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, rows: list[list[int]]) -> np.ndarray:
        """[documents, grades - 1] probabilities of more than each grade."""
        z = np.array([self.weights[r].sum() for r in rows])
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None], -500, 500)))


def text_features(text: str) -> set[str]:
    """Lower-case words, and the beginnings of longer ones (with a mark)."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM} | {w + "*" for w in words if len(w) == STEM}


def signature(text: str) -> list[int]:
    """Three least hashes of five-word shingles: near copies share one with high odds."""
    words = text.lower().split()
    hashes = np.array([crc32(" ".join(words[i : i + 5]).encode("utf-8", "replace")) for i in range(max(1, len(words) - 4))], np.uint64)
    return [int((hashes * np.uint64(a) % np.uint64(4294967291)).min()) for a in (1, 2654435761, 40503)]


def without_copies(rows: list[tuple[np.ndarray, int, list[int]]]) -> list[tuple[np.ndarray, int]]:
    """The sample without near copies of earlier rows, whose words would pass for marks."""
    seen, out = set(), []
    for features, label, marks in rows:
        keys = {(k, m) for k, m in enumerate(marks)}
        if not keys & seen:
            out.append((features, label))
        seen |= keys
    return out


def log_ratio(a: np.ndarray, b: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """G statistics of features in a of ``toxic`` and b of ``clean`` documents."""
    total, n = np.zeros(len(a)), toxic + clean
    for x, y, size in ((a, b, toxic), (b, a, clean), (toxic - a, clean - b, toxic), (clean - b, toxic - a, clean)):
        with np.errstate(divide="ignore", invalid="ignore"):
            total += np.where(x > 0, 2 * x * np.log(x * n / ((x + y) * size)), 0.0)
    return total


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, size: int, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated gradient steps on the penalised likelihood."""
    levels = int(grades.max())
    index = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.fromiter((c for r in rows for c in r), np.int64, len(index))
    above = (grades[:, None] > np.arange(levels)[None]).astype(float)  # stacked binary targets share w
    w = np.zeros(size)
    share = np.clip(above.mean(0), 1e-3, 1 - 1e-3)
    t = -np.log(share / (1 - share))
    first, second = np.zeros(size + levels), np.zeros(size + levels)
    for step in range(1, steps + 1):
        z = np.bincount(index, w[cols], len(rows))
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - t[None], -500, 500)))
        d = (p - above) / len(rows)
        grad = np.concatenate([np.bincount(cols, d.sum(1)[index], size) + PENALTY / len(rows) * w * levels, -d.sum(0)])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w -= move[:size]
        t = np.maximum.accumulate(t - move[size:])
    return w, t


def chosen_features(sample: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, whether no clean document holds it) of the features that mark toxic
    documents, the most telling ones first; empty unless both labels occur."""
    none = np.zeros(0, np.int64), np.zeros(0, bool)
    toxic, clean = ([x for x, label in sample if bool(label) == side] for side in (True, False))
    if not toxic or not clean:
        return none
    ids, a = np.unique(np.concatenate(toxic), return_counts=True)
    least = 2 * np.log(len(ids)) + MARGIN
    ids, a = ids[a >= LEAST_DOCS], a[a >= LEAST_DOCS]
    if not len(ids):
        return none
    b = np.zeros(len(ids), np.int64)
    for x in clean:  # sorted hashes
        at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
        np.add.at(b, at[ids[at] == x], 1)
    ratio = (a + 0.5) / (len(toxic) + 1) / ((b + 0.5) / (len(clean) + 1))
    good = (ratio >= LEAST_RATIO) & (log_ratio(a, b, len(toxic), len(clean)) >= least)
    order = np.lexsort((ids[good], -(a * np.log(ratio))[good]))[:FEATURES]
    return ids[good][order], (b == 0)[good][order]


def train(sample: list[tuple[np.ndarray, int]], names: dict[int, str]) -> Model | None:
    """A model of (feature hashes, toxic 0 or 1) pairs; ``names`` has the chosen features'
    texts by hash. None without any that tells the labels apart."""
    ids, pure = chosen_features(sample)
    features = {names[i]: k for k, i in enumerate(sorted(i for i in ids.tolist() if i in names))}
    if not features:
        return None
    place = {i: features[names[i]] for i in ids.tolist() if i in names}
    rows = [sorted(place[i] for i in np.intersect1d(x, ids).tolist() if i in place) for x, _ in sample]
    strong = {place[i] for i, p in zip(ids.tolist(), pure) if p and i in place and not names[i].endswith("*")}
    grades = np.array([(1 + sum(len(strong.intersection(r)) >= s for s in STEPS[: GRADES - 2])) * bool(label) for r, (_, label) in zip(rows, sample)])
    weights, thresholds = fit_ordinal(rows, grades, len(features))
    return Model(features, weights, thresholds)


def feature_hash(feature: str) -> int:
    return crc32(feature.encode("utf-8", "replace"))


def _featured(batches: Iterator):
    resident(None, None)  # what an earlier stage's worker holds
    for batch in batches:
        texts = [x.as_py() or "" for x in batch.column(1)]
        found = [np.unique(np.array([feature_hash(f) for f in text_features(x)], np.int64)) for x in texts]
        marks = [signature(x) for x in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.list_(pa.int64())), batch.column(2), pa.array(marks, pa.list_(pa.int64()))], names=["id", "f", "toxic", "marks"])


def _named(sent):
    def work(batches: Iterator):
        wanted = set(sent.value)
        for batch in batches:
            names = {f for x in batch.column(0) for f in text_features(x.as_py() or "") if feature_hash(f) in wanted}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(names), pa.string())], names=["f"])

    return work


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model from at most SAMPLE_DOCS labelled documents, half of them toxic where
    there are as many. Null labels are left out; documents labelled twice, and ids
    that repeat, count each time. The driver sees hashes of the sample's features and
    the texts of the chosen ones."""
    marked = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) != 0).alias("toxic"))
    order = F.xxhash64(F.lit("toxicity"), F.col("id"))
    chosen = [marked.where(side).orderBy(order, "id").limit(SAMPLE_DOCS // 2) for side in ("toxic", "not toxic")]
    chosen = chosen[0].unionByName(chosen[1])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # bounded by SAMPLE_DOCS
    texts = written(texts.select(F.col("id").cast("string"), "text", "toxic"), "labelled")
    got = texts.mapInArrow(_featured, "id string, f array<long>, toxic boolean, marks array<long>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["id"][i].as_py() or "", got["toxic"][i].as_py()))
    rows = [(np.array(got["f"][i].values), int(got["toxic"][i].as_py()), got["marks"][i].as_py()) for i in order]
    del got
    sample = without_copies(rows)
    ids, _ = chosen_features(sample)
    if not len(ids):
        return None
    sent = docs.sparkSession.sparkContext.broadcast(ids.tolist())
    found = texts.select("text").mapInArrow(_named(sent), "f string").distinct().collect()
    names: dict[int, str] = {}
    for (f,) in sorted(found):
        names.setdefault(feature_hash(f), f)
    return train(sample, names)


def _grader(spark, model: Model | None):
    """A function from an Arrow column of texts to [texts, grades - 1] probabilities of more than each grade."""
    sent = spark.sparkContext.broadcast(model)  # bounded by FEATURES

    def above(column) -> np.ndarray:
        m = sent.value
        if m is None:
            return np.zeros((len(column), 1))
        look = m.features.get
        return m.above([[i for f in text_features(x.as_py() or "") if (i := look(f)) is not None] for x in column])

    return above


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that grade() does not find toxic, all columns as they were. Null and empty
    texts are not toxic, repeated rows are judged each, without a model all stay."""
    above = _grader(docs.sparkSession, model)

    @F.arrow_udf("boolean")
    def clean(column: pa.Array) -> pa.Array:
        resident(None, None)  # what an earlier stage's worker holds
        return pa.array(above(column)[:, 0] < 0.5)

    return docs.where(clean(F.col(text_col)))


def grade(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toxic, grade, severity, p_toxic) of every row.

    severity is the expected grade, the sum of P(grade > k); grade the number of
    thresholds passed with a probability of a half or more; toxic means grade >= 1.
    Null and empty texts have no features. Without a model all is 0 and not toxic.
    Repeated rows are graded each."""
    above = _grader(docs.sparkSession, model)

    def work(batches: Iterator):
        for batch in batches:
            p = above(batch.column(1))
            grades = (p >= 0.5).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(grades > 0), pa.array(grades.astype(np.int32)), pa.array(p.sum(1)), pa.array(p[:, 0])],
                names=["id", "toxic", "grade", "severity", "p_toxic"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, toxic boolean, grade int, severity double, p_toxic double"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)
