"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to three bytes long counts the bytes
that follow. A byte seen after its longest known context costs its share there;
otherwise an escape (method C, without exclusions) is paid and the next shorter
context is asked, down to equal shares of all 256 bytes. With frozen statistics
that cost depends on the last four bytes only, so that the code length of a text
is a sum of table entries. The language with the shortest code wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import resident

#: Bound of the training sample: about so many documents of each language, chosen by a hash
#: of the id, as long as their whole texts fit into a language's share of so many bytes (one
#: text of a language is learned from in any case). Every language is learned.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 32 << 20
#: Bytes scored at once.
BLOCK = 1 << 20
#: Texts of a language, of at least so many bytes, whose rates tell how high rates can be, and
#: how far beyond the highest one they may go; bits that any text may cost beyond, as much as a key or a name of forty letters does.
BOUND_TEXTS, BOUND_BYTES, RATE_SPREAD, SPARE_BITS = 8, 100, 2.5, 256


@dataclass
class Model:
    """Frozen statistics: costs in bits by language for contexts of 1, 2 and 3 bytes."""

    langs: list[str]
    cost1: np.ndarray  # [65536, L] byte after one byte
    keys2: np.ndarray  # three bytes, sorted
    cost2: np.ndarray  # [len(keys2), L]
    escape2: np.ndarray  # [65536, L] added where a two-byte context is known but not the byte
    keys3: np.ndarray  # four bytes, sorted
    cost3: np.ndarray
    escape3: np.ndarray  # [len(keys2), L] by the three bytes of the context


def train(texts: dict[str, list[str]]) -> Model:
    """Statistics of texts by language; every count is kept."""
    langs = sorted(texts)
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in langs:
        raw = b"".join(b"\n\n\n" + t.encode("utf-8", "replace") for t in texts[lang]) + b"\n"
        x = np.frombuffer(raw, np.uint8).astype(np.uint32)
        per = []
        for k in range(4):
            key = np.zeros(len(x) - 3, np.uint32)
            for j in range(k + 1):
                key = key << np.uint32(8) | x[3 - k + j : len(x) - k + j]
            per.append(np.unique(key, return_counts=True))
        grams.append(per)
    size = len(langs)

    def level(k: int, lang: int, keys: np.ndarray):
        """For byte keys of k context bytes: share and escape in bits, NaN where unseen."""
        own, n = grams[lang][k]
        context = own >> np.uint32(8)
        heads, where, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(where, n, len(heads))
        bits = -np.log2(n / (total + kinds)[where])
        escape = -np.log2(kinds / (total + kinds))
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return np.where(own[at] == keys, bits[at], np.nan), heads, escape

    def known(heads, escape, contexts):
        at = np.minimum(np.searchsorted(heads, contexts), len(heads) - 1)
        return np.where(heads[at] == contexts, escape[at], 0.0)

    pairs = np.arange(65536, dtype=np.uint32)
    cost1, escape2 = np.zeros((65536, size), np.float32), np.zeros((65536, size), np.float32)
    keys2 = np.unique(np.concatenate([g[2][0] for g in grams]))
    keys3 = np.unique(np.concatenate([g[3][0] for g in grams]))
    cost2, cost3 = np.zeros((len(keys2), size), np.float32), np.zeros((len(keys3), size), np.float32)
    escape3 = np.zeros((len(keys2), size), np.float32)
    for lang in range(size):
        bits0, _, escape0 = level(0, lang, np.arange(256, dtype=np.uint32))
        cost0 = np.where(np.isnan(bits0), escape0[0] + 8.0, bits0)
        bits, heads, escape = level(1, lang, pairs)
        below = known(heads, escape, pairs >> np.uint32(8)) + cost0[pairs & 255]
        cost1[:, lang] = np.where(np.isnan(bits), below, bits)
        bits, heads, escape = level(2, lang, keys2)
        escape2[:, lang] = known(heads, escape, pairs)
        below = escape2[keys2 >> np.uint32(8), lang] + cost1[keys2 & np.uint32(65535), lang]
        cost2[:, lang] = np.where(np.isnan(bits), below, bits)
        bits, heads, escape = level(3, lang, keys3)
        escape3[:, lang] = known(heads, escape, keys2)
        low = np.searchsorted(keys2, keys3 & np.uint32(0xFFFFFF))
        below = known(heads, escape, keys3 >> np.uint32(8)) + cost2[low, lang]
        cost3[:, lang] = np.where(np.isnan(bits), below, bits)
    return Model(langs, cost1, keys2, cost2, escape2, keys3, cost3, escape3)


class Scorer:
    """A model with its lookup tables laid out (about 130 MB) for one worker."""

    def __init__(self, model: Model):
        self.m = model
        self.at2 = np.full(1 << 24, -1, np.int32)
        self.at2[model.keys2] = np.arange(len(model.keys2), dtype=np.int32)
        # the four bytes of a key: its context's place among keys2, and the byte
        context = self.at2[model.keys3 >> np.uint32(8)]
        used = np.unique(context)
        self.row = np.full(len(model.keys2) + 1, -1, np.int32)  # the last for unknown contexts
        self.row[used] = np.arange(len(used), dtype=np.int32)
        self.at3 = np.full((len(used) + 1, 256), -1, np.int32)
        self.at3[self.row[context], model.keys3 & np.uint32(255)] = np.arange(len(model.keys3), dtype=np.int32)

    def bits(self, x: np.ndarray) -> np.ndarray:
        """[len(x) - 3, L] code lengths of the bytes after the first three."""
        m = self.m
        x = x.astype(np.uint32)
        two = x[1:-1] << np.uint32(8) | x[2:]
        three = x[:-2] << np.uint32(16) | two
        place = self.at2[three]
        head, tail = place[:-1], place[1:]
        found = self.at3[self.row[head], x[3:]]
        out = m.cost3[found]
        miss = np.flatnonzero(found < 0)
        if len(miss):
            h, t = head[miss], tail[miss]
            cost = np.where((t >= 0)[:, None], m.cost2[t], m.cost1[x[3:][miss] | x[2:-1][miss] << np.uint32(8)])
            lacking = np.flatnonzero(t < 0)
            context2 = x[1:-2][miss] << np.uint32(8) | x[2:-1][miss]
            cost[lacking] += m.escape2[context2[lacking]]
            out[miss] = cost + np.where((h >= 0)[:, None], m.escape3[h], 0.0)
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """[texts, L] code lengths; texts are scored together in blocks of bytes."""
        out = np.zeros((len(texts), len(self.m.langs)))
        start = 0
        while start < len(texts):
            stop, size = start + 1, len(texts[start])
            while stop < len(texts) and size + len(texts[stop]) <= BLOCK:
                size += len(texts[stop])
                stop += 1
            if size <= BLOCK:
                x = np.frombuffer(b"".join(b"\n\n\n" + t for t in texts[start:stop]), np.uint8)
                bits = np.vstack([self.bits(x), np.zeros((3, out.shape[1]), np.float32)])
                lengths = np.array([len(t) for t in texts[start:stop]])
                begins = np.concatenate([[0], np.cumsum(lengths + 3)[:-1]])
                ends = begins + lengths
                marks = np.stack([begins, ends], 1).ravel()
                out[start:stop] = np.add.reduceat(bits, marks, axis=0, dtype=np.float64)[::2] * (lengths > 0)[:, None]
            else:  # one long text
                raw = b"\n\n\n" + texts[start]
                for k in range(0, len(raw) - 3, BLOCK):
                    out[start] += self.bits(np.frombuffer(raw[k : k + BLOCK + 3], np.uint8)).sum(0, dtype=np.float64)
            start = stop
        return out


def sample(docs: DataFrame, learned: Column, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """The bounded training sample: at most about SAMPLE_DOCS whole texts of each language.

    Texts are taken in order of a hash of the id while a language's share of SAMPLE_BYTES
    lasts; texts longer than the whole share are passed over (the shortest is taken where
    there are no others). Repeated rows count once."""
    rows = docs.where(learned & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(lang_col).count().collect()  # a row a language
    if not counts:
        return {}
    span = 1 << 30
    mark = F.xxhash64(F.lit("sample"), F.col(id_col))
    share = F.create_map(*[v for r in counts for v in (F.lit(r[0]), F.lit(min(span, -(-span * SAMPLE_DOCS // r[1]))))])
    own = max(1, SAMPLE_BYTES // len(counts))
    size = F.octet_length(text_col).cast("long")
    # which rows: ids, sizes and digests alone are sorted; then their texts are read
    chosen = rows.where(F.pmod(mark, F.lit(span)) < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), mark.alias("mark"), F.xxhash64(text_col).alias("digest"), size.alias("size"))
    order = Window.partitionBy("lang").orderBy("mark", "digest")
    fits = F.sum(F.when(F.col("size") <= own, F.col("size")).otherwise(0)).over(order) <= own
    ranked = chosen.withColumns({"fits": fits & (F.col("size") <= own), "rank": F.row_number().over(order)})
    least = Window.partitionBy("lang")
    kept = ranked.withColumn("any", F.max("fits").over(least)).withColumn("shortest", F.min(F.struct("size", "rank")).over(least)["rank"])
    kept = kept.where((F.col("rank") <= 2 * SAMPLE_DOCS) & (F.col("fits") | (~F.col("any") & (F.col("rank") == F.col("shortest")))))
    wanted = {(lang, m, d): k for lang, m, d, k in kept.select("lang", "mark", "digest", "rank").collect()}
    keys = docs.sparkSession.createDataFrame(list(wanted), "lang string, mark long, digest long") if wanted else None
    if keys is None:
        return {}
    found = rows.select(F.col(lang_col).alias("lang"), mark.alias("mark"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    found = found.join(F.broadcast(keys), ["lang", "mark", "digest"], "left_semi").dropDuplicates(["lang", "mark", "digest"])  # bounded by the sample
    texts: dict[str, list[str]] = {}
    for r in sorted(found.collect(), key=lambda r: wanted[r.lang, r.mark, r.digest]):
        texts.setdefault(r.lang, []).append(r.text)
    return texts


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the rows that are not held out and have a language; None without any."""
    texts = sample(docs, ~held_out(id_col), id_col, text_col, lang_col)
    return train(texts) if texts else None


def _predictor(spark, model: Model | None):
    """A function from an Arrow column of texts to (languages, scores, bits a byte)."""
    sent = spark.sparkContext.broadcast(model)  # bounded by the sample
    key = uuid.uuid4().hex

    def predict(column):
        import regex

        letter, m, n = regex.compile(r"\p{L}"), sent.value, len(column)
        scorer = resident(key, lambda: Scorer(m)) if m is not None else None
        langs, scores, rates, todo, where, size = ["und"] * n, [0.0] * n, [None] * n, [], [], 0

        def flush():
            if todo:
                for i, b, t in zip(where, scorer.totals(todo), todo):
                    best = int(b.argmin())
                    langs[i], scores[i] = m.langs[best], float(1 / np.exp2(np.maximum(b[best] - b, -1000)).sum())
                    rates[i] = float(b[best] / len(t))
                todo.clear()
                where.clear()

        for i, v in enumerate(column):
            t = v.as_py()
            if m is None or t is None or not letter.search(t):
                continue
            todo.append(t.encode("utf-8", "replace"))
            where.append(i)
            size += len(todo[-1])
            if size >= BLOCK:
                flush()
                size = 0
        flush()
        return langs, scores, rates

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(id, held_out, lang_pred, score, bits_per_byte) of every row.

    Learns from rows that are not held out and have a language. ``und`` (score 0)
    where the text is null or has no letter, or where no language could be
    learned; ties go to the first language by name; the score is the posterior
    under equal priors. Repeated rows and ids are predicted each; other columns
    play no part."""
    predict = _predictor(docs.sparkSession, model or learn(docs, id_col, text_col, lang_col))

    def work(batches: Iterator):
        for batch in batches:
            langs, scores, rates = predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
                                             names=["id", "held_out", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    schema = f"id {dict(rows.dtypes)['id']}, held_out boolean, lang_pred string, score double, bits_per_byte double"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def rate_bounds(texts: dict[str, list[str]]) -> np.ndarray:
    """[L] the bits a byte beyond which a text is in none of the learned languages, though one
    of them may be far likelier than the others: half of a language's texts are learned, and
    the bound is RATE_SPREAD times as far above the mean rate of the other half as the highest
    of them. Infinite where fewer than BOUND_TEXTS long texts are left to tell."""
    langs = sorted(texts)
    scorer = Scorer(train({lang: texts[lang][::2] for lang in langs}))
    bounds = np.full(len(langs), np.inf)
    for k, lang in enumerate(langs):
        rest = [r for t in texts[lang][1::2] if len(r := t.encode("utf-8", "replace")) >= BOUND_BYTES]
        if len(rest) >= BOUND_TEXTS:
            rates = scorer.totals(rest)[:, k] / np.array([len(r) for r in rest])
            bounds[k] = rates.mean() + RATE_SPREAD * (rates.max() - rates.mean())
    return bounds


def accepted(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of identify() with a language at a score of ``least`` or more, all columns as
    they were. A text of a language that was not learned goes as well, by its bits (see
    rate_bounds; texts too short to cost SPARE_BITS more than the bound allows stay)."""
    texts = sample(docs, ~held_out(id_col), id_col, text_col, lang_col)
    bounds = dict(zip(sorted(texts), rate_bounds(texts).tolist())) if texts else {}
    predict = _predictor(docs.sparkSession, train(texts) if texts else None)

    @F.arrow_udf("boolean")
    def keeps(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            langs, scores, rates = predict(column)
            sizes = [len((t.as_py() or "").encode("utf-8", "replace")) for t in column]
            yield pa.array([lang != "und" and s >= least and n * r <= n * bounds[lang] + SPARE_BITS for lang, s, r, n in zip(langs, scores, rates, sizes)], pa.bool_())
        resident(None, None)  # an idle worker would keep the tables beside those of other stages

    return docs.where(keeps(F.col(text_col)))
