"""Token ids: truncation, padding, pairs, spans, shape buckets, batched model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.pieces import pieces

#: Ids kept of a text.
MAX_LENGTH = 512


def pad(ids: Column, length: Column | int, pad_id: int = 0, max_length: int = MAX_LENGTH) -> Column:
    """struct(ids, mask, length): the first max_length ids, filled up to ``length``."""
    kept = F.slice(ids, 1, max_length)
    length = F.lit(length) if isinstance(length, int) else length
    gap = F.greatest(length - F.size(kept), F.lit(0))
    return F.struct(
        F.concat(kept, F.array_repeat(F.lit(pad_id), gap)).alias("ids"),
        F.concat(F.transform(kept, lambda _: F.lit(1)), F.array_repeat(F.lit(0), gap)).alias("mask"),
        F.size(kept).alias("length"),
    )


def pad_batches(rows: DataFrame, batch_col: str, ids_col: str = "ids", pad_id: int = 0, max_length: int = MAX_LENGTH, to: str = "longest") -> DataFrame:
    """Rows with ``encoded`` padded to the longest of their batch (``longest``), to
    max_length (``max_length``) or not at all (``none``). The longest of each batch is
    summed up first and joined back, so that a batch needs no single task."""
    size = F.least(F.size(ids_col), F.lit(max_length))
    if to == "max_length":
        return rows.withColumn("encoded", pad(F.col(ids_col), max_length, pad_id, max_length))
    if to == "none":
        return rows.withColumn("encoded", pad(F.col(ids_col), size, pad_id, max_length))
    longest = rows.groupBy(batch_col).agg(F.max(size).alias("_n"))
    return rows.join(longest, batch_col).withColumn("encoded", pad(F.col(ids_col), F.col("_n"), pad_id, max_length)).drop("_n")


def pair(first: Column, second: Column, begin_id: int, sep_id: int, max_length: int = MAX_LENGTH) -> Column:
    """struct(ids, types) of begin, first, separator, second, separator, cut at the end;
    types are 1 from the first separator on."""
    ids = F.slice(F.concat(F.array(F.lit(begin_id)), first, F.array(F.lit(sep_id)), second, F.array(F.lit(sep_id))), 1, max_length)
    at = F.array_position(ids, F.lit(sep_id))
    return F.struct(ids.alias("ids"), F.transform(ids, lambda _, i: F.when((at > 0) & (i + 1 >= at), 1).otherwise(0)).alias("types"))


def shape_buckets(most: int, ratio: float = 1.4) -> list[int]:
    """Powers of the ratio, rounded up, each at least one above the last, beyond ``most``."""
    out, x = [1], 1.0
    while out[-1] < most:
        x *= ratio
        n = max(out[-1] + 1, -int(-x // 1))
        out.append(n)
    return out


def shape_bucket(n: Column, most: int, ratio: float = 1.4) -> Column:
    """The least bucket that takes n."""
    buckets = F.array(*[F.lit(b) for b in shape_buckets(most, ratio)])
    return F.element_at(F.filter(buckets, lambda b: b >= n), 1)


def trim_output(values: Column, length: Column) -> Column:
    """The outputs of the first ``length`` tokens of a padded row."""
    return F.slice(values, F.lit(1), length)


def word_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words array<struct<word, start, end>>): runs without blank, tab, line feed
    or carriage return, with byte offsets. One pass over the bytes; a null text is empty.
    Words are marked in the bytes of some texts at a time and never become Python objects."""

    def work(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), _words(part.column(1))], names=["id", "words"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, words array<struct<word:string,start:int,end:int>>").withColumnRenamed("id", id_col)


def _words(texts):
    """List column of (word, start, end) of a string column."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, places, raw = texts.buffers()
    at = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = ~np.isin(data, np.frombuffer(b" \t\n\r", np.uint8))
    first = np.zeros(len(data) + 1, bool)
    first[at] = True  # a text's first byte begins a word whatever stands before it
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    counts = np.searchsorted(starts, at)
    origin = np.repeat(at[:-1], np.diff(counts))
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[inside].tobytes()))
    spans = [pa.array((x - origin).astype(np.int32)) for x in (starts, ends)]
    return pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), pa.StructArray.from_arrays([words, *spans], names=["word", "start", "end"]))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_length: int = MAX_LENGTH, add_special_tokens: bool = True) -> DataFrame:
    """(id, ids, spans) of a tokenizers file, at most max_length tokens; spans are bytes.

    The tokenizer is loaded once a worker and gets some texts at a time, as it holds several
    objects a token until a call ends. Null texts are empty."""

    def work(batches: Iterator):
        import pyarrow as pa

        own = _tokenizer(tokenizer_path)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for part in (p for batch in batches for p in pieces(batch)):
            texts = [x.as_py() or "" for x in part.column(1)]
            ids, spans = [], []
            for text, e in zip(texts, own.encode_batch(texts, add_special_tokens=add_special_tokens)):
                at = None if text.isascii() else _byte_places(text)
                ids.append(e.ids[:max_length])
                spans.append([{"start": a if at is None else at[a], "end": b if at is None else at[b]} for a, b in e.offsets[:max_length]])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(spans, span)], names=["id", "ids", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, ids array<int>, spans array<struct<start:int,end:int>>").withColumnRenamed("id", id_col)


def _byte_places(text: str) -> list[int]:
    places, n = [0], 0
    for c in text:
        n += len(c.encode())
        places.append(n)
    return places


_tokenizers: dict = {}


def _tokenizer(path: str):
    """A worker's tokenizer: a tokenizers file, or else a sentencepiece model under the same calls."""
    if path not in _tokenizers:
        if path.endswith(".model"):
            _tokenizers[path] = _Pieces(path)
        else:
            import os

            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


class _Pieces:
    """A sentencepiece model behind the part of the tokenizers interface that encode() needs."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode_batch(self, texts, add_special_tokens=True):
        from types import SimpleNamespace

        out = []
        for text in texts:
            pieces = self.own.encode(text, out_type="immutable_proto").pieces
            out.append(SimpleNamespace(ids=[p.id for p in pieces], offsets=[(p.begin, p.end) for p in pieces]))
        return out


def run_model(rows: DataFrame, model: Callable, inputs: list[str], output: str, output_type: str, batch_size: int = 32, bucket: str | None = None) -> DataFrame:
    """Rows with the model's output, called with lists of at most batch_size rows.

    ``model`` is made once a task by calling it without arguments and then called
    with a list of tuples of the inputs. With ``bucket`` rows of a task are sorted by
    that column first, so that batches need little padding. Order does not matter:
    outputs stay with their rows, which leave piece by piece."""
    names = rows.columns
    if bucket:
        rows = rows.sortWithinPartitions(bucket)
    kind = _arrow(output_type)

    def work(batches: Iterator):
        import pyarrow as pa

        ready = model()
        for part in (p for batch in batches for p in pieces(batch, batch_size)):
            columns = [part.column(names.index(c)).to_pylist() for c in inputs]
            tuples, out = list(zip(*columns)), []
            for k in range(0, len(tuples), batch_size):
                out += ready(tuples[k : k + batch_size])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, kind)], names=[*names, output])

    from pyspark.sql.types import StructType

    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"`{output}` {output_type}").fields])
    return rows.mapInArrow(work, schema)


def _arrow(kind: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(f"x {kind}")).field(0).type


def embed(rows: DataFrame, model: Callable, text_col: str = "text", batch_size: int = 32, output: str = "embedding") -> DataFrame:
    """Embeddings of texts in batches; each distinct text is computed once and joined
    back (as a result cache and shared calls would have it)."""
    from millrace.functions import vector as V

    # a text's digest stands for it in the joins; duplicates are few in a shuffle by digest
    keyed = rows.withColumn("_k", F.sha2(F.coalesce(text_col, F.lit("")), 256))
    distinct = keyed.groupBy("_k").agg(F.first(F.col(text_col)).alias("_text"))
    done = run_model(distinct, model, ["_text"], "_raw", "array<double>", batch_size)
    done = done.select("_k", V.l2_normalize(F.col("_raw")).alias(output))
    return keyed.join(done, "_k").drop("_k")


def mixed_model(models: dict[str, Callable]) -> Callable:
    """One model of (modality, input, ...) rows from a model each modality: each gets the rows of
    its own, with the first input that is not null. A task makes only those that it meets.
    Any row of a modality without model fails the batch."""

    def make():
        ready: dict[str, Callable] = {}

        def call(batch):
            places: dict[str, list[int]] = {}
            for i, (modality, *_) in enumerate(batch):
                places.setdefault(modality, []).append(i)
            out = [None] * len(batch)
            for modality, own in places.items():
                if modality not in models:
                    raise ValueError(f"no encoder for {'null' if modality is None else modality}")
                if modality not in ready:
                    ready[modality] = models[modality]()
                for i, value in zip(own, ready[modality]([(next((x for x in batch[i][1:] if x is not None), None),) for i in own])):
                    out[i] = value
            return out

        return call

    return make


def embed_mixed(rows: DataFrame, models: dict[str, Callable], modality_col: str = "modality", input_col: str = "data", batch_size: int = 32, output: str = "embedding") -> DataFrame:
    """Rows of several modalities, each through its own encoder, in one pass over the rows. A row of
    a modality without encoder, null included, fails the job: check before where that may be."""
    return run_model(rows, mixed_model(models), [modality_col, input_col], output, "array<double>", batch_size)


#: Numbers of the largest query set that is sent to every task (64 MB); larger ones meet the vectors in blocks.
SENT_NUMBERS = 8 << 20
#: Queries of a block, and groups of vectors that each block meets.
QUERY_BLOCK, VECTOR_GROUPS = 65_536, 64
#: Bytes of copies of packed rows that leave a task at a time.
PACKED_BYTES = 4 << 20
#: Similarities worked out at a time.
CELLS = 1 << 22


class _Best:
    """The k most similar vectors of each of a block of queries, ties by vector id."""

    def __init__(self, ids, queries, k: int):
        import numpy as np

        self.ids, self.queries, self.k = np.asarray(ids, np.int64), self._unit(queries), k
        self.sims = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    @staticmethod
    def _unit(x):
        import numpy as np

        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    def add(self, ids, vectors) -> None:
        import numpy as np

        x, ids, at = self._unit(vectors), np.asarray(ids, np.int64), 0
        while at < len(ids):
            step = max(1, CELLS // max(1, len(self.ids)))
            step = min(step, 4 * self.k) if np.isneginf(self.sims[0, -1]) else step  # until k are known nearly all are kept
            sims = self.queries @ x[at : at + step].T
            rows, cols = np.nonzero(sims >= self.sims[:, -1:] - 1e-11)
            if len(rows):
                some = np.unique(rows)
                r = np.concatenate([np.repeat(some, self.k), rows])
                s = np.concatenate([self.sims[some].ravel(), sims[rows, cols].round(12)])
                v = np.concatenate([self.found[some].ravel(), ids[at + cols]])
                order = np.lexsort((v, -s, r))
                starts = np.searchsorted(r[order], some)
                top = order[(starts[:, None] + np.arange(self.k)).ravel()]
                self.sims[some], self.found[some] = s[top].reshape(-1, self.k), v[top].reshape(-1, self.k)
            at += step

    def batch(self):
        import numpy as np
        import pyarrow as pa

        kept = ~np.isneginf(self.sims)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((np.repeat(self.ids, self.k)[kept.ravel()], pa.int64()), (self.found[kept], pa.int64()), (self.sims[kept], pa.float64()))], names=["q", "v", "similarity"])


def _matrix(column):
    """Rows of a list column as doubles, all of one length."""
    import numpy as np

    flat = column.flatten() if not hasattr(column, "chunks") else column.combine_chunks().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _blocks(blocks: int, groups: int, kind: int):
    """Rows (id, vector) as packed rows (block, group, kind, ids, data): queries (kind 0) are dealt
    to one block and all groups, vectors (kind 1) to one group and all blocks."""
    own, others = (blocks, groups) if kind == 0 else (groups, blocks)

    def work(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        turn = 0
        for batch in (p for b in batches for p in pieces(b)):
            ids, x = np.asarray(batch.column(0), np.int64), _matrix(batch.column(1))
            dealt = (turn + np.arange(len(ids))) % own
            turn += len(ids)
            for part in np.unique(dealt):
                raw = (ids[dealt == part].tobytes(), x[dealt == part].tobytes())
                step = max(1, min(1024, PACKED_BYTES // max(len(raw[1]), 1)))  # copies of one batch
                for k in range(0, others, step):
                    other = np.arange(k, min(k + step, others), dtype=np.int32)
                    mine = np.full(len(other), part, np.int32)
                    pair = (mine, other) if kind == 0 else (other, mine)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(np.full(len(other), kind, np.int32)), pa.array([raw[0]] * len(other), pa.binary()), pa.array([raw[1]] * len(other), pa.binary())],
                                                     names=["block", "part", "kind", "ids", "data"])

    return work


def _meet(k: int):
    """Top k of each (block, group): its queries come first, then its vectors one packed row after the other."""

    def work(batches: Iterator):
        import numpy as np

        place, asked, best = None, [], None
        for batch in batches:
            for b, g, kind, ids, data in ([c[k].as_py() for c in batch.columns] for k in range(batch.num_rows)):
                if (b, g) != place:
                    if best is not None:
                        yield best.batch()
                    place, asked, best = (b, g), [], None
                ids = np.frombuffer(ids, np.int64)
                data = np.frombuffer(data, float).reshape(len(ids), -1)
                if kind == 0:
                    asked.append((ids, data))
                elif asked:
                    if best is None:
                        best, asked = _Best(np.concatenate([i for i, _ in asked]), np.concatenate([d for _, d in asked]), k), [True]
                    best.add(ids, data)
        if best is not None:
            yield best.batch()

    return work


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", vector_id: str = "vec_id", column: str = "embedding", sent_numbers: int = SENT_NUMBERS) -> DataFrame:
    """(query id, vector id, similarity, rank): the k most similar vectors of each query by
    cosine, ties by id, against all vectors. Cosines are rounded to 12 places, so that
    copies tie wherever they are met.

    Query sets of up to ``sent_numbers`` numbers are sent to every task. Larger ones are dealt
    into blocks of about QUERY_BLOCK and meet the vectors block by block and group by group:
    each meeting streams a group's vectors past one block of queries and keeps k a query.
    Ranks are settled among what tasks have kept. Vectors of one length and not null; null
    or empty ones are left out."""
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")).where(F.size("x") > 0)
    known = vectors.select(F.col(vector_id).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")).where(F.size("x") > 0)
    count, width = asked.agg(F.count("*"), F.max(F.size("x"))).first()
    if count * (width or 0) <= sent_numbers:
        rows = asked.toArrow().combine_chunks()  # counted above
        sent = queries.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(), _matrix(rows["x"]) if count else None))

        def work(batches: Iterator):
            import numpy as np

            if not len(sent.value[0]):
                return
            best = _Best(*sent.value, k)
            for batch in batches:
                best.add(np.asarray(batch.column(0)), _matrix(batch.column(1)))
            yield best.batch()

        found = known.mapInArrow(work, "q long, v long, similarity double")
    else:
        blocks = -(-count // QUERY_BLOCK)
        packed = "block int, part int, kind int, ids binary, data binary"
        rows = asked.mapInArrow(_blocks(blocks, VECTOR_GROUPS, 0), packed).unionByName(known.mapInArrow(_blocks(blocks, VECTOR_GROUPS, 1), packed))
        met = rows.repartition(blocks * VECTOR_GROUPS, "block", "part").sortWithinPartitions("block", "part", "kind")
        found = met.mapInArrow(_meet(k), "q long, v long, similarity double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "v"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("v").alias(vector_id), "similarity", "rank")
