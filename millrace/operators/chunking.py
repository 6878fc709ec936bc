"""Chunking of texts: fixed size by sections, at predicted boundaries, by target size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vector as V


@dataclass(frozen=True)
class ChunkConfig:
    """Settings of fixed-size chunking; zero and empty values mean the defaults."""

    model: str = "fixed-bert-tokenizer"
    target_tokens: int = 500
    overlap_tokens: int = 50
    separator: str = "\n\n"
    max_chunks: int = 50

    def resolved(self) -> ChunkConfig:
        plain = ChunkConfig()
        out = ChunkConfig(
            self.model or plain.model,
            self.target_tokens if self.target_tokens > 0 else plain.target_tokens,
            self.overlap_tokens if self.overlap_tokens >= 0 else plain.overlap_tokens,
            self.separator or plain.separator,
            self.max_chunks if self.max_chunks > 0 else plain.max_chunks,
        )
        if out.overlap_tokens >= out.target_tokens:
            raise ValueError("overlap_tokens must be less than target_tokens")
        return out

    def override(self, target_tokens: int = 0, overlap_tokens: int = 0, separator: str = "", max_chunks: int = 0) -> ChunkConfig:
        """A request's own values over these; a request may ask for an overlap beyond the target."""
        return ChunkConfig(self.model, target_tokens or self.target_tokens, overlap_tokens or self.overlap_tokens, separator or self.separator, max_chunks or self.max_chunks)


#: Models that mean fixed-size chunking.
FIXED_MODELS = ("fixed-bert-tokenizer", "fixed-bpe-tokenizer")

_CHUNKS = "array<struct<text:string,start:int,n_bytes:int>>"


def _fold(text: Column, c: ChunkConfig) -> Column:
    """Chunks as an array of at most max_chunks structs, by one fold over the sections."""
    counted = F.transform(T.trimmed_sections(text, c.separator), lambda s: F.struct(s.alias("s"), T.count_tokens(s).alias("n")))
    gap = len(c.separator.encode())
    zero = F.struct(F.array().cast(_CHUNKS).alias("chunks"), F.lit("").alias("cur"), F.lit(0).alias("start"), F.lit(0).alias("tokens"))

    def chunk(state):
        body = T.trim(state["cur"])
        return F.struct(body.alias("text"), state["start"].alias("start"), F.octet_length(body).alias("n_bytes"))

    def grown(state, section):
        joined = F.when(state["cur"] == "", section["s"]).otherwise(F.concat(state["cur"], F.lit(c.separator), section["s"]))
        return F.struct(state["chunks"].alias("chunks"), joined.alias("cur"), state["start"].alias("start"), (state["tokens"] + section["n"]).alias("tokens"))

    def flushed(state, section):
        def after(b):
            body, over = b["body"], b["over"]
            done = F.struct(body.alias("text"), state["start"].alias("start"), F.octet_length(body).alias("n_bytes"))
            return F.struct(
                F.when(body != "", F.array_append(state["chunks"], done)).otherwise(state["chunks"]).alias("chunks"),
                F.when(over == "", section["s"]).otherwise(F.concat(over, F.lit(" " + c.separator), section["s"])).alias("cur"),
                (state["start"] + F.octet_length(body) + gap).alias("start"),
                (T.count_tokens(over) + section["n"]).alias("tokens"),
            )

        # what overlaps a piece is the end of its text
        over = lambda body: T.tail(body, 4 * c.overlap_tokens) if c.overlap_tokens > 0 else F.lit("")
        return T.let(T.let(T.trim(state["cur"]), lambda body: F.struct(body.alias("body"), over(body).alias("over"))), after)

    def step(state, section):
        full = (state["tokens"] > 0) & (state["tokens"] + section["n"] > c.target_tokens)
        return F.when(F.size(state["chunks"]) >= c.max_chunks, state).when(full, flushed(state, section)).otherwise(grown(state, section))

    def finish(state):
        more = (F.size(state["chunks"]) < c.max_chunks) & (T.trim(state["cur"]) != "")
        return F.when(more, F.array_append(state["chunks"], chunk(state))).otherwise(state["chunks"])

    return F.aggregate(counted, zero, step, finish)


def chunk_fixed(docs: DataFrame, config: ChunkConfig = ChunkConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_id, text, start_char, end_char): sections packed until the target.

    Offsets count bytes and separators as if every chunk began at its last one's end
    (overlaps and other separators shift them); null and empty texts have no
    chunks; a text without sections is one chunk over its whole length. No shuffle."""
    c = config
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_t")).where("_t <> ''")
    whole = F.array(F.struct(T.trim(F.col("_t")).alias("text"), F.lit(0).alias("start"), F.octet_length("_t").alias("n_bytes")))
    found = rows.withColumn("_c", _fold(F.col("_t"), c)).select(id_col, F.posexplode(F.when(F.size("_c") > 0, F.col("_c")).otherwise(whole)).alias("chunk_id", "_c"))
    return found.select(id_col, "chunk_id", F.col("_c.text").alias("text"), F.col("_c.start").alias("start_char"), (F.col("_c.start") + F.col("_c.n_bytes")).alias("end_char"))


def chunk_request(docs: DataFrame, defaults: ChunkConfig = ChunkConfig(), target_tokens: int = 0, overlap_tokens: int = 0, separator: str = "", max_chunks: int = 0, **names: str) -> DataFrame:
    """chunk_fixed() as a request has it: a request's overlap and separator have no effect."""
    return chunk_fixed(docs, defaults.override(target_tokens=target_tokens, max_chunks=max_chunks), **names)


def dispatch(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Requests (…, model) with (model_used, chunker): fixed names and names without a
    model fall to the fixed chunker, others to the registered model."""
    known = models.select(F.col("name").alias("_m")).distinct()
    fixed = F.col("model").isin(*FIXED_MODELS)
    out = requests.join(known, F.col("model") == F.col("_m"), "left")
    used = F.when(~fixed & F.col("_m").isNotNull(), F.col("_m")).otherwise(ChunkConfig().model)
    return out.withColumns({"model_used": used, "chunker": F.when(~fixed & F.col("_m").isNotNull(), "model").otherwise("fixed")}).drop("_m")


def boundary_positions(tokens: Column, labels: list[str], text_bytes: Column, threshold: float = 0.5) -> Column:
    """Sorted byte positions strictly inside the text at which tokens (struct of logits
    and, if known, end) are predicted to be separators with enough probability."""
    names = F.array(*[F.lit(x) for x in labels])

    def found(tokens, size):
        def judged(t, i):
            at = F.coalesce(t["end"], F.floor(i * size / F.size(tokens)).cast("int"))
            likely = lambda best: (best < len(labels)) & T.is_separator_label(F.get(names, best)) & (F.element_at(V.softmax(t["logits"]), best + 1) >= threshold)
            return F.when((at > 0) & (at < size) & T.let(V.argmax(t["logits"]), likely), at)

        return F.sort_array(F.array_compact(F.transform(tokens, judged)))

    # worked out once: a column of tokens may itself be an expression
    return T.let(F.struct(tokens.alias("t"), text_bytes.alias("n")), lambda x: found(x["t"], x["n"]))


def _bytes(raw: Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(raw, start + 1, end - start), "utf-8")


def split_at(text: Column, positions: Column, min_size: int = 50) -> Column:
    """array<struct<text, start, end>>: cut where the trimmed piece since the last cut has
    min_size bytes; a small end joins the last piece. Positions lie between characters.

    The text is cut at all positions once; each part tells where its first and last visible
    character is, and what follows are numbers: a piece of several parts reaches, trimmed,
    from the first of the one to the last of the other."""
    return T.let(F.encode(text, "utf-8"), lambda raw: T.let(_parts(raw, positions), lambda parts: _pieces(raw, parts, min_size)))


def _parts(raw: Column, positions: Column) -> Column:
    """array<struct<start, end, first, last>> of the text between positions; first and last
    enclose what is visible, null where nothing is."""
    size = F.octet_length(raw)
    inside = F.filter(positions, lambda p: (p > 0) & (p <= size))
    bounds = F.concat(F.array(F.lit(0)), F.array_distinct(inside), F.array(size))

    def part(bounds, i):
        start, end = F.get(bounds, i), F.get(bounds, i + 1)
        return T.let(_bytes(raw, start, end), lambda t: T.let(F.struct(start.alias("start"), end.alias("end"), F.octet_length(F.regexp_extract(t, r"(?U)^\s+", 0)).alias("lead"), F.octet_length(T.trim(t)).alias("n")), seen))

    def seen(x):
        first = F.when(x["n"] > 0, x["start"] + x["lead"])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), first.alias("first"), (first + x["n"]).alias("last"))

    return T.let(bounds, lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda i: part(b, i)))


def _pieces(raw: Column, parts: Column, min_size: int) -> Column:
    kind = "struct<start:int,end:int,first:int,last:int>"
    size = F.octet_length(raw)
    piece = lambda start, end, first, last: F.struct(start.alias("start"), end.alias("end"), first.alias("first"), last.alias("last"))
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("cuts"), F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")).alias("open"))

    def step(a, x):
        o = a["open"]
        return T.let(F.struct(a["cuts"].alias("cuts"), piece(o["start"], x["end"], F.coalesce(o["first"], x["first"]), F.coalesce(x["last"], o["last"])).alias("open")), closed)

    def closed(a):
        o = a["open"]
        good = (o["end"] > o["start"]) & (F.coalesce(o["last"] - o["first"], F.lit(0)) >= min_size)
        fresh = piece(o["end"], o["end"], F.lit(None).cast("int"), F.lit(None).cast("int"))
        return F.when(good, F.struct(F.array_append(a["cuts"], o).alias("cuts"), fresh.alias("open"))).otherwise(a)

    def finish(a):
        last_part = F.element_at(parts, -1)
        o = a["open"]
        rest = piece(o["start"], size, F.coalesce(o["first"], last_part["first"]), F.coalesce(last_part["last"], o["last"]))
        return T.let(F.struct(a["cuts"].alias("cuts"), rest.alias("rest")), ended)

    def ended(a):
        cuts, rest = a["cuts"], a["rest"]
        left, before = F.coalesce(rest["last"] - rest["first"], F.lit(0)), F.element_at(a["cuts"], -1)
        merged = F.array_append(F.slice(cuts, 1, F.greatest(F.size(cuts) - 1, F.lit(0))), piece(before["start"], size, before["first"], F.coalesce(rest["last"], before["last"])))
        return F.when((rest["start"] >= size) | (left == 0), cuts).when((left < min_size) & (F.size(cuts) > 0), merged).otherwise(F.array_append(cuts, rest))

    inner = F.slice(parts, 1, F.size(parts) - 1)
    whole = F.array(piece(F.lit(0), size, F.element_at(parts, 1)["first"], F.element_at(parts, 1)["last"]))
    cuts = T.let(F.aggregate(inner, zero, step, finish), lambda c: F.when(F.size(c) > 0, c).otherwise(whole))
    shown = lambda c: F.when(c["first"].isNull(), F.lit("")).otherwise(_bytes(raw, c["first"], c["last"]))
    return F.transform(cuts, lambda c: F.struct(shown(c).alias("text"), c["start"].alias("start"), c["end"].alias("end")))


def merge_to_target(chunks: Column, target_tokens: int) -> Column:
    """Neighbouring pieces joined by blank lines until the target (four bytes a token)."""
    kind = "array<struct<text:string,start:int,end:int>>"
    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("struct<text:string,start:int,end:int>").alias("cur"), F.lit(0).alias("tokens"))

    def step(a, c):
        n = T.estimate_tokens(c["text"])
        full = (a["tokens"] > 0) & (a["tokens"] + n > target_tokens)
        own = F.struct(c["text"].alias("text"), c["start"].alias("start"), c["end"].alias("end"))
        more = F.struct(F.concat(a["cur"]["text"], F.lit("\n\n"), c["text"]).alias("text"), a["cur"]["start"].alias("start"), c["end"].alias("end"))
        return F.struct(
            F.when(full, F.array_append(a["done"], a["cur"])).otherwise(a["done"]).alias("done"),
            F.when(full | a["cur"].isNull(), own).otherwise(more).alias("cur"),
            F.when(full, n).otherwise(a["tokens"] + n).alias("tokens"),
        )

    return F.aggregate(chunks, zero, step, lambda a: F.when(a["cur"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["cur"])))


def chunk_predicted(docs: DataFrame, labels: list[str], threshold: float = 0.5, min_size: int = 50, target_tokens: int = 0, max_chunks: int = 0, id_col: str = "doc_id") -> DataFrame:
    """(id, chunk_id, text, start_char, end_char) of rows (id, text, tokens): cuts at the
    predicted boundaries, merged to the target if one is given. Without tokens or
    boundaries the text is one chunk."""
    text = F.col("text")
    at = boundary_positions(F.coalesce("tokens", F.expr("cast(array() as array<struct<logits:array<double>,end:int>>)")), labels, F.octet_length(text), threshold)
    pieces = split_at(text, at, min_size)
    if target_tokens > 0:
        pieces = T.let(pieces, lambda c: F.when(F.size(c) > 1, merge_to_target(c, target_tokens)).otherwise(c))
    if max_chunks > 0:
        pieces = F.slice(pieces, 1, max_chunks)
    # the expression itself is exploded: of a column the optimiser would infer a filter and work it out again for that
    out = docs.where("text <> ''").select(id_col, F.posexplode(pieces).alias("chunk_id", "_c"))
    return out.select(id_col, "chunk_id", F.col("_c.text").alias("text"), F.col("_c.start").alias("start_char"), F.col("_c.end").alias("end_char"))


def chunk_key(text: Column, config: ChunkConfig, threshold: float = 0.5) -> Column:
    """Cache key of a text under a configuration: SHA-256 over both."""
    head = f"{config.model}:{config.target_tokens}:{config.overlap_tokens}:{config.separator}:{config.max_chunks}:{threshold:.3f}"
    return F.sha2(F.concat(F.lit(head), F.sha2(text, 256)), 256)
