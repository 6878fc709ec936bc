"""Requests from end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import vector
from millrace.operators import chunking, extraction, generation, scoring, tokens
from millrace.sources import inputs


def embed(requests: DataFrame, model: Callable, capabilities: DataFrame | None = None, batch_size: int = 32, encoders: dict[str, Callable] | None = None) -> DataFrame:
    """(id, pos, embedding, error) of requests (id, model, input JSON): parts are read,
    checked against the model's media types and embedded, equal texts once.

    ``encoders`` embed bytes by kind of media ("image", "audio"). Every part is a row:
    one of a kind without encoder, and one without content, has an error. Requests of
    one id are answered each."""
    read = inputs.read_inputs(requests, "id", "input", "model").select("id", "pos", "model", "part.*", "error")
    # what each part is, and what is wrong with it, is one row from here on
    if capabilities is not None:
        read = inputs.checked(read, capabilities)
        # an address that is not read yet has no type to check
        bare = (F.col("type") != "text") & F.col("data").isNull() & F.col("mime_type").isNull()
        refused = F.when(F.col("error").isNull() & ~F.coalesce(bare, F.lit(False)) & ~F.col("listed"), F.concat(F.lit("unsupported content type "), F.coalesce("checked_mime", F.lit("unknown"))))
        read = read.withColumn("error", F.coalesce("error", refused))
    kind = F.when((F.col("type") == "text") | (F.col("data").isNull() & F.col("url").isNotNull()), "text").when(F.col("data").isNotNull(), F.split(F.coalesce("mime_type", F.lit("unknown")), "/")[0])
    rows = read.withColumn("kind", kind).withColumn("text", F.when(F.col("kind") == "text", F.coalesce("text", "url")))
    lost = F.when(F.col("kind").isNull() | ((F.col("kind") == "text") & F.col("text").isNull()), "content part without content").when(~F.col("kind").isin("text", *(encoders or {})), F.concat(F.lit("no encoder for "), "kind"))
    content = F.when(F.col("kind") == "text", F.encode("text", "utf-8")).otherwise(F.col("data"))
    rows = rows.withColumn("error", F.coalesce("error", lost)).withColumn("_k", F.when(F.col("error").isNull(), F.sha2(F.concat(F.encode(F.concat("kind", F.lit("|")), "utf-8"), content), 256)))
    # equal contents are embedded once, texts and media in one pass
    first = rows.where("_k is not null").groupBy("_k").agg(F.first(F.struct("kind", "text", "data")).alias("c")).select("_k", "c.*")
    media = first.withColumn("data", F.when(F.col("kind") != "text", F.col("data")))
    done = tokens.run_model(media, tokens.mixed_model({"text": model, **(encoders or {})}), ["kind", "text", "data"], "_raw", "array<double>", batch_size)
    done = done.select("_k", vector.l2_normalize(F.col("_raw")).alias("embedding"))
    return rows.select("id", "pos", "error", "_k").join(done, "_k", "left").select("id", "pos", "embedding", "error")


def chunk(requests: DataFrame, models: DataFrame, config: chunking.ChunkConfig = chunking.ChunkConfig(), **options: int) -> DataFrame:
    """(id, model, model_used, chunk_id, text, start_char, end_char) of requests (id, model,
    text); models other than the fixed ones fall back where they are not registered.
    Requests of one id are cut each."""
    routed = chunking.dispatch(requests, models).withColumn("_r", F.struct("id", "model", "model_used"))
    return chunking.chunk_request(routed, config, id_col="_r", **options).select("_r.*", "chunk_id", "text", "start_char", "end_char")


def recognise(grid: DataFrame, heads: DataFrame | None = None, relation_labels: list[str] | None = None, threshold: float = extraction.THRESHOLD, relation_threshold: float = 0.0, id_col: str = "doc_id"):
    """(entities, relations) of a span model's logits (see extraction.score_spans) and of
    its relation heads; relations are None without heads."""
    found = extraction.without_overlaps(extraction.score_spans(grid, threshold, id_col), id_col)
    if heads is None:
        return found, None
    return found, extraction.extract_relations(found, heads, relation_labels or [], relation_threshold, id_col)


def rerank(requests: DataFrame, model: Callable, k: int | None = None) -> DataFrame:
    """(query_id, pos, text, score) of requests (query_id, query, prompts array); the best k
    of each query if asked for."""
    pairs = requests.select("query_id", "query", F.posexplode("prompts").alias("pos", "text"))
    scored = scoring.rerank(pairs, model).drop("query")
    return scored if k is None else scoring.top_documents(scored, k, "query_id", "pos")


def generate(messages: DataFrame, encode: Callable[[DataFrame], DataFrame], decoder: Callable[[], generation.Decoder], decode: Callable[[DataFrame], DataFrame], tools: bool = False, id_col: str = "conv_id") -> DataFrame:
    """Answers to conversations: prompt, ids (``encode`` adds the column), generation, text
    (``decode`` adds it), tool calls, finish reason and usage."""
    prompts = generation.chat_prompts(messages, id_col)
    made = generation.generate(encode(prompts), decoder)
    texts = decode(made).select(F.col(id_col).alias("id"), "text", F.when(F.col("generated.stopped"), "stop").otherwise("length").alias("stopped"), "prompt_tokens", F.size("generated.ids").alias("completion_tokens"))
    if tools:
        answered = generation.with_tool_calls(texts)
    else:
        answered = texts.withColumn("calls", F.expr("cast(array() as array<struct<name:string,arguments:string>>)")).withColumn("content", F.col("text"))
    return generation.completion(answered).withColumnRenamed("id", id_col)
