"""Chat prompts, decoding, tool calls and usage."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

#: How roles are written in a prompt; others are not named.
ROLES = {"system": "System: ", "user": "User: ", "assistant": "Assistant: "}


def message_text(parts: Column, content: Column) -> Column:
    """The text parts run together; without parts the content."""
    texts = F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit("")))
    return F.when(F.size(parts) > 0, F.array_join(texts, "")).otherwise(F.coalesce(content, F.lit("")))


def message_block(role: Column, content: Column) -> Column:
    names = F.create_map(*[F.lit(x) for p in ROLES.items() for x in p])
    return F.concat(F.coalesce(F.try_element_at(names, role), F.lit("")), F.coalesce(content, F.lit("")), F.lit("\n\n"))


def chat_prompts(messages: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, prompt, prompt_tokens): messages in order, each a block, then the assistant's
    cue; tokens are estimated for each message. A conversation is one row in the end
    and so one group; ties in order go by role and text."""
    block = F.struct(F.col(order_col), F.col(role_col), F.col(text_col), message_block(F.col(role_col), F.col(text_col)).alias("b"))
    out = messages.groupBy(id_col).agg(F.sort_array(F.collect_list(block)).alias("m"), F.sum(T.estimate_tokens(F.col(text_col))).alias("prompt_tokens"))
    return out.select(id_col, F.concat(F.array_join(F.transform("m", lambda x: x["b"]), ""), F.lit("Assistant: ")).alias("prompt"), "prompt_tokens")


def options(max_tokens: Column, temperature: Column, top_p: Column, top_k: Column) -> Column:
    """struct of sampling options, zero or null meaning the default; sampling is on as
    soon as any of temperature, top_p and top_k is set."""
    given = lambda c: F.coalesce(c, F.lit(0)) > 0
    value = lambda c, d: F.when(given(c), c).otherwise(F.lit(d))
    return F.struct(
        value(max_tokens, 256).alias("max_tokens"), value(temperature, 1.0).alias("temperature"), value(top_p, 1.0).alias("top_p"), value(top_k, 50).alias("top_k"),
        (given(temperature) | given(top_p) | given(top_k)).alias("do_sample"),
    )


def finish_reason(tool_calls: Column, stopped: Column) -> Column:
    return F.when(F.size(tool_calls) > 0, "tool_calls").when(stopped == "length", "length").otherwise("stop")


# --- decoding ---------------------------------------------------------------


@dataclass
class Decoder:
    """One sequence decoded token by token. ``step`` gives the logits of the ids so far."""

    step: Callable[[list[int]], list[float]]
    eos_id: int
    max_new_tokens: int = 256
    min_length: int = 0
    temperature: float = 1.0
    top_k: int = 0
    top_p: float = 1.0
    repetition_penalty: float = 1.0
    do_sample: bool = False
    suppress: tuple[int, ...] = ()
    forced: dict[int, int] = field(default_factory=dict)
    seed: int = 0

    def choose(self, logits, generated: list[int], rng) -> tuple[int, float]:
        """(token, log-probability) under the penalty and the sampling options."""
        import numpy as np

        x = np.array(logits, float)
        for token in generated if self.repetition_penalty != 1.0 else ():
            if token < len(x):
                x[token] = x[token] / self.repetition_penalty if x[token] > 0 else x[token] * self.repetition_penalty
        if self.do_sample and self.temperature != 1.0:
            x = x / self.temperature
        shifted = np.exp(x - x.max())
        p = shifted / shifted.sum()
        if not self.do_sample:
            token = int(p.argmax())
            return token, float(np.log(p[token]))
        kept = p
        if 0 < self.top_k < len(kept):
            kept = np.where(kept >= np.sort(kept)[-self.top_k], kept, 0.0)
            kept = kept / kept.sum()
        if self.top_p < 1.0:
            order = np.argsort(-kept, kind="stable")
            cut = order[: int(np.searchsorted(np.cumsum(kept[order]), self.top_p)) + 1]
            mask = np.zeros(len(kept), bool)
            mask[cut] = True
            kept = np.where(mask, kept, 0.0)
            kept = kept / kept.sum()
        token = int(min(np.searchsorted(np.cumsum(kept), rng.random(), side="right"), len(kept) - 1))
        return token, float(np.log(max(p[token], 1e-300)))

    def stream(self, start: list[int], plain: bool = True) -> Iterator[tuple[int, float, bool]]:
        """(token, log-probability, stopped) one by one. ``plain`` leaves out suppressed
        and forced tokens, as streams do."""
        import numpy as np

        rng, ids, out = np.random.default_rng(self.seed), list(start), [] if plain else list(start[1:])
        for _ in range(self.max_new_tokens):
            logits = np.array(self.step(ids), float)
            if not plain:
                logits[[t for t in self.suppress if t < len(logits)]] = -np.inf
            if not plain and len(ids) in self.forced:
                token, log_prob = self.forced[len(ids)], 0.0
            else:
                token, log_prob = self.choose(logits, out, rng)
            if token == self.eos_id:
                if len(out) >= self.min_length:
                    yield token, log_prob, True
                    return
                logits[self.eos_id] = -np.inf
                token, log_prob = self.choose(logits, out, rng)
            out.append(token)
            ids.append(token)
            yield token, log_prob, False

    def generate(self, start: list[int]) -> dict:
        """Ids (start tokens after the first included), log-probability, whether it stopped, score."""
        import math

        ids, total, stopped = list(start[1:]), 0.0, False
        for token, log_prob, stopped in self.stream(start, plain=False):
            total += log_prob
            if not stopped:
                ids.append(token)
        return {"ids": ids, "log_prob": total, "stopped": stopped, "score": math.exp(total / len(ids)) if ids else 0.0}


def start_tokens(prompt: Column, start_id: int) -> Column:
    """A prompt's tokens, else the decoder's start token."""
    return F.when(F.size(prompt) > 0, prompt).otherwise(F.array(F.lit(start_id)))


def generate(rows: DataFrame, decoder: Callable[[], Decoder], ids_col: str = "ids", output: str = "generated") -> DataFrame:
    """Rows with a struct(ids, log_prob, stopped, score); the decoder is made once a task."""
    from millrace.operators.tokens import run_model

    def model():
        own = decoder()
        return lambda batch: [own.generate(list(ids or [])) for (ids,) in batch]

    return run_model(rows, model, [ids_col], output, "struct<ids:array<int>,log_prob:double,stopped:boolean,score:double>")


def generate_stream(rows: DataFrame, decoder: Callable[[], Decoder], id_col: str, ids_col: str = "ids", stop: Callable[[int], bool] | None = None) -> DataFrame:
    """(id, index, token, log_prob, last): one row a token; ``stop`` may end a sequence early."""

    def work(batches):
        import pyarrow as pa

        own = decoder()
        for batch in batches:
            rows = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for index, (token, log_prob, last) in enumerate(own.stream(list(ids or []))):
                    ends = last or bool(stop and stop(token))
                    rows.append((key, index, token, log_prob, ends))
                    if ends:
                        break
            kinds = (batch.column(0).type, pa.int32(), pa.int32(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["id", "index", "token", "log_prob", "last"])

    given = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return given.mapInArrow(work, f"id {dict(given.dtypes)['id']}, index int, token int, log_prob double, last boolean").withColumnRenamed("id", id_col)


# --- tools ------------------------------------------------------------------


@dataclass(frozen=True)
class ToolTokens:
    """Marks around declarations, calls and values."""

    start_declaration: str = "<start_function_declaration>"
    end_declaration: str = "<end_function_declaration>"
    start_call: str = "<start_function_call>"
    end_call: str = "<end_function_call>"
    escape: str = "<escape>"


#: Configuration keys of the marks, in the order in which added tokens are searched for them.
TOKEN_KEYS = {"start_function_declaration": "start_declaration", "end_function_declaration": "end_declaration", "start_function_call": "start_call", "end_function_call": "end_call", "escape": "escape"}


def tool_tokens(configs: DataFrame, id_col: str = "model", special_col: str = "special_tokens_map", tokenizer_col: str = "tokenizer_config") -> DataFrame:
    """(id, tokens struct) of a model's JSON files: each file in turn by its own keys, then
    by its added tokens whose content holds a key; used if it has both call marks, else
    the defaults."""
    plain = ToolTokens()

    def read(c: Column) -> Column:
        keyed = {a: F.get_json_object(c, f"$.{k}") for k, a in TOKEN_KEYS.items()}
        added = F.transform(F.map_values(F.from_json(F.get_json_object(c, "$.added_tokens_decoder"), "map<string,struct<content:string>>")), lambda t: t["content"])
        holding = lambda key: F.filter(added, lambda x: x.contains(key))
        found = {a: F.try_element_at(holding(k), F.lit(-1)) for k, a in TOKEN_KEYS.items()}
        own = F.struct(*[F.coalesce(keyed[a], F.lit("")).alias(a) for a in keyed])
        from_added = F.struct(*[F.coalesce(found[a], keyed[a], F.lit("")).alias(a) for a in keyed])
        good = lambda s: (s["start_call"] != "") & (s["end_call"] != "")
        return F.when(good(own), own).when(good(from_added), from_added)

    default = F.struct(*[F.lit(getattr(plain, a)).alias(a) for a in TOKEN_KEYS.values()])
    return configs.select(id_col, F.coalesce(read(F.col(special_col)), read(F.col(tokenizer_col)), default).alias("tokens"))


def tools_prompt(tools: Column, tokens: ToolTokens = ToolTokens()) -> Column:
    """Declarations of array<struct<name, description, parameters>> (parameters: array of
    struct<name, type, description, required>, written in order of name) and how to call."""
    t, e = tokens, tokens.escape

    def parameter(p):
        return F.concat(p["name"], F.lit(":{type:"), p["type"], F.when(p["required"], ",required:true").otherwise(""), F.lit(",description:" + e), p["description"], F.lit(e + "}"))

    def declaration(x):
        listed = F.array_join(F.transform(F.array_sort(x["parameters"]), parameter), ",")
        return F.concat(F.lit(t.start_declaration + "declaration:"), x["name"], F.lit("{description:" + e), x["description"], F.lit(e + ",parameters:{"), listed, F.lit("}}" + t.end_declaration + "\n"))

    usage = f"\nWhen you want to call a function, output in this format:\n{t.start_call}function_name{{param1:{e}value1{e},param2:{e}value2{e}}}{t.end_call}\n"
    head = "You are a model that can do function calling with the following functions.\n\n"
    return F.when(F.size(tools) > 0, F.concat(F.lit(head), F.array_join(F.transform(tools, declaration), ""), F.lit(usage))).otherwise("")


def with_tools_prompt(first_role: Column, first_text: Column, prompt: Column) -> Column:
    """The system message with the tools: before the one there is, else on its own."""
    return F.when(first_role == "system", F.concat(prompt, F.lit("\n\n"), first_text)).otherwise(prompt)


def forced_tools(tools: Column, name: Column) -> Column:
    """Only the tool named (all without a name); an error if there is none of that name."""
    kept = F.filter(tools, lambda x: x["name"] == name)
    chosen = F.when(F.size(kept) > 0, kept).otherwise(F.raise_error(F.concat(F.lit("no such function: "), name)).cast(_type(tools)))
    return F.when(F.coalesce(name, F.lit("")) == "", tools).otherwise(chosen)


def _type(tools: Column) -> str:
    return "array<struct<name:string,description:string,parameters:array<struct<name:string,type:string,description:string,required:boolean>>>>"


def call_texts(text: Column, tokens: ToolTokens = ToolTokens()) -> Column:
    """What stands between call marks, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)\Q{tokens.start_call}\E(.*?)\Q{tokens.end_call}\E"), 1)


def text_without_calls(text: Column, tokens: ToolTokens = ToolTokens()) -> Column:
    return F.regexp_replace(text, rf"(?s)\Q{tokens.start_call}\E.*?\Q{tokens.end_call}\E", "")


def call_arguments(body: str, escape: str) -> dict:
    """Values by key of ``key:value,...``; commas count outside escapes only; values are
    read as JSON where they can be."""
    out: dict = {}
    parts, outside = [""], True
    for k, piece in enumerate(body.split(escape)):
        outside = k % 2 == 0
        if outside:
            first, *more = piece.split(",")
            parts[-1] += first
            parts += more
        else:
            parts[-1] += piece
    for part in parts:
        key, colon, value = part.partition(":")
        key, value = key.strip(), value.strip()
        if colon and key:
            try:
                out[key] = json.loads(value)
            except ValueError:
                out[key] = value
    return out


def parse_call(content: str, tokens: ToolTokens = ToolTokens()) -> tuple[str, str] | None:
    """(name, arguments as JSON) of what stands between call marks; None without a name."""
    name, brace, body = content.partition("{")
    if not brace or not name.strip():
        return None
    return name.strip(), json.dumps(call_arguments(body.removesuffix("}"), tokens.escape), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


class ToolParser:
    """Calls in a text that comes token by token."""

    def __init__(self, tokens: ToolTokens = ToolTokens()):
        self.tokens, self.buffer, self.prose, self.calls = tokens, "", [], []

    def feed(self, token: str) -> list[tuple[str, str]]:
        """Calls that this token completes."""
        self.buffer += token
        new = []
        while (start := self.buffer.find(self.tokens.start_call)) >= 0 and (end := self.buffer.find(self.tokens.end_call, start)) >= 0:
            call = parse_call(self.buffer[start + len(self.tokens.start_call) : end], self.tokens)
            if call:
                new.append(call)
            if start:
                self.prose.append(self.buffer[:start])
            self.buffer = self.buffer[end + len(self.tokens.end_call) :]
        self.calls += new
        return new

    def finish(self) -> tuple[list[tuple[str, str]], str]:
        """All calls, and the text around them."""
        return self.calls, "".join([*self.prose, self.buffer])


#: Parsers of tool calls by name.
PARSERS: dict[str, Callable[[], ToolParser]] = {"tagged": ToolParser}


def tool_parser(name: str) -> ToolParser | None:
    """A parser by name; none for no name, an error for an unknown one."""
    if not name:
        return None
    if name not in PARSERS:
        raise ValueError(f"unknown tool parser: {name}")
    return PARSERS[name]()


def tool_calls(rows: DataFrame, id_col: str = "id", text_col: str = "text", tokens: ToolTokens = ToolTokens()) -> DataFrame:
    """(id, calls array<struct<name, arguments>>, content) of generated texts. Texts
    without a call mark are not parsed."""

    def work(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("name", pa.string()), ("arguments", pa.string())]))
        for batch in batches:
            calls, rest = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                found, content = [], text
                if tokens.start_call in text:
                    parser = ToolParser(tokens)
                    parser.feed(text)
                    found, content = parser.finish()
                calls.append([{"name": n, "arguments": a} for n, a in found])
                rest.append(content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(calls, kind), pa.array(rest, pa.string())], names=["id", "calls", "content"])

    given = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(work, f"id {dict(given.dtypes)['id']}, calls array<struct<name:string,arguments:string>>, content string").withColumnRenamed("id", id_col)


def with_tool_calls(rows: DataFrame, text_col: str = "text", tokens: ToolTokens = ToolTokens()) -> DataFrame:
    """Rows with ``calls`` and ``content`` of their texts, in one pass: what made the texts
    is not run again, and rows of one id stay apart."""
    whole = rows.withColumn("_r", F.struct(*rows.columns))
    return tool_calls(whole, "_r", text_col, tokens).select("_r.*", "calls", "content")


def stream_chunks(generated: DataFrame, id_col: str = "id", tokens_col: str = "tokens", created: int = 0, model_col: str = "model") -> DataFrame:
    """(id, index, data): the events of a streamed answer: a role, a chunk for each token,
    the end, and [DONE]."""
    choice = lambda delta, finish=None: F.to_json(F.struct(
        F.col(id_col).cast("string").alias("id"), F.lit("chat.completion.chunk").alias("object"), F.lit(created).alias("created"), F.col(model_col).alias("model"),
        F.array(F.struct(F.lit(0).alias("index"), delta.alias("delta"), *([F.lit(finish).alias("finish_reason")] if finish else []))).alias("choices")))
    empty = F.struct(F.lit(None).cast("string").alias("content"))
    n = F.size(tokens_col)
    body = generated.select(id_col, model_col, n.alias("_n"), F.posexplode(tokens_col).alias("_i", "_t")).select(
        id_col, (F.col("_i") + 1).alias("index"), choice(F.struct(F.col("_t").alias("content"))).alias("data"))
    head = generated.select(id_col, F.lit(0).alias("index"), choice(F.struct(F.lit("assistant").alias("role"))).alias("data"))
    last = generated.select(id_col, (n + 1).alias("index"), choice(empty, "stop").alias("data"))
    done = generated.select(id_col, (n + 2).alias("index"), F.lit("[DONE]").alias("data"))
    return head.unionByName(body).unionByName(last).unionByName(done).withColumn("data", F.concat(F.lit("data: "), "data", F.lit("\n\n")))


def completion(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows (id, content, calls, stopped, prompt_tokens, completion_tokens) with the answer's
    id, finish reason and usage."""
    from millrace.functions.catalog import random_id

    return rows.withColumns({
        "completion_id": random_id("chatcmpl-", F.col(id_col)),
        "finish_reason": finish_reason(F.col("calls"), F.col("stopped")),
        "total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"),
    })
