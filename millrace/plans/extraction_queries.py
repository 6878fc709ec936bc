"""Queries over token, span and text outputs: entities, relations, answers, prompts, tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import extraction, features, generation
from millrace.plans.registry import query, table

TAGS = ["O", "B-PER", "I-PER", "B-ORGANIZATION", "I-ORGANIZATION"]

#: Token labels of each document in closed form: 24 tokens of 5 bytes.
TOKENS = f"""tok AS (SELECT doc_id, CAST(i AS INTEGER) AS pos, CAST(i * 6 AS INTEGER) AS start, CAST(i * 6 + 5 AS INTEGER) AS "end",
        ({TAGS})[((doc_id * 7 + i * i * 3 + i * 5) % 11) % 5 + 1] AS label, ((doc_id + i * 13) % 50 + 50) / 100.0 AS score FROM documents, range(24) r(i))"""


def _tokens(spark, sf_dir):
    tags = F.array(*[F.lit(x) for x in TAGS])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("pos"))
    return rows.select("doc_id", "pos", (F.col("pos") * 6).alias("start"), (F.col("pos") * 6 + 5).alias("end"),
                       F.get(tags, F.expr("cast(((doc_id * 7 + pos * pos * 3 + pos * 5) % 11) % 5 as int)")).alias("label"), (((F.col("doc_id") + F.col("pos") * 13) % 50 + 50) / 100.0).alias("score"))


@query(f"""WITH t AS (SELECT doc_id, i, [CAST((doc_id * (k + 2) + i * 7 * (k + 1)) % 9 AS DOUBLE) FOR k IN [0, 1, 2]] AS l, CASE WHEN i % 7 = 6 THEN 0 ELSE 1 END AS mask FROM documents, range(12) r(i)),
    s AS (SELECT doc_id, CAST(i AS INTEGER) AS pos, CAST(CASE WHEN i = 5 THEN 0 ELSE i * 4 END AS INTEGER) AS start, CAST(CASE WHEN i = 5 THEN 0 ELSE i * 4 + 3 END AS INTEGER) AS "end", l, list_max(l) AS m FROM t WHERE mask = 1 AND i <> 5)
    SELECT doc_id, pos, start, "end", (['O', 'B-LOC', 'I-LOC'])[list_position(l, m)] AS label, round(1 / list_sum(list_transform(l, lambda x: exp(x - m))), 6) AS score FROM s""")
def r062_token_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos"))
    logits = F.expr("transform(sequence(0, 2), k -> cast((doc_id * (k + 2) + pos * 7 * (k + 1)) % 9 as double))")
    place = lambda add: F.when(F.col("pos") == 5, 0).otherwise(F.col("pos") * 4 + add)
    toks = rows.select("doc_id", "pos", place(0).alias("start"), place(3).alias("end"), F.when(F.col("pos") % 7 == 6, 0).otherwise(1).alias("mask"), logits.alias("logits"))
    return extraction.token_labels(toks, ["O", "B-LOC", "I-LOC"]).withColumn("score", F.round("score", 6))


def _entity_sql(score: str) -> str:
    return f"""WITH {TOKENS},
    k AS (SELECT *, CASE WHEN label = 'O' THEN '' ELSE label[3:] END AS kind FROM tok),
    m AS (SELECT *, label <> 'O' AND (lag(label) OVER w IS NULL OR lag(label) OVER w = 'O' OR label[:2] = 'B-' OR lag(kind) OVER w <> kind) AS b FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    i AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM m)
    SELECT doc_id, arg_min(kind, pos) AS label, min(start) AS start, max("end") AS "end", round({score}, 6) AS score FROM i WHERE label <> 'O' GROUP BY doc_id, island"""


@query(_entity_sql("avg(score)"))
def r063_entities_average(spark, sf_dir):
    return extraction.entities(_tokens(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(_entity_sql("arg_min(score, pos)"))
def r063_entities_first(spark, sf_dir):
    return extraction.entities(_tokens(spark, sf_dir), strategy="first").withColumn("score", F.round("score", 6))


@query(_entity_sql("max(score)"))
def r063_entities_max(spark, sf_dir):
    return extraction.entities(_tokens(spark, sf_dir), strategy="max").withColumn("score", F.round("score", 6))


@query(f"""WITH {TOKENS} SELECT doc_id, label, label[3:] AS kind, CASE label[3:] WHEN 'ORGANIZATION' THEN 'ORG' ELSE label[3:] END AS canonical, start, "end" FROM tok WHERE label <> 'O'""")
def r064_r065_labels(spark, sf_dir):
    rows = _tokens(spark, sf_dir).where("label <> 'O'")
    return rows.select("doc_id", "label", T.label_type(F.col("label")).alias("kind"), T.canonical_label(F.col("label")).alias("canonical"), "start", "end")


@query("""SELECT doc_id, '<<ENT>>' || lang || '<<SEP>><<ENT>>' || source || '<<SEP>>' AS entities, '<<REL>>' || lang || '::in<<SEP>><<REL>>' || lang || '::of<<SEP>><<REL>>' || source || '::in<<SEP>><<REL>>' || source || '::of<<SEP>>' AS relations,
    '<<CLS>>' || lang || '<<SEP>><<CLS>>' || source || '<<SEP>>' AS classes FROM documents""")
def r067_r072_label_prompts(spark, sf_dir):
    labels = F.array("lang", "source")
    both = T.composite_labels(labels, F.array(F.lit("in"), F.lit("of")))
    return table(spark, sf_dir, "documents").select("doc_id", T.label_prompt(labels).alias("entities"), T.label_prompt(both, "relations").alias("relations"), T.label_prompt(labels, "classification").alias("classes"))


WORDS = "list_transform(range(doc_id % 9), lambda i: {'start': CAST(i * 7 AS INTEGER), 'end': CAST(i * 7 + 3 + i % 3 AS INTEGER)})"


def _words(spark, sf_dir):
    words = F.expr("transform(filter(sequence(0, 8), i -> i < doc_id % 9), i -> named_struct('word', concat('w', i), 'start', i * 7, 'end', i * 7 + 3 + i % 3))")
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents)
    SELECT doc_id, CAST(i AS INTEGER) AS first, CAST(j AS INTEGER) AS last, w[i + 1].start AS start, w[j + 1]."end" AS "end" FROM w, range(9) a(i), range(9) b(j) WHERE i <= j AND j < i + 4 AND j < len(w)""")
def r068_span_enumeration(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", F.explode(extraction.spans(F.col("words"), 4)).alias("s")).select("doc_id", "s.*")


KINDS = ["person", "place"]
SPANS = f"""cell AS (SELECT doc_id, {WORDS} AS w, i, d, k, CAST((doc_id * 5 + i * 11 + d * 7 + k * 3) % 17 - 9 AS DOUBLE) / 2 AS logit FROM documents, range(9) a(i), range(3) b(d), range(2) c(k) WHERE i < doc_id % 9),
    scored AS (SELECT doc_id, w[i + 1].start AS start, w[i + d + 1]."end" AS "end", ({KINDS})[k + 1] AS label, 1 / (1 + exp(-logit)) AS score FROM cell WHERE i + d < len(w) AND 1 / (1 + exp(-logit)) >= 0.6)"""


def _grid(spark, sf_dir):
    n = "cast(doc_id % 9 as int) * 6"
    logits = f"transform(filter(sequence(0, 53), x -> x < {n}), x -> cast((doc_id * 5 + (x div 6) * 11 + (x div 2) % 3 * 7 + x % 2 * 3) % 17 - 9 as double) / 2)"
    return _words(spark, sf_dir).select("doc_id", "words", F.array(*[F.lit(k) for k in KINDS]).alias("labels"), F.expr(logits).alias("logits"), F.lit(3).alias("max_width"))


@query(f"""WITH {SPANS} SELECT doc_id, start, "end", label, round(score, 6) AS score FROM scored""")
def r069_span_scores(spark, sf_dir):
    return extraction.score_spans(_grid(spark, sf_dir), 0.6).withColumn("score", F.round("score", 6))


NMS = f"""{SPANS},
    ranked AS (SELECT doc_id, list({{'s': start, 'e': "end", 'l': label, 'c': score}} ORDER BY score DESC, start, "end", label) AS l FROM scored GROUP BY doc_id),
    walk AS (SELECT doc_id, 0 AS i, l[:0] AS kept FROM ranked
        UNION ALL SELECT doc_id, i + 1, CASE WHEN len(list_filter(kept, lambda y: x.s < y.e AND y.s < x.e)) = 0 THEN list_append(kept, x) ELSE kept END
        FROM (SELECT walk.*, l[i + 1] AS x FROM walk JOIN ranked USING (doc_id) WHERE i < len(l))),
    nms AS (SELECT doc_id, unnest(kept) AS x FROM walk JOIN ranked USING (doc_id) WHERE i = len(l)),
    flat AS (SELECT doc_id, x.s AS start, x.e AS "end", x.l AS label, x.c AS score FROM nms)"""


@query(f"""WITH RECURSIVE {NMS} SELECT doc_id, start, "end", label, round(score, 6) AS score FROM flat""")
def r070_r071_flat_nms(spark, sf_dir):
    return extraction.without_overlaps(extraction.score_spans(_grid(spark, sf_dir), 0.6)).withColumn("score", F.round("score", 6))


HEADS = f"""heads AS (SELECT doc_id, w[i + 1].start AS start, w[i + 1]."end" AS "end", CASE WHEN i % 2 = 0 THEN 'person::lives_in' ELSE 'place::near' END AS label, (doc_id % 7 + i) / 10.0 AS score
    FROM (SELECT doc_id, {WORDS} AS w FROM documents), range(3) a(i) WHERE i < len(w))"""


def _heads(spark, sf_dir):
    each = _words(spark, sf_dir).select("doc_id", F.posexplode(F.slice("words", 1, 3)).alias("i", "w"))
    return each.select("doc_id", "w.start", "w.end", F.when(F.col("i") % 2 == 0, "person::lives_in").otherwise("place::near").alias("label"), ((F.col("doc_id") % 7 + F.col("i")) / 10.0).alias("score"))


@query(f"""WITH RECURSIVE {NMS}, {HEADS},
    good AS (SELECT * FROM flat WHERE doc_id IN (SELECT doc_id FROM flat GROUP BY doc_id HAVING count(*) >= 2)),
    named AS (SELECT h.doc_id, h.start, h."end", h.score, split_part(h.label, '::', 2) AS relation, coalesce(g.label, split_part(h.label, '::', 1)) AS kind
              FROM heads h LEFT JOIN good g ON g.doc_id = h.doc_id AND g.start = h.start AND g."end" = h."end")
    SELECT n.doc_id, n.start AS head_start, kind AS head_label, g.start AS tail_start, g.label AS tail_label, relation AS label, round((n.score + g.score) / 2, 6) AS score
    FROM named n JOIN good g ON g.doc_id = n.doc_id AND NOT (n.start < g."end" AND g.start < n."end") WHERE (n.score + g.score) / 2 >= 0.4""")
def r073_r074_relations(spark, sf_dir):
    found = extraction.without_overlaps(extraction.score_spans(_grid(spark, sf_dir), 0.6))
    out = extraction.extract_relations(found, _heads(spark, sf_dir), ["lives_in", "near"], 0.4)
    return out.select("doc_id", F.col("head.start").alias("head_start"), F.col("head.label").alias("head_label"), F.col("tail.start").alias("tail_start"), F.col("tail.label").alias("tail_label"), "label", F.round("score", 6).alias("score"))


@query(f"""WITH {SPANS}, b AS (SELECT doc_id, arg_max({{'s': start, 'e': "end", 'c': score}}, (score, -start, -"end")) AS x FROM scored GROUP BY doc_id)
    SELECT doc_id, coalesce(x.s, 0) AS start, coalesce(x.e, 0) AS "end", round(coalesce(x.c, 0), 6) AS score FROM documents LEFT JOIN b USING (doc_id)""")
def r075_answers(spark, sf_dir):
    out = extraction.answers(table(spark, sf_dir, "documents").select("doc_id"), extraction.score_spans(_grid(spark, sf_dir), 0.6))
    return out.select("doc_id", "answer.start", "answer.end", F.round("answer.score", 6).alias("score"))


RAW = """(SELECT doc_id, lang, source, CASE doc_id % 3 WHEN 0 THEN '<s><triplet> ' || source || ' <subj> ' || lang || ' <obj> written in <triplet> broken <subj> x <triplet> ' || lang || ' <subj> ' || source || ' <obj> used by</s>'
    WHEN 1 THEN source || '  ' || lang || '  written in  left over' ELSE '<pad>' END AS raw FROM documents)"""


def _generated(spark, sf_dir):
    raw = F.expr("case doc_id % 3 when 0 then concat('<s><triplet> ', source, ' <subj> ', lang, ' <obj> written in <triplet> broken <subj> x <triplet> ', lang, ' <subj> ', source, ' <obj> used by</s>') when 1 then concat(source, '  ', lang, '  written in  left over') else '<pad>' end")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("From "), F.upper("source"), F.lit(" it is")).alias("text"), raw.alias("raw")).withColumn("triplets", extraction.triplets(F.col("raw")))


TRIPLETS = f"""trip AS (SELECT doc_id, 'From ' || upper(source) || ' it is' AS text, source AS s, lang AS o, 'written in' AS r FROM {RAW} WHERE doc_id % 3 < 2
    UNION ALL SELECT doc_id, 'From ' || upper(source) || ' it is', lang, source, 'used by' FROM {RAW} WHERE doc_id % 3 = 0)"""


@query(f"WITH {TRIPLETS} SELECT doc_id, s AS subject, o AS object, r AS relation FROM trip")
def r077_r078_triplets(spark, sf_dir):
    return _generated(spark, sf_dir).select("doc_id", F.explode("triplets").alias("t")).select("doc_id", "t.*")


@query(f"""WITH {TRIPLETS}, n AS (SELECT DISTINCT doc_id, text AS t, unnest([s, o]) AS text FROM trip)
    SELECT doc_id, text, 'ENTITY' AS label, CAST(instr(lower(t), lower(text)) - 1 AS INTEGER) AS start, CAST(CASE WHEN instr(lower(t), lower(text)) = 0 THEN -1 ELSE instr(lower(t), lower(text)) - 1 + strlen(text) END AS INTEGER) AS "end" FROM n""")
def r079_triplet_entities(spark, sf_dir):
    return extraction.triplet_entities(_generated(spark, sf_dir))


@query(f"""WITH {TRIPLETS} SELECT doc_id, s AS head, CAST(instr(lower(text), lower(s)) - 1 AS INTEGER) AS head_start, o AS tail, r AS label FROM trip""")
def r079_triplet_relations(spark, sf_dir):
    return extraction.triplet_relations(_generated(spark, sf_dir)).select("doc_id", F.col("head.text").alias("head"), F.col("head.span.start").alias("head_start"), F.col("tail.text").alias("tail"), "label")


@query(f"WITH {TRIPLETS} SELECT source, CAST(count(t.doc_id) AS BIGINT) AS triplets FROM documents d LEFT JOIN trip t USING (doc_id) GROUP BY source")
def r080_counters(spark, sf_dir):
    rows = _generated(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(F.sum(F.size("triplets")).alias("triplets"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'tokens' WHEN doc_id % 2 = 0 THEN 'relations' WHEN doc_id % 5 = 0 THEN 'labels' ELSE 'default_labels' END AS served,
    CASE WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN ['relations'] ELSE ['relations', 'zeroshot'] END WHEN doc_id % 2 = 0 THEN ['relations', 'answers'] ELSE ['answers'] END AS capabilities FROM documents""")
def r081_r154_recognise_dispatch(spark, sf_dir):
    none = F.array().cast("array<string>")
    kind = F.expr("case doc_id % 3 when 0 then 'tokens' when 1 then 'triplets' else 'spans' end")
    declared = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("relations"))).otherwise(none)
    rows = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), declared.alias("m"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("x"))).otherwise(none).alias("labels"))
    return rows.select("doc_id", extraction.recognise_route(F.col("kind"), F.col("m"), F.col("labels")).alias("served"), extraction.capabilities(F.col("kind"), F.col("m"), F.array(F.lit("answers"))).alias("capabilities"))


@query("SELECT label, CAST(strlen(label) AS DOUBLE) AS size, CAST(count(*) AS BIGINT) AS uses FROM (SELECT lang AS label FROM documents UNION ALL SELECT source FROM documents) GROUP BY label")
def r076_label_embeddings(spark, sf_dir):
    from millrace.operators import scorers, state

    labels = table(spark, sf_dir, "documents").select(F.explode(F.array("lang", "source")).alias("label"))
    from millrace.operators.tokens import run_model

    out = state.compute_once(labels, F.col("label"), lambda d: run_model(d, scorers.length_embedder, ["label"], "v", "array<double>"))
    return out.groupBy("label").agg(F.first(F.get("v", F.lit(0))).alias("size"), F.count("*").alias("uses"))


# --- generation -------------------------------------------------------------


@query("""SELECT conv_id, string_agg(CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE '' END || text || chr(10) || chr(10), '' ORDER BY turn, role, text) || 'Assistant: ' AS prompt,
    CAST(sum(strlen(text) // 4) AS BIGINT) AS prompt_tokens FROM conversations GROUP BY conv_id""")
def r094_r096_chat_prompts(spark, sf_dir):
    return generation.chat_prompts(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || '!' ELSE text END AS content FROM conversations""")
def r095_message_text(spark, sf_dir):
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.when(F.col("turn") % 2 == 0, F.array(part("text", F.col("text")), part("image_url", F.lit("x")), part("text", F.lit("!")))).otherwise(F.array().cast("array<struct<type:string,text:string>>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", generation.message_text(parts, F.col("text")).alias("content"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 256 ELSE CAST(doc_id % 5 AS INTEGER) END AS max_tokens, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE CAST((doc_id % 3) / 2 AS DOUBLE) END AS temperature,
    1.0 AS top_p, CASE WHEN doc_id % 2 = 0 THEN 50 ELSE 1 END AS top_k, doc_id % 3 <> 0 OR doc_id % 2 = 1 AS do_sample FROM documents""".replace("1.0 AS top_p", "CAST(1 AS DOUBLE) AS top_p").replace("THEN 1.0", "THEN CAST(1 AS DOUBLE)"))
def r097_options(spark, sf_dir):
    k = F.col("doc_id")
    o = generation.options((k % 5).cast("int"), (k % 3) / 2, F.lit(0.0), (k % 2).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", o.alias("o")).select("doc_id", "o.*")


CALLS = """(SELECT doc_id, 'before ' || CASE WHEN doc_id % 3 > 0 THEN '<start_function_call>find{q:<escape>' || source || ', x<escape>,n:' || doc_id || '}<end_function_call>' ELSE '' END || ' mid '
    || CASE WHEN doc_id % 3 > 1 THEN '<start_function_call>stop{}<end_function_call>' ELSE '' END || 'after' AS text, source FROM documents)"""


def _calls(spark, sf_dir):
    text = F.expr("concat('before ', if(doc_id % 3 > 0, concat('<start_function_call>find{q:<escape>', source, ', x<escape>,n:', doc_id, '}<end_function_call>'), ''), ' mid ', if(doc_id % 3 > 1, '<start_function_call>stop{}<end_function_call>', ''), 'after')")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("text"))


@query(f"""SELECT doc_id AS id, regexp_extract_all(text, '<start_function_call>(.*?)<end_function_call>', 1) AS calls, regexp_replace(text, '<start_function_call>.*?<end_function_call>', '', 'g') AS content FROM {CALLS}""")
def r100_call_texts(spark, sf_dir):
    return _calls(spark, sf_dir).select("id", generation.call_texts(F.col("text")).alias("calls"), generation.text_without_calls(F.col("text")).alias("content"))


@query(f"""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'find' ELSE 'find,stop' END AS names,
    CASE WHEN doc_id % 3 > 0 THEN '{{"n":' || doc_id || ',"q":"' || source || ', x"}}' ELSE '' END AS arguments, CASE WHEN doc_id % 3 > 0 THEN 'tool_calls' ELSE 'stop' END AS finish_reason FROM {CALLS}""")
def r098_r101_r147_tool_calls(spark, sf_dir):
    out = generation.tool_calls(_calls(spark, sf_dir))
    return out.select("id", F.array_join(F.transform("calls", lambda c: c["name"]), ",").alias("names"), F.coalesce(F.get("calls", F.lit(0))["arguments"], F.lit("")).alias("arguments"), generation.finish_reason(F.col("calls"), F.lit("stop")).alias("finish_reason"))


def _tools(name, need):
    parameter = lambda n: F.struct(F.lit(n).alias("name"), F.lit("string").alias("type"), F.lit(f"the {n}").alias("description"), F.lit(n == "b").alias("required"))
    tool = lambda n: F.struct(n.alias("name"), F.lit("does it").alias("description"), F.array(parameter("b"), parameter("a")).alias("parameters"))
    return F.array(tool(name), tool(need))


@query("""SELECT doc_id, 'You are a model that can do function calling with the following functions.' || chr(10) || chr(10) || d || chr(10) || 'When you want to call a function, output in this format:' || chr(10)
    || '<start_function_call>function_name{param1:<escape>value1<escape>,param2:<escape>value2<escape>}<end_function_call>' || chr(10) AS prompt
    FROM (SELECT doc_id, '<start_function_declaration>declaration:' || lang || '{description:<escape>does it<escape>,parameters:{a:{type:string,description:<escape>the a<escape>},b:{type:string,required:true,description:<escape>the b<escape>}}}<end_function_declaration>' || chr(10) AS d FROM documents)""")
def r099_r102_tools_prompt(spark, sf_dir):
    tools = generation.forced_tools(_tools(F.col("lang"), F.lit("other")), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", generation.tools_prompt(tools).alias("prompt"))


@query("""SELECT doc_id AS model, CASE doc_id % 3 WHEN 0 THEN '<a>' WHEN 1 THEN '[start_function_call]' ELSE '<start_function_call>' END AS start_call, CASE doc_id % 3 WHEN 0 THEN '<b>' WHEN 1 THEN '[end_function_call]' ELSE '<end_function_call>' END AS end_call FROM documents""")
def r148_tool_tokens(spark, sf_dir):
    first = F.expr("""if(doc_id % 3 = 0, '{"start_function_call":"<a>","end_function_call":"<b>"}', '{"eos_token":"x"}')""")
    second = F.expr("""if(doc_id % 3 = 1, '{"added_tokens_decoder":{"7":{"content":"[start_function_call]"},"8":{"content":"[end_function_call]"}}}', '{}')""")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("model"), first.alias("special_tokens_map"), second.alias("tokenizer_config"))
    return generation.tool_tokens(rows).select("model", "tokens.start_call", "tokens.end_call")


@query("""WITH t AS (SELECT doc_id AS id, lang AS model, string_split(replace(replace(text, chr(10), ' '), '"', ''), ' ') AS w FROM documents),
    e AS (SELECT id, 0 AS index, '{"id":"' || id || '","object":"chat.completion.chunk","created":0,"model":"' || model || '","choices":[{"index":0,"delta":{"role":"assistant"}}]}' AS d FROM t
        UNION ALL SELECT id, CAST(i + 1 AS INTEGER), '{"id":"' || id || '","object":"chat.completion.chunk","created":0,"model":"' || model || '","choices":[{"index":0,"delta":{"content":"' || w[i + 1] || '"}}]}' FROM t, unnest(range(len(w))) r(i)
        UNION ALL SELECT id, CAST(len(w) + 1 AS INTEGER), '{"id":"' || id || '","object":"chat.completion.chunk","created":0,"model":"' || model || '","choices":[{"index":0,"delta":{},"finish_reason":"stop"}]}' FROM t
        UNION ALL SELECT id, CAST(len(w) + 2 AS INTEGER), '[DONE]' FROM t)
    SELECT id, index, 'data: ' || d || chr(10) || chr(10) AS data FROM e""")
def r016_stream_chunks(spark, sf_dir):
    clean = F.split(F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('"'), F.lit("")), " ", -1)
    return generation.stream_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("model"), clean.alias("tokens")))


@query("""SELECT doc_id AS id, 'chatcmpl-' || sha256(CAST(doc_id AS VARCHAR))[:24] AS completion_id, 'length' AS finish_reason, CAST(doc_id % 100 + 7 AS BIGINT) AS total_tokens FROM documents""")
def r146_completions(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array().cast("array<string>").alias("calls"), F.lit("length").alias("stopped"), (F.col("doc_id") % 100).alias("prompt_tokens"), F.lit(7).alias("completion_tokens"))
    return generation.completion(rows).select("id", "completion_id", "finish_reason", "total_tokens")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [2] ELSE [5, CAST(doc_id % 7 AS INTEGER)] END AS ids FROM documents""")
def r165_start_tokens(spark, sf_dir):
    prompt = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(5), (F.col("doc_id") % 7).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", generation.start_tokens(prompt, 2).alias("ids"))


@query("""SELECT doc_id AS id, source AS company, 'deep' AS item_name, CAST(doc_id AS VARCHAR) AS item_price, CAST(3 AS INTEGER) AS n FROM documents""")
def r109_field_tree(spark, sf_dir):
    text = F.concat(F.lit("<s_company>x</s_company><s_company> "), "source", F.lit("</s_company><s_open><s_item><s_name>deep</s_name><s_price>"), F.col("doc_id").cast("string"), F.lit("</s_price></s_item>"))
    out = features.parse_fields(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("text")))
    f = F.col("fields")
    return out.select("id", f["company"].alias("company"), f["item.name"].alias("item_name"), f["item.price"].alias("item_price"), F.size(F.map_keys(f)).alias("n"))


@query("""SELECT doc_id AS path, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, source AS kind FROM documents""")
def r107_read_documents(spark, sf_dir):
    images = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.encode(F.concat("source", F.lit("|"), "text"), "utf-8").alias("content"))
    model = lambda: lambda batch: [f"<s_read><s_kind>{c.decode().partition('|')[0]}</s_kind><s_text>{c.decode().partition('|')[2]}</s_text></s_read>" for (c,) in batch]
    out = features.read_documents(images, model)
    return out.select("path", F.col("fields")["text"].alias("text"), F.col("fields")["kind"].alias("kind"))


@query("""SELECT doc_id AS path, 'heard ' || doc_id % 7 AS text FROM documents""")
def r113_transcribe(spark, sf_dir):
    sounds = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 7 + 1).cast("int")), lambda i: i / 10).alias("sound"))
    model = lambda: lambda batch: [f"<|en|><|0.00|> heard {len(s) - 1}<|end|>" for (s,) in batch]
    return features.transcribe(sounds, model)
