"""Queries over texts: sections, chunks, tokens, clean-up of model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import chunking, tokens
from millrace.plans.registry import query, table

TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
COUNT = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]'))"
SECTIONS = rf"""
    cut AS (SELECT doc_id, text, CASE WHEN len(string_split(text, chr(10) || chr(10))) > 1 THEN string_split(text, chr(10) || chr(10))
                WHEN len(string_split(text, chr(10))) > 1 THEN string_split(text, chr(10))
                ELSE list_transform(string_split(text, '. '), lambda x, i: CASE WHEN i < len(string_split(text, '. ')) THEN x || '.' ELSE x END) END AS p
            FROM documents WHERE text <> ''),
    parts AS MATERIALIZED (SELECT doc_id, text, list_filter(list_transform(p, lambda x: {TRIM.format("x")}), lambda x: x <> '') AS p FROM cut)"""


@query(f"WITH {SECTIONS} SELECT doc_id, CAST(unnest(range(len(p))) AS INTEGER) AS pos, unnest(p) AS section FROM parts")
def r017_r018_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.trimmed_sections(F.col("text"))).alias("pos", "section"))


def chunk_sql(target: int, overlap: int, most: int) -> str:
    n = 4 * overlap
    tail = f"CASE WHEN strlen(body) <= {n} THEN body ELSE right(body, CAST(list_max(list_filter(range({n} + 1), lambda k: strlen(right(body, CAST(k AS INTEGER))) <= {n})) AS INTEGER)) END"
    over = tail if overlap else "''"
    return rf"""
    WITH RECURSIVE {SECTIONS},
    step AS (
        SELECT doc_id, 0 AS i, '' AS cur, 0 AS start, 0 AS tok, 0 AS k, CAST(NULL AS VARCHAR) AS etext, 0 AS estart FROM parts
        UNION ALL
        SELECT doc_id, i + 1,
               CASE WHEN before = '' THEN s ELSE before || chr(10) || chr(10) || s END,
               CAST(CASE WHEN f THEN start + strlen(body) + 2 ELSE start END AS INTEGER),
               CAST(CASE WHEN f THEN {COUNT.format("over")} ELSE tok END + n AS INTEGER),
               k + CASE WHEN f THEN 1 ELSE 0 END, CASE WHEN f THEN body END, start
        FROM (SELECT *, CASE WHEN f THEN CASE WHEN over = '' THEN '' ELSE over || ' ' END ELSE cur END AS before
              FROM (SELECT *, CASE WHEN f THEN {over} ELSE '' END AS over
                    FROM (SELECT step.*, p[i + 1] AS s, {COUNT.format("p[i + 1]")} AS n, {TRIM.format("cur")} AS body,
                                 tok > 0 AND tok + {COUNT.format("p[i + 1]")} > {target} AS f
                          FROM step JOIN parts USING (doc_id) WHERE i < len(p) AND k < {most})))),
    chunks AS (
        SELECT doc_id, k - 1 AS chunk_id, etext AS text, estart AS start_char FROM step WHERE etext IS NOT NULL
        UNION ALL
        SELECT doc_id, k, {TRIM.format("cur")}, start FROM step JOIN parts USING (doc_id) WHERE i = len(p) AND k < {most} AND {TRIM.format("cur")} <> '')
    SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, text, CAST(start_char AS INTEGER) AS start_char, CAST(start_char + strlen(text) AS INTEGER) AS end_char FROM chunks
    UNION ALL
    SELECT doc_id, 0, {TRIM.format("text")}, 0, CAST(strlen(text) AS INTEGER) FROM parts WHERE len(p) = 0"""


@query(chunk_sql(120, 0, 50))
def r019_r021_r022_chunk_packing(spark, sf_dir):
    return chunking.chunk_fixed(table(spark, sf_dir, "documents"), chunking.ChunkConfig(target_tokens=120, overlap_tokens=0))


@query(chunk_sql(200, 20, 50))
def r020_chunk_overlap(spark, sf_dir):
    return chunking.chunk_fixed(table(spark, sf_dir, "documents"), chunking.ChunkConfig(target_tokens=200, overlap_tokens=20))


@query(chunk_sql(300, 50, 5))
def r024_chunk_request(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return chunking.chunk_request(docs, target_tokens=300, overlap_tokens=7, separator="#", max_chunks=5)


@query("""SELECT doc_id, model, CASE WHEN model = 'm1' THEN 'm1' ELSE 'fixed-bert-tokenizer' END AS model_used,
                 CASE WHEN model = 'm1' THEN 'model' ELSE 'fixed' END AS chunker
          FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'fixed-bert-tokenizer' WHEN 1 THEN 'fixed-bpe-tokenizer' WHEN 2 THEN 'm1' ELSE 'm2' END AS model FROM documents)""")
def r025_chunk_dispatch(spark, sf_dir):
    model = F.expr("case doc_id % 4 when 0 then 'fixed-bert-tokenizer' when 1 then 'fixed-bpe-tokenizer' when 2 then 'm1' else 'm2' end")
    return chunking.dispatch(table(spark, sf_dir, "documents").select("doc_id", model.alias("model")), spark.createDataFrame([("m1",)], "name string"))


@query(f"SELECT doc_id, CAST({COUNT.format('text')} AS INTEGER) AS tokens, CAST(strlen(text) // 4 AS INTEGER) AS estimate FROM documents")
def r026_r027_r041_token_counts(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.count_tokens(text).alias("tokens"), T.estimate_tokens(text).alias("estimate"))


def _predicted(spark, sf_dir):
    end = "cast(octet_length(left(text, cast((i + 1) * char_length(text) div 30 as int))) as int)"
    token = f"named_struct('logits', array(cast((i * 7 + doc_id) % 5 as double), cast((i * 3 + doc_id) % 4 as double)), 'end', {end})"
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(f"transform(sequence(0, 29), i -> {token})").alias("tokens"))


POSITIONS = """
    tok AS (SELECT doc_id, text, i, (i * 7 + doc_id) % 5 AS a, (i * 3 + doc_id) % 4 AS b, CAST((i + 1) * length(text) // 30 AS INTEGER) AS c
            FROM documents, range(30) r(i) WHERE text <> ''),
    pos AS (SELECT doc_id, text, list_sort(list(c) FILTER (b > a AND exp(b) / (exp(a) + exp(b)) >= 0.7 AND c > 0 AND strlen(left(text, c)) < strlen(text))) AS p
            FROM tok GROUP BY doc_id, text)"""


@query(f"WITH {POSITIONS} SELECT doc_id, list_transform(coalesce(p, []), lambda c: CAST(strlen(left(text, c)) AS INTEGER)) AS positions FROM pos")
def r028_boundary_positions(spark, sf_dir):
    at = chunking.boundary_positions(F.col("tokens"), ["O", "B-SEP"], F.octet_length("text"), 0.7)
    return _predicted(spark, sf_dir).where("text <> ''").select("doc_id", at.alias("positions"))


SPLIT = rf"""
    walk AS (
        SELECT doc_id, 0 AS i, 0 AS s, CAST([] AS STRUCT(s INTEGER, e INTEGER)[]) AS cuts FROM pos
        UNION ALL
        SELECT doc_id, i + 1, CASE WHEN f THEN c ELSE s END, CASE WHEN f THEN list_append(cuts, {{'s': s, 'e': c}}) ELSE cuts END
        FROM (SELECT walk.*, p[i + 1] AS c, p[i + 1] > s AND strlen({TRIM.format("substr(text, s + 1, p[i + 1] - s)")}) >= 50 AS f
              FROM walk JOIN pos USING (doc_id) WHERE i < len(coalesce(p, [])))),
    ended AS (
        SELECT doc_id, text, CAST(length(text) AS INTEGER) AS n, s, cuts, strlen({TRIM.format("substr(text, s + 1)")}) AS rest
        FROM walk JOIN pos USING (doc_id) WHERE i = len(coalesce(p, []))),
    final AS (
        SELECT doc_id, text, CASE WHEN len(c) > 0 THEN c ELSE [{{'s': 0, 'e': n}}] END AS c FROM (
            SELECT *, CASE WHEN s >= n OR rest = 0 THEN cuts
                           WHEN rest < 50 AND len(cuts) > 0 THEN list_append(cuts[:-2], {{'s': cuts[-1].s, 'e': n}})
                           ELSE list_append(cuts, {{'s': s, 'e': n}}) END AS c FROM ended)),
    pieces AS (SELECT doc_id, text AS t, generate_subscripts(c, 1) - 1 AS k, unnest(c) AS x FROM final),
    split AS (SELECT doc_id, k, {TRIM.format("substr(t, x.s + 1, x.e - x.s)")} AS text, CAST(strlen(left(t, x.s)) AS INTEGER) AS a, CAST(strlen(left(t, x.e)) AS INTEGER) AS b FROM pieces)"""


@query(f"WITH RECURSIVE {POSITIONS}, {SPLIT} SELECT doc_id, CAST(k AS INTEGER) AS chunk_id, text, a AS start_char, b AS end_char FROM split")
def r029_r031_predicted_chunks(spark, sf_dir):
    return chunking.chunk_predicted(_predicted(spark, sf_dir), ["O", "B-SEP"], 0.7, 50)


@query(rf"""WITH RECURSIVE {POSITIONS}, {SPLIT},
    listed AS (SELECT doc_id, list({{'t': text, 'a': a, 'b': b, 'n': strlen(text) // 4}} ORDER BY k) AS l FROM split GROUP BY doc_id),
    fold AS (
        SELECT doc_id, 1 AS i, l[1].t AS t, l[1].a AS a, l[1].b AS b, l[1].n AS tok, 0 AS k, CAST(NULL AS VARCHAR) AS et, 0 AS ea, 0 AS eb FROM listed
        UNION ALL
        SELECT doc_id, i + 1, CASE WHEN f THEN x.t ELSE t || chr(10) || chr(10) || x.t END, CASE WHEN f THEN x.a ELSE a END, x.b,
               CASE WHEN f THEN x.n ELSE tok + x.n END, k + CASE WHEN f THEN 1 ELSE 0 END, CASE WHEN f THEN t END, a, b
        FROM (SELECT fold.*, l[i + 1] AS x, tok > 0 AND tok + l[i + 1].n > 150 AS f FROM fold JOIN listed USING (doc_id) WHERE i < len(l)))
    SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk_id, et AS text, ea AS start_char, eb AS end_char FROM fold WHERE et IS NOT NULL
    UNION ALL SELECT doc_id, CAST(k AS INTEGER), t, a, b FROM fold JOIN listed USING (doc_id) WHERE i = len(l)""")
def r030_target_aggregation(spark, sf_dir):
    return chunking.chunk_predicted(_predicted(spark, sf_dir), ["O", "B-SEP"], 0.7, 50, target_tokens=150)


@query("""SELECT doc_id, sha256('fixed-bert-tokenizer:500:50:' || chr(10) || chr(10) || ':50:0.500' || sha256(text)) AS key FROM documents""")
def r120_chunk_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.chunk_key(F.col("text"), chunking.ChunkConfig()).alias("key"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+|[ \t\n\r]+') AS p FROM documents),
    e AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM w),
    o AS (SELECT doc_id, x, k, CAST(sum(strlen(x)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS b FROM e)
    SELECT doc_id, count(*) AS words, CAST(sum(b - strlen(x)) AS BIGINT) AS starts, CAST(sum(b) AS BIGINT) AS ends, CAST(sum(strlen(x)) AS BIGINT) AS bytes
    FROM o WHERE NOT regexp_matches(x, '[ \t\n\r]') GROUP BY doc_id""")
def r066_word_spans(spark, sf_dir):
    each = tokens.word_spans(table(spark, sf_dir, "documents")).select("doc_id", F.explode("words").alias("w"))
    return each.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum("w.start").alias("starts"), F.sum("w.end").alias("ends"), F.sum(F.octet_length("w.word")).alias("bytes"))


IDS = "list_transform(range(doc_id % 37), lambda i: CAST((i * 13 + doc_id) % 1000 + 3 AS INTEGER))"


def _ids(spark, sf_dir):
    ids = F.expr("transform(filter(sequence(0, 36), i -> i < doc_id % 37), i -> cast((i * 13 + doc_id) % 1000 + 3 as int))")
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 25).alias("batch"), ids.alias("ids"))


@query(f"""WITH d AS (SELECT doc_id, doc_id % 25 AS batch, ({IDS})[:24] AS ids FROM documents),
    m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS n FROM d)
    SELECT doc_id, list_resize(ids, n, 9) AS ids, list_resize(list_transform(ids, lambda x: 1), n, 0) AS mask, CAST(len(ids) AS INTEGER) AS length FROM m""")
def r037_encode_batch(spark, sf_dir):
    return tokens.pad_batches(_ids(spark, sf_dir), "batch", pad_id=9, max_length=24).select("doc_id", "encoded.*")


@query(f"""WITH d AS (SELECT doc_id, ([1] || ({IDS}) || [2] || ({IDS})[:5] || [2])[:30] AS ids FROM documents)
    SELECT doc_id, list_transform(ids, lambda x: CAST(x AS INTEGER)) AS ids,
           list_transform(ids, lambda x, i: CASE WHEN list_position(ids, 2) > 0 AND i >= list_position(ids, 2) THEN 1 ELSE 0 END) AS types FROM d""")
def r039_r040_encode_pair(spark, sf_dir):
    return _ids(spark, sf_dir).select("doc_id", tokens.pair(F.col("ids"), F.slice("ids", 1, 5), 1, 2, 30).alias("p")).select("doc_id", "p.*")


@query(f"SELECT doc_id, CAST(list_min(list_filter({tokens.shape_buckets(600)}, lambda b: b >= doc_id % 513 + 1)) AS INTEGER) AS bucket FROM documents")
def r042_shape_bucket(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.shape_bucket(F.col("doc_id") % 513 + 1, 600).alias("bucket"))


# --- clean-up ---------------------------------------------------------------


@query(rf"""WITH d AS (SELECT doc_id, '  <s_cord-v' || doc_id % 3 || '> ' || text || ' </s_cord-v2>' || CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE '' END AS raw FROM documents),
    a AS (SELECT doc_id, {TRIM.format("regexp_replace(" + TRIM.format("raw") + ", '^<s_[a-zA-Z0-9_-]+>', '')")} AS x FROM d)
    SELECT doc_id, {TRIM.format("regexp_replace(x, '</s_[a-zA-Z0-9_-]+>$', '')")} AS clean FROM a""")
def r108_strip_task(spark, sf_dir):
    raw = F.expr("concat('  <s_cord-v', doc_id % 3, '> ', text, ' </s_cord-v2>', if(doc_id % 2 = 0, ' ', ''))")
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_task(raw).alias("clean"))


@query(rf"""SELECT doc_id, '<s_docvqa><s_question>' || text || '</s_question><s_answer>' AS prompt,
    {TRIM.format("split_part(' ' || text || ' </s_answer></s_docvqa>', '</s_answer>', 1)")} AS answer FROM documents""")
def r110_document_answers(spark, sf_dir):
    answer = T.document_answer(F.concat(F.lit(" "), F.col("text"), F.lit(" </s_answer></s_docvqa>")))
    return table(spark, sf_dir, "documents").select("doc_id", T.document_question(F.col("text")).alias("prompt"), answer.alias("answer"))


@query(r"""SELECT item_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(x, '. ', '.'), ', ', ''), '^\s+|\s+$', '', 'g'),
           '([a-z.!?])([A-Z])', '\1' || chr(10) || '\2', 'g'), '([a-z.!?])([A-Z])', '\1' || chr(10) || '\2', 'g'), 'zz', 'zz') AS lines
    FROM (SELECT item_id, regexp_replace(text, '[^\x00-\x7f]', 'e', 'g') AS x FROM benchmark)""")
def r111_recover_lines(spark, sf_dir):
    run = F.replace(F.replace(F.regexp_replace("text", r"[^\x00-\x7f]", "e"), F.lit(". "), F.lit(".")), F.lit(", "), F.lit(""))
    return table(spark, sf_dir, "benchmark").select("item_id", T.recover_lines(run).alias("lines"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<OCR>' WHEN 1 THEN '<OD>' WHEN 2 THEN '<CAPTION_TO_PHRASE_GROUNDING>' END AS task,
    CASE doc_id % 4 WHEN 0 THEN 'What is the text in the image?' WHEN 1 THEN 'Locate the objects with category name in the image.' WHEN 2 THEN '<CAPTION_TO_PHRASE_GROUNDING>' ELSE '<unknown>' END AS prompt,
    '<CAPTION_TO_PHRASE_GROUNDING>' || text AS grounding FROM documents""")
def r112_r166_reader_tasks(spark, sf_dir):
    name = F.expr("case doc_id % 4 when 0 then '<ocr>' when 1 then '<OD>' when 2 then '<grounding>' else '<unknown>' end")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", name.alias("n")).withColumn("task", T.reader_task(F.col("n")))
    return docs.select("doc_id", "task", T.reader_prompt(F.coalesce("task", "n")).alias("prompt"), T.grounding_prompt(F.col("text")).alias("grounding"))


@query(rf"""SELECT doc_id, {TRIM.format("replace(text, '<|', '') || 'x ' || text")} AS text FROM documents""")
def r114_clean_transcript(spark, sf_dir):
    raw = F.concat(F.lit(" <|en|> <|0.00|> "), F.col("text"), F.lit("<|1.5|>x<|2.0|> "), F.col("text"), F.lit(" <|end|>"))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_transcript(raw).alias("text"))


@query("""SELECT doc_id, 'generate question: <hl> ' || lang || ' <hl> ' || text AS prompt FROM documents""")
def r092_question_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.question_prompt(F.col("lang"), F.col("text")).alias("prompt"))


@query()
def r036_r038_encode_spans(spark, sf_dir):
    import public_tokenizers

    out = tokens.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.size("ids").alias("tokens"), F.try_element_at("spans", F.lit(-1))["end"].alias("last_end"))  # null of a text without tokens
