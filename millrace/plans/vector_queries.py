"""Queries over vectors, logits and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vector as V
from millrace.operators import generation, scorers, scoring, tokens
from millrace.plans.registry import query, table
from millrace.sources import vectors

ROUND = "list_transform({}, lambda x: round(x, 6))"


def rounded(c):
    return F.transform(c, lambda x: V.rounded(x, 6))


HIDDEN = "list_transform(range(4), lambda t: list_transform(embedding[:8], lambda x: CAST(x AS DOUBLE) * (t + 1) - vec_id % 3 * 0.1 * t))"
MASK = "list_transform(range(4), lambda t: CASE WHEN vec_id % 5 = 4 THEN 0 WHEN t <= vec_id % 4 THEN 1 ELSE 0 END)"


def _hidden(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.expr("transform(sequence(0, 3), t -> transform(slice(embedding, 1, 8), x -> cast(x as double) * (t + 1) - cast(vec_id % 3 as double) * 0.1D * t))").alias("h"),
        F.expr("transform(sequence(0, 3), t -> case when vec_id % 5 = 4 then 0 when t <= vec_id % 4 then 1 else 0 end)").alias("m"))


@query(f"""WITH d AS (SELECT vec_id, {HIDDEN} AS h, {MASK} AS m FROM embeddings),
    e AS (SELECT vec_id, h, m, range(1, 9) AS j FROM d)
    SELECT vec_id, {ROUND.format("list_transform(j, lambda k: CASE WHEN list_sum(m) = 0 THEN 0 ELSE list_sum(list_transform(list_zip(h, m), lambda t: t[1][k] * t[2])) / list_sum(m) END)")} AS mean,
           {ROUND.format("h[1]")} AS first,
           {ROUND.format("list_transform(j, lambda k: coalesce(list_max(list_filter(list_transform(list_zip(h, m), lambda t: CASE WHEN t[2] = 1 THEN t[1][k] END), lambda x: x IS NOT NULL)), -1e9))")} AS greatest FROM e""")
def r043_r044_r045_pooling(spark, sf_dir):
    h, m = F.col("h"), F.col("m")
    return _hidden(spark, sf_dir).select("vec_id", rounded(V.mean_pool(h, m)).alias("mean"), rounded(V.first_pool(h)).alias("first"), rounded(V.max_pool(h, m)).alias("greatest"))


@query(f"""SELECT vec_id, {ROUND.format("list_transform(embedding, lambda x: CASE WHEN n = 0 THEN 0 ELSE CAST(x AS DOUBLE) / n END)")} AS unit, round(n, 6) AS norm
    FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)""")
def r046_l2_normalize(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(V.l2_normalize(v)).alias("unit"), F.round(V.norm(v), 6).alias("norm"))


@query("""SELECT doc_id, [round(CAST(strlen(text) AS DOUBLE) / n, 6), round(CAST(length(text) AS DOUBLE) / n, 6), round(1.0 / n, 6)] AS embedding
    FROM (SELECT doc_id, text, sqrt(CAST(strlen(text) AS DOUBLE) ** 2 + CAST(length(text) AS DOUBLE) ** 2 + 1) AS n FROM documents)""")
def r047_r121_embed_texts(spark, sf_dir):
    out = tokens.embed(table(spark, sf_dir, "documents").select("doc_id", "text"), scorers.length_embedder)
    return out.select("doc_id", rounded(F.col("embedding")).alias("embedding"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [CAST(strlen(text) AS DOUBLE), CAST(length(text) AS DOUBLE), 1.0] ELSE [2.0 * strlen(text), 0.0] END AS embedding FROM documents""")
def r048_embed_mixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "text").otherwise("image").alias("modality"), F.col("text").alias("data"))
    image = lambda: lambda batch: [[2.0 * len((t or "").encode()), 0.0] for (t,) in batch]
    return tokens.embed_mixed(docs, {"text": scorers.length_embedder, "image": image}).select("doc_id", "embedding")


@query("""SELECT vec_id, [round(e[1] * 0.5 + e[2] * -1.0 + e[3] * 2.0, 6), round(e[4] + e[5], 6)] AS projected
    FROM (SELECT vec_id, list_transform(embedding[:5], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)""")
def r049_projection(spark, sf_dir):
    matrix = [[0.5, -1.0, 2.0, 0.0, 0.0], [0.0, 0.0, 0.0, 1.0, 1.0]]
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(V.project(F.slice("embedding", 1, 5), matrix)).alias("projected"))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM u),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS s FROM n q, n v WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def r050_cosine_top_k(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    out = tokens.nearest(v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), v, 10)
    return out.withColumn("similarity", V.rounded(F.col("similarity"), 6))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM u),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS s FROM n q, n v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS rank FROM s)
    SELECT query_id, vec_id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def r050_nearest_all(spark, sf_dir):
    """Every vector is a query: the set is not sent along but met block by block."""
    v = table(spark, sf_dir, "embeddings")
    out = tokens.nearest(v.withColumnRenamed("vec_id", "query_id"), v, 3, sent_numbers=0)
    return out.withColumn("similarity", V.rounded(F.col("similarity"), 6))


@query("""SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings""")
def r005_r006_vector_codec(spark, sf_dir):
    again = vectors.unpack_batches(vectors.pack_batches(table(spark, sf_dir, "embeddings"), 64))
    return again.select("vec_id", F.size("embedding").alias("width"), V.rounded(V.total(F.col("embedding")), 6).alias("total"))


# --- scores -----------------------------------------------------------------

LOGITS = "list_transform(range({n}), lambda k: CAST((strlen(text) * (k + 3) + k * 7) % 11 - 5 AS DOUBLE) / 2)"


def logits(n):
    return F.expr(f"transform(sequence(0, {n} - 1), k -> cast((octet_length(text) * (k + 3) + k * 7) % 11 - 5 as double) / 2)")


@query(f"""WITH d AS (SELECT doc_id, {LOGITS.format(n=4)} AS l, doc_id % 3 + 1 AS w FROM documents),
    s AS (SELECT doc_id, l, l[:w] AS v, list_max(l) AS m, list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS z FROM d)
    SELECT doc_id, {ROUND.format("list_transform(l, lambda x: exp(x - m) / z)")} AS softmax, {ROUND.format("list_transform(l, lambda x: 1 / (1 + exp(-x)))")} AS sigmoid,
           CAST(list_position(l, m) - 1 AS INTEGER) AS argmax,
           round(CASE len(v) WHEN 2 THEN 1 / (1 + exp(v[1] - v[2])) ELSE v[1] END, 6) AS relevance, list_min(l) AS least, m AS most FROM s""")
def r052_r053_r060_r061_scores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", logits(4).alias("l"))
    l = F.col("l")
    return d.select("doc_id", rounded(V.softmax(l)).alias("softmax"), rounded(F.transform(l, V.sigmoid)).alias("sigmoid"), V.argmax(l).alias("argmax"),
                    F.round(V.relevance(F.slice(l, F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))), 6).alias("relevance"), V.least_score(l).alias("least"), V.greatest_score(l).alias("most"))


@query(r"""WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 50 = 0),
    p AS (SELECT query_id, doc_id, query, text FROM q, documents),
    s AS (SELECT query_id, doc_id, CAST(len(list_intersect(qw, dw)) AS DOUBLE) / greatest(len(qw), 1) AS x
          FROM (SELECT query_id, doc_id, list_distinct(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: w <> '')) AS qw,
                       list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS dw FROM p)),
    r AS (SELECT query_id, doc_id, round(1 / (1 + exp(-(4 * x - 2))), 6) AS score FROM s)
    SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r) WHERE rank <= 5""")
def r051_rerank(spark, sf_dir):
    # the query set: items whose id is divisible by 50, against all documents, one query a pass over a batch
    q = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    pairs = table(spark, sf_dir, "documents").select("doc_id", "text").crossJoin(q)
    scored = scoring.rerank(pairs, scorers.overlap_reranker).select("query_id", "doc_id", F.round("score", 6).alias("score"))
    return scoring.top_documents(scored, 5)


LABELS = ["sports", "politics", "science", "arts"]


@query(f"""WITH d AS (SELECT doc_id, text, CAST(i AS INTEGER) AS pos, ({LABELS})[i + 1] AS label FROM documents, range(4) r(i))
    SELECT doc_id, pos, label, text, 'This example is ' || label || '.' AS hypothesis FROM d""")
def r054_hypotheses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scoring.zero_shot_pairs(docs, LABELS)


ZERO = f"""l AS (SELECT doc_id, CAST((strlen(text) * (i + 3) + i * 7) % 11 - 5 AS DOUBLE) / 2 AS x, i, ({LABELS})[i + 1] AS label FROM documents, range(4) r(i)),
    s AS (SELECT *, exp(x - max(x) OVER w) / sum(exp(x - m)) OVER w AS p FROM (SELECT *, max(x) OVER (PARTITION BY doc_id) AS m FROM l) WINDOW w AS (PARTITION BY doc_id))"""


def _zero_shot(spark, sf_dir, multi_label=False):
    rows = table(spark, sf_dir, "documents").withColumn("hypotheses", scoring.hypotheses(LABELS))
    logits = F.expr("transform(hypotheses, (h, pos) -> array(0D, 0D, cast((octet_length(text) * (pos + 3) + pos * 7) % 11 - 5 as double) / 2))")
    return rows.select("doc_id", scoring.zero_shot_scores(logits, LABELS, multi_label).alias("z")).select("doc_id", "z.*")


@query(f"WITH {ZERO} SELECT doc_id, arg_max(label, (x, -i)) AS label, round(max(p), 6) AS score, [round(max(p) FILTER (i = k), 6) FOR k IN [0, 1, 2, 3]] AS scores FROM s GROUP BY doc_id".replace(
    "[round(max(p) FILTER (i = k), 6) FOR k IN [0, 1, 2, 3]]", "list(round(p, 6) ORDER BY i)"))
def r055_zero_shot(spark, sf_dir):
    out = _zero_shot(spark, sf_dir)
    return out.select("doc_id", "label", F.round("score", 6).alias("score"), F.array(*[F.round(F.col("scores")[x], 6) for x in LABELS]).alias("scores"))


@query(f"WITH {ZERO} SELECT doc_id, list({{'label': label, 'score': round(1 / (1 + exp(-x)), 6)}} ORDER BY x DESC, label) FILTER (1 / (1 + exp(-x)) >= 0.5) AS ranked FROM s GROUP BY doc_id HAVING ranked IS NOT NULL")
def r057_r058_multi_label(spark, sf_dir):
    out = _zero_shot(spark, sf_dir, multi_label=True).select("doc_id", scoring.ranked_labels(F.col("scores"), 0.5).alias("r"))
    return out.where("size(r) > 0").select("doc_id", F.transform("r", lambda x: F.struct(x["label"].alias("label"), F.round(x["score"], 6).alias("score"))).alias("ranked"))


@query(f"""WITH d AS (SELECT doc_id, {LOGITS.format(n=3)} AS l FROM documents),
    s AS (SELECT doc_id, l, list_max(l) AS m, list_sum(list_transform(l, lambda x: exp(x - list_max(l)))) AS z FROM d)
    SELECT doc_id, (['NEG', 'LABEL_1', 'POS'])[list_position(l, m)] AS label, round(1 / z, 6) AS score, round(exp(l[2] - m) / z, 6) AS second FROM s""")
def r056_supervised(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", logits(3).alias("logits"))
    out = scoring.supervised(d, {0: "NEG", 2: "POS"})
    return out.select("doc_id", "label", F.round("score", 6).alias("score"), F.round(F.col("scores")["LABEL_1"], 6).alias("second"))


SPAN_LOGITS = f"SELECT doc_id, ({LABELS})[i + 1] AS label, CAST((doc_id * (i + 2) + s * 5) % 13 - 6 AS DOUBLE) / 3 AS logit FROM documents, range(4) r(i), range(6) q(s)"


@query(f"""WITH b AS (SELECT doc_id, label, 1 / (1 + exp(-max(logit))) AS score FROM ({SPAN_LOGITS}) GROUP BY ALL)
    SELECT doc_id, label, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rank FROM b WHERE score >= 0.8) WHERE rank <= 3""")
def r059_span_classes(spark, sf_dir):
    labels = F.array(*[F.lit(x) for x in LABELS])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("doc_id", "i", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("s"))
    spans = rows.select("doc_id", F.get(labels, F.col("i")).alias("label"), F.expr("cast((doc_id * (i + 2) + s * 5) % 13 - 6 as double) / 3").alias("logit"))
    return scoring.span_classes(spans, True, 0.8, 3).withColumn("score", F.round("score", 6))


# --- sampling ---------------------------------------------------------------

PROBS = f"(SELECT doc_id, list_transform(l, lambda x: exp(x - list_max(l)) / list_sum(list_transform(l, lambda y: exp(y - list_max(l))))) AS p FROM (SELECT doc_id, {LOGITS.format(n=6)} AS l FROM documents))"


@query(f"""WITH d AS (SELECT doc_id, {LOGITS.format(n=6)} AS l, [CAST(doc_id % 6 AS INTEGER), 2, 2] AS g FROM documents)
    SELECT doc_id, {ROUND.format("list_transform(l, lambda x, i: CASE WHEN x > 0 THEN x / 1.3 ** len(list_filter(g, lambda t: t = i - 1)) ELSE x * 1.3 ** len(list_filter(g, lambda t: t = i - 1)) END)")} AS logits FROM d""")
def r084_repetition_penalty(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", logits(6).alias("l"), F.array((F.col("doc_id") % 6).cast("int"), F.lit(2), F.lit(2)).alias("g"))
    return d.select("doc_id", rounded(V.repetition_penalty(F.col("l"), F.col("g"), 1.3)).alias("logits"))


@query(f"""WITH t AS (SELECT doc_id, p, list_reverse_sort(p)[3] AS c FROM {PROBS})
    SELECT doc_id, {ROUND.format("list_transform(p, lambda x: CASE WHEN x >= c THEN x / list_sum(list_filter(p, lambda y: y >= c)) ELSE 0.0 END)")} AS probs FROM t""")
def r085_top_k(spark, sf_dir):
    p = V.softmax(F.col("l"))
    return table(spark, sf_dir, "documents").select("doc_id", logits(6).alias("l")).withColumn("p", p).select("doc_id", rounded(V.top_k(F.col("p"), 3)).alias("probs"))


@query(f"""WITH e AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM {PROBS}),
    c AS (SELECT *, sum(x) OVER (PARTITION BY doc_id ORDER BY x DESC, i) - x AS before FROM e),
    k AS (SELECT doc_id, i, CASE WHEN before < 0.8 THEN x ELSE 0 END AS x FROM c)
    SELECT doc_id, list(round(x / s, 6) ORDER BY i) AS probs FROM (SELECT *, sum(x) OVER (PARTITION BY doc_id) AS s FROM k) GROUP BY doc_id""")
def r086_top_p(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", logits(6).alias("l")).withColumn("p", V.softmax(F.col("l"))).select("doc_id", rounded(V.top_p(F.col("p"), 0.8)).alias("probs"))


@query(f"""WITH e AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS i FROM {PROBS}),
    c AS (SELECT *, sum(x) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM e)
    SELECT doc_id, CAST(coalesce(min(i) FILTER (CAST(doc_id % 97 AS DOUBLE) / 97 < s), 5) AS INTEGER) AS token FROM c GROUP BY doc_id""")
def r087_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", logits(6).alias("l")).withColumn("p", V.softmax(F.col("l")))
    return d.select("doc_id", V.sample(F.col("p"), (F.col("doc_id") % 97).cast("double") / 97).cast("int").alias("token"))


@query("SELECT doc_id, round(CASE WHEN doc_id % 9 = 0 THEN 0 ELSE exp(-(doc_id % 50) / 10.0 / (doc_id % 9)) END, 6) AS score FROM documents")
def r090_sequence_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(V.sequence_score(-(F.col("doc_id") % 50) / 10.0, F.col("doc_id") % 9), 6).alias("score"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
    SELECT vec_id, list_transform(range(42), lambda i: round(CASE WHEN floor(i * 1.5) + 2 <= 64 THEN e[CAST(floor(i * 1.5) AS INTEGER) + 1] * (1 - (i * 1.5 - floor(i * 1.5))) + e[CAST(floor(i * 1.5) AS INTEGER) + 2] * (i * 1.5 - floor(i * 1.5)) ELSE e[CAST(floor(i * 1.5) AS INTEGER) + 1] END, 6)) AS samples FROM s""")
def r105_resample(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(V.resample(F.col("embedding"), 24000, 16000)).alias("samples"))


def _decoder():
    import numpy as np

    step = lambda ids: np.array([(sum(ids) * (k + 3) + len(ids) * k) % 17 / 3.0 for k in range(12)])
    return generation.Decoder(step, eos_id=0, max_new_tokens=12, min_length=2, repetition_penalty=1.2, suppress=(7,), forced={3: 5})


@query()
def r082_r088_r089_decode(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array((F.col("doc_id") % 11).cast("int")).alias("ids"))
    return generation.generate(rows, _decoder).select("doc_id", "generated.*")


@query()
def r083_r149_r164_decode_stream(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array((F.col("doc_id") % 11).cast("int")).alias("ids"))
    return generation.generate_stream(rows, _decoder, "doc_id", stop=lambda token: token == 11)


@query()
def r091_r093_rewrite(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T.question_prompt(F.col("text"), F.col("text")).alias("input"))
    reverse = lambda: lambda batch: [[" ".join(reversed(t.split()))] for (t,) in batch]
    return tokens.run_model(rows, reverse, ["input"], "texts", "array<string>").select("doc_id", "texts")
