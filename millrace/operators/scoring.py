"""Reranking and classification over model logits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vector as V

#: Zero-shot sentence around a label.
TEMPLATE = "This example is {}."


def rerank(pairs: DataFrame, model: Callable, query_col: str = "query", doc_col: str = "text", batch_size: int = 32) -> DataFrame:
    """Pairs with ``score``, in no order. The model gives the logits of (query, document).
    An empty query is an error; no pairs, no rows."""
    from millrace.operators.tokens import run_model

    checked = pairs.withColumn(query_col, F.when(F.coalesce(query_col, F.lit("")) == "", F.raise_error("query is required").cast("string")).otherwise(F.col(query_col)))
    out = run_model(checked, model, [query_col, doc_col], "_logits", "array<double>", batch_size)
    return out.withColumn("score", V.relevance(F.col("_logits"))).drop("_logits")


def top_documents(scored: DataFrame, k: int, query_col: str = "query_id", doc_col: str = "doc_id") -> DataFrame:
    """The k best of each query with their ``rank``, ties by document.

    Spark keeps k rows a group before the shuffle, so that a query with very many
    documents is cut in each task."""
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("score"), doc_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def zero_shot_pairs(texts: DataFrame, labels: list[str], template: str = TEMPLATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, label, text, hypothesis) for every text and label."""
    if not labels:
        raise ValueError("at least one candidate label is required")
    each = F.posexplode(F.array(*[F.lit(x) for x in labels])).alias("pos", "label")
    rows = texts.select(id_col, F.col(text_col).alias("text"), each)
    return rows.withColumn("hypothesis", T.hypothesis(F.lit(template), F.col("label")))


def entailment_index(labels: dict[int, str] | None) -> int:
    """The place of the label that names entailment; 2 without one."""
    return next((i for i, x in sorted((labels or {}).items()) if "entailment" in x.lower()), 2)


def entailment_logit(logits: Column, index: int = 2) -> Column:
    return F.when(F.size(logits) >= 3, F.get(logits, F.lit(index))).when(F.size(logits) == 2, F.get(logits, F.lit(1))).otherwise(F.get(logits, F.lit(0)))


def zero_shot(pairs: DataFrame, multi_label: bool = False, index: int = 2, id_col: str = "doc_id", logits_col: str = "logits") -> DataFrame:
    """(id, label, score, scores): the best label and all labels' scores of rows (id, pos,
    label, logits); softmax over the labels, or a sigmoid each. First label on ties."""
    logit = entailment_logit(F.col(logits_col), index).cast("double")
    gathered = pairs.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", "label", logit.alias("logit")))).alias("l"))
    raw = F.transform("l", lambda x: x["logit"])
    probs = F.transform(raw, V.sigmoid) if multi_label else V.softmax(raw)
    out = gathered.withColumn("p", probs).withColumn("b", V.argmax(F.col("p")))
    names = F.transform("l", lambda x: x["label"])
    return out.select(id_col, F.get(names, F.col("b")).alias("label"), F.get("p", F.col("b")).alias("score"), F.map_from_arrays(F.array_distinct(names), F.transform(F.array_distinct(names), lambda n: F.get("p", (F.array_size(names) - F.array_position(F.reverse(names), n)).cast("int")))).alias("scores"))


def hypotheses(labels: list[str], template: str = TEMPLATE) -> Column:
    """Array of the sentences of all labels, in their order: one row a text goes to the model."""
    if not labels:
        raise ValueError("at least one candidate label is required")
    return F.array(*[T.hypothesis(F.lit(template), F.lit(x)) for x in labels])


def zero_shot_scores(logits: Column, labels: list[str], multi_label: bool = False, index: int = 2) -> Column:
    """struct(label, score, scores) of a text's logits by label (an array for each, in the order
    of ``labels``): as zero_shot() has them, without gathering rows. Of repeated labels the
    last one's score is kept; a null array gives nulls."""
    raw = F.transform(logits, lambda x: entailment_logit(x, index).cast("double"))
    names = F.array(*[F.lit(x) for x in labels])
    last = {x: i for i, x in enumerate(labels)}

    def judged(p):
        best = V.argmax(p)
        scores = F.create_map(*[v for x, i in last.items() for v in (F.lit(x), F.get(p, F.lit(i)))])
        return F.when(p.isNotNull(), F.struct(F.get(names, best).alias("label"), F.get(p, best).alias("score"), scores.alias("scores")))

    return T.let(F.transform(raw, V.sigmoid) if multi_label else V.softmax(raw), judged)


def supervised(rows: DataFrame, labels: dict[int, str] | None = None, multi_label: bool = False, logits_col: str = "logits") -> DataFrame:
    """Rows with label, score and scores (map); labels without a name are LABEL_i."""
    probs = F.transform(F.col(logits_col), V.sigmoid) if multi_label else V.softmax(F.col(logits_col))
    table = F.create_map(*[x for i, n in (labels or {-1: ""}).items() for x in (F.lit(i), F.lit(n))])
    name = lambda i: F.coalesce(F.try_element_at(table, i), F.concat(F.lit("LABEL_"), i.cast("string")))
    out = rows.withColumn("_p", probs)
    best = V.argmax(F.col("_p"))
    return out.withColumns({
        "label": name(best), "score": F.get("_p", best),
        "scores": F.map_from_arrays(F.transform("_p", lambda _, i: name(i)), F.col("_p")),
    }).drop("_p")


def ranked_labels(scores: Column, threshold: float = 0.0) -> Column:
    """array<struct<label, score>> of a map, best first, ties by label; with a threshold
    above 0 only labels that reach it."""
    pairs = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("label")))
    out = F.transform(F.array_sort(pairs), lambda x: F.struct(x["label"].alias("label"), (-x["n"]).alias("score")))
    return F.filter(out, lambda x: x["score"] >= threshold) if threshold > 0 else out


def span_classes(spans: DataFrame, multi_label: bool = False, threshold: float = 0.5, top: int = 0, id_col: str = "doc_id") -> DataFrame:
    """(id, label, score, rank) of rows (id, label, logit): the greatest logit of each label
    as a sigmoid; the best one (or ``top``), or all that reach the threshold."""
    best = spans.groupBy(id_col, "label").agg(V.sigmoid(F.max("logit")).alias("score"))
    best = best.where(F.col("score") >= threshold) if multi_label else best
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "label"))
    out = best.withColumn("rank", rank)
    most = top if top > 0 else 0 if multi_label else 1
    return out.where(F.col("rank") <= most) if most else out
