"""Entities, relations and answers from token, span and text outputs of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vector as V

#: Widest span in words; least score of a span.
MAX_WIDTH, THRESHOLD = 12, 0.5


def token_labels(tokens: DataFrame, labels: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id, pos, start, end, label, score) of rows (id, pos, start, end, mask, logits):
    the best label of each token; padding and marks without span (but the first) go."""
    names = F.array(*[F.lit(x) for x in labels])
    kept = tokens.where("mask <> 0 and not (start = 0 and end = 0 and pos > 0)")
    best = V.argmax(F.col("logits"))
    return kept.select(id_col, "pos", "start", "end", F.coalesce(F.get(names, best), F.lit("O")).alias("label"), F.get(V.softmax(F.col("logits")), best).alias("score"))


def entities(tokens: DataFrame, texts: DataFrame | None = None, strategy: str = "simple", ignore: tuple[str, ...] = ("O",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, start, end, score[, text]) of rows (id, pos, start, end, label, score).

    ``none``: one entity a token. Else neighbours of one type join; a new entity
    begins at a B- label, another type or after an ignored label. Scores: the mean
    (``simple``, ``average``), the ``first`` or the ``max``. Two windows over one
    sort a document; documents are the partitions, bounded by their own length."""
    if strategy not in ("none", "simple", "average", "first", "max"):
        raise ValueError(f"unknown aggregation strategy: {strategy}")
    kind = T.label_type(F.col("label"))
    if strategy == "none":
        out = tokens.where(~F.col("label").isin(*ignore)).select(id_col, kind.alias("label"), "start", "end", "score")
    else:
        line = Window.partitionBy(id_col).orderBy("pos")
        marked = tokens.select(id_col, "pos", "start", "end", "score", "label", kind.alias("kind"), F.col("label").isin(*ignore).alias("outside"))
        before = F.lag(F.struct("kind", "outside")).over(line)
        begins = before.isNull() | before["outside"] | F.startswith("label", F.lit("B-")) | (before["kind"] != F.col("kind"))
        islands = marked.withColumn("island", F.sum(F.when(~F.col("outside") & begins, 1).otherwise(0)).over(line)).where(~F.col("outside"))
        score = {"first": F.min_by("score", "pos"), "max": F.max("score")}.get(strategy, F.avg("score"))
        out = islands.groupBy(id_col, "island").agg(F.min_by("kind", "pos").alias("label"), F.min_by("start", "pos").alias("start"), F.max_by("end", "pos").alias("end"), score.alias("score")).drop("island")
    if texts is None:
        return out
    raw = F.encode(F.col("_t"), "utf-8")
    part = F.decode(F.substring(raw, F.col("start") + 1, F.greatest(F.least("end", F.octet_length("_t")) - F.col("start"), F.lit(0))), "utf-8")
    return out.join(texts.select(id_col, F.col(text_col).alias("_t")), id_col).withColumn("text", part).drop("_t")


def spans(words: Column, max_width: int = MAX_WIDTH) -> Column:
    """array<struct<first, last, start, end>>: all spans of up to max_width words, by
    first word, then width, of an array of (word, start, end)."""
    n = F.size(words)
    each = F.transform(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.transform(
            F.sequence(i, F.least(i + max_width - 1, n - 1)),
            lambda j: F.struct(i.alias("first"), j.alias("last"), F.get(words, i)["start"].alias("start"), F.get(words, j)["end"].alias("end")),
        ),
    )
    return F.flatten(each)


def score_spans(grid: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, label, score) of rows (id, words, labels, logits, max_width): the flat
    logits of (word, width, label) whose sigmoid reaches the threshold, spans past the
    last word left out."""
    m, w = F.size("labels"), F.col("max_width")

    def cell(x, k):
        first = F.floor(k / (m * w)).cast("int")
        last = first + (F.floor(k / m) % w).cast("int")
        return F.struct(F.get("words", first)["start"].alias("start"), F.get("words", last)["end"].alias("end"), F.get("labels", k % m).alias("label"), V.sigmoid(x).alias("score"), last.alias("last"))

    # cells are judged inside the row: only spans that count become rows, without words and labels
    good = F.filter(F.transform("logits", cell), lambda c: (c["last"] < F.size("words")) & (c["score"] >= threshold))
    return grid.select(id_col, F.explode(good).alias("c")).select(id_col, "c.start", "c.end", "c.label", "c.score")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def without_overlaps(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans (id, start, end, label, score) taken by falling score (ties by start, end,
    label) unless they overlap one taken before. A document's spans meet in one array."""
    one = F.struct((-F.col("score")).alias("n"), "start", "end", "label")
    kind = "array<struct<n:double,start:int,end:int,label:string>>"
    ordered = found.groupBy(id_col).agg(F.array_sort(F.collect_list(one)).cast(kind).alias("s"))
    clear = lambda kept, x: ~F.exists(kept, lambda y: overlaps(x["start"], x["end"], y["start"], y["end"]))
    kept = F.aggregate("s", F.array().cast(kind), lambda a, x: F.when(clear(a, x), F.array_append(a, x)).otherwise(a))
    return ordered.select(id_col, F.explode(kept).alias("e")).select(id_col, "e.start", "e.end", "e.label", (-F.col("e.n")).alias("score"))


def relations(found: DataFrame, heads: DataFrame, threshold: float = 0.0, id_col: str = "doc_id") -> DataFrame:
    """(id, head, tail, label, score) of entities and relation heads, both (id, start, end,
    label, score); a head's label is ``type::relation``.

    A head takes the entity at its place, or stands for itself; its tails are all
    entities that do not overlap it. The score is the mean of head and tail."""
    entity = F.struct("start", "end", "label", "score")
    # the last entity at a place counts, ties by label and score
    at = found.groupBy(id_col, "start", "end").agg(F.max_by(entity, F.struct("label", "score")).alias("known"))
    split = heads.where(F.instr("label", "::") > 0).select(
        id_col, "start", "end", "score", F.substring_index("label", "::", 1).alias("kind"), F.expr("substring(label, instr(label, '::') + 2)").alias("relation"))
    own = F.struct("start", "end", F.col("kind").alias("label"), "score")
    named = split.join(at, [id_col, "start", "end"], "left").select(id_col, "start", "end", "score", "relation", F.coalesce("known", own).alias("head"))
    tails = found.select(id_col, entity.alias("tail"))
    apart = ~overlaps(F.col("start"), F.col("end"), F.col("tail.start"), F.col("tail.end"))
    out = named.join(tails, id_col).where(apart).select(id_col, "head", "tail", F.col("relation").alias("label"), ((F.col("score") + F.col("tail.score")) / 2).alias("score"))
    return out.where(F.col("score") >= threshold) if threshold > 0 else out


def extract_relations(found: DataFrame, heads: DataFrame, relation_labels: list[str], threshold: float = 0.0, id_col: str = "doc_id") -> DataFrame:
    """relations() of documents with two or more entities; none without relation labels."""
    several = found.groupBy(id_col).count().where("count >= 2").select(id_col)
    heads = heads if relation_labels else heads.where("false")
    return relations(found.join(several, id_col, "left_semi"), heads.join(several, id_col, "left_semi"), threshold, id_col)


def answers(contexts: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """contexts with ``answer`` (start, end, score): the best span, ties by place; an empty
    answer where there is none."""
    best = found.groupBy(id_col).agg(F.max_by(F.struct("start", "end", "score"), F.struct("score", -F.col("start"), -F.col("end"))).alias("answer"))
    empty = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("score"))
    return contexts.join(best, id_col, "left").withColumn("answer", F.coalesce("answer", empty))


def triplets(text: Column, mark: str = "<triplet>", subject: str = "<subj>", object_: str = "<obj>") -> Column:
    """array<struct<subject, object, relation>> of generated text: marked parts, or else
    elements between double blanks, three at a time. Incomplete ones are left out."""
    bare = T.trim(F.replace(F.replace(F.replace(text, F.lit("<s>"), F.lit("")), F.lit("</s>"), F.lit("")), F.lit("<pad>"), F.lit("")))
    marked = bare.contains(mark) | bare.contains(subject) | bare.contains(object_)
    parts = F.filter(F.transform(T.split_plain(bare, mark), T.trim), lambda p: p.contains(subject) & p.contains(object_))

    def one(p):
        rest = F.substring(p, F.instr(p, subject) + len(subject), F.length(p))
        head = F.substring_index(p, subject, 1)
        tail = F.substring(rest, F.instr(rest, object_) + len(object_), F.length(rest))
        found = F.instr(rest, object_) > 0
        return F.struct(T.trim(head).alias("subject"), F.when(found, T.trim(F.substring_index(rest, object_, 1))).alias("object"), F.when(found, T.trim(tail)).alias("relation"))

    full = lambda t: (t["subject"] != "") & (t["object"] != "") & (t["relation"] != "")
    first = F.filter(F.transform(parts, one), full)
    elements = F.filter(F.transform(T.split_plain(bare, "  "), T.trim), lambda x: x != "")
    count = F.floor(F.size(elements) / 3).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    second = F.transform(starts, lambda i: F.struct(F.get(elements, i * 3).alias("subject"), F.get(elements, i * 3 + 1).alias("object"), F.get(elements, i * 3 + 2).alias("relation")))
    return F.when(marked, first).otherwise(second)


def find_span(text: Column, part: Column) -> Column:
    """struct(start, end) in bytes of the first occurrence whatever the case; -1 for none."""
    at = F.instr(F.lower(text), F.lower(part))
    start = F.octet_length(F.left(text, at - 1)).cast("int")
    return F.when(at > 0, F.struct(start.alias("start"), (start + F.octet_length(part)).alias("end"))).otherwise(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")))


def triplet_entities(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", triplets_col: str = "triplets") -> DataFrame:
    """(id, text, label, start, end): the distinct subjects and objects of each row."""
    names = F.explode(F.array_distinct(F.flatten(F.transform(triplets_col, lambda t: F.array(t["subject"], t["object"])))))
    each = rows.select(id_col, F.col(text_col).alias("_t"), names.alias("text"))
    return each.withColumn("_s", find_span(F.col("_t"), F.col("text"))).select(id_col, "text", F.lit("ENTITY").alias("label"), "_s.start", "_s.end")


def triplet_relations(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", triplets_col: str = "triplets") -> DataFrame:
    """(id, head, tail, label) of each triplet, heads and tails with their places."""
    each = rows.select(id_col, F.col(text_col).alias("_t"), F.explode(triplets_col).alias("_x"))
    end = lambda c: F.struct(c.alias("text"), find_span(F.col("_t"), c).alias("span"))
    return each.select(id_col, end(F.col("_x.subject")).alias("head"), end(F.col("_x.object")).alias("tail"), F.col("_x.relation").alias("label"))


def count_items(lists: Column) -> Column:
    """Items over all inner lists."""
    return F.aggregate(lists, F.lit(0), lambda a, x: a + F.size(x))


def recognise_route(kind: Column, capabilities: Column, labels: Column) -> Column:
    """How a request is served: recognisers of spans or triplets by relations where they
    have that capability, else with the labels given, else with their own; models of
    token labels by plain recognition."""
    own = kind.isin("spans", "triplets")
    return (
        F.when(own & F.array_contains(capabilities, "relations"), "relations")
        .when(own & (F.size(labels) > 0), "labels")
        .when(own, "default_labels")
        .otherwise("tokens")
    )


def capabilities(kind: Column, manifest: Column, configured: Column) -> Column:
    """What a recogniser can do: triplets models what their manifest says, else relations
    and zero-shot; others the union of manifest and configuration."""
    none = F.array().cast("array<string>")
    declared, own = F.coalesce(manifest, none), F.coalesce(configured, none)
    triplets_ = F.when(F.size(declared) > 0, declared).otherwise(F.array(F.lit("relations"), F.lit("zeroshot")))
    return F.when(kind == "triplets", triplets_).otherwise(F.array_union(declared, own))
