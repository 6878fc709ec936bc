"""Spelling variants by a rare-first prefix filter on positional bigrams.

Bigrams are ordered by their frequency over all words. One edit touches at most two
bigrams of a word, so of the three rarest of each of two near words at least one is
untouched in both; it stands at the same place from the start (the edit comes after
it) or from the end (the edit comes before it). So words meet only by the three
rarest. The join key is the untouched side of the word and, where that is short, the half
of the other side that the edit leaves alone, so that a common beginning or ending is
no hot key; each meeting is verified by its edit distance inside the join. Equal bigrams
of one word count in the order of their places: only so does the first untouched one
stand in both prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import written

#: Bigrams of a word that are joined: two for each edit, and one.
RAREST = 3
#: Code points of the shortest words that are compared: with fewer than three bigrams one edit can leave none.
SHORTEST = 4
#: Times its own occurrences that a word's form must have.
FACTOR = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column, least: int = 1) -> Column:
    """Array of the maximal runs of Latin letters of at least ``least`` code points, A-Z
    lower-cased one by one by ``lowered``; a null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}+"), F.lit(0)), F.array().cast("array<string>"))


def lowered(word: Column) -> Column:
    return F.translate(word, UPPER, LOWER)


def _rarest(words: DataFrame) -> DataFrame:
    """(word, n, size, at): places from 0 of the three rarest bigrams of each word."""
    chars = F.split("word", "")
    grams = F.transform(F.sequence(F.lit(0), F.col("size") - 2), lambda p: F.concat(F.get(F.col("chars"), p), F.get(F.col("chars"), p + 1)))
    each = words.withColumn("chars", chars).select("word", "n", "size", F.posexplode(grams).alias("at", "gram"))
    counts = written(each.groupBy("gram").agg(F.count("*").alias("f")), "bigrams")
    ranked = each.join(counts, "gram")
    first = F.slice(F.array_sort(F.collect_list(F.struct("f", "gram", "at"))), 1, RAREST)
    return ranked.groupBy("word", "n", "size").agg(first["at"].alias("at"))


def _letters(start: Column | int, n: Column) -> Column:
    """``n`` letters of the word from ``start``, which counts from 1."""
    return F.substring(F.col("word"), F.lit(start), n)


def _last(n: Column) -> Column:
    return _letters(F.col("size") - n + 1, n)


def _before(p: Column, short: Column) -> Column:
    """Keys for an edit after the bigram at ``p``: all up to it, and where that is not half of the
    shorter word also the half of the rest that the edit leaves alone (the near or the far one)."""
    known = p + 2
    half = F.floor((short - known) / 2).cast("int")
    near = F.xxhash64(F.lit("before, near"), _letters(1, known + half), known)
    far = F.xxhash64(F.lit("before, far"), _letters(1, known), _last(short - known - half))
    return F.when(known * 2 >= short, F.array(F.xxhash64(F.lit("before"), _letters(1, known)))).otherwise(F.array(near, far))


def _after(p: Column, short: Column) -> Column:
    """The same for an edit before the bigram at ``p``."""
    known = F.col("size") - p
    half = F.floor((short - known) / 2).cast("int")
    near = F.xxhash64(F.lit("after, near"), _last(short - half), known)
    far = F.xxhash64(F.lit("after, far"), _letters(1, half), _last(known))
    return F.when(known * 2 >= short, F.array(F.xxhash64(F.lit("after"), _last(known)))).otherwise(F.array(near, far))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n) of words (word, n) that one inserted, deleted or replaced code
    point tells apart, a pair as often as its words meet. Words are distinct and not
    null; those shorter than SHORTEST meet nothing."""
    sized = words.where("word is not null").withColumn("size", F.char_length("word")).where(F.col("size") >= SHORTEST)
    rare = written(_rarest(sized), "rarest")
    keyed = lambda short: F.explode(F.array_distinct(F.flatten(F.transform("at", lambda p: F.concat(_before(p, short), _after(p, short))))))
    # a meets words of its own length and of one more
    left = rare.select(keyed(F.col("size")).alias("part"), F.col("size").alias("short"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = rare.select("word", "n", "size", "at", F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("short"))
    right = right.select(keyed(F.col("short")).alias("part"), "short", F.col("word").alias("b"), F.col("n").alias("b_n"), "size")
    ordered = (F.col("size") > F.col("short")) | (F.col("a") < F.col("b"))
    # the hash only proposes: the distance decides
    return left.join(right, ["part", "short"]).where(ordered & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: forms followed to the last. Counts grow at every
    step, so there is no ring; steps double each round."""
    steps = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = steps.join(further, "root", "left")
        out = written(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = out.select("word", "root")
        if out.where("moved").isEmpty():
            return steps


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n).

    A word's form is the near word with most occurrences (ties: the smallest in code-point
    order) where those are at least ``factor`` times its own, ``root`` the last form that
    following forms leads to, or the word itself. Words are distinct, with n at least 1;
    null words are left out; words under SHORTEST code points are near nothing. An empty
    table has no rows. A factor up to 1 could make rings and is an error."""
    if factor < 2:
        raise ValueError("factor must be at least 2")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                                          F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("l")).select("l.*")
    once = both.groupBy("word", "near", "near_n").agg(F.lit(1).alias("one"))
    best = once.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.where("word is not null").select("word", F.col("n").cast("long").alias("n"))
    takes = -F.col("best.less") >= factor * F.col("n")
    judged = written(known.join(best, "word", "left").select(
        "word", F.when(takes, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, -F.col("best.less")).cast("long").alias("form_n")), "forms")
    out = judged.join(_roots(judged.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def count_words(found: DataFrame, least_size: int = 1, least_n: int = 1) -> DataFrame:
    """(word, n) of a column of words, those of enough code points and occurrences; null is none."""
    return found.where(F.char_length("word") >= least_size).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def document_words(docs: DataFrame, least_size: int, id_col: str = "doc_id", text_col: str = "text", slip: int = 31) -> DataFrame:
    """(word): lower-cased runs of all texts, as often as they occur, one letter deleted
    where ``slip`` divides the hash of document and run (0: nowhere): planted misspellings.

    A null text has no runs, a null id hashes as an empty one; repeated rows count each."""
    run = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(runs(F.col(text_col), least_size)).alias("run")).withColumn("run", lowered(F.col("run")))
    if not slip:
        return run.select(F.col("run").alias("word"))
    h = F.crc32(F.encode(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run"), "utf-8"))
    run = run.withColumn("h", h)
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return run.select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("word"))
