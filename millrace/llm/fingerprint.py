"""Canonical exact digests of documents, with DataFrame and SQL functions only.

A text is normalised (Unicode NFC), case-folded, normalised again, its runs of
white space become one blank and its ends are trimmed; 128 bits of XXH64 under two
seeds are its fingerprint. Buckets of equal fingerprints are compared byte by
byte; canonical texts that differ within a bucket get a suffix of their SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import written

#: Bytes of text in one interval of ids.
INTERVAL_BYTES = 8 << 20
#: Intervals at most; beyond, they grow and spill.
MOST_INTERVALS = 1 << 16
#: Bits that mark the buckets of two and more documents.
MARKS = 1 << 23
#: Most white space of Unicode as a Java class.
SPACE = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def canonical(text: Column) -> Column:
    """NFC, full case folding, NFC, white space to single blanks, trimmed. ASCII
    texts skip the normaliser; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    nfc = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    fold = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(nfc(fold(nfc(text))))
    return F.trim(F.regexp_replace(folded, SPACE, " "))


def digest(canon: Column) -> Column:
    """128 bits as 32 hex digits: XXH64 under seed 42, and under a seed drawn from it."""
    wide = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return F.concat(wide(F.xxhash64(canon)), wide(F.xxhash64(F.lit("second seed"), canon)))


def clashes(digests: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests that stand for canonical texts of different bytes (in practice none).

    Only documents in buckets of two and more are compared: copies shrink to the
    least and the greatest text of a bucket in each task before the shuffle."""
    buckets = written(digests.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d"), "buckets")
    # a bitmap of MARKS bits (at most 1 MB whatever the input) keeps texts of other buckets out of the shuffle
    place = lambda: F.pmod(F.xxhash64("d"), F.lit(MARKS)) + 1
    marks = buckets.select(place().alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("marks"))
    texts = docs.select(canonical(F.col(text_col)).alias("c")).withColumn("d", digest(F.col("c")))
    texts = texts.withColumns({"b": F.bitmap_bucket_number(place()), "bit": F.bitmap_bit_position(place())}).join(F.broadcast(marks), "b")
    byte = F.conv(F.hex(F.expr("substring(marks, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    texts = texts.where(F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    texts = texts.select("c", "d").join(buckets, "d")  # a semi join would be pushed below the bitmap
    return written(texts.groupBy("d").agg((F.min("c") != F.max("c")).alias("bad")).where("bad").select("d"), "clashes")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint): equal canonical texts have equal fingerprints, others differ.

    A null text counts as empty; empty and blank texts share one fingerprint;
    repeated rows stay, one row out for each row in."""
    rows = docs.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("c"))
    rows = rows.select("id", digest(F.col("c")).alias("d"), F.sha2(F.col("c").cast("binary"), 256).alias("sha"))
    rows = written(rows, "digests")
    bad = clashes(rows, docs, id_col, text_col)
    if bad.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.col("d").alias("fingerprint"))
    marked = rows.join(bad.withColumn("bad", F.lit(True)), "d", "left")
    return marked.select(F.col("id").alias(id_col), F.when(F.col("bad"), F.concat_ws("-", "d", "sha")).otherwise(F.col("d")).alias("fingerprint"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fingerprint, copies, first_id) of every group of equal canonical texts."""
    return fingerprints(docs, id_col, text_col).groupBy("fingerprint").agg(F.count("*").alias("copies"), F.min(id_col).alias("first_id"))


def _intervals(ids: DataFrame) -> list[int]:
    """Inner bounds of intervals of ids of about INTERVAL_BYTES of text."""
    total = ids.agg(F.sum("n_bytes")).first()[0] or 0
    count = min(MOST_INTERVALS, max(ids.sparkSession.sparkContext.defaultParallelism, -(-total // INTERVAL_BYTES)))
    bounds = ids.agg(F.percentile_approx("id", [k / count for k in range(1, count)], 100_000)).first()[0] if count > 1 else None
    return sorted(set(bounds or []))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited texts, whose last floor(n/2) code
    points come from the next document in descending order of id.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next); the digest is exact, so that likeness is 1 for equal canonical
    bytes, else 0. Ids are whole numbers; equal ids follow in order of their
    texts; a null id sorts as the least. Null texts count as empty. A table of one
    row is its own next document.

    Rows meet their successor inside intervals of ids; the first row of the next
    interval that has rows is sent along, a row for each interval."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("k", F.coalesce("id", F.lit(-(1 << 63))))
    # a digest names its text twice: the canonical text is a column first, or it would be worked out twice
    marked = lambda frame, text, name: frame.withColumn("c", canonical(F.col(text))).withColumn(name, digest(F.col("c"))).drop("c")
    narrow = written(marked(rows.withColumn("n_bytes", F.octet_length("t")), "t", "d").select("id", "k", "n_bytes", "d"), "ids")
    bad = clashes(narrow, docs, id_col, text_col)
    bounds = _intervals(narrow.select(F.col("k").alias("id"), "n_bytes"))
    slot = F.lit(0) if not bounds else F.size(F.filter(F.lit(bounds), lambda b: b < F.col("k"))) if len(bounds) < 64 else _search(bounds, F.col("k"))
    tops = {r[0]: r[1] for r in narrow.select(slot.alias("s"), "k").groupBy("s").agg(F.max("k")).collect()}  # a row for each interval
    order = sorted(tops, reverse=True)
    ahead = {tops[s]: order[i - 1] for i, s in enumerate(order)}  # whose rows end before this interval's first
    spark = docs.sparkSession
    rows = rows.withColumn("s", slot)
    heads = spark.createDataFrame(list(ahead.items()) or [(0, 0)], "k long, s int")
    heads = heads if ahead else heads.where("false")
    firsts = rows.drop("s").join(F.broadcast(heads), "k")
    # equal ids at an interval's top: only the first in order is sent along
    firsts = firsts.groupBy("k", "s").agg(F.min("t").alias("t"), F.min("id").alias("id"))
    both = rows.select("id", "k", "t", "s", F.lit(False).alias("sent")).unionByName(firsts.select("id", "k", "t", "s", F.lit(True).alias("sent")))
    line = Window.partitionBy("s").orderBy("sent", F.desc("k"), "t")
    both = marked(both, "t", "d").withColumns({"next": F.lead("t").over(line), "nd": F.lead("d").over(line)}).where("not sent")
    n = F.char_length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half))
    out = both.select("id", n.cast("long").alias("n_chars"), edited.alias("e"), "t", "d", "next", "nd").withColumn("ec", canonical(F.col("e")))
    out = out.withColumn("edited_sha256", F.sha2(F.col("e").cast("binary"), 256)).withColumn("ed", digest(F.col("ec")))
    # texts are normalised again only where digests are equal, or bad
    c, nc = canonical(F.col("t")), canonical(F.col("next"))
    same = lambda equal, exact: F.when(equal, F.when(exact, 1.0).otherwise(0.0)).otherwise(0.0)
    near = [same(F.col("d") == F.col("ed"), c == F.col("ec")).alias("near_edited"), same(F.col("d") == F.col("nd"), c == nc).alias("near_next")]
    if bad.isEmpty():
        marks = [F.col("d"), F.col("ed")]
    else:
        for d in ("d", "ed"):
            out = out.join(bad.select(F.col("d").alias(d), F.lit(True).alias(f"bad_{d}")), d, "left")
        marks = [F.when(F.col(f"bad_{d}"), F.concat_ws("-", d, F.sha2(x.cast("binary"), 256))).otherwise(F.col(d)) for d, x in (("d", c), ("ed", F.col("ec")))]
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", marks[0].alias("fingerprint"), marks[1].alias("edited_fingerprint"), *near)


def _search(bounds: list[int], key: Column) -> Column:
    """Number of bounds below key, by two looks of about sqrt(n) comparisons."""
    step = round(len(bounds) ** 0.5)
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    block = F.size(F.filter(F.lit([b[-1] for b in blocks]), lambda b: b < key))
    inner = F.coalesce(F.get(F.array(*[F.lit(b) for b in blocks]), block), F.array().cast("array<bigint>"))
    return (block * step + F.size(F.filter(inner, lambda b: b < key))).cast("int")
