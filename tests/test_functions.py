"""Expressions: fixed cases."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import catalog as C
from millrace.functions import routing as R
from millrace.functions import text as T
from millrace.functions import vector as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(value, kind="string"):
    return F.lit(value).cast(kind)


@pytest.mark.parametrize("raw, clean", [
    ("<s_cord-v2>hello</s_cord-v2>", "hello"), ("  <s_docvqa> a </s_docvqa> ", "a"), ("plain", "plain"), ("", ""), ("<s_x>", ""),
    ("<s_a><s_b>v</s_b></s_a>", "<s_b>v</s_b>"), ("x<s_a>", "x<s_a>"), ("</s_a>x", "</s_a>x"), ("<s_a>x</s_b>", "x"),
])
def test_strip_task(spark, raw, clean):
    assert one(spark, T.strip_task(lit(raw))) == clean


def test_answers_and_lines(spark):
    assert one(spark, T.document_answer(lit(" The total is 5</s_answer></s_docvqa>"))) == "The total is 5"
    assert one(spark, T.document_answer(lit("none"))) == "none"
    assert one(spark, T.recover_lines(lit(" headingThis is it.Next one?Élan "))) == "heading\nThis is it.\nNext one?\nÉlan"
    assert one(spark, T.clean_transcript(lit(" <|en|> <|0.00|> hi<|1|> there <|x"))) == "hi there <|x"
    assert one(spark, T.clean_transcript(lit("<|a|>\n<|b|>"))) == ""


def test_trim_and_tail(spark):
    assert one(spark, T.trim(lit("   a b\t\n"))) == "a b"
    assert one(spark, T.tail(lit("aéé"), 3)) == "é"
    assert one(spark, T.tail(lit("abc"), 9)) == "abc"
    assert one(spark, T.tail(lit("xx\U0001f600y"), 4)) == "y"


def test_sections(spark):
    assert one(spark, T.trimmed_sections(lit("a\n\n b \n\n\n\nc"))) == ["a", "b", "c"]
    assert one(spark, T.trimmed_sections(lit("a\nb"))) == ["a", "b"]
    assert one(spark, T.trimmed_sections(lit("One. Two. Three"))) == ["One.", "Two.", "Three"]
    assert one(spark, T.trimmed_sections(lit("a#b"), "#")) == ["a", "b"]
    assert one(spark, T.trimmed_sections(lit(" "))) == []


@pytest.mark.parametrize("label, plain, canonical", [("O", "", ""), ("", "", ""), ("B-PER", "PER", "PER"), ("I-person", "person", "PER"), ("GPE", "GPE", "LOC"), ("E-Company", "Company", "ORG"), ("x", "x", "X")])
def test_labels(spark, label, plain, canonical):
    assert one(spark, T.label_type(lit(label))) == plain
    assert one(spark, T.canonical_label(lit(label))) == canonical


def test_hypothesis(spark):
    assert one(spark, T.hypothesis(F.lit("It is {} or {}."), F.lit("{}x"))) == "It is {}x or {}."
    assert one(spark, T.hypothesis(F.lit("none"), F.lit("x"))) == "none"


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.l2_normalize(v)) == [0.6, 0.8]
    assert one(spark, V.l2_normalize(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, V.cosine(v, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, V.argmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)))) == 1
    assert one(spark, V.top_k(F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25)), 2)) == [0.5, 0.25, 0.25]
    assert one(spark, V.top_p(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25)), 0.6)) == pytest.approx([1 / 3, 2 / 3, 0])
    assert one(spark, V.sample(F.array(F.lit(0.25), F.lit(0.75)), F.lit(0.25))) == 1
    assert one(spark, V.relevance(F.array(F.lit(7.0)))) == 7.0
    assert one(spark, V.relevance(F.array(F.lit(0.0), F.lit(0.0)))) == 0.5
    assert one(spark, V.resample(F.array(F.lit(0.0), F.lit(2.0), F.lit(4.0), F.lit(6.0)), 4, 8)) == [0, 1, 2, 3, 4, 5, 6, 6]
    assert one(spark, V.resample(F.array().cast("array<double>"), 4, 8)) == []


def test_routing(spark):
    assert one(spark, R.glob_match(F.lit("a.b-1"), F.lit("a.*"))) is True
    assert one(spark, R.glob_match(F.lit("axb"), F.lit("a.*"))) is False
    assert one(spark, R.fnv1a(F.lit("a"))) == 0xE40C292C and one(spark, R.fnv1a(F.lit(""))) == 2166136261
    assert one(spark, R.threshold(F.lit(" >= 100ms"))).asDict() == {"op": ">=", "value": 0.1}
    assert one(spark, R.threshold(F.lit("x")))["value"] is None
    assert one(spark, R.topology_product(F.lit("2x4"))) == 8 and one(spark, R.topology_product(F.lit("axb"))) == 4
    day = lambda h, d="2024-01-07", **k: one(spark, R.in_window(lit(f"{d} {h}", "timestamp"), F.lit(k.get("a", 1320)), F.lit(k.get("b", 360)), F.array(*[F.lit(x) for x in k.get("days", [0])])))
    assert day("23:00:00") and day("05:59:00") and not day("06:00:00") and not day("23:00:00", days=[1])


def test_catalog(spark):
    assert one(spark, C.byte_size(F.lit(1536))) == "1.5 KB" and one(spark, C.byte_size(F.lit(3 << 30))) == "3.0 GB" and one(spark, C.byte_size(F.lit(5))) == "5 B"
    assert one(spark, C.model_size(F.lit("x/gemma-12b-it"))) == 12 and one(spark, C.model_size(F.lit("x"))) == 999
    assert one(spark, C.folder(F.lit("a/b/c"))) == "a/b" and one(spark, C.folder(F.lit("c"))) == "."


def test_sizes_have_no_commas(spark):
    from millrace.functions import catalog

    rows = spark.createDataFrame([(1023,), (1048500,), (1073741000,), (1 << 41,)], "n long")
    assert [r[0] for r in rows.select(catalog.byte_size(F.col("n"))).collect()] == ["1023 B", "1023.9 KB", "1024.0 MB", "2048.0 GB"]


def test_rounded_to_a_zero_with_its_sign(spark):
    values = [-1e-9, -0.0, 0.0, 1e-9, -0.0000005, 1.2345678, float("nan"), None]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(V.rounded(F.col("v"), 6).alias("x")).collect()]
    assert repr(got) == "[-0.0, -0.0, 0.0, 0.0, -1e-06, 1.234568, nan, None]"
