"""Queries without SQL give whole texts to their operators."""

import __spark_entry__
from tests.test_entry import DIR


def test_rewrite_reads_whole_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}
    out = {r.doc_id: r.texts for r in __spark_entry__.queries()["r091_r093_rewrite"](spark, DIR).collect()}
    assert max(len(t or "") for t in texts.values()) > 80
    for i, t in texts.items():
        if t is not None:
            assert out[i] == [" ".join(reversed(f"generate question: <hl> {t} <hl> {t}".split()))]


def test_encoded_spans_of_texts_without_tokens(spark, tmp_path):
    spark.createDataFrame([(1, ""), (2, None), (3, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = __spark_entry__.queries()["r036_r038_encode_spans"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(1, 0, None), (2, 0, None), (3, 2, 3)]
