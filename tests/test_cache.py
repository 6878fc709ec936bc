"""Results are computed once a key, outlive the run, and expire."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators.cache import ResultCache

key = lambda: F.sha2("text", 256)


def lengths(spark, seen):
    def compute(missing):
        def count(text):
            seen.add(1)
            return len(text)

        return missing.withColumn("n", F.udf(count, "int")("text"))

    return compute


def test_second_run_computes_nothing(spark, tmp_path):
    now, seen = [1000.0], spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i, f"text {i % 7}", "k") for i in range(50)] + [(50, None, "k")], "id long, text string, r string")
    cache = lambda: ResultCache(spark, f"{tmp_path}/c", 120, lambda: now[0])
    want = {i: len(f"text {i % 7}") for i in range(50)} | {50: None}
    one = cache()
    out = one.apply(rows, key(), lengths(spark, seen))
    assert out.columns == ["id", "text", "r", "n"] and {r.id: r.n for r in out.collect()} == want
    assert (one.asked, one.computed, seen.value) == (7, 7, 7)
    two = cache()
    assert {r.id: r.n for r in two.apply(rows, key(), lengths(spark, seen)).collect()} == want
    assert (two.asked, two.computed, seen.value) == (7, 0, 7)
    more = rows.unionByName(spark.createDataFrame([(60, "other", "k")], rows.schema))
    assert {r.id: r.n for r in two.apply(more, key(), lengths(spark, seen)).collect()} == want | {60: 5}
    assert (two.asked, two.computed, seen.value) == (8, 1, 8)
    now[0] = 1119.0
    assert cache().sweep() == 0
    now[0] = 1120.0
    three = cache()
    assert {r.id: r.n for r in three.apply(rows, key(), lengths(spark, seen)).collect()} == want and three.computed == 7
    assert three.sweep() == 2 and len([n for n in os.listdir(tmp_path / "c") if n.startswith("until")]) == 1
    assert three.apply(rows.where("false"), key(), lengths(spark, seen)).count() == 0


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "id long, text string")
    broken = lambda missing: missing.withColumn("n", F.when(F.col("text") == "text 7", F.raise_error(F.lit("stop")).cast("int")).otherwise(1))
    cache = ResultCache(spark, f"{tmp_path}/c", 120, lambda: 0.0)
    with pytest.raises(Exception, match="stop"):
        cache.apply(rows, key(), broken).count()
    assert cache.live("_key string, n int").count() == 0
    cache.sweep()
    out = cache.apply(rows, key(), lambda missing: missing.withColumn("n", F.length("text")))
    assert cache.computed == 20 and out.where("n is null").count() == 0


def test_runs_at_the_same_time_may_repeat_keys(spark, tmp_path):
    rows = spark.createDataFrame([(i, "same") for i in range(5)], "id long, text string")
    compute = lambda missing: missing.withColumn("n", F.length("text"))
    ResultCache(spark, f"{tmp_path}/c", 120, lambda: 0.0).apply(rows, key(), compute)
    (folder,) = [n for n in os.listdir(tmp_path / "c") if n.startswith("until")]
    import shutil

    shutil.copytree(tmp_path / "c" / folder, tmp_path / "c" / (folder + "b"))
    assert ResultCache(spark, f"{tmp_path}/c", 120, lambda: 1.0).apply(rows, key(), compute).count() == 5
