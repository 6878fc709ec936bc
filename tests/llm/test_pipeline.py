"""The pipeline on planted documents."""

import random

import public_tokenizers as P

import corpus_pipeline
from tests.llm.test_packing import check


def test_planted(spark, tmp_path):
    rng = random.Random(6)
    syllables = {"aa": ["ba", "be", "lo", "mi", "ta"], "bb": ["zu", "xo", "qi", "vy", "wo"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(2, 4)))
    prose = lambda lang, n: " ".join(word(lang) for _ in range(n))
    passage = prose("aa", 40)
    rows, labels, toxic, near = [], [], set(), set()
    for i in range(400):
        lang = rng.choice(["aa", "bb"])
        text = prose(lang, rng.randint(60, 200))
        if i % 10 == 3:
            text += " Vileone viletwo, vileone"
            toxic.add(i)
        elif i % 10 == 5 and i > 100:
            words = next(r for r in rows if r[0] == i - 5)[1].split()
            words[len(words) // 2] = "other"
            text = " ".join(words)
            near.add(i)
        elif i % 10 == 7:
            text = text + " " + passage + " " + prose(lang, 10)
        rows.append((i, text, lang, "s", len(text)))
        if i % 3:
            labels.append((i, 1, int(i in toxic)))
    junk = {1000: None, 1001: "", 1002: "12345 !!", 1003: "  "}
    rows += [(i, t, None, "s", 0) for i, t in junk.items()]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {r[0] for r in rows} - set(junk)
    assert set(kept["language"]) == clean
    assert set(kept["toxicity"]) == clean - toxic
    assert set(kept["near_duplicates"]) == clean - toxic - near
    last = kept["repeated_passages"]
    assert set(last) == set(kept["near_duplicates"])
    assert [i for i, t in last.items() if passage in t] == [min(i for i in last if i % 10 == 7)]
    assert all(t == kept["toxicity"][i] for i, t in last.items() if i % 10 in (0, 1, 2))
    made = corpus_pipeline.run(spark, sf).collect()
    check([(i, t) for i, t in last.items()], made, 2048)
    assert P.path("byte_bpe_50k.json")


def test_empty_table(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_distinct_keeps_null_and_repeated_ids(spark):
    rng = random.Random(2)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**5)}" for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, a), (None, b), (7, b), (3, c), (3, d), (3, d), (None, e + " more"), (None, e)]
    docs = spark.createDataFrame([(i, t, "x", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.distinct(spark, docs, "").collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, e if r.text.startswith(e) else r.text) for r in out)
    assert got == sorted([(-1, a), (7, b), (3, c), (3, d), (-1, e)])
