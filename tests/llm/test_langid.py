"""Language identification against a plain PPM over counters."""

from collections import Counter, defaultdict
from math import log2

import numpy as np

from millrace.llm import langid

TEXTS = {"a": ["abc abd abe the quick", "abcabc", "ünïcode"], "b": ["zyx zyw zyx fox", "zzz", "x"]}


def plain(text: bytes, texts: list[str]) -> float:
    raw = b"".join(b"\n\n\n" + t.encode() for t in texts) + b"\n"
    counts = [defaultdict(Counter) for _ in range(4)]
    for i in range(3, len(raw)):
        for k in range(4):
            counts[k][raw[i - k : i]][raw[i]] += 1
    total, x = 0.0, b"\n\n\n" + text
    for i in range(3, len(x)):
        for k in (3, 2, 1, 0, -1):
            if k < 0:
                total += 8
                break
            c = counts[k].get(x[i - k : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if x[i] in c:
                total -= log2(c[x[i]] / (n + d))
                break
            total -= log2(d / (n + d))
    return total


def test_code_lengths():
    model = langid.train(TEXTS)
    scorer = langid.Scorer(model)
    texts = [b"abc the fox", b"zyx", b"q", b"\xff\xfe", b"", "ünï the".encode(), b"abcabd" * 50]
    got = scorer.totals(texts)
    for row, text in zip(got, texts):
        assert np.allclose(row, [plain(text, TEXTS[lang]) for lang in ("a", "b")], atol=1e-3), text


def test_long_texts_by_blocks(monkeypatch):
    scorer = langid.Scorer(langid.train(TEXTS))
    texts = [b"abc the fox " * 9, b"zyx", b"quick"]
    whole = scorer.totals(texts)
    monkeypatch.setattr(langid, "BLOCK", 16)
    assert np.allclose(scorer.totals(texts), whole, atol=1e-3)


def test_identify(spark):
    rows = [(i, t, lang, "x") for lang, texts in TEXTS.items() for i, t in enumerate(texts)]
    rows += [(10, None, "a", "x"), (11, "", None, "x"), (12, "123 !", None, "x"), (13, "zyx zyx", None, "x"), (13, "zyx zyx", None, "x"), (14, "abc " * 9000, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [out[i].lang_pred for i in (10, 11, 12, 13, 14)] == ["und", "und", "und", "b", "a"]
    assert all(0 <= r.score <= 1 for r in out.values())
    assert langid.identify(docs).count() == len(rows)
    assert langid.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.where("lang is null")).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rows = [(i, "".join(chr(0x4E00 + 40 * (i % 90) + (i // 90 * 7 + k) % 40) for k in range(30)), f"l{i % 90:02d}") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) > 100 and all(r.lang_pred == r.lang for r in out)


def test_the_sample_holds_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 200_000)
    rows = [(1, "a" * 90_000, "x"), (2, "b" * 500_000, "x"), (3, "c" * 300_000, "y"), (4, "d" * 400_000, "y"), (5, None, "y"), (5, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(docs, langid.F.lit(True), "doc_id", "text", "lang")
    assert {k: [(t[0], len(t)) for t in v] for k, v in got.items()} == {"x": [("a", 90_000)], "y": [("c", 300_000)]}


def test_languages_that_were_not_learned_go(spark):
    import random

    rng = random.Random(2)
    parts = {"a": "an the er is to of in at on ea th wh".split(), "b": "der die und ein sch ung ich ge be ver zu".split()}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3)))
    text = lambda lang, n=40: " ".join(word(lang) for _ in range(n)) + "."
    secret = "".join(rng.choice("0123456789abcdef") for _ in range(32))
    rows = [(i, text(lang, rng.randint(3, 80)), lang) for i, lang in enumerate(["a", "b"] * 150)]
    rows += [(400, f"{text('a', 4)} token={secret} {text('a', 2)}", "a"), (401, text("b", 3000), "b")]
    gone = [(500, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.", "pl"), (501, "Все люди рождаются свободными и равными в своем достоинстве и правах.", None),
            (502, "xkcd qwrtz zxcv bnmk pqrs tvwx zzzz kkjh gfds plmk njhb vgtf crdx " * 2, "a"), (503, None, "a"), (504, "12 !", "a")]
    held = {i for i in range(500, 510) if __import__("zlib").crc32(str(i).encode()) % 3 == 1}
    docs = spark.createDataFrame(rows + [(i, t, lang if lang == "a" and i in held else None) for i, t, lang in gone], "doc_id long, text string, lang string")
    out = langid.accepted(docs, 0.5)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r[0] for r in rows}
    few = spark.createDataFrame(rows[:10] + [(501, gone[1][1], None)], "doc_id long, text string, lang string")
    assert langid.accepted(few, 0.5).count() == 11  # too few texts to know how rates vary
    assert langid.accepted(docs.where("false"), 0.5).count() == 0
