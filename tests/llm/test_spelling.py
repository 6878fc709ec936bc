"""Spelling variants against comparing all words."""

import random
import zlib
from collections import Counter

from millrace.llm import spelling


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    p = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[p:] == b[p + 1 :] if len(a) < len(b) else a[p + 1 :] == b[p + 1 :]


def plain(counts, factor=10):
    near = {w: [v for v in counts if distance_one(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def got(frame):
    rows = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in frame.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def edited(rng, w, letters):
    p = rng.randrange(len(w))
    return rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice(letters) + w[p:], w[:p] + rng.choice(letters) + w[p + 1 :], w + rng.choice(letters), rng.choice(letters) + w])


def test_all_words(spark):
    rng = random.Random(7)
    for letters in ("ab", "abcdeéÿ"):
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(150)} | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababab", "a" * 300, "a" * 150 + "b" + "a" * 150}
        for _ in range(3):
            words |= {e for w in list(words) if len(e := edited(rng, w, letters)) >= 4 and rng.random() < 0.3}
        counts = {w: rng.choice([1, 1, 2, 9, 10, 100, 1000, 10_000]) for w in words}
        frame = spark.createDataFrame([*counts.items(), (None, 5)], "word string, n long")
        assert got(spelling.variants(frame)) == plain(counts)


def test_chain_and_ties(spark):
    counts = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "xbcdefghi": 10_000, "yyyyyyy": 2, "zyyyyyy": 20, "ayyyyyy": 20, "éyyyyyy": 20, "lonely": 3}
    out = got(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert out == plain(counts)
    assert out["abcdefg"][1] == "xbcdefghi" and out["yyyyyyy"][0] == "ayyyyyy"


def test_short_words_and_nothing(spark):
    out = got(spelling.variants(spark.createDataFrame([("abc", 1), ("abd", 50), ("", 4)], "word string, n long")))
    assert out == {"abc": (None, "abc", 1, 0, None), "abd": (None, "abd", 50, 0, None), "": (None, "", 4, 0, None)}
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_words_of_documents(spark):
    texts = ["Straße ÀÉÎõü×÷ abcdefg1abcdefgh", None, "", "ABCdefgh " * 200, "x" * 5000, "İstanbul'dan Ünïcödé"]
    rows = [(i, t, "w") for i, t in enumerate(texts * 3)] + [(None, "nullnullid", "w"), (5, "ABCdefgh", "w"), (5, "ABCdefgh", "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, word string")
    import re

    want = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    out = {r.word: r.n for r in spelling.count_words(spelling.document_words(frame, 7), 7, 2).collect()}
    assert out == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}


def test_documents_alike_to_sql(spark):
    import duckdb

    from millrace.llm.queries import ORACLE, op11_spelling_variants

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    rel = con.sql(ORACLE["op11_spelling_variants"])
    want = {tuple(dict(zip(rel.columns, r))[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rel.fetchall()}
    out = op11_spelling_variants(spark, path)
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in out.collect()} == want
