"""Fingerprints and edited texts against plain Python."""

import hashlib
import re
import unicodedata

import pytest
from xxhash import xxh64_intdigest

from millrace.llm import fingerprint

SPACES = re.compile("[\\s\x85\xa0  -     　]+")
TEXTS = ["Straße  café", "STRASSE café ", "", None, "  ", "abc", "ABC", "abc d", "abc d", "\U0001f600x" * 9, "가", "가", "abc", "long " * 5000, "İx", "ςσΣ", "ạ̇", "ạ̇"]


def canonical(t):
    t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", t or "").casefold())
    return SPACES.sub(" ", t).strip(" ")


def digest(t):
    raw = canonical(t).encode()
    second = xxh64_intdigest(raw, xxh64_intdigest(b"second seed", 42))
    return f"{xxh64_intdigest(raw, 42):016x}{second:016x}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(3 * i, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, d string")


def test_fingerprints(docs):
    out = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    assert out == {3 * i: digest(t) for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("size", [1, 40, 16 << 20])
def test_edited(docs, monkeypatch, size):
    monkeypatch.setattr(fingerprint, "INTERVAL_BYTES", size)
    out = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    order = list(range(len(TEXTS)))[::-1]
    for at, i in enumerate(order):
        t, after = TEXTS[i] or "", TEXTS[order[(at + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = out[3 * i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (digest(t), digest(edited))
        assert (r.near_edited, r.near_next) == (float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(after)))


def test_small_tables(docs, spark):
    assert fingerprint.edited_fingerprints(docs.where("false")).count() == 0
    one = fingerprint.edited_fingerprints(docs.where("doc_id = 15")).first()
    assert one.near_next == 1.0 and one.n_chars == 3
    twice = docs.where("doc_id = 15").unionByName(docs.where("doc_id in (15, 18)"))
    assert fingerprint.edited_fingerprints(twice).count() == 3


def test_clashing_buckets(docs, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprint, "digest", lambda c: F.lpad(F.hex(F.length(c)), 32, "0"))
    out = {r.doc_id // 3: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    for a in range(len(TEXTS)):
        for b in range(len(TEXTS)):
            assert (out[a] == out[b]) == (canonical(TEXTS[a]) == canonical(TEXTS[b]))
