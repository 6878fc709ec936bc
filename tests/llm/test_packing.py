"""Packing: exact ids, gapless sequences, and close to the fewest."""

import zlib

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = P.path("byte_bpe_50k.json")


def library(special_as_text=False):
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = special_as_text
    return own


TEXTS = ["", "a b", "it's\n\n  x\x85 y", "é中½ ʼ<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n<|endoftext", "\x1c\x1d x", "word " * 30000,
         "x" * 70, "\u2028 \u3000y", "ab\n \n\n c", "".join(map(chr, range(1, 0x500))), "🙂🙂 \U0001d400", "É" * 40]


@pytest.mark.parametrize("special_as_text", [False, True])
def test_tokens(special_as_text):
    own, lib = packing.Tokens(PATH, special_as_text), library(special_as_text)
    assert own.ranks is not None
    for text in TEXTS:
        assert memoryview(own.pack(text)).cast("I").tolist() == lib.encode(text, add_special_tokens=False).ids
    own.ranks = None
    own.clear()
    for text in TEXTS:
        assert memoryview(own.pack(text)).cast("I").tolist() == lib.encode(text, add_special_tokens=False).ids


def check(rows, out, size):
    lib, pieces = library(), {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in dict(rows).items():
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // size))) and mine[0].start == 0
        for r in mine:
            part = ids[r.start : r.start + r.length]
            assert len(part) == r.length and (r.piece == 0 or r.length == size)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), -(-sum(r.length for r in out) // size)


@pytest.mark.parametrize("stream", [1 << 16, 40])
def test_pack_documents(spark, monkeypatch, stream):
    monkeypatch.setattr(packing, "STREAM", stream)
    rows = [(i, "w%d " % (i % 7) * (i * 37 % 400)) for i in range(300)] + [(1000, None), (1001, ""), (1002, "abc " * 9000), (1003, "a <|endoftext|> b")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int")
    out = packing.pack_documents(docs, PATH, 512).collect()
    made, least = check(rows, out, 512)
    assert made <= 1.03 * least + 2
    assert packing.pack_documents(docs.where("false"), PATH, 512).count() == 0


def test_sequences(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d"), (2, "d")], "doc_id long, text string")
    out = packing.pack_documents(docs, PATH, 64, with_ids=True)
    (row,) = packing.sequences(out).collect()
    assert len(row.ids) == 4 * out.agg({"length": "sum"}).first()[0] and row.ids.endswith(b"\0" * 4)


def test_best_fit_closes_the_fullest():
    packer = packing.BestFit(10, 2)
    assert packer.put(6) == (0, 0) and packer.put(7) == (1, 0) and packer.put(4) == (0, 6)
    assert packer.closed == [0] and packer.put(9) == (2, 0) and packer.put(8) == (3, 0)
    assert packer.closed == [0, 2]
