"""The prefix trie against one that is built node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from millrace.llm import prefix_trie
from millrace.llm.queries import ORACLE, op13_prefix_trie, trie_of

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = set()
    below = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (saved + sum(below[c][0] for c in children[p]), sum(below[c][1] for c in children[p]) or 1)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(rebuilt[c]) == len(p))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), below[p][1], below[p][0], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(frame):
    rows = [tuple(r[c] for c in COLUMNS) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def conversations(rng, n):
    rows = []
    for c in range(n):
        for turn in range(rng.choice([1, 2, 3, 5, 12, 30])):
            text = rng.choice(["a", "b", "éé", "", None])
            rows.append((c * rng.choice([1, 1, 1, 5]), rng.choice([turn, turn, None, 3]), rng.choice(["user", None]), text))
    return rows


@pytest.mark.parametrize("block, piece", [(4096, 50_000), (3, 2)])
def test_every_node(spark, monkeypatch, block, piece):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    rng = random.Random(block)
    rows = conversations(rng, 120) + [(None, 1, "user", "a"), (7, 0, "user", "a"), (7, 0, "user", "a")]
    rows += [(c, t, "user", f"turn {t}") for c in range(400, 440) for t in range(15)] + [(900, t, "user", "long") for t in range(400)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, k0 string")
    assert got(trie_of(frame)) == plain(rows)


def test_few_rows(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert trie_of(spark.createDataFrame([], kind)).count() == 0
    short = [(c, 0, None, None) for c in range(1, 40)]  # many are left without turns
    assert got(trie_of(spark.createDataFrame(short, kind))) == plain(short)


def test_same_as_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    rel = con.sql(ORACLE["op13_prefix_trie"])
    place = [rel.columns.index(c) for c in COLUMNS]
    assert got(op13_prefix_trie(spark, path)) == {tuple(r[i] for i in place) for r in rel.fetchall()}
