"""One thin query for each operator, with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, embed_dedup, fingerprint, langid, packing, prefix_trie, sharding, simhash, spelling, suffix_dedup, toxicity, url_filter, warc
from millrace.llm._shared import shared_dir, spread, written

#: Byte limit of a shard: small enough for the small tables to have several.
SHARD_BYTES = 256 << 10
#: Code points and occurrences of a word whose spelling is judged.
LEAST_LETTERS, LEAST_COUNT = 7, 2
#: Bytes of the smallest payload that is not written again.
LEAST_PAYLOAD = 0
#: Conversations that share a head, and one more than the turns of it at most.
HEADS = (5, 9)
#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(spelling.document_words(table(spark, sf_dir, "documents"), LEAST_LETTERS), LEAST_LETTERS, LEAST_COUNT)
    return spelling.variants(written(words, "words"))


def page_records(found: DataFrame) -> DataFrame:
    """Rows of read archives by page."""
    page = lambda c: F.expr(f"try_cast(substr({c}, {len('urn:page:') + 1}) as bigint)")
    return warc.resolved(found).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/millrace/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages"), LEAST_PAYLOAD), path)
    return page_records(written(warc.read_archives(spark, path, payload=False), "records"))


def trie_of(conversations: DataFrame) -> DataFrame:
    """Nodes of conversations whose first turns come from the first one of their HEADS."""
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(prefix_trie.ordered_turns(conversations), *HEADS))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_of(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_toxicity, op3_sharding, op4_simhash, op5_best_fit, op6_language_id, op7_fingerprints, op8_suffix_dedup, op9_url_filter, op10_embedding_near_dedup, op11_spelling_variants, op12_warc, op13_prefix_trie)}


def crc32_sql(list_of_bytes: str) -> str:
    """CRC-32 of a list of bytes in SQL: each byte and eight shifts (-1) folded in turn."""
    steps = f"flatten(list_transform({list_of_bytes}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = "CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: {fold}), 4294967295)"


#: Letters up to U+00FF as the bytes of UTF-8.
LATIN_BYTES = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 + ord(c) // 64)::BIGINT, (128 + ord(c) % 64)::BIGINT] END))"

ORACLE = {
    "op3_sharding": f"""
        WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
                          CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h FROM documents),
        s AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes) AS b, min(h) < max(h) AS many
              FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range(61)) GROUP BY ALL),
        leaf AS (SELECT s.* FROM s LEFT JOIN s AS up ON up.depth = s.depth - 1 AND up.prefix = s.prefix >> 1
                 WHERE NOT (s.b > {SHARD_BYTES} AND s.many) AND (s.depth = 0 OR (up.b > {SHARD_BYTES} AND up.many)))
        SELECT doc_id, n_bytes,
               CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard,
               depth, CAST(b AS BIGINT) AS shard_bytes
        FROM d JOIN leaf ON d.h >> (60 - leaf.depth) = leaf.prefix""",
    "op9_url_filter": r"""
        WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        c AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                             WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                             WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                             WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM b)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM c""",
    "op11_spelling_variants": f"""
        WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{{LEAST_LETTERS},}}')) AS raw FROM documents),
        u AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS named, run, length(run) AS size, count(*) AS c
              FROM (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM r) GROUP BY ALL),
        h AS (SELECT run, size, c, {crc32_sql(LATIN_BYTES.format("named"))} AS h FROM u),
        w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % size AS INTEGER)) || substr(run, CAST(h % size AS INTEGER) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n
              FROM h GROUP BY 1 HAVING length(word) >= {LEAST_LETTERS} AND n >= {LEAST_COUNT}),
        d AS (SELECT word, n, p, left(word, CAST(p AS INTEGER) - 1) || substr(word, CAST(p AS INTEGER) + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
        l AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
              UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
        b AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM l GROUP BY word),
        f AS (SELECT w.word, CASE WHEN near_n >= {spelling.FACTOR} * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {spelling.FACTOR} * n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
        t AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT t.word, f.form, step + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, last(root ORDER BY step) AS root FROM t GROUP BY word) USING (word)""",
    "op12_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        q AS (SELECT page_id, strlen(html) AS n, sha1(html) AS x, max(page_id) OVER (PARTITION BY html) AS first FROM p),
        r AS (SELECT *, n >= {LEAST_PAYLOAD} AND page_id IS DISTINCT FROM first AND first IS NOT NULL AS again FROM q)
        SELECT page_id, n AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r""",
    "op13_prefix_trie": f"""
        WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, conv_id - conv_id % {HEADS[0]} AS head, {crc32_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)")} % {HEADS[1]} AS h FROM (SELECT DISTINCT conv_id FROM t)),
        p AS (SELECT c.conv_id, t.pos AS k, role, text FROM c JOIN t ON t.conv_id = c.head AND t.pos <= c.h UNION ALL SELECT conv_id, h + pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
        q AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS depth, strlen(text) AS n_bytes, sha256(strlen(role) || ':' || role || text) AS x FROM p),
        s AS (SELECT conv_id, depth, n_bytes, sha256(string_agg(x, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM q UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        m AS (SELECT s.*, max(depth) OVER (PARTITION BY conv_id) AS size, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up FROM s),
        n AS (SELECT node, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) * (count(*) - 1) AS saved,
                     sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = size), '')) AS ends_sha256 FROM m GROUP BY node),
        k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
        a AS (SELECT node, node AS above FROM n UNION ALL SELECT a.node, n.up FROM a JOIN n ON n.node = a.above WHERE n.up IS NOT NULL),
        b AS (SELECT a.above AS node, sum(n.saved) AS saved, count(*) FILTER (WHERE k.node IS NULL) AS leaves FROM a JOIN n ON n.node = a.node LEFT JOIN k ON k.node = a.node GROUP BY 1)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM n JOIN b ON b.node = n.node LEFT JOIN k ON k.node = n.node LEFT JOIN n AS u ON u.node = n.up""",
}
