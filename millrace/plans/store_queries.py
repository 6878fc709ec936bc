"""Queries over files in stores: indexes, verified copies, reads under limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import vector as V
from millrace.operators import catalogue, chunking
from millrace.operators.cache import ResultCache
from millrace.plans.registry import query, table
from millrace.sources import blobs, fetch, index, vectors
from millrace.sources.stores import new_folder, store


def _entries(spark, sf_dir):
    k = F.col("doc_id")
    kind = F.get(F.array(F.lit("embedder"), F.lit("generator"), F.lit("recognizer"), F.lit("reader")), (k % 4).cast("int"))
    variants = F.when(k % 3 == 0, F.array(F.lit("f16"), F.lit("i8"))).when(k % 3 == 1, F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("m"), k.cast("string")).alias("name"), F.concat_ws("/", "source", F.concat(F.lit("m"), k.cast("string"))).alias("source"), F.col("source").alias("owner"),
                                                    kind.alias("type"), F.col("text").alias("description"), (k * 1500).alias("size"), variants.alias("variants"))


@query("""WITH m AS (SELECT doc_id, source, text, doc_id * 1500 AS n FROM documents WHERE doc_id % 4 = 1)
    SELECT 'm' || doc_id AS name, 'generator' AS type, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END AS size,
        CASE WHEN doc_id % 3 = 0 THEN 'f16,i8' ELSE '' END AS variants, CASE WHEN length(text) > 50 THEN left(text, 47) || '...' ELSE text END AS description FROM m""")
def r012_r161_index_listing(spark, sf_dir):
    """Indexes written from the documents, a file a task, and listed by one type."""
    path = new_folder(spark, "indexes")
    index.write_indexes(_entries(spark, sf_dir), path)
    return catalogue.remote_listing(index.read_indexes(spark, path), "Generators")


@query("""SELECT 'm' || doc_id AS name, source AS owner, strlen(text) AS described FROM documents WHERE starts_with('m' || doc_id, 'm1') AND doc_id % 4 IN (0, 3)""")
def r012_index_by_name(spark, sf_dir):
    """Entries of two types whose name begins with m1: both filters go to the reader."""
    path = new_folder(spark, "indexes")
    index.write_indexes(_entries(spark, sf_dir), path)
    found = index.read_indexes(spark, path).where(F.col("name").startswith("m1") & F.col("type").isin("embedder", "reader"))
    return found.select("name", "owner", F.octet_length("description").alias("described"))


def _artefacts(spark, sf_dir):
    html = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    return table(spark, sf_dir, "pages").select("page_id", "url", html.alias("content"), catalogue.digest(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))


@query("""SELECT 'sha256:' || sha256(html) AS digest, 'model-' || page_id % 7 || '/page-' || page_id || '.html' AS name, strlen(html) AS size FROM pages""")
def r013_verified_copy(spark, sf_dir):
    """Pages as blobs named by their digests, copied from there into model folders, and scanned again."""
    base = new_folder(spark, "blobs")
    pages = _artefacts(spark, sf_dir)
    blob = lambda: F.concat(F.lit("blobs/"), F.replace(F.col("digest"), F.lit(":"), F.lit("-")))
    blobs.copy_verified(pages.dropDuplicates(["digest"]).select(blob().alias("name"), "digest", "size", "content"), base)
    name = F.format_string("model-%d/page-%d.html", F.col("page_id") % 7, F.col("page_id"))
    blobs.copy_verified(pages.select(name.alias("name"), "digest", "size", F.concat(F.lit(f"{base}/"), blob()).alias("source")), f"{base}/models")
    found = fetch.read_files(spark, [f"{base}/models"])
    folder = F.lit(f"{store(base)[1]}/models/")
    return found.select(catalogue.digest(F.col("content")).alias("digest"), F.replace(F.col("path"), folder, F.lit("")).alias("name"), F.col("length").alias("size"))


#: Bytes of the largest page that is fetched.
PAGE_BYTES = 2000


@query(f"""SELECT page_id, CASE WHEN page_id % 5 = 3 THEN 'text/html' END AS mime_type,
        CASE WHEN page_id % 5 IN (0, 3) AND strlen(html) <= {PAGE_BYTES} THEN sha256(html) END AS digest,
        CASE page_id % 5 WHEN 1 THEN CASE WHEN regexp_matches(url, '^https?://') THEN 'no network here' ELSE 'outside the allowed folders' END WHEN 2 THEN 'not found' WHEN 4 THEN 'outside the allowed folders'
            ELSE CASE WHEN strlen(html) > {PAGE_BYTES} THEN 'larger than {PAGE_BYTES} bytes' END END AS error FROM pages""")
def r004_fetch(spark, sf_dir):
    """Pages as files, data URIs, addresses of the network, names that are not there or not allowed."""
    base = new_folder(spark, "fetched")
    pages = _artefacts(spark, sf_dir)
    blobs.copy_verified(pages.select(F.format_string("pages/%d.html", "page_id").alias("name"), "digest", "content"), base)
    k, root = F.col("page_id") % 5, f"{store(base)[1]}/pages"
    url = (F.when(k == 0, F.format_string(f"file://{root}/%d.html", "page_id")).when(k == 1, F.col("url")).when(k == 2, F.format_string(f"{root}/absent-%d", "page_id"))
           .when(k == 3, F.concat(F.lit("data:text/html;base64,"), F.base64("content"))).otherwise(F.lit("file:///elsewhere/page.html")))
    out = fetch.fetch(pages.select("page_id", url.alias("url")), [root], file_bytes=PAGE_BYTES)
    return out.select("page_id", "mime_type", F.sha2("content", 256).alias("digest"), "error")


@query("""WITH k AS (SELECT doc_id, text, sha256('fixed-bert-tokenizer:500:50:' || chr(10) || chr(10) || ':50:0.500' || sha256(text)) AS key FROM documents),
    n AS (SELECT count(DISTINCT key) AS keys, count(DISTINCT key) FILTER (doc_id < (SELECT avg(doc_id) FROM k)) AS early FROM k)
    SELECT doc_id, key, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_words, early AS computed_first, keys - early AS computed_next, 0 AS computed_again FROM k, n""")
def r119_r120_r122_result_cache(spark, sf_dir):
    """The earlier half of the documents, then all, then all again: each key is computed once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, key = new_folder(spark, "results"), chunking.chunk_key(F.col("text"), chunking.ChunkConfig())
    compute = lambda missing: missing.select("_key", F.size(F.split("text", " ", -1)).alias("n_words"))
    middle = docs.agg(F.avg("doc_id").alias("middle"))
    early = docs.join(F.broadcast(middle), F.col("doc_id") < F.col("middle")).select("doc_id", "text")
    counts, out = [], None
    for rows in (early, docs, docs):
        cache = ResultCache(spark, path, ttl=86_400)  # each as a run of its own
        out = cache.apply(rows, key, compute)
        counts.append(F.lit(cache.computed).cast("long"))
    return out.select("doc_id", key.alias("key"), "n_words", *[c.alias(f"computed_{n}") for c, n in zip(counts, ("first", "next", "again"))])


@query("""SELECT CAST(len(embedding) AS INTEGER) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, round(CAST(embedding[1] AS DOUBLE), 6) AS head FROM embeddings""")
def r005_r006_vector_files(spark, sf_dir):
    """Embeddings as files of the binary form, read back in parts of 16 KB."""
    path = new_folder(spark, "vectors")
    vectors.write_vectors(table(spark, sf_dir, "embeddings"), path)
    found = vectors.read_vectors(spark, path, range_bytes=16 << 10)
    return found.select(F.size("vector").alias("width"), V.rounded(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), V.rounded(F.get("vector", F.lit(0)).cast("double"), 6).alias("head"))
