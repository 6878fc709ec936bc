"""Queries over inputs, media and the model catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import catalog as C
from millrace.operators import catalogue, features, media
from millrace.plans.registry import query, table
from millrace.sources import audio, images, inputs


def _inputs(spark, sf_dir):
    parts = """concat('[{"type":"text","text":"a"},{"type":"image_url","image_url":{"url":"data:image/png;base64,', base64(encode(role, 'utf-8')), '"}},{"type":"media","mime_type":"audio/wav","data":"', base64(encode(role, 'utf-8')), '"},{"type":"odd"}]')"""
    body = F.expr(f"""case turn % 5 when 0 then concat('["', role, '","b"]') when 1 then concat('"', role, '"') when 2 then {parts} when 3 then '{{"x":1}}' else '""' end""")
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", body.alias("input"))


@query("""WITH r AS (SELECT conv_id || '-' || turn AS id, role, turn % 5 AS k FROM conversations),
    e AS (SELECT id, unnest([0, 1]) AS pos, 'text' AS type, unnest([role, 'b']) AS text, NULL AS mime_type, NULL AS size, NULL AS error FROM r WHERE k = 0
        UNION ALL SELECT id, 0, 'text', role, NULL, NULL, NULL FROM r WHERE k = 1
        UNION ALL SELECT id, unnest([0, 1, 2, 3]), unnest(['text', 'image_url', 'media', NULL]), unnest(['a', NULL, NULL, NULL]), unnest([NULL, 'image/png', 'audio/wav', NULL]), unnest([NULL, strlen(role), strlen(role), NULL]), unnest([NULL, NULL, NULL, 'unknown content type at index 3']) FROM r WHERE k = 2
        UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, 'input must be a string, array of strings, or array of content parts' FROM r WHERE k >= 3)
    SELECT id, CAST(pos AS INTEGER) AS pos, type, text, mime_type, CAST(size AS INTEGER) AS size, error FROM e""")
def r001_embed_inputs(spark, sf_dir):
    out = inputs.read_inputs(_inputs(spark, sf_dir))
    return out.select("id", "pos", "part.type", "part.text", "part.mime_type", F.octet_length("part.data").alias("size"), "error")


MIMES = ["text/plain", "image/gif", "image/png", "audio/wav"]


@query(f"SELECT doc_id, ({MIMES})[doc_id % 4 + 1] AS checked_mime FROM documents WHERE doc_id % 4 IN (1, 3)")
def r002_unsupported(spark, sf_dir):
    k = (F.col("doc_id") % 4).cast("int")
    parts = table(spark, sf_dir, "documents").select("doc_id", F.lit("m").alias("model"), F.when(k == 0, "text").otherwise("media").alias("type"), F.get(F.array(*[F.lit(m) for m in MIMES]), k).alias("mime_type"))
    listed = spark.createDataFrame([("m", "text/plain"), ("m", "image/*"), ("m", "image/png")], "model string, mime_type string")
    return inputs.unsupported(parts, listed).select("doc_id", "checked_mime")


@query("""SELECT doc_id, (['image', 'text', 'audio', 'text'])[doc_id % 4 + 1] AS kind, CASE doc_id % 4 WHEN 1 THEN lang WHEN 3 THEN 'http://x/' || lang END AS text, CASE WHEN doc_id % 4 IN (0, 2) THEN md5(lang) END AS digest FROM documents""")
def r003_first_content(spark, sf_dir):
    k = F.col("doc_id") % 4
    part = lambda text=None, url=None, mime=None, data=None: F.struct((text if text is not None else F.lit(None).cast("string")).alias("text"), (url if url is not None else F.lit(None).cast("string")).alias("url"),
        F.lit(mime).cast("string").alias("mime_type"), (data if data is not None else F.lit(None).cast("binary")).alias("data"))
    raw = F.encode("lang", "utf-8")
    parts = F.when(k == 0, F.array(part(F.lit("")), part(mime="image/png", data=raw), part(F.lit("late")))).when(k == 1, F.array(part(F.col("lang")), part(mime="image/png", data=raw)))
    parts = parts.when(k == 2, F.array(part(mime="application/pdf", data=raw), part(mime="audio/wav", data=raw))).otherwise(F.array(part(url=F.concat(F.lit("http://x/"), "lang"))))
    return table(spark, sf_dir, "documents").select("doc_id", inputs.first_content(parts).alias("c")).select("doc_id", "c.kind", "c.text", F.md5("c.data").alias("digest"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'image/png' ELSE 'text/plain' END AS mime_type, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'a b&' || lang END) AS digest FROM documents""")
def r004_data_uris(spark, sf_dir):
    uri = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("text", "utf-8")))).otherwise(F.concat(F.lit("data:,a%20b%26"), "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", inputs.data_uri_mime(uri).alias("mime_type"), F.md5(inputs.data_uri_bytes(uri)).alias("digest"))


@query("""SELECT page_id, regexp_matches(url, '^https?://') AS allowed, FALSE AS private FROM pages""")
def r004_addresses(spark, sf_dir):
    private = inputs.allowed_address(F.regexp_replace("url", "://[^/]*", "://192.168.0.1"))
    return table(spark, sf_dir, "pages").select("page_id", inputs.allowed_address(F.col("url")).alias("allowed"), private.alias("private"))


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}' AS body, CASE WHEN doc_id % 2 = 0 THEN 'json' ELSE 'binary' END AS format FROM documents""")
def r007_answers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    accept = F.when(F.col("doc_id") % 2 == 0, "application/json").otherwise("*/*")
    return inputs.to_answers(docs, "doc_id", "doc_id", "lang", "n_chars").withColumn("format", inputs.answer_format(accept))


SAMPLES = "list_transform(range(doc_id % 50 + 8), lambda i: CAST((i * (doc_id + 3)) % 256 - 128 AS DOUBLE) / 100)"
CLAMPED = f"list_transform({SAMPLES}, lambda x: greatest(-1.0, least(1.0, x)))"


def _sounds(spark, sf_dir):
    samples = F.expr("transform(sequence(0, cast(doc_id % 50 + 7 as int)), i -> cast(cast((i * (doc_id + 3)) % 256 - 128 as double) / 100 as float))")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), samples.alias("samples"), F.lit(1000).alias("sample_rate"), F.get(F.array(F.lit(8), F.lit(16), F.lit(24), F.lit(32)), (F.col("doc_id") % 4).cast("int")).alias("bits"), (F.col("doc_id") % 2 + 1).cast("int").alias("channels"))


@query(f"""WITH d AS (SELECT doc_id AS path, doc_id, {CLAMPED} AS s FROM documents)
    SELECT path, 1000 AS sample_rate, ([8, 16, 24, 32])[doc_id % 4 + 1] AS bits, CAST(doc_id % 2 + 1 AS INTEGER) AS channels, CAST(len(s) AS INTEGER) AS n,
        round(list_sum(list_transform(s, lambda x: CASE doc_id % 4 WHEN 0 THEN round(x * 127) / 128 WHEN 1 THEN round(x * 32767) / 32768 ELSE x END)), 3) + 0.0 AS total FROM d""")
def r008_r009_wav(spark, sf_dir):
    files = audio.write_wav(_sounds(spark, sf_dir), "path")
    out = audio.read_wav(files)
    s = F.col("sound")
    return out.select("path", s["sample_rate"].alias("sample_rate"), s["bits"].alias("bits"), s["channels"].alias("channels"), F.size(s["samples"]).alias("n"), (F.round(F.aggregate(s["samples"], F.lit(0.0), lambda a, x: a + x.cast("double")), 3) + 0.0).alias("total"))


@query("""WITH d AS (SELECT doc_id, doc_id % 5000 + 1 AS n FROM documents)
    SELECT doc_id, CAST(i // 750 AS INTEGER) AS chunk_id, CAST(i AS INTEGER) AS start, CAST(least(i + 1000, n) AS INTEGER) AS "end", CAST(i AS FLOAT) AS start_ms, CAST(least(i + 1000, n) AS FLOAT) AS end_ms
    FROM d, (SELECT unnest(range(0, 5001, 750)) AS i) WHERE i < n AND i // 750 < 5""")
def r033_windows(spark, sf_dir):
    n = (F.col("doc_id") % 5000 + 1).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(media.windows(n, F.lit(1000), 1000, 250, 5)).alias("w")).select("doc_id", "w.*")


@query("""SELECT doc_id, (['wav', 'wav', 'mp3', 'gif', NULL])[doc_id % 5 + 1] AS kind FROM documents""")
def r032_media_kinds(spark, sf_dir):
    mime = F.get(F.array(F.lit(" Audio/WAV"), F.lit("audio/x-wav"), F.lit("audio/mp3"), F.lit("image/gif "), F.lit("video/mp4")), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", media.media_kind(mime).alias("kind"))


@query(f"""WITH d AS (SELECT doc_id, {CLAMPED} AS s FROM documents), w AS (SELECT doc_id, s, unnest(range(0, 60, 15)) AS i FROM d)
    SELECT doc_id AS path, CAST(i // 15 AS INTEGER) AS chunk_id, 'audio/wav' AS mime_type, CAST(least(20, len(s) - i) AS INTEGER) AS n, CAST(i AS FLOAT) AS start_time_ms, CAST(least(i + 20, len(s)) AS FLOAT) AS end_time_ms FROM w WHERE i < len(s)""")
def r034_sound_chunks(spark, sf_dir):
    files = audio.write_wav(_sounds(spark, sf_dir), "path").withColumn("mime_type", F.lit("audio/wav"))
    chunks = media.chunk_media(files, 20, 5)
    read = audio.read_wav(chunks.select(F.struct("path", "chunk_id", "mime_type", "start_time_ms", "end_time_ms").alias("id"), "data"), "id", "data")
    return read.select("id.*", F.size("sound.samples").alias("n")).select("path", "chunk_id", "mime_type", "n", "start_time_ms", "end_time_ms")


def _gif(frames: int, seed: int) -> bytes:
    """A GIF of 4 x 3 pixels, its colour numbers as uncompressed codes of two bits and a clear code before each pair."""
    out = b"GIF89a" + bytes([4, 0, 3, 0, 0x81, 0, 0]) + bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    for f in range(frames):
        out += bytes([0x21, 0xF9, 4, (f % 3) << 2 | (f > 0), 10 + f, 0, 0, 0]) + bytes([0x2C, 0, 0, 0, 0, 4, 0, 3, 0, 0, 2])
        bits, n = 0, 0
        for k in range(12):
            for code in ([4] if k % 2 == 0 else []) + [(k + f + seed) % 4]:
                bits, n = bits | code << n, n + 3
        bits, n = bits | 5 << n, n + 3
        body = bits.to_bytes(-(-n // 8), "little")
        out += bytes([len(body)]) + body + b"\0"
    return out + b";"


def _gifs(spark, sf_dir):
    make = lambda: lambda batch: [_gif(k % 4 + 1, k % 7) for (k,) in batch]
    from millrace.operators.tokens import run_model

    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit("image/gif").alias("mime_type"))
    return run_model(rows, make, ["path"], "content", "binary")


@query("""SELECT doc_id AS path, CAST(f AS INTEGER) AS chunk_id, 'image/png' AS mime_type, CAST(f AS INTEGER) AS frame_index, CAST((10 + f) * 10 AS INTEGER) AS frame_delay_ms FROM documents, range(4) r(f) WHERE f <= doc_id % 4 AND f < 3""")
def r011_r035_gif_frames(spark, sf_dir):
    return media.chunk_media(_gifs(spark, sf_dir), most=3).select("path", "chunk_id", "mime_type", "frame_index", "frame_delay_ms")


@query()
def r103_r104_pixels(spark, sf_dir):
    decode = lambda raw: features.crop_margin(features.pad_image(images.gif_frames(raw, 1)[0]["pixels"], 8, 6, (0, 0, 0, 255)), 0)
    return features.image_features(_gifs(spark, sf_dir), decode, width=5, height=5, crop=4).select("path", "shape", F.transform("pixels", lambda x: F.round(x, 4)).alias("pixels"))


@query()
def r106_log_mel(spark, sf_dir):
    sounds = audio.read_wav(audio.write_wav(_sounds(spark, sf_dir), "path"))
    out = features.sound_features(sounds, seconds=1)
    return out.select("path", "frames", F.size("mel").alias("n"), F.round(F.aggregate("mel", F.lit(0.0), lambda a, x: a + x.cast("double")), 2).alias("total"))


# --- catalogue --------------------------------------------------------------


def _manifests(spark, sf_dir):
    digest = "concat('sha256:', sha2(text, 256))"
    one = f"""concat('{{"name":"', if(doc_id % 5 = 1, 'encoder.onnx', 'model.onnx'), '","digest":"', if(doc_id % 5 = 2, 'md5:1', {digest}), '","size":', n_chars, '}}')"""
    body = f"""case when doc_id % 5 = 4 then '{{bad' else concat('{{"schemaVersion":', if(doc_id % 5 = 3, 9, 2), ',"name":"m', doc_id, '","type":"', if(doc_id % 2 = 0, 'embedder', 'Rerankers'), '","files":[', {one}, ']}}') end"""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(body).alias("manifest"))


@query("""SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'no model file' WHEN 2 THEN 'invalid digest' WHEN 3 THEN 'unsupported schema version' ELSE 'invalid JSON' END AS error FROM documents""")
def r012_manifests(spark, sf_dir):
    return catalogue.read_manifests(_manifests(spark, sf_dir)).select("id", "error")


@query("""SELECT doc_id || '.txt' AS name, 'sha256:' || sha256(text || CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END) AS digest FROM documents WHERE doc_id % 3 = 0""")
def r013_r159_missing_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", "doc_id")
    present = catalogue.scan_files(docs.select(F.concat(F.lit("/m/"), "path").alias("path"), F.encode("text", "utf-8").alias("content")))
    wanted = docs.select(F.col("path").alias("name"), catalogue.digest(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "!").otherwise(""))).alias("digest"))
    return catalogue.missing_files(wanted, present)


TREE = """tree AS (SELECT source AS owner, lang AS name, (['model.onnx', 'model_i8.onnx', 'onnx/audio_model.onnx', 'config.json', 'visual_model_quantized.onnx', 'readme.md'])[doc_id % 6 + 1] AS file FROM documents)"""


def _paths(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("model.onnx", "model_i8.onnx", "onnx/audio_model.onnx", "config.json", "visual_model_quantized.onnx", "readme.md")])
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", F.get(names, (F.col("doc_id") % 6).cast("int"))).alias("path"))


@query(f"WITH {TREE} SELECT owner, name, list_sort(list(DISTINCT file)) AS files, coalesce(bool_or(file = 'model.onnx'), FALSE) AS plain, coalesce(bool_or(file = 'model_i8.onnx'), FALSE) AS small FROM tree GROUP BY ALL")
def r014_scan_models(spark, sf_dir):
    out = catalogue.scan_models(_paths(spark, sf_dir))
    return out.select("owner", "name", "files", F.map_contains_key("variants", "").alias("plain"), F.map_contains_key("variants", "i8").alias("small"))


FLAGS = f"""{TREE}, flags AS (SELECT owner, name, bool_or(file = 'model.onnx') AS m, bool_or(file = 'model_i8.onnx') AS s, bool_or(file = 'onnx/audio_model.onnx') AS a, bool_or(file = 'config.json') AS c, bool_or(file = 'visual_model_quantized.onnx') AS v FROM tree GROUP BY ALL)"""


@query(f"WITH {FLAGS} SELECT owner, name, FALSE AS has_image, v AS has_image_quantized, a AS has_audio, FALSE AS has_audio_quantized, c AND m AS is_generator, m OR a AS is_model FROM flags")
def r151_r152_folder_flags(spark, sf_dir):
    return catalogue.folder_flags(catalogue.scan_models(_paths(spark, sf_dir))).drop("files", "variants")


@query(f"""WITH {FLAGS}, n AS (SELECT *, owner || '/' || name AS whole FROM flags)
    SELECT whole AS name, 'model.onnx' AS file, 'embedder' AS kind, FALSE AS quantized FROM n WHERE NOT a AND NOT v AND m UNION ALL SELECT whole || '-i8', 'model_i8.onnx', 'embedder', FALSE FROM n WHERE NOT a AND NOT v AND s
    UNION ALL SELECT whole, NULL, 'multimodal', FALSE FROM n WHERE a UNION ALL SELECT whole || '-i8-qt', NULL, 'multimodal', TRUE FROM n WHERE v""")
def r153_expand_variants(spark, sf_dir):
    return catalogue.expand_variants(catalogue.scan_models(_paths(spark, sf_dir)))


#: Every document is a repository; what it holds follows from its id and length: folders of a generator, or other files.
REPOS = """repo AS (SELECT 'r' || doc_id AS repo, doc_id % 6 AS kind, (n_chars // 3) % 2 = 0 AS low, (n_chars // 5) % 3 > 0 AS cpu, ([1, 2, 3, 4, 7, 8, 12, 13])[n_chars % 8 + 1] AS a, ([1, 2, 3, 4, 7, 8, 12, 13])[doc_id % 8 + 1] AS b FROM documents),
    folders AS (SELECT repo, 0 AS tier, a AS size, 'cpu/x-' || a || 'b-int4' AS variant FROM repo WHERE kind < 2 AND cpu AND low
        UNION ALL SELECT repo, 1, b, 'cpu/x-' || b || 'b' FROM repo WHERE kind < 2 AND cpu UNION ALL SELECT repo, 2, a, 'cuda/x-' || a || 'b' FROM repo WHERE kind < 2),
    best AS (SELECT repo, arg_min(variant, (tier, size, variant)) AS variant FROM folders GROUP BY repo),
    files AS (SELECT repo, variant || '/' || unnest(['genai_config.json', 'model.onnx', 'notes.md', 'chat.jinja']) AS path, unnest([0, 1, 2, 3]) + tier * 4 AS pos FROM folders
        UNION ALL SELECT repo, unnest(['onnx/model.onnx', 'onnx/model.onnx_data', 'onnx/model_fp16.onnx', 'tokenizer.json', 'old/tokenizer.json', 'readme.md', 'onnx/text_model_quantized.onnx']), unnest(range(7)) FROM repo WHERE kind = 2
        UNION ALL SELECT repo, unnest(['encoder.onnx', 'decoder.onnx', 'vocab.txt']), unnest(range(3)) FROM repo WHERE kind = 3
        UNION ALL SELECT repo, unnest(['visual_model.onnx', 'text_model_quantized.onnx', 'model_q4.onnx']), unnest(range(3)) FROM repo WHERE kind = 4
        UNION ALL SELECT repo, 'a-' || a || '.bin', 0 FROM repo WHERE kind = 5)"""


def _repos(spark, sf_dir):
    k, n = F.col("doc_id"), F.col("n_chars")
    sizes = lambda i: F.get(F.array(*[F.lit(str(x)) for x in (1, 2, 3, 4, 7, 8, 12, 13)]), (i % 8).cast("int"))
    cpu, low = F.floor(n / 5) % 3 > 0, F.floor(n / 3) % 2 == 0
    folder = lambda head, size, end="": F.concat(F.lit(head), size, F.lit(end))
    # every folder keeps its place, so that positions count from the ones that are there
    folders = F.array(F.when(cpu & low, folder("cpu/x-", sizes(n), "b-int4")), F.when(cpu, folder("cpu/x-", sizes(k), "b")), folder("cuda/x-", sizes(n), "b"))
    names = ("genai_config.json", "model.onnx", "notes.md", "chat.jinja")
    inside = F.flatten(F.transform(folders, lambda f: F.array(*[F.concat(f, F.lit(f"/{x}")) for x in names])))
    fixed = {2: ("onnx/model.onnx", "onnx/model.onnx_data", "onnx/model_fp16.onnx", "tokenizer.json", "old/tokenizer.json", "readme.md", "onnx/text_model_quantized.onnx"), 3: ("encoder.onnx", "decoder.onnx", "vocab.txt"), 4: ("visual_model.onnx", "text_model_quantized.onnx", "model_q4.onnx")}
    paths = F.when(k % 6 < 2, inside).when(k % 6 == 5, F.array(F.concat(F.lit("a-"), sizes(n), F.lit(".bin"))))
    for kind, listed in fixed.items():
        paths = paths.when(k % 6 == kind, F.array(*[F.lit(x) for x in listed]))
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), k.cast("string")).alias("repo"), F.posexplode(paths).alias("pos", "path"))
    return rows.where("path is not null").select("repo", "path", "pos")


@query(f"""WITH {REPOS} SELECT repo, path FROM files LEFT JOIN best USING (repo) WHERE (variant IS NULL OR starts_with(path, variant || '/')) AND regexp_matches(path, '(^|/)(genai_config|tokenizer|config)\\.json$|\\.(onnx|onnx_data|txt|jinja)$')""")
def r015_generator_files(spark, sf_dir):
    return catalogue.generator_files(_repos(spark, sf_dir))


@query(f"""WITH {REPOS}, text AS (SELECT repo, arg_min(path, pos) AS path FROM files WHERE regexp_matches(path, '(^|/)tokenizer\\.json$') GROUP BY repo)
    SELECT repo, path FROM text UNION ALL SELECT repo, path FROM files WHERE regexp_matches(path, '(^|/)(model|text_model|visual_model|audio_model|text_model_quantized|visual_model_quantized)\\.(onnx|onnx_data)$')""")
def r015_onnx_files(spark, sf_dir):
    return catalogue.onnx_files(_repos(spark, sf_dir))


@query(f"""WITH {REPOS}, g AS (SELECT repo, count(*) AS generators FROM folders GROUP BY repo)
    SELECT repo, CASE WHEN kind < 2 THEN 'generator' WHEN kind = 3 THEN 'rewriter' WHEN kind = 4 THEN 'embedder' END AS type, CASE kind WHEN 2 THEN 'cannot tell the type of a lone model file' WHEN 5 THEN 'no recognizable model files' END AS error,
        CASE WHEN kind < 2 THEN ['default'] WHEN kind = 2 THEN ['default', 'fp16'] WHEN kind = 4 THEN ['q4'] ELSE CAST([] AS VARCHAR[]) END AS variants, CAST(coalesce(generators, 0) AS INTEGER) AS generators FROM repo LEFT JOIN g USING (repo)""")
def r160_repo_types(spark, sf_dir):
    repos = _repos(spark, sf_dir)
    both = catalogue.repo_types(repos).join(catalogue.repo_variants(repos), "repo")
    return both.select("repo", "type", "error", "variants", F.size("generator_variants").alias("generators"))


@query("""WITH r AS (SELECT doc_id, doc_id % 7 AS k, source, (['i8', 'f16', 'zz'])[n_chars % 3 + 1] AS v FROM documents),
    t AS (SELECT doc_id, CASE k WHEN 0 THEN 'hf:' || source || '/m' || doc_id || ':' || v WHEN 1 THEN source || '/' || source || '/m' WHEN 2 THEN 'm' || doc_id WHEN 3 THEN 'm:' || v WHEN 4 THEN '' WHEN 5 THEN source || '/' ELSE 'hf:m' END AS ref,
        k IN (0, 6) AS remote, CASE WHEN k IN (0, 1, 5) THEN source ELSE '' END AS owner, CASE k WHEN 0 THEN 'm' || doc_id WHEN 1 THEN source || '/m' WHEN 2 THEN 'm' || doc_id WHEN 3 THEN 'm' WHEN 6 THEN 'm' ELSE '' END AS name, CASE WHEN k IN (0, 3) THEN v ELSE '' END AS variant FROM r)
    SELECT *, CASE WHEN ref = '' THEN 'empty model reference' WHEN variant = 'zz' THEN 'invalid variant' WHEN name = '' THEN 'empty name' END AS error FROM t""")
def r115_model_refs(spark, sf_dir):
    k = F.col("doc_id") % 7
    v = F.get(F.array(F.lit("i8"), F.lit("f16"), F.lit("zz")), (F.col("n_chars") % 3).cast("int"))
    ref = (F.when(k == 0, F.concat(F.lit("hf:"), "source", F.lit("/m"), F.col("doc_id").cast("string"), F.lit(":"), v)).when(k == 1, F.concat("source", F.lit("/"), "source", F.lit("/m"))).when(k == 2, F.concat(F.lit("m"), F.col("doc_id").cast("string")))
           .when(k == 3, F.concat(F.lit("m:"), v)).when(k == 4, "").when(k == 5, F.concat("source", F.lit("/"))).otherwise("hf:m"))
    return table(spark, sf_dir, "documents").select("doc_id", ref.alias("ref")).select("doc_id", "ref", C.model_ref(F.col("ref")).alias("m")).select("doc_id", "ref", "m.*")


@query("""SELECT doc_id, (['embedder', 'reranker', NULL, 'reader'])[doc_id % 4 + 1] AS type, doc_id % 4 = 2 AS capability FROM documents""")
def r116_types(spark, sf_dir):
    name = F.get(F.array(F.lit("Embedders"), F.lit("reranker"), F.lit("zeroshot"), F.lit("READER")), (F.col("doc_id") % 4).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", C.model_type(name).alias("type"), C.is_capability(name).alias("capability"))


def _models(spark, sf_dir):
    kind = F.get(F.array(F.lit("embedder"), F.lit("generator"), F.lit("recognizer"), F.lit("reader")), (F.col("doc_id") % 4).cast("int"))
    files = F.array(F.struct(F.lit("model.onnx").alias("name"), F.lit("sha256:1").alias("digest"), (F.col("doc_id") * 1500).alias("size")))
    return table(spark, sf_dir, "documents").select(kind.alias("type"), F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("name"), F.when(F.col("doc_id") % 8 == 2, F.array(F.lit("zeroshot"))).otherwise(F.array().cast("array<string>")).alias("capabilities"), files.alias("files"))


MODELS = """m AS (SELECT doc_id, (['embedder', 'generator', 'recognizer', 'reader'])[doc_id % 4 + 1] AS type, 'm' || doc_id AS name FROM documents)"""


@query(f"""WITH {MODELS}, a AS (SELECT type, name FROM m UNION ALL SELECT 'extractor', name FROM m WHERE doc_id % 8 = 2 UNION ALL SELECT 'chunker', unnest(['fixed-bert-tokenizer', 'fixed-bpe-tokenizer']))
    SELECT type, list_sort(list(name)) AS names FROM a GROUP BY type""")
def r117_list_models(spark, sf_dir):
    return catalogue.list_models(_models(spark, sf_dir))


@query(f"""WITH {MODELS} SELECT CAST(row_number() OVER (ORDER BY CASE type WHEN 'generator' THEN 0 ELSE 1 END, name) - 1 AS INTEGER) AS pos, name AS id, 'model' AS object, 0 AS created, 'millrace' AS owned_by FROM m WHERE type IN ('generator', 'embedder')""")
def r144_open_list(spark, sf_dir):
    return catalogue.open_list(_models(spark, sf_dir), "millrace")


@query(f"""WITH {MODELS} SELECT count(*) FILTER (type IN ('embedder', 'generator')) > 0 AS ready, count(*) FILTER (type IN ('embedder', 'generator')) AS models FROM m""")
def r126_ready(spark, sf_dir):
    return catalogue.ready(_models(spark, sf_dir))


@query(f"""WITH {MODELS}, s AS (SELECT type, name, doc_id * 1500 AS n FROM m WHERE type = 'generator') SELECT type, name, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END AS size FROM s""")
def r161_listing(spark, sf_dir):
    return catalogue.listing(_models(spark, sf_dir), "generator")


@query(f"""WITH {MODELS} SELECT type, count(*) AS models, '0.1.0' AS version, 'unknown' AS git_commit FROM m GROUP BY type""")
def r145_version(spark, sf_dir):
    """Models by type beside the record of what serves them."""
    models = _models(spark, sf_dir).groupBy("type").agg(F.count("*").alias("models"))
    return models.crossJoin(F.broadcast(catalogue.version(spark, "0.1.0"))).select("type", "models", "version", "git_commit")  # one row


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['go'] WHEN doc_id % 2 = 0 THEN ['onnx'] END AS required, CASE WHEN doc_id % 3 = 0 THEN 'go' ELSE 'onnx' END AS backend FROM documents""")
def r156_r157_r158_backends(spark, sf_dir):
    k = F.col("doc_id")
    name = F.when(k % 2 == 0, F.lit(C.ONNX_ONLY[0])).otherwise("other")
    declared = F.when(k % 3 == 0, F.array(F.lit("go"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", C.required_backends(name, declared).alias("backends"))
    return catalogue.choose_backends(rows, ["coreml:gpu", "onnx:cuda", "go"], ["go", "onnx"]).withColumnRenamed("backends", "required")


@query("""WITH s AS (SELECT event_id, (['onnx', 'ONNX', 'xla', 'go', 'CoreML', 'metal'])[event_id % 6 + 1] AS b, (['', ':GPU', ':cuda', ':tpu', ':off', ':cpu', ':x'])[event_id % 7 + 1] AS d FROM events)
    SELECT event_id, b || d AS spec, CASE WHEN b <> 'metal' AND d <> ':x' THEN lower(b) END AS backend, CASE WHEN b <> 'metal' THEN CASE d WHEN '' THEN 'auto' WHEN ':GPU' THEN 'cuda' WHEN ':cuda' THEN 'cuda' WHEN ':tpu' THEN 'tpu' WHEN ':off' THEN 'cpu' WHEN ':cpu' THEN 'cpu' END END AS device FROM s""")
def r157_backend_specs(spark, sf_dir):
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values)).cast("int"))
    spec = F.concat(pick(["onnx", "ONNX", "xla", "go", "CoreML", "metal"]), pick(["", ":GPU", ":cuda", ":tpu", ":off", ":cpu", ":x"]))
    return table(spark, sf_dir, "events").select("event_id", spec.alias("spec")).select("event_id", "spec", C.backend_spec(F.col("spec")).alias("b")).select("event_id", "spec", "b.backend", "b.device")


@query("""SELECT doc_id AS model, CASE doc_id % 3 WHEN 0 THEN 'gemma' WHEN 1 THEN 'llama' ELSE 'gpt2' END AS type, 32000 AS vocab_size, CAST(64 * (doc_id % 5 + 1) AS INTEGER) AS hidden_size, 16 AS num_hidden_layers, 8 AS num_attention_heads, 8 AS num_key_value_heads,
    CAST(256 * (doc_id % 5 + 1) AS INTEGER) AS intermediate_size, CAST(8 * (doc_id % 5 + 1) AS INTEGER) AS head_dim, 8192 AS context_length FROM documents""")
def r150_runtime_config(spark, sf_dir):
    config = F.expr("""concat('{"hidden_size":', 64 * (doc_id % 5 + 1), case doc_id % 3 when 0 then ',"model_type":"gemma2"' when 1 then ',"model_type":"x","architectures":["MyLlamaModel"]' else '' end, '}')""")
    return catalogue.runtime_config(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("model"), config.alias("config")))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 3 WHEN doc_id % 5 <> 0 THEN doc_id % 5 ELSE 0 END AS value FROM documents""")
def r167_first_nonzero(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.first_nonzero(F.col("doc_id") % 3, F.col("doc_id") % 5).alias("value"))
