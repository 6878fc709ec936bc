"""Operators: fixed cases and plain Python versions."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import chunking, extraction, features, generation, media, scorers, scoring, state, tokens
from millrace.operators.pieces import pieces
from millrace.plans import lifecycle
from millrace.sources import audio, images, inputs, vectors


def test_chunk_config():
    assert chunking.ChunkConfig("", 0, -1, "", 0).resolved() == chunking.ChunkConfig()
    with pytest.raises(ValueError):
        chunking.ChunkConfig(target_tokens=5, overlap_tokens=5).resolved()


def test_chunk_edge_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (5, "a b\n\nc d\n\ne f")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chunk_id string")
    out = sorted(tuple(r) for r in chunking.chunk_fixed(docs, chunking.ChunkConfig(target_tokens=4, overlap_tokens=0)).collect())
    assert out == [(3, 0, "", 0, 3), (4, 0, "one", 0, 3), (4, 0, "one", 0, 3), (5, 0, "a b\n\nc d", 0, 8), (5, 1, "e f", 10, 13)]
    most = chunking.chunk_fixed(docs.where("doc_id = 5"), chunking.ChunkConfig(target_tokens=2, overlap_tokens=0, max_chunks=2)).collect()
    assert [r.text for r in most] == ["a b", "c d"]


@pytest.mark.parametrize("vs", [[], [[1.0, 2.0, 3.0]], [[0.0, -1.5], [1e-30, 1e30]], [[float(i)] * 10 for i in range(2)]])
def test_codec(vs):
    assert vectors.deserialize(vectors.serialize(vs)) == [pytest.approx(v) for v in vs]


@pytest.mark.parametrize("raw", [b"", b"1234567", (1).to_bytes(8, "little"), vectors.serialize([[1.0, 2.0]])[:-1]])
def test_codec_errors(raw):
    with pytest.raises(ValueError):
        vectors.deserialize(raw)


@pytest.mark.parametrize("bits, limit", [(8, 0.02), (16, 1e-4), (24, 1e-6), (32, 1e-6)])
def test_wav(bits, limit):
    x = np.sin(np.arange(400) / 9).astype(np.float32)
    for channels in (1, 2):
        y, form = audio.parse_wav(audio.encode_wav(x, 16000, bits, channels))
        assert form == {"sample_rate": 16000, "bits": bits, "channels": channels} and np.abs(x - y).max() < limit


def test_wav_errors():
    for raw in (b"", b"RIFF....", audio.encode_wav([0.1], 8000)[:40], audio.encode_wav([0.1], 8000).replace(b"\x01\x00\x01\x00", b"\x03\x00\x01\x00", 1)):
        with pytest.raises(ValueError):
            audio.parse_wav(raw)
    for args in (([], 1), ([0.0], 0), ([0.0], 1, 12)):
        with pytest.raises(ValueError):
            audio.encode_wav(*args)


def test_sound_windows():
    second = audio.encode_wav(np.zeros(5 * 1600), 1600)
    cut = lambda raw, **k: [(c["start_time_ms"], c["end_time_ms"]) for c in media._sound_chunks(*audio.parse_wav(raw), k.get("window", 2000), k.get("overlap", 0), k.get("most", 0))]
    assert cut(second) == [(0, 2000), (2000, 4000), (4000, 5000)]
    assert cut(audio.encode_wav(np.zeros(4 * 1600), 1600), overlap=1000) == [(0, 2000), (1000, 3000), (2000, 4000), (3000, 4000)]
    assert len(cut(second, most=2)) == 2 and len(cut(audio.encode_wav(np.zeros(800), 1600))) == 1
    with pytest.raises(ValueError):
        cut(second, overlap=2000)


def test_media_rows(spark):
    from millrace.plans.catalogue_queries import _gif

    rows = [("w", " AUDIO/wav ", audio.encode_wav(np.zeros(100), 100)), ("g", "image/gif", _gif(3, 1)), ("e", "image/gif", b""), ("b", "image/gif", b"GIF89a"), ("p", "video/mp4", b"1")]
    out = media.chunk_media(spark.createDataFrame(rows, "path string, mime_type string, content binary")).collect()
    assert sorted((r.path, r.chunk_id, r.error is None) for r in out) == sorted([("w", 0, True), ("g", 0, True), ("g", 1, True), ("g", 2, True), ("e", None, False), ("b", None, False), ("p", None, False)], key=lambda r: (r[0], r[1] or 0))


def test_gif_and_png():
    from millrace.plans.catalogue_queries import _gif

    frames = images.gif_frames(_gif(4, 2))
    assert [f["delay_ms"] for f in frames] == [100, 110, 120, 130]
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]])
    numbers = [[(k + 2) % 4 for k in range(r * 4, r * 4 + 4)] for r in range(3)]
    assert (frames[0]["pixels"][:, :, :3] == palette[numbers]).all() and (frames[0]["pixels"][:, :, 3] == 255).all()
    for f in frames:
        assert (images.decode_png(images.encode_png(f["pixels"])) == f["pixels"]).all()
    for raw in (b"", b"GIF87a", _gif(1, 0)[:-6]):
        with pytest.raises(ValueError):
            images.gif_frames(raw)


def test_pixels():
    x = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (features.resize(x, 4, 4) == x).all() and features.resize(x, 2, 2).tolist() == x[::2, ::2].tolist()
    assert features.center_crop(x, 2).tolist() == x[1:3, 1:3].tolist()
    padded = features.pad_image(x, 8, 6, 9)
    assert padded.shape == (6, 8, 3) and (padded[1:5, 2:6] == x).all() and (padded[0] == 9).all()
    assert (features.crop_margin(padded, 0) == x).all()
    assert features.pixel_tensor(x, 4, 4).shape == (3, 4, 4)


def test_mel():
    tone = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000).astype(np.float32)
    mel = features.log_mel(tone, seconds=1)
    assert mel.shape == (100, 80) and mel.max() - mel.min() <= 2 + 1e-6
    assert features.log_mel(tone, seconds=1, speech=False).shape == (100, 80)
    assert len(features.resample(tone, 16000, 8000)) == 8000


def test_fields():
    assert features.field_tree("<s_company>ACME</s_company><s_total>5</s_total>") == {"company": "ACME", "total": "5"}
    assert features.field_tree("<s_menu><s_nm>Tea</s_nm><s_sub><s_x>1</s_x></s_sub></s_menu>") == {"menu.nm": "Tea", "menu.sub.x": "1"}
    assert features.field_tree("<s_a>1<s_b>2</s_b>") == {"b": "2"} and features.field_tree("plain") == {}


def test_decoder():
    step = lambda ids: [0.0, 1.0 + len(ids), 2.0, 0.0]
    out = generation.Decoder(step, eos_id=3, max_new_tokens=4).generate([9])
    assert out["ids"] == [1, 1, 1, 1] and not out["stopped"]
    assert generation.Decoder(step, eos_id=1, min_length=2, max_new_tokens=5).generate([9, 8])["ids"][:1] == [8]
    assert generation.Decoder(step, eos_id=3, suppress=(1,), forced={1: 0}, max_new_tokens=2).generate([9])["ids"] == [0, 2]
    ended = generation.Decoder(lambda ids: [0, 0, 0, 9.0], eos_id=3).generate([5])
    assert ended["ids"] == [] and ended["stopped"] and ended["score"] == 0.0 and -0.001 < ended["log_prob"] < 0
    sampled = generation.Decoder(step, eos_id=3, do_sample=True, top_k=2, top_p=0.9, temperature=0.7, seed=5)
    assert sampled.generate([1]) == sampled.generate([1])


def test_tool_parser():
    text = 'say <start_function_call>f{a:<escape>x, {y}<escape>,b:2,c:[1],d:tru}<end_function_call> and <start_function_call>{}<end_function_call>end'
    for size in (1, 3, 500):
        parser = generation.ToolParser()
        new = [c for k in range(0, len(text), size) for c in parser.feed(text[k : k + size])]
        calls, rest = parser.finish()
        assert new == calls and rest == "say  and end"
        assert calls[0][0] == "f" and json.loads(calls[0][1]) == {"a": "x, {y}", "b": 2, "c": [1], "d": "tru"}
    assert generation.tool_parser("") is None
    with pytest.raises(ValueError):
        generation.tool_parser("other")


def test_forced_tool_must_exist(spark):
    from millrace.plans.extraction_queries import _tools

    with pytest.raises(Exception, match="no such function"):
        spark.range(1).select(generation.forced_tools(_tools(F.lit("a"), F.lit("b")), F.lit("c"))).collect()


def test_stubs(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["test1", "té", None])], "id long, text string").coalesce(1)
    out = {r.id: r.v for r in tokens.run_model(rows, scorers.stub_embedder, ["text"], "v", "array<double>").collect()}
    assert out == {0: [0, 5], 1: [1, 3], 2: [2, 0]}
    pairs = spark.createDataFrame([(i, "q", "d") for i in range(3)], "id long, query string, text string").coalesce(1)
    assert {r.id: r.score for r in scoring.rerank(pairs, scorers.stub_reranker).collect()} == {0: 3, 1: 2, 2: 1}
    with pytest.raises(Exception, match="query is required"):
        scoring.rerank(pairs.withColumn("query", F.lit("")), scorers.stub_reranker).collect()


def test_supervised_and_labels(spark):
    assert scoring.entailment_index({0: "a", 1: "ENTAILMENT"}) == 1 and scoring.entailment_index(None) == 2
    with pytest.raises(ValueError):
        scoring.zero_shot_pairs(spark.range(1), [])
    with pytest.raises(ValueError):
        extraction.entities(spark.range(1), strategy="other")


def test_entity_text(spark):
    toks = [(1, 0, 0, 4, "B-PER", 0.9), (1, 1, 5, 11, "I-PER", 0.7), (1, 2, 12, 17, "O", 0.9), (1, 3, 18, 99, "I-ORG", 0.8)]
    df = spark.createDataFrame(toks, "doc_id long, pos int, start int, end int, label string, score double")
    texts = spark.createDataFrame([(1, "Jöhn Smith works Google.")], "doc_id long, text string")
    out = sorted((r.start, r.text, r.label, round(r.score, 3)) for r in extraction.entities(df, texts).collect())
    assert out == [(0, "Jöhn Smith", "PER", 0.8), (18, "Google.", "ORG", 0.8)]
    none = extraction.entities(df, strategy="none").count()
    assert none == 3


def test_machines():
    at = lambda make, *events: [make_step(e) for make_step in [make()] for e in events]
    calls = [{"at": t, "success": s} for t, s in [(0, False), (1, False), (2, True), (8, False), (9, True), (20, True), (21, True)]]
    out = at(state.breaker(2, 5.0), *calls)
    assert [(o["state"], o["allowed"]) for o in out] == [("closed", True), ("closed", True), ("open", False), ("half_open", True), ("open", False), ("half_open", True), ("closed", True)]
    out = at(state.token_bucket(1.0, 2), *[{"at": t} for t in (0, 0, 0, 1, 1.5, 10, 10, 10)])
    assert [o["allowed"] for o in out] == [True, True, False, True, False, True, True, False]
    out = at(state.admission(1, 1, 4.0), *[{"at": t, "service": s} for t, s in [(0, 5), (1, 1), (2, 1), (3, 1), (6, 1)]])
    assert [o["outcome"] for o in out] == ["processed", "processed", "rejected", "rejected", "processed"] and out[1]["start"] == 5
    assert at(state.admission(0, 0, 0), {"at": 3, "service": 2}) == [{"outcome": "processed", "start": 3, "end": 5}]
    uses = [{"at": t, "model": m, "busy": b} for t, m, b in [(0, "a", 0), (1, "b", 50), (2, "c", 0), (3, "a", 0), (400, "b", 0)]]
    out = at(state.model_pool(2, 300.0), *uses)
    assert [o["loaded"] for o in out] == [True, True, True, True, True] and [o["evicted"] for o in out] == [[], [], ["a"], ["c"], ["a", "b"]]


def test_lifecycle(spark):
    requests = spark.createDataFrame([(1, "m", '["a","bb"]'), (2, "m", '"ccc"'), (3, "m", "[]"), (4, "m", '[{"type":"media","mime_type":"audio/wav","data":"AAAA"}]')], "id long, model string, input string")
    listed = spark.createDataFrame([("m", "text/plain")], "model string, mime_type string")
    out = {(r.id, r.pos): (r.embedding is not None, r.error) for r in lifecycle.embed(requests, scorers.length_embedder, listed).collect()}
    assert out == {(1, 0): (True, None), (1, 1): (True, None), (2, 0): (True, None), (3, None): (False, "input must be a string, array of strings, or array of content parts"), (4, 0): (False, "unsupported content type audio/wav")}
    asks = spark.createDataFrame([(1, "fast cars", ["slow cars", "fast cars", "x"]), (2, "y", [])], "query_id long, query string, prompts array<string>")
    assert [(r.pos, r.rank) for r in lifecycle.rerank(asks, scorers.overlap_reranker, 2).orderBy("rank").collect()] == [(1, 1), (0, 2)]
    texts = spark.createDataFrame([(1, "zzz", "a\n\nb"), (2, "own", "c")], "id long, model string, text string")
    got = {(r.id, r.chunk_id): (r.model_used, r.text) for r in lifecycle.chunk(texts, spark.createDataFrame([("own",)], "name string")).collect()}
    assert got == {(1, 0): ("fixed-bert-tokenizer", "a\n\nb"), (2, 0): ("own", "c")}


def test_embed_keeps_every_part(spark):
    image = '[{"type":"media","mime_type":"image/png","data":"AAAA"},{"type":"media","mime_type":"audio/wav","data":"AAAA"},{"type":"text","text":"a"},{"type":"text"},{"type":"image_url","image_url":{"url":"http://x.org/a.png"}}]'
    requests = spark.createDataFrame([(1, "m", image), (2, "m", '"bb"'), (2, "m", '"ccc"')], "id long, model string, input string")
    made = lambda: lambda batch: [[float(len(x)), 0.0] for (x,) in batch]
    out = sorted((r.id, r.pos, r.embedding is not None, r.error or "") for r in lifecycle.embed(requests, scorers.length_embedder, encoders={"image": made}).collect())
    assert out == [(1, 0, True, ""), (1, 1, False, "no encoder for audio"), (1, 2, True, ""), (1, 3, False, "content part without content"), (1, 4, True, ""), (2, 0, True, ""), (2, 0, True, "")]


def test_requests_of_one_id_are_cut_each(spark):
    texts = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "id long, model string, text string")
    got = sorted((r.id, r.model, r.text) for r in lifecycle.chunk(texts, spark.createDataFrame([("own",)], "name string")).collect())
    assert got == [(1, "a", "x"), (1, "b", "y")]


def test_documents_are_read_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def model():
        def run(batch):
            calls.add(len(batch))
            return [f"<s_read><s_a>{c.decode()}</s_a></s_read>" for (c,) in batch]

        return run

    images = spark.createDataFrame([(str(i), b"v") for i in range(20)], "path string, content binary").coalesce(2)
    assert [r.fields["a"] for r in features.read_documents(images, model).collect()] == ["v"] * 20
    assert calls.value == 20


def test_null_modality_is_an_error(spark):
    rows = spark.createDataFrame([(1, None, b"x")], "id long, modality string, data binary")
    with pytest.raises(Exception, match="no encoder for null"):
        tokens.embed_mixed(rows, {"image": lambda: lambda batch: [[1.0] for _ in batch]}).collect()


def test_addresses(spark):
    bad = ["http://[::1]/", "http://2130706433/", "http://0x7f.1/", "http://127.1/", "http://localhost./", "http://a.localhost/", "http://0.1.2.3/", "http://u@10.0.0.1/", "http://a@b@127.0.0.1/", "ftp://x.org/", "http:///a"]
    good = ["HTTP://x.org/", "https://8.8.8.8/a", "http://1x.org", "file:///a", "S3://bucket/key", "data:,x", "https://u:p@x.org:8080/a"]
    rows = spark.createDataFrame([(u,) for u in bad + good], "url string")
    assert [r[0] for r in rows.select(inputs.allowed_address(F.col("url"))).collect()] == [False] * len(bad) + [True] * len(good)


def test_route_index(spark):
    import random
    import re

    from millrace.operators import routing

    rng = random.Random(3)
    some = lambda values, most: rng.sample(values, rng.randint(0, most)) or rng.choice([None, []])
    globs = ["*", "", "m1", "m1*", "m*1", "*x", "m\\E*", "m1*x*", "é*", "m.*", "m2-x", "*1*"]
    rows = [(f"r{k}", k % 5, some(["embed", "chunk"], 2), some(globs, 3), {"tier": (rng.choice([None, "a"]), rng.choice([None, "b"]), None)} if rng.random() < 0.4 else None, some(["t", "s"], 1), None) for k in range(120)]
    routes = spark.createDataFrame(rows, routing.ROUTE)
    models = ["m1", "m1-x", "m2-x", "x", "", None, "m\\Ea", "én", "m11x", "M1", "m.x", "a\nb1"]
    asked = [(i, rng.choice(["embed", "chunk", "read", None]), rng.choice(models), rng.choice([{}, {"tier": "a"}, {"tier": "bc"}, None]), rng.choice(["t", "u", None]), None, "c") for i in range(300)]
    requests = spark.createDataFrame(asked, "request_id long, operation string, model string, headers map<string,string>, source_table string, ts timestamp, candidates string")

    def fits(route, request):
        _, _, ops, models, headers, tables, _ = route
        _, op, model, given, table, *_ = request
        glob = lambda g: model is not None and re.fullmatch(".*".join(map(re.escape, g.split("*"))), model)
        heads = all((e and (given or {}).get(h) == e) or (p and ((given or {}).get(h) or "").startswith(p)) for h, (e, p, _) in (headers or {}).items())
        return (not ops or op in ops) and (not models or any(map(glob, models))) and heads and (not tables or table in tables)

    ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
    out = routing.match_routes(requests, routes)
    assert out.columns == [*requests.columns, "route"]
    assert {r.request_id: r.route for r in out.collect()} == {a[0]: next((r[0] for r in ranked if fits(r, a)), None) for a in asked}
    assert {r.route for r in routing.match_routes(requests, routes.where("false")).collect()} == {None}
    assert routing.match_routes(requests.where("false"), routes).count() == 0


def test_route_index_meets_few(spark):
    """Of many routes with stems of their own a request meets those of its model."""
    from millrace.operators import routing

    routes = spark.range(20_000).select(F.format_string("r%05d", "id").alias("name"), F.lit(1).alias("priority"), F.array().cast("array<string>").alias("operations"), F.array(F.format_string("m%d-*", "id")).alias("models"),
                                        F.lit(None).cast("map<string,struct<exact:string,prefix:string,regex:string>>").alias("headers"), F.array().cast("array<string>").alias("tables"), F.lit(None).cast("struct<start:int,end:int,days:array<int>>").alias("window"))
    requests = spark.range(500).select(F.col("id").alias("request_id"), F.lit("embed").alias("operation"), F.format_string("m%d-x", F.col("id") * 30).alias("model"), F.lit(None).cast("map<string,string>").alias("headers"), F.lit("t").alias("source_table"), F.current_timestamp().alias("ts"))
    index = routing.route_index(requests, routes)
    assert index.agg(F.max(F.size("candidates")), F.count("*")).first() == (1, 500)
    assert routing.match_routes(requests, routes).where(F.col("route") == F.format_string("r%05d", F.col("request_id") * 30)).count() == 500


def test_nearest_of_any_number_of_queries(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8)).round(1)
    vectors[7] = vectors[9] = vectors[250]
    vectors[11] = 0
    asked = np.vstack([vectors[::10], rng.normal(size=(40, 8))])
    known = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [(900, [], 1), (901, None, 1)], "vec_id long, embedding array<double>, q int").repartition(5)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<double>").repartition(3)
    unit = lambda x: x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    sims = unit(asked) @ unit(vectors).T
    for most, block, groups in ((8 << 20, 65_536, 64), (0, 65_536, 3), (0, 9, 4)):
        monkeypatch.setattr(tokens, "QUERY_BLOCK", block)
        monkeypatch.setattr(tokens, "VECTOR_GROUPS", groups)
        for k in (1, 5, 400):
            got = {}
            for r in tokens.nearest(queries, known, k, sent_numbers=most).collect():
                got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.similarity))
            for i in range(len(asked)):
                rows = sorted(got[i])
                assert [r for r, _, _ in rows] == list(range(1, min(k, 300) + 1))
                want = np.sort(-sims[i])[: len(rows)]
                assert np.allclose([-s for _, _, s in rows], want, atol=1e-12) and np.allclose([-sims[i, v] for _, v, _ in rows], want, atol=1e-12)
        assert tokens.nearest(queries.where("false"), known, 3, sent_numbers=most).count() == 0 and tokens.nearest(queries, known.where("false"), 3, sent_numbers=most).count() == 0


def test_zero_shot_of_rows_is_that_of_pairs(spark):
    labels = ["a", "b", "a", "c"]
    logits = [[[0.0, 0.1, 2.0]], [[1.0, 3.0]], [[0.5]]]
    rows = [(i, [logits[(i + k) % 3][0] if i % 4 else [float(k % 2)] for k in range(4)]) for i in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, logits array<array<double>>")
    pairs = frame.select("doc_id", F.posexplode("logits").alias("pos", "logits")).withColumn("label", F.get(F.array(*[F.lit(x) for x in labels]), F.col("pos")))
    for multi in (False, True):
        want = {r.doc_id: (r.label, round(r.score, 9), {k: round(v, 9) for k, v in r.scores.items()}) for r in scoring.zero_shot(pairs, multi).collect()}
        out = frame.select("doc_id", scoring.zero_shot_scores(F.col("logits"), labels, multi).alias("z")).select("doc_id", "z.*")
        assert {r.doc_id: (r.label, round(r.score, 9), {k: round(v, 9) for k, v in r.scores.items()}) for r in out.collect()} == want
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    none = spark.range(1).select(scoring.zero_shot_scores(F.lit(None).cast("array<array<double>>"), labels).alias("z")).first().z
    assert none is None


def test_readers_by_kind_and_limit(spark):
    kinds = {"x/TrOCR-base": "trocr", "y/donut-docvqa": "donut", "Florence-2": "florence", "": "generic", "other": "generic"}
    assert {p: features.kind_of(p, features.READER_KINDS) for p in kinds} == kinds
    assert [features.kind_of(p, features.TRANSCRIBER_KINDS) for p in ("a/Whisper", "wav2vec-2", "WAV2VEC2", "hubert", "z")] == ["whisper", "wav2vec2", "wav2vec2", "hubert", "generic"]
    images = spark.createDataFrame([("p", b" one.Two three ")], "path string, content binary")

    def model(max_tokens=99, prompt="", language=""):
        return lambda batch: [f"<s_x><s_k>{language}{prompt[:3]}{' '.join(bytes(c).decode().split()[:max_tokens])}</s_k></s_x>" for (c,) in batch]

    read = lambda path, **o: features.read_documents(images, model, model_path=path, **o).first()
    assert read("donut")["fields"] == {"k": "one.Two three"} and read("donut", max_tokens=1)["fields"] == {"k": "one.Two"}
    assert read("trocr").text == "<s_x><s_k>one.Two three</s_k></s_x>" and read("trocr")["fields"] == {}
    assert read("florence", max_tokens=1).text == "<s_x><s_k>one.\nTwo</s_k></s_x>"
    answer = lambda max_tokens=9, prompt="": lambda batch: [f"{prompt[-4:]} 42 </s_answer> tail" for _ in batch]
    assert features.read_documents(images, answer, prompt="<s_docvqa>q").first().text == "qa>q 42"
    sounds = spark.createDataFrame([("p", b"a b c")], "path string, sound binary")
    heard = lambda max_tokens=9, language="": lambda batch: [f" <|{language}|> {' '.join(bytes(c).decode().split()[:max_tokens])} " for (c,) in batch]
    assert features.transcribe(sounds, heard, language="de", max_tokens=2).first().text == "a b"
    assert features.transcribe(sounds, heard, model_path="hubert", language="de").first().text == "<|de|> a b c"


def test_numbered_rows(spark):
    from millrace.operators import catalogue

    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 1000).alias("a"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("b"), F.lit(1).alias("pos_"))
    out = catalogue.numbered(rows, "a", "b").orderBy("pos").collect()
    assert [r.pos for r in out] == list(range(5000)) and [(r.a, r.b) for r in out] == sorted((r.a, r.b) for r in out)
    assert catalogue.numbered(rows.where("false"), "a").count() == 0


def test_batches_in_pieces():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": list(range(300)), "text": ["x" * (100 * k) for k in range(300)]})
    for step in (1, 32):
        parts = list(pieces(batch, step, 50_000))
        assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
        assert all(p.num_rows % step == 0 for p in parts[:-1]) and all(p.num_rows <= step or sum(map(len, p["text"].to_pylist())) <= 50_000 for p in parts)
    assert not list(pieces(batch.slice(0, 0)))


def test_word_spans_without_objects():
    import pyarrow as pa

    texts = pa.array(["left out", "é a\n b", None, "", " \t", "c", "d "]).slice(1)
    word = lambda w, a, b: {"word": w, "start": a, "end": b}
    assert tokens._words(texts).to_pylist() == [[word("é", 0, 2), word("a", 3, 4), word("b", 6, 7)], [], [], [], [word("c", 0, 1)], [word("d", 0, 1)]]


def test_models_get_whole_batches_of_every_piece(spark):
    rows = spark.range(0, 200, 1, 1).select("id", F.repeat(F.lit("x"), 20_000).alias("text"))  # 4 MB in one Arrow batch
    sizes = lambda: lambda batch: [len(batch)] * len(batch)
    out = tokens.run_model(rows, sizes, ["text"], "n", "int", 32).groupBy("n").count().collect()
    assert sorted(map(tuple, out)) == [(8, 8), (32, 192)]


def test_packed_copies_leave_some_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(np.ones((2000, 64)).tolist(), pa.list_(pa.float64()))], names=["id", "x"])
    out = list(tokens._blocks(1, 64, 0)(iter([batch])))
    assert max(b.nbytes for b in out) < 2 * tokens.PACKED_BYTES
    held = sorted((r["part"], i) for b in out for r in b.select(["part", "ids"]).to_pylist() for i in np.frombuffer(r["ids"], np.int64))
    assert held == [(g, i) for g in range(64) for i in range(2000)]


def test_sounds_share_filters_and_batches(spark):
    assert features.mel_filters(80, 400, 16000) is features.mel_filters(80, 400, 16000)
    rows = spark.range(0, 70, 1, 1).selectExpr("id as path", "named_struct('sample_rate', 16000, 'samples', array(cast(id as float) / 70, 0.5F)) as sound")
    out = {r.path: r for r in features.sound_features(rows, seconds=1).collect()}
    assert len(out) == 70
    for k in (0, 32, 33, 69):
        assert out[k].frames == 100 and np.allclose(np.float32(out[k].mel), features.log_mel(np.array([k / 70, 0.5], np.float32), seconds=1).ravel(), atol=1e-4)
