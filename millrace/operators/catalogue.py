"""The model catalogue: manifests, folders, repositories, variants, backends, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import catalog as C
from millrace.sources.stores import new_folder

#: A manifest as JSON.
FILES = "array<struct<name:string,digest:string,size:bigint>>"
MANIFEST = f"""struct<schemaVersion:int,name:string,owner:string,type:string,files:{FILES},
    variants:map<string,struct<files:{FILES}>>,capabilities:array<string>,backends:array<string>>"""


def manifest_errors(m: Column) -> Column:
    """The first thing wrong with a manifest; null if nothing is."""
    files, none = m["files"], F.lit(False)
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    has = lambda name: F.coalesce(F.exists(files, lambda f: f["name"] == name), none)
    can = lambda what: F.coalesce(F.array_contains(m["capabilities"], what), none)
    no_onnx = (F.coalesce(F.size(m["backends"]), F.lit(0)) > 0) & ~F.coalesce(F.array_contains(m["backends"], "onnx"), none)
    variants = F.map_entries(m["variants"])
    any_variant = lambda f: F.coalesce(F.exists(variants, lambda v: f(v["key"], v["value"]["files"])), none)
    pair = has("encoder.onnx") & has("decoder.onnx")
    return (
        F.when(~F.coalesce(m["schemaVersion"], F.lit(0)).between(1, 2), "unsupported schema version")
        .when(empty(m["name"]), "missing name")
        .when(empty(m["type"]), "missing type")
        .when(C.model_type(m["type"]).isNull(), "invalid model type")
        .when(F.coalesce(F.size(files), F.lit(0)) <= 0, "no files")
        .when(F.exists(files, lambda f: empty(f["name"])), "file without name")
        .when(F.exists(files, lambda f: empty(f["digest"])), "file without digest")
        .when(F.exists(files, lambda f: ~f["digest"].startswith("sha256:")), "invalid digest")
        .when(can("image") & ~(has("visual_model.onnx") & has("text_model.onnx")), "image embedder without its encoders")
        .when(can("image") & no_onnx, "image embedder needs the ONNX backend")
        .when(~can("image") & can("audio") & ~(has("audio_model.onnx") & has("text_model.onnx")), "audio embedder without its encoders")
        .when(~can("image") & can("audio") & no_onnx, "audio embedder needs the ONNX backend")
        .when(~can("image") & ~can("audio") & (m["type"] == "rewriter") & ~pair, "rewriter without encoder and decoder")
        .when(~can("image") & ~can("audio") & (m["type"] != "rewriter") & ~pair & ~has("model.onnx"), "no model file")
        .when(any_variant(lambda k, f: F.coalesce(F.size(f), F.lit(0)) <= 0), "variant without files")
        .when(any_variant(lambda k, f: F.exists(f, lambda x: empty(x["name"]) | empty(x["digest"]))), "variant file without name or digest")
        .when(any_variant(lambda k, f: ~k.isin(*C.VARIANT_FILES)), "unknown variant")
    )


def read_manifests(rows: DataFrame, id_col: str = "id", json_col: str = "manifest") -> DataFrame:
    """(id, m, error) of manifests as JSON; what cannot be read is an error."""
    parsed = rows.select(id_col, F.from_json(F.col(json_col), MANIFEST).alias("m"), F.try_parse_json(F.col(json_col)).isNull().alias("_bad"))
    return parsed.select(id_col, "m", F.when(F.col("_bad"), "invalid JSON").otherwise(manifest_errors(F.col("m"))).alias("error"))


def digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def scan_files(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(name, digest, size) of files' bytes (as of Spark's binaryFile source)."""
    return files.select(C.base_name(F.col(path_col)).alias("name"), digest(F.col(content_col)).alias("digest"), F.octet_length(content_col).cast("long").alias("size"))


def missing_files(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted files (name, digest) that are not there with that digest."""
    return wanted.join(present.select("name", "digest"), ["name", "digest"], "left_anti")


def scan_models(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """(owner, name, files, variants map) of files ``[owner/]name/file`` below a folder of
    models (deeper files keep their inner path)."""
    parts = F.split(path_col, "/")
    owned = F.size(parts) > 2
    inner = F.element_at(parts, 2).isin("onnx")
    two = owned & ~((F.size(parts) == 3) & inner)
    owner = F.when(two, F.get(parts, F.lit(0))).otherwise("")
    name = F.when(two, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    rest = F.array_join(F.slice(parts, F.when(two, 3).otherwise(2), F.size(parts)), "/")
    found = paths.where(F.size(parts) > 1).select(owner.alias("owner"), name.alias("name"), rest.alias("file"))
    grouped = found.groupBy("owner", "name").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return grouped.withColumn("variants", variants_of(F.col("files")))


def variants_of(files: Column) -> Column:
    """map<variant, file>: the plain model under the empty name, others under theirs."""
    known = {"": "model.onnx", **{k: v for k, v in C.VARIANT_FILES.items() if v != "model.onnx"}}
    entries = F.array_compact(F.array(*[F.when(F.array_contains(files, v), F.struct(F.lit(k), F.lit(v))) for k, v in known.items()]))
    return F.map_from_entries(entries)


def folder_flags(models: DataFrame) -> DataFrame:
    """Models (owner, name, files) with has_image, has_audio and their quantised forms, whether
    they generate and whether they are models at all."""
    has = lambda *names: F.arrays_overlap("files", F.array(*[F.lit(n) for n in names]))
    generator = has("genai_config.json") | (has("config.json") & has("model.onnx", "onnx/model.onnx"))
    return models.withColumns({
        "has_image": has("visual_model.onnx"), "has_image_quantized": has("visual_model_quantized.onnx"),
        "has_audio": has("audio_model.onnx", "onnx/audio_model.onnx"), "has_audio_quantized": has("audio_model_quantized.onnx", "onnx/audio_model_quantized.onnx"),
        "is_generator": generator,
        "is_model": has("model.onnx", "model_manifest.json", "visual_model.onnx", "audio_model.onnx", "encoder.onnx", "genai_config.json", "onnx/audio_model.onnx", "onnx/text_model.onnx"),
    })


def expand_variants(models: DataFrame) -> DataFrame:
    """(name, file, kind, quantized): a row for each variant, its name at the end; models of
    images or sound are one row, and one more with quantised encoders."""
    full = F.when(F.col("owner") != "", F.concat_ws("/", "owner", "name")).otherwise(F.col("name"))
    rows = folder_flags(models).withColumn("full", full)
    mixed = F.col("has_image") | F.col("has_audio") | F.col("has_image_quantized") | F.col("has_audio_quantized")
    plain = rows.where(~mixed).select("full", F.explode("variants").alias("variant", "file"))
    plain = plain.select(F.concat(F.col("full"), F.when(F.col("variant") != "", F.concat(F.lit("-"), "variant")).otherwise("")).alias("name"), "file", F.lit("embedder").alias("kind"), F.lit(False).alias("quantized"))
    both = rows.where(F.col("has_image") | F.col("has_audio")).select(F.col("full").alias("name"), F.lit(None).cast("string").alias("file"), F.lit("multimodal").alias("kind"), F.lit(False).alias("quantized"))
    quantised = rows.where(F.col("has_image_quantized") | F.col("has_audio_quantized")).select(F.concat("full", F.lit("-i8-qt")).alias("name"), F.lit(None).cast("string").alias("file"), F.lit("multimodal").alias("kind"), F.lit(True).alias("quantized"))
    return plain.unionByName(both).unionByName(quantised)


# --- repositories -----------------------------------------------------------

#: Names and endings of files that a repository's models need.
GENERATOR_FILES = ("genai_config.json", "tokenizer.json", "tokenizer.model", "tokenizer_config.json", "config.json", "special_tokens_map.json", "added_tokens.json", "generation_config.json")
GENERATOR_ENDINGS = (".onnx", ".onnx.data", ".onnx_data", ".txt", ".spm", ".tiktoken", ".jinja", "processor_config.json")
TOKENIZER_FILES = ("tokenizer.json", "tokenizer.model", "tokenizer_config.json", "config.json", "special_tokens_map.json")
ENCODERS = ("model", "text_model", "visual_model", "audio_model")
REPO_VARIANTS = ("", "fp16", "q4", "q4f16", "quantized")


def generator_variant(files: DataFrame, repo_col: str = "repo", path_col: str = "path") -> DataFrame:
    """(repo, variant): the folder with a generator's configuration to take: on the CPU with
    four-bit integers, else on the CPU, else any; then the smallest, then by name."""
    at = C.folder(F.col(path_col))
    dirs = files.where((C.base_name(F.col(path_col)) == "genai_config.json") & (at != ".")).select(repo_col, at.alias("variant")).distinct()
    low = F.lower("variant")
    tier = F.when(low.contains("cpu") & low.contains("int4"), 0).when(low.contains("cpu"), 1).otherwise(2)
    return dirs.groupBy(repo_col).agg(F.min(F.struct(tier.alias("t"), C.model_size(F.col("variant")).alias("s"), "variant")).alias("b")).select(repo_col, "b.variant")


def generator_files(files: DataFrame, repo_col: str = "repo", path_col: str = "path") -> DataFrame:
    """Files of the chosen variant (or of a repository without variants) that a generator needs."""
    base = C.base_name(F.col(path_col))
    needed = base.isin(*GENERATOR_FILES)
    for end in GENERATOR_ENDINGS:
        needed = needed | base.endswith(end)
    rows = files.join(generator_variant(files, repo_col, path_col), repo_col, "left")
    inside = F.col("variant").isNull() | F.startswith(F.col(path_col), F.concat("variant", F.lit("/"))) | (F.col(path_col) == F.col("variant"))
    return rows.where(inside & needed).select(repo_col, path_col)


def onnx_files(files: DataFrame, variant: str = "", repo_col: str = "repo", path_col: str = "path", order_col: str = "pos") -> DataFrame:
    """Tokenizer and configuration files (the first of each name) and the variant's model
    files; the default variant also takes quantised encoders."""
    base = C.base_name(F.col(path_col))
    end = f"_{variant}" if variant in REPO_VARIANTS and variant else ""
    wanted = [f"{e}{end}{x}" for e in ENCODERS for x in (".onnx", ".onnx_data")]
    if not end:
        wanted += [f"{e}_quantized{x}" for e in ENCODERS[1:] for x in (".onnx", ".onnx_data")]
    rows = files.select(repo_col, path_col, order_col, base.alias("_b"))
    first = F.row_number().over(Window.partitionBy(repo_col, "_b").orderBy(order_col))
    text = rows.where(F.col("_b").isin(*TOKENIZER_FILES)).withColumn("_r", first).where("_r = 1").drop("_r")
    return text.unionByName(rows.where(F.col("_b").isin(*wanted))).select(repo_col, path_col)


def repo_variants(files: DataFrame, repo_col: str = "repo", path_col: str = "path") -> DataFrame:
    """(repo, variants, generator_variants): sorted names of what a repository holds."""
    base = C.base_name(F.col(path_col))
    named = F.when(base == "model.onnx", "default")
    for v in REPO_VARIANTS[1:]:
        named = named.when(base == f"model_{v}.onnx", v)
    at = F.when((base == "genai_config.json") & (C.folder(F.col(path_col)) != "."), C.folder(F.col(path_col)))
    return files.groupBy(repo_col).agg(F.array_sort(F.collect_set(named)).alias("variants"), F.array_sort(F.collect_set(at)).alias("generator_variants"))


def repo_types(files: DataFrame, repo_col: str = "repo", path_col: str = "path") -> DataFrame:
    """(repo, type, error) by the files there are."""
    base = C.base_name(F.col(path_col))
    has = lambda *names: F.bool_or(base.isin(*names))
    both = files.groupBy(repo_col).agg(
        has("genai_config.json").alias("g"), (has("encoder.onnx") & has("decoder.onnx")).alias("r"), has("model.onnx").alias("m"),
        ((has("visual_model.onnx", "visual_model_quantized.onnx") | has("audio_model.onnx", "audio_model_quantized.onnx")) & has("text_model.onnx", "text_model_quantized.onnx")).alias("e"))
    kind = F.when(F.col("g"), "generator").when(F.col("r"), "rewriter").when(F.col("e"), "embedder")
    error = F.when(kind.isNull(), F.when(F.col("m"), "cannot tell the type of a lone model file").otherwise("no recognizable model files"))
    return both.select(repo_col, kind.alias("type"), error.alias("error"))


# --- listings ---------------------------------------------------------------


def list_models(models: DataFrame) -> DataFrame:
    """(type, names) of (type, name, capabilities); recognisers of any labels are listed as
    extractors too; fixed chunkers are always there."""
    from millrace.operators.chunking import FIXED_MODELS

    zero = models.where((F.col("type") == "recognizer") & F.array_contains("capabilities", "zeroshot")).select(F.lit("extractor").alias("type"), "name")
    fixed = models.sparkSession.createDataFrame([("chunker", n) for n in FIXED_MODELS], "type string, name string")
    return models.select("type", "name").unionByName(zero).unionByName(fixed).groupBy("type").agg(F.array_sort(F.collect_set("name")).alias("names"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``pos``, their place from 0 in order of the columns, without one task that sees them
    all: they are sorted by range and written to the shared folder, and each range counts on
    from those before it. Equal rows are numbered in any order."""
    spark = rows.sparkSession
    path = new_folder(spark, "numbered")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    starts = parts.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_start"))
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.join(starts, "_part").select(*[F.col(f"`{c}`") for c in rows.columns], (inside + F.col("_start")).alias("pos"))


def open_list(models: DataFrame, owned_by: str, created: int = 0) -> DataFrame:
    """(pos, id, object, created, owned_by): generators, then embedders, by name, each once."""
    order = F.when(F.col("type") == "generator", 0).when(F.col("type") == "embedder", 1)
    rows = numbered(models.where(order.isNotNull()).select(order.alias("o"), F.col("name").alias("id")).distinct(), "o", "id")
    return rows.select(F.col("pos").cast("int").alias("pos"), "id").withColumns({"object": F.lit("model"), "created": F.lit(created), "owned_by": F.lit(owned_by)})


def listing(models: DataFrame, kind: str = "") -> DataFrame:
    """(type, name, size) of (type, name, files array<struct<name,digest,size>>), of one type if given."""
    rows = models.where(F.col("type") == kind) if kind else models
    size = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f["size"], F.lit(0)))
    return rows.select("type", "name", C.byte_size(size).alias("size"))


#: Fixed value: characters of a description that a listing shows.
SHOWN = 50


def remote_listing(entries: DataFrame, kind: str = "") -> DataFrame:
    """(name, type, size, variants, description) of index entries (see sources.index), of one type
    (singular or plural, in any case) if given; an unknown type is an error. Long
    descriptions end in three dots. Rows of unusable indexes are left out."""
    if kind and kind.lower() not in (low := {n: t for t in C.MODEL_TYPES for n in (t, t + "s")}):
        raise ValueError(f"unknown model type: {kind}")
    rows = entries.where(F.col("type") == low[kind.lower()]) if kind else entries.where("error is null")
    text = F.coalesce("description", F.lit(""))
    shown = F.when(F.char_length(text) > SHOWN, F.concat(F.left(text, F.lit(SHOWN - 3)), F.lit("..."))).otherwise(text)
    return rows.select("name", "type", C.byte_size(F.coalesce("size", F.lit(0))).alias("size"), F.array_join(F.coalesce("variants", F.array().cast("array<string>")), ",").alias("variants"), shown.alias("description"))


def ready(models: DataFrame) -> DataFrame:
    """(ready, models): ready once any embedder, chunker, reranker or generator is there."""
    n = F.count(F.when(F.col("type").isin("embedder", "chunker", "reranker", "generator"), 1))
    return models.agg((n > 0).alias("ready"), n.alias("models"))


def version(spark, number: str, commit: str = "unknown", built: str = "unknown") -> DataFrame:
    """One row: version, commit, build time, runtime."""
    return spark.createDataFrame([(number, commit, built, f"spark-{spark.version}")], "version string, git_commit string, build_time string, runtime string")


def choose_backends(models: DataFrame, priority: list[str], available: list[str]) -> DataFrame:
    """Models (name, backends) with ``backend``: the first by priority that the model allows
    (empty: all) and that is there; null for none."""
    specs = F.array(*[C.backend_spec(F.lit(p)) for p in priority])
    fits = F.filter(specs, lambda s: ((F.coalesce(F.size("backends"), F.lit(0)) <= 0) | F.array_contains("backends", s["backend"])) & s["backend"].isin(*available))
    return models.withColumn("backend", F.try_element_at(fits, F.lit(1))["backend"])


#: Model families by the names in configurations.
FAMILIES = {"gemma": "gemma", "gemma2": "gemma", "gemma3_text": "gemma", "llama": "llama", "mistral": "mistral", "phi": "phi", "phi3": "phi", "qwen2": "qwen2", "gpt2": "gpt2"}


def runtime_config(rows: DataFrame, id_col: str = "model", json_col: str = "config") -> DataFrame:
    """(id, type and sizes) that a generator runs with, from a model's configuration and defaults."""
    n = lambda key, default: F.coalesce(F.get_json_object(json_col, f"$.{key}").try_cast("double").cast("int"), default if isinstance(default, Column) else F.lit(default))
    named, arch = F.get_json_object(json_col, "$.model_type"), F.lower(F.get_json_object(json_col, "$.architectures[0]"))
    table = F.create_map(*[F.lit(x) for p in FAMILIES.items() for x in p])
    guess = F.when(named.isNotNull(), F.when(arch.contains("gemma"), "gemma").when(arch.contains("llama"), "llama").when(arch.contains("mistral"), "mistral"))
    hidden, heads = n("hidden_size", 2048), n("num_attention_heads", 8)
    return rows.select(
        id_col, F.coalesce(F.try_element_at(table, named), guess, F.lit("gpt2")).alias("type"), n("vocab_size", 32000).alias("vocab_size"), hidden.alias("hidden_size"),
        n("num_hidden_layers", 16).alias("num_hidden_layers"), heads.alias("num_attention_heads"), n("num_key_value_heads", heads).alias("num_key_value_heads"),
        n("intermediate_size", hidden * 4).alias("intermediate_size"), n("head_dim", F.floor(hidden / heads).cast("int")).alias("head_dim"),
        n("max_position_embeddings", 8192).alias("context_length"))


#: Bounds of histograms, in seconds.
REQUEST_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)
WAIT_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)
LOAD_BUCKETS = (0.1, 0.5, 1, 2, 5, 10, 30, 60)


def counters(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("total"))


def histogram(events: DataFrame, value: Column, *labels: str, buckets: tuple = REQUEST_BUCKETS) -> DataFrame:
    """(labels, le, count): cumulative counts up to each bound, the last one infinite. All
    bounds are counted in one pass."""
    sums = [F.count(F.when(value <= b, 1)).alias(f"_{k}") for k, b in enumerate(buckets)]
    wide = events.groupBy(*labels).agg(*sums, F.count(value).alias("_all"))
    each = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{k}").alias("count")) for k, b in enumerate(buckets)], F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("count"))))
    return wide.select(*labels, each.alias("b")).select(*labels, "b.*")


def by_window(events: DataFrame, width: str, *labels: str, ts_col: str = "ts") -> DataFrame:
    """(start, labels, total) of tumbling windows."""
    return events.groupBy(F.window(ts_col, width).alias("w"), *labels).agg(F.count("*").alias("total")).select(F.col("w.start").alias("start"), *labels, "total")
