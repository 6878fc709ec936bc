"""Expressions over model references, files and configuration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Variants and the files that hold them.
VARIANT_FILES = {"f32": "model.onnx", "f16": "model_f16.onnx", "bf16": "model_bf16.onnx", "i8": "model_i8.onnx", "i8-st": "model_i8-st.onnx", "i4": "model_i4.onnx"}

#: Kinds of models.
MODEL_TYPES = ("embedder", "chunker", "reranker", "generator", "recognizer", "rewriter", "classifier", "reader", "transcriber")

#: What a model can be said to do.
CAPABILITIES = ("image", "audio", "labels", "zeroshot", "relations", "answers", "classification")

#: Backends and the names of their devices.
BACKENDS = ("onnx", "xla", "coreml", "go")
DEVICES = {"auto": "auto", "": "auto", "cuda": "cuda", "gpu": "cuda", "coreml": "coreml", "tpu": "tpu", "cpu": "cpu", "off": "cpu"}

#: Parts of names of models that need the ONNX backend.
ONNX_ONLY = ("nomic-ai/nomic-embed-text-v1.5",)


def model_ref(ref: Column, variants: tuple[str, ...] = tuple(VARIANT_FILES)) -> Column:
    """struct(remote, owner, name, variant, error) of ``[hf:][owner/]name[:variant]``."""
    remote = ref.startswith("hf:")
    bare = F.when(remote, F.substring(ref, 4, 1 << 30)).otherwise(ref)
    tagged = F.instr(bare, ":") > 0
    variant = F.when(tagged, F.substring_index(bare, ":", -1)).otherwise("")
    path = F.when(tagged, F.left(bare, F.length(bare) - F.length(variant) - 1)).otherwise(bare)
    owned = F.instr(path, "/") > 0
    owner = F.when(owned, F.substring_index(path, "/", 1)).otherwise("")
    name = F.when(owned, F.substring(path, F.length(owner) + 2, F.length(path))).otherwise(path)
    error = (
        F.when(F.coalesce(ref, F.lit("")) == "", "empty model reference")
        .when((variant != "") & ~variant.isin(*variants), "invalid variant")
        .when(name == "", "empty name")
    )
    return F.struct(F.coalesce(remote, F.lit(False)).alias("remote"), owner.alias("owner"), name.alias("name"), variant.alias("variant"), error.alias("error"))


def model_type(name: Column) -> Column:
    """The kind that a singular or plural name stands for, in any case; null for others."""
    low = F.lower(name)
    return F.when(low.isin(*MODEL_TYPES), low).when(low.isin(*[t + "s" for t in MODEL_TYPES]), F.regexp_replace(low, "s$", ""))


def is_capability(name: Column) -> Column:
    return name.isin(*CAPABILITIES)


def backend_spec(spec: Column) -> Column:
    """struct(backend, device) of ``backend[:device]``; null where either is unknown."""
    backend = F.substring_index(spec, ":", 1)
    device = F.when(F.instr(spec, ":") > 0, F.lower(F.substring(spec, F.length(backend) + 2, F.length(spec)))).otherwise("")
    known = F.try_element_at(F.create_map(*[F.lit(x) for p in DEVICES.items() for x in p]), device)
    return F.when(F.lower(backend).isin(*BACKENDS) & known.isNotNull(), F.struct(F.lower(backend).alias("backend"), known.alias("device")))


def required_backends(name: Column, declared: Column) -> Column:
    """What the manifest declares, else ONNX for names that need it, else null (all)."""
    needs = F.lit(False)
    for part in ONNX_ONLY:
        needs = needs | name.contains(part)
    return F.when(F.size(declared) > 0, declared).when(needs, F.array(F.lit("onnx")))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    """The folder of a file; ``.`` at the top."""
    return F.when(F.instr(path, "/") > 0, F.left(path, F.length(path) - F.length(base_name(path)) - 1)).otherwise(".")


#: Sizes looked for in names, in this order.
MODEL_SIZES = (1, 2, 3, 4, 7, 8, 12, 13, 27, 70)


def model_size(path: Column) -> Column:
    """Size in a name such as ``-4b`` (or ``4b-``); 999 without any."""
    low, out = F.lower(path), None
    for mark in ("-{}b", "{}b-"):
        for n in MODEL_SIZES:
            out = F.when(low.contains(mark.format(n)), n) if out is None else out.when(low.contains(mark.format(n)), n)
    return out.otherwise(999)


def byte_size(n: Column) -> Column:
    """Bytes in powers of 1024 with one decimal."""
    shown = lambda p, unit: F.concat(F.replace(F.format_number(n / 1024**p, 1), F.lit(","), F.lit("")), F.lit(f" {unit}"))
    return F.when(n >= 1024**3, shown(3, "GB")).when(n >= 1024**2, shown(2, "MB")).when(n >= 1024, shown(1, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def first_nonzero(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit(0)) for v in values], F.lit(0))


def path_kind(files: Column, name: Column) -> Column:
    """Kind of recogniser that a folder's files and name tell of: triplets, spans or tokens."""
    low = F.lower(name)
    pair = F.array_contains(files, "encoder_model.onnx") & F.array_contains(files, "decoder_model.onnx")
    triplets = F.array_contains(files, "rebel_config.json") | (low.contains("rebel") & pair)
    spans = low.contains("gliner") | F.array_contains(files, "gliner_config.json")
    return F.when(triplets, "triplets").when(spans, "spans").otherwise("tokens")


def random_id(prefix: str, key: Column) -> Column:
    """``prefix`` and 24 hex digits; drawn from the key, so that a retried task gives the same."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(key.cast("string"), 256), 1, 24))
