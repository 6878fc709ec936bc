"""Model inputs from pixels and samples, and field trees from generated text."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.pieces import PIECE_BYTES, pieces

# --- images -----------------------------------------------------------------


def center_crop(x: np.ndarray, size: int) -> np.ndarray:
    """The middle square of at most ``size``."""
    h, w = min(size, x.shape[0]), min(size, x.shape[1])
    top, left = (x.shape[0] - h) // 2, (x.shape[1] - w) // 2
    return x[top : top + h, left : left + w]


def resize(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear at x * ratio (no half-pixel shift), in 16-bit values cut to 8 bits."""
    if x.shape[:2] == (height, width):
        return x
    wide = x.astype(float) * 257

    def places(n, m):
        at = np.arange(n) * (m / n)
        low = at.astype(int)
        return low, np.minimum(low + 1, m - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = places(height, x.shape[0]), places(width, x.shape[1])
    fx, fy = fx[None, :, None], fy[:, None, None]
    top = wide[y0][:, x0] * (1 - fx) + wide[y0][:, x1] * fx
    low = wide[y1][:, x0] * (1 - fx) + wide[y1][:, x1] * fx
    return ((top * (1 - fy) + low * fy).astype(np.uint16) >> 8).astype(np.uint8)


def pixel_tensor(x: np.ndarray, width: int = 224, height: int = 224, crop: int = 0, rescale: float = 1 / 255, mean=(0.5, 0.5, 0.5), std=(0.5, 0.5, 0.5)) -> np.ndarray:
    """[3, height, width] of RGB pixels: crop, resize, rescale, normalise."""
    if crop:
        x = center_crop(x, crop)
    x = resize(x[:, :, :3], width, height).astype(np.float32) * np.float32(rescale)
    return ((x - np.array(mean, np.float32)) / np.array(std, np.float32)).transpose(2, 0, 1)


def pad_image(x: np.ndarray, width: int, height: int, colour) -> np.ndarray:
    """Centred on a canvas of a colour; images at least as large both ways stay."""
    h, w = x.shape[:2]
    if w >= width and h >= height:
        return x
    out = np.empty((height, width, x.shape[2]), x.dtype)
    out[:] = colour
    top, left = (height - h) // 2 if height >= h else -((h - height) // 2), (width - w) // 2 if width >= w else -((w - width) // 2)
    y0, x0 = max(top, 0), max(left, 0)
    part = x[max(-top, 0) :, max(-left, 0) :][: height - y0, : width - x0]
    out[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]] = part
    return out


def crop_margin(x: np.ndarray, tolerance: int) -> np.ndarray:
    """Without borders whose colours (16-bit) are within the tolerance of the first pixel's."""
    off = (np.abs(x[:, :, :3].astype(int) - x[0, 0, :3].astype(int)) * 257 > tolerance).any(2)
    if not off.any():
        return x
    rows, cols = np.flatnonzero(off.any(1)), np.flatnonzero(off.any(0))
    return x[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]


def image_features(files: DataFrame, decode: Callable[[bytes], np.ndarray], id_col: str = "path", content_col: str = "content", **settings) -> DataFrame:
    """(id, shape, pixels): flat tensors of decoded images."""

    def work(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                t = pixel_tensor(decode(batch.column(1)[k].as_py()), **settings)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([list(t.shape)], pa.list_(pa.int32())), pa.array([t.ravel()], pa.list_(pa.float32()))], names=["id", "shape", "pixels"])

    rows = files.select(F.col(id_col).alias("id"), F.col(content_col).alias("c"))
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, shape array<int>, pixels array<float>").withColumnRenamed("id", id_col)


# --- sound ------------------------------------------------------------------


def resample(x: np.ndarray, from_rate: int, to_rate: int) -> np.ndarray:
    """Linear interpolation at the new rate."""
    if from_rate == to_rate:
        return x
    ratio = from_rate / to_rate
    at = np.arange(int(len(x) / ratio)) * ratio
    low = at.astype(int)
    share = (at - low).astype(np.float32)
    after = np.where(low + 1 < len(x), x[np.minimum(low + 1, len(x) - 1)], x[low])
    return (x[low] * (1 - share) + after * share).astype(np.float32)


@functools.cache
def mel_filters(n_mels: int = 80, n_fft: int = 400, rate: int = 16000) -> np.ndarray:
    """[n_mels, n_fft // 2 + 1] triangles between points even on the mel scale."""
    bins = n_fft // 2 + 1
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hertz = 700 * (10 ** (np.linspace(0, top, n_mels + 2) / 2595) - 1)
    at = np.minimum(np.floor((n_fft + 1) * hertz / rate + 0.5).astype(int), bins - 1)
    out, k = np.zeros((n_mels, bins), np.float32), np.arange(bins)
    for m, (a, b, c) in enumerate(zip(at, at[1:], at[2:])):
        up = (k >= a) & (k < b)
        down = (k >= b) & (k <= c) if c != b else np.zeros(bins, bool)
        out[m, up] = (k[up] - a) / (b - a) if b != a else 0
        out[m, down] = (c - k[down]) / (c - b)
    return out


def log_mel(x: np.ndarray, rate: int = 16000, n_fft: int = 400, hop: int = 160, n_mels: int = 80, seconds: int = 30, padding: float = 0.0, speech: bool = True) -> np.ndarray:
    """[frames, n_mels]: magnitudes of windowed frames through the mel filters, as logarithms.

    Samples are cut or padded to ``seconds`` and padded by half a frame at both ends.
    The transform runs at the next power of two and its first n_fft // 2 + 1 bins
    are read. ``speech``: base 10, at most 8 below the maximum, (x + 4) / 4; else the
    natural logarithm."""
    target = seconds * rate
    x = np.concatenate([x[:target], np.full(max(target - len(x), 0), padding)]).astype(np.float32)
    x = np.concatenate([np.full(n_fft // 2, padding, np.float32), x, np.full(n_fft // 2, padding, np.float32)])
    frames = max(target // hop, 1)
    short = (frames - 1) * hop + n_fft - len(x)
    x = np.concatenate([x, np.zeros(max(short, 0), np.float32)])
    window = (0.5 * (1 - np.cos(2 * np.pi * np.arange(n_fft) / (n_fft - 1)))).astype(np.float32)
    cut = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop][:frames] * window
    power = 1 << (n_fft - 1).bit_length()
    spectrum = np.abs(np.fft.rfft(cut, n=power)[:, : n_fft // 2 + 1]).astype(np.float32)
    mel = np.maximum(spectrum @ mel_filters(n_mels, n_fft, rate).T, 1e-10)
    if not speech:
        return np.log(mel).astype(np.float32)
    logs = np.log10(mel)
    return ((np.maximum(logs, logs.max() - 8) + 4) / 4).astype(np.float32)


def sound_features(sounds: DataFrame, id_col: str = "path", sound_col: str = "sound", rate: int = 16000, **settings) -> DataFrame:
    """(id, frames, mel): flat log-mel features of decoded sounds, resampled to the rate."""

    def work(batches: Iterator):
        import pyarrow as pa

        def done(ids, mels):
            return pa.RecordBatch.from_arrays([ids, pa.array([len(m) for m in mels], pa.int32()), pa.array([m.ravel() for m in mels], pa.list_(pa.float32()))], names=["id", "frames", "mel"])

        for batch in batches:
            mels, first = [], 0
            for k in range(batch.num_rows):
                s = batch.column(1)[k].as_py()
                x = resample(np.array(s["samples"], np.float32), s["sample_rate"], rate)
                mels.append(log_mel(x, rate, **settings))
                if sum(m.nbytes for m in mels) >= PIECE_BYTES:
                    yield done(batch.column(0).slice(first, len(mels)), mels)
                    mels, first = [], k + 1
            if mels:
                yield done(batch.column(0).slice(first, len(mels)), mels)

    rows = sounds.select(F.col(id_col).alias("id"), F.col(sound_col).alias("s")).where("s is not null")
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, frames int, mel array<float>").withColumnRenamed("id", id_col)


# --- fields -----------------------------------------------------------------

_OPEN = re.compile(r"<s_([a-zA-Z_][a-zA-Z0-9_]*)>")


def field_tree(text: str, prefix: str = "") -> dict[str, str]:
    """``<s_a><s_b>v</s_b></s_a>`` as {"a.b": "v"}: later values replace earlier ones, a
    mark without its end is passed over."""
    out, at = {}, 0
    while m := _OPEN.search(text, at):
        end = f"</s_{m[1]}>"
        stop = text.find(end, m.end())
        at = m.end() if stop < 0 else stop + len(end)
        if stop >= 0:
            value, key = text[m.end() : stop].strip(), f"{prefix}.{m[1]}" if prefix else m[1]
            out.update(field_tree(value, key) if "<s_" in value else {key: value})
    return out


def parse_fields(rows: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, fields map) of generated texts."""

    def work(batches: Iterator):
        import pyarrow as pa

        for part in (p for batch in batches for p in pieces(batch)):
            maps = [list(field_tree(x.as_py() or "").items()) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(maps, pa.map_(pa.string(), pa.string()))], names=["id", "fields"])

    given = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return given.mapInArrow(work, f"id {dict(given.dtypes)['id']}, fields map<string,string>").withColumnRenamed("id", id_col)


#: Parts of paths that tell a model's kind, in this order.
READER_KINDS = (("trocr", "trocr"), ("donut", "donut"), ("florence", "florence"))
TRANSCRIBER_KINDS = (("whisper", "whisper"), ("wav2vec2", "wav2vec2"), ("wav2vec-2", "wav2vec2"), ("hubert", "hubert"))


def kind_of(path: str, kinds: tuple[tuple[str, str], ...]) -> str:
    """The kind whose mark is in the path, in any case; generic for others."""
    return next((kind for part, kind in kinds if part in path.lower()), "generic")


def _limited(model: Callable, **options) -> Callable:
    """A model made with those of the options that are set."""
    given = {k: v for k, v in options.items() if v}
    return (lambda: model(**given)) if given else model


def read_documents(images: DataFrame, model: Callable, id_col: str = "path", content_col: str = "content", model_path: str = "donut", prompt: str = "", max_tokens: int = 0) -> DataFrame:
    """(id, text, fields): the model's text of each image, read as its kind (by ``model_path``) has it.

    Marked answers lose their task marks and give fields, or the answer alone where the
    prompt asks a document question; line readers get their line breaks back; other texts are
    trimmed. Only marked answers have fields. ``prompt`` and ``max_tokens`` (new tokens an
    image at most) go to the model where they are set: it is then made with these names."""
    from millrace.functions import text as T
    from millrace.operators.tokens import run_model

    kind = kind_of(model_path, READER_KINDS)
    raw = run_model(images.select(F.col(id_col), F.col(content_col)), _limited(model, prompt=prompt, max_tokens=max_tokens), [content_col], "_raw", "string", 1)
    if kind != "donut":
        text = T.recover_lines(F.col("_raw")) if kind == "florence" else T.trim(F.col("_raw"))
        return raw.select(id_col, text.alias("text"), F.create_map().cast("map<string,string>").alias("fields"))
    asked = "<s_docvqa>" in prompt
    stripped = T.strip_task(F.col("_raw"))
    texts = raw.select(id_col, (T.document_answer(F.col("_raw")) if asked else stripped).alias("text"), stripped.alias("_s"))
    whole = texts.withColumn("_r", F.struct(id_col, "text", F.col("_s").alias("s")))
    fields = parse_fields(whole.select("_r", F.col("_s").alias("text")), "_r")  # one pass: the model is not run again for the fields
    return fields.select(F.col("_r")[id_col].alias(id_col), F.col("_r")["text"].alias("text"), "fields")


def transcribe(sounds: DataFrame, model: Callable, id_col: str = "path", sound_col: str = "sound", model_path: str = "whisper", language: str = "", max_tokens: int = 0) -> DataFrame:
    """(id, text): the model's text of each sound, without special marks where its kind (by
    ``model_path``) writes them, trimmed for others. ``language`` and ``max_tokens`` go to the
    model where they are set: it is then made with these names."""
    from millrace.functions import text as T
    from millrace.operators.tokens import run_model

    raw = run_model(sounds.select(F.col(id_col), F.col(sound_col)), _limited(model, language=language, max_tokens=max_tokens), [sound_col], "_raw", "string", 1)
    marked = kind_of(model_path, TRANSCRIBER_KINDS) == "whisper"
    return raw.select(id_col, (T.clean_transcript(F.col("_raw")) if marked else T.trim(F.col("_raw"))).alias("text"))
