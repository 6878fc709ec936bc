"""WAV files: reading, writing; MP3 where a decoder is installed."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a decoded file is in Spark.
SOUND = "struct<sample_rate:int,bits:int,channels:int,samples:array<float>>"


def parse_wav(raw: bytes) -> tuple[np.ndarray, dict]:
    """(mono samples, format) of a PCM file of 8, 16, 24 or 32 bits; channels are averaged.
    ValueError for anything else."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body, at = raw[at + 8 : at + 8 + size], at + 8 + size
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
        elif name == b"data":
            if len(body) < size:
                raise ValueError("reading audio data: unexpected end")
            data = body
    if data is None:
        raise ValueError("no audio data found")
    if form is None or form[0] != 1:
        raise ValueError(f"unsupported audio format {form and form[0]} (only PCM supported)")
    _, channels, rate, _, _, bits = form
    width = bits // 8
    if bits not in (8, 16, 24, 32):
        raise ValueError(f"unsupported bits per sample: {bits}")
    frames = len(data) // (width * channels)
    cut = np.frombuffer(data, np.uint8, frames * width * channels)
    if bits == 8:
        x = (cut.astype(float) - 128) / 128
    else:
        low = np.zeros((len(cut) // width, 4), np.uint8)
        low[:, 4 - width :] = cut.reshape(-1, width)  # the high bytes of 32 bits
        x = low.view("<i4").ravel() / 2147483648.0
    return x.reshape(frames, channels).mean(1).astype(np.float32), {"sample_rate": rate, "bits": bits, "channels": channels}


def encode_wav(samples, sample_rate: int, bits: int = 16, channels: int = 1) -> bytes:
    """A PCM file of samples clamped to [-1, 1], each written to all channels."""
    x = np.clip(np.asarray(samples, np.float32), -1, 1).astype(float)
    if not len(x):
        raise ValueError("no samples to encode")
    if sample_rate <= 0:
        raise ValueError(f"invalid sample rate: {sample_rate}")
    if bits not in (8, 16, 24, 32):
        raise ValueError(f"unsupported bits per sample: {bits} (must be 8, 16, 24, or 32)")
    channels, width = max(channels, 1), bits // 8
    top = {8: 127.0, 16: 32767.0, 24: 8388607.0, 32: 2147483647.0}[bits]
    n = np.copysign(np.floor(np.abs(x * top) + 0.5), x).astype(np.int64)  # halves away from zero
    n = np.repeat(n + 128 * (bits == 8), channels)
    body = n.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, sample_rate, sample_rate * channels * width, channels * width, bits, b"data", len(body))
    return head + body


def parse_mp3(raw: bytes) -> tuple[np.ndarray, dict]:
    """Mono samples by an optional decoder; none comes with this package."""
    try:
        import miniaudio
    except ImportError as missing:
        raise RuntimeError("reading MP3 needs the miniaudio package") from missing
    sound = miniaudio.decode(raw, nchannels=2)
    return (np.array(sound.samples, float).reshape(-1, 2).mean(1) / 32768).astype(np.float32), {"sample_rate": sound.sample_rate, "bits": 16, "channels": 1}


def read_wav(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(id, sound, error) of files' bytes (as of Spark's binaryFile source)."""

    def work(batches: Iterator):
        import pyarrow as pa

        kind = pa.struct([("sample_rate", pa.int32()), ("bits", pa.int32()), ("channels", pa.int32()), ("samples", pa.list_(pa.float32()))])
        for batch in batches:
            sounds, errors = [], []
            for x in batch.column(1):
                try:
                    samples, form = parse_wav(x.as_py() or b"")
                    sounds.append(form | {"samples": samples})
                    errors.append(None)
                except (ValueError, struct.error) as e:
                    sounds.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sounds, kind), pa.array(errors, pa.string())], names=["id", "sound", "error"])

    rows = files.select(F.col(id_col).alias("id"), F.col(content_col).alias("c"))
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, sound {SOUND}, error string").withColumnRenamed("id", id_col)


def write_wav(sounds: DataFrame, id_col: str, samples_col: str = "samples", rate_col: str = "sample_rate", bits_col: str = "bits", channels_col: str = "channels") -> DataFrame:
    """(id, content): WAV bytes of rows."""

    def work(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            c = [batch.column(k).to_pylist() for k in range(1, 5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode_wav(*x) for x in zip(*c)], pa.binary())], names=["id", "content"])

    rows = sounds.select(F.col(id_col).alias("id"), samples_col, rate_col, bits_col, channels_col)
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, content binary").withColumnRenamed("id", id_col)
