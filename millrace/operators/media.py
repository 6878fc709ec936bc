"""Chunks of sound and of animated images."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources import audio, images

WINDOW_MS, OVERLAP_MS = 30_000, 0
CHUNK = "chunk_id int, mime_type string, data binary, start_time_ms float, end_time_ms float, frame_index int, frame_delay_ms int"

#: Media types by the way they are cut.
KINDS = {"audio/wav": "wav", "audio/x-wav": "wav", "audio/wave": "wav", "audio/mpeg": "mp3", "audio/mp3": "mp3", "image/gif": "gif"}


def media_kind(mime: Column) -> Column:
    """wav, mp3 or gif of a media type in any case, blanks around it ignored; null for others."""
    table = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    return F.try_element_at(table, F.lower(F.trim(mime)))


def windows(samples: Column, rate: Column, window_ms: int = WINDOW_MS, overlap_ms: int = OVERLAP_MS, most: int = 0) -> Column:
    """array<struct<chunk_id, start, end, start_ms, end_ms>> over a number of samples: a
    window every step until the samples end, the last ones cut short."""
    window_ms = window_ms if window_ms > 0 else WINDOW_MS
    overlap_ms = overlap_ms if overlap_ms >= 0 else OVERLAP_MS
    size, over = (F.floor(rate * ms / 1000).cast("int") for ms in (window_ms, overlap_ms))
    step = F.when(size - over > 0, size - over).otherwise(F.raise_error("overlap_duration_ms must be less than window_duration_ms").cast("int"))
    starts = F.when(samples > 0, F.sequence(F.lit(0), samples - 1, step)).otherwise(F.array().cast("array<int>"))
    starts = F.slice(starts, 1, most) if most > 0 else starts
    ms = lambda n: (n.cast("float") * F.lit(1000.0).cast("float") / rate.cast("float")).cast("float")
    end = lambda s: F.least(s + size, samples)
    return F.transform(starts, lambda s, i: F.struct(i.alias("chunk_id"), s.alias("start"), end(s).alias("end"), ms(s).alias("start_ms"), ms(end(s)).alias("end_ms")))


def _sound_chunks(samples, form: dict, window_ms: int, overlap_ms: int, most: int) -> list[dict]:
    rate = form["sample_rate"]
    size, over = rate * (window_ms if window_ms > 0 else WINDOW_MS) // 1000, rate * max(overlap_ms, 0) // 1000
    if size - over <= 0:
        raise ValueError("overlap_duration_ms must be less than window_duration_ms")
    out = []
    for start in range(0, len(samples), size - over):
        end = min(start + size, len(samples))
        out.append({"chunk_id": len(out), "mime_type": "audio/wav", "data": audio.encode_wav(samples[start:end], rate, form["bits"], 1),
                    "start_time_ms": start * 1000.0 / rate, "end_time_ms": end * 1000.0 / rate})
        if most and len(out) >= most:
            break
    return out


def chunk_media(files: DataFrame, window_ms: int = WINDOW_MS, overlap_ms: int = OVERLAP_MS, most: int = 0, id_col: str = "path", mime_col: str = "mime_type", data_col: str = "content") -> DataFrame:
    """(id, chunk fields, error): windows of sound as WAV, frames of GIFs as PNG. Empty,
    unreadable and other media give one row with an error. A chunk is written as soon
    as its batch is done, so that a long file is held once."""

    def work(batches: Iterator):
        import pyarrow as pa

        kinds = {"chunk_id": pa.int32(), "mime_type": pa.string(), "data": pa.binary(), "start_time_ms": pa.float32(), "end_time_ms": pa.float32(), "frame_index": pa.int32(), "frame_delay_ms": pa.int32(), "error": pa.string()}
        for batch in batches:
            for k in range(batch.num_rows):
                raw, mime = batch.column(2)[k].as_py(), batch.column(1)[k].as_py()
                try:
                    rows = _cut(raw, mime)
                except (ValueError, RuntimeError) as e:
                    rows = [{"error": str(e)}]
                columns = [pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(rows), pa.int64())), *columns], names=["id", *kinds])

    def _cut(raw, mime):
        if not raw:
            raise ValueError("empty media data")
        kind = KINDS.get((mime or "").strip().lower())
        if kind == "gif":
            return [{"chunk_id": f["index"], "mime_type": "image/png", "data": images.encode_png(f["pixels"]), "frame_index": f["index"], "frame_delay_ms": f["delay_ms"]} for f in images.gif_frames(raw, most)]
        if kind is None:
            raise ValueError(f"unsupported media type for chunking: {mime}")
        samples, form = audio.parse_wav(raw) if kind == "wav" else audio.parse_mp3(raw)
        return _sound_chunks(samples, form, window_ms, overlap_ms, most)

    rows = files.select(F.col(id_col).alias("id"), mime_col, data_col)
    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, {CHUNK}, error string").withColumnRenamed("id", id_col)
