"""GIF reading and PNG writing with numpy and zlib alone."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def _blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    """Data sub-blocks run together, and the place behind them."""
    out = []
    while raw[at]:
        out.append(raw[at + 1 : at + 1 + raw[at]])
        at += 1 + raw[at]
    return b"".join(out), at + 1


def _lzw(data: bytes, width: int, count: int) -> np.ndarray:
    """Colour numbers of a variable-width LZW stream."""
    clear, stop = 1 << width, (1 << width) + 1
    plain = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, size, before, out, have = list(plain), width + 1, None, [], 0
    bits, n, at = 0, 0, 0
    while have < count:
        while n < size:
            if at == len(data):
                raise ValueError("not enough image data")
            bits |= data[at] << n
            n, at = n + 8, at + 1
        code, bits, n = bits & (1 << size) - 1, bits >> size, n - size
        if code == clear:
            table, size, before = list(plain), width + 1, None
            continue
        if code == stop:
            break
        if code < len(table):
            entry = table[code]
        elif before is not None and code == len(table):
            entry = before + before[:1]
        else:
            raise ValueError("bad LZW code")
        out.append(entry)
        have += len(entry)
        if before is not None and len(table) < 4096:
            table.append(before + entry[:1])
            if len(table) == 1 << size and size < 12:
                size += 1
        before = entry
    flat = b"".join(out)
    if len(flat) < count:
        raise ValueError("not enough image data")
    return np.frombuffer(flat[:count], np.uint8)


def gif_frames(raw: bytes, most: int = 0) -> list[dict]:
    """Composited frames: index, delay in ms and RGBA pixels [height, width, 4].

    A frame is drawn over the canvas; before it, the area of one that asked for the
    background is cleared. Restoring to an earlier state is not done. At most
    ``most`` frames if that is above 0. ValueError for anything that is no GIF."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    try:
        return _frames(raw, most)
    except (IndexError, struct.error) as e:
        raise ValueError("unexpected end of GIF") from e


def _frames(raw: bytes, most: int) -> list[dict]:
    width, height, flags = struct.unpack_from("<HHB", raw, 6)
    at, palette = 13, None
    colours = lambda at, flags: np.frombuffer(raw, np.uint8, 3 << (flags & 7) + 1, at).reshape(-1, 3)
    if flags & 0x80:
        palette = colours(at, flags)
        at += palette.size
    canvas = np.zeros((height, width, 4), np.uint8)
    out, delay, clear_colour, disposal, last = [], 0, None, 0, None
    while raw[at] != 0x3B:
        if raw[at] == 0x21:
            label, (body, after) = raw[at + 1], _blocks(raw, at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_colour = packed >> 2 & 7, index if packed & 1 else None
            at = after
            continue
        if raw[at] != 0x2C:
            raise ValueError("unknown GIF block")
        x, y, w, h, flags = struct.unpack_from("<HHHHB", raw, at + 1)
        at, own = at + 10, palette
        if flags & 0x80:
            own = colours(at, flags)
            at += own.size
        if own is None:
            raise ValueError("no color table")
        if x + w > width or y + h > height:
            raise ValueError("frame bounds larger than image bounds")
        code_width = raw[at]
        body, at = _blocks(raw, at + 1)
        pixels = _lzw(body, code_width, w * h).reshape(h, w)
        if flags & 0x40:  # interlaced
            order = [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, h, step)]
            rows = np.empty_like(pixels)
            rows[order] = pixels
            pixels = rows
        if last is not None and last[0] == 2:
            canvas[last[1]] = 0
        area = (slice(y, y + h), slice(x, x + w))
        seen = pixels != clear_colour if clear_colour is not None else np.ones(pixels.shape, bool)
        if pixels[seen].size and pixels[seen].max() >= len(own):
            raise ValueError("invalid pixel value")
        canvas[area][seen] = np.concatenate([own[pixels[seen]], np.full((int(seen.sum()), 1), 255, np.uint8)], 1)
        out.append({"index": len(out), "delay_ms": delay * 10, "pixels": canvas.copy()})
        last, delay, clear_colour, disposal = (disposal, area), 0, None, 0
        if most and len(out) >= most:
            break
    if not out:
        raise ValueError("GIF contains no frames")
    return out


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of [height, width, 3 or 4] bytes."""
    h, w, c = pixels.shape
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * c)], 1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def decode_png(raw: bytes) -> np.ndarray:
    """[height, width, channels] of an 8-bit PNG without palette and interlace."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, head = 8, [], None
    while at < len(raw):
        size, name = struct.unpack_from(">I4s", raw, at)
        body, at = raw[at + 8 : at + 8 + size], at + 12 + size
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            data.append(body)
    w, h, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("unsupported PNG")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, w * channels + 1)
    out = np.zeros((h + 1, w * channels + channels), np.int64)  # a border of zeros above and to the left
    for y, line in enumerate(lines):
        kind, up, row = line[0], out[y], out[y + 1]
        for x in range(channels, len(row)):
            a, b, c = row[x - channels], up[x], up[x - channels]
            if kind == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            else:
                near = (0, a, b, (a + b) // 2)[kind]
            row[x] = (line[x - channels + 1] + near) & 255
    return out[1:, channels:].astype(np.uint8).reshape(h, w, channels)
