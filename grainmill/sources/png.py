"""PNG images decoded within tasks, downscaled and measured.

Images of 8 bits a channel without interlacing are read: grey, grey with alpha, RGB, RGBA and palettes. Others, and broken files, give nulls.
An image is one row; all of it is in memory while it is read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.sources.io import image_statistics

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MOST_PIXELS = 1 << 28
STATISTICS = ("sharpness", "contrast", "brightness", "entropy")


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size


def unfiltered(raw: np.ndarray, filters: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes with their filters undone; ``step`` is the number of bytes a pixel.

    A row depends on the one above: sums along a row for the left neighbour, whole rows for the upper one, and byte by byte only where both count.
    """
    out = np.zeros((len(raw) + 1, raw.shape[1] + step), np.uint8)  # a row and a pixel of zeros before
    for y, (row, kind) in enumerate(zip(raw, filters, strict=True), 1):
        up, own = out[y - 1], out[y]
        if kind == 0:
            own[step:] = row
        elif kind == 1:
            own[step:] = np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            own[step:] = row + up[step:]
        elif kind in (3, 4):
            above, line, told = up.tolist(), own.tolist(), row.tolist()
            for x in range(step, len(line)):
                a, b, c = line[x - step], above[x], above[x - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[x] = (told[x - step] + guess) & 255
            own[:] = line
        else:
            raise ValueError(f"filter {kind}")
    return out[1:, step:]


def decode(data: bytes) -> np.ndarray:
    """Height by width by 3 bytes of RGB; alpha is left out."""
    if not data.startswith(SIGNATURE):
        raise ValueError("no PNG")
    head, palette, body = b"", b"", []
    for kind, chunk in _chunks(data):
        if kind == b"IHDR":
            head = chunk
        elif kind == b"PLTE":
            palette = chunk
        elif kind == b"IDAT":
            body.append(chunk)
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlaced or colour not in CHANNELS or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("a kind of PNG that is not read")
    step = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)[: height * (width * step + 1)].reshape(height, width * step + 1)
    pixels = unfiltered(lines[:, 1:], lines[:, 0], step).reshape(height, width, step)
    if colour == 3:
        return np.frombuffer(palette, np.uint8).reshape(-1, 3)[pixels[:, :, 0]]
    return pixels[:, :, :3] if step >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)


def encode(pixels: np.ndarray, kind: int = 0) -> bytes:
    """A PNG of a height by width (by 3 or 4) array of bytes, all rows with one filter (0 to 2)."""
    height, width = pixels.shape[:2]
    rows = pixels.reshape(height, -1)
    step = rows.shape[1] // width
    if kind == 1:
        rows = rows - np.pad(rows, ((0, 0), (step, 0)))[:, :-step]
    elif kind == 2:
        rows = rows - np.pad(rows, ((1, 0), (0, 0)))[:-1]
    body = np.concatenate([np.full((height, 1), kind, np.uint8), rows.astype(np.uint8)], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[step], 0, 0, 0)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def _weights(size: int, new: int) -> np.ndarray:
    """A row a new pixel: triangles as wide as two new pixels, cut at the border."""
    scale = max(1.0, size / new)
    centre = (np.arange(new) + 0.5) * size / new
    w = np.maximum(0, 1 - np.abs(np.arange(size) + 0.5 - centre[:, None]) / scale)
    return w / w.sum(1, keepdims=True)


def downscale(pixels: np.ndarray, most: int = 512) -> np.ndarray:
    """Bilinear, to at most ``most`` pixels a side with the sides' ratio kept; smaller images stay as they are."""
    height, width = pixels.shape[:2]
    if max(height, width) <= most:
        return pixels
    scale = most / max(height, width)
    new_height, new_width = (max(1, round(n * scale)) for n in (height, width))
    told = lambda x: np.floor(np.clip(x, 0, 255) + 0.5).astype(np.uint8)
    across = told(np.einsum("nw,hwc->hnc", _weights(width, new_width), pixels))
    return told(np.einsum("nh,hwc->nwc", _weights(height, new_height), across))


def luminance(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[:, :, k].astype(np.int64) for k in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.uint8)


def measure(data: bytes | None, most: int = 512) -> tuple[float | None, ...]:
    """The four statistics of an image's luminance, or nulls."""
    try:
        return image_statistics(luminance(downscale(decode(data or b""), most)))
    except (ValueError, zlib.error, struct.error, IndexError):
        return (None,) * 4


def score_images(df: DataFrame, content: str = "content", most: int = 512) -> DataFrame:
    """Add ``sharpness``, ``contrast``, ``brightness`` and ``entropy`` of PNG files in a binary column."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATISTICS))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for data in batches:
            yield pd.DataFrame([measure(d, most) for d in data], columns=list(STATISTICS), dtype="float64")

    rows = df.select(F.struct("*").alias("row"), run(F.col(content)).alias("of"))
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in STATISTICS], "of.*")
