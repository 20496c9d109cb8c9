"""Elevation rasters: PNG images whose colours are heights, their samples and bilinear grids."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.arrow import with_arrow

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def decode_png(data: bytes) -> np.ndarray:
    """Rows by columns by channels of an 8-bit RGB or RGBA image without interlace."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, body, size = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if len(chunk) < n:
            raise ValueError("a chunk passes the end of the image")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", chunk)
            if depth != 8 or colour not in (2, 6) or interlace:
                raise ValueError("only 8-bit RGB and RGBA without interlace")
            size = (height, width, 3 if colour == 2 else 4)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
        at += 12 + n
    if size is None:
        raise ValueError("an image without a header")
    height, width, channels = size
    stride = width * channels
    raw = np.frombuffer(zlib.decompress(body), np.uint8)
    if len(raw) < height * (stride + 1):
        raise ValueError("an image without all of its rows")
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        kind, line = raw[y * (stride + 1)], raw[y * (stride + 1) + 1 : (y + 1) * (stride + 1)]
        up = out[y]
        if kind == 0:
            row = line
        elif kind == 2:
            row = line + up
        elif kind == 1:
            row = np.cumsum(line.reshape(width, channels), axis=0, dtype=np.uint8).reshape(-1)
        elif kind in (3, 4):
            row = _predicted(line, up, channels, kind)
        else:
            raise ValueError(f"no filter {kind}")
        out[y + 1] = row
    return out[1:].reshape(height, width, channels)


def _predicted(line: np.ndarray, up: np.ndarray, channels: int, kind: int) -> np.ndarray:
    """A row whose filter looks at the sample before: the mean of left and up, or the nearest of left, up and corner."""
    row, above, zero = [0] * len(line), up.tolist(), [0] * channels
    left = zero + row
    corner = zero + above
    for i, v in enumerate(line.tolist()):
        a, b, c = left[i], above[i], corner[i]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            p = a + b - c
            da, db, dc = abs(p - a), abs(p - b), abs(p - c)
            guess = a if da <= db and da <= dc else b if db <= dc else c
        left[i + channels] = row[i] = (v + guess) & 255
    return np.array(row, np.uint8)


def encode_png(pixels: np.ndarray, filters: int = 0) -> bytes:
    """An image of rows by columns by channels, every row by filter 0 or 2 (differences from the row above)."""
    height, width, channels = pixels.shape
    rows = pixels.reshape(height, -1).astype(np.uint8)
    lines = rows - np.vstack([np.zeros_like(rows[:1]), rows[:-1]]) if filters == 2 else rows
    raw = np.hstack([np.full((height, 1), filters, np.uint8), lines]).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 6, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def heights(pixels: np.ndarray) -> np.ndarray:
    """Metres of a Terrarium image's colours."""
    p = pixels.astype(np.float64)
    return p[:, :, 0] * 256 + p[:, :, 1] + p[:, :, 2] / 256 - 32768


def colours(metres: np.ndarray) -> np.ndarray:
    v = np.floor((metres + 32768) * 256).astype(np.int64)
    return np.stack([v >> 16 & 255, v >> 8 & 255, v & 255], axis=2).astype(np.uint8)


def resampled(grid: np.ndarray, res: int) -> np.ndarray:
    """``res`` by ``res`` samples over a grid's whole extent, bilinear between its four neighbours."""
    h, w = grid.shape
    y, x = np.linspace(0, h - 1, res), np.linspace(0, w - 1, res)
    y0, x0 = np.minimum(np.floor(y).astype(int), max(h - 2, 0)), np.minimum(np.floor(x).astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    top = grid[np.ix_(y0, x0)] * (1 - fx) + grid[np.ix_(y0, x1)] * fx
    low = grid[np.ix_(y1, x0)] * (1 - fx) + grid[np.ix_(y1, x1)] * fx
    return top * (1 - fy) + low * fy


def read_terrarium(images: DataFrame, column: str = "content", res: int | None = None) -> DataFrame:
    """(x, y, v) samples of the images in ``column``, or of ``res`` by ``res`` grids over them, and ``error``.

    Other columns stay. An image that cannot be read gives one row with its error; a null one none.
    """

    def decode(values: list[bytes | None]) -> list[tuple]:
        out = []
        for v in values:
            try:
                grid = heights(decode_png(v)) if v is not None else np.zeros((0, 0))
                grid = resampled(grid, res) if res and grid.size else grid
                out.append((grid.shape[1], grid.reshape(-1).tolist(), None))
            except (ValueError, struct.error, zlib.error) as e:
                out.append((1, [None], str(e)))
        return out

    d = with_arrow(images, F.col(f"`{column}`").cast("binary"), [("_width", "int"), ("_samples", "array<double>"), ("error", "string")], decode)
    kept = [F.col(f"`{c}`") for c in d.columns if c not in ("_width", "_samples", column)]
    rows = d.select(*kept, "_width", F.posexplode("_samples").alias("_i", "v"))
    return rows.select(*kept, F.pmod("_i", "_width").cast("long").alias("x"), F.floor(F.col("_i") / F.col("_width")).alias("y"), "v")
