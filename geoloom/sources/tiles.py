"""Vector tiles and the archives that hold them: features in tile units and degrees, directories, and covering tiles."""

from __future__ import annotations

import gzip
import math
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.arrow import with_arrow
from geoloom.sources.protobuf import as_double, as_float, fields, packed, signed, unzigzag, varint, write, write_varint, zigzag

KINDS = {1: "point", 2: "line", 3: "polygon"}


def read_commands(values: list[int]) -> list[list[tuple[int, int]]]:
    """The parts that a geometry's commands draw, in tile units: each begins with a move; closing repeats its first point."""
    parts: list[list[tuple[int, int]]] = []
    x = y = i = 0
    while i < len(values):
        command, count = values[i] & 7, values[i] >> 3
        i += 1
        if command == 7:
            if parts and parts[-1]:
                parts[-1].append(parts[-1][0])
            continue
        if command not in (1, 2):
            raise ValueError(f"no geometry command {command}")
        for _ in range(count):
            if i + 1 >= len(values):
                raise ValueError("a geometry ends within a command")
            x, y, i = x + unzigzag(values[i]), y + unzigzag(values[i + 1]), i + 2
            if command == 1:
                parts.append([])
            parts[-1].append((x, y))
    return parts


def write_commands(parts: list[list[tuple[int, int]]], close: bool = False) -> list[int]:
    out, x, y = [], 0, 0
    for part in parts:
        for k, (px, py) in enumerate(part):
            if k < 2:
                out.append(1 | 1 << 3 if k == 0 else 2 | (len(part) - 1) << 3)
            out += [zigzag(px - x), zigzag(py - y)]
            x, y = px, py
        if close:
            out.append(7 | 1 << 3)
    return out


def _value(data: bytes) -> str | None:
    for number, kind, v in fields(data):
        if number == 1:
            return v.decode("utf-8", "replace")
        if number in (2, 3):
            return repr(as_float(v) if number == 2 else as_double(v))
        if number in (4, 5, 6):
            return str(signed(v) if number == 4 else v if number == 5 else unzigzag(v))
        if number == 7:
            return "true" if v else "false"
    return None


def decode_tile(data: bytes) -> list[dict]:
    """Features of a vector tile, gzipped or not: layer, extent, id, kind, properties as text, parts in tile units."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    out = []
    for number, _, layer in fields(data):
        if number != 3:
            continue
        name, extent, keys, values, raw = "", 4096, [], [], []
        for n, _, v in fields(layer):
            if n == 1:
                name = v.decode("utf-8", "replace")
            elif n == 2:
                raw.append(v)
            elif n == 3:
                keys.append(v.decode("utf-8", "replace"))
            elif n == 4:
                values.append(_value(v))
            elif n == 5:
                extent = v
        for feature in raw:
            f = {"layer": name, "extent": extent, "id": None, "kind": None, "properties": {}, "parts": []}
            tags, geometry = [], []
            for n, _, v in fields(feature):
                if n == 1:
                    f["id"] = signed(v)
                elif n == 2:
                    tags += packed(v)
                elif n == 3:
                    f["kind"] = KINDS.get(v)
                elif n == 4:
                    geometry += packed(v)
            for k, v in zip(tags[::2], tags[1::2]):
                if k < len(keys) and v < len(values):
                    f["properties"][keys[k]] = values[v]
            f["parts"] = read_commands(geometry)
            out.append(f)
    return out


def encode_tile(layer: str, features: list[dict], extent: int = 4096) -> bytes:
    """A tile of one layer: features with id, kind, properties (text, number or bool) and parts in tile units."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body = b""
    for f in features:
        tags = []
        for k, v in f.get("properties", {}).items():
            raw = write(7, int(v)) if isinstance(v, bool) else write(6, zigzag(v)) if isinstance(v, int) else write(3 if isinstance(v, float) else 1, v)
            tags += [keys.setdefault(k, len(keys)), values.setdefault(raw, len(values))]
        kind = {v: k for k, v in KINDS.items()}[f["kind"]]
        parts = f["parts"]
        if kind == 1:
            flat = [p for part in parts for p in part]
            commands = write_commands([[p] for p in flat])
        else:
            commands = write_commands([p[:-1] if kind == 3 else p for p in parts], kind == 3)
        body += write(2, write(1, f.get("id")) + write(2, b"".join(map(write_varint, tags))) + write(3, kind) + write(4, b"".join(map(write_varint, commands))))
    head = write(15, 2) + write(1, layer)
    tail = b"".join(write(3, k) for k in keys) + b"".join(write(4, v) for v in values) + write(5, extent)
    return write(3, head + body + tail)


FEATURE = "layer string, extent int, id bigint, kind string, properties map<string,string>, parts array<array<struct<x:bigint,y:bigint>>>"


def read_tiles(tiles: DataFrame, column: str = "content") -> DataFrame:
    """One row for each feature of the vector tiles in ``column``, and ``error``; other columns stay.

    A tile that cannot be read gives one row with its error; a null or empty one none.
    """
    names = ("layer", "extent", "id", "kind", "properties", "parts")

    def decode(values: list[bytes | None]) -> list[tuple]:
        out = []
        for v in values:
            try:
                rows = [{**f, "properties": list(f["properties"].items()), "parts": [[{"x": x, "y": y} for x, y in p] for p in f["parts"]]} for f in decode_tile(v or b"")]
                out.append(([tuple(r[n] for n in names) for r in rows], None))
            except (ValueError, OSError, EOFError, AttributeError, TypeError) as e:
                out.append(([(None,) * len(names)], str(e)))
        return out

    kind = "array<struct<layer:string,extent:int,id:bigint,kind:string,properties:map<string,string>,parts:array<array<struct<x:bigint,y:bigint>>>>>"
    d = with_arrow(tiles, F.col(f"`{column}`").cast("binary"), [("_features", kind), ("error", "string")], decode)
    kept = [F.col(f"`{c}`") for c in d.columns if c not in ("_features", column)]
    return d.select(*kept, F.explode("_features").alias("_f")).select(*kept, "_f.*")


def to_degrees(z, x, y, parts, extent):
    """``parts`` of tile (z, x, y) as arrays of (lon, lat), as a column."""
    n = F.pow(F.lit(2.0), z)
    lon = lambda p: (x + p["x"] / extent) / n * 360 - 180
    lat = lambda p: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - (y + p["y"] / extent) / n * 2))))
    return F.transform(parts, lambda part: F.transform(part, lambda p: F.struct(lon(p).alias("lon"), lat(p).alias("lat"))))


def inflate(data: bytes, code: int) -> bytes:
    """Data by an archive's code: 0 and 1 as it is, 2 gzip, 4 zstd; a missing library or another code is an error."""
    if code in (0, 1):
        return data
    if code == 2:
        return gzip.decompress(data)
    if code == 4:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"no way to inflate code {code}")


def inflate_any(data: bytes) -> bytes:
    """Data as its first bytes tell: gzip, zlib or zstd; else raw deflate if it is that, or as it stands."""
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return inflate(data, 4)
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        try:
            d = zlib.decompressobj(bits)
            out = d.decompress(data)
            if d.eof:
                return out
        except zlib.error:
            pass
    return data


HEADER = struct.Struct("<7sB11Q6B4iB2i")
HEADER_NAMES = ("magic", "version", "root_offset", "root_bytes", "metadata_offset", "metadata_bytes", "leaves_offset", "leaves_bytes", "tiles_offset", "tiles_bytes", "addressed", "entries", "contents", "clustered", "directory_code", "tile_code", "tile_type", "min_zoom", "max_zoom", "west_e7", "south_e7", "east_e7", "north_e7", "centre_zoom", "centre_lon_e7", "centre_lat_e7")


def read_header(data: bytes) -> dict:
    """The 127 bytes at an archive's start."""
    if len(data) < HEADER.size or data[:7] != b"PMTiles" or data[7] != 3:
        raise ValueError("not an archive of version 3")
    return dict(zip(HEADER_NAMES, HEADER.unpack_from(data), strict=True))


def decode_directory(data: bytes) -> list[tuple[int, int, int, int]]:
    """(tile_id, offset, length, run_length) of a directory, which stores each column by itself; run 0 points to a leaf."""
    n, at = varint(data, 0)
    columns = []
    for _ in range(4):
        column = []
        for _ in range(n):
            v, at = varint(data, at)
            column.append(v)
        columns.append(column)
    out, tile, end = [], 0, 0
    for step, run, length, place in zip(*columns, strict=True):
        tile += step
        offset = end if place == 0 else place - 1
        out.append((tile, offset, length, run))
        end = offset + length
    return out


def encode_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    ids = [e[0] for e in entries]
    steps = [b - a for a, b in zip([0, *ids], ids)]
    places = [0 if i and o == entries[i - 1][1] + entries[i - 1][2] else o + 1 for i, (_, o, _, _) in enumerate(entries)]
    columns = [steps, [e[3] for e in entries], [e[2] for e in entries], places]
    return write_varint(len(entries)) + b"".join(write_varint(v) for c in columns for v in c)


def find_entry(entries: list[tuple[int, int, int, int]], tile: int) -> tuple[int, int, int, int] | None:
    """The entry that holds a tile, or the leaf that would."""
    import bisect

    at = bisect.bisect_right(entries, tile, key=lambda e: e[0]) - 1
    if at >= 0 and (entries[at][3] == 0 or tile < entries[at][0] + entries[at][3]):
        return entries[at]
    return None


def read_archive(data: bytes, wanted: list[int] | None = None, depth: int = 4) -> list[tuple[int, bytes]]:
    """(tile_id, inflated tile) of an archive's bytes: all tiles, or those of ``wanted``; directories nest up to ``depth``."""
    h = read_header(data)
    out = []

    def walk(at: int, size: int, left: int) -> None:
        if left == 0:
            raise ValueError("directories nest too deep")
        for tile, offset, length, run in decode_directory(inflate(data[at : at + size], h["directory_code"])):
            if run == 0:
                walk(h["leaves_offset"] + offset, length, left - 1)
                continue
            ids = range(tile, tile + run) if wanted is None else [t for t in wanted if tile <= t < tile + run]
            body = inflate(data[h["tiles_offset"] + offset : h["tiles_offset"] + offset + length], h["tile_code"]) if len(ids) else b""
            out.extend((t, body) for t in ids)

    walk(h["root_offset"], h["root_bytes"], depth)
    return out


def tiles_covering(boxes: DataFrame, zoom: int) -> DataFrame:
    """``boxes`` (west, south, east, north) once for each tile (z, x, y) that they touch."""
    from geoloom.functions import geo

    x0, y0 = geo.tile(F.col("west"), F.col("north"), zoom)
    x1, y1 = geo.tile(F.col("east"), F.col("south"), zoom)
    wide = boxes.withColumn("z", F.lit(zoom)).withColumn("x", F.explode(F.sequence(x0, x1)))
    return wide.withColumn("y", F.explode(F.sequence(y0, y1)))


def distinct_features(features: DataFrame) -> DataFrame:
    """Features that tiles cut and so repeat, once by layer and id; those without an id (null or 0) all stay."""
    known = F.coalesce("id", F.lit(0)) != 0
    return features.where(known).dropDuplicates(["layer", "id"]).unionByName(features.where(~known))
