"""The binary document: records of typed fields in sections, compressed and framed, to and from nested columns.

Each kind of field knows its Spark type, how it is read and how it is written; records, lists, options and choices are made
of others, so that the layouts below are the whole format.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable
from typing import Any, NamedTuple

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.arrow import with_arrow

# Fixed values of the format: the first word of document and frame, the frame's mark, its codecs by number, the usual extent.
MAGIC, MARK, CODECS, EXTENT = 0x53435231, 0xA7, ("raw", "gzip", "brotli", "zstd"), 4096
WIDEST = 1 << 30


class Kind(NamedTuple):
    ddl: str
    read: Callable[[Cursor], Any]
    write: Callable[[bytearray, Any], None]


class Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError(f"ends early: {n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        """A magnitude with its sign in the lowest bit, seven bits a byte."""
        x = shift = 0
        while True:
            b = self.take(1)[0]
            x |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return -(x >> 1) if x & 1 else x >> 1
            if shift > 28:
                raise ValueError(f"number too long at {self.at}")

    def count(self) -> int:
        """A number of things to come, each of a byte at least."""
        n = self.number()
        if not 0 <= n <= len(self.data) - self.at:
            raise ValueError(f"ends early: {n} things told at {self.at} of {len(self.data)}")
        return n


def _put(out: bytearray, value: int | None) -> None:
    v = int(value or 0)
    if abs(v) >= WIDEST:
        raise ValueError(f"number out of range: {v}")
    x = abs(v) << 1 | (v < 0)
    while x >= 0x80:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)


def _fixed(ddl: str, form: str, none: Any) -> Kind:
    size = struct.calcsize(form)
    return Kind(ddl, lambda c: struct.unpack(form, c.take(size))[0], lambda out, v: out.extend(struct.pack(form, none if v is None else v)))


def _put_text(out: bytearray, value: str | None) -> None:
    raw = (value or "").encode()
    _put(out, len(raw))
    out.extend(raw)


WHOLE = Kind("bigint", Cursor.number, _put)
WORD, REAL, FLAG = _fixed("bigint", "<I", 0), _fixed("double", "<d", 0.0), _fixed("boolean", "?", False)
TEXT = Kind("string", lambda c: c.take(c.count()).decode(), _put_text)


def record(**fields: Kind) -> Kind:
    def write(out: bytearray, value: dict | None) -> None:
        for name, kind in fields.items():
            kind.write(out, (value or {}).get(name))

    return Kind("struct<" + ",".join(f"{n}:{k.ddl}" for n, k in fields.items()) + ">", lambda c: {n: k.read(c) for n, k in fields.items()}, write)


def many(kind: Kind) -> Kind:
    def write(out: bytearray, values: list | None) -> None:
        _put(out, len(values or []))
        for v in values or []:
            kind.write(out, v)

    return Kind(f"array<{kind.ddl}>", lambda c: [kind.read(c) for _ in range(c.count())], write)


def option(kind: Kind) -> Kind:
    def write(out: bytearray, value: Any) -> None:
        out.append(value is not None)
        if value is not None:
            kind.write(out, value)

    return Kind(kind.ddl, lambda c: kind.read(c) if c.take(1)[0] == 1 else None, write)


def choice(**kinds: Kind) -> Kind:
    """One of ``kinds``, told by its place among them; as a column, its name and a field for each."""
    names = list(kinds)

    def read(c: Cursor) -> dict:
        tag = c.take(1)[0]
        if tag >= len(names):
            raise ValueError(f"unknown choice {tag} at {c.at}")
        return {"is": names[tag], names[tag]: kinds[names[tag]].read(c)}

    def write(out: bytearray, value: dict | None) -> None:
        name = (value or {}).get("is") or names[0]
        if name not in kinds:
            raise ValueError(f"unknown choice {name}")
        out.append(names.index(name))
        kinds[name].write(out, (value or {}).get(name))

    return Kind("struct<is:string," + ",".join(f"{n}:{k.ddl}" for n, k in kinds.items()) + ">", read, write)


def _read_path(c: Cursor) -> list[dict]:
    if not c.take(1)[0]:
        return []
    x = y = 0
    out = []
    for _ in range(c.count()):
        x, y = x + c.number(), y + c.number()
        out.append({"x": x, "y": y})
    return out


def _put_path(out: bytearray, line: list[dict] | None) -> None:
    out.append(bool(line))
    if line:
        _put(out, len(line))
        x = y = 0
        for p in line:
            _put(out, p["x"] - x)
            _put(out, p["y"] - y)
            x, y = p["x"], p["y"]


PLACE = record(x=WHOLE, y=WHOLE)
PATH = Kind(f"array<{PLACE.ddl}>", _read_path, _put_path)
AREA = many(many(PATH))
GEOMETRY = choice(point=record(x=WHOLE, y=WHOLE, z=option(WHOLE)), line=many(PATH), polygon=AREA, building=AREA)
VALUE = choice(ref=WHOLE, num=REAL, bool=FLAG, token=TEXT)
HEAT = choice(
    sparse=many(record(x=WHOLE, y=WHOLE, value=REAL)),
    rle=many(record(y=WHOLE, runs=many(record(x=WHOLE, len=WHOLE, value=REAL)))),
    cell=many(record(cell=TEXT, value=REAL)),
)
HEADER = record(
    version=WORD,
    envelope=choice(tile=record(z=WHOLE, x=WHOLE, y=WHOLE), bbox=record(west=REAL, south=REAL, east=REAL, north=REAL)),
    wgs84=FLAG,
    extent=WHOLE,
    buffer=WHOLE,
)
# The sections by number, in the order in which they are written; those of the first four are known by their id.
SECTIONS: dict[int, tuple[str, Kind]] = {
    2: ("layers", record(id=WHOLE, name=TEXT)),
    3: ("classes", record(id=WHOLE, layer=WHOLE, name=TEXT)),
    4: ("strings", record(id=WHOLE, text=TEXT)),
    5: ("attributes", record(id=WHOLE, props=many(record(key=WHOLE, value=VALUE)))),
    6: ("features", record(id=WHOLE, layer=WHOLE, klass=WHOLE, attributes=WHOLE, geometry=GEOMETRY)),
    7: ("heat", record(id=WHOLE, name=TEXT, resolution=WHOLE, low=REAL, high=REAL, cells=HEAT)),
    8: ("omissions", record(layer=WHOLE, count=WHOLE, centre=option(PLACE), note=option(WHOLE))),
    9: ("refs", record(kind=TEXT, uri=TEXT, mime=option(TEXT), note=option(WHOLE))),
}
KEYED = ("layers", "classes", "strings", "attributes")
DOCUMENT = f"struct<header:{HEADER.ddl}," + ",".join(f"{n}:array<{k.ddl}>" for n, k in SECTIONS.values()) + ">"


def encode(doc: dict) -> bytes:
    """The sections of a document after its header; what has an id as its key goes by it."""
    head = bytearray()
    HEADER.write(head, doc.get("header"))
    out = bytearray(struct.pack("<II", MAGIC, len(head)) + head)
    for number, (name, kind) in SECTIONS.items():
        rows = doc.get(name) or []
        for row in sorted(rows, key=lambda r: r["id"] or 0) if name in KEYED else rows:
            out.append(number)
            kind.write(out, row)
    return bytes(out)


def decode(data: bytes) -> dict:
    """The document of its bytes. Of rows with one id the last counts where the id is the key; an extent of 0 is the usual one."""
    c = Cursor(data)
    magic, length = struct.unpack("<II", c.take(8))
    if magic != MAGIC:
        raise ValueError(f"not a binary document (magic {magic:x})")
    doc: dict[str, Any] = {"header": HEADER.read(Cursor(c.take(length)))} | {n: [] for n, _ in SECTIONS.values()}
    doc["header"]["extent"] = doc["header"]["extent"] or EXTENT
    while c.at < len(data):
        number = c.take(1)[0]
        if number not in SECTIONS:
            raise ValueError(f"unknown section {number}")
        name, kind = SECTIONS[number]
        doc[name].append(kind.read(c))
    for name in KEYED:
        doc[name] = list({r["id"]: r for r in doc[name]}.values())
    return doc


def wrap(body: bytes, codec: str) -> bytes:
    pack = {"raw": lambda b: b, "gzip": lambda b: gzip.compress(b, 9, mtime=0), "zstd": zstandard.ZstdCompressor(level=3).compress}
    if codec not in pack:
        raise ValueError(f"codec {codec} is not available")
    payload = pack[codec](body)
    return struct.pack("<IBBI", MAGIC, MARK, CODECS.index(codec), len(payload)) + payload


def unwrap(frame: bytes) -> bytes:
    if len(frame) < 10:
        raise ValueError("frame too short")
    magic, mark, codec, length = struct.unpack_from("<IBBI", frame)
    if magic != MAGIC or mark != MARK:
        raise ValueError("not a framed document")
    if 10 + length > len(frame):
        raise ValueError(f"frame cut: {length} bytes told, {len(frame) - 10} there")
    payload, name = frame[10 : 10 + length], CODECS[codec] if codec < len(CODECS) else "raw"
    if name == "brotli":
        raise ValueError("codec brotli is not available")
    if name == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(payload)
    return gzip.decompress(payload) if name == "gzip" else payload


FAULTS = (ValueError, KeyError, TypeError, EOFError, OSError, struct.error, zlib.error, zstandard.ZstdError)


def _each(make: Callable[[Any], Any]) -> Callable[[list], list[tuple]]:
    def one(value: Any) -> tuple:
        if value is None:
            return None, None
        try:
            return make(value), None
        except FAULTS as fault:
            return None, str(fault)

    return lambda values: [one(v) for v in values]


def framed(df: DataFrame, document: Column, codec: str = "gzip") -> DataFrame:
    """``df`` with ``frame`` (binary) of a DOCUMENT column, or the ``error`` that kept it from being written.

    Null documents give neither; null lists are empty, null numbers 0, null texts empty; numbers from 2^30 on are an error.
    Empty lines are one byte. The codecs are raw, gzip and zstd.
    """
    if codec not in ("raw", "gzip", "zstd"):
        raise ValueError(f"codec {codec} is not available")
    return with_arrow(df, document.cast(DOCUMENT), [("frame", "binary"), ("error", "string")], _each(lambda d: wrap(encode(d), codec)))


def unframed(df: DataFrame, frame: Column) -> DataFrame:
    """``df`` with the ``document`` of a frame column, or the ``error`` of a frame that cannot be read; null gives neither."""
    return with_arrow(df, frame, [("document", DOCUMENT), ("error", "string")], _each(lambda b: decode(unwrap(bytes(b)))))


def is_frame(data: Column) -> Column:
    """Whether bytes begin as a frame does."""
    return (F.octet_length(data) >= 10) & (F.substring(data, 1, 5) == F.unhex(F.lit(struct.pack("<IB", MAGIC, MARK).hex())))
