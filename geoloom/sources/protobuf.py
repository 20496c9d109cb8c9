"""Reading and writing protobuf messages field by field, without their schema."""

from __future__ import annotations

import struct
from collections.abc import Iterator


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next offset) of the varint at ``at``; a value beyond 64 bits or the data's end raises ValueError."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a varint does not end")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & (1 << 64) - 1, at


def signed(value: int) -> int:
    """A varint's value as int32 or int64, which are both written in 64 bits."""
    return value - (1 << 64) if value >> 63 else value


def unzigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) in order: an int for varints and fixed numbers, bytes for what has a length.

    Group markers, which nothing here uses, are passed over with what is between them.
    """
    at = depth = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            if at + size > len(data):
                raise ValueError("a field passes the end of its message")
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        elif kind == 2:
            size, at = varint(data, at)
            if at + size > len(data):
                raise ValueError("a field passes the end of its message")
            value, at = data[at : at + size], at + size
        elif kind in (3, 4):
            depth += 1 if kind == 3 else -1
            continue
        else:
            raise ValueError(f"no wire type {kind}")
        if not depth:
            yield number, kind, value


def packed(value: int | bytes) -> list[int]:
    """A repeated varint field's values, packed or not."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        v, at = varint(value, at)
        out.append(v)
    return out


def as_double(value: int) -> float:
    return struct.unpack("<d", value.to_bytes(8, "little"))[0]


def as_float(value: int) -> float:
    return struct.unpack("<f", value.to_bytes(4, "little"))[0]


def write_varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def zigzag(value: int) -> int:
    return (value << 1) ^ (value >> 63)


def write(number: int, value: int | bytes | str | float | None) -> bytes:
    """A field: varint for ints and booleans, double for floats, else with its length; null writes nothing."""
    if value is None:
        return b""
    if isinstance(value, float):
        return write_varint(number << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, int):
        return write_varint(number << 3) + write_varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return write_varint(number << 3 | 2) + write_varint(len(raw)) + raw
