"""MPEG audio columns: write payloads into frames, find frames again, verify them and index them."""

from __future__ import annotations

import struct
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.arrow import with_arrow
from geoloom.llm.common import documents

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version 1?, layer), and Hz by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

#: The writer's frames: MPEG-1 Layer III, 48 kHz, stereo, with checksum; 4 + 2 + 32 bytes precede what a frame carries.
LEAD = 38
SIZES = {i: 3 * kbps for i, kbps in enumerate(BITRATES[True, 3]) if i}
FULL = max(SIZES)


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return table


_TABLE = _crc_table()
_CRCS: dict[bytes, int] = {}


def crc16(data: bytes) -> int:
    """The checksum of an MPEG frame: polynomial 0x8005, start 0xFFFF. Recent arguments are kept, at most 4,096."""
    if (found := _CRCS.get(data)) is not None:
        return found
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _TABLE[(c >> 8) ^ b]
    if len(_CRCS) >= 4096:
        _CRCS.clear()
    _CRCS[data] = c
    return c


def _header(index: int, protected: bool = True) -> bytes:
    return bytes((0xFF, 0xFA if protected else 0xFB, index << 4 | 1 << 2, 0))


def _lead(index: int) -> bytes:
    head, side = _header(index), bytes(32)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


_LEADS = {i: _lead(i) for i in SIZES}


def _syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def write_mpeg(payload: bytes) -> bytes:
    """A variable-bitrate Layer III stream that carries ``payload`` after its frames' empty side information.

    An ID3v2.4 tag holds the payload's length, an information frame the counts and the seek table. Decoders hear
    silence. Full frames come first; the last takes the lowest bitrate that holds the rest.
    """
    body = SIZES[FULL] - LEAD
    full, rest = divmod(len(payload), body)
    frames = [_LEADS[FULL] + payload[i * body : (i + 1) * body] for i in range(full)]
    if rest:
        index = next(i for i, n in SIZES.items() if n - LEAD >= rest)
        frames.append(_LEADS[index] + payload[full * body :] + bytes(SIZES[index] - LEAD - rest))
    text = b"\x00payload\x00" + str(len(payload)).encode()
    tag = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    tag = b"ID3\x04\x00\x00" + _syncsafe(len(tag)) + tag
    total, count = sum(map(len, frames)), len(frames)
    toc = bytes(min(255, (SIZES[FULL] * (count * p // 100)) * 256 // max(1, total)) for p in range(100))
    info = _header(9, protected=False) + bytes(32) + b"Xing" + struct.pack(">III", 7, count, total) + toc
    return tag + info + bytes(SIZES[9] - len(info)) + b"".join(frames)


def frame_header(data: bytes, at: int) -> tuple[int, int, int, int, int, bool] | None:
    """(bytes, samples, Hz, layer, side-information bytes, protected) of the frame header at ``at``, if there is one."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b, c, d = data[at + 1], data[at + 2], data[at + 3]
    version, layer, index, rate = b >> 3 & 3, 4 - (b >> 1 & 3), c >> 4, c >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    one, hz, mono, padding = version == 3, RATES[version][rate], d >> 6 == 3, c >> 1 & 1
    bps = BITRATES[one, layer][index] * 1000
    if layer == 1:
        return (12 * bps // hz + padding) * 4, 384, hz, 1, 0, not b & 1
    samples = 1152 if layer == 2 or one else 576
    side = 0 if layer == 2 else (17 if mono else 32) if one else (9 if mono else 17)
    return samples // 8 * bps // hz + padding, samples, hz, layer, side, not b & 1


def _be(data: bytes, at: int, n: int) -> int:
    """The big-endian number in ``n`` bytes at ``at``; what the data lacks counts as 0."""
    return int.from_bytes(data[at : at + n].ljust(n, b"\0"), "big")


def _read_syncsafe(data: bytes, at: int) -> int:
    b = data[at : at + 4].ljust(4, b"\0")
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def read_tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """Text tags, and where audio begins and ends: ID3v2.2 to 2.4 in front (TXXX by its description), ID3v1 behind."""
    tags, at, end = {}, 0, len(data)
    if data[:3] == b"ID3" and end >= 10 and data[3] in (2, 3, 4):
        version, stop = data[3], min(end, 10 + _read_syncsafe(data, 6))
        at, p = min(end, stop + 10 * bool(data[5] & 16)), 10
        if data[5] & 64 and version > 2:  # an extended header
            p += _read_syncsafe(data, 10) if version == 4 else 4 + _be(data, 10, 4)
        lead, name_len = (6, 3) if version == 2 else (10, 4)
        while p + lead <= stop and data[p]:
            n = _be(data, p + 3, 3) if version == 2 else _read_syncsafe(data, p + 4) if version == 4 else _be(data, p + 4, 4)
            name, body = data[p : p + name_len].decode("latin-1"), data[p + lead : min(stop, p + lead + n)]
            if name[0] == "T" and body:
                text = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
                key, _, value = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
                tags[key] = value.rstrip("\0")
            p += lead + n
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    return tags, at, end


def read_vbr(data: bytes, lead: int, at: int) -> dict | None:
    """The variable-bitrate table of a frame, with what its flags say is there: Xing or Info after the side information
    (at ``lead``), or VBRI 32 bytes behind the frame's header (``at``)."""
    if data[lead : lead + 4] in (b"Xing", b"Info"):
        flags, p, out = _be(data, lead + 4, 4), lead + 8, {"frames": None, "bytes": None, "toc": []}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = _be(data, p, 4), p + 4
        return out | {"toc": list(data[p : p + 100]) if flags & 4 else []}
    if data[at + 36 : at + 40] == b"VBRI":
        p = at + 40
        n, scale, width = _be(data, p + 14, 2), _be(data, p + 16, 2), _be(data, p + 18, 2)
        n = min(n, (len(data) - p - 22) // max(1, width)) if 1 <= width <= 4 else 0
        return {"frames": _be(data, p + 10, 4), "bytes": _be(data, p + 6, 4), "toc": [scale * _be(data, p + 22 + i * width, width) for i in range(n)]}
    return None


def _crc_bits(data: bytes, at: int, n: int, c: int) -> int:
    """The checksum ``c`` after ``n`` more bits, from byte ``at``."""
    for b in data[at : at + n // 8]:
        c = ((c << 8) & 0xFFFF) ^ _TABLE[(c >> 8) ^ b]
    for i in range(n % 8):
        bit = data[at + n // 8] >> (7 - i) & 1
        c = (c << 1 ^ (0x8005 if (c >> 15) ^ bit else 0)) & 0xFFFF
    return c


# Fixed values of the same standards: bits of a subband's allocation in Layer II, as (bits, subbands), by table.
ALLOCATION = {"a": ((4, 11), (3, 12), (2, 4)), "b": ((4, 11), (3, 12), (2, 7)), "c": ((4, 2), (3, 6)), "d": ((4, 2), (3, 10)), "low": ((4, 4), (3, 7), (2, 19))}


def _layer_two_table(one: bool, hz: int, kbps: int) -> str:
    if not one:
        return "low"
    if kbps <= 48:
        return "d" if hz == 32000 else "c"
    return "a" if hz == 48000 or kbps <= 80 else "b"


def checked_bits(data: bytes, at: int) -> int:
    """How many bits after the checksum of the frame at ``at`` the checksum covers, in any layer."""
    _, _, hz, layer, side, _ = frame_header(data, at)
    if layer == 3:
        return 8 * side
    mode, extension = data[at + 3] >> 6, data[at + 3] >> 4 & 3
    channels = 1 if mode == 3 else 2
    bound = 4 + 4 * extension if mode == 1 else 32  # subbands that the channels do not share
    if layer == 1:
        return 4 * (32 if channels == 1 else bound + 32)
    one = data[at + 1] >> 3 & 3 == 3
    kbps = BITRATES[one, 2][data[at + 2] >> 4] // channels
    bands = [bits for bits, n in ALLOCATION[_layer_two_table(one, hz, kbps)] for _ in range(n)]
    start, p, used = (at + 6) * 8, 0, 0
    for sb, bits in enumerate(bands):
        for _ in range(1 if channels == 1 or sb >= bound else 2):
            value = 0
            for i in range(start + p, start + p + bits):
                value = value << 1 | (data[i >> 3] >> (7 - (i & 7)) & 1 if i >> 3 < len(data) else 0)
            # where channels share a subband's allocation, both have scale factors
            used += (value > 0) * (2 if channels == 2 and sb >= bound else 1)
            p += bits
    return p + 2 * used  # and the selection of each scale factor


def checksum_holds(data: bytes, at: int) -> bool:
    """Whether the protected frame at ``at`` has the checksum it names."""
    bits = checked_bits(data, at)
    if bits % 8 == 0:
        c = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + bits // 8])
    else:
        c = _crc_bits(data, at + 6, bits, crc16(data[at + 2 : at + 4]))
    return c == _be(data, at + 4, 2)


def parse_mpeg(data: bytes) -> dict:
    """Tags, frames, checksums, duration and seek offsets of an MPEG audio stream of any layer, from any bytes.

    Bytes that are no frame are skipped until a header that another header (or the end of the data) follows at its
    frame's end. A frame cut off by the end is dropped, one too short for its checksum counts as bad. Empty data gives no
    frames and duration 0.
    """
    tags, at, end = read_tags(data)
    offsets, bodies, vbr, skipped, bad, checked, locked = [], [], None, 0, 0, 0, True
    duration, first, run, run_hz = Fraction(0), True, 0, 0
    while at < end:
        h = frame_header(data, at)
        if h is None or h[0] < 6 or at + h[0] > end or not locked and at + h[0] < end and frame_header(data, at + h[0]) is None:
            nxt = data.find(b"\xff", at + 1, end)
            skipped, at, locked = skipped + (nxt if nxt >= 0 else end) - at, nxt if nxt >= 0 else end, False
            continue
        size, samples, hz, layer, side, protected = h
        locked, lead = True, at + 4 + 2 * protected
        if first and layer == 3:
            vbr = read_vbr(data[: at + size], lead + side, at)
        if not first or vbr is None:
            if protected:
                checked += 1
                bad += checked_bits(data, at) > 8 * (size - 6) or not checksum_holds(data, at)
            offsets.append(at)
            bodies.append((lead + side, at + size))
            if hz != run_hz:
                duration, run, run_hz = duration + (Fraction(run, run_hz) if run_hz else 0), 0, hz
            run += samples
        first, at = False, at + size
    duration += Fraction(run, run_hz) if run_hz else 0
    return {"tags": tags, "vbr": vbr, "offsets": offsets, "bodies": bodies, "skipped": skipped, "checked": checked, "bad": bad, "duration": duration}


def read_payload(data: bytes, parsed: dict | None = None) -> bytes:
    """What write_mpeg() stored; nothing from a stream that it did not write."""
    parsed = parsed or parse_mpeg(data)
    n = parsed["tags"].get("payload", "")
    return b"".join([data[a:b] for a, b in parsed["bodies"]])[: int(n) if n.isdecimal() else 0]


def pad64(raw: bytes) -> bytes:
    """``raw`` and bytes 0 up to a multiple of 64, at least 64."""
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def encode_media(df: DataFrame, column: str = "text", out: str = "media") -> DataFrame:
    """``df`` and ``out``: the bytes of ``column`` (null: none), padded and stored as an MPEG stream. Rows stay as they are."""
    return with_arrow(df, F.col(f"`{column}`").cast("binary"), [(out, "binary")], lambda values: [(write_mpeg(pad64(v or b"")),) for v in values])


INDEX = (
    ("tags", "map<string,string>"),
    ("vbr", "struct<frames:bigint,bytes:bigint,toc:array<bigint>>"),
    ("offsets", "array<bigint>"),
    ("skipped", "bigint"),
    ("checked", "bigint"),
    ("bad", "bigint"),
    ("seconds_num", "bigint"),
    ("seconds_den", "bigint"),
)


def index_media(df: DataFrame, column: str = "media", payload: str | None = None) -> DataFrame:
    """``df`` and what a column of MPEG streams holds: INDEX, and with ``payload`` what write_mpeg() stored, by that name.

    tags; the variable-bitrate table (null without one); the byte offset of each frame; skipped bytes; frames whose checksum
    was checked, and how many of those failed; and the exact duration in seconds as a fraction. Any bytes give a row, null ones as empty
    ones do: no frames and 0 seconds.
    """

    def index(values: list[bytes | None]) -> list[tuple]:
        out = []
        for v in values:
            p = parse_mpeg(v or b"")
            row = (list(p["tags"].items()), p["vbr"], p["offsets"], p["skipped"], p["checked"], p["bad"], p["duration"].numerator, p["duration"].denominator)
            out.append((*row, read_payload(v or b"", p)) if payload else row)
        return out

    return with_arrow(df, F.col(f"`{column}`").cast("binary"), [*INDEX, *([(payload, "binary")] if payload else [])], index)


def media_digests(indexed: DataFrame) -> DataFrame:
    """The digest columns of stored texts, from the columns of encode_media() and index_media()."""
    seek = F.lpad(F.lower(F.hex(F.crc32(F.array_join(F.transform("offsets", lambda o: o.cast("string")), ",").cast("binary")))), 8, "0")
    parts = {"frames": F.size("offsets"), "s": F.concat_ws("/", "seconds_num", "seconds_den"), "checked": F.col("checked"), "bad": F.col("bad"), "skipped": F.col("skipped"), "vbr": F.coalesce(F.col("vbr.frames"), F.lit(0)), "seek": seek}
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()])
    return indexed.select(
        "doc_id",
        F.coalesce(F.length("raw"), F.lit(0)).cast("long").alias("n_bytes"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text counts as empty; equal texts give equal values; rows that repeat repeat."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("raw"))
    return media_digests(index_media(encode_media(docs, "raw"), payload="payload"))
