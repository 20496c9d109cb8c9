"""Trip updates of realtime transit feeds: one row for each stop, or for each trip that names none."""

from __future__ import annotations

import gzip

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.arrow import with_arrow
from geoloom.sources.protobuf import fields, signed, write

UPDATE = (
    "entity_id string, is_deleted boolean, trip_id string, route_id string, direction_id int, trip_timestamp bigint, trip_delay int, trip_relationship int, "
    "ord int, stop_sequence int, stop_id string, arrival_delay int, arrival_time bigint, departure_delay int, departure_time bigint, relationship int"
)
NAMES = tuple(x.split()[0] for x in UPDATE.split(", "))


def _scalars(data: bytes, names: dict[int, str]) -> dict:
    out = {}
    for number, kind, value in fields(data):
        if number in names:
            out[names[number]] = value.decode("utf-8", "replace") if isinstance(value, bytes) else signed(value)
    return out


def _event(data: bytes, lead: str) -> dict:
    return _scalars(data, {1: f"{lead}_delay", 2: f"{lead}_time"})


def decode_updates(data: bytes) -> tuple[int | None, list[dict]]:
    """(feed's timestamp, rows) of a feed message, gzipped or not. Entities without a trip update give a row only if deleted."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    stamp, rows = None, []
    for number, _, value in fields(data):
        if number == 1:
            stamp = _scalars(value, {3: "t"}).get("t")
        elif number == 2:
            entity, stops, found = {"is_deleted": False}, [], False
            for n, _, v in fields(value):
                if n == 1:
                    entity["entity_id"] = v.decode("utf-8", "replace")
                elif n == 2:
                    entity["is_deleted"] = bool(v)
                elif n == 3:
                    found = True
                    for m, _, w in fields(v):
                        if m == 1:
                            entity |= _scalars(w, {1: "trip_id", 4: "trip_relationship", 5: "route_id", 6: "direction_id"})
                        elif m == 2:
                            stop = _scalars(w, {1: "stop_sequence", 4: "stop_id", 5: "relationship"})
                            for k, _, x in fields(w):
                                if k in (2, 3):
                                    stop |= _event(x, "arrival" if k == 2 else "departure")
                            stops.append(stop)
                        elif m in (4, 5):
                            entity["trip_timestamp" if m == 4 else "trip_delay"] = signed(w)
            if found or entity["is_deleted"]:
                rows += [entity | s | {"ord": i} for i, s in enumerate(stops or [{}])]
    return stamp, rows


def encode_updates(stamp: int, entities: list[dict]) -> bytes:
    """A feed message of entities (as rows of decode_updates(), ``stops`` a list of theirs)."""
    out = write(1, write(1, "2.0") + write(3, stamp))
    for e in entities:
        trip = write(1, e.get("trip_id")) + write(4, e.get("trip_relationship")) + write(5, e.get("route_id")) + write(6, e.get("direction_id"))
        update = write(1, trip)
        for s in e.get("stops", ()):
            times = b"".join(write(n, body) for n, lead in ((2, "arrival"), (3, "departure")) if (body := write(1, s.get(f"{lead}_delay")) + write(2, s.get(f"{lead}_time"))))
            update += write(2, write(1, s.get("stop_sequence")) + times + write(4, s.get("stop_id")) + write(5, s.get("relationship")))
        update += write(4, e.get("trip_timestamp")) + write(5, e.get("trip_delay"))
        out += write(2, write(1, str(e["entity_id"])) + write(2, int(e["is_deleted"]) if e.get("is_deleted") else None) + write(3, update))
    return out


def read_updates(feeds: DataFrame, column: str = "content") -> DataFrame:
    """Rows of the feeds in ``column``, with ``feed_timestamp`` and ``error``; other columns stay.

    A message that cannot be read gives one row with its error and nothing else; a null one, or one without updates, none.
    """

    def decode(values: list[bytes | None]) -> list[tuple]:
        out = []
        for v in values:
            try:
                stamp, rows = decode_updates(v) if v is not None else (None, [])
                out.append((stamp, [tuple(r.get(n) for n in NAMES) for r in rows], None))
            except (ValueError, OSError, EOFError) as e:
                out.append((None, [(None,) * len(NAMES)], str(e)))
        return out

    d = with_arrow(feeds, F.col(f"`{column}`").cast("binary"), [("feed_timestamp", "bigint"), ("_updates", f"array<struct<{UPDATE.replace(' ', ':').replace(',:', ',')}>>"), ("error", "string")], decode)
    kept = [F.col(f"`{c}`") for c in d.columns if c not in ("_updates", column)]
    return d.select(*kept, F.explode("_updates").alias("_u")).select(*kept, "_u.*")
