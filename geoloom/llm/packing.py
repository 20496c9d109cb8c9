"""Best-fit packing after Martello-Toth dominance reduction, on the histogram of piece lengths."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents
from geoloom.llm.tokens import Encoder, default_added
from geoloom.operators.prefix import prefix_sums
from geoloom.storage import materialize

CAPACITY, END_ID = 1024, 2


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins that Martello and Toth's criterion fixes, as (lengths, how many), and the counts that are left.

    From the longest length down, with k the longest that fits beside it: alone if nothing fits; with k if that fills
    the bin, if only one more fits at all, or if no two that fit together exceed k and no three fit. Any other bin of
    that length is dominated by the fixed one.
    """
    left, fixed = {n: c for n, c in counts.items() if c}, []
    changed = True
    while changed:
        changed = False
        for n in sorted(left, reverse=True):
            while left.get(n):
                others = sorted(x for x in left if x != n or left[n] > 1)
                room = capacity - n
                at = bisect.bisect_right(others, room)
                if not at:
                    fixed.append(((n,), left.pop(n)))
                    changed = True
                    break
                k = others[at - 1]
                small: list[int] = []
                for x in others:
                    small += [x] * min(3 - len(small), left[x] - (x == n))
                    if len(small) >= 3:
                        break
                fits2, fits3 = len(small) > 1 and small[0] + small[1] <= room, len(small) > 2 and sum(small[:3]) <= room
                if n + k != capacity and fits2:
                    if fits3:
                        break
                    best, fit = 0, others[:at]
                    for i, a in enumerate(fit):
                        j = bisect.bisect_right(fit, room - a) - 1
                        while j >= i:
                            if fit[j] != a or left[a] - (a == n) > 1:
                                best = max(best, a + fit[j])
                                break
                            j -= 1
                    if best > k:
                        break
                m = left[n] // 2 if n == k else min(left[n], left[k])
                fixed.append(((n, k), m))
                for x in (n, k):
                    left[x] -= m
                left = {x: c for x, c in left.items() if c}
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing over a histogram: bins as ((length, copies), ...) and how many of each."""
    rooms: dict[int, list] = defaultdict(list)
    order: list[int] = []

    def add(room: int, pattern: tuple, m: int) -> None:
        if not rooms[room]:
            bisect.insort(order, room)
        rooms[room].append((pattern, m))

    for n in sorted(counts, reverse=True):
        c = counts[n]
        while c and (at := bisect.bisect_left(order, n)) < len(order):
            room = order[at]
            pattern, m = rooms[room].pop()
            if not rooms[room]:
                order.pop(at)
            q = min(room // n, max(1, c // m)) if c >= m else 1
            used = min(m, c // q)
            add(room - q * n, (*pattern, (n, q)), used)
            if used < m:
                add(room, pattern, m - used)
            c -= used * q
        q = capacity // n
        if c >= q:
            add(capacity - q * n, ((n, q),), c // q)
        if c % q:
            add(capacity - (c % q) * n, ((n, c % q),), 1)
    return [b for bins in rooms.values() for b in bins]


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Segments (length, first rank, copies a bin, offset, first bin), by length and rank, and the number of bins.

    The piece of ``length`` with rank r in a segment goes to bin ``first bin + (r - first rank) // copies``, at
    ``offset + (r - first rank) % copies * length``. Work and size depend on the number of lengths only.
    """
    fixed, left = reduce_dominated(counts, capacity)
    bins = [(tuple((n, 1) for n in lengths), m) for lengths, m in fixed] + best_fit(left, capacity)
    ranks: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for pattern, m in bins:
        offset = 0
        for n, q in pattern:
            out.append((n, ranks[n], q, offset, base))
            ranks[n] += m * q
            offset += n * q
        base += m
    return sorted(out), base


def pieces_of(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of full length but the first, which takes what is left over."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def cut(capacity: int, end_id: int, tokenizer: str, added: dict[str, int]):
    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, added)
        tail = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), tail])
                raw = ids.tobytes()
                rows += [(doc_id, i, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(pieces_of(len(ids), capacity))]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut_batches


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored ``pieces`` (doc_id, piece, start, length, ids_crc32).

    The driver sees a histogram of at most ``capacity`` lengths. Pieces are numbered within their length by prefix sums
    over a hash, so that a frequent length is dealt over many tasks, and find their segment by binary search.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    rows = sum(counts.values())
    segments, _ = plan_bins(counts, capacity)
    table = np.array(segments, dtype=np.int64).reshape(-1, 5)
    keys = table[:, 0] << 48 | table[:, 1]
    salt = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("_u", F.pmod(salt, F.lit(1 << 40)) / F.lit(float(1 << 40))).withColumn("_one", F.lit(1).cast("long"))
    ranked = prefix_sums(ranked, ["length"], "_u", ["doc_id", "piece", "start", "ids_crc32"], "_one", rows, "_rank").drop("_u", "_one")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            seg = table[np.searchsorted(keys, length << 48 | rank, side="right") - 1] if len(rank) else table[:0]
            within = rank - seg[:, 1]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seg[:, 4] + within // np.maximum(seg[:, 2], 1)), pa.array(seg[:, 3] + within % np.maximum(seg[:, 2], 1) * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, added: dict[str, int] | None = None) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    ``tokenizer``: the rank file of byte_bpe_50k.json's vocabulary; ``added``: the literals that are one token each, those of
    that file if None. Null text is an empty document, which still has its end id; repeated rows are packed each; of pieces
    of one length a hash of the piece tells which comes first, then its id; an empty table gives no piece.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return pack(materialize(docs.select("doc_id", "text").mapInArrow(cut(capacity, end_id, tokenizer, default_added() if added is None else added), schema), "packing-pieces"), capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
