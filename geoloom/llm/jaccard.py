"""Jaccard join of documents' word n-grams by a signature tree.

Documents with equal sets collapse to one class, the leaf entries of the tree. A set that links has most of its items in
some other set too; classes of which too many items occur nowhere else get no entry, so that passages which many documents
share do not tie documents together that have little else in common.

The root's children are candidate groups. Sets that link differ in at most d items, so of more than d parts of them one at
least is equal; sets that share no part, nor are tied by others that do, cannot overlap enough, and so every pair of
children of the root is cut off at once, without being listed. Below, each node holds the OR of its sets' bitmaps, their
range of sizes and by how much a size passes its bitmap's bits; a dual traversal goes down, level by level, those pairs of
nodes whose largest possible overlap allows a link. Large groups are cut into blocks of subtrees, whose pairs are tasks: a
first traversal over compact bitmaps alone parts what the root's rule tied together, a second over the items finds links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents
from geoloom.operators.graph import connected, merged
from geoloom.storage import discard, materialize

#: Bytes of text shingled at once; sets, or items of sets, in a block of a candidate group; children of a node.
RUN, BLOCK, BLOCK_ITEMS, FANOUT = 1 << 21, 256, 1 << 20, 8
#: Sets in a block of compact bitmaps.
MAP_BLOCK = 4096
#: Least number of ranges of items: so many that most sets have few items in one, and rows grow with the items.
RANGES = 256
#: Words of bitmaps that are compared at once.
WORDS = 1 << 20
#: Parts beyond those that linked sets may differ in, so that empty parts seldom need a meeting place.
SLACK = 2
#: Up to so many links, of 16 bytes each, are solved for components by one task; more go through rounds first.
FEW_LINKS = 1 << 18
#: Names that stand for sets which need no answer.
NOBODY = (-1, -2)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, 64-bit hash) of each text's distinct n-word shingles, sorted by both.

    Words are what ASCII white space separates, A to Z lower-cased. A text of fewer than n words gives one shingle of
    all its words, one without words none.
    """
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    raw = low[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[1], space.view(np.int8), [1]])))
    starts, ends = edge[::2], edge[1::2]
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    # a word's hash: its bytes, each through a table, times powers of an odd number, from its start
    table = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    word = np.zeros(len(starts), _U)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(min(size.max(initial=0), 32)), side="left")
    for i, k in enumerate(live.tolist()):
        at = order[:k]
        word[at] = word[at] * _U(0x2545F4914F6CDD1D) + table[raw[starts[at] + i]]
    for i in order[: np.searchsorted(-size[order], -32, side="left")].tolist():  # longer words, by a digest
        word[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    word = _mix(word + size.astype(_U))
    count = np.bincount(owner, minlength=len(texts))
    h = word.copy()
    for i in range(1, n):
        h[: len(h) - i] = _mix(h[: len(h) - i] * _U(0x9E3779B97F4A7C15) + word[i:])
    begin = np.cumsum(count) - count
    whole = (np.arange(len(word)) - begin[owner]) <= (count - n)[owner]
    few = np.flatnonzero((count > 0) & (count < n))
    alone = np.zeros(len(few), _U)
    for j, t in enumerate(few.tolist()):
        x = np.zeros(1, _U)
        for w in word[begin[t] : begin[t] + count[t]]:
            x = _mix(x * _U(0x9E3779B97F4A7C15) + w + _U(1))
        alone[j] = (x + _U(int(count[t])))[0]
    doc, h = np.concatenate([owner[whole], few]), np.concatenate([h[whole], alone])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[fresh], h[fresh]


def size_classes(num: int, den: int, largest: int) -> list[tuple[int, int]]:
    """(least, largest) sizes of each class; sets that link are of the same class or of neighbouring ones."""
    out, low = [], 1
    while low <= largest:
        high = low
        for _ in range(3):
            high = max(high, high * den // num)
        out.append((low, high))
        low = high + 1
    return out


def meeting_keys(doc: np.ndarray, h: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(set's number, key): keys such that any two sets that link share one. Sets are given as shingles() gives them."""
    if not len(doc):
        return doc, h
    sizes = np.bincount(doc)
    classes = size_classes(num, den, int(sizes.max()))
    lows, highs = np.array([c[0] for c in classes]), np.array([c[1] for c in classes])
    own = np.searchsorted(lows, sizes, side="right") - 1
    out_doc, out_key = [], []
    for shift in (0, 1):
        scheme = own + shift
        nxt = np.append(lows, highs[-1] + 1)[np.maximum(scheme, 0)]
        # the next class too, if a set of it is small enough to link
        uses = (sizes > 0) & ((shift == 0) | (den * sizes >= num * nxt))
        top = np.append(highs, _next_high(int(highs[-1]), num, den))[np.maximum(scheme, 0)]
        parts = 2 * top * (den - num) // (den + num) + 1 + SLACK
        base = np.cumsum(np.where(uses, parts, 0)) - np.where(uses, parts, 0)
        pick = uses[doc]
        d, x = doc[pick], h[pick]
        part = (_mix(x ^ _U(0x5851F42D4C957F2D)) % parts[d].astype(_U)).astype(np.int64)
        slot = base[d] + part
        total = int(np.where(uses, parts, 0).sum())
        sums = np.zeros(total, _U)
        np.add.at(sums, slot, _mix(x + _U(0x14057B7EF767814F)))
        filled = np.bincount(slot, minlength=total) > 0
        who = np.repeat(np.arange(len(sizes)), np.where(uses, parts, 0))
        empty = np.bincount(who[~filled], minlength=len(sizes))
        keep = filled | (empty > SLACK)[who]
        place = (np.arange(total) - base[who]).astype(_U)
        key = _mix(_mix(sums + place * _U(0x9E3779B97F4A7C15)) + scheme[who].astype(_U) * _U(0xD1B54A32D192ED03) + filled)
        out_doc.append(who[keep])
        out_key.append(key[keep])
    return np.concatenate(out_doc), np.concatenate(out_key)


def _next_high(high: int, num: int, den: int) -> int:
    high += 1
    for _ in range(3):
        high = max(high, high * den // num)
    return high


def runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = n = 0
    for i, t in enumerate(texts):
        if i > begin and n + len(t) > RUN:
            yield begin, i
            begin, n = i, 0
        n += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def _set_ids(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and a 64-bit id of each set: the sum of its items' hashes, mixed with its size."""
    sizes, sums = np.bincount(doc, minlength=n), np.zeros(n, _U)
    np.add.at(sums, doc, _mix(h))
    return sizes, _mix(sums + sizes.astype(_U)).view(np.int64)


def bitmaps(doc: np.ndarray, h: np.ndarray, n: int) -> list[bytes]:
    """Each set's bitmap, in which every item sets the bit it hashes to.

    It has 64 bits at least, and the least power of two that is not below twice the set's size. OR of its halves makes a
    bitmap of half the length.
    """
    sizes = np.bincount(doc, minlength=n)
    bits = np.left_shift(1, np.maximum(6, np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64)))
    ends = np.cumsum(bits)
    on = np.zeros(int(bits.sum()), np.uint8)
    on[(ends - bits)[doc] + (_mix(h ^ _U(0x2127599BF4325C37)) & (bits[doc] - 1).astype(_U)).astype(np.int64)] = 1
    packed = np.packbits(on, bitorder="little").tobytes()
    return [packed[(e - b) // 8 : e // 8] for b, e in zip(bits.tolist(), ends.tolist(), strict=True)]


class Tree:
    """A signature tree over sets, in the order given: nodes with the OR of bitmaps, size range and excess.

    A set's excess is by how much its size passes its bitmap's bits. Any set of node x and any of node y share at most
    ``bits(OR_x & OR_y) + min(excess_x, excess_y)`` items. ``rows`` are the sets' numbers.
    """

    def __init__(self, rows: np.ndarray, maps: np.ndarray, size: np.ndarray) -> None:
        self.rows = rows
        excess = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, excess)]
        while len(maps) > 1:
            cut = np.arange(0, len(maps), FANOUT)
            maps = np.bitwise_or.reduceat(maps, cut)
            low, high, excess = np.minimum.reduceat(self.levels[-1][1], cut), np.maximum.reduceat(self.levels[-1][2], cut), np.maximum.reduceat(excess, cut)
            self.levels.append((maps, low, high, excess))

    def level(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.levels[min(i, len(self.levels) - 1)]


def _least(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap with which two sets of so many items together link."""
    return -(-num * total // (num + den))


def traverse(t: Tree, u: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets that sizes and bitmaps allow to link, as numbers of rows of ``t`` and ``u``; with ``t is u`` each once.

    Pairs of nodes go down together from the two roots; those whose largest possible overlap is too small go no further.
    """
    top = max(len(t.levels), len(u.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    most = max(64, WORDS // max(1, t.levels[0][0].shape[1]))
    while stack:
        level, i, j = stack.pop()
        if len(i) > most:
            stack += [(level, i[most:], j[most:])]
            i, j = i[:most], j[:most]
        (mi, li, hi, ei), (mj, lj, hj, ej) = t.level(level), u.level(level)
        keep = (den * hi[i] >= num * lj[j]) & (den * hj[j] >= num * li[i])
        i, j = i[keep], j[keep]
        shared = np.bitwise_count(mi[i] & mj[j]).sum(axis=1, dtype=np.int64) + np.minimum(ei[i], ej[j])
        keep = shared >= _least(li[i] + lj[j], num, den)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if not level:
            if t is u:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield t.rows[i], u.rows[j]
            continue
        i, j = _children(t, level, i, j)
        j, i = _children(u, level, j, i)
        if t is u:
            i, j = i[i <= j], j[i <= j]
        stack.append((level - 1, i, j))


def _children(t: Tree, level: int, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once for every child of its own node; a tree's top stands for itself at levels above it."""
    if level >= len(t.levels):
        return own, other
    n = len(t.levels[level - 1][1])
    kids = own[:, None] * FANOUT + np.arange(FANOUT)[None]
    there = kids < n
    return kids[there], np.repeat(other, there.sum(axis=1))


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def forest(rows: np.ndarray, sizes: np.ndarray, lows: np.ndarray, maps: list[bytes]) -> dict[int, Tree]:
    """A tree for each length of bitmap, in words, over the sets of that length ordered by their least item.

    Sets that are alike mostly share their least item, and so stand in the same nodes, whose bitmaps stay sparse.
    """
    words = np.array([len(m) // 8 for m in maps], np.int64)
    out = {}
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        at = at[np.lexsort((rows[at], sizes[at], lows[at]))]
        out[w] = Tree(rows[at], np.frombuffer(b"".join([maps[k] for k in at.tolist()]), _U).reshape(len(at), w), sizes[at])
    return out


def tree_pairs(one: dict[int, Tree], two: dict[int, Tree], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """traverse() over all trees of two forests that can hold sets which link: within one if both are the same."""
    ratio = 2 * max(1, -(-den // num))
    for w, t in one.items():
        for v, u in two.items():
            if one is two and v < w or max(v, w) > ratio * min(v, w):
                continue
            if v == w:
                yield from traverse(t, u, num, den)
            else:
                low = min(v, w)
                x, y = (x if x.levels[0][0].shape[1] == low else Tree(x.rows, _folded(x.levels[0][0], low), x.levels[0][1]) for x in (t, u))
                yield from traverse(x, y, num, den)


def blockwise(rows: list[tuple]) -> tuple[list[tuple], list[int]]:
    """The rows of a task once each, by set, and where its blocks begin. Rows are (block, set_id, ...), sorted by block."""
    seen, kept, begins, block = set(), [], [], None
    for r in rows:
        if r[1] in seen:
            continue
        seen.add(r[1])
        if r[0] != block:
            block = r[0]
            begins.append(len(kept))
        kept.append(r)
    return kept, begins


def by_task(columns: tuple[str, ...], solve, names: list[str]):
    """Run ``solve`` on each task's rows (of ``columns``). Batches are a partition's rows, sorted by task and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []

        def out(found: list[tuple[int, ...]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(len(names))], names)

        for b in batches:
            done = []
            for t, *row in zip(b.column("task").to_pylist(), *(b.column(c).to_pylist() for c in columns), strict=True):
                if t != task:
                    done += solve(rows)
                    task, rows = t, []
                rows.append(tuple(row))
            yield out(done)
        yield out(solve(rows))

    return run


def possible(num: int, den: int):
    """solve() of a task of compact bitmaps: a forest (a, b) over all pairs that the trees leave possible."""

    def solve(rows: list[tuple[str, int, int, int, bytes]]) -> list[tuple[int, int]]:
        rows, begins = blockwise(rows)
        if len(rows) < 2:
            return []
        ids = [r[1] for r in rows]
        sizes, lows = np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        cut = [*begins, len(rows)]
        trees = [forest(np.arange(a, b), sizes[a:b], lows[a:b], [r[4] for r in rows[a:b]]) for a, b in zip(cut, cut[1:])]
        root = np.arange(len(rows))
        for i, j in tree_pairs(trees[0], trees[-1], num, den):
            root = merged(root, i, j)
        return [(ids[r], ids[i]) for i, r in enumerate(root.tolist()) if r != i]

    return solve


def find_links(sets: list[np.ndarray], begins: list[int], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, links) of each set: all pairs that link, within one block or between two.

    The trees leave pairs, and each is compared item by item. Sets are sorted arrays of hashes.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    items = np.concatenate(sets)
    maps = bitmaps(owner, items, n)
    lows = np.array([s[0] for s in sets], _U).view(np.int64)
    names, places = np.unique(items, return_inverse=True)
    own = np.split(places, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(names), bool)
    cut = [*begins, n]
    trees = [forest(np.arange(a, b), sizes[a:b], lows[a:b], maps[a:b]) for a, b in zip(cut, cut[1:])]
    root, links = np.arange(n), np.zeros(n, np.int64)
    for left, right in tree_pairs(trees[0], trees[-1], num, den):
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        for begin, end in zip(*_spans(left), strict=True):
            i, js = int(left[begin]), right[begin:end]
            mark[own[i]] = True
            shared = np.add.reduceat(mark[np.concatenate([own[j] for j in js.tolist()])], np.cumsum(sizes[js]) - sizes[js], dtype=np.int64)
            mark[own[i]] = False
            js = js[den * shared >= num * (sizes[i] + sizes[js] - shared)]
            links[i] += len(js)
            links[js] += 1
            root = merged(root, np.full(len(js), i), js)
    return root, links


def linked(n: int, num: int, den: int):
    """solve() of a task of texts: (root, set, links) of each set that links to another of the task."""

    def solve(rows: list[tuple[str, int, bytes]]) -> list[tuple[int, int, int]]:
        rows, begins = blockwise(rows)
        if len(rows) < 2:
            return []
        ids, sets = [r[1] for r in rows], []
        for begin, end in runs([r[2] or b"" for r in rows]):
            doc, h = shingles([r[2] or b"" for r in rows[begin:end]], n)
            sets += np.split(h, np.cumsum(np.bincount(doc, minlength=end - begin))[:-1])
        root, links = find_links(sets, begins, num, den)
        return [(ids[r], ids[i], k) for i, (r, k) in enumerate(zip(root.tolist(), links.tolist(), strict=True)) if k]

    return solve


def _per_print(num: int, den: int) -> int:
    """One item of so many, chosen by hash, is looked up in other sets: twice as many as two linked sets may differ in."""
    return max(1, den // (2 * (den - num)))


def prints(doc: np.ndarray, h: np.ndarray, ids: np.ndarray, every: int, ranges: int) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """(chosen items of each set, those of them that other sets here have too, the rest as blobs by range of hashes).

    A blob lists sets, how many items of each follow, and 32 bits of each item. An item that several sets here have is
    sent once, for two sets without a row, so that no item sends more rows than there are runs of texts.
    """
    x = _mix(h ^ _U(0x6A09E667F3BCC909))
    pick = (x % _U(every)) == 0
    d, x = doc[pick], x[pick] // _U(every)
    kept = np.bincount(d, minlength=len(ids))
    owner = ids[d]
    order = np.lexsort((owner, x))
    same = np.concatenate([[False], x[order][1:] == x[order][:-1]]) if len(x) else np.zeros(0, bool)
    group = np.cumsum(~same) - 1
    other = same & np.concatenate([[False], owner[order][1:] != owner[order][:-1]]) if len(x) else same
    several = np.bincount(group[other], minlength=int(group[-1]) + 1 if len(group) else 0) > 0
    known = np.zeros(len(x), bool)
    known[order] = several[group]
    here = np.bincount(d[known], minlength=len(ids))
    once = x[order][~same][several]
    owner = np.concatenate([owner[~known], np.full(len(once), NOBODY[0]), np.full(len(once), NOBODY[1])])
    x = np.concatenate([x[~known], once, once])
    part = (x % _U(ranges)).astype(np.int64)
    bits = (x // _U(ranges)).astype(np.uint32)
    order = np.lexsort((owner, part))
    part, owner, bits = part[order], owner[order], bits[order]
    blobs = []
    for begin, end in zip(*_spans(part), strict=True):
        first, last = _spans(owner[begin:end])
        n = -(-(last - first) // 255)  # a name is repeated where its items pass what a byte counts
        counts = np.full(int(n.sum()), 255)
        counts[np.cumsum(n) - 1] = last - first - 255 * (n - 1)
        blobs.append({"range": int(part[begin]), "ids": np.repeat(owner[begin:end][first], n).tobytes(), "counts": counts.astype(np.uint8).tobytes(), "items": bits[begin:end].tobytes()})
    return kept, here, blobs


def _spans(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal values."""
    cut = np.flatnonzero(x[1:] != x[:-1]) + 1
    edges = np.concatenate([[0], cut, [len(x)]]) if len(x) else np.zeros(1, np.int64)
    return edges[:-1], edges[1:]


def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_id, n): chosen items of each set that some other set has too. Batches are a partition's blobs, sorted by range."""

    def count(blobs: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        owner = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.uint8)) for i, c, _ in blobs] or [np.zeros(0, np.int64)])
        item = np.concatenate([np.frombuffer(x, np.uint32) for _, _, x in blobs] or [np.zeros(0, np.uint32)])
        order = np.lexsort((owner, item))
        owner, item = owner[order], item[order]
        fresh = np.ones(len(item), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (owner[1:] != owner[:-1])
        owner, item = owner[fresh], item[fresh]
        again = np.zeros(len(item), bool)
        again[1:] = item[1:] == item[:-1]
        again[:-1] |= again[1:]
        found, n = np.unique(owner[again], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["set_id", "n"])

    now, blobs = None, []
    for b in batches:
        for r, *blob in zip(*(b.column(c).to_pylist() for c in ("range", "ids", "counts", "items")), strict=True):
            if r != now:
                yield count(blobs)
                now, blobs = r, []
            blobs.append(blob)
    yield count(blobs)


def describe(n: int, num: int, den: int, ranges: int):
    """First pass over all texts: each one's set by name and size, and what tells whether its items occur elsewhere."""
    blob = pa.list_(pa.struct([("range", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("items", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column("raw").to_pylist()]
            for begin, end in runs(texts):
                doc, h = shingles(texts[begin:end], n)
                sizes, ids = _set_ids(doc, h, end - begin)
                kept, here, blobs = prints(doc, h, ids, _per_print(num, den), ranges)
                rows = end - begin
                sent = pa.array([blobs, *[None] * (rows - 1)], blob)
                same = [b.column(c).slice(begin, rows) for c in ("doc_id", "digest")]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(sizes.astype(np.int64)), pa.array(ids), pa.array(kept.astype(np.int64)), pa.array(here.astype(np.int64)), sent],
                    ["doc_id", "digest", "n_shingles", "set_id", "kept", "here", "prints"],
                )

    return run


ENTRY = "set_id long, n_shingles long, low long, map binary, keys array<long>, raw binary"


def enter(n: int, num: int, den: int):
    """Second pass, over texts of classes that may link: the tree's entries, each with its bitmap, keys and text.

    A row whose text has another set than its class is left out: its id and digest stand for several texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts, wanted = [t or b"" for t in b.column("raw").to_pylist()], b.column("set_id").to_pylist()
            for begin, end in runs(texts):
                doc, h = shingles(texts[begin:end], n)
                sizes, ids = _set_ids(doc, h, end - begin)
                at = []
                for k, s in enumerate(ids.tolist()):
                    if s == wanted[begin + k] and s not in seen:
                        seen.add(s)
                        at.append(k)
                who, keys = meeting_keys(doc, h, num, den)
                order = np.argsort(who, kind="stable")
                ends = np.cumsum(np.bincount(who, minlength=end - begin))
                parts = np.split(keys[order].view(np.int64), ends[:-1])
                maps, first = bitmaps(doc, h, end - begin), np.cumsum(sizes) - sizes
                low = [int(h[first[k]].view(np.int64)) for k in at]
                cols = [pa.array(ids[at]), pa.array(sizes[at].astype(np.int64)), pa.array(low, pa.int64()), pa.array([maps[k] for k in at], pa.binary()), pa.array([parts[k] for k in at], pa.list_(pa.int64())), pa.array([texts[begin + k] for k in at], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["set_id", "n_shingles", "low", "map", "keys", "raw"])

    return run


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that share a key, as links to the least of them. Batches hold whole partitions of keys, sorted by key then set.

    The last key's least set is carried from batch to batch, so that a key of any size needs no memory.
    """
    last_key = last_hub = None
    for b in batches:
        key, s = b.column("key").to_numpy(), b.column("set_id").to_numpy()
        if not len(key):
            continue
        first = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        hub = s[at]
        if last_key is not None and key[0] == last_key:
            hub[key == last_key] = last_hub
        last_key, last_hub = key[-1], hub[-1]
        keep = hub != s
        pair = np.unique(np.stack([hub[keep], s[keep]]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])


def _tasks(members: DataFrame, block: int, num: int, den: int) -> DataFrame:
    """``members`` (set_id, root, n_shingles) once for each task they take part in, with ``task`` and ``block``.

    A group of up to ``block`` sets (and their items) is one task of one block. A larger one is cut by size, in bands as
    wide as a link allows, and within a band by hash; each block, and each two blocks whose bands are near enough, are a
    task.
    """
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(den / num) + 1e-9))
    members = members.withColumn("band", band)
    items = block * (BLOCK_ITEMS // BLOCK)
    cells = members.groupBy("root", "band").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("items"))
    cells = cells.withColumn("parts", F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("items") / items)))
    small = cells.groupBy("root").agg(((F.sum("c") <= block) & (F.sum("items") <= items)).alias("whole"))
    near = cells.join(small, "root").alias("x").join(cells.select("root", F.col("band").alias("other"), F.col("parts").alias("other_parts")).alias("y"), "root").where("NOT whole AND abs(band - other) <= 1")
    near = near.groupBy("root", "band").agg(F.first("parts").alias("parts"), F.collect_list(F.struct("other", "other_parts")).alias("others"))
    plan = members.join(near, ["root", "band"], "left")
    mine = F.pmod(F.xxhash64("set_id"), F.col("parts"))
    where = lambda b1, p1, b2, p2: F.when((b1 < b2) | ((b1 == b2) & (p1 <= p2)), F.concat_ws(":", F.col("root"), b1, p1, b2, p2)).otherwise(F.concat_ws(":", F.col("root"), b2, p2, b1, p1))
    tasks = F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0).cast("long"), o["other_parts"] - 1), lambda p: where(F.col("band"), mine, o["other"], p))))
    return plan.withColumn("block", F.when(F.col("parts").isNull(), "").otherwise(F.concat_ws(":", "band", mine))).withColumn("task", F.explode(F.coalesce(tasks, F.array(F.col("root").cast("string"))))).select("set_id", "task", "block")


def _class() -> list:
    """How a class is told from its rows: the least id, null last, and of equals the least digest."""
    return [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("_rep"), F.min("n_shingles").alias("n_shingles")]


#: Up to so many classes or ids, of at most 40 bytes each, are broadcast to the documents; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def near_duplicates(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each row doc_id, n_shingles, component_id, class_id and n_links; sets link if ``den * shared >= num * union``.

    component_id is the least doc_id reachable by links, class_id the least with an equal set, and n_links the number of
    other classes that the row's links to. ``n`` and ``num / den`` are the words of a shingle and the similarity; 5 and 0.8
    unless a contract says otherwise. Sets are compared exactly (items by 64-bit hashes). Null and empty texts have no
    shingle and link with nothing: both ids are their own doc_id. Equal texts share a class; rows that repeat repeat; a
    null doc_id takes part, but gives no component its id unless all of it are null. An empty table gives no rows. Columns
    other than doc_id and text are left aside.

    Of all documents ids and a part of the items at 32 bits are shuffled. Texts are read once more by the classes that may
    link, which are broadcast up to BROADCAST_IDS and joined by a shuffle beyond; only those texts are kept, and sent to
    tasks. Tasks hold at most two blocks of BLOCK sets or BLOCK_ITEMS items, or of one larger set.
    """
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("raw")).withColumn("digest", F.xxhash64("raw"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blobs = "prints array<struct<range:int,ids:binary,counts:binary,items:binary>>"
    described = materialize(raw.mapInArrow(describe(n, num, den, max(RANGES, 4 * parts)), f"doc_id long, digest long, n_shingles long, set_id long, kept long, here long, {blobs}"), "sets")
    rows = materialize(described.select("doc_id", "n_shingles", "set_id"), "rows")
    classes = described.where("n_shingles > 0").groupBy("set_id").agg(*_class(), F.min("kept").alias("kept"), F.max("here").alias("here"))
    sent = described.where("prints IS NOT NULL").select(F.explode("prints").alias("p")).select("p.*")
    shared = sent.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(elsewhere, "set_id long, n long").groupBy("set_id").agg(F.sum("n").alias("n"))
    # of a set that links, at most n_shingles - ceil(num / den * n_shingles) items are in no other set
    own = F.col("kept") - F.col("here") - F.coalesce("n", F.lit(0))
    meeting = classes.join(shared, "set_id", "left").where(den * own <= (den - num) * F.col("n_shingles"))
    meeting = materialize(meeting.select("set_id", F.col("_rep.doc_id").alias("rep"), F.col("_rep.digest").alias("rep_digest")), "meeting")
    discard(described)
    few = meeting.count() <= BROADCAST_IDS
    texts = raw.join(F.broadcast(meeting) if few else meeting, (F.col("digest") == F.col("rep_digest")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    entries = materialize(texts.select("set_id", "raw").mapInArrow(enter(n, num, den), ENTRY), "entries")

    met = entries.select("set_id", F.explode("keys").alias("key")).repartition(parts, "key").sortWithinPartitions("key", "set_id").mapInArrow(meet, "a long, b long")
    group = materialize(connected(met, FEW_LINKS), "groups")
    sized = group.join(entries.select("set_id", "n_shingles").distinct(), F.col("node") == F.col("set_id")).select("set_id", "root", "n_shingles")
    large = sized.groupBy("root").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("items")).where((F.col("c") > BLOCK) | (F.col("items") > BLOCK_ITEMS)).select("root")
    maps = _tasks(sized.join(large, "root", "left_semi"), MAP_BLOCK, num, den).join(entries.select("set_id", "n_shingles", "low", "map"), "set_id")
    maps = maps.repartition(4 * parts, "task").sortWithinPartitions("task", "block")
    tied = connected(maps.mapInArrow(by_task(("block", "set_id", "n_shingles", "low", "map"), possible(num, den), ["a", "b"]), "a long, b long"), FEW_LINKS)
    again = tied.join(sized.drop("root"), F.col("node") == F.col("set_id")).select("set_id", "root", "n_shingles")
    members = materialize(sized.join(large, "root", "left_anti").unionByName(again), "members")

    work = _tasks(members, BLOCK, num, den).join(entries.select("set_id", "raw"), "set_id")
    work = work.repartition(4 * parts, "task").sortWithinPartitions("task", "block")
    found = materialize(work.mapInArrow(by_task(("block", "set_id", "raw"), linked(n, num, den), ["a", "b", "links"]), "a long, b long, links long"), "found")
    discard(entries, meeting, group, members)
    root = connected(found.select("a", "b"), FEW_LINKS).withColumnRenamed("node", "set_id").join(found.groupBy(F.col("b").alias("set_id")).agg(F.sum("links").alias("links")), "set_id")
    classes = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("class_id"))
    labelled = classes.join(root, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = labelled.groupBy("root").agg(F.min("class_id").alias("component_id"))
    label = labelled.join(least, "root").select("set_id", "component_id", "class_id", "links")
    out, any_ = rows.join(label, "set_id", "left"), F.col("n_shingles") > 0
    return out.select("doc_id", "n_shingles", *[F.when(any_, F.col(c)).otherwise(F.col("doc_id")).alias(c) for c in ("component_id", "class_id")], F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` without those that a smaller doc_id represents: of each component of near_duplicates() one id stays.

    Rows of the same doc_id are one document and stay together; rows with a null doc_id stay; an empty table stays empty.
    """
    found = near_duplicates(docs, n, num, den)
    gone = materialize(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), n=3, num=90, den=100)


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS items FROM d),
k AS (SELECT doc_id, len(items) AS n, CASE WHEN len(items) > 0 THEN min(doc_id) OVER (PARTITION BY items) ELSE doc_id END AS class_id FROM s),
c AS (SELECT s.doc_id AS class_id, k.n, unnest(s.items) AS item FROM s JOIN k USING (doc_id) WHERE k.class_id = s.doc_id),
l AS (
  SELECT a.class_id AS a, b.class_id AS b FROM c a JOIN c b ON a.item = b.item AND a.class_id <> b.class_id AND a.n * 100 >= b.n * 90 AND b.n * 100 >= a.n * 90
  GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, CAST(coalesce(root.component_id, k.class_id) AS BIGINT) AS component_id,
  CAST(k.class_id AS BIGINT) AS class_id, CAST(coalesce(links.n_links, 0) AS BIGINT) AS n_links
FROM k LEFT JOIN root ON root.a = k.class_id LEFT JOIN links ON links.a = k.class_id
"""
