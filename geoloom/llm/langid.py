"""Language of the words of a text by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents
from geoloom.llm.crf import Adam, chains, forward_backward

#: Training takes about so many documents of each language, by hash, of at most so many characters.
PER_LANG, TRAIN_CHARS = 200, 20_000
BUCKETS = 1 << 17
#: Characters handled at once; longer texts are cut between words.
BLOCK = 1 << 20
UNKNOWN = "und"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its lower case where that is one code point."""
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        letter[i] = c.isalpha()
        if len(x := c.lower()) == 1:
            lower[i] = ord(x)
    return letter, lower


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def blocks(text: str, size: int = BLOCK) -> list[tuple[int, str]]:
    """(offset, part) of a text, cut between words; a word longer than a block is cut."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and end > at + size // 2 and text[end - 1].isalpha():
            end -= 1
        out.append((at, text[at:end]))
        at = end
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all ``texts``: (text's number, start, end, rows of n-gram features, where each word's begin, word hashes).

    Features of a word: each letter with its neighbours, each pair of letters (word ends are letters of their own),
    and its first and last three letters as affixes.
    """
    letter, lower = _tables()
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], is_letter.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    c = np.where(is_letter, lower[raw], 0).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    cur, left, right = c[at], np.where(at > 0, c[at - 1], 0), c[np.minimum(at + 1, len(c) - 1)]
    tri = _mix(left << np.uint64(42) | cur << np.uint64(21) | right)
    bi = _mix((cur << np.uint64(21) | right) ^ np.uint64(0x9E3779B97F4A7C15))
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    get = lambda i, ok: np.where(ok, c[np.clip(i, 0, len(c) - 1)], 0)
    pre = _mix((get(starts, True) << np.uint64(42) | get(starts + 1, lengths > 1) << np.uint64(21) | get(starts + 2, lengths > 2)) ^ np.uint64(0xD1B54A32D192ED03))
    suf = _mix((get(ends - 3, lengths > 2) << np.uint64(42) | get(ends - 2, lengths > 1) << np.uint64(21) | get(ends - 1, True)) ^ np.uint64(0x8CB92BA72F3D8DD7))
    word = np.bitwise_xor.reduceat(_mix(tri + (np.arange(len(at)) - np.repeat(first, lengths)).astype(np.uint64)), first) if len(at) else tri
    rows = np.empty(2 * len(at) + 2 * len(starts), np.int64)
    begin = 2 * first + 2 * np.arange(len(starts))
    slot = np.repeat(begin + 2, lengths) + 2 * (np.arange(len(at)) - np.repeat(first, lengths))
    mask = np.uint64(BUCKETS - 1)
    rows[slot], rows[slot + 1] = (tri & mask).astype(np.int64), (bi & mask).astype(np.int64)
    rows[begin], rows[begin + 1] = (pre & mask).astype(np.int64), (suf & mask).astype(np.int64)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(bounds, starts, side="right")
    base = np.concatenate([[0], bounds])[owner]
    return owner, starts - base, ends - base, rows, begin, word


class Model:
    """Weights of n-grams and affixes, of words of the lexicon, and of transitions between languages."""

    def __init__(self, labels: list[str]) -> None:
        k = len(labels)
        self.labels, self.lexicon = labels, np.zeros(0, np.uint64)
        self.grams, self.words, self.trans = np.zeros((BUCKETS, k), np.float32), np.zeros((1, k), np.float32), np.zeros((k, k), np.float32)

    def entries(self, word: np.ndarray) -> np.ndarray:
        """A word's place in the lexicon; the last is that of all others."""
        n = len(self.lexicon)
        at = np.searchsorted(self.lexicon, word)
        return np.where((at < n) & (self.lexicon[np.minimum(at, n - 1)] == word), at, n) if n else np.zeros(len(word), np.int64)

    def scores(self, rows: np.ndarray, begin: np.ndarray, entry: np.ndarray) -> np.ndarray:
        sums = np.stack([np.add.reduceat(self.grams[rows, j], begin) for j in range(len(self.labels))], axis=1) if len(begin) else np.zeros((0, len(self.labels)), np.float32)
        return sums + self.words[entry]

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        owner, start, end, rows, begin, word = features(texts)
        lengths = np.bincount(owner, minlength=len(texts))
        gamma, _ = forward_backward(self.scores(rows, begin, self.entries(word)), lengths[lengths > 0], self.trans)
        return owner, start, end, gamma


def train(texts: list[str], langs: list[str], epochs: int = 4, batch: int = 64, seen: int = 3) -> Model:
    """Fit by the likelihood of every word having its document's language, with Adam over batches of documents.

    The lexicon holds words that occur ``seen`` times or more. Sentences end chains here (at 64 words), so that
    transitions are learned from many. No texts give a model without labels.
    """
    model = Model(sorted(set(langs)))
    if not model.labels:
        return model
    order = np.random.default_rng(7).permutation(len(texts))
    texts, gold = [texts[i] for i in order], np.array([model.labels.index(langs[i]) for i in order])
    words, hits = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(texts), batch):
        w, c = np.unique(features(texts[i : i + batch])[5], return_counts=True)
        both, at = np.unique(np.concatenate([words, w]), return_inverse=True)
        words, hits = both, np.bincount(at, weights=np.concatenate([hits, c]), minlength=len(both)).astype(np.int64)
    model.lexicon = words[hits >= seen]
    k = len(model.labels)
    model.words = np.zeros((len(model.lexicon) + 1, k), np.float32)
    opt = Adam([model.grams, model.words, model.trans], 0.05)
    for _ in range(epochs):
        for i in range(0, len(texts), batch):
            owner, _s, _e, rows, begin, word = features(texts[i : i + batch])
            if not len(word):
                continue
            entry, y = model.entries(word), gold[i : i + batch][owner]
            lengths = np.bincount(owner)
            starts, lens = chains(lengths[lengths > 0], 64)
            gamma, expected = forward_backward(model.scores(rows, begin, entry), lens, model.trans, counts=True)
            g = -gamma
            g[np.arange(len(y)), y] += 1
            inside = np.ones(len(y), bool)
            inside[starts] = False
            j = np.flatnonzero(inside)
            seen_pairs = np.bincount(y[j - 1] * k + y[j], minlength=k * k).reshape(k, k)
            each = np.repeat(np.arange(len(word)), np.diff(np.append(begin, len(rows))))
            grad = [np.stack([np.bincount(r, weights=x[:, q], minlength=m) for q in range(k)], axis=1).astype(np.float32) for r, x, m in ((rows, g[each], BUCKETS), (entry, g, len(model.words)))]
            opt.step([(grad[0] - 0.1 * model.grams) / len(y), (grad[1] - 0.1 * model.words) / len(y), ((seen_pairs - expected) / len(y) - 1e-3 * model.trans).astype(np.float32)])
    return model


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, segments array<struct<start:int,end:int,lang:string>>"


def _label(model: Model, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
    """For each text the language of most of its words by summed marginals, its mean marginal, and its runs of one language."""
    k, out = len(model.labels), []
    parts = [(i, off, part) for i, t in enumerate(texts) for off, part in blocks(t or "")]
    sums, segments = np.zeros((len(texts), k)), [[] for _ in texts]
    at = 0
    while at < len(parts) and k:
        stop, n = at, 0
        while stop < len(parts) and (n == 0 or n + len(parts[stop][2]) <= BLOCK):
            n += len(parts[stop][2])
            stop += 1
        run = parts[at:stop]
        at = stop
        owner, start, end, gamma = model.marginals([p for _, _, p in run])
        doc = np.array([i for i, _, _ in run])[owner]
        off = np.array([o for _, o, _ in run])[owner]
        for q in range(k):
            sums[:, q] += np.bincount(doc, weights=gamma[:, q], minlength=len(texts))
        best = gamma.argmax(axis=1) if len(gamma) else np.zeros(0, int)
        change = np.flatnonzero((np.diff(best) != 0) | (np.diff(doc) != 0)) + 1
        first = np.concatenate([[0], change]) if len(best) else change
        last = np.append(change, len(best)) - 1 if len(best) else change
        for d, s, e, q in zip(doc[first].tolist(), (start + off)[first].tolist(), (end + off)[last].tolist(), best[first].tolist(), strict=True):
            mine = segments[d]
            if mine and mine[-1]["lang"] == model.labels[q]:
                mine[-1]["end"] = e
            else:
                mine.append({"start": s, "end": e, "lang": model.labels[q]})
    total = sums.sum(axis=1)
    for i in range(len(texts)):
        if total[i] <= 0:
            out.append((UNKNOWN, 0.0, []))
        else:
            q = int(sums[i].argmax())
            out.append((model.labels[q], min(1.0, float(sums[i, q] / total[i])), segments[i]))
    return out


def label_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _label(model, b.column("text").to_pylist())
            seg = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], seg)], ["doc_id", "held_out", "lang_pred", "score", "segments"])

    return run


def training_sample(docs: DataFrame, per_lang: int = PER_LANG, chars: int = TRAIN_CHARS) -> tuple[list[str], list[str]]:
    """Texts and languages to learn from: about ``per_lang`` rows of each language, by hash of the id.

    Rates follow the counts over all rows, so the sample does not grow with the corpus.
    """
    own = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(F.length("text").between(1, chars))
    counts = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_lang / n))]), F.col("lang"))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = own.where(unit < rate).orderBy(F.xxhash64("doc_id"), "text").limit(2 * per_lang * len(counts)).select("text", "lang").collect()
    return [r[0] for r in rows], [r[1] for r in rows]


def identify(docs: DataFrame, model: Model, held_out) -> DataFrame:
    """Language, score and runs of one language of every whole text.

    Null texts and texts without a letter get ``und``, score 0 and no run; rows that repeat repeat; ``held_out`` is a
    column that only passes through. Texts are handled in blocks of about a million characters.
    """
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(label_batches(model), SCHEMA)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = train(*training_sample(docs.where(~held)))
    out = identify(docs, model, held)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("segments").alias("n_segments"))
