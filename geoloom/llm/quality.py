"""Document quality by a linear-chain conditional random field that labels lines good or bad."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents
from geoloom.llm.crf import Adam, forward_backward

#: Training takes at most so many labelled documents, by hash, of at most so many characters.
TRAIN_DOCS, TRAIN_CHARS = 4_000, 50_000
#: Characters handled at once; a longer text is handled alone.
BLOCK = 1 << 20
PREDICT_AT = 0.3
_CLASSES = 7
_OWN = _CLASSES + 10


@cache
def _classes() -> np.ndarray:
    """By code point: 0 lower case or uncased letter, 1 upper case, 2 digit, 3 white space, 4 sentence mark, 5 symbol, 6 other."""
    out = np.full(0x110000, 6, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = 1 if c.isupper() else 0
        elif c.isdigit():
            out[i] = 2
        elif c.isspace():
            out[i] = 3
    for c in ".,;:?'\"()-":
        out[ord(c)] = 4
    for c in "#*$%&|<>!@^~=+_{}[]\\/":
        out[ord(c)] = 5
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines of each text, their lengths, features): of each line its own, its predecessor's and its successor's.

    Own features: shares of the character classes, length, words, mean word length, words that end with a symbol or
    begin with a capital, the last character's class, whether it is blank, equals an earlier line of the text, and its
    shares of repeated words. Lines are what line feeds separate, so an empty text has one.
    """
    raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = _classes()[raw]
    stops = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], stops[:-1] + 1])
    size = stops - starts
    per_text = np.array([t.count("\n") + 1 for t in texts])
    n = len(starts)
    line = np.repeat(np.arange(n), size + 1)
    own = np.zeros((n, _OWN), np.float32)
    safe = np.maximum(size, 1)
    inside = raw != 10
    for k in range(_CLASSES):
        own[:, k] = np.bincount(line, weights=(cls == k) & inside, minlength=n) / safe
    space = cls == 3
    first = ~space & np.concatenate([[True], space[:-1]])
    last = ~space & np.concatenate([space[1:], [True]])
    nw = np.bincount(line, weights=first, minlength=n)
    sw = np.maximum(nw, 1)
    own[:, _CLASSES] = np.log1p(size) / 5
    own[:, _CLASSES + 1] = np.log1p(nw) / 4
    own[:, _CLASSES + 2] = (size - np.bincount(line, weights=space & inside, minlength=n)) / sw / 10
    own[:, _CLASSES + 3] = np.bincount(line, weights=last & (cls == 5), minlength=n) / sw
    own[:, _CLASSES + 4] = np.bincount(line, weights=first & (cls == 1), minlength=n) / sw
    own[:, _CLASSES + 5] = (cls[np.maximum(stops - 1, 0)] == 4) & (size > 0)
    own[:, _CLASSES + 6] = nw == 0
    # hashes of words and lines by sums of code points times powers of an odd number
    at = np.arange(len(raw)) - starts[line]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        h = (raw.astype(np.uint64) + np.uint64(0x51ED)) * power[at]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h)])
        whole = sums[stops] - sums[starts]
        ws, we = np.flatnonzero(first), np.flatnonzero(last)
        letters = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ (raw.astype(np.uint64) << np.uint64(17)))])
        word = letters[we + 1] - letters[ws]
    text_of = np.repeat(np.arange(len(texts)), per_text)
    order = np.lexsort((np.arange(n), whole, text_of))
    dup = np.zeros(n, bool)
    dup[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
    own[:, _CLASSES + 7] = dup & (nw > 0)
    wl = line[ws]
    order = np.lexsort((word, wl))
    again = np.zeros(len(word), bool)
    again[1:] = (word[order][1:] == word[order][:-1]) & (wl[order][1:] == wl[order][:-1])
    own[:, _CLASSES + 8] = np.bincount(wl[order], weights=again, minlength=n) / sw
    own[:, _CLASSES + 9] = 1
    begin = np.zeros(n, bool)
    begin[np.cumsum(per_text) - per_text] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[begin] = 0
    after[np.roll(begin, -1)] = 0
    return per_text, size, np.concatenate([own, before, after], axis=1)


class Model:
    """Weights of a good line against a bad one, transitions, and the calibration of a document's mean."""

    def __init__(self) -> None:
        self.weights, self.trans = np.zeros(3 * _OWN, np.float32), np.zeros((2, 2), np.float32)
        self.slope, self.bias = 1.0, 0.0

    def marginals(self, f: np.ndarray, lengths: np.ndarray, counts: bool = False) -> tuple[np.ndarray, np.ndarray]:
        s = f @ self.weights
        return forward_backward(np.stack([np.zeros_like(s), s], axis=1), lengths, self.trans, counts)

    def means(self, texts: list[str]) -> np.ndarray:
        """Mean marginal of good lines, each line with its length and one more as weight."""
        per_text, size, f = line_features(texts)
        gamma, _ = self.marginals(f, per_text)
        owner = np.repeat(np.arange(len(texts)), per_text)
        return np.bincount(owner, weights=gamma[:, 1] * (size + 1)) / np.bincount(owner, weights=size + 1.0)

    def scores(self, texts: list[str]) -> np.ndarray:
        m = np.clip(self.means(texts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(m / (1 - m)) + self.bias, -30, 30)))


    def runs(self, texts: list[str], size: int = BLOCK // 4) -> Iterator[list[str]]:
        """``texts`` in runs of at most ``size`` characters, or of one text."""
        begin = 0
        while begin < len(texts):
            end, n = begin, 0
            while end < len(texts) and (end == begin or n + len(texts[end]) <= size):
                n += len(texts[end])
                end += 1
            yield texts[begin:end]
            begin = end

    def score_all(self, texts: list[str]) -> np.ndarray:
        """Scores of any number of texts, about BLOCK characters at once, rounded to 6 places."""
        scores = [np.zeros(0), *map(self.scores, self.runs(texts, BLOCK))]
        return np.round(np.concatenate(scores), 6)


def train(texts: list[str], labels: list[int], rounds: int = 60) -> Model:
    """Fit by the likelihood of every line having its document's label, documents weighing alike; then calibrate.

    The calibration is a logistic curve over the log odds of the mean, fitted to the documents' labels with a slight
    pull towards no change. Without texts of both labels the model scores every text 0.5.
    """
    model = Model()
    if len(set(labels)) < 2:
        return model
    y = np.array(labels)
    # features of a run at a time, as the characters of all texts at once would take too much of the driver's memory
    found = [(x[0], x[2]) for x in map(line_features, model.runs(texts))]
    per_text, f = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    line_y = np.repeat(y, per_text)
    weight = np.repeat(1 / per_text, per_text)[:, None]
    inside = np.ones(len(line_y), bool)
    inside[np.cumsum(per_text) - per_text] = False
    j = np.flatnonzero(inside)
    pairs = np.bincount(line_y[j - 1] * 2 + line_y[j], minlength=4).reshape(2, 2)
    opt = Adam([model.weights, model.trans], 0.2)
    for _ in range(rounds):
        gamma, expected = model.marginals(f, per_text, counts=True)
        g = (line_y - gamma[:, 1])[:, None] * weight
        opt.step([((f * g).sum(axis=0) / len(texts) - 1e-4 * model.weights).astype(np.float32), ((pairs - expected) / max(1, len(j)) - 1e-2 * model.trans).astype(np.float32)])
    m = np.clip(np.concatenate([model.means(r) for r in model.runs(texts)]), 1e-6, 1 - 1e-6)
    x = np.stack([np.log(m / (1 - m)), np.ones(len(m))], axis=1)
    a = np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        a += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (y - p) - (a - [1.0, 0.0]))
    model.slope, model.bias = float(a[0]), float(a[1])
    return model


def score_batches(model: Model, at: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            s = model.score_all(texts)
            keep = [b.column(c) for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(s, pa.float64()), pa.array((s >= at).astype(np.int32), pa.int32())], [*[c for c in b.schema.names if c != "text"], "score", "predicted"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, own, limit: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``limit`` labelled documents that meet ``own``, by hash of the id.

    Only the chosen ids, a bounded number, are broadcast to the documents.
    """
    ids = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(own).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    # a margin of ids, as some of their texts are null or longer than ``chars``
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * limit).withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").where(F.length("text") <= chars).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_label").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(limit).collect()
    return [r[1] for r in rows], [int(r[2]) for r in rows]


def held(doc_id):
    """Whether a document is held out: crc32 of its id as text leaves no rest by 5. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def classify(docs: DataFrame, model: Model, at: float = PREDICT_AT) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text; null text counts as empty, rows that repeat repeat."""
    d = docs.select("doc_id", held(F.col("doc_id")).alias("held_out"), "text")
    return d.mapInArrow(score_batches(model, at), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, at: float = PREDICT_AT) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``at`` or more. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score_all([t or "" for t in b.column("text").to_pylist()]) >= at))

    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]  # any name may be in use, dots too
    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*training_sample(docs, labels, ~held(F.col("doc_id"))))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return classify(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
