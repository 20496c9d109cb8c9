"""Token counts attributed to sections by offset, and the byte-level BPE encoder."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents


#: A run of white space of so many characters is more than the pattern's matcher has stack for.
LONG_SPACE = 1 << 15
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class Encoder:
    """text -> ids as little-endian unsigned 32-bit integers, by a byte-level BPE rank file; none are put around the text.

    With ``added`` (literal -> id) texts are split at those literals first, each of which is one token. The ids then equal
    those that the ``tokenizers`` file of the same vocabulary gives as it is loaded, which tests hold it against. Inside
    a white-space run of LONG_SPACE or more, whose last character may go with what follows, all but that one are
    encoded by themselves: the pattern makes them one piece.
    """

    def __init__(self, path: str, added: dict[str, int] | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.added = dict(added or {})
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v not in self.added.values()}, special_tokens=self.added)
        self.single = encoding._encode_single_piece
        self.plain, self.split = encoding.encode_ordinary, partial(encoding.encode, allowed_special="all")
        #: Bytes of each token.
        self.lengths = np.zeros(max(*ranks.values(), *self.added.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        for literal, i in self.added.items():
            self.lengths[i] = len(literal.encode())

    def __call__(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for m in _SPACES.finditer(text) if len(text) >= LONG_SPACE else ():
            if m.end() - m.start() >= LONG_SPACE:
                stop = m.end() - (m.end() < len(text) and not text.startswith(tuple(self.added), m.end()))
                parts += [self._short(text[at : m.start()]), self._piece(text[m.start() : stop])]
                at = stop
        return np.concatenate([*parts, self._short(text[at:])])

    def _short(self, text: str) -> np.ndarray:
        return np.array((self.split if any(x in text for x in self.added) else self.plain)(text), "<u4")

    def _piece(self, text: str) -> np.ndarray:
        return np.array(self.single(text.encode()), "<u4")


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file, all of which must be plain literals: matched anywhere, as they stand."""
    with open(path, encoding="utf-8") as f:
        listed = json.load(f)["added_tokens"]
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in listed):
        raise ValueError(f"an added token of {path} is more than a literal")
    return {x["content"]: x["id"] for x in listed}


def default_added() -> dict[str, int]:
    """Those of byte_bpe_50k.json, whose vocabulary the default rank file holds."""
    import public_tokenizers

    return added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def section_starts(raw: bytes) -> np.ndarray:
    """Byte offsets at which sections start: the text's start and what follows each run of line feeds."""
    b = np.frombuffer(raw, np.uint8) == 10
    return np.concatenate([[0], np.flatnonzero(b[:-1] & ~b[1:]) + 1]).astype(np.int64) if len(b) else np.zeros(1, np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of those reach over its end.

    Token i covers bytes [ends[i-1], ends[i]). A token that crosses a boundary belongs to the section that holds most
    of its bytes, and of equals to the first. ``starts`` are sorted and begin with 0; ``size`` is the text's length.
    """
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first, last = np.searchsorted(starts, begins, side="right") - 1, np.searchsorted(starts, ends - 1, side="right") - 1
    owner = first.copy()
    stops = np.append(starts[1:], size)
    crossing = np.flatnonzero(first != last)
    for i in crossing.tolist():
        held = [min(ends[i], stops[k]) - max(begins[i], starts[k]) for k in range(first[i], last[i] + 1)]
        owner[i] = first[i] + int(np.argmax(held))
    n = len(starts)
    return np.bincount(owner, minlength=n), np.bincount(owner[crossing], minlength=n)


COUNT_SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def count_batches(tokenizer: str, added: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer, added)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                raw = text.encode()
                starts = section_starts(raw)
                counts, crossing = attribute(np.cumsum(encode.lengths[encode(text)]), starts, len(raw))
                # characters before each byte offset, for offsets in code points
                chars = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])
                at = chars[np.append(starts, len(raw))]
                for col, x in zip(cols, ([doc_id] * len(starts), range(len(starts)), at[:-1], at[1:], counts, crossing), strict=True):
                    col.extend(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in COUNT_SCHEMA.split(", ")])

    return run


def count_tokens(docs: DataFrame, tokenizer: str | None = None, added: dict[str, int] | None = None) -> DataFrame:
    """One row per section of each document: its span in code points, its tokens, and those that cross its end or start.

    A document is encoded whole and once, so a section's count is what it adds to the document's, not what it would
    have alone. ``added``: the literals that are one token each; those of byte_bpe_50k.json if None. Null and empty texts have one empty section with no token; rows that repeat repeat.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return docs.select("doc_id", "text").mapInArrow(count_batches(tokenizer, default_added() if added is None else added), COUNT_SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
