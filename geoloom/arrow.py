"""Columns made in Python, a batch of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

#: Values are made into Python objects for so many bytes of a batch at a time, or one larger value.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows that start every SLICE_BYTES of ``column``; lists and records count by their mean size."""
    values = batch.column(column)
    if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type) or pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        sizes = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        sizes = np.full(len(values), values.nbytes // max(1, len(values)), np.int64)
    before = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    ends = [0, *(np.flatnonzero(np.diff(before)) + 1).tolist(), len(values)]
    for a, b in zip(ends, ends[1:]):
        yield batch.slice(a, b - a)


def with_arrow(df: DataFrame, value: Column, added: list[tuple[str, str]], make: Callable[[list], list[tuple]]) -> DataFrame:
    """``df`` and the columns ``added`` (name, type): a tuple of them for each value, made a slice of a batch at a time.

    Columns of ``df`` pass through whatever their names are; one of the same name as an added column is replaced.
    """
    kept = [c for c in df.columns if c not in {n for n, _ in added}]
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], value.alias("value"))
    out = StructType(plain.schema.fields[:-1] + [StructField(f"a{i}", DataType.fromDDL(t)) for i, (_, t) in enumerate(added)])
    types = [to_arrow_type(f.dataType) for f in out.fields[len(kept) :]]

    def run(batches):
        for b in (s for batch in batches for s in slices(batch, len(kept))):
            rows = make(b.column(len(kept)).to_pylist())
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], out.names)

    return plain.mapInArrow(run, out).toDF(*kept, *[n for n, _ in added])
