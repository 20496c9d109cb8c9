"""Pieces the corpus operators share: word patterns, prefix sums and array idioms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]++"

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, even where the body's lambdas use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def running_sums(values: Column) -> Column:
    """Inclusive running sums of an array, in blocks, so that the work grows with n times the square root of n at most."""
    step = 256
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    after = lambda block, base: F.aggregate(block, F.array(base), grow)

    def of(arr: Column) -> Column:
        last = F.floor((F.size(arr) - 1) / F.lit(step)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(arr, b * step + 1, step))

        def joined(bs: Column) -> Column:
            sums = F.transform(bs, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x))
            return F.flatten(F.zip_with(bs, after(sums, F.lit(0).cast("long")), lambda b, base: F.when(b.isNotNull(), F.slice(after(b, base), 2, step)).otherwise(F.array().cast("array<bigint>"))))

        return let(blocks, joined)

    return let(values.cast("array<bigint>"), lambda arr: F.when(F.size(arr) > 0, of(arr)).otherwise(F.array().cast("array<bigint>")))
