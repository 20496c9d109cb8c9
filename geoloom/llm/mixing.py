"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import WORD, documents
from geoloom.operators.prefix import prefix_sums
from geoloom.storage import discard, materialize

#: Quality weights lie between these; the ratio bounds how unevenly the exponential keys fill the sampler's cells.
LOW, HIGH = 0.5, 2.0
#: Tables of sources up to so many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Runs of symbols and digits, which lower a document's quality weight.
NOISE = r"[#*$%&|<>!0-9]++"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Per source: ``source_size`` and ``target``, the share of all sizes that its weight gives it.

    Sources rank by code point with null last and take ``weights`` in turn. No target exceeds ``max_epochs`` times its
    source's size; what is cut off is reshared by weight. The level at which that settles is found in closed form, over
    sources in the order in which they reach their limit.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    every = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every).cast("double")
    capped = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (total - capped) / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("_level", level)
    s = s.withColumn("_settled", F.first(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")), ignorenulls=True).over(every))
    return s.select("source", "source_size", F.least(F.col("_cap"), F.col("_settled") * F.col("_w")).alias("target"))


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` joined to a stored or small table of one row for each source, null among them."""
    n, chars = sources.agg(F.count("*"), F.sum(F.octet_length(F.coalesce("source", F.lit(""))))).first()
    sources = sources.withColumnRenamed("source", "_source")
    few = n * 128 + (chars or 0) <= BROADCAST_BYTES
    return rows.join(F.broadcast(sources) if few else sources, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _position() -> Column:
    """The place of a document's exponential key among its source's, in [0, 1)."""
    return F.lit(1.0) - F.pow(F.col("u"), F.lit(LOW) / F.col("weight"))


def _decided(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """``sizes`` with source_size, target, _pos, _epochs and _extra, whether the fraction takes the row."""
    rows = sizes.count()
    keyed = prefix_sums(sizes.withColumn("_pos", _position()), ["source"], "_pos", ["doc_id", "size", "u"], "size", rows, "_before")
    j = _with_sources(keyed, source_targets(sizes, weights, max_epochs))
    j = j.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    left = F.col("target") - F.col("_epochs") * F.col("source_size")
    return j.withColumn("_extra", F.when(F.col("size") > 0, (F.col("_before") * 2 + F.col("size") <= left * 2).cast("long")).otherwise(F.lit(0)))


def mix(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Decide how often each document of ``sizes`` (doc_id, source, size, u, weight) goes into the mix.

    A source takes as many complete epochs as its target holds, then a fraction of one: its documents in the order of
    their exponential keys, as long as the middle of a document lies within what is left. With ``u`` uniform in (0, 1)
    and ``weight`` between LOW and HIGH, the order by ``-ln(u) / weight`` is that of ``1 - u ** (LOW / weight)``,
    which lies in [0, 1) and serves as the position for the prefix sums.

    Adds source_size, target, copies and taken. Null sources form a source of their own; size 0 takes nothing; rows
    that repeat count each time; an empty table gives no rows.
    """
    j = _decided(sizes, weights, max_epochs).withColumn("copies", F.col("_epochs") + F.col("_extra"))
    return j.withColumn("taken", F.col("size") * F.col("copies")).drop("_pos", "_before", "_epochs", "_extra")


def document_digest():
    """A number in (0, 1) that depends on the id and the text."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5e0) / F.lit(float(2**52))


def _measures() -> list[Column]:
    """size (words; null text 0), u in (0, 1) from a digest of id and text, and the quality weight.

    The weight falls from HIGH to LOW with the number of runs of symbols or digits for each word.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    share = F.when(size > 0, F.greatest(F.lit(0.0), F.lit(1.0) - F.regexp_count(text, F.lit(NOISE)) / size)).otherwise(F.lit(0.0))
    return [size.alias("size"), document_digest().alias("u"), (F.lit(LOW) + F.lit(HIGH - LOW) * share).alias("weight")]


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, and each document's size, u and quality weight."""
    return docs.select("doc_id", "source", *_measures())


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as mix() decides, rows taken not at all left out.

    What a fraction takes is a source's documents up to one place in the order of their keys, so each source needs its
    epochs and that place only; they are joined by source, and each row decides for itself: no text is shuffled. Where rows
    that equal each other in source, id and text stand at that place and only some are taken, those rows are numbered, and
    only they. Null sources form a source of their own; documents without words come with complete epochs only; an empty
    table stays empty.
    """
    sizes = materialize(document_sizes(docs), "mixing-sizes")
    key = ["_pos", "doc_id", "size", "u"]
    equal = _decided(sizes, weights, max_epochs).groupBy("source", *key).agg(F.count("*").alias("n"), F.sum("_extra").alias("m"), F.first("_epochs").alias("_epochs"))
    last = F.max(F.when(F.col("m") > 0, F.struct(F.struct(*key).alias("key"), "m", "n")))
    cuts = materialize(equal.groupBy("source").agg(F.first("_epochs").alias("_epochs"), last.alias("_last")), "mixing-cuts")
    discard(sizes)
    rows = docs.select("doc_id", "source", *_measures(), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = _with_sources(rows.withColumn("_pos", _position()), cuts).withColumn("_key", F.struct(*key))
    border = (F.col("_key") == F.col("_last.key")) & (F.col("_last.m") < F.col("_last.n"))
    split = not cuts.where("_last.m < _last.n").isEmpty()
    extra = F.coalesce(((F.col("size") > 0) & (F.col("_key") <= F.col("_last.key")) & ~border).cast("long"), F.lit(0))
    out = rows.withColumn("_copies", F.col("_epochs") + extra).select("_row", "_copies")
    if split:
        equal = materialize(rows.where(border).select("source", "_row", "_epochs", F.col("_last.m").alias("_m"), F.lit(1).cast("long").alias("_one"), F.rand(7).alias("_r")), "mixing-border")
        equal = prefix_sums(equal, ["source"], "_r", [], "_one", equal.count(), "_rank")
        more = equal.select("_row", (F.col("_epochs") + (F.col("_rank") < F.col("_m")).cast("long")).alias("_copies"))
        out = rows.where(~F.coalesce(border, F.lit(False))).withColumn("_copies", F.col("_epochs") + extra).select("_row", "_copies").unionByName(more)
    return out.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(materialize(document_sizes(documents(spark, sf_dir)), "mixing-sizes"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>!0-9]+')) AS noise FROM documents),
k AS (
  SELECT doc_id, source, CAST(size AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text), 1, 13) AS BIGINT) AS DOUBLE) + 0.5e0) / 4503599627370496e0 AS u,
    0.5e0 + 1.5e0 * CASE WHEN size > 0 THEN greatest(0e0, 1e0 - CAST(noise AS DOUBLE) / CAST(size AS DOUBLE)) ELSE 0e0 END AS weight FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, cap / weight AS ratio,
    (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT l.source, l.source_size,
    least(l.cap, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * l.weight) AS target FROM l),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY 1e0 - pow(k.u, 0.5e0 / k.weight), k.doc_id, k.size, k.u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN size > 0 AND before * 2 + size <= (target - epochs * source_size) * 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""
