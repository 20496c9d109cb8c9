"""Quality rules: counts of a whole text, and a hashed n-gram log-likelihood ratio against the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents, let, words
from geoloom.storage import materialize

#: Buckets of the hashed n-grams; the two multinomials have one entry for each.
BUCKETS = 1 << 20
#: So many buckets are packed into one row before all meet in a single one.
PACKED = 1 << 10
#: At most so many trusted documents, those of the least hashed ids, give the target's counts; their ids are broadcast.
TRUSTED = 20_000
#: A document goes if its mean log-likelihood ratio is below this, where labels give no threshold.
THRESHOLD = -0.5
SMOOTHING = 1.0



def ngram_buckets(ws: Column) -> Column:
    """Buckets of a word array's unigrams and bigrams, by xxhash64 with seed 42."""
    uni = F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))
    bi = F.when(F.size(ws) > 1, F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws) - 1), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(uni, bi)


def repeated_words(ws: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in the text."""

    def covered(pos: Column) -> Column:
        gaps = F.zip_with(F.slice(pos, 1, F.size(pos) - 1), F.slice(pos, 2, F.size(pos)), lambda a, b: F.least(F.lit(3), b - a))
        return F.when(F.size(pos) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda a, x: a + x))

    def places(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def of(tri: Column) -> Column:
        marked = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(tri)) == F.size(tri), F.lit(0)).otherwise(let(let(marked, places), covered))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))

    hashes = F.transform(ws, lambda w: F.xxhash64(w))
    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(let(hashes, windows), of)).cast("long")


def base_counts(text: Column, ws: Column) -> dict[str, Column]:
    """The base statistics of a text, given its words."""
    full = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": F.length(F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]++"), F.lit(0)), "")).cast("long"),
        "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(ws),
    }


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """doc_ids of the trusted target: labelled good, at most ``limit`` of them, by hash so that none is favoured."""
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumnRenamed("doc_id", "_trusted")


def bucket_ratios(docs: DataFrame, labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """One row with ``ratio``: by bucket, the log of its share in the trusted target over its share in all documents.

    Counts cover every word of every document; they are added up by task before the shuffle, at most BUCKETS rows each.
    """
    hit = docs.join(F.broadcast(trusted_ids(labels, limit)), F.col("doc_id") == F.col("_trusted"), "left")
    grams = hit.select(F.lit(1).cast("long").alias("_n"), F.col("_trusted").isNotNull().cast("long").alias("_t"), F.explode(let(words(F.col("text")), ngram_buckets)).alias("bucket"))
    none = F.lit(0).cast("long")
    every = docs.sparkSession.range(BUCKETS).select(none.alias("_n"), none.alias("_t"), F.col("id").cast("int").alias("bucket"))
    counts = grams.unionByName(every).groupBy("bucket").agg(F.sum("_n").alias("raw"), F.sum("_t").alias("target"))
    packed = counts.groupBy(F.floor(F.col("bucket") / PACKED).alias("pack")).agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("counts"), F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    whole = packed.agg(F.sort_array(F.collect_list(F.struct("pack", "counts"))).alias("packs"), *[(F.sum(c) + F.lit(SMOOTHING * BUCKETS)).alias(c) for c in ("raw", "target")])
    ratio = lambda x: F.log((x["target"] + SMOOTHING) / F.col("target")) - F.log((x["raw"] + SMOOTHING) / F.col("raw"))
    return whole.select(F.flatten(F.transform("packs", lambda p: F.transform(p["counts"], lambda x: F.round(ratio(x), 9)))).alias("ratio"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = TRUSTED) -> DataFrame:
    """doc_id, the base statistics, base_failed, score (mean log-likelihood ratio; 0 without words) and kept.

    The table of ratios has BUCKETS entries whatever the corpus's size, and reaches the rows as a scalar subquery. Null
    and empty texts count no word and fail the base rule; rows that repeat repeat; without trusted documents every
    ratio follows from the smoothing alone. Other columns of ``docs`` are left aside.
    """
    ratio = bucket_ratios(docs, labels, limit).scalar()
    ws = words(F.col("text"))

    def scored(grams: Column) -> Column:
        total = F.aggregate(grams, F.lit(0.0), lambda a, b: a + F.get(F.col("_ratio"), b))
        return F.when(F.size(grams) > 0, total / F.size(grams)).otherwise(F.lit(0.0))

    d = docs.select("doc_id", "text", ratio.alias("_ratio"))

    def all_of(w: Column) -> Column:
        cols = base_counts(F.col("text"), w) | {"score": F.round(let(ngram_buckets(w), scored), 6)}
        return F.struct(*[c.alias(k) for k, c in cols.items()])

    d = d.select("doc_id", let(ws, all_of).alias("x")).select("doc_id", "x.*")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return d.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def learned_threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The score that parts labelled documents best: most of the bad below it less most of the good, as shares.

    Every labelled document that passes the base rule counts, in cells of a thousandth, so that the driver sees a bounded
    table. The threshold lies midway between the scores on its two sides; without both labels it is THRESHOLD.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q")).distinct()
    d = scored.where("NOT base_failed").join(known, F.col("doc_id") == F.col("_id"))
    cell = F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("score"))) * 1000)
    cells = sorted(d.groupBy(cell.alias("cell")).agg(F.count_if(F.col("_q") == 0), F.count_if(F.col("_q") == 1), F.min("score"), F.max("score")).collect())
    bad, good = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best, threshold, low, lost = 0.0, THRESHOLD, 0, 0
    for c, after in zip(cells, cells[1:], strict=False):
        low, lost = low + c[1], lost + c[2]
        if bad and good and low / bad - lost / good > best:
            best, threshold = low / bad - lost / good, (c[4] + after[3]) / 2
    return threshold


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = materialize(quality_rules(documents(spark, sf_dir), labels), "quality-rules")
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= learned_threshold(out, labels)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
