"""Secrets: candidates from a pattern of high recall, and a random forest that removes false findings."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents
from geoloom.llm.spans import bound, digits, matches, pick, total, trees
from geoloom.storage import materialize

#: Runs of 16 or more token characters of which one, at least, is a digit or a capital after the first. An equals sign is
#: padding at the end of a run only, and no part of it where a token character follows, as between a name and its value.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]?[a-z+/_-]*+[A-Z0-9])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_-]))?"
#: Words of so many letters make the dictionary, so many of the most frequent.
WORD_LENGTHS, WORDS = (3, 12), 400
#: Words that names in code and paths are made of, which running text may lack.
CODE_WORDS = "access account admin api app auth aws base build bucket client code conf config core data database date default doc example file git hash home http id image index input key lib local login main name node number output page part password path private project public secret server service session source src static string stripe system temp test token tool type url user util value version web"
#: Labelled findings the forest learns from, and the share of its votes that a secret needs.
LABELLED, VOTES = 1_200, 0.5
FEATURES = ("length", "digit_share", "upper_share", "transition_share", "covered", "distinct", "hex", "prefixed", "named", "assigned", "quoted", "digest_named", "test_path")


def dictionary(docs: DataFrame, most: int = WORDS) -> list[str]:
    """The ``most`` frequent lower-case words over all texts, and CODE_WORDS. Null and empty texts have none."""
    low, high = WORD_LENGTHS
    found = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(rf"(?<![A-Za-z])[a-z]{{{low},{high}}}+(?![A-Za-z])"), F.lit(0))).alias("w"))
    top = found.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most)
    return sorted({r[0] for r in top.select("w").collect()} | set(CODE_WORDS.split()))


def _covering(words: list[str]) -> str:
    """A pattern that prefers the longest word."""
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def candidate_features(c: Column, path: Column, parts: str) -> list[Column]:
    """Length, character transitions, coverage by the words of ``parts``, path and neighbouring words, as FEATURES lists them."""
    x, before = c["text"], F.lower(c["before"])
    n = F.length(x)
    cols = [
        F.least(n, F.lit(200)),
        F.regexp_count(x, F.lit("[0-9]")) / n,
        F.regexp_count(x, F.lit("[A-Z]")) / n,
        F.regexp_count(x, F.lit("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])")) / n,
        F.length(F.array_join(F.regexp_extract_all(F.lower(x), F.lit(parts), F.lit(0)), "")) / n,
        F.size(F.array_distinct(F.split(x, ""))),
        x.rlike("^[0-9a-f]+$|^[0-9A-F]+$"),
        x.rlike("^(?:AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[abp]-|eyJ|AIza|glpat-)"),
        before.rlike("(?:token|secret|passw|api.?key|access.?key|private.?key|auth|bearer|credential)"),
        before.rlike(r"[=:]\s*[\"']?$"),
        before.rlike(r"[\"']$"),
        before.rlike("(?:sha|md5|checksum|digest|commit|revision|uuid|hash|etag|build|file|page|image)[^a-z]*$"),
        F.lower(path).rlike("test|example|fixture|sample|mock"),
    ]
    return [F.coalesce(y.cast("double"), F.lit(0.0)) for y in cols]


def labelled(spark: SparkSession, words: list[str], rows: int = LABELLED) -> DataFrame:
    """(text, path, label): findings by rule. True ones are hex or mixed tokens that are named or have a known prefix.

    False ones are digests and identifiers, names and paths made of ``words``, and placeholder values, also in named
    places.
    """
    d = spark.range(0, rows, 1, 1).select("id", F.pmod("id", F.lit(2)).cast("int").alias("label"))
    key = lambda k: F.xxhash64("id", F.lit(k))
    hexed = F.substring(F.md5(F.col("id").cast("string")), 1, 32)
    sha = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40)
    mixed = F.regexp_replace(F.base64(F.unhex(F.substring(F.sha2(F.concat(F.lit("m"), F.col("id").cast("string")), 256), 1, 48))), "[+/=]", "x")
    named = pick(['token = "', "secret: ", "api_key=", "password = '", "Authorization: Bearer ", 'access_key = "', "auth token ", "TOKEN=", "secret:", "password=", "https://a.example/v1?page=2&access_token=", "/login?auth="], key(1))
    value = F.element_at(F.array(hexed, sha, mixed, F.upper(sha)), (F.pmod(key(2), F.lit(4)) + 1).cast("int"))
    known = F.concat(pick(["AKIA", "ghp_", "sk_live_", "xoxb-", "AIza", "glpat-"], key(3)), mixed)
    known = F.when(F.pmod(key(45), F.lit(3)) == 0, F.concat(pick(["AKIA", "ASIA"], key(46)), F.upper(F.substring(sha, 1, 16)))).otherwise(known)
    value = F.when(F.pmod(key(47), F.lit(4)) == 0, known).otherwise(value)
    true = F.when(F.pmod(key(4), F.lit(4)) == 0, F.concat(pick(["use ", "key ", "= ", "with ", "KEY=", "id:", "?q="], key(5)), known)).otherwise(F.concat(named, value))
    some = [w for w in words if 3 <= len(w) <= 8] or CODE_WORDS.split()
    joint = pick(["", "_", "/", "-"], key(52))
    word = F.concat_ws("", F.initcap(pick(some, key(10))), joint, pick(some, key(11)), joint, F.initcap(pick(some, key(12))), joint, pick(some, key(13)), F.when(F.pmod(key(53), F.lit(2)) == 0, F.concat(joint, F.initcap(pick(some, key(14))))))
    false = F.element_at(
        F.array(
            F.concat(pick(["commit ", "sha1 ", "md5: ", "checksum ", "revision ", "etag: ", "build ", "commit=", "sha1=", "md5:", "?hash=", "etag="], key(6)), F.element_at(F.array(hexed, sha), (F.pmod(key(7), F.lit(2)) + 1).cast("int"))),
            F.concat(pick(["so ", "of ", "token ", "and "], key(8)), word),
            F.concat(pick(["see ", "file ", "in "], key(9)), F.lit("src/"), word, F.lit("/part-"), digits(5, F.col("id"), F.lit(30))),
            F.concat(pick(['token = "', "password: ", "api_key=", "TOKEN=", "?auth="], key(31)), pick(["YOUR_API_KEY_HERE_000", "xxxxxxxxxxxxxxxx0000", "EXAMPLEEXAMPLE123456", "changeme-changeme-1"], key(32))),
            F.concat(pick(["number ", "in ", "of ", "card "], key(33)), digits(8, F.col("id"), F.lit(34)), digits(8, F.col("id"), F.lit(35))),
            F.concat(pick(["uuid ", "page ", "image ", "uuid=", "?page=", "image:"], key(36)), hexed),
            F.concat(pick(["AWS_SECRET_ACCESS_KEY", "GITHUB_ACCESS_TOKEN", "DATABASE_PASSWORD", "SERVICE_AUTH_SECRET", "clientPrivateKeyFile", "STRIPE_API_KEY_LIVE_2"], key(42)), pick(["=", ": ", " = "], key(43)), pick(["none", "env", "<unset>", "8080"], key(44))),
        ),
        (F.pmod(key(37), F.lit(7)) + 1).cast("int"),
    )
    path = F.when(F.pmod(key(38), F.lit(8)) == 0, pick(["tests/a.py", "examples/b.md"], key(39))).otherwise(pick(["src/a.py", "conf/b.yml", "web", "notes"], key(40)))
    return d.select("id", "label", path.alias("path"), F.concat(F.lit("Here "), F.when(F.col("label") == 1, true).otherwise(false), pick(['" ', " then", ".", "'"], key(41))).alias("text"))


class Forest:
    def __init__(self, description: str, parts: str) -> None:
        self.description, self.parts = description, parts

    def score(self, values: list[Column]) -> Column:
        """The share of the trees that vote for a secret."""
        votes = trees(self.description, values)
        return total(votes) / len(votes)


_FORESTS: dict[tuple, Forest] = {}


def fit(spark: SparkSession, docs: DataFrame | None = None, rows: int = LABELLED) -> Forest:
    """Train on the labelled findings, with a dictionary of ``docs``, once in an application for each dictionary."""
    words = dictionary(docs) if docs is not None else CODE_WORDS.split()
    key = (spark.sparkContext.applicationId, rows, tuple(words))
    if key not in _FORESTS:
        parts = _covering(words)
        d = labelled(spark, words, rows).select("id", "label", "path", F.explode(matches(F.col("text"), CANDIDATE, over=True)).alias("c"))
        d = d.select("id", "label", *[x.alias(n) for n, x in zip(FEATURES, candidate_features(F.col("c"), F.col("path"), parts), strict=True)])
        d = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(materialize(d.coalesce(1), "secret-findings").coalesce(1).sortWithinPartitions("id"))
        model = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=20, maxDepth=6, seed=7, featureSubsetStrategy="sqrt").fit(d)
        _FORESTS[key] = Forest(model.toDebugString, parts)
    return _FORESTS[key]


def find_secrets(docs: DataFrame, forest: Forest, path: str = "source", votes: float = VOTES) -> DataFrame:
    """One row per secret: doc_id, start, end (code points, exclusive), score and the secret's sha256, never itself.

    Null and empty texts have none; a null path counts as empty; rows that repeat repeat. Scoring happens within a row.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"), F.coalesce(F.col(path), F.lit("")).alias("_path"))
    scored = F.transform(matches(F.col("_text"), CANDIDATE, over=True), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.round(bound(candidate_features(c, F.col("_path"), forest.parts), forest.score), 6).alias("score"), F.sha2(c["text"], 256).alias("secret_sha256")))
    return d.select("doc_id", F.explode(F.filter(scored, lambda c: c["score"] >= votes)).alias("c")).select("doc_id", "c.*")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_secrets(docs, fit(spark, docs))
