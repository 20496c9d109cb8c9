"""Personal data: fixed formats, and further candidates that boosted trees select."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import documents
from geoloom.llm.spans import bound, digits, matches, pick, total, trees
from geoloom.storage import materialize

#: The fixed formats, written so that no start is tried twice and no repeat is kept for backtracking.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9]){11,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

YEAR, MONTHS = "(?:19|20)[0-9]{2}", "(?i:jan|feb|mar|mär|apr|may|mai|jun|jul|aug|sep|oct|okt|nov|dec|dez)[a-z]{0,6}"

#: Generators of further candidates, in the order of their kinds' numbers; each has words that announce it.
EXTRA = {
    "ssn": (r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])", "ssn|social"),
    "iban": (r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])", "iban|account|konto|compte|cuenta"),
    "phone_national": (r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])", "phone|tel|call|fax|mobile"),
    "birth_date": (rf"(?<![0-9./-])(?:[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-]{YEAR}|{YEAR}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}|[0-9]{{1,2}}\.? (?:{MONTHS})\.?,? {YEAR}|(?:{MONTHS})\.? [0-9]{{1,2}},? {YEAR})(?![0-9])", "born|birth|dob|geboren|nacid|né"),
    "email_spelled": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,40}+ ?(?i:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,40}+(?: ?(?i:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,40}+)+", "mail|contact|write|reach"),
}
#: Labelled candidates of each kind, and the least precision on those held out that a kind's threshold must give.
LABELLED, PRECISION = 240, 0.97
FEATURES = ("kind", "length", "n_digits", "n_separators", "n_distinct", "announced", "counted", "marked", "closed", "valid")


def _checked_iban(text: Column) -> Column:
    s = F.upper(F.regexp_replace(text, " ", ""))
    moved = F.split(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), lambda a, c: F.pmod(F.when(value(c) > 9, a * 100).otherwise(a * 10) + value(c), F.lit(97)))
    return rest == 1


def candidate_features(c: Column, kind: int, cue: str) -> list[Column]:
    """Format and context of a candidate, in the order of FEATURES, as doubles."""
    text, before = c["text"], F.lower(c["before"])
    plain = F.regexp_replace(text, "[^0-9]", "")
    numbers = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    number = lambda i: F.coalesce(F.get(numbers, F.lit(i)).try_cast("int"), F.lit(0))
    day, month = lambda i: number(i).between(1, 31), lambda i: number(i).between(1, 12)
    valid = {
        0: ~F.substring(plain, 1, 3).isin("000", "666") & (F.substring(plain, 1, 1) != "9") & (F.substring(plain, 4, 2) != "00") & (F.substring(plain, 6, 4) != "0000"),
        1: _checked_iban(text),
        2: ~F.substring(plain, 1, 1).isin("0", "1") & ~F.substring(plain, 4, 1).isin("0", "1"),
        3: F.when(F.size(numbers) < 3, day(0)).when(number(0) > 31, month(1) & day(2)).otherwise((day(0) & month(1)) | (month(0) & day(1))),
        4: text.rlike(r"(?i)\(at\)|\[at\]") | text.rlike(r"(?i)(?:com|org|net|edu|de|fr|es)$"),
    }[kind]
    cols = [
        F.lit(kind),
        F.length(text),
        F.length(plain),
        F.length(F.regexp_replace(text, "[A-Za-z0-9]", "")),
        F.size(F.array_distinct(F.split(text, ""))),
        before.rlike(rf"(?:{cue})[^.!?]*$"),
        before.rlike(r"(?:no|number|nr|order|part|lot|ref|version|id|invoice|page|table|score|total|sum)[ .:#]*$"),
        before.rlike(r"[:=#] ?$"),
        c["after"].rlike(r"^(?:[\s.,;:!?)\"']|$)"),
        valid,
    ]
    return [F.coalesce(x.cast("double"), F.lit(0.0)) for x in cols]


def labelled(spark: SparkSession, each: int = LABELLED) -> DataFrame:
    """(kind, text, label): labelled findings of each kind in sentences, made by rule.

    Half are personal data, mostly announced and well formed; the others share the format but count, number or date
    something else, or break the format's own rules, also where they are announced. A tenth of each half lacks its usual
    context. Words that announce, other contexts and the ways to write a date differ from those of unseen().
    """
    n = len(EXTRA)
    d = spark.range(0, each * n, 1, 1).select("id", F.pmod("id", F.lit(n)).cast("int").alias("kind"), (F.pmod(F.floor(F.col("id") / n), F.lit(2))).cast("int").alias("label"))
    key = lambda k: F.xxhash64("id", F.lit(k))
    good, plain = F.col("label") == 1, F.pmod(key(1), F.lit(10)) == 0
    cues = [["SSN ", "ssn: ", "social security number "], ["IBAN ", "account ", "IBAN: "], ["phone ", "call ", "tel. ", "mobile: "], ["born ", "date of birth ", "dob: "], ["mail ", "contact ", "write to "]]
    other = ["part no. ", "order ", "lot ", "ref. ", "version ", "invoice ", "page ", "meet ", "of the "]
    prefix = F.when(plain, F.lit("and then ")).when(good | ((F.pmod(key(31), F.lit(4)) == 0) & F.col("kind").isin(0, 1)), F.element_at(F.array(*[pick(c, key(2)) for c in cues]), F.col("kind") + 1)).otherwise(pick(other, key(3)))
    ssn = F.concat(F.when(good, F.lit("2")).otherwise(pick(["0", "9", "4"], key(4))), F.when(good, digits(2, F.col("id"), F.lit(5))).otherwise(pick(["00", "66", "12"], key(6))), F.lit("-"), F.when(good, F.lit("47")).otherwise(pick(["00", "31"], key(7))), F.lit("-"), digits(4, F.col("id"), F.lit(8)))
    body = F.concat(F.lit("3704"), digits(12, F.col("id"), F.lit(9)), F.lit("00"))
    check = F.lpad((F.lit(98) - F.pmod(F.concat(body, F.lit("131400")).cast("decimal(38,0)"), F.lit(97).cast("decimal(38,0)")).cast("int")).cast("string"), 2, "0")
    iban = F.concat(F.lit("DE"), F.when(good, check).otherwise(digits(2, F.col("id"), F.lit(10))), body)
    national = F.concat(F.lit("("), F.when(good, F.lit("4")).otherwise(pick(["0", "1", "5"], key(11))), digits(2, F.col("id"), F.lit(12)), F.lit(") "), F.when(good, F.lit("5")).otherwise(pick(["0", "1", "7"], key(13))), digits(2, F.col("id"), F.lit(14)), F.lit("-"), digits(4, F.col("id"), F.lit(15)))
    right = F.pmod(key(32), F.lit(2)) == 0  # half of the dates of something else are well formed
    day = F.when(good | right, F.concat(F.lit("1"), digits(1, F.col("id"), F.lit(17)))).otherwise(pick(["00", "34", "99"], key(18)))
    year = F.concat(F.lit("19"), digits(2, F.col("id"), F.lit(21)))
    month = F.lpad((F.pmod(key(20), F.lit(12)) + 1).cast("string"), 2, "0")
    named = pick(["May", "June", "Oct.", "Februar", "August"], key(33))
    date = F.element_at(F.array(F.concat_ws(".", day, month, year), F.concat_ws("-", year, month, day), F.concat_ws(" ", day, named, year)), (F.pmod(key(34), F.lit(3)) + 1).cast("int"))
    date = F.when(good | right | (F.pmod(key(34), F.lit(3)) < 2), date).otherwise(F.concat_ws("/", day, F.lit("44"), year))
    spelled = F.concat(pick(["ana", "max.b", "j.doe", "info"], key(22)), F.when(good, pick([" (at) ", " [at] "], key(23))).otherwise(F.lit(" at ")), pick(["mail", "post", "example"], key(24)), F.when(good, pick([" (dot) com", " [dot] org"], key(25))).otherwise(pick([" dot matrix", " dot product", " dot line"], key(26))))
    text = F.element_at(F.array(ssn, iban, national, date, spelled), F.col("kind") + 1)
    return d.select("id", "kind", "label", F.concat(F.lit("There "), prefix, text, pick([".", " and so on.", ", then", " x"], key(27))).alias("text"))


#: Findings in forms that no training sentence has: (kind, text, label), with {0} to {4} for digits.
UNSEEN = (
    ("ssn", "Her social insurance is SSN#{0}36 52 1{1}0{2}, on file.", 1),
    ("ssn", "batch 000-{0}{1}-77{2}{3} was shipped", 0),
    ("ssn", "lot number {0}66 00 1{1}{2}3 came back", 0),
    ("iban", "Überweisung auf Konto de{iban} bitte", 1),
    ("iban", "compte FR1{0} 20{1}1 0{2}10 0{3}05 in the invoice ref", 0),
    ("phone_national", "Fax: 41{0}-55{1}-2{2}71 after five", 1),
    ("phone_national", "score 01{0} 1{1}3-2{2}71 of the match", 0),
    ("birth_date", "She was born on March {0}, 19{1}{2} in Ulm", 1),
    ("birth_date", "né le 1{0}/0{1}/19{2}{3} à Lyon", 1),
    ("birth_date", "The report of 1{0}/0{1}/19{2}{3} is late", 0),
    ("birth_date", "revised on April 1{0}, 20{1}{2} by the board", 0),
    ("email_spelled", "reach JO.{0}X(AT)Example(DOT)co(DOT)uk any day", 1),
    ("email_spelled", "they meet at home dot by dot {0}", 0),
)


def unseen(spark: SparkSession, each: int = 40) -> DataFrame:
    """(id, want, label, text): UNSEEN with different digits, to measure precision and recall on."""
    rows = []
    for i in range(each):
        for k, (kind, text, label) in enumerate(UNSEEN):
            d = [str((7 * i + 3 * k + j * (i // 3 + 1)) % 9 + 1) for j in range(5)]
            body = f"3704{i:04d}{k:04d}{i * 7919 % 10**6:06d}"
            iban = f"{98 - int(body + '131400') % 97:02d}{body}"
            rows.append((len(rows), kind, label, text.format(*d, iban=iban)))
    return spark.createDataFrame(rows, "id long, want string, label int, text string")


def measured(found: DataFrame) -> dict[str, tuple[float, float]]:
    """Precision and recall of each kind over rows of unseen() with their ``found`` spans."""
    hit = F.exists("found", lambda s: s["kind"] == F.col("want")).cast("int")
    rows = found.groupBy("want").agg(F.sum(hit * F.col("label")).alias("t"), F.sum(hit).alias("p"), F.sum("label").alias("n")).collect()
    return {r.want: (r.t / r.p if r.p else 1.0, r.t / r.n) for r in rows}


class Selector:
    """Boosted trees over candidates' features, and each kind's calibrated threshold."""

    def __init__(self, description: str, weights: list[float], thresholds: dict[int, float]) -> None:
        self.description, self.weights, self.thresholds = description, weights, thresholds

    def score(self, values: list[Column]) -> Column:
        margin = total([t * w for t, w in zip(trees(self.description, values), self.weights, strict=True)])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(margin * -2.0))


def _training(d: DataFrame) -> DataFrame:
    out = None
    for k, (pattern, cue) in enumerate(EXTRA.values()):
        rows = d.where(F.col("kind") == k).select("id", "label", F.explode(matches(F.col("text"), pattern)).alias("c"))
        rows = rows.select("id", "label", *[x.alias(n) for n, x in zip(FEATURES, candidate_features(F.col("c"), k, cue), strict=True)])
        out = rows if out is None else out.unionByName(rows)
    return out.coalesce(1)


_SELECTORS: dict[tuple, Selector] = {}


def fit(spark: SparkSession, each: int = LABELLED, precision: float = PRECISION) -> Selector:
    """Train on three quarters of the labelled findings; set thresholds on the rest, a bounded number of rows.

    A kind's threshold is the least score from which its held-out candidates are at least ``precision`` right. Where no
    score is, the kind is not redacted. The model is made once in an application.
    """
    key = (spark.sparkContext.applicationId, each, precision)
    if key in _SELECTORS:
        return _SELECTORS[key]
    d = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(materialize(_training(labelled(spark, each)), "pii-findings").coalesce(1).sortWithinPartitions("id", "kind"))
    out = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=12, maxDepth=3, stepSize=0.3, seed=7).fit(d.where(~out))
    selector = Selector(model.toDebugString, list(model.treeWeights), {})
    rows = d.where(out).select("kind", "label", selector.score([F.col(c) for c in FEATURES]).alias("s")).collect()
    for k in range(len(EXTRA)):
        mine = sorted(((r.s, r.label) for r in rows if r.kind == k), reverse=True)
        good, best = 0, None
        for i, (s, y) in enumerate(mine):
            good += y
            if (i + 1 == len(mine) or mine[i + 1][0] < s) and good >= precision * (i + 1):
                best = s
        if best is not None:
            selector.thresholds[k] = best - 1e-9
    _SELECTORS[key] = selector
    return selector


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the fixed formats; matches that fail their check are dropped."""
    plain = lambda m: F.regexp_replace(m, "[^0-9]", "")
    guarded = lambda p, hint: F.when(F.contains(text, F.lit(hint)), matches(text, p)).otherwise(matches(F.lit(""), p))
    return {
        "email": guarded(EMAIL, "@"),
        "ip": F.filter(matches(text, IP), lambda c: F.forall(F.split(c["text"], "[.]"), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))),
        "card": F.filter(matches(text, CARD), lambda c: F.length(plain(c["text"])).between(12, 19) & F.call_function("luhn_check", plain(c["text"]))),
        "phone": F.filter(guarded(PHONE, "+"), lambda c: F.length(plain(c["text"])).between(9, 15)),
    }


def find_pii(docs: DataFrame, selector: Selector, *keep: str) -> DataFrame:
    """``keep`` columns, the base counts and ``found``: all spans as (start, rank, kind, end), by start, then kind.

    Null text counts as empty. Base spans always stay, overlaps among them too; a candidate stays if its score reaches
    its kind's threshold and it overlaps no base span. Rows that repeat repeat, an empty table gives no rows. All of it
    happens within a row: nothing is shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(*keep, text.alias("_text"))
    d = d.select(*keep, "_text", F.struct(*[c.alias(k) for k, c in base_spans(F.col("_text")).items()]).alias("_b"))
    shape = lambda rank, kind: lambda c: F.struct(c["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), c["end"].alias("end"))
    base = F.concat(*[F.transform(F.col(f"_b.{k}"), shape(i, k)) for i, k in enumerate(BASE)])
    d = d.select(*keep, "_text", F.col("_b"), F.sort_array(base).alias("_base"))
    def selected(k: int, cue: str):
        clear = lambda c: ~F.exists(F.col("_base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
        return lambda c: (bound(candidate_features(c, k, cue), selector.score) >= selector.thresholds[k]) & clear(c)

    more = []
    for k, (kind, (pattern, cue)) in enumerate(EXTRA.items()):
        if k not in selector.thresholds:
            continue
        found = matches(F.col("_text"), pattern)
        if kind == "email_spelled":
            dotted = F.contains("_text", F.lit("dot")) | F.contains("_text", F.lit("DOT")) | F.contains("_text", F.lit("Dot"))
            found = F.when(dotted, found).otherwise(matches(F.lit(""), pattern))
        if kind == "birth_date":
            found = F.when(F.col("_text").rlike(YEAR), found).otherwise(matches(F.lit(""), pattern))
        more.append(F.transform(F.filter(found, selected(k, cue)), shape(len(BASE) + k, kind)))
    counts = [F.size(F.col(f"_b.{k}")).cast("long").alias(f"n_{k}") for k in BASE]
    return d.select(*keep, "_text", *counts, "_base", F.sort_array(F.concat(F.col("_base"), *more)).alias("found"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, selector: Selector) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in angle brackets; texts without spans stay as they are.

    Overlapping spans are replaced as one, named after the first.
    """
    names = docs.columns
    held = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    f = find_pii(held, selector, "_row")

    def cut(spans: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
        step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] < a["at"], a["text"]).otherwise(F.concat(a["text"], F.substring(F.col("_text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))).alias("text"))
        return F.aggregate(spans, start, step, lambda a: F.concat(a["text"], F.substring(F.col("_text"), (a["at"] + 1).cast("int"), F.length("_text"))))

    text = F.when(F.size("found") > 0, cut(F.col("found"))).otherwise(F.col("_row.text"))
    return f.select(*[(text if c == "text" else F.col("_row").getField(c)).alias(c) for c in names])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = find_pii(documents(spark, sf_dir), fit(spark), "doc_id")
    return f.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
