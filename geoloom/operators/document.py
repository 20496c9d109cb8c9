"""The compact text document: its lines taken apart into records, checked, and written from sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the format: its first word, and the least number of fields of each record.
MAGIC = "SCR"
FIELDS = {"TILE": 3, "BBOX": 4, "PROJ": 1, "Q": 1, "BUF": 1, "META": 2, "L": 2, "C": 3, "S": 2, "A": 2, "F": 1, "H": 5, "D": 3, "X": 2, "HC": 3, "O": 2, "REF": 2, "ROUTE": 2, "STEP": 2}


def records(lines: DataFrame) -> DataFrame:
    """(doc, n, tag, rest, fields, error) of the lines (doc, n, text) that are not blank, in documents' order.

    The first of a document must be its header; records of unknown tags or with too few fields have an error. A null text
    counts as blank.
    """
    text = F.rtrim(F.regexp_replace("text", "\r$", ""))
    d = lines.select("doc", "n", text.alias("text")).where("text <> ''")
    tag = F.substring_index("text", " ", 1)
    rest = F.when(F.contains("text", F.lit(" ")), F.substr("text", F.length(tag) + 2)).otherwise("")
    head = F.row_number().over(Window.partitionBy("doc").orderBy("n")) == 1
    d = d.withColumn("head", head).select("doc", "n", "head", tag.alias("tag"), rest.alias("rest"), F.filter(F.split(rest, " +"), lambda x: x != "").alias("fields"))
    least = F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv])[F.col("tag")]
    wrong = F.when(F.col("head") & (F.col("tag") != MAGIC), "no header").when(~F.col("head") & least.isNull(), F.concat(F.lit('unknown record tag "'), F.col("tag"), F.lit('"')))
    wrong = F.coalesce(wrong, F.when(~F.col("head") & (F.size("fields") < least), F.concat(F.col("tag"), F.lit(" needs "), least.cast("string"), F.lit(" fields"))))
    return d.withColumn("error", F.when(wrong.isNotNull(), F.concat(F.lit("line "), F.col("n").cast("string"), F.lit(": "), wrong))).drop("head")


def faults(found: DataFrame) -> DataFrame:
    """(doc, error): the first fault of each document that has one: of a line, or an envelope or extent that is missing."""
    has = lambda *tags: F.coalesce(F.bool_or(F.col("tag").isin(*tags)), F.lit(False))
    d = found.groupBy("doc").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("n"))).alias("first"), has("TILE", "BBOX").alias("box"), has("Q").alias("q"))
    error = F.coalesce("first", F.when(~F.col("box"), "missing envelope: need TILE or BBOX"), F.when(~F.col("q"), "missing Q record: quantization extent is required"))
    return d.select("doc", error.alias("error")).where("error IS NOT NULL")


def named(found: DataFrame, tag: str, skip: int = 1) -> DataFrame:
    """(doc, id, name) of records that give an id a name: the text after ``skip`` fields, the first of which is the id."""
    pattern = r"^\S+(?: +\S+)*? +" if skip > 1 else r"^\S+ "
    name = F.regexp_replace("rest", pattern if skip == 1 else rf"^\S+(?: +\S+){{{skip - 1}}} +", "")
    return found.where(F.col("tag") == tag).select("doc", F.col("fields")[0].cast("long").alias("id"), name.alias("name"))


def steps(found: DataFrame) -> DataFrame:
    """(doc, route, n, dist, turn, instruction) of route steps; each belongs to the last route above it."""
    above = F.last(F.when(F.col("tag") == "ROUTE", F.col("fields")[0].cast("long")), ignorenulls=True).over(Window.partitionBy("doc").orderBy("n"))
    d = found.withColumn("route", above).where("tag = 'STEP'")
    option = lambda k: F.nullif(F.regexp_extract("rest", rf"^\S+ (?:(?:dist|ref|turn)=\S+ )*?{k}=(\S+)", 1), F.lit(""))
    told = F.trim(F.regexp_replace("rest", r"^\S+ (?:(?:dist|ref|turn)=\S+\s*)*", ""))
    return d.select("doc", "route", F.col("fields")[0].cast("long").alias("n"), option("dist").cast("long").alias("dist"), option("turn").alias("turn"), told.alias("instruction"))


def properties_text(properties: Column, refs: Column) -> Column:
    """Typed properties as key=value;..., texts by their number in the map ``refs``."""
    one = lambda p: F.concat(p["key"].cast("string"), F.lit("="), F.when(p["type"] == "ref", F.concat(F.lit("s"), refs[p["value"]].cast("string"))).otherwise(p["value"]))
    return F.array_join(F.transform(properties, one), ";")


def sparse_heat(cells: Column, layer: Column) -> Column:
    """The line of a layer's cells (x, y, value); null without cells."""
    body = F.array_join(F.transform(cells, lambda c: F.concat_ws(",", c["x"].cast("string"), c["y"].cast("string"), c["value"].cast("string"))), ";")
    return F.when(F.size(cells) > 0, F.concat(F.lit("X "), layer.cast("string"), F.lit(" "), body))


def cells_of(text: Column) -> Column:
    """Cells (x, y, value) of x,y,v;...; a cell that lacks a number has null there."""
    part = lambda c, i, t: F.get(F.split(c, ","), F.lit(i)).try_cast(t)
    chunks = F.filter(F.split(text, ";"), lambda c: c != "")
    return F.transform(chunks, lambda c: F.struct(part(c, 0, "bigint").alias("x"), part(c, 1, "bigint").alias("y"), part(c, 2, "double").alias("value")))


def written(lines: DataFrame) -> DataFrame:
    """(doc, text) of documents' lines (doc, section, ord, line): sections in their order with a blank line between them."""
    parts = lines.groupBy("doc", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "part"))), lambda x: x["part"]), "\n\n")
    return parts.groupBy("doc").agg(F.concat(whole, F.lit("\n")).alias("text"))


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc, n, text) of documents' (doc, text) lines, numbered from 1."""
    return documents.select("doc", F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("n", F.col("n") + 1)


def geojson(kind: Column, lon: Column, lat: Column, properties: Column) -> Column:
    """A point feature as GeoJSON, coordinates to seven places."""
    at = F.array(F.round(lon, 7), F.round(lat, 7))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(kind.alias("type"), at.alias("coordinates")).alias("geometry"), properties.alias("properties")))


def diff_lines(changes: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, line) of a difference's rows (id, op, aspects), with the label of their feature, or its id without one."""
    told = F.coalesce(F.nullif(F.col("label"), F.lit("")), F.concat(F.lit("feature "), F.col("id").cast("string")))
    line = F.concat_ws(" ", "op", F.col("id").cast("string"), told, F.when(F.col("op") == "~", F.concat(F.lit("("), F.col("aspects"), F.lit(")"))))
    return changes.join(labels, "id", "left").select("id", line.alias("line"))


def op_counts(changes: DataFrame) -> DataFrame:
    """How many rows a difference adds, removes and changes."""
    return changes.agg(*[F.count_if(F.col("op") == op).alias(name) for op, name in (("+", "added"), ("-", "removed"), ("~", "changed"))])
