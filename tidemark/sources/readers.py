"""Scans of feed formats. Schemas are given, never inferred; what cannot be read is set aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated rows without header; empty is null; a bad value fails the read."""
    return spark.read.schema(schema).option("sep", "\t").option("nullValue", "").option("quote", "").option("mode", "FAILFAST").csv(path).withColumn("parse_path", F.lit("strict"))


def read_fallback(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Lines with the right number of fields, bad cells null and counted; and the lines set
    aside (reason: field_count or null_key)."""
    lines = spark.read.text(path).where("value <> ''")
    cells = lines.select("value", F.split("value", "\t", -1).alias("c"))
    fits = F.size("c") == len(schema)
    typed = [F.when(F.col("c")[i] != "", F.col("c")[i]).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)]
    bad_cell = [F.when((F.col("c")[i] != "") & F.col("c")[i].try_cast(f.dataType).isNull(), 1).otherwise(0) for i, f in enumerate(schema)]
    good = cells.where(fits).select("value", *typed, sum(bad_cell[1:], bad_cell[0]).alias("coerced"))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    aside = cells.where(~fits).select("value", F.lit("field_count").alias("reason")).unionByName(good.where(null_key).select("value", F.lit("null_key").alias("reason")))
    return good.where(~null_key).drop("value").withColumn("parse_path", F.lit("fallback")), aside


def error_percent(rows: DataFrame, aside: DataFrame) -> DataFrame:
    """100 (set aside + coerced rows) / lines; a slice fails above five per cent."""
    good = rows.agg(F.count("*").alias("good"), F.count_if(F.col("coerced") > 0).alias("coerced"))
    both = good.crossJoin(aside.agg(F.count("*").alias("aside")))
    percent = F.coalesce(F.try_divide(100.0 * (F.col("aside") + F.col("coerced")), F.col("good") + F.col("aside")), F.lit(0.0))
    return both.withColumn("error_percent", percent).withColumn("failed", F.col("error_percent") > 5.0)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines of size, MD5 and URL: stream and slice id from the file's name."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) == 3).select(parts[0].try_cast("long").alias("size"), parts[1].alias("md5"), parts[2].alias("url"))
    name = F.lower(F.element_at(F.split("url", "/"), -1))
    stream = F.when(name.contains(".export."), "events").when(name.contains(".mentions."), "mentions").when(name.contains(".gkg."), "gkg")
    return rows.withColumns({"stream": stream, "slice_id": F.regexp_extract(name, r"^(\d{14})", 1)}).where("stream is not null")


def verified_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files with whether their MD5 is that of the manifest (name, md5)."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("actual"))
    return expected.join(files, "name", "left").withColumn("verified", F.coalesce(F.col("md5") == F.col("actual"), F.lit(False)))


def canonical_events(rows: DataFrame) -> DataFrame:
    """Events in their canonical form from the delimited slice."""
    from ..functions.classify import ROOT_CATEGORY, mapped
    from ..functions.dates import compact_instant
    from ..functions.keys import event_id

    return rows.select(
        event_id("global_event_id").alias("event_id"), compact_instant("date_added").alias("date_added"), F.col("event_code"), F.col("event_root_code"), mapped("event_root_code", ROOT_CATEGORY, "").alias("codebook_type"),
        "quad_class", "goldstein_scale", "num_mentions", "num_sources", "num_articles", "avg_tone", F.col("action_geo_lat").alias("lat"), F.col("action_geo_long").alias("lon"), "source_url",
    )


def canonical_documents(rows: DataFrame) -> DataFrame:
    """Documents from the theme slice: lists without empties, six tone numbers (missing: 0)."""
    from ..functions.dates import compact_instant
    from ..functions.keys import document_id
    from ..functions.text import split_list

    names = ("tone", "positive", "negative", "polarity", "activity", "self_group")
    tone = F.split(F.coalesce("v15_tone", F.lit("")), ",")
    numbers = [F.coalesce(F.get(tone, F.lit(i)).try_cast("double"), F.lit(0.0)).alias(f"tone_{n}") for i, n in enumerate(names)]
    return rows.select(document_id("gkg_record_id").alias("doc_id"), compact_instant("v21_date").alias("date"), F.col("v2_document_identifier").alias("url"), split_list("v1_themes").alias("themes"), split_list("v1_persons").alias("persons"), split_list("v1_organizations").alias("organizations"), *numbers)


def read_geojson(spark: SparkSession, path: str, properties: dict[str, tuple[str, str]], lines: bool = False) -> DataFrame:
    """Features as rows: lon, lat (of points), geometry type and typed properties (name: (field, type)). A file is one collection,
    or holds many, one in each of its ``lines``: a task then reads part of a file instead of every file being one."""
    schema = T.StructType.fromDDL("features array<struct<id: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>")
    f = spark.read.option("multiLine", not lines).schema(schema).json(path).select(F.explode("features").alias("f"))
    numbers = F.from_json(F.when(F.col("f.geometry.type") == "Point", F.col("f.geometry.coordinates")), "array<double>")
    return f.select(F.col("f.id").alias("id"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.get(numbers, F.lit(0)).alias("lon"), F.get(numbers, F.lit(1)).alias("lat"), F.get(numbers, F.lit(2)).alias("depth_km"), *[F.try_element_at("f.properties", F.lit(field)).try_cast(kind).alias(name) for name, (field, kind) in properties.items()])


def multi_lines(features: DataFrame) -> DataFrame:
    """Line features as arrays of lines of [lon, lat]: a single line becomes one of several."""
    one = F.array(F.from_json("coordinates", "array<array<double>>"))
    many = F.from_json("coordinates", "array<array<array<double>>>")
    return features.withColumn("lines", F.when(F.col("geometry_type") == "LineString", one).when(F.col("geometry_type") == "MultiLineString", many))


def read_thermal(spark: SparkSession, path: str) -> DataFrame:
    """Thermal detections with a header; rows without a position go, missing numbers are 0."""
    from ..functions.classify import possible_explosion
    from ..functions.dates import acquisition_instant

    names = ("latitude", "longitude", "brightness", "scan", "track", "acq_date", "acq_time", "satellite", "confidence", "frp", "daynight")
    raw = spark.read.option("header", True).schema(", ".join(f"{n} string" for n in names)).option("enforceSchema", False).csv(path)
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c)
    rows = raw.where(F.col("latitude").try_cast("double").isNotNull() & F.col("longitude").try_cast("double").isNotNull())
    rows = rows.select(*[number(c) for c in ("latitude", "longitude", "brightness", "scan", "track", "frp")], "acq_date", "acq_time", "satellite", "confidence", "daynight")
    return rows.withColumns({"acquired": acquisition_instant("acq_date", "acq_time"), "possible_explosion": possible_explosion("frp", "brightness")})


def latest_geometry(rows: DataFrame, geometries: str) -> DataFrame:
    """Events with the position of their latest point. geometries: array of structs date, type, coordinates (array)."""
    points = F.filter(geometries, lambda g: g["type"] == "Point")
    last = F.array_max(F.transform(points, lambda g: F.struct(g["date"].alias("date"), g["coordinates"].alias("c"))))
    return rows.withColumn("__g", last).where("__g is not null").withColumns({"event_date": F.col("__g.date"), "lon": F.get("__g.c", F.lit(0)), "lat": F.get("__g.c", F.lit(1))}).drop("__g")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Rows of an XML file: sanctions entries, feed items."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema).load(path)


def newest_items(items: DataFrame, feed: str, order: Sequence[Column], n: int = 15) -> DataFrame:
    """The first n entries of each feed that have a title and a link."""
    from ..operators.timeline import ranked_first

    return ranked_first(items.where("trim(title) <> '' and trim(link) <> ''"), [feed], order, n)


def parse_tle(files: DataFrame, text: Column) -> DataFrame:
    """Satellites of element files (name, line 1, line 2): after a bad record the reading goes on
    one line later. A number of more than five digits moves what follows it. Out: name, norad_id, inclination, mean_motion,
    period_minutes."""
    import re

    import pandas as pd

    number = re.compile(r"[12] ( *\d+)")

    def run(batches):
        for batch in batches:
            rows = []
            for body in batch["body"]:
                lines = [x.rstrip() for x in (body or "").splitlines() if x.strip()]
                i = 0
                while i + 2 < len(lines):
                    name, one, two = lines[i : i + 3]
                    # the places by which a number is wider than its field
                    first, second = (max(m.end() - 7, 0) if (m := number.match(x)) else 0 for x in (one, two))
                    if one.startswith("1 ") and two.startswith("2 ") and len(one) >= 62 + first and len(two) >= 63 + second:
                        try:
                            motion = float(two[52 + second : 63 + second])
                            rows.append((name.strip(), int(one[2 : 7 + first]), float(two[8 + second : 16 + second]), motion, 1440.0 / motion))
                            i += 3
                            continue
                        except (ValueError, ZeroDivisionError):
                            pass
                    i += 1
            yield pd.DataFrame(rows, columns=["name", "norad_id", "inclination", "mean_motion", "period_minutes"])

    return files.select(text.alias("body")).mapInPandas(run, "name string, norad_id long, inclination double, mean_motion double, period_minutes double")


def markdown_blocks(files: DataFrame, text: Column) -> DataFrame:
    """Blocks under third-level headings with their **field:** values."""
    blocks = files.select(F.explode(F.split(text, r"(?m)^### ")).alias("b"), ).where(F.trim("b") != "").where(~F.col("b").rlike("^\\s*#"))
    pairs = F.regexp_extract_all("b", F.lit(r"(?m)^[-*]?\s*\*\*([^*:]+):?\*\*:?\s*(.+)$"), 1), F.regexp_extract_all("b", F.lit(r"(?m)^[-*]?\s*\*\*([^*:]+):?\*\*:?\s*(.+)$"), 2)
    return blocks.select(F.trim(F.substring_index("b", "\n", 1)).alias("name"), F.map_from_arrays(F.transform(pairs[0], lambda x: F.trim(x)), F.transform(pairs[1], lambda x: F.trim(x))).alias("fields"))


def pipe_table(files: DataFrame, text: Column, columns: Sequence[str]) -> DataFrame:
    """Rows of a Markdown table without its header and separator."""
    lines = files.select(F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.trim("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.where(~F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$")).select("pos", cells.alias("c")).where(F.size("c") == len(columns))
    return rows.where(F.lower(F.col("c")[0]) != columns[0].lower()).select("pos", *[F.col("c")[i].alias(n) for i, n in enumerate(columns)])


def heading_fill(lines: DataFrame, doc: str, pos: str, line: str) -> DataFrame:
    """Third-level headings with the second-level heading that they stand under."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    branch = F.last(F.when(F.col(line).rlike("^## "), F.trim(F.substring(line, 4, 10_000))), ignorenulls=True).over(w)
    return lines.withColumn("branch", branch).where(F.col(line).rlike("^### ")).select(doc, pos, "branch", F.trim(F.substring(line, 5, 10_000)).alias("program"))


def sparql_rows(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Bindings of a linked-data result: item id, label, and the point's lat and lon. A file is one result, or holds one in each
    of its ``lines``."""
    from ..functions.geo import wkt_point

    schema = T.StructType.fromDDL("results struct<bindings: array<map<string, struct<value: string>>>>")
    b = spark.read.option("multiLine", not lines).schema(schema).json(path).select(F.explode("results.bindings").alias("b"))
    value = lambda k: F.try_element_at("b", F.lit(k))["value"]
    return b.select(F.regexp_extract(value("item"), r"(Q\d+)$", 1).alias("qid"), value("itemLabel").alias("label"), wkt_point(value("coord")).alias("point")).where("qid <> ''")


def first_provider(feeds: Sequence[DataFrame]) -> DataFrame:
    """The first feed that has rows."""
    for feed in feeds[:-1]:
        if not feed.isEmpty():
            return feed
    return feeds[-1]


def canonical_mentions(rows: DataFrame) -> DataFrame:
    """Mentions in their canonical form; a missing confidence is 0."""
    from ..functions.keys import event_id

    return rows.select(event_id("global_event_id").alias("event_id"), F.col("mention_identifier").alias("mention_url"), F.col("mention_doc_tone").cast("double").alias("tone"), F.coalesce(F.col("confidence").cast("int"), F.lit(0)).alias("confidence"), F.col("char_offset").cast("int").alias("char_offset"))
