"""Feed rows in their own shape, from JSON text or files that are already read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import mapped

#: Kinds of violence and classes of storms.
VIOLENCE = {1: "state-based", 2: "non-state", 3: "one-sided"}
STORMS = {"TD": "tropical depression", "TS": "tropical storm", "HU": "hurricane", "STD": "subtropical depression", "STS": "subtropical storm", "PTC": "post-tropical cyclone"}
ALERTS = {"green": 1, "orange": 2, "red": 3}


def records(lines: DataFrame, text: str, schema: str, path: str | None = None) -> DataFrame:
    """Rows of JSON documents: the document itself, or the array of records under a field."""
    parsed = F.from_json(text, schema if path is None else f"{path} array<struct<{schema}>>")
    if path is None:
        return lines.select(parsed.alias("r")).where("r is not null").select("r.*")
    return lines.select(F.explode(parsed[path]).alias("r")).select("r.*")


def disasters(rows: DataFrame) -> DataFrame:
    """Disaster features: severity as a number or 0, alert level with its rank."""
    level = F.lower(F.coalesce("alert_level", F.lit("")))
    return rows.withColumns({"severity": F.coalesce(F.col("severity").try_cast("double"), F.lit(0.0)), "alert_rank": mapped(level, ALERTS, 0)})


def conflicts(rows: DataFrame, now: str, days: int = 365) -> DataFrame:
    """Conflict events of the last year with their label; null coordinates stay null."""
    start = F.to_date("date_start")
    return rows.where(start >= F.date_sub(F.lit(now).cast("date"), days)).withColumns({"violence_label": mapped("type_of_violence", VIOLENCE, "unknown"), "best": F.coalesce(F.col("best").try_cast("long"), F.lit(0))})


def humanitarian(rows: DataFrame) -> DataFrame:
    """Monthly aggregates: the period is a year and a month."""
    whole = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0)).alias(c)
    return rows.select("location_code", F.substring("reference_period", 1, 7).alias("reference_period"), "event_type", whole("events"), whole("fatalities"))


def chokepoints(flows: DataFrame, places: DataFrame) -> DataFrame:
    """Flows with the position of their chokepoint. places is a small list: chokepoint, lat, lon."""
    return flows.join(places, "chokepoint", "left").withColumns({"vessel_count": F.coalesce(F.col("vessel_count").try_cast("long"), F.lit(0)), "trade_value_usd": F.coalesce(F.col("trade_value_usd").try_cast("double"), F.lit(0.0))})


def storms(rows: DataFrame) -> DataFrame:
    return rows.withColumn("class_name", mapped(F.upper(F.trim("classification")), STORMS, "unknown"))


def vessels(positions: DataFrame, metadata: DataFrame, now_ms: int, age_s: int = 600) -> DataFrame:
    """Recent positions with the vessels' names, where known."""
    recent = positions.where(F.col("timestamp_ms") >= now_ms - age_s * 1000)
    return recent.join(metadata, "mmsi", "left")


def aircraft(rows: DataFrame, ranges: Sequence[tuple[int, int, str]]) -> DataFrame:
    """Positions in metric units with branch by id range; "ground" has no altitude."""
    from ..functions.classify import in_ranges
    from ..functions.numbers import feet_to_metres, hex_number, knots_to_ms

    number = hex_number("icao24").cast("long")
    return rows.withColumns({"altitude_m": feet_to_metres("alt_ft"), "speed_ms": knots_to_ms("speed_kn"), "military_branch": in_ranges(number, ranges)})


def seeds(spark: SparkSession, entries: Sequence[Mapping], required: Sequence[str], schema: str, least_route: int = 2) -> DataFrame:
    """A curated list as a table; entries without their keys or with too short a route are errors."""
    for e in entries:
        missing = [k for k in required if e.get(k) in (None, "")]
        if missing or len(e.get("route", [None] * least_route)) < least_route:
            raise ValueError(f"bad seed {e.get('id')}: {missing or 'route'}")
    return spark.createDataFrame([dict(e) for e in entries], schema)


def verified(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """A file's bytes; a hash other than the locked one fails the read."""
    files = spark.read.format("binaryFile").load(path)
    ok = F.sha2("content", 256) == sha256
    return files.select("path", F.when(ok, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("hash mismatch: "), F.col("path"))).cast("binary")).alias("content"))


def country_facts(rows: DataFrame, facts: Mapping[str, str]) -> DataFrame:
    """Sections of a country's JSON (column body) as label and value pairs: label to JSON path."""
    from ..functions.text import strip_html

    pairs = F.array(*[F.struct(F.lit(label).alias("label"), strip_html(F.get_json_object("body", path)).alias("value")) for label, path in facts.items()])
    return rows.withColumn("facts", F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != ""))


def articles(rows: DataFrame, queries: Sequence[str]) -> DataFrame:
    """Article search results for a fixed list of queries, one per URL, first query first."""
    from ..operators.upsert import first_by

    position = F.array_position(F.array(*[F.lit(q) for q in queries]), F.col("query"))
    return first_by(rows.where(position > 0), ["url"], [position, F.col("seen")])


#: How each table of the graph is written: its key, and rules for operators.upsert.upsert and sources.commits.folded.
GRAPH_KEYS: dict[str, list[str]] = {"document": ["url"], "entity": ["name", "type"], "event": ["event_key"], "location": ["loc_key"], "aircraft": ["icao24"], "incident": ["id"], "edge": ["src", "rel", "dst"], "spotted_at": ["icao24", "dedup_key"], "corroborated_by": ["src", "dst"]}
GRAPH_RULES: dict[str, dict[str, str]] = {
    "document": {"title": "always", "source": "always"},
    "entity": {"aliases": "append_distinct", "last_seen": "max"},
    "event": {"title": "create", "summary": "create", "codebook_type": "create", "severity": "create", "confidence": "create", "timeline_at": "create", "time_basis": "create"},
    "location": {"country": "create", "name": "create", "lat": "create", "lon": "create", "basis": "create", "scope_key": "coalesce"},
    "aircraft": {"callsign": "always", "registration": "always", "type_code": "always", "branch": "always", "last_seen": "max"},
    "incident": {"trigger_s": "create", "kind": "always", "title": "always", "severity": "always", "status": "always", "lat": "always", "lon": "always", "location": "always"},
    "edge": {},
    "spotted_at": {"loc_key": "always", "lat": "always", "lon": "always", "altitude_m": "always", "speed_ms": "always", "heading": "always", "seconds": "always"},
    "corroborated_by": {"score": "always", "distance_km": "always", "days": "always"},
}


def text_of_event(row: Column) -> Column:
    """What is embedded of an event, 1500 characters at most."""
    return F.substring(F.concat_ws(" ", row["title"], F.array_join(row["themes"], " "), row["place"]), 1, 1500)
