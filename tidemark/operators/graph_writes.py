"""What feeds write into the graph, as rows of its tables for one commit (``sources.commits``).

Each function gives a dictionary of tables, with the keys and rules of ``sources.feeds.GRAPH_KEYS`` and
``GRAPH_RULES``. Equal rows of a batch are one. Ends of edges are ``kind:key``. Where several tables are made from the
same rows, ``keep`` gets a name and these rows; it may write them and give the written table
(``CommittedTables.write``), so that they are worked out once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, dates, keys

#: The tables that come with one row per key from each function here.
ONE_A_KEY = ("entity", "event", "location", "aircraft", "edge", "spotted_at", "corroborated_by")
Keep = Callable[[str, DataFrame], DataFrame]


def _same(name: str, rows: DataFrame) -> DataFrame:
    return rows


def _end(kind: str, *key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("|", *key))


def _edges(rows: DataFrame, src: Column, rel: str, dst: Column) -> DataFrame:
    return rows.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst")).distinct()


def extraction_tables(docs: DataFrame, ingested_at: str, aliases: Mapping[str, str] | None = None, keep: Keep = _same) -> dict[str, DataFrame]:
    """Documents, entities, events, a country's location, and edges from rows with ``outcome`` (see ``operators.extraction``).

    docs: url, title, source, outcome, and any of occurred_at, observed_at, published_at (texts) and doc_hash. Only
    rows whose outcome is ok and holds an event or an entity are written. Names are
    canonicalised by ``aliases`` (spelling to canonical name; the spelling stays as an alias); an unknown type of entity
    passes as it is. An event is anchored at the first time that can be read: the feed's occurrence or else
    the extracted one, observation, publication, ingestion. The document's country counts only if all its
    locations name one and the same code of two capitals."""
    has = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    ok = (F.col("outcome.status") == "ok") & ((F.size("outcome.events") > 0) | (F.size("outcome.entities") > 0))
    wide = docs.where(ok & F.col("url").isNotNull()).select("url", "title", "source", "outcome", *[has(c).alias(c) for c in ("occurred_at", "observed_at", "published_at")], F.coalesce(has("doc_hash"), keys.content_hash("title", "url")).alias("doc_hash"))
    tables = {"document": wide.select("url", "title", "source").distinct()}

    e = wide.select("url", F.explode("outcome.entities").alias("e")).select("url", F.col("e.name").alias("spelling"), "e.type")
    canonical = F.try_element_at(F.create_map(*[F.lit(x) for pair in (aliases or {"": ""}).items() for x in pair]), F.col("spelling"))
    e = e.select("url", F.coalesce(canonical, "spelling").alias("name"), F.coalesce(classify.known_entity_type("type"), "type").alias("type"), F.when(canonical != F.col("spelling"), F.array("spelling")).otherwise(F.array().cast("array<string>")).alias("aliases"))
    spelt = e.select("name", "type", F.explode_outer("aliases").alias("alias")).distinct()
    tables["entity"] = spelt.groupBy("name", "type").agg(F.array_sort(F.collect_list("alias")).alias("aliases"), F.lit(ingested_at).alias("last_seen"))

    v = wide.select("*", F.explode("outcome.events").alias("v"))
    at, basis = dates.anchor(occurred=dates.iso_instant(F.coalesce("occurred_at", "v.timestamp")), observed=dates.iso_instant("observed_at"), published=dates.iso_instant("published_at"), ingested=F.lit(ingested_at).cast("timestamp"))
    event_key = keys.event_key("doc_hash", "v.codebook_type", "v.title")
    v = keep("described", v.select("url", event_key.alias("event_key"), *[F.col(f"v.{c}").alias(c) for c in ("title", "summary", "codebook_type", "severity", "confidence")], at.alias("timeline_at"), basis.alias("time_basis")))
    first = F.min(F.struct("codebook_type", "title", "summary", "severity", "confidence", "timeline_at", "time_basis")).alias("f")
    tables["event"] = v.groupBy("event_key").agg(first).select("event_key", "f.title", "f.summary", "f.codebook_type", "f.severity", "f.confidence", "f.timeline_at", "f.time_basis")

    codes = F.array_distinct(F.transform("outcome.locations", lambda x: F.coalesce(F.when(x["country"].rlike("^[A-Z]{2}$"), x["country"]), F.lit(""))))
    country = F.when((F.size(codes) == 1) & (codes[0] != ""), codes[0])
    placed = wide.select("url", country.alias("country")).where("country is not null")
    loc = F.concat(F.lit("spatial:country:"), F.lower("country"))
    tables["location"] = placed.select(loc.alias("loc_key"), "country", F.lit("source_country_code").alias("basis")).distinct()

    mentions = _edges(e, _end("document", F.col("url")), "MENTIONS", _end("entity", F.col("name"), F.col("type")))
    describes = _edges(v, _end("document", F.col("url")), "DESCRIBES", _end("event", F.col("event_key")))
    occurred = _edges(v.select("url", "event_key").join(placed.dropDuplicates(["url"]), "url"), _end("event", F.col("event_key")), "OCCURRED_AT", _end("location", loc))
    tables["edge"] = mentions.unionByName(describes).unionByName(occurred)
    return tables


def _there(lat: Column, lon: Column) -> Column:
    """A whole pair that isn't (0, 0)."""
    return lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))


def aircraft_tables(rows: DataFrame, keep: Keep = _same) -> dict[str, DataFrame]:
    """Aircraft, a location per observation and the sighting, from rows icao24, callsign, registration, type_code, branch, lat,
    lon, altitude_m, speed_ms, heading, seconds. Observations of one quarter of an hour are one, the last; one without a place
    updates the aircraft only."""
    rows = rows.where("icao24 is not null and seconds is not null")
    last = lambda *columns: F.max(F.struct("seconds", *columns)).alias("l")
    craft = rows.groupBy("icao24").agg(last("callsign", "registration", "type_code", "branch"))
    seen = rows.where(_there(F.col("lat"), F.col("lon"))).groupBy("icao24", keys.quarter_hour("seconds").alias("quarter")).agg(last("lat", "lon", "altitude_m", "speed_ms", "heading"))
    seen = seen.withColumn("dedup_key", F.concat_ws("|", "icao24", F.col("quarter").cast("string")))
    seen = keep("spotted_at", seen.select("icao24", "dedup_key", F.concat(F.lit("aircraft-observation:"), "dedup_key").alias("loc_key"), "l.lat", "l.lon", "l.altitude_m", "l.speed_ms", "l.heading", "l.seconds"))
    return {
        "aircraft": craft.select("icao24", "l.callsign", "l.registration", "l.type_code", "l.branch", F.col("l.seconds").alias("last_seen")),
        "location": seen.select("loc_key", "lat", "lon", F.lit("observation").alias("basis")),
        "spotted_at": seen,
    }


def incident_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Incidents (id, kind, title, severity, status, trigger_s, lat, lon, location) and the place of those that have one."""
    rows = rows.where("id is not null")
    loc = keys.incident_location_key("lat", "lon", "location")
    placed = rows.where(_there(F.col("lat"), F.col("lon"))).withColumn("loc_key", loc)
    at = placed.groupBy("loc_key").agg(F.min(F.struct("lat", "lon", F.col("location").alias("name"))).alias("p"))
    return {
        "incident": rows,
        "location": at.select("loc_key", "p.*", F.lit("incident_report").alias("basis")),
        "edge": _edges(placed, _end("incident", F.col("id").cast("string")), "OCCURRED_AT", _end("location", F.col("loc_key"))),
    }


def corroboration_table(pairs: DataFrame) -> dict[str, DataFrame]:
    """One edge per pair of documents (src, dst) with score, distance_km and days; the last commit's values stay."""
    one = pairs.groupBy("src", "dst").agg(F.max(F.struct("score", "distance_km", "days")).alias("b"))
    return {"corroborated_by": one.select("src", "dst", "b.*")}

