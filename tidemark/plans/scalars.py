"""Column functions over whole tables: names, numbers, places, times and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, dates, geo, numbers, text
from ..operators import catalog, texts, upsert
from ..session import table
from . import places


def scalar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, keys of names, clipped and quoted texts, countries and headquarters."""
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(left(text, 60), '') as t", "coalesce(text, '') as whole", "lang", "source")
    tail = F.expr("element_at(array('Bayern', '80331 Ort', 'Niederlande', 'Berlin', 'Frankreich'), cast(doc_id % 5 as int) + 1)")
    address = F.concat(F.lit("Weg 1, "), F.lpad(F.col("doc_id").cast("string"), 5, "1"), F.lit(" Stadt, "), tail, F.lit(" / Zweig, Ausland"))
    place = text.headquarters(address)
    listed = F.concat(F.lit(";"), "lang", F.lit(";;"), "source", F.lit(";"))
    return d.select(
        "doc_id", text.slug("t").alias("slug"), text.folded_slug("t").alias("folded"), text.entity_name("t").alias("entity"), text.exact_name("t").alias("exact"), text.facility_key("t").alias("facility"),
        F.array_join(text.split_list(listed), "+").alias("parts"), text.clip("whole", 200).alias("clipped"), text.neutral_headers(F.concat(F.lit("## a\n"), "lang", F.lit("\n[BOX] b\n===\nplain"))).alias("quoted"),
        place["city"].alias("city"), place["country"].alias("country"), text.graph_country(place["country"]).alias("graph_country"),
    )


_WS = "[ \\t\\n\\r\\f\\x0b]+"
_NAMES = rf"""WITH d AS (SELECT doc_id, coalesce(left(text, 60), '') AS t, coalesce(text, '') AS whole, lang, source, ['Bayern', '80331 Ort', 'Niederlande', 'Berlin', 'Frankreich'][doc_id % 5 + 1] AS tail, list_filter(range(1, 8), lambda d: len(CAST(len(coalesce(text, '')) - 189 + d AS VARCHAR)) = d)[-1] AS digits FROM documents)
SELECT doc_id, trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(replace(strip_accents(lower(t)), 'ß', ''), '[^a-z0-9]+', '-', 'g'), '-') AS folded,
 trim(regexp_replace(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}_ \t\n\r\f]', ' ', 'g'), '{_WS}', ' ', 'g')) AS entity, trim(regexp_replace(replace(lower(t), 'ß', 'ss'), '{_WS}', ' ', 'g')) AS exact, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS facility,
 lang || '+' || source AS parts, CASE WHEN len(whole) <= 200 THEN whole ELSE left(whole, 189 - digits) || '… [+' || (len(whole) - 189 + digits) || ' chars]' END AS clipped,
 '> ## a' || chr(10) || lang || chr(10) || '> [BOX] b' || chr(10) || '> ===' || chr(10) || 'plain' AS quoted,
 CASE WHEN doc_id % 5 = 1 THEN 'Ort' ELSE 'Stadt' END AS city, CASE WHEN doc_id % 5 IN (0, 1, 3) THEN 'Deutschland' ELSE tail END AS country, CASE WHEN doc_id % 5 IN (0, 1, 3) THEN 'Germany' WHEN doc_id % 5 = 2 THEN 'Netherlands' ELSE 'France' END AS graph_country FROM d"""


def scalar_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-10 and numbers out of German texts: whole ones with dots, scaled decimals, years, hexadecimal ranges, lengths."""
    p = table(spark, sf_dir, "part").selectExpr("*", "concat('ca. ', p_partkey % 900 + 1, '.', lpad(cast(p_size as string), 3, '0'), ' Leute seit ', 1850 + p_partkey % 200, ', neu ', 1900 + p_size) as t")
    money = F.expr("concat('rund ', p_size, ',5 ', element_at(array('Millionen', 'Mrd', 'Euro'), cast(p_partkey % 3 as int) + 1))")
    return p.select(
        "p_partkey", numbers.first_integer("t").alias("people"), F.round(numbers.scaled_decimal(money)).cast("long").alias("money"), numbers.first_year("t").alias("first_year"), numbers.last_year("t").alias("last_year"),
        numbers.hex_number(F.lower(F.hex("p_partkey"))).cast("long").alias("number"), classify.in_ranges(numbers.hex_number(F.hex("p_partkey")).cast("long"), [(0, 99, "low"), (100, 999, "middle")], "high").alias("range"),
        numbers.length_km(F.concat(F.format_string("%,d", F.col("p_partkey") * 7), F.lit(" km"))).cast("long").alias("km"), F.round(numbers.feet_to_metres(F.when(F.col("p_size") > 40, "ground").otherwise(F.col("p_size").cast("string"))) * 10).cast("long").alias("decimetres"),
    )


_NUMBERS = """SELECT p_partkey, (p_partkey % 900 + 1) * 1000 + p_size AS people,
 CASE WHEN p_partkey % 3 = 2 THEN CAST(floor(p_size + 0.5 + 0.5) AS BIGINT) ELSE (p_size::BIGINT * 10 + 5) * [100000::BIGINT, 100000000, 1][p_partkey % 3 + 1] END AS money, 1850 + p_partkey % 200 AS first_year, 1900 + p_size AS last_year, p_partkey AS number,
 CASE WHEN p_partkey < 100 THEN 'low' WHEN p_partkey < 1000 THEN 'middle' ELSE 'high' END AS range, p_partkey * 7 AS km, CASE WHEN p_size <= 40 THEN CAST(round(round(p_size * 0.3048::DOUBLE, 1) * 10) AS BIGINT) END AS decimetres FROM part"""
_NUMBERS = f"SELECT p_partkey, CAST(people AS BIGINT) AS people, money, CAST(first_year AS INTEGER) AS first_year, CAST(last_year AS INTEGER) AS last_year, number, range, km, decimetres FROM ({_NUMBERS})"


def scalar_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of texts and links, degrees and minutes, capitals, rings: area and unwrapping; SPA-08, SPA-14."""
    p = table(spark, sf_dir, "events").selectExpr("event_id", f"{places.LAT} as lat", f"{places.LON} as lon")
    ring = F.expr("array(struct(179.0D as x, lat as y), struct(-179.0D as x, lat as y), struct(-179.0D as x, lat + event_id % 4 as y), struct(179.0D as x, lat + event_id % 4 as y), struct(179.0D as x, lat as y))")
    wkt, link = geo.wkt_point(F.concat(F.lit("POINT ("), "lon", F.lit(" "), "lat", F.lit(")"))), geo.map_url_point(F.concat(F.lit("https://maps/@"), "lon", F.lit(","), "lat", F.lit(",9z")))
    key = F.expr("element_at(array('world', 'country:DEU', 'admin1:DEU:BY', 'admin2:DEU:BY:1', 'country:de'), cast(event_id % 5 as int) + 1)")
    cents = lambda c: F.round(c * 100).cast("long")
    got = p.select(
        "event_id", cents(wkt["lat"]).alias("wkt_lat"), cents(link["lon"]).alias("link_lon"), geo.dms(F.col("event_id") % 90 + 0.5, "N", "S").alias("dms"), geo.plausible_capital("lat", "lon", F.lit(0.0), F.lit(0.0)).alias("capital"),
        cents(geo.signed_area(geo.unwrapped(ring))).alias("area"), cents(F.array_max(F.transform(geo.unwrapped(ring), lambda q: q["x"]))).alias("east"), catalog.scope_depth(key).alias("depth"), catalog.valid_scope_key(key).alias("valid"),
        F.round(geo.orbit_period_minutes(F.col("event_id") % 15 + 1) * 1000).cast("long").alias("period"),
    )
    return catalog.unavailable(got, "no place", "v1").selectExpr("*", "concat_ws('|', spatial.status, spatial.reason, size(spatial.about_tokens), spatial.conflict) as spatial_text").drop("spatial")


_PLACES = f"""WITH p AS (SELECT event_id, {places.SQL_LAT} AS lat, {places.SQL_LON} AS lon FROM events)
SELECT event_id, CAST(round(lat * 100) AS BIGINT) AS wkt_lat, CAST(round(lon * 100) AS BIGINT) AS link_lon, (event_id % 90) || '°30''00"N' AS dms, 2 * 6371.0 * asin(sqrt(least(pow(sin(radians(lat) / 2), 2) + cos(radians(lat)) * pow(sin(radians(lon) / 2), 2), 1.0))) <= 5000 AS capital,
 CAST(event_id % 4 * 200 AS BIGINT) AS area, CAST(18100 AS BIGINT) AS east, [0, 1, 2, 3, NULL][event_id % 5 + 1]::INTEGER AS depth, event_id % 5 < 4 AS valid, CAST(round(1440.0::DOUBLE / (event_id % 15 + 1) * 1000) AS BIGINT) AS period, 'unavailable|no place|0|false' AS spatial_text FROM p"""


def scalar_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-08 and times: compact and tolerant ones, dates apart, partitions, stamps of reports."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    compact = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    odd = F.when(F.col("o_orderkey") % 4 == 0, "soon").when(F.col("o_orderkey") % 4 == 1, F.concat(day, F.lit("T05:06:07Z"))).when(F.col("o_orderkey") % 4 == 2, F.concat(day, F.lit("T05:06:07+02:00")))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return o.select(
        "o_orderkey", show(dates.compact_instant(F.when(F.col("o_orderkey") % 3 > 0, compact).otherwise("2024"))).alias("compact"), show(dates.iso_instant(odd)).alias("instant"),
        dates.event_date(F.lit(""), F.when(F.col("o_orderkey") % 2 == 0, " "), F.concat(day, F.lit("T00"))).alias("event_date"), dates.within_days(day, F.lit("1996-06-15"), 30).alias("near"), dates.partition_date(compact).alias("partition"), dates.report_stamp("o_orderdate").alias("stamp"),
    )


_TIMES = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS compact, CASE o_orderkey % 4 WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 05:06:07' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 03:06:07' END AS instant,
 strftime(o_orderdate, '%Y-%m-%d') AS event_date, abs(date_diff('day', o_orderdate::DATE, DATE '1996-06-15')) <= 30 AS near, strftime(o_orderdate, '%Y-%m-%d') AS partition,
 strftime(o_orderdate, '%d') || '·' || ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII'][month(o_orderdate)] AS stamp FROM orders"""


def scalar_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-20, FLT-24, PRJ-05, PRJ-13, PRJ-14, PRJ-17, DD-09, DD-12, TXT-07: classes of rows, bodies, sections of reports, and keys that would change."""
    o = table(spark, sf_dir, "orders")
    pick = lambda *words: F.expr(f"element_at(array({', '.join(repr(w) for w in words)}), cast(o_orderkey % {len(words)} as int) + 1)")
    kinds = ("rss", "telegram", "gdelt", "dataset", "notebooklm")
    written = classify.provenance(pick(*kinds, "mail"), F.when(F.col("o_orderkey") % 7 > 0, "p"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("2024"))
    body = F.concat(F.lit("[a](http://x)\n"), F.repeat(F.lit("A sentence of prose that is surely longer than forty-five.\n"), F.expr("cast(o_orderkey % 12 as int)")))
    sections = texts.report_sections(F.concat(F.lit("# Summary\n- one\n* two "), F.col("o_orderkey").cast("string"), F.lit("\n## Findings\ntext\n")))
    moved = upsert.rekey_plan(o.selectExpr("o_orderkey", "if(o_orderkey % 10 = 0, 'old', concat('k', o_custkey)) as current"), "current", F.concat(F.lit("k"), F.lit("")))
    got = o.select(
        "o_orderkey", classify.severity(pick("Low", " EXTREME ", "elevated", "odd")).alias("severity"), classify.severity_rank(pick("Low", " EXTREME ", "elevated", "odd")).alias("rank"), classify.name_prefix(pick("STARLINK-1", "starlinked", "GPS BIIF", "x"), [("STARLINK", "comms"), ("GPS", "nav")]).alias("satellite"),
        F.round(classify.credibility(F.when(F.col("o_custkey") % 3 == 0, "own"), pick(*kinds), {"own": 0.9}) * 100).cast("int").alias("credibility"), written["fault"].alias("fault"), written["published_at"].alias("published_at"), classify.dataset_provider(pick("usgs", "gdacs", "x")).alias("provider"),
        classify.known_entity_type(pick("person", "COUNTRY", "creature", "VESSEL")).alias("entity_type"), classify.source_tier(pick("Reuters live", "a blog", "THINK tank"), [("tier1", ["reuters"]), ("tier2", ["think"])]).alias("tier"),
        texts.prose_blocks(texts.clean_body(body)).alias("blocks"), texts.body_quality(texts.clean_body(body)).alias("good"), F.concat_ws("|", F.size(sections), sections[0]["heading"], F.array_join(sections[0]["bullets"], ","), sections[1]["heading"]).alias("sections"),
    )
    return got.join(moved.groupBy("o_orderkey").agg(F.count("*").alias("moved")), "o_orderkey", "left")


_CLASSES = """SELECT o_orderkey, ['low', 'critical', 'high', 'unknown'][o_orderkey % 4 + 1] AS severity, [1, 4, 3, 0][o_orderkey % 4 + 1]::INTEGER AS rank, ['comms', 'other', 'nav', 'other'][o_orderkey % 4 + 1] AS satellite,
 CASE WHEN o_custkey % 3 = 0 THEN 90 ELSE [60, 40, 50, 80, 60][o_orderkey % 5 + 1] END::INTEGER AS credibility, CASE WHEN o_orderkey % 6 = 5 THEN 'source_type' WHEN o_orderkey % 7 = 0 THEN 'provider' END AS fault, CASE WHEN o_orderkey % 2 = 1 THEN '2024' END AS published_at,
 ['usgs.gov', 'gdacs.org', NULL][o_orderkey % 3 + 1] AS provider, ['PERSON', 'COUNTRY', NULL, 'VESSEL'][o_orderkey % 4 + 1] AS entity_type, ['tier1', 'tier3', 'tier2'][o_orderkey % 3 + 1] AS tier, CAST(o_orderkey % 12 AS INTEGER) AS blocks,
 o_orderkey % 12 >= 2 AND 59 * (o_orderkey % 12) - 1 >= 400 AS good, '2|Summary|one,two ' || o_orderkey || '|Findings' AS sections, CAST(1 AS BIGINT) AS moved FROM orders"""

QUERIES = {f.__name__: f for f in (scalar_names, scalar_numbers, scalar_places, scalar_times, scalar_classes)}
ORACLE = {"scalar_names": _NAMES, "scalar_numbers": _NUMBERS, "scalar_places": _PLACES, "scalar_times": _TIMES, "scalar_classes": _CLASSES}
