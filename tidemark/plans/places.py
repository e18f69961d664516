"""Spatial queries. Coordinates are made from keys with whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.geo import concern_level, concern_score, correlation_strength, in_bbox, in_extent, rounded, two_decimals
from ..operators import spatial as sp
from ..session import table

LAT, LON = "(event_id * 7919 % 17000) / 100.0D - 85", "(event_id * 104729 % 36000) / 100.0D - 180"
SQL_LAT, SQL_LON = "(event_id * 7919 % 17000) / 100.0::DOUBLE - 85", "(event_id * 104729 % 36000) / 100.0::DOUBLE - 180"
SITES = [("alpha", 41.3, 129.1), ("bravo", 37.1, -116.0), ("charlie", -22.2, -138.7), ("delta", 73.0, 54.8), ("echo", 50.1, 78.8)]
BOXES = [("europe", 35.0, -10.0, 70.0, 40.0), ("middle", 12.0, 25.0, 42.0, 63.0), ("pacific", -50.0, 150.0, 50.0, -120.0)]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "ts", "event_type", "value", f"{LAT} as lat", f"{LON} as lon")


_P = f"p AS (SELECT event_id, ts, event_type, value, {SQL_LAT} AS lat, {SQL_LON} AS lon FROM events)"


def bbox_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07, FLT-08."""
    return _points(spark, sf_dir).where(in_bbox("lat", "lon", 10.0, -20.0, 55.0, 60.0)).select("event_id")


def bbox_dateline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-07, FLT-09, FLT-15."""
    extent = {"south": -30.0, "west": 160.0, "north": 40.0, "east": -150.0}
    return _points(spark, sf_dir).where(in_extent("lat", "lon", extent)).select("event_id")


def region_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-22."""
    return _points(spark, sf_dir).select("event_id", classify.region("lat", "lon", BOXES).alias("region"))


def nearest_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-07; distances to whole kilometres."""
    near = sp.nearest_site(_points(spark, sf_dir), SITES, 1500.0)
    return near.where("nearest_site is not null").select("event_id", "nearest_site", F.round("distance_km", 3).alias("distance_km"))


_HAV = "2 * 6371.0 * asin(sqrt(least(pow(sin((radians({b}.lat) - radians({a}.lat)) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin((radians({b}.lon) - radians({a}.lon)) / 2), 2), 1.0)))"
_S = "s AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {o}::DOUBLE)" for n, a, o in SITES) + ") t(site, lat, lon))"


def concern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and level of tremors near sites."""
    near = sp.nearest_site(_points(spark, sf_dir), SITES, 1500.0).where("nearest_site is not null")
    score = concern_score(F.expr("value / 80"), F.expr("cast(event_id % 40 as double)"), F.col("distance_km") / 15)
    return near.select("event_id", F.round(score, 4).alias("score"), concern_level(score).alias("level"))


def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-06: errors and purchases within 300 km and a day whose score reaches 0.3."""
    p = _points(spark, sf_dir).select(F.col("event_id").alias("id"), "lat", "lon", F.to_date("ts").alias("day"), "event_type")
    met = sp.near_pairs(p.where("event_type = 'error'").drop("event_type"), p.where("event_type = 'purchase'").drop("event_type"), 300.0, 1, 3.0)
    strength = correlation_strength(F.col("distance_km"), F.col("days"), F.expr("a_id % 5 = 0"), F.expr("a_id % 2 = 0"), F.expr("b_id % 3 = 0"), 300.0)
    # columns of their own: rounding names its value often, and a step of much code is never compiled by the JVM
    scored = met.withColumn("strength", F.explode(F.array(strength)))
    scored = scored.withColumn("score", F.explode(F.array(F.least(two_decimals("strength"), F.lit(1.0))))).where("score >= 0.3")
    return scored.select("a_id", "b_id", "days", rounded("distance_km", 3).alias("distance_km"), "score")


def scope_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09, AGG-26, JN-14: one pass over orders with disjoint classes."""
    o = table(spark, sf_dir, "orders")
    conflict, stale = F.expr("o_custkey % 10 = 0"), F.expr("o_orderdate < timestamp_ntz'1995-01-01 00:00:00'")
    classes = {"conflict": conflict, "stale": stale, "included": F.expr("o_orderstatus <> 'P'")}
    return sp.accounting(o, classes)


def scope_filter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10, WIN-01, WIN-02: a customer's representative order in scope, first ten with the total."""
    from ..operators.timeline import ranked_first, samples

    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    inside = o.join(c.where("c_nationkey in (1, 2, 3)"), o.o_custkey == c.c_custkey).where("o_orderstatus in ('F', 'O')")
    rep = ranked_first(inside, ["c_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")])
    return samples(rep.select("c_custkey", "o_orderkey"), [F.col("o_orderkey").desc(), F.col("c_custkey")], 10)


def longitude_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22: the smallest circular extent of each user group's points."""
    p = _points(spark, sf_dir).selectExpr("event_id div 97 as grp", "lat", "lon").where("grp % 11 < 9 and (grp % 3 > 0 or lon > 100 or lon < -120)")
    return sp.longitude_extent(p, ["grp"], "lon", "lat")


def scope_token_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPA-06, SPA-07, SPA-17, T21: tokens of orders' nations and regions."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    evidence = rows.select(
        F.col("o_custkey").alias("doc"), F.when(F.col("o_orderstatus") == "F", "about").otherwise("occurrence").alias("relation"),
        F.concat(F.lit("world:r"), F.col("n_regionkey").cast("string"), F.lit(":n"), F.col("n_nationkey").cast("string")).alias("scope"), F.expr("o_orderkey % 40 = 0").alias("conflict"),
    )
    got = sp.scope_tokens(evidence, "doc")
    return got.select("doc", F.array_join("tokens", ",").alias("tokens"), F.array_join("withheld", ",").alias("withheld"))


def spatial_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPA-01 to SPA-05, JN-08: scopes of points by codes and by polygons."""
    box = lambda k, w, s, e, n: {"key": k, "rings": [[(w, s), (e, s), (e, n), (w, n), (w, s)]]}
    catalog = [box("world:a", -60, -60, 20, 60), box("world:b", 20, -60, 120, 60), box("world:a:1", -60, 0, 20, 60)]
    p = sp.locate(_points(spark, sf_dir), catalog)
    codes = F.when(F.expr("event_id % 5 = 0"), F.array(F.lit("world:a"))).when(F.expr("event_id % 5 = 1"), F.array(F.lit("world:b"))).otherwise(F.array().cast("array<string>"))
    lost = F.when(F.expr("event_id % 17 = 0"), F.array(F.lit("zz"))).otherwise(F.array().cast("array<string>"))
    deepest = F.filter("inside", lambda s: ~F.exists("inside", lambda t: t.startswith(F.concat(s, F.lit(":")))))
    p = p.withColumns({"explicit": codes, "unresolved": lost, "located": deepest})
    n = sp.normalize_scope(F.col("explicit"), F.col("unresolved"), F.col("located"), F.col("edge"))
    return p.select("event_id", n["scope"].alias("scope"), n["status"].alias("status"), sp.precision(F.size("located") > 0, n["scope"]).alias("precision"))


QUERIES = {
    f.__name__: f
    for f in (bbox_plain, bbox_dateline, region_classify, nearest_site, concern, correlation_pairs, scope_accounting, scope_filter_samples, longitude_extent, scope_token_projection, spatial_normalize)
}
QUERIES["concern_score"] = QUERIES.pop("concern")

_IN = lambda s, w, n, e: f"lat BETWEEN {s} AND {n} AND " + (f"lon BETWEEN {w} AND {e}" if w <= e else f"(lon >= {w} OR lon <= {e})")
_NEAR = f"""n AS (SELECT p.event_id, p.value, s.site, {_HAV.format(a='p', b='s')} AS km FROM p, s),
m AS (SELECT * FROM n WHERE km <= 1500 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY km, site) = 1)"""
_SCORE = "CAST(printf('%.2f', (least(value / 80, 9.0::DOUBLE) / 9.0::DOUBLE * 0.45::DOUBLE + greatest((40.0::DOUBLE - least(km / 15, 40.0::DOUBLE)) / 40.0::DOUBLE, 0) * 0.35::DOUBLE + greatest(1 - (event_id % 40) / 10.0::DOUBLE, 0) * 0.15::DOUBLE) * 100) AS DOUBLE)"

ORACLE = {
    "bbox_plain": f"WITH {_P} SELECT event_id FROM p WHERE {_IN(10, -20, 55, 60)}",
    "bbox_dateline": f"WITH {_P} SELECT event_id FROM p WHERE {_IN(-30, 160, 40, -150)}",
    "region_classify": f"WITH {_P} SELECT event_id, CASE " + " ".join(f"WHEN {_IN(s, w, n, e)} THEN '{k}'" for k, s, w, n, e in BOXES) + " ELSE 'unknown' END AS region FROM p",
    "nearest_site": f"WITH {_P}, {_S}, {_NEAR} SELECT event_id, site AS nearest_site, round(km, 3) AS distance_km FROM m",
    "concern_score": f"WITH {_P}, {_S}, {_NEAR}, x AS (SELECT event_id, {_SCORE} AS sc FROM m) SELECT event_id, round(sc, 4) AS score, CASE WHEN sc >= 75 THEN 'critical' WHEN sc >= 50 THEN 'elevated' WHEN sc >= 25 THEN 'moderate' END AS level FROM x",
    "correlation_pairs": f"""WITH {_P}, x AS (SELECT a.event_id AS a_id, b.event_id AS b_id, abs(date_diff('day', a.ts::DATE, b.ts::DATE)) AS days, {_HAV.format(a='a', b='b')} AS km FROM p a JOIN p b ON a.event_type = 'error' AND b.event_type = 'purchase' AND abs(date_diff('day', a.ts::DATE, b.ts::DATE)) <= 1)
SELECT * FROM (SELECT a_id, b_id, CAST(days AS INTEGER) AS days, round(km, 3) AS distance_km, least(1.0::DOUBLE, CAST(printf('%.2f', greatest(1 - km / 300.0::DOUBLE, 0) * CASE WHEN days = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + (CASE WHEN a_id % 5 = 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN b_id % 3 = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN a_id % 2 = 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)) AS DOUBLE)) AS score FROM x WHERE km <= 300) WHERE score >= 0.3""",
    "scope_accounting": """WITH k AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN 'conflict' WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'stale' WHEN o_orderstatus <> 'P' THEN 'included' ELSE 'unsupported' END AS c FROM orders)
SELECT count(*) AS candidate, count(*) FILTER (WHERE c = 'conflict') AS conflict, count(*) FILTER (WHERE c = 'stale') AS stale, count(*) FILTER (WHERE c = 'included') AS included, count(*) FILTER (WHERE c = 'unsupported') AS unsupported, true AS reconciled FROM k""",
    "scope_filter_samples": """WITH i AS (SELECT c_custkey, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (1, 2, 3) AND o_orderstatus IN ('F', 'O') QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1)
SELECT c_custkey, o_orderkey, (SELECT count(*) FROM i) AS total, (SELECT count(*) FROM i) > 10 AS truncated FROM i ORDER BY o_orderkey DESC, c_custkey LIMIT 10""",
    "longitude_extent": f"""WITH {_P}, q AS (SELECT event_id // 97 AS grp, lat, lon FROM p), r AS (SELECT * FROM q WHERE grp % 11 < 9 AND (grp % 3 > 0 OR lon > 100 OR lon < -120)),
d AS (SELECT DISTINCT grp, round(lon, 4) AS x FROM r), g AS (SELECT grp, x, coalesce(lead(x) OVER (PARTITION BY grp ORDER BY x), min(x) OVER (PARTITION BY grp) + 360.0) AS nxt FROM d),
w AS (SELECT grp, x, nxt FROM g QUALIFY row_number() OVER (PARTITION BY grp ORDER BY round(nxt - x, 4) DESC, x DESC) = 1)
SELECT w.grp, CASE WHEN nxt > 180 THEN round(nxt - 360.0, 4) ELSE nxt END AS west, x AS east, south, north FROM w JOIN (SELECT grp, min(lat) AS south, max(lat) AS north FROM r GROUP BY grp) l ON w.grp = l.grp""",
    "scope_token_projection": """WITH e AS (SELECT o_custkey AS doc, CASE WHEN o_orderstatus = 'F' THEN 'about' ELSE 'occurrence' END AS relation, 'world:r' || n_regionkey AS s1, 'world:r' || n_regionkey || ':n' || n_nationkey AS s2, o_orderkey % 40 = 0 AS conflict FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
g AS (SELECT doc, relation, bool_or(conflict) AS conflict, min(s1) AS s1, min(s2) AS s2 FROM e GROUP BY ALL),
t AS (SELECT doc, relation || ':' || s1 AS tok FROM g WHERE NOT conflict UNION ALL SELECT doc, relation || ':' || s2 FROM g WHERE NOT conflict)
SELECT d.doc, coalesce((SELECT string_agg(tok, ',' ORDER BY tok) FROM t WHERE t.doc = d.doc), '') AS tokens, coalesce((SELECT string_agg(relation, ',' ORDER BY relation) FROM g WHERE g.doc = d.doc AND g.conflict), '') AS withheld FROM (SELECT DISTINCT doc FROM e) d""",
    "spatial_normalize": f"""WITH {_P}, q AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'world:a' WHEN 1 THEN 'world:b' END AS own, event_id % 17 = 0 AS lost,
 CASE WHEN lon > -60 AND lon < 20 AND lat > 0 AND lat < 60 THEN 'world:a:1' WHEN lon > -60 AND lon < 20 AND lat > -60 AND lat < 60 THEN 'world:a' WHEN lon > 20 AND lon < 120 AND lat > -60 AND lat < 60 THEN 'world:b' END AS there,
 (lat BETWEEN -60 AND 60 AND (lon = -60 OR lon = 20 OR lon = 120)) OR (abs(lat) = 60 AND lon BETWEEN -60 AND 120) OR (lat = 0 AND lon BETWEEN -60 AND 20) AS edge FROM p),
c AS (SELECT *, coalesce(own IS NOT NULL AND there IS NOT NULL AND NOT starts_with(there, own), false) OR edge AS conflict FROM q),
s AS (SELECT *, CASE WHEN lost THEN NULL WHEN there IS NOT NULL AND (own IS NULL OR starts_with(there, own)) AND NOT conflict THEN there ELSE own END AS scope FROM c)
SELECT event_id, scope, CASE WHEN lost THEN 'unresolved' WHEN scope IS NULL THEN 'none' WHEN conflict THEN 'conflict' ELSE 'resolved' END AS status,
 CASE WHEN there IS NOT NULL THEN 'point' WHEN len(string_split(scope, ':')) >= 4 THEN 'admin2' WHEN len(string_split(scope, ':')) = 3 THEN 'admin1' WHEN len(string_split(scope, ':')) = 2 THEN 'country' ELSE 'none' END AS precision FROM s""",
}
