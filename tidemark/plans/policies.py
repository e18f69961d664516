"""Queries of parameterised filters, backfills and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..operators import enrich as e
from ..operators import filters as f
from ..session import table

SPEC = {"must": [{"key": "p_size", "range": {"gte": 5, "lt": 40}}], "should": [{"key": "p_type", "any": ["ECONOMY", "SMALL"]}, {"must": [{"key": "p_brand", "match": "Brand#4"}], "must_not": [{"key": "p_retailprice", "range": {"gt": 1500}}]}], "must_not": [{"key": "p_name", "match": "red widget"}, {"key": "p_type", "is_empty": True}]}


def payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12, FLT-13."""
    return table(spark, sf_dir, "part").where(f.payload_filter(SPEC)).select("p_partkey")


def token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14: orders whose tokens are about or occur in a scope."""
    scope = F.concat(F.lit("world:n"), F.expr("o_custkey % 25").cast("string"))
    token = F.concat(F.when(F.col("o_orderstatus") == "F", "about").otherwise("occurrence"), F.lit(":sr1|"), scope, F.lit("|r"), F.expr("o_orderkey % 3").cast("string"))
    o = table(spark, sf_dir, "orders").withColumn("tokens", F.array(token))
    return o.where(f.token_filter(F.col("tokens"), "either", "world:n7", ["r0", "r2"])).select("o_orderkey")


def country_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-26: customers that name a nation by number or name."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation").where("n_nationkey = 4")
    one = n.select(F.upper(F.substring("n_name", -3, 3)).alias("iso3"), F.col("n_nationkey").alias("m49"), F.col("n_name").alias("country"))
    named = c.select("c_custkey", F.when(F.expr("c_custkey % 2 = 0"), F.col("c_nationkey").cast("string")).alias("a"), F.concat(F.lit(" nation_"), F.expr("c_custkey % 30").cast("string")).alias("b"))
    hit = f.same_country({"a": F.col("a"), "b": F.col("b")}, F.col("iso3"), F.col("m49"), F.col("country"))
    return named.join(F.broadcast(one), hit).select("c_custkey")


def due_teasers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-30: the first hundred orders that are due."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").alias("state"), F.expr("if(o_orderkey % 4 = 0, null, o_orderkey * 7 % 1000)").alias("next_s"), F.expr("o_custkey % 7").alias("attempts"))
    return f.due_teasers(o, 500, 100).select("id")


def viewport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-31."""
    from .places import LAT, LON

    ev = table(spark, sf_dir, "events").selectExpr("event_id as id", f"{LAT} as lat", f"{LON} as lon", "value")
    return f.viewport(ev, "lat", "lon", (-20.0, -60.0, 60.0, 90.0), F.col("value"), 75).select("id")


def linked_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-25: the five dearest orders of each part."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    links = li.select(F.col("l_partkey").alias("url"), F.col("l_orderkey").alias("event_id"))
    return e.linked_pairs(links, o.select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("score"))).select("url", "event_id", "place")


def geo_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-26."""
    from .places import LAT, LON

    ev = table(spark, sf_dir, "events")
    raw = ev.selectExpr("event_id", f"if(event_id % 5 = 0, null, {LAT}) as lat", f"{LON} as lon")
    return e.geo_backfill(ev.select("event_id"), ev.where("event_type = 'click'").select("event_id"), raw).select("event_id", "lat", "lon")


def candidate_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-18: orders of two runs by customer, first recorded date and last status."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("recorded"), F.col("o_orderkey").alias("row"))
    got = e.rows_of(o.where("row % 2 = 0"), o.where("row % 2 = 1"), "id", "recorded")
    return got.select("id", F.col("recorded.o_orderkey").alias("first_row"), F.col("row").alias("last_row"))


def judge_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-19."""
    o = table(spark, sf_dir, "orders").select(F.sha2(F.concat_ws("|", "o_custkey", "o_orderpriority"), 256).alias("relation_hash"), "o_orderkey", "o_orderstatus")
    cache = o.where("o_orderkey % 3 = 0").select("relation_hash", F.lit("v1").alias("config"), F.when(F.col("o_orderstatus") == "P", "error").otherwise("ok").alias("verdict"))
    return e.judge_misses(o, cache, "v1").select("o_orderkey")


def skipped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-27."""
    return e.skipped_by_type(table(spark, sf_dir, "part"), "p_type", F.col("p_size") > 10)


def hotspot_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24, PRJ-15: part names that hold each word, with the shifted level."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    hot = p.select(F.element_at(F.split("title", " "), 1).alias("keyword")).distinct().select(F.concat(F.lit("h-"), "keyword").alias("hotspot"), "keyword")
    got = e.hotspot_mentions(p, hot)
    return got.withColumn("level", classify.shifted_level(F.lit(2), "mentions"))


QUERIES = {q.__name__: q for q in (payload_filter, token_filter, country_signals, due_teasers, viewport, linked_evidence, geo_backfill, candidate_rewrite, judge_misses, skipped_items, hotspot_mentions)}

_LATLON = "(event_id * 7919 % 17000) / 100.0::DOUBLE - 85 AS lat, (event_id * 104729 % 36000) / 100.0::DOUBLE - 180 AS lon"
ORACLE = {
    "payload_filter": "SELECT p_partkey FROM part WHERE p_size >= 5 AND p_size < 40 AND (p_type IN ('ECONOMY', 'SMALL') OR (p_brand = 'Brand#4' AND NOT p_retailprice > 1500)) AND p_name <> 'red widget' AND coalesce(p_type, '') <> ''",
    "token_filter": "SELECT o_orderkey FROM orders WHERE o_custkey % 25 = 7 AND o_orderkey % 3 IN (0, 2)",
    "country_signals": "SELECT c_custkey FROM customer WHERE (c_custkey % 2 = 0 AND c_nationkey = 4) OR c_custkey % 30 = 4",
    "due_teasers": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 7 < 5 AND (o_orderkey % 4 = 0 OR o_orderkey * 7 % 1000 <= 500) ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_orderkey * 7 % 1000 END, id LIMIT 100",
    "viewport": f"WITH p AS (SELECT event_id AS id, value, {_LATLON} FROM events) SELECT id FROM p WHERE lat BETWEEN -20 AND 60 AND lon BETWEEN -60 AND 90 ORDER BY value DESC, id LIMIT 75",
    "linked_evidence": "WITH l AS (SELECT DISTINCT l_partkey AS url, l_orderkey AS event_id FROM lineitem) SELECT url, event_id, CAST(row_number() OVER (PARTITION BY url ORDER BY o_totalprice DESC, event_id) AS INTEGER) AS place FROM l JOIN orders ON event_id = o_orderkey QUALIFY place <= 5",
    "geo_backfill": f"SELECT * FROM (SELECT event_id, {_LATLON} FROM events WHERE event_type <> 'click' AND event_id % 5 <> 0) WHERE NOT (lat = 0 AND lon = 0)",
    "candidate_rewrite": "SELECT o_custkey AS id, arg_min(o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS first_row, arg_max(o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS last_row FROM orders GROUP BY 1",
    "judge_misses": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM orders c WHERE c.o_orderkey % 3 = 0 AND c.o_orderstatus <> 'P' AND c.o_custkey = orders.o_custkey AND c.o_orderpriority = orders.o_orderpriority)",
    "skipped_items": "SELECT p_type, count(*) AS skipped FROM part WHERE NOT p_size > 10 GROUP BY 1",
    "hotspot_mentions": """WITH h AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS k FROM part), n AS (SELECT k, least(count(p_partkey), 100) AS m FROM h LEFT JOIN part ON list_contains(string_split_regex(lower(p_name), '[^a-z0-9]+'), lower(k)) GROUP BY k)
SELECT 'h-' || k AS hotspot, m AS mentions, CAST(least(greatest(2 + CASE WHEN m > 30 THEN 2 WHEN m > 15 THEN 1 WHEN m < 2 THEN -1 ELSE 0 END, 1), 5) AS INTEGER) AS level FROM n""",
}
