"""Catalog queries: nations are countries, suppliers and customers carry codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as c
from ..session import table
from ..streaming import control
from .places import LAT, LON


def crosswalk_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-09, SPA-01: suppliers' codes in two systems against the nations."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    walk = n.where("n_nationkey % 6 > 0").select(F.lit("key").alias("system"), F.col("n_nationkey").cast("string").alias("code"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("scope"))
    walk = walk.unionByName(n.where("n_nationkey % 4 > 0").select(F.lit("name").alias("system"), F.col("n_name").alias("code"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("scope")))
    code = lambda system, value: F.struct(F.lit(system).alias("system"), value.alias("code"))
    codes = F.array(code("key", F.col("s_nationkey").cast("string")), code("name", F.concat(F.lit("NATION_"), F.expr("s_suppkey % 25").cast("string"))))
    got = c.resolve_codes(s.select("s_suppkey", codes.alias("codes")), walk, "s_suppkey", "codes")
    return got.select("s_suppkey", F.array_join("scopes", ",").alias("scopes"), F.array_join("unresolved", ",").alias("unresolved"))


def iso_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-24: pairs of codes that are one to one."""
    m = table(spark, sf_dir, "supplier").select(F.expr("s_nationkey").alias("iso3"), F.expr("if(s_suppkey % 10 = 0, s_nationkey + 1, s_nationkey)").alias("gec"))
    good, _ = c.one_to_one(m, "iso3", "gec", table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("iso3")))
    return good


def coordinate_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13."""
    ev = table(spark, sf_dir, "events").selectExpr(f"{LAT} as lat", f"{LON} as lon", f"{LAT} + if(event_id % 9 = 0, 1, 0) as lat2", f"{LON} as lon2")
    return c.disagreement(ev, "lat", "lon", "lat2", "lon2")


def alias_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-05: part names with their aliases."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit("--"))).alias("name"))
    aliases = table(spark, sf_dir, "part").where("p_name like 'red%'").select(F.col("p_name").alias("alias_key"), F.concat(F.lit("canon "), "p_name").alias("canonical")).distinct()
    return c.canonical_names(p, aliases, "name").select("p_partkey", "canonical", "via_alias")


def worst_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPA-15: orders' states per customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.element_at(F.array(*[F.lit(x) for x in c.COMPLETENESS]), (F.expr("o_orderkey % 37 % 4") + 1).cast("int")).alias("completeness"))
    return c.worst_completeness(o, "o_custkey", "completeness")


def missing_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-07: event types that each user lacks."""
    ev = table(spark, sf_dir, "events").where("event_id % 5 = 0")
    return c.missing_lanes(ev, "user_id", "event_type", ["error", "purchase", "signup"]).select("user_id", F.array_join("missing", ",").alias("missing"))


def sink_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-16: how far two sinks of the orders are."""
    o = table(spark, sf_dir, "orders")
    done = o.where("o_orderkey % 97 <> 40").select(F.lit("graph").alias("sink"), F.col("o_orderkey").alias("slice_id")).unionByName(o.where("o_orderkey < 500 or o_orderkey % 2 = 0").select(F.lit("vectors").alias("sink"), F.col("o_orderkey").alias("slice_id")))
    return control.sink_progress(o.select(F.col("o_orderkey").alias("slice_id")), done)


def admitted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-21: orders admitted per customer."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("queue"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("priority"))
    return control.admitted(o, 3).select("id", "admitted")


def operator_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-20: orders' states after an action."""
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "closed").otherwise("promoted")
    action = F.when(F.expr("o_orderkey % 3 = 0"), "silence").when(F.expr("o_orderkey % 3 = 1"), "promote")
    return table(spark, sf_dir, "orders").groupBy(status.alias("before"), control.transition(status, action).alias("after")).agg(F.count("*").alias("n"))


QUERIES = {q.__name__: q for q in (crosswalk_codes, iso_mapping, coordinate_disagreement, alias_canonical, worst_completeness, missing_lanes, sink_progress, admitted_items, operator_transitions)}

ORACLE = {
    "crosswalk_codes": """WITH k AS (SELECT 'key' AS system, CAST(n_nationkey AS VARCHAR) AS code, 'n' || n_nationkey AS scope FROM nation WHERE n_nationkey % 6 > 0 UNION ALL SELECT 'name', n_name, 'n' || n_nationkey FROM nation WHERE n_nationkey % 4 > 0),
e AS (SELECT s_suppkey, 'key' AS system, CAST(s_nationkey AS VARCHAR) AS code FROM supplier UNION ALL SELECT s_suppkey, 'name', 'NATION_' || (s_suppkey % 25) FROM supplier)
SELECT s_suppkey, coalesce(string_agg(DISTINCT scope, ',' ORDER BY scope), '') AS scopes, coalesce(string_agg(DISTINCT e.system || ':' || e.code, ',' ORDER BY e.system || ':' || e.code) FILTER (WHERE scope IS NULL), '') AS unresolved FROM e LEFT JOIN k ON k.system = e.system AND k.code = e.code GROUP BY s_suppkey""",
    "iso_mapping": """WITH p AS (SELECT DISTINCT s_nationkey AS iso3, CASE WHEN s_suppkey % 10 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS gec FROM supplier WHERE s_nationkey < 20)
SELECT iso3, gec FROM p QUALIFY count(*) OVER (PARTITION BY iso3) = 1 AND count(*) OVER (PARTITION BY gec) = 1""",
    "coordinate_disagreement": "SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 9 = 0) AS disagree, count(*) FILTER (WHERE event_id * 7919 % 17000 = 8500 AND event_id * 104729 % 36000 = 18000) AS null_island FROM events",
    "alias_canonical": "SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 'canon ' || p_name ELSE upper(replace(p_name, ' ', '--')) END AS canonical, p_name LIKE 'red%' AS via_alias FROM part",
    "worst_completeness": "SELECT o_custkey, ['unavailable', 'partial', 'approximate', 'complete'][min(o_orderkey % 37 % 4) + 1] AS completeness, count(*) AS consumers FROM orders GROUP BY 1",
    "missing_lanes": "WITH h AS (SELECT user_id, list(DISTINCT event_type) AS h FROM events WHERE event_id % 5 = 0 GROUP BY 1) SELECT user_id, array_to_string(list_filter(['error', 'purchase', 'signup'], lambda x: NOT list_contains(h, x)), ',') AS missing FROM h",
    "sink_progress": """WITH s AS (SELECT 'graph' AS sink, o_orderkey AS k, o_orderkey % 97 <> 40 AS ok FROM orders UNION ALL SELECT 'vectors', o_orderkey, o_orderkey < 500 OR o_orderkey % 2 = 0 FROM orders), b AS (SELECT sink, min(k) FILTER (WHERE NOT ok) AS bad FROM s GROUP BY sink)
SELECT s.sink, max(k) FILTER (WHERE ok AND (bad IS NULL OR k < bad)) AS pointer, count(*) FILTER (WHERE NOT ok) AS pending, max(k) AS newest FROM s JOIN b ON b.sink = s.sink GROUP BY s.sink""",
    "admitted_items": "SELECT o_orderkey AS id, o_orderpriority = '1-URGENT' OR sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) <= 3 AS admitted FROM orders",
    "operator_transitions": """WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'promoted' END AS before FROM orders)
SELECT before, CASE WHEN before = 'open' AND o_orderkey % 3 = 0 THEN 'closed' WHEN before = 'open' AND o_orderkey % 3 = 1 THEN 'promoted' ELSE before END AS after, count(*) AS n FROM s GROUP BY ALL""",
}
