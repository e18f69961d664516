"""Graph queries: customers and parts are entities, orders events, line items involve parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..session import table


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PLACED from customer to order, INVOLVES from order to part."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    placed = o.select(key("p", "o_orderkey").alias("id"), key("c", "o_custkey").alias("src"), F.lit("PLACED").alias("rel"), key("o", "o_orderkey").alias("dst"))
    involves = li.select(F.concat_ws("-", key("i", "l_orderkey"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("id"), key("o", "l_orderkey").alias("src"), F.lit("INVOLVES").alias("rel"), key("t", "l_partkey").alias("dst"))
    return placed.unionByName(involves)


_EDGES = """e AS (SELECT 'p' || o_orderkey AS id, 'c' || o_custkey AS src, 'PLACED' AS rel, 'o' || o_orderkey AS dst FROM orders
UNION ALL SELECT 'i' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, 'o' || l_orderkey, 'INVOLVES', 't' || l_partkey FROM lineitem),
b AS (SELECT id, rel, src AS a, dst AS z FROM e UNION ALL SELECT id, rel, dst, src FROM e)"""
_SEEDS = "s AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_custkey % 50 = 0)"


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))


def graph_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-10."""
    return g.one_hop(_edges(spark, sf_dir), _seeds(spark, sf_dir))


def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11, JN-28."""
    return g.two_hops(_edges(spark, sf_dir), _seeds(spark, sf_dir))


def graph_top_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05."""
    return g.degrees(_edges(spark, sf_dir)).orderBy(F.col("degree").desc(), "node").limit(25)


def graph_co_occurring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-12, AGG-06."""
    involved = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("entity"))
    seeds = table(spark, sf_dir, "part").where("p_partkey % 100 = 7").select(F.col("p_partkey").alias("entity"))
    return g.co_occurring(involved, seeds)


def graph_events_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-13: a part's orders, with the place of their customers."""
    li, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    parts = li.where("l_partkey % 200 = 3").select("l_partkey", F.col("l_orderkey").alias("o_orderkey")).distinct()
    return parts.join(o, "o_orderkey").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("l_partkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "n_name")


def graph_source_backed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-13: events with the number of their distinct sources."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(F.countDistinct("l_suppkey").alias("sources")).where("sources >= 3")


def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by contained text."""
    return g.search(table(spark, sf_dir, "part"), F.col("p_name"), "RED").select("p_partkey", "p_name")


def integrity_duplicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11: parallel edges from nations' customers to parts."""
    li = table(spark, sf_dir, "lineitem")
    edges = li.select(F.col("l_orderkey").alias("src"), F.col("l_returnflag").alias("rel"), F.col("l_suppkey").alias("dst"))
    return g.duplicate_edges(edges)


def integrity_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12, JN-16: customers and parts without an edge."""
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    nodes = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.lit("customer").alias("label")).unionByName(
        p.select(F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("node"), F.lit("part").alias("label"))
    )
    return g.orphans(nodes, _edges(spark, sf_dir))


def duplicate_key_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: keys that would not be unique."""
    return g.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def entity_merge_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-06: part names, with brands' last digits as types."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("LOCATION", "REGION", "COUNTRY", "CITY")]), (F.col("p_partkey") % 3 + F.when(F.col("p_name").like("r%"), 1).otherwise(0) + 1).cast("int"))
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("type"))
    return g.merge_eligible(entities).select("key", "n", F.array_join("types", ",").alias("types"))


def entity_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-07, DD-08: parts of one name; degree is the number of their line items."""
    degree = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("degree"), F.min("l_shipdate").alias("first_seen"))
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name").join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return g.survivors(entities, F.lower("p_name")).select("id", "survivor")


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-07: line items redrawn to the smallest part of each name, parallel ones counted out."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("key"))
    low = part.join(part.groupBy("key").agg(F.min("id").alias("survivor")), "key").select((-F.col("id") - 1).alias("id"), (-F.col("survivor") - 1).alias("survivor"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_returnflag").alias("rel"), (-F.col("l_partkey") - 1).alias("dst"))
    return g.transfer_edges(edges, low).groupBy("rel").agg(F.count("*").alias("edges"), F.countDistinct("dst").alias("targets"))


def relation_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-15: nations' trade, supported by suppliers."""
    li, s, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "orders", "customer"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    rows = rows.select(F.col("s_nationkey").alias("src"), F.col("l_returnflag").alias("rel"), F.col("c_nationkey").alias("dst"), F.col("s_suppkey").alias("provenance"), F.col("o_orderkey").alias("evidence"))
    got = g.relation_support(rows)
    return got.select("src", "rel", "dst", F.col("support").cast("long").alias("support"), F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


def relation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-11: orders as relations; counts per lane and gate, and the sum of the first ends as sorted."""
    o = table(spark, sf_dir, "orders")
    relations = o.select(
        F.expr("o_custkey % 7").alias("src"), F.expr("case when o_custkey % 13 = 0 then null when o_custkey % 2 = 0 then 'ORG' else 'PERSON' end").alias("src_type"), F.substring("o_orderpriority", 1, 1).alias("rel"),
        F.expr("o_orderkey % 7").alias("dst"), F.when(F.expr("o_orderkey % 3 = 0"), "ORG").otherwise("PERSON").alias("dst_type"), F.expr("o_orderkey % 10 / 10.0D").alias("confidence"), F.when(F.expr("o_orderkey % 11 > 0"), "text").alias("evidence"),
    )
    both = ["ORG", "PERSON"]
    rules = [("1", "canonical", both, both, True), ("2", "canonical", ["ORG"], both, False), ("3", "canonical", both, ["PERSON"], False), ("4", "candidate_only", both, both, False)]
    rules = spark.createDataFrame(rules, "rel string, mode string, source_types array<string>, target_types array<string>, symmetric boolean")
    return g.gate_relations(relations, rules).groupBy("lane", "failed_gate").agg(F.count("*").alias("n"), F.sum("src").alias("src_sum"))


QUERIES = {
    f.__name__: f
    for f in (graph_one_hop, graph_two_hop, graph_top_connected, graph_co_occurring, graph_events_by_entity, graph_source_backed, graph_search, integrity_duplicate_edges, integrity_orphans, duplicate_key_preflight, entity_merge_eligible, entity_survivor, merged_edges, relation_support, relation_gate)
}

ORACLE = {
    "graph_one_hop": f"WITH {_EDGES}, {_SEEDS} SELECT node, rel, z AS neighbour FROM s JOIN b ON s.node = b.a",
    "graph_two_hop": f"""WITH {_EDGES}, {_SEEDS}, f AS (SELECT node, id, z FROM s JOIN b ON s.node = b.a),
h AS (SELECT node, z AS neighbour, 1 AS hops FROM f UNION ALL SELECT f.node, b.z, 2 FROM f JOIN b ON f.z = b.a WHERE f.id <> b.id)
SELECT node, neighbour, min(hops) AS hops FROM h WHERE node <> neighbour GROUP BY ALL""",
    "graph_top_connected": f"WITH {_EDGES} SELECT a AS node, count(*) AS degree FROM b GROUP BY a ORDER BY degree DESC, node LIMIT 25",
    "graph_co_occurring": """WITH l AS (SELECT DISTINCT l_orderkey AS event, l_partkey AS entity FROM lineitem)
SELECT x.entity, y.entity AS other, count(*) AS shared FROM l x JOIN l y ON x.event = y.event WHERE x.entity % 100 = 7 AND x.entity IN (SELECT p_partkey FROM part) AND x.entity <> y.entity GROUP BY ALL""",
    "graph_events_by_entity": "SELECT DISTINCT l_partkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_partkey % 200 = 3",
    "graph_source_backed": "SELECT l_orderkey AS event, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3",
    "graph_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red')",
    "integrity_duplicate_edges": "SELECT rel, count(*) AS groups, CAST(sum(c - 1) AS BIGINT) AS excess FROM (SELECT l_orderkey, l_returnflag AS rel, l_suppkey, count(*) AS c FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY rel",
    "integrity_orphans": f"""WITH {_EDGES}, n AS (SELECT 'c' || c_custkey AS node, 'customer' AS label FROM customer UNION ALL SELECT 't' || p_partkey, 'part' FROM part)
SELECT label, count(*) AS n, count(*) FILTER (WHERE node NOT IN (SELECT a FROM b)) AS orphans FROM n GROUP BY label""",
    "duplicate_key_preflight": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "entity_merge_eligible": """WITH e AS (SELECT lower(p_name) AS key, ['LOCATION', 'REGION', 'COUNTRY', 'CITY'][p_partkey % 3 + CASE WHEN p_name LIKE 'r%' THEN 1 ELSE 0 END + 1] AS type FROM part),
k AS (SELECT key, count(*) AS n, list_sort(list(DISTINCT type)) AS types FROM e GROUP BY key)
SELECT key, n, array_to_string(types, ',') AS types FROM k WHERE n > 1 AND (len(types) = 1 OR (NOT list_contains(types, 'CITY') AND (list_contains(types, 'COUNTRY') OR list_contains(types, 'REGION'))))""",
    "entity_survivor": """WITH d AS (SELECT l_partkey AS id, count(*) AS degree, min(l_shipdate) AS first_seen FROM lineitem GROUP BY 1)
SELECT p_partkey AS id, first_value(p_partkey) OVER (PARTITION BY lower(p_name) ORDER BY coalesce(degree, 0) DESC, first_seen ASC NULLS LAST, p_partkey) AS survivor FROM part LEFT JOIN d ON id = p_partkey""",
    "merged_edges": """WITH m AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS survivor FROM part), x AS (SELECT DISTINCT l_orderkey, l_returnflag AS rel, coalesce(survivor, l_partkey) AS dst FROM lineitem LEFT JOIN m ON l_partkey = id)
SELECT rel, count(*) AS edges, count(DISTINCT dst) AS targets FROM x GROUP BY rel""",
    "relation_support": """WITH r AS (SELECT s_nationkey AS src, l_returnflag AS rel, c_nationkey AS dst, s_suppkey AS p, o_orderkey AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT src, rel, dst, count(DISTINCT p) AS support, array_to_string(list_slice(list_sort(list(DISTINCT e)), 1, 5), ',') AS evidence FROM r GROUP BY ALL""",
    "relation_gate": """WITH r AS (SELECT o_custkey % 7 AS s, CASE WHEN o_custkey % 13 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'ORG' ELSE 'PERSON' END AS st, substr(o_orderpriority, 1, 1) AS rel, o_orderkey % 7 AS d, CASE WHEN o_orderkey % 3 = 0 THEN 'ORG' ELSE 'PERSON' END AS dt FROM orders),
g AS (SELECT *, CASE WHEN rel NOT IN ('1', '2', '3', '4') THEN 'relation_type_unknown' WHEN st IS NULL THEN 'entity_type_unresolved' WHEN rel = '4' THEN 'relation_type_candidate_only' WHEN rel = '2' AND st <> 'ORG' THEN '2.source_type' WHEN rel = '3' AND dt <> 'PERSON' THEN '3.target_type' END AS failed_gate FROM r)
SELECT CASE WHEN failed_gate IS NULL THEN 'canonical' ELSE 'candidate' END AS lane, failed_gate, count(*) AS n, CAST(sum(CASE WHEN failed_gate IS NULL AND rel = '1' THEN least(s, d) ELSE s END) AS BIGINT) AS src_sum FROM g GROUP BY ALL""",
}
