"""Upserts, deduplication and enrichment over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich as e
from ..operators import upsert as u
from ..session import table


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-11, DD-02: orders of customers that no earlier order has."""
    o = table(spark, sf_dir, "orders")
    old, new = o.where("o_orderdate < timestamp_ntz'1996-01-01 00:00:00'"), o.where("o_orderdate >= timestamp_ntz'1996-01-01 00:00:00'")
    return u.insert_if_absent(old, new, ["o_custkey"]).select("o_orderkey", "o_custkey")


def upsert_mutable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03, SNK-12, SNK-14, SNK-16: customers seen in two feeds, one column per rule."""
    c = table(spark, sf_dir, "customer")
    row = lambda df, shift: df.select("c_custkey", F.col("c_name").alias("name"), F.when(F.expr(f"(c_custkey + {shift}) % 3 > 0"), F.col("c_mktsegment")).alias("segment"), (F.col("c_acctbal") + shift).alias("balance"), F.expr(f"c_custkey * {shift + 1}").alias("seen"))
    old, new = row(c.where("c_custkey % 4 <> 1"), 0), row(c.where("c_custkey % 4 <> 2"), 1)
    return u.upsert(old, new, ["c_custkey"], {"name": "create", "segment": "coalesce", "balance": "max", "seen": "match"}).withColumn("seen", F.coalesce("seen", F.lit(-1)))


def alias_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-13, SET-06: suppliers' part brands of two years, old first."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    aliases = lambda w: li.where(w).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey").agg(F.sort_array(F.collect_set("p_type")).alias("aliases"))
    old, new = aliases("l_quantity <= 5"), aliases("l_quantity > 5 and l_quantity <= 10")
    return u.upsert(old, new, ["l_suppkey"], {"aliases": "append_distinct"}).select("l_suppkey", F.array_join("aliases", ",").alias("aliases"))


def bucket_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-03: the first event of each user and quarter hour."""
    ev = table(spark, sf_dir, "events").withColumn("bucket", F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 900))
    return u.first_by(ev, ["user_id", "bucket"], [F.col("ts"), F.col("event_id")]).select("user_id", "bucket", "event_id")


def feed_priority_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-04, DD-16: parts by name, first feed (type) wins."""
    p = table(spark, sf_dir, "part")
    priority = F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "SMALL", 1).otherwise(2)
    return u.first_by(p, ["p_name"], [priority, F.col("p_partkey")]).select("p_name", "p_partkey", "p_type")


def at_most_one_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-17: each nation linked to its richest supplier."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    got = u.at_most_one(n.select("n_nationkey", "n_name"), s.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_acctbal"), "n_nationkey", "n_nationkey", [F.col("s_acctbal").desc(), F.col("s_suppkey")])
    return got.select("n_name", "s_suppkey")


def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-25: null fields of a patch change nothing, the segment can be cleared."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    patch = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.expr("c_custkey % 2 = 0"), F.lit("renamed")).alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"), F.expr("c_custkey % 5 = 0").alias("clear_c_mktsegment"))
    return u.partial_update(c, patch, "c_custkey", ["c_name", "c_mktsegment"], "c_mktsegment")


def replace_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-26: only the owned balance is replaced."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.expr("c_custkey % 4 = 0"), F.col("c_acctbal") * 2).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"))
    return u.replace_owned(c, new, "c_custkey", ["c_acctbal"], ["c_mktsegment"])


def write_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-17: part names that several rows would write."""
    return u.colliding(table(spark, sf_dir, "part"), "p_name")


def facility_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-18, JN-19: suppliers' and customers' balances per nation, suppliers first."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    left = s.where("s_suppkey % 3 = 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.max("s_acctbal").alias("balance"), F.max(F.when(F.col("s_acctbal") > 9000, F.col("s_name"))).alias("name"))
    right = c.where("c_custkey % 7 < 3 and c_nationkey % 6 > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.max("c_acctbal").alias("balance"), F.max("c_name").alias("name"))
    return e.fill_missing(left, right, ["nation"], ["balance", "name"])


def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-21, JN-27: names against known ones."""
    p = table(spark, sf_dir, "part")
    fresh = p.where("p_partkey % 20 = 1").select(F.col("p_partkey").alias("fresh_id"), F.upper("p_name").alias("fresh_name"))
    known = p.where("p_partkey % 37 = 3").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return e.match_report(fresh, known, "fresh_name").withColumn("matched_id", F.coalesce("matched_id", F.lit(-1)))


def match_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-22, JN-30: approved customers against a later feed."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    fresh = c.where("c_custkey % 10 > 0").withColumn("c_nationkey", F.expr("if(c_custkey % 9 = 0, c_nationkey + 1, c_nationkey)")).withColumn("c_mktsegment", F.when(F.expr("c_custkey % 8 = 0"), "OTHER").otherwise(F.col("c_mktsegment")))
    return e.drift(c, fresh, ["c_custkey"], ["c_nationkey", "c_mktsegment"])


def almanac_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-23, JN-24: nations with region, counts and overrides."""
    n, r, c, s = (table(spark, sf_dir, t) for t in ("nation", "region", "customer", "supplier"))
    cs = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    ss = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    joined = n.join(r, n.n_regionkey == r.r_regionkey, "left").join(cs, "n_nationkey", "left").join(ss, "n_nationkey", "left")
    return joined.select("n_nationkey", F.when(F.col("n_nationkey") == 3, "override").otherwise(F.col("n_name")).alias("name"), "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def signals_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-06, FLT-26: the first five orders of each nation's customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o.o_custkey == c.c_custkey).select("c_nationkey", "o_orderkey", "o_orderdate")
    return e.first_per_key(rows, "c_nationkey", 5, [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("c_nationkey", "o_orderkey", "place")


def latest_year_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-15: each customer's total in its latest year, from a map of years; years before 1994 have no number."""
    year = F.year("o_orderdate")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.when(year < 1994, "early").otherwise(F.concat(F.lit("FY "), year.cast("string"))).alias("y")).agg(F.count("*").alias("n"))
    maps = o.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("m"))
    return maps.select("o_custkey", e.latest_year(F.col("m")).alias("latest"))


def contained_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-29: the longest part type or name in documents' licence lines and part names."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.element_at(F.split("p_name", " "), -1).alias("name")).distinct()
    texts = p.select("p_partkey", F.concat_ws(" / ", "p_name", "p_type").alias("t"))
    return e.longest_contained(texts, names, "t").select("p_partkey", "contained")


def report_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-31: a customer for each request, own nation first, then aliases."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    requests = n.select(F.col("n_nationkey").alias("request"), F.array(F.col("n_nationkey") + 30, (F.col("n_nationkey") + 1) % 25, F.col("n_nationkey")).alias("keys"))
    reports = c.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("report_id"), F.col("c_nationkey").alias("scope"))
    return e.by_scope(reports, requests).select("request", "report_id", F.col("scope").cast("long").alias("scope"), "candidates")


QUERIES = {
    f.__name__: f
    for f in (insert_if_absent, upsert_mutable, alias_union, bucket_dedup, feed_priority_dedup, at_most_one_link, partial_update, replace_owned, write_collisions, facility_enrich, match_report, match_drift, almanac_assembly, signals_by_country, latest_year_value, contained_name, report_by_scope)
}

ORACLE = {
    "insert_if_absent": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')",
    "upsert_mutable": """WITH o AS (SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment, c_acctbal AS balance, c_custkey AS seen FROM customer WHERE c_custkey % 4 <> 1),
n AS (SELECT c_custkey, c_name AS name, CASE WHEN (c_custkey + 1) % 3 > 0 THEN c_mktsegment END AS segment, c_acctbal + 1 AS balance, c_custkey * 2 AS seen FROM customer WHERE c_custkey % 4 <> 2)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NOT NULL THEN o.name ELSE n.name END AS name, coalesce(n.segment, o.segment) AS segment, greatest(o.balance, n.balance) AS balance,
CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL THEN n.seen WHEN o.c_custkey IS NOT NULL THEN o.seen ELSE -1 END AS seen FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""",
    "alias_union": """WITH o AS (SELECT l_suppkey, list_sort(list(DISTINCT p_type)) AS a FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity <= 5 GROUP BY 1), n AS (SELECT l_suppkey, list_sort(list(DISTINCT p_type)) AS a FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 5 AND l_quantity <= 10 GROUP BY 1)
SELECT coalesce(o.l_suppkey, n.l_suppkey) AS l_suppkey, array_to_string(list_concat(coalesce(o.a, []), list_filter(coalesce(n.a, []), lambda x: NOT list_contains(coalesce(o.a, []), x))), ',') AS aliases FROM o FULL JOIN n ON o.l_suppkey = n.l_suppkey""",
    "bucket_dedup": "SELECT user_id, CAST(floor((epoch_us(ts) // 1000) / 900000.0) AS BIGINT) AS bucket, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, floor((epoch_us(ts) // 1000) / 900000.0) ORDER BY ts, event_id) = 1",
    "feed_priority_dedup": "SELECT p_name, p_partkey, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'SMALL' THEN 1 ELSE 2 END, p_partkey) = 1",
    "at_most_one_link": "SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1",
    "partial_update": "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'renamed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "replace_owned": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal * 2 WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
    "write_collisions": "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "facility_enrich": """WITH l AS (SELECT s_nationkey AS nation, max(s_acctbal) AS balance, max(CASE WHEN s_acctbal > 9000 THEN s_name END) AS name FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1), r AS (SELECT c_nationkey AS nation, max(c_acctbal) AS balance, max(c_name) AS name FROM customer WHERE c_custkey % 7 < 3 AND c_nationkey % 6 > 0 GROUP BY 1)
SELECT coalesce(l.nation, r.nation) AS nation, coalesce(l.balance, r.balance) AS balance, coalesce(l.name, r.name) AS name, CASE WHEN r.nation IS NULL THEN 'left' WHEN l.nation IS NULL THEN 'right' ELSE 'both' END AS origin FROM l FULL JOIN r ON l.nation = r.nation""",
    "match_report": """WITH k AS (SELECT lower(trim(p_name)) AS k, count(*) AS n, min(p_partkey) AS id FROM part WHERE p_partkey % 37 = 3 GROUP BY 1)
SELECT p_partkey AS fresh_id, upper(p_name) AS fresh_name, CASE WHEN n IS NULL THEN 'new' WHEN n = 1 THEN 'match' ELSE 'ambiguous' END AS outcome, CASE WHEN n = 1 THEN id ELSE -1 END AS matched_id FROM part LEFT JOIN k ON lower(trim(p_name)) = k WHERE p_partkey % 20 = 1""",
    "match_drift": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'vanished' WHEN c_custkey % 9 = 0 THEN 'c_nationkey' ELSE 'c_mktsegment' END AS drift FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 9 = 0 OR c_custkey % 8 = 0",
    "almanac_assembly": """SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'override' ELSE n_name END AS name, r_name, coalesce(c, 0) AS customers, coalesce(s, 0) AS suppliers FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""",
    "signals_by_country": "SELECT c_nationkey, o_orderkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY place <= 5",
    "latest_year_value": "SELECT o_custkey, n AS latest FROM (SELECT o_custkey, CASE WHEN year(o_orderdate) < 1994 THEN 0 ELSE year(o_orderdate) END AS y, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC) = 1",
    "contained_name": """WITH n AS (SELECT DISTINCT string_split(p_name, ' ')[-1] AS name FROM part), k AS (SELECT name FROM n WHERE length(name) >= 4),
t AS (SELECT p_partkey, string_split(trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM part)
SELECT p_partkey, max_by(name, length(name) || ':' || name) AS contained FROM t LEFT JOIN k ON list_contains(w, lower(name)) GROUP BY p_partkey""",
    "report_by_scope": """WITH q AS (SELECT n_nationkey AS request, unnest([n_nationkey + 30, (n_nationkey + 1) % 25, n_nationkey]) AS scope, unnest([0, 1, 2]) AS pos FROM nation), f AS (SELECT request, scope, pos, c_custkey AS report_id FROM q JOIN customer ON c_nationkey = scope WHERE c_custkey % 20 = 0)
SELECT request, report_id, CAST(scope AS BIGINT) AS scope, count(*) OVER (PARTITION BY request) AS candidates FROM f QUALIFY row_number() OVER (PARTITION BY request ORDER BY pos, report_id) = 1""",
}
