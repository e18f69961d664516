"""Slice queries: orders are events, line items mentions, parts documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import TACTICAL_ROOTS, theme_match
from ..functions.dates import slice_calendar
from ..operators import slices as s
from ..session import table

EXACT, PREFIXES = ("ECONOMY",), ("small", "red")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.expr("o_orderkey % 20 + 1").alias("root"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("event_type"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("url"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    themes = F.concat(F.col("p_type"), F.lit(";;"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit(";"))
    return table(spark, sf_dir, "part").where("p_partkey % 10 < 8").select(F.col("p_partkey").alias("url"), themes.alias("themes"), "p_size")


_EVENTS = "e AS (SELECT o_orderkey AS event_id, o_orderkey % 20 + 1 AS root, o_totalprice AS score, o_orderpriority AS event_type FROM orders)"
_MENTIONS = "m AS (SELECT l_orderkey AS event_id, l_partkey AS url FROM lineitem)"
_DOCS = "d AS (SELECT p_partkey AS url, p_type || ';;' || replace(p_name, ' ', '_') || ';' AS themes, p_size FROM part WHERE p_partkey % 10 < 8)"
_MATCH = "(list_contains(string_split(themes, ';'), 'ECONOMY') OR len(list_filter(string_split(themes, ';'), lambda x: x IN ('small', 'red') OR x LIKE 'small\\_%' ESCAPE '\\' OR x LIKE 'red\\_%' ESCAPE '\\')) > 0)"


def theme_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02, T19."""
    return _documents(spark, sf_dir).select("url", theme_match("themes", EXACT, PREFIXES).alias("matched"))


def tactical_override_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, SET-01, JN-01, JN-02."""
    documents = _documents(spark, sf_dir)
    over = s.override_ids(_mentions(spark, sf_dir), documents, theme_match("themes", ("NONE",), ("small",)) & (F.col("p_size") < 10))
    return s.select_events(_events(spark, sf_dir), F.col("root").isin(*TACTICAL_ROOTS), over).select("event_id", "root", "filter_reason")


def doc_event_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-03, JN-04, AGG-01; ids as text."""
    linked = s.link_documents(_documents(spark, sf_dir).select("url", "p_size"), _mentions(spark, sf_dir), _events(spark, sf_dir).where("root < 3"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return linked.select("url", join("linked_event_ids").alias("linked_event_ids"), join("linked_types").alias("linked_types"), "min_score", F.round("avg_score", 6).alias("avg_score"))


def mention_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-05."""
    return s.mention_outcomes(_mentions(spark, sf_dir), _documents(spark, sf_dir), _events(spark, sf_dir).where("root > 3"))


def unique_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-01, SET-02: the first line item of each order and part."""
    return s.unique_by(table(spark, sf_dir, "lineitem"), ["l_partkey"], [F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber")


def contract_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-29, SRC-03: rows per set of broken rules."""
    rules = {"quantity": F.col("l_quantity").between(1, 40), "discount": F.col("l_discount") < 0.08, "flag": F.col("l_returnflag").isin("A", "N", "R")}
    good, bad = s.split_valid(table(spark, sf_dir, "lineitem"), rules)
    out = good.agg(F.lit("").alias("broken"), F.count("*").alias("n"))
    return out.unionByName(bad.groupBy(F.array_join("broken_rules", ",").alias("broken")).agg(F.count("*").alias("n")))


def slice_calendar_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-08: quarter hours of a day, and the events in each."""
    slots = spark.range(1).select(F.explode(slice_calendar("2024-01-05 00:07:00", "2024-01-05 23:52:00")).alias("slot"))
    events = table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-05 00:00:00' and ts < timestamp_ntz'2024-01-06 00:00:00'")
    each = events.groupBy(F.expr("timestampadd(MINUTE, -(minute(ts) % 15), date_trunc('MINUTE', ts))").cast("timestamp_ntz").alias("slot")).agg(F.count("*").alias("n"))
    return slots.join(each, "slot", "left").select(F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"), F.coalesce("n", F.lit(0)).alias("n"))


def backfill_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-03: orders that are neither done nor failed."""
    o = table(spark, sf_dir, "orders")
    one = lambda w: o.where(w).select("o_orderkey")
    return s.pending(o.select("o_orderkey"), one("o_orderstatus = 'F'"), one("o_orderpriority = '1-URGENT'"))


def exact_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04: orders without line items of a quantity above 45, and the reverse."""
    expected = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    got = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id"))
    return s.exact_cover(expected, got, "id").groupBy("problem").agg(F.count("*").alias("n"))


def slice_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23: an order is complete when all its line items are shipped (status F)."""
    status = F.when(F.col("l_linestatus") == "F", "done").when(F.col("l_returnflag") == "R", "failed").otherwise("open")
    streams = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slice_id"), F.col("l_linenumber").alias("stream"), status.alias("status"))
    return s.slice_status(streams)


QUERIES = {
    "theme_prefix_match": theme_prefix_match,
    "tactical_override_events": tactical_override_events,
    "doc_event_linkage": doc_event_linkage,
    "mention_outcomes": mention_outcomes,
    "unique_mentions": unique_mentions,
    "contract_split": contract_split,
    "slice_calendar": slice_calendar_query,
    "backfill_pending": backfill_pending,
    "exact_cover": exact_cover,
    "slice_status": slice_status,
}

ORACLE = {
    "theme_prefix_match": f"WITH {_DOCS} SELECT url, {_MATCH} AS matched FROM d",
    "tactical_override_events": f"""WITH {_EVENTS}, {_MENTIONS}, {_DOCS},
o AS (SELECT DISTINCT event_id FROM m WHERE url IN (SELECT url FROM d WHERE p_size < 10 AND len(list_filter(string_split(themes, ';'), lambda x: x = 'small' OR x LIKE 'small\\_%' ESCAPE '\\')) > 0))
SELECT event_id, root, CASE WHEN root IN {TACTICAL_ROOTS} THEN 'tactical' ELSE 'nuclear_override' END AS filter_reason FROM e WHERE root IN {TACTICAL_ROOTS} OR event_id IN (SELECT event_id FROM o)""",
    "doc_event_linkage": f"""WITH {_EVENTS}, {_MENTIONS}, {_DOCS},
a AS (SELECT url, array_to_string(list_sort(list(DISTINCT event_id)), ',') AS ids, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, min(score) AS lo, CAST(sum(CAST(score AS DECIMAL(28,4))) AS DOUBLE) / count(score) AS av FROM m JOIN e USING (event_id) WHERE root < 3 GROUP BY url)
SELECT d.url, coalesce(ids, '') AS linked_event_ids, coalesce(types, '') AS linked_types, lo AS min_score, round(av, 6) AS avg_score FROM d LEFT JOIN a USING (url)""",
    "mention_outcomes": f"""WITH {_EVENTS}, {_MENTIONS}, {_DOCS}
SELECT CASE WHEN d.url IS NULL AND x.event_id IS NULL THEN 'both_missing' WHEN d.url IS NULL THEN 'document_missing' WHEN x.event_id IS NULL THEN 'event_missing' ELSE 'linked' END AS outcome, count(*) AS n
FROM m LEFT JOIN d ON m.url = d.url LEFT JOIN (SELECT event_id FROM e WHERE root > 3) x ON m.event_id = x.event_id GROUP BY 1""",
    "unique_mentions": "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) = 1",
    "contract_split": """WITH b AS (SELECT concat_ws(',', CASE WHEN NOT (l_quantity BETWEEN 1 AND 40) THEN 'quantity' END, CASE WHEN NOT (l_discount < 0.08) THEN 'discount' END, CASE WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 'flag' END) AS broken FROM lineitem)
SELECT broken, count(*) AS n FROM b GROUP BY broken""",
    "slice_calendar": """WITH s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-05 23:52:00', INTERVAL 15 MINUTE)) AS slot),
e AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS slot, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(s.slot, '%Y-%m-%d %H:%M') AS slot, coalesce(n, 0) AS n FROM s LEFT JOIN e ON s.slot = e.slot""",
    "backfill_pending": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT'",
    "exact_cover": """WITH x AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0), g AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity > 45)
SELECT 'missing' AS problem, count(*) AS n FROM x WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'orphan', count(*) FROM g WHERE id NOT IN (SELECT id FROM x)""",
    "slice_status": "SELECT l_orderkey AS slice_id, bool_and(l_linestatus = 'F') AS complete, count(*) FILTER (WHERE l_linestatus <> 'F' AND l_returnflag = 'R') AS failed FROM lineitem GROUP BY 1",
}
