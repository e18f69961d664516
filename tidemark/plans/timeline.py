"""Timeline queries over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeline as t
from ..session import table

START, END = "2024-01-03 00:00:00", "2024-01-24 00:00:00"
START_MS, END_MS, BUCKETS = 1704240000000, 1706054400000, 48

#: Severity and category of the event types, one map for Spark and SQL.
SEVERITY = {"error": "critical", "purchase": "high", "signup": "medium", "click": "low"}
CATEGORY = {"error": "system", "purchase": "commerce", "signup": "account", "click": "traffic", "view": "traffic"}
PRIORITY = ("system", "commerce", "account", "traffic")


def mapped(column: str, pairs: dict[str, str], default: str):
    made = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(made, F.col(column)), F.lit(default))


def case(column: str, pairs: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE '{default}' END"


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(t.in_window("ts", START, END))
    return t.histogram(events, t.epoch_ms("ts"), START_MS, END_MS, BUCKETS, mapped("event_type", CATEGORY, "other"), mapped("event_type", SEVERITY, "unknown"))


_COUNTS_SQL = f"""WITH c AS (SELECT CAST(least(greatest(floor(((epoch_us(ts) // 1000) - {START_MS}) / {(END_MS - START_MS) // BUCKETS}.0), 0), {BUCKETS - 1}) AS INTEGER) AS bucket,
  {case('event_type', CATEGORY, 'other')} AS category, {case('event_type', SEVERITY, 'unknown')} AS severity, count(*) AS n
  FROM events WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY ALL)"""


def timeline_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02, AGG-03, FLT-06, PRJ-05, PRJ-06."""
    return t.histogram_maps(_counts(spark, sf_dir))


def timeline_dominant_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04."""
    return t.dominant(_counts(spark, sf_dir), ["bucket"], "category", PRIORITY)


QUERIES = {"timeline_histogram": timeline_histogram, "timeline_dominant_category": timeline_dominant_category}

ORACLE = {
    "timeline_histogram": _COUNTS_SQL
    + """, a AS (SELECT bucket, category, sum(n)::BIGINT AS n FROM c GROUP BY ALL), b AS (SELECT bucket, severity, sum(n)::BIGINT AS n FROM c GROUP BY ALL)
SELECT x.bucket, total, by_category, by_severity FROM
 (SELECT bucket, sum(n)::BIGINT AS total, string_agg(category || '=' || n, ',' ORDER BY category || '=' || n) AS by_category FROM a GROUP BY bucket) x
 JOIN (SELECT bucket, string_agg(severity || '=' || n, ',' ORDER BY severity || '=' || n) AS by_severity FROM b GROUP BY bucket) y ON x.bucket = y.bucket""",
    "timeline_dominant_category": _COUNTS_SQL
    + f""", a AS (SELECT bucket, category, sum(n)::BIGINT AS n FROM c GROUP BY ALL)
SELECT bucket, category AS dominant_category, n AS dominant_n FROM a
QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY n DESC, {case('category', {c: str(i) for i, c in enumerate(PRIORITY)}, '9')}, category) = 1""",
}
