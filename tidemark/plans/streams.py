"""Batch twins of the streaming operators, and the rest of the timeline reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.geo import in_bbox
from ..operators import timeline as t
from ..session import table
from ..streaming import twins
from . import places
from .timeline import CATEGORY, SEVERITY, case, mapped

SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
_S = "CAST(floor((epoch_us(ts) // 1000) / 1000.0) AS BIGINT)"
_RANK = {"critical": 0, "high": 2}


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").selectExpr("*", f"{places.LAT} as lat", f"{places.LON} as lon", f"{SECONDS} as s")
    return ev.withColumns({"severity": mapped("event_type", SEVERITY, "unknown"), "category": mapped("event_type", CATEGORY, "other")})


_EV = f"ev AS (SELECT *, {places.SQL_LAT} AS lat, {places.SQL_LON} AS lon, {_S} AS s, {case('event_type', SEVERITY, 'unknown')} AS severity, {case('event_type', CATEGORY, 'other')} AS category FROM events)"


def timeline_window_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06, WIN-02, WIN-05."""
    ev = _ev(spark, sf_dir).where(t.in_window("ts", "2024-01-05 00:00:00", "2024-01-06 00:00:00"))
    return t.samples(ev.select("event_id", "severity", "s"), [F.col("s").desc(), F.col("event_id")], 50)


def timeline_notables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-03: events (the newest 400 high or critical) and incidents (the newest 200), 40 in all."""
    ev = _ev(spark, sf_dir)
    newest = lambda rows, n, live: rows.orderBy(F.col("s").desc(), "event_id").limit(n).select("event_id", "s", "severity", F.lit(live).alias("is_incident"))
    both = newest(ev.where("severity in ('high', 'critical')"), 400, False).unionByName(newest(ev.where("value > 400"), 200, True))
    return t.notables(both, "event_id", "s", 40).select("event_id", "s", "tier", "is_incident", "rank")


def timeline_geo_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-04, JN-15: events in a box by severity and time."""
    rank = mapped("severity", {"critical": 4, "high": 3, "medium": 2, "low": 1}, 0)
    ev = _ev(spark, sf_dir).where(in_bbox("lat", "lon", -40.0, 100.0, 60.0, -60.0)).withColumn("r", rank)
    return t.samples(ev.select("event_id", "r", "s"), [F.col("r").desc(), F.col("s").desc(), F.col("event_id")], 200)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, WIN-13: each user's points in order, 100 users by their last point. The points of a
    track are one result row."""
    got = _ev(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("s", "event_id"))).alias("p"), F.max("s").alias("last_s"))
    return got.orderBy(F.col("last_s").desc(), "user_id").limit(100).select("user_id", "last_s", F.array_join(F.transform("p", lambda x: x["event_id"].cast("string")), ",").alias("points"))


def tracks_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08: users with a point in the box, and these users' points outside it."""
    inside = F.count_if(in_bbox("lat", "lon", -40.0, 100.0, 60.0, -60.0))
    n = _ev(spark, sf_dir).where("lat is not null and lon is not null").groupBy("user_id").agg(F.count("*").alias("n"), inside.alias("inside")).where("inside > 0")
    return n.agg(F.count("*").alias("users"), F.coalesce(F.sum(F.col("n") - F.col("inside")), F.lit(0)).alias("clipped_points"))


def landing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10: all counters in one scan."""
    ev = _ev(spark, sf_dir)
    recent = F.expr("ts >= timestamp_ntz'2024-01-20 00:00:00'")
    return ev.agg(F.count("*").alias("events"), F.count_if(recent).alias("recent"), F.count_if(recent & (F.col("severity") == "critical")).alias("critical"), F.count_if(F.col("value") > 300).alias("large"), F.countDistinct("user_id").alias("users"))


def latest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-13, JN-17, JN-18: the last point of each user."""
    return twins.last_positions(_ev(spark, sf_dir), "user_id", F.struct("s", "event_id"), ["event_id", "lat", "lon"])


def grid_ignitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03: the first hour in which a cell of ten degrees has three events."""
    ev = _ev(spark, sf_dir).withColumns({"row": F.floor(F.col("lat") / 10), "col": F.floor(F.col("lon") / 10)})
    return twins.ignitions(ev, ["row", "col"], F.col("s"), 86400, 3, "event_id").select("row", "col", "event_id", "hits")


def severity_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05: one cluster of all high and critical events: its ignition by five in 900 seconds, then updates."""
    ev = _ev(spark, sf_dir).where("severity in ('critical', 'high')")
    return twins.global_burst(ev, "s", "event_id", 900, 5).select("event_id", "kind")


def cluster_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09: clusters of a user's events that close after a quiet half day."""
    return twins.sessions(_ev(spark, sf_dir), ["user_id"], F.col("s"), 43200)


def escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11: severity by the running number of hits."""
    from pyspark.sql import Window

    hits = F.count("*").over(Window.partitionBy("user_id").orderBy("s", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    got = _ev(spark, sf_dir).withColumn("hits", hits)
    return got.select("user_id", "event_id", twins.escalation(F.col("hits"), [(5, "elevated"), (20, "high"), (50, "critical")], "low").alias("level"))


def contiguous_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07: per user the last event before the first of value above 450."""
    got = twins.contiguous_watermark(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") <= 300)
    return got.withColumn("watermark", F.coalesce("watermark", F.lit(-1)))


def replay_after_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, STR-02: the ring of the newest 2000 ids, read after one of them."""
    ev = _ev(spark, sf_dir).select(F.concat(F.lpad((F.col("s") * 1000).cast("string"), 13, "0"), F.lit("-"), F.lpad(F.col("event_id").cast("string"), 6, "0")).alias("id"), "s")
    ring = twins.retained(ev, "s", 1706572800, 864000, 2000, "id")
    return twins.replay_after(ring, "1706400000000-000000").select("id", "reset")


def message_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-14."""
    return twins.albums(table(spark, sf_dir, "events"), F.when(F.expr("event_id % 3 > 0"), F.expr("event_id div 10")), "event_id")


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15, SRC-23."""
    attempts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("message"), (F.col("l_quantity") > 20).alias("ok"))
    return twins.dead_letters(attempts, "message", 3)


def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-18: delay after so many attempts, permanent at five."""
    o = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("message")).agg(F.count("*").alias("attempts"))
    return o.select("message", dates.retry_delay("attempts").alias("delay_s"), (F.col("attempts") >= 5).alias("permanent"))


def timeline_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-07: the first valid time and its basis."""
    o = table(spark, sf_dir, "orders")
    occurred = F.when(F.expr("o_orderkey % 5 = 0"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).when(F.expr("o_orderkey % 5 = 1"), "not a time")
    published = F.when(F.expr("o_orderkey % 3 = 0"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    ts, basis = dates.anchor(occurred=dates.iso_instant(occurred), published=dates.iso_instant(published), ingested=F.to_timestamp(F.lit("2001-01-01 00:00:00")))
    return o.select("o_orderkey", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("anchor"), basis.alias("basis"))


QUERIES = {
    f.__name__: f
    for f in (timeline_window_samples, timeline_notables, timeline_geo_top, tracks, tracks_clipped, landing_counts, latest_positions, grid_ignitions, severity_bursts, cluster_sessions, escalation, contiguous_watermark, replay_after_id, message_albums, dead_letters, retry_plan, timeline_anchor)
}

_SAMPLE = lambda rows, order, n: f"SELECT *, (SELECT count(*) FROM {rows}) AS total, (SELECT count(*) FROM {rows}) > {n} AS truncated FROM {rows} ORDER BY {order} LIMIT {n}"

ORACLE = {
    "timeline_window_samples": f"WITH {_EV}, w AS (SELECT event_id, severity, s FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06') " + _SAMPLE("w", "s DESC, event_id", 50),
    "timeline_notables": f"""WITH {_EV}, e AS (SELECT event_id, s, severity, false AS is_incident FROM ev WHERE severity IN ('high', 'critical') ORDER BY s DESC, event_id LIMIT 400),
i AS (SELECT event_id, s, severity, true AS is_incident FROM ev WHERE value > 400 ORDER BY s DESC, event_id LIMIT 200),
b AS (SELECT *, CASE WHEN severity = 'critical' THEN 0 WHEN is_incident THEN 1 WHEN severity = 'high' THEN 2 ELSE 3 END AS tier FROM (SELECT * FROM e UNION ALL SELECT * FROM i)),
u AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY tier, s DESC, is_incident) = 1)
SELECT event_id, s, tier, is_incident, CAST(row_number() OVER (ORDER BY tier, s DESC, is_incident, event_id) AS INTEGER) AS rank FROM u ORDER BY rank LIMIT 40""",
    "timeline_geo_top": f"WITH {_EV}, w AS (SELECT event_id, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS r, s FROM ev WHERE lat BETWEEN -40 AND 60 AND (lon >= 100 OR lon <= -60)) " + _SAMPLE("w", "r DESC, s DESC, event_id", 200),
    "tracks": f"WITH {_EV} SELECT user_id, max(s) AS last_s, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY s, event_id) AS points FROM ev GROUP BY user_id ORDER BY last_s DESC, user_id LIMIT 100",
    "tracks_clipped": f"WITH {_EV}, u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE lat BETWEEN -40 AND 60 AND (lon >= 100 OR lon <= -60)) AS inside FROM ev WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1) SELECT count(*) AS users, CAST(coalesce(sum(n - inside), 0) AS BIGINT) AS clipped_points FROM u WHERE inside > 0",
    "landing_counts": f"WITH {_EV} SELECT count(*) AS events, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20') AS recent, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20' AND severity = 'critical') AS critical, count(*) FILTER (WHERE value > 300) AS large, count(DISTINCT user_id) AS users FROM ev",
    "latest_positions": f"WITH {_EV} SELECT user_id, event_id, lat, lon FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id DESC) = 1",
    "grid_ignitions": f"""WITH {_EV}, c AS (SELECT CAST(floor(lat / 10) AS BIGINT) AS row, CAST(floor(lon / 10) AS BIGINT) AS col, event_id, s, count(*) OVER (PARTITION BY floor(lat / 10), floor(lon / 10) ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS hits FROM ev)
SELECT row, col, event_id, hits FROM c WHERE hits >= 3 QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY s, event_id) = 1""",
    "severity_bursts": f"""WITH {_EV}, h AS (SELECT event_id, s, lag(s, 4) OVER (ORDER BY s, event_id) AS fifth, row_number() OVER (ORDER BY s, event_id) AS r FROM ev WHERE severity IN ('critical', 'high')), g AS (SELECT min(r) AS r0 FROM h WHERE fifth >= s - 900)
SELECT event_id, CASE WHEN r = r0 THEN 'ignition' ELSE 'update' END AS kind FROM h, g WHERE r >= r0""",
    "cluster_sessions": f"""WITH {_EV}, n AS (SELECT user_id, event_id, s, CASE WHEN s - lag(s) OVER w <= 43200 THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
k AS (SELECT user_id, s, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM n) SELECT user_id, session, min(s) AS start_s, max(s) AS end_s, count(*) AS hits FROM k GROUP BY ALL""",
    "escalation": f"WITH {_EV}, h AS (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS h FROM ev) SELECT user_id, event_id, CASE WHEN h >= 50 THEN 'critical' WHEN h >= 20 THEN 'high' WHEN h >= 5 THEN 'elevated' ELSE 'low' END AS level FROM h",
    "contiguous_watermark": """WITH b AS (SELECT user_id, min(event_id) FILTER (WHERE value > 300) AS bad FROM events GROUP BY 1)
SELECT e.user_id, coalesce(max(event_id) FILTER (WHERE bad IS NULL OR event_id < bad), -1) AS watermark, count(*) FILTER (WHERE event_id >= bad) AS held_back FROM events e JOIN b ON e.user_id = b.user_id GROUP BY e.user_id""",
    "replay_after_id": f"""WITH {_EV}, r AS (SELECT DISTINCT lpad(CAST(s * 1000 AS VARCHAR), 13, '0') || '-' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS id FROM ev WHERE s > 1706572800 - 864000 ORDER BY id DESC LIMIT 2000)
SELECT id, (SELECT min(id) FROM r) > '1706400000000-000000' AS reset FROM r WHERE id > '1706400000000-000000'""",
    "message_albums": "SELECT coalesce(CAST(CASE WHEN event_id % 3 > 0 THEN event_id // 10 END AS VARCHAR), 'm' || event_id) AS album, min(event_id) AS canonical, count(*) AS parts FROM events GROUP BY 1",
    "dead_letters": "SELECT l_orderkey AS message, count(*) AS attempts, bool_or(l_quantity > 20) AS done, NOT bool_or(l_quantity > 20) AND count(*) >= 3 AS dead FROM lineitem GROUP BY 1",
    "retry_plan": "SELECT l_orderkey AS message, CAST(least(3600, 60 * pow(2, count(*))) AS BIGINT) AS delay_s, count(*) >= 5 AS permanent FROM lineitem GROUP BY 1",
    "timeline_anchor": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' ELSE '2001-01-01 00:00:00' END AS anchor,
CASE WHEN o_orderkey % 5 = 0 THEN 'occurred' WHEN o_orderkey % 3 = 0 THEN 'published' ELSE 'ingested' END AS basis FROM orders""",
}
