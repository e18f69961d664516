"""Clusters through their life, coordinates to scopes, extraction outcomes, and graph commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches, extraction, graph_writes
from ..operators.scopes import ScopeIndex, resolve_classes
from ..session import scratch, table
from ..sources.commits import CommittedTables
from ..sources.feeds import GRAPH_KEYS, GRAPH_RULES
from ..streaming.lifecycle import Rules, lifecycle
from ..streaming.topics import topic_table
from . import places

# --- clusters

RULES = Rules("firms", least=3, window=86_400, quiet=21_600)
UPTO = 1_706_745_600  # 2024-02-01
START = 1_704_240_000  # 2024-01-03
_CELL = "concat('cell:', cast(floor(lat / 30) as string), ':', cast(floor(lon / 30) as string))"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from the third day on as signals of their cell; errors of a high value promote, signups of one silence a day."""
    p = table(spark, sf_dir, "events").selectExpr("*", f"{places.LAT} as lat", f"{places.LON} as lon", "cast(ts as timestamp) as at")
    kind = "case when event_type = 'error' and value > 100 then 'promote' when event_type = 'signup' and value > 100 then 'silence' else 'signal' end"
    rows = p.selectExpr(f"{_CELL} as key", "at as ts", f"{kind} as kind", "lpad(cast(event_id as string), 12, '0') as id", "unix_timestamp(at) + 86400 as until")
    return rows.where(F.unix_timestamp("ts") >= START)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents as a store has them: one per purchase of the first two days, every one of a cell with its mark."""
    p = table(spark, sf_dir, "events").selectExpr("*", f"{places.LAT} as lat", f"{places.LON} as lon", "unix_timestamp(cast(ts as timestamp)) as s")
    status = "case when value > 100 then 'promoted' when value < 10 then 'closed' else 'open' end"
    return p.where(f"event_type = 'purchase' and s < {START}").selectExpr(
        "lpad(cast(event_id as string), 12, '0') as id", f"{status} as status", "'elevated' as severity", "s as trigger_s",
        f"array('events', 'auto_promoter:v1', concat('cluster:', {_CELL})) as layer_hints", "array(0.0D, 600.5D, 7200.0D) as offsets",
    )


def cluster_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09, STR-10, STR-11, STR-20: all that happens to the clusters of cells after a restart with stored incidents."""
    got = lifecycle(_signals(spark, sf_dir), RULES, UPTO, _stored(spark, sf_dir))
    return got.select("key", "incident", "seconds", "kind", "hits", "severity", F.array_join("ids", ",").alias("ids"))


_S = "CAST(floor((epoch_us(ts) // 1000) / 1000.0) AS BIGINT)"
_SQL_CELL = "'cell:' || CAST(CAST(floor(lat / 30) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(lon / 30) AS BIGINT) AS VARCHAR)"
# One row of state per key and step; what a step does is in two columns: what ended by itself before it, and what it did.
_LIFE = f"""WITH RECURSIVE e AS (SELECT *, {places.SQL_LAT} AS lat, {places.SQL_LON} AS lon, {_S} AS s FROM events),
rows AS (SELECT key, s, kind, id, until, row_number() OVER (PARTITION BY key ORDER BY s, turn, id) AS r FROM (
  SELECT {_SQL_CELL} AS key, s, CASE WHEN event_type = 'error' AND value > 100 THEN 'promote' WHEN event_type = 'signup' AND value > 100 THEN 'silence' ELSE 'signal' END AS kind,
   CASE WHEN event_type IN ('error', 'signup') AND value > 100 THEN 1 ELSE 0 END AS turn, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, s + 86400 AS until FROM e WHERE s >= {START}
  UNION ALL SELECT DISTINCT {_SQL_CELL}, {UPTO}, 'end', 2, '', 0 FROM e)),
stored AS (SELECT {_SQL_CELL} AS key, lpad(CAST(event_id AS VARCHAR), 12, '0') AS incident, CASE WHEN value > 100 THEN 'promoted' ELSE 'open' END AS status, s FROM e WHERE event_type = 'purchase' AND s < {START} AND value >= 10
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC, incident DESC) = 1),
keys AS (SELECT DISTINCT key FROM rows),
f AS (
 SELECT k.key, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS muted, st.status, st.incident, CASE WHEN st.key IS NULL THEN 0 ELSE 3 END::BIGINT AS hits, coalesce(st.s + 7200, 0) AS last,
  CASE WHEN st.key IS NOT NULL THEN 1 ELSE 0 END AS sev, []::VARCHAR[] AS ids, false AS ignited, []::BIGINT[] AS recent, []::VARCHAR[] AS rids,
  CAST(NULL AS VARCHAR) AS k1, CAST(NULL AS BIGINT) AS t1, CAST(NULL AS VARCHAR) AS i1, CAST(0 AS BIGINT) AS h1, 0 AS v1, []::VARCHAR[] AS d1, CAST(NULL AS VARCHAR) AS k2, CAST(NULL AS BIGINT) AS t2, CAST(NULL AS VARCHAR) AS i2, CAST(0 AS BIGINT) AS h2, 0 AS v2, []::VARCHAR[] AS d2
 FROM keys k LEFT JOIN stored st ON st.key = k.key
 UNION ALL
 SELECT key, r, muted, status, incident, hits, last, sev, ids, ignited, recent, rids, k1, t1, i1, h1, v1, d1, k2, t2,
  CASE WHEN k2 IS NULL THEN NULL WHEN k2 IN ('promote', 'silence') THEN i0 ELSE incident END, CASE WHEN k2 = 'silence' THEN h0 ELSE hits END, CASE WHEN k2 = 'silence' THEN v0 ELSE sev END, CASE WHEN k2 = 'silence' THEN d0 ELSE ids END
 FROM (
  SELECT key, r, k1, t1, i1, h1, v1, d1, k2, s AS t2, incident AS i0, hits AS h0, sev AS v0, ids AS d0,
   CASE WHEN k2 = 'silence' THEN until ELSE muted END AS muted,
   CASE k2 WHEN 'silence' THEN NULL WHEN 'promote' THEN 'promoted' WHEN 'open' THEN 'open' ELSE status END AS status,
   CASE k2 WHEN 'silence' THEN NULL WHEN 'open' THEN key || '@' || s ELSE incident END AS incident,
   CASE WHEN k2 = 'silence' THEN 0 WHEN k2 IN ('open', 'update') THEN hits + len(fresh) ELSE hits END AS hits,
   CASE WHEN k2 IN ('open', 'update', 'absorb') THEN s ELSE last END AS last,
   CASE WHEN k2 = 'silence' THEN 0 WHEN k2 IN ('open', 'update') THEN greatest(sev, 2, CASE WHEN hits + len(fresh) >= 10 THEN 3 ELSE 2 END) ELSE sev END AS sev,
   CASE WHEN k2 = 'silence' THEN [] WHEN k2 IN ('open', 'update') THEN list_reverse(list_reverse(ids || fresh)[1:50]) ELSE ids END AS ids,
   CASE WHEN k2 = 'silence' THEN false ELSE ignited OR hit END AS ignited,
   CASE WHEN k2 = 'silence' OR hit THEN [] WHEN counts AND NOT ignited THEN recent || [s] ELSE recent END AS recent,
   CASE WHEN k2 = 'silence' OR hit THEN [] WHEN counts AND NOT ignited THEN rids || [id] ELSE rids END AS rids
  FROM (
   SELECT *, CASE WHEN ignited THEN [id] ELSE rids || [id] END AS fresh,
    CASE WHEN kind IN ('promote', 'silence') AND status = 'open' THEN kind WHEN hit AND status IS NULL THEN 'open' WHEN hit AND status = 'promoted' THEN 'absorb' WHEN hit THEN 'update' END AS k2
   FROM (
    SELECT *, counts AND (ignited OR len(recent) >= 2) AS hit FROM (
     SELECT *, kind = 'signal' AND muted IS NULL AS counts FROM (
      SELECT key, r, s, kind, id, until, CASE WHEN muted <= s THEN NULL ELSE muted END AS muted,
       CASE WHEN over THEN NULL ELSE status END AS status, CASE WHEN over THEN NULL ELSE incident END AS incident, CASE WHEN over THEN 0 ELSE hits END AS hits, CASE WHEN over THEN 0 ELSE last END AS last,
       CASE WHEN over THEN 0 ELSE sev END AS sev, CASE WHEN over THEN [] ELSE ids END AS ids, CASE WHEN over THEN false ELSE ignited END AS ignited,
       CASE WHEN over THEN [] ELSE list_filter(recent, lambda x: x >= s - 86400) END AS recent, CASE WHEN over THEN [] ELSE rids[len(recent) - len(list_filter(recent, lambda x: x >= s - 86400)) + 1:] END AS rids,
       CASE WHEN over THEN CASE status WHEN 'open' THEN 'close' ELSE 'drop' END END AS k1, last + 21600 AS t1, incident AS i1, hits AS h1, sev AS v1, ids AS d1
      FROM (SELECT f.* EXCLUDE (r, k1, t1, i1, h1, v1, d1, k2, t2, i2, h2, v2, d2), n.r, n.s, n.kind, n.id, n.until, f.status IS NOT NULL AND n.s - f.last >= 21600 AS over FROM f JOIN rows n ON n.key = f.key AND n.r = f.r + 1))))))),
o AS (SELECT key, i1 AS incident, t1 AS seconds, k1 AS kind, h1 AS hits, v1 AS v, d1 AS ids FROM f WHERE k1 IS NOT NULL UNION ALL SELECT key, i2, t2, k2, h2, v2, d2 FROM f WHERE k2 IS NOT NULL)
SELECT key, incident, seconds, kind, hits, ['low', 'elevated', 'high', 'critical'][v + 1] AS severity, array_to_string(ids, ',') AS ids FROM o"""

# --- topics

TOPIC_RULES = Rules("telegram", least=3, window=1_800, quiet=10**9, severity="elevated")


def near_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04, DD-10: the topic of each document among those of its language, in the order of their ids, a minute apart, with ignitions."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    rows = d.selectExpr("lang as shard", "timestamp_seconds(1700000000 + doc_id * 60) as ts", "'signal' as kind", "lpad(cast(doc_id as string), 12, '0') as id", "text as title", "source as channel", "cast(null as long) as until")
    got = topic_table(rows, TOPIC_RULES, most=6, most_shingles=10**9)
    return got.select("shard", "id", "topic", "kind", F.when(F.col("kind").isNotNull(), F.col("hits")).alias("hits"), "severity")


_TITLE = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[^ \\t\\n\\r\\f]+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_TOPICS = f"""WITH RECURSIVE w AS (SELECT lang AS shard, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id, 1700000000 + doc_id * 60 AS s, coalesce(source, '') AS ch, list_filter(string_split({_TITLE}, ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
m AS (SELECT shard, id, s, ch, list_distinct(w) AS w, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g, row_number() OVER (PARTITION BY shard ORDER BY s, id) AS r FROM w WHERE len(w) > 0),
f AS (SELECT DISTINCT shard, CAST(0 AS BIGINT) AS r, []::STRUCT(k VARCHAR, inst BIGINT, seen BIGINT, ch VARCHAR, g VARCHAR[], w VARCHAR[])[] AS t, CAST(NULL AS VARCHAR) AS key, CAST(0 AS BIGINT) AS inst FROM m
 UNION ALL SELECT shard, r, CASE WHEN b IS NOT NULL THEN list_transform(t, lambda x, i: CASE WHEN i = b THEN {{'k': x.k, 'inst': x.inst, 'seen': s, 'ch': x.ch, 'g': list_distinct(x.g || g), 'w': list_distinct(x.w || w)}} ELSE x END)
   ELSE list_filter(t, lambda x: x.k <> fresh AND (len(list_filter(t, lambda z: z.k <> fresh)) < 6 OR x.seen > list_min(list_transform(t, lambda y: y.seen)))) || [{{'k': fresh, 'inst': r, 'seen': s, 'ch': ch, 'g': g, 'w': w}}] END,
  CASE WHEN b IS NOT NULL THEN t[b].k ELSE fresh END, CASE WHEN b IS NOT NULL THEN t[b].inst ELSE r END
 FROM (SELECT *, CASE WHEN list_max(l) > 0 THEN list_position(l, list_max(l)) END AS b, 'telegram:topic:' || left(sha1(array_to_string(list_sort(g), '|')), 12) AS fresh
  FROM (SELECT *, list_transform(t, lambda x: CASE WHEN x.ch = ch AND ch <> '' THEN CASE WHEN jw(w, x.w) >= 0.45 THEN jw(w, x.w) ELSE 0 END ELSE CASE WHEN jw(g, x.g) >= 0.55 THEN jw(g, x.g) ELSE 0 END END) AS l
   FROM (SELECT f.shard, f.t, m.* EXCLUDE (shard) FROM f JOIN m ON m.shard = f.shard AND m.r = f.r + 1)))),
h AS (SELECT f.shard, m.id, m.s, f.key, f.inst, f.r, count(*) OVER (PARTITION BY f.shard, f.inst ORDER BY m.s RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW) AS n FROM f JOIN m ON m.shard = f.shard AND m.r = f.r),
o AS (SELECT shard, inst, min(r) AS r0, min_by(n, r) AS n0 FROM h WHERE n >= 3 GROUP BY 1, 2),
q AS (SELECT h.*, r0, n0, CASE WHEN h.r = r0 THEN 'open' WHEN h.r > r0 THEN 'update' END AS kind, CASE WHEN h.r >= r0 THEN n0 + count(*) FILTER (WHERE h.r > r0) OVER (PARTITION BY h.shard, h.inst ORDER BY h.r) END AS hits FROM h LEFT JOIN o ON o.shard = h.shard AND o.inst = h.inst)
SELECT shard, id, key AS topic, kind, CAST(hits AS BIGINT) AS hits, CASE WHEN hits >= 10 THEN 'critical' WHEN hits >= 5 THEN 'high' WHEN hits IS NOT NULL THEN 'elevated' END AS severity FROM q"""
for _a, _b in (("jw(w, x.w)", ("w", "x.w")), ("jw(g, x.g)", ("g", "x.g"))):
    _TOPICS = _TOPICS.replace(_a, "(len(list_intersect({0}, {1}))::DOUBLE / (len({0}) + len({1}) - len(list_intersect({0}, {1}))))".format(*_b))

# --- scopes


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root, a box of 72 by 30 degrees for each nation, and a diamond for each customer in its nation's box."""
    box = "array(array({}))".format(", ".join(f"named_struct('x', cast({x} as double), 'y', cast({y} as double))" for x, y in (("w", "s"), ("w + 72", "s"), ("w + 72", "s + 30"), ("w", "s + 30"), ("w", "s"))))
    diamond = "array(array({}))".format(", ".join(f"named_struct('x', {x} / 100.0D, 'y', {y} / 100.0D)" for x, y in (("(cx + r)", "cy"), ("cx", "(cy + r)"), ("(cx - r)", "cy"), ("cx", "(cy - r)"), ("(cx + r)", "cy"))))
    at = "n_nationkey % 5 * 72 - 180 as w", "n_nationkey div 5 * 30 - 75 as s"
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    nations = n.selectExpr("*", *at).selectExpr("concat('n', n_nationkey) as key", "'world' as parent", "'country' as kind", f"{box} as rings")
    own = c.join(n.selectExpr("n_nationkey", *at), c.c_nationkey == F.col("n_nationkey"))
    own = own.selectExpr("*", "200 + c_custkey * 13 % 400 as r", "w * 100 + 600 + c_custkey * 7919 % 6000 as cx", "s * 100 + 600 + c_custkey * 104729 % 1800 as cy")
    admins = own.selectExpr("concat('c', c_custkey) as key", "concat('n', n_nationkey) as parent", "'admin1' as kind", f"{diamond} as rings")
    root = spark.range(1).selectExpr("'world' as key", "cast(null as string) as parent", "'world' as kind", "cast(null as array<array<struct<x: double, y: double>>>) as rings")
    return root.unionByName(nations).unionByName(admins)


def located_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPA-03, SPA-05, SPA-13: points to scopes of a catalog of a polygon per customer and nation, with conflicts at edges and overlaps."""
    points = table(spark, sf_dir, "events").selectExpr("event_id", f"{places.LAT} as lat", f"{places.LON} as lon")

    def found(names: Column, classes: Column) -> dict[str, Column]:
        # a struct of one array, and texts instead of arrays, before points of one place part again
        of = F.transform(F.array(resolve_classes(names, classes)), lambda r: F.struct(r["scope"].alias("scope"), r["status"].alias("status"), F.array_join(r["conflicts"], ",").alias("conflicts")))[0]
        return {"found": of}

    got = ScopeIndex(_catalog(spark, sf_dir)).judge(points, found)
    return got.select("event_id", "found.scope", "found.status", "found.conflicts")


_SCOPES = """WITH p AS (SELECT event_id, event_id * 7919 % 17000 - 8500 AS y, event_id * 104729 % 36000 - 18000 AS x FROM events),
n AS (SELECT n_nationkey, (n_nationkey % 5 * 72 - 180) * 100 AS w, (n_nationkey // 5 * 30 - 75) * 100 AS s FROM nation),
c AS (SELECT 'c' || c_custkey AS key, 'n' || n_nationkey AS parent, 200 + c_custkey * 13 % 400 AS r, w + 600 + c_custkey * 7919 % 6000 AS cx, s + 600 + c_custkey * 104729 % 1800 AS cy FROM customer JOIN n ON n_nationkey = c_nationkey),
m AS (SELECT event_id, key, parent, abs(x - cx) + abs(y - cy) = r AS edge FROM p JOIN c ON abs(x - cx) + abs(y - cy) <= r),
k AS (SELECT event_id, 'n' || n_nationkey AS key, x IN (w, w + 7200) OR y IN (s, s + 3000) OR (x = -18000 AND w + 7200 = 18000) AS edge FROM p JOIN n ON (x BETWEEN w AND w + 7200 OR (x = -18000 AND w + 7200 = 18000)) AND y BETWEEN s AND s + 3000),
t AS (SELECT event_id, key, parent, edge FROM m UNION ALL SELECT event_id, key, NULL, edge FROM k WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.event_id = k.event_id AND m.parent = k.key)),
g AS (SELECT event_id, count(*) AS n, bool_or(edge) AS edge, min(key) AS key, count(DISTINCT coalesce(parent, key)) AS tops, min(coalesce(parent, key)) AS top, min(parent) AS parent, string_agg(key, ',' ORDER BY key) AS keys FROM t GROUP BY 1)
SELECT p.event_id, CASE WHEN n = 1 AND NOT edge THEN key WHEN n = 1 THEN parent WHEN tops = 1 THEN top END AS scope,
 CASE WHEN n > 1 OR edge THEN 'conflict' WHEN n = 1 THEN 'resolved' ELSE 'unresolved' END AS status, CASE WHEN n > 1 OR edge THEN keys ELSE '' END AS conflicts FROM p LEFT JOIN g ON g.event_id = p.event_id"""

# --- extraction and the graph

TYPES = ("military.strike", "civil.protest", "space.launch")
ALIASES = {"Thntblere": "The Notable"}


def stand_in(text: str, url: str) -> dict | str:
    """In place of a service: events are lines, entities capitalised words, and some documents fail as services do."""
    import re

    number = int(url.rsplit("/", 1)[1])
    if number % 29 == 3:
        raise TimeoutError
    if number % 31 == 5:
        raise extraction.HttpStatus(401 if number % 2 else 503)
    if number % 37 == 7:
        return '{"events": [{"title": "cut'
    if number % 41 == 9:
        raise extraction.Truncated
    lines = [line for line in text.split("\n") if line]
    kinds = (*TYPES, "made.up")
    events = [{"title": line[:40], "summary": line[:10], "codebook_type": kinds[len(line) % 4], "severity": ("low", "medium", "high", "critical")[len(line) % 4], "confidence": 0.5} for line in lines]
    names = list(dict.fromkeys(re.findall("[A-Z][a-z]{3,}", text)))
    entities = [{"name": n, "type": ("person", "organization", "creature")[len(n) % 3]} for n in names]
    countries = [{"name": "x", "country": c} for c in ("DE", "FR")[: 1 + number % 2]] if number % 3 else [{"name": "y", "country": "de"}]
    return {"events": events, "entities": entities, "locations": countries}


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", "concat('http://', source, '/', doc_id) as url", "concat(lang, ' ', doc_id) as title", "source")
    return extraction.extract(d, stand_in, TYPES, keep=("doc_id", "url", "title", "source"))


def extraction_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-09, TXT-10: the outcome of each document's extraction, and when a failed one is tried again."""
    plan = extraction.retry_plan(F.col("outcome"), F.col("doc_id") % 5, F.lit(1000))
    size = lambda c: F.coalesce(F.size(f"outcome.{c}"), F.lit(0))
    names = F.array_join(F.transform("outcome.entities", lambda e: e["name"]), ",")
    got = _outcomes(spark, sf_dir)
    return got.select("doc_id", "outcome.status", "outcome.error", size("events").alias("n_events"), size("entities").alias("n_entities"), F.coalesce(names, F.lit("")).alias("entities"), extraction.primary_type(F.col("outcome")).alias("primary_type"), *[c.alias(n) for n, c in plan.items()])


def graph_writes_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07, SNK-08, SNK-18, SNK-20, SNK-22: extractions, sightings, incidents and corroborations in commits over several tables,
    one of them replayed; the graph that a reader then sees."""
    store = CommittedTables(spark, scratch(spark, "graph"))
    answered = scratch(spark, "outcomes")
    _outcomes(spark, sf_dir).write.parquet(answered)  # the service is asked once
    outcomes = spark.read.parquet(answered)
    ev = table(spark, sf_dir, "events").selectExpr("*", f"{places.LAT} as lat", f"{places.LON} as lon", "unix_timestamp(cast(ts as timestamp)) as s")
    seen = ev.selectExpr("concat('u', user_id) as icao24", "event_type as callsign", "cast(user_id as string) as registration", "'t' as type_code", "'b' as branch", "case when event_type = 'view' then 0.0D else lat end as lat", "case when event_type = 'view' then 0.0D else lon end as lon", "value as altitude_m", "1.0D as speed_ms", "2.0D as heading", "s as seconds")
    told = ev.where("event_type = 'error'").selectExpr("event_id as id", "'fire' as kind", "props as title", "'high' as severity", "'open' as status", "s as trigger_s", "case when value < 20 then cast(null as double) else lat end as lat", "lon", "cast(null as string) as location")
    pairs = ev.where("event_type = 'purchase'").selectExpr("concat('a', user_id) as src", "concat('b', event_id % 97) as dst", "value as score", "lat as distance_km", "cast(event_id as int) as days")
    commits = {
        "extraction": graph_writes.extraction_tables(outcomes, "2024-01-01T00:00:00", ALIASES, store.write),
        "sightings": graph_writes.aircraft_tables(seen, store.write),
        "incidents": graph_writes.incident_tables(told),
        "closed": graph_writes.incident_tables(told.withColumn("status", F.lit("closed")).withColumn("trigger_s", F.lit(0).cast("long"))),
        "corroborations": graph_writes.corroboration_table(pairs),
    }
    keys = {name: GRAPH_KEYS[name] for name in graph_writes.ONE_A_KEY}
    for name, tables in commits.items():
        store.commit(name, tables, keys=keys)
    store.commit("incidents", commits["incidents"], keys=keys)  # a replay
    current = {name: store.current(name, GRAPH_KEYS[name], GRAPH_RULES[name]) for name in GRAPH_KEYS}
    as_text = {
        "document": ("url", "title"), "entity": ("concat_ws('|', name, type)", "array_join(aliases, ',')"), "event": ("event_key", "concat_ws('|', title, codebook_type, severity, time_basis)"),
        "location": ("loc_key", "concat_ws('|', country, basis)"), "aircraft": ("icao24", "concat_ws('|', callsign, last_seen)"), "incident": ("cast(id as string)", "concat_ws('|', status, trigger_s)"),
        "edge": ("concat_ws(' ', src, rel, dst)", "''"), "spotted_at": ("dedup_key", "concat_ws('|', seconds, cast(round(lat * 100) as int))"), "corroborated_by": ("concat_ws(' ', src, dst)", "cast(days as string)"),
    }
    out = None
    for name, (key, value) in as_text.items():
        rows = current[name].selectExpr(f"'{name}' as kind", f"{key} as key", f"{value} as value")
        out = rows if out is None else out.unionByName(rows)
    return out


_WORDS = "list_distinct(regexp_extract_all(x, '[A-Z][a-z]{3,}'))"
_EXTRACT = """d AS (SELECT doc_id, 'http://' || source || '/' || doc_id AS url, lang || ' ' || doc_id AS title, source, left(coalesce(text, ''), 4000) AS x FROM documents),
o AS (SELECT *, CASE WHEN doc_id % 29 = 3 THEN 'timeout' WHEN doc_id % 31 = 5 THEN CASE WHEN doc_id % 2 = 1 THEN 'http 401' ELSE 'http 503' END WHEN doc_id % 37 = 7 THEN 'parse' WHEN doc_id % 41 = 9 THEN 'truncated' END AS error FROM d),
ln AS (SELECT doc_id, list_filter(string_split(x, chr(10)), lambda v: v <> '')[1:5] AS l FROM o WHERE error IS NULL),
wd AS (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(m) AS w, generate_subscripts(m, 1) AS i FROM (SELECT doc_id, regexp_extract_all(x, '[A-Z][a-z]{3,}') AS m FROM o WHERE error IS NULL)) GROUP BY 1, 2),
en AS (SELECT doc_id, w, i, ['person', 'organization', 'creature'][len(w) % 3 + 1] AS type FROM wd QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 20),
eg AS (SELECT doc_id, count(*) AS n, string_agg(w, ',' ORDER BY i) AS names FROM en GROUP BY 1)"""
_KIND = "['military.strike', 'civil.protest', 'space.launch', 'other.unclassified'][len({}) % 4 + 1]"
_OUTCOMES = f"""WITH {_EXTRACT}
SELECT o.doc_id, CASE WHEN error IS NULL THEN 'ok' WHEN error = 'http 401' THEN 'config' ELSE 'transient' END AS status, error, CAST(coalesce(len(l), 0) AS INTEGER) AS n_events, CAST(coalesce(n, 0) AS INTEGER) AS n_entities, coalesce(names, '') AS entities,
 coalesce({_KIND.format('l[1]')}, 'other.unclassified') AS primary_type, o.doc_id % 5 + CASE WHEN error IS NOT NULL AND error <> 'http 401' THEN 1 ELSE 0 END AS attempts,
 CASE WHEN error IS NULL THEN 'done' WHEN error = 'http 401' THEN 'held' WHEN o.doc_id % 5 + 1 >= 5 THEN 'failed' ELSE 'retry' END AS state,
 CASE WHEN error IS NOT NULL AND error <> 'http 401' AND o.doc_id % 5 + 1 < 5 THEN 1000 + CAST(least(3600, 60 * pow(2, o.doc_id % 5 + 1)) AS BIGINT) END AS due_s
FROM o LEFT JOIN ln ON ln.doc_id = o.doc_id LEFT JOIN eg ON eg.doc_id = o.doc_id"""
_GRAPH = f"""WITH {_EXTRACT},
w AS (SELECT o.*, l, n FROM o LEFT JOIN ln ON ln.doc_id = o.doc_id LEFT JOIN eg ON eg.doc_id = o.doc_id WHERE error IS NULL AND (len(l) > 0 OR n > 0)),
ent AS (SELECT DISTINCT 'http://' || source || '/' || w.doc_id AS url, CASE en.w WHEN 'Thntblere' THEN 'The Notable' ELSE en.w END AS name, CASE en.type WHEN 'person' THEN 'PERSON' WHEN 'organization' THEN 'ORGANIZATION' ELSE en.type END AS type, CASE en.w WHEN 'Thntblere' THEN en.w ELSE '' END AS alias FROM w JOIN en ON en.doc_id = w.doc_id),
evr AS (SELECT url, doc_id, left(v, 40) AS title, {_KIND.format('v')} AS kind, ['low', 'medium', 'high', 'critical'][len(v) % 4 + 1] AS severity, sha256(lower(trim(title)) || '|' || lower(trim(url))) AS h FROM (SELECT url, doc_id, title, unnest(l) AS v FROM w)),
evk AS (SELECT *, substr(sha256(h || '|' || kind || '|' || substr(lower(regexp_replace(trim(title), '[ \\t\\n\\f\\r]+', ' ', 'g')), 1, 200)), 1, 24) AS k FROM evr),
ev1 AS (SELECT k, kind, min(title) AS title, min_by(severity, title) AS severity FROM evk GROUP BY 1, 2),
pl AS (SELECT url, 'spatial:country:de' AS loc FROM w WHERE doc_id % 3 > 0 AND doc_id % 2 = 0),
e AS (SELECT *, {places.SQL_LAT} AS lat, {places.SQL_LON} AS lon, {_S} AS s FROM events),
q AS (SELECT 'u' || user_id AS icao24, 'u' || user_id || '|' || CAST(s // 900 * 900 AS VARCHAR) AS k, * FROM e),
sp AS (SELECT k, max(s) AS s, max_by(lat, (s, lat, lon)) AS lat FROM q WHERE event_type <> 'view' AND NOT (lat = 0 AND lon = 0) GROUP BY 1),
inc AS (SELECT event_id, s, CASE WHEN value < 20 THEN NULL ELSE lat END AS lat, lon FROM e WHERE event_type = 'error'),
il AS (SELECT event_id, 'geo:' || printf('%.3f', lat) || ',' || printf('%.3f', lon) AS loc FROM inc WHERE lat IS NOT NULL AND NOT (lat = 0 AND lon = 0))
SELECT 'document' AS kind, url AS key, title AS value FROM w
UNION ALL SELECT 'entity', name || '|' || type, max(alias) FROM ent GROUP BY name, type
UNION ALL SELECT 'event', k, title || '|' || kind || '|' || severity || '|ingested' FROM ev1
UNION ALL SELECT DISTINCT 'location', loc, 'DE|source_country_code' FROM pl
UNION ALL SELECT 'location', 'aircraft-observation:' || k, 'observation' FROM sp
UNION ALL SELECT DISTINCT 'location', loc, 'incident_report' FROM il
UNION ALL SELECT 'aircraft', icao24, max_by(event_type, (s, event_type)) || '|' || max(s) FROM q GROUP BY icao24
UNION ALL SELECT 'incident', CAST(event_id AS VARCHAR), 'closed|' || s FROM inc
UNION ALL SELECT DISTINCT 'edge', 'document:' || url || ' MENTIONS entity:' || name || '|' || type, '' FROM ent
UNION ALL SELECT DISTINCT 'edge', 'document:' || url || ' DESCRIBES event:' || k, '' FROM evk
UNION ALL SELECT DISTINCT 'edge', 'event:' || k || ' OCCURRED_AT location:' || loc, '' FROM evk JOIN pl ON pl.url = evk.url
UNION ALL SELECT 'edge', 'incident:' || event_id || ' OCCURRED_AT location:' || loc, '' FROM il
UNION ALL SELECT 'spotted_at', k, s || '|' || CAST(round(lat * 100) AS INTEGER) FROM sp
UNION ALL SELECT 'corroborated_by', 'a' || user_id || ' b' || (event_id % 97), CAST(max_by(event_id, (value, lat, event_id)) AS VARCHAR) FROM e WHERE event_type = 'purchase' GROUP BY user_id, event_id % 97"""

def reenrichment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SPA-09, SPA-16, AGG-17, AGG-21: a change to all customers' nations, approved by its fingerprint and applied in pages with a stop between two;
    its report, and what the control table and the written records hold."""
    c = table(spark, sf_dir, "customer")
    status = "case when c_custkey % 11 = 0 then 'unresolved' when c_acctbal < 0 then 'conflict' when c_custkey % 3 = 0 then 'already_normalized' else 'resolvable' end"
    plan = c.selectExpr("c_custkey as record_id", "c_mktsegment as source", "cast(c_nationkey % 4 as string) as code_system", f"{status} as status").withColumn("change", F.when(F.col("status") == "resolvable", F.struct(F.concat(F.lit("n"), F.col("code_system")).alias("scope"))))
    store = CommittedTables(spark, scratch(spark, "reenrichment"))
    paged = batches.PagedChange(store, "customers", "scopes")
    paged.approve(plan, batches.approval(plan), 6)
    paged.apply(most_pages=2)
    paged.apply()
    done = store.read("scopes").groupBy("scope").agg(F.count("*").alias("records"), F.countDistinct("record_id").alias("writes"))
    control = paged.progress().agg(F.sum("writes").alias("records"), F.max("cursor").alias("writes"))
    out = batches.report(plan).unionByName(done.select(F.lit("written").alias("dimension"), F.col("scope").alias("value"), F.lit(None).cast("string").alias("status"), "records", "writes"))
    return out.unionByName(control.select(F.lit("control").alias("dimension"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("status"), "records", "writes"))


_REPORT = """WITH p AS (SELECT c_custkey AS id, c_mktsegment AS source, CAST(c_nationkey % 4 AS VARCHAR) AS cs, CASE WHEN c_custkey % 11 = 0 THEN 'unresolved' WHEN c_acctbal < 0 THEN 'conflict' WHEN c_custkey % 3 = 0 THEN 'already_normalized' ELSE 'resolvable' END AS status FROM customer),
w AS (SELECT * FROM p WHERE status = 'resolvable')
SELECT 'source' AS dimension, source AS value, status, count(*) AS records, count(*) FILTER (WHERE status = 'resolvable') AS writes FROM p GROUP BY source, status
UNION ALL SELECT 'code_system', cs, status, count(*), count(*) FILTER (WHERE status = 'resolvable') FROM p GROUP BY cs, status
UNION ALL SELECT 'all', NULL, status, count(*), count(*) FILTER (WHERE status = 'resolvable') FROM p GROUP BY status
UNION ALL SELECT 'written', 'n' || cs, NULL, count(*), count(*) FROM w GROUP BY cs
UNION ALL SELECT 'control', NULL, NULL, count(*), max(id) FROM w"""

QUERIES = {f.__name__: f for f in (cluster_lifecycle, near_duplicate_clusters, located_scopes, extraction_outcomes, reenrichment_report)} | {"graph_commits": graph_writes_committed}

ORACLE = {"cluster_lifecycle": _LIFE, "near_duplicate_clusters": _TOPICS, "located_scopes": _SCOPES, "extraction_outcomes": _OUTCOMES, "reenrichment_report": _REPORT, "graph_commits": _GRAPH}
