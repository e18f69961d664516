"""Enrichment joins: priorities, drift, match reports and crosswalks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_missing(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Full outer join where the left side has priority; which side a row comes from is its origin."""
    a = left.select(*keys, F.lit(True).alias("__l"), *[F.col(c).alias(f"l_{c}") for c in columns])
    b = right.select(*keys, F.lit(True).alias("__r"), *[F.col(c).alias(f"r_{c}") for c in columns])
    origin = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left").otherwise("right")
    return a.join(b, list(keys), "full_outer").select(*keys, *[F.coalesce(f"l_{c}", f"r_{c}").alias(c) for c in columns], origin.alias("origin"))


def with_drift(joined: DataFrame, distance: Column, limit_km: float, seeded: Column) -> DataFrame:
    """Which position holds: a seed's always, the newer one if it lies near, else the older with a flag."""
    choice = F.when(seeded, "seed").when(distance.isNull(), "only").when(distance <= limit_km, "update").otherwise("drift")
    return joined.withColumn("position_rule", choice)


def match_report(fresh: DataFrame, known: DataFrame, name: str, canonical: Column | None = None) -> DataFrame:
    """Each fresh name: matched by its lower-cased name, else by its canonical one; new, or
    ambiguous if several are known. known: id, name."""
    by_name = known.groupBy(F.lower(F.trim("name")).alias("__k")).agg(F.count("*").alias("__n"), F.min("id").alias("__id"))
    out = fresh.withColumn("__k", F.lower(F.trim(name))).join(by_name, "__k", "left")
    count, found = F.coalesce("__n", F.lit(0)), F.col("__id")
    if canonical is not None:
        second = by_name.select(F.col("__k").alias("__k2"), F.col("__n").alias("__n2"), F.col("__id").alias("__id2"))
        out = out.withColumn("__k2", canonical).join(second, "__k2", "left")
        found = F.when(count > 0, F.col("__id")).otherwise(F.col("__id2"))
        count = F.when(count > 0, count).otherwise(F.coalesce("__n2", F.lit(0)))
    outcome = F.when(count == 0, "new").when(count == 1, "match").otherwise("ambiguous")
    return out.select(*fresh.columns, outcome.alias("outcome"), F.when(outcome == "match", found).alias("matched_id"))


def drift(approved: DataFrame, fresh: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Approved rows against fresh ones: vanished, or the first column that differs."""
    b = fresh.select(*keys, F.lit(True).alias("__r"), *[F.col(c).alias(f"r_{c}") for c in columns])
    joined = approved.join(b, list(keys), "left")
    what = F.when(F.col("__r").isNull(), "vanished")
    for c in columns:
        what = what.when(~F.col(c).eqNullSafe(F.col(f"r_{c}")), c)
    return joined.select(*keys, what.alias("drift")).where("drift is not null")


def latest_year(values: Column) -> Column:
    """The value of the greatest four-digit year among a map's keys (0 for keys without one, a note
    left out); a later key wins ties. A value under ``text`` goes before all."""
    entries = F.filter(F.map_entries(values), lambda e: e["key"] != "note")
    year = lambda k: F.coalesce(F.try_to_number(F.regexp_extract(k, r"(\d{4})\b", 1), F.lit("9999")).cast("int"), F.lit(0))
    keyed = F.transform(entries, lambda e, i: F.struct(year(e["key"]).alias("year"), i.alias("pos"), e["value"].alias("value")))
    return F.when(F.map_contains_key(values, "text"), F.try_element_at(values, F.lit("text"))).otherwise(F.array_max(keyed)["value"])


def first_per_key(rows: DataFrame, key: str, n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows of each key, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)


def _run(n: int):
    return lambda i: F.array_join(F.slice("__w", i, n), " ")


def longest_contained(texts: DataFrame, names: DataFrame, text: str, least: int = 4) -> DataFrame:
    """The longest known name that stands as words in each text; names: name. The names are a
    curated list: they are checked to be few before they are broadcast, and every text is cut
    into word runs that are looked up, so texts and names never meet pairwise."""
    known = names.where(F.length("name") >= least).select("name", F.lower("name").alias("__key"), F.size(F.split(F.lower("name"), " ")).alias("__words")).distinct()
    longest = known.agg(F.max("__words")).first()[0] or 0
    words = F.filter(F.split(F.regexp_replace(F.lower("__id"), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    # each distinct text is looked up once; its rows get the name by the text itself
    rows = texts.select(F.col(text).alias("__id")).distinct().withColumn("__w", words)
    runs = [F.transform(F.sequence(F.lit(1), F.size("__w") - (n - 1)), _run(n)) for n in range(1, longest + 1)]
    safe = [F.when(F.size("__w") >= n + 1, r).otherwise(F.array().cast("array<string>")) for n, r in enumerate(runs)]
    keys = rows.select("__id", F.explode(F.array_distinct(F.flatten(F.array(*safe)))).alias("__key")) if safe else rows.select("__id", F.lit("").alias("__key"))
    best = keys.join(F.broadcast(known) if known.limit(100_001).count() <= 100_000 else known, "__key").groupBy("__id").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("contained"))
    return texts.join(best, texts[text] == best["__id"], "left").drop("__id")


def by_scope(reports: DataFrame, requests: DataFrame) -> DataFrame:
    """The report of each request: its own key first, then its aliases in order, then the
    smallest id; and how many reports would do. requests: request, keys (array, own key first);
    reports: report_id, scope."""
    wanted = requests.select("request", F.posexplode("keys").alias("pos", "scope"))
    found = wanted.join(reports, "scope")
    w = Window.partitionBy("request")
    ranked = found.withColumns({"__n": F.row_number().over(w.orderBy("pos", "report_id")), "candidates": F.count("*").over(w)})
    return ranked.where("__n = 1").select("request", "report_id", "scope", "candidates")


def linked_evidence(documents: DataFrame, events: DataFrame, most: int = 5) -> DataFrame:
    """Each document's linked events (linked_event_ids), the highest scores first, at most so many."""
    return linked_pairs(documents.select("url", F.explode("linked_event_ids").alias("event_id")), events, most)


def linked_pairs(links: DataFrame, events: DataFrame, most: int = 5) -> DataFrame:
    """``linked_evidence`` from rows (url, event_id), each pair once; no document's events are gathered."""
    return first_per_key(links.distinct().join(events, "event_id"), "url", most, [F.col("score").desc(), F.col("event_id")])


def geo_backfill(events: DataFrame, located: DataFrame, raw: DataFrame) -> DataFrame:
    """Positions for events that have none yet. events, located: event_id; raw: event_id, lat, lon."""
    return events.join(located, "event_id", "left_anti").join(raw.where("lat is not null and lon is not null and not (lat = 0 and lon = 0)"), "event_id")


def rows_of(old: DataFrame, new: DataFrame, key: str, recorded: str) -> DataFrame:
    """Candidates of two runs, one per key, with the time at which each was first recorded."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.min(recorded).alias(recorded), *[F.max_by(c, recorded).alias(c) for c in old.columns if c not in (key, recorded)])


def judge_misses(relations: DataFrame, cache: DataFrame, config: str) -> DataFrame:
    """Relations whose verdict under this configuration is not cached; errors never are."""
    known = cache.where((F.col("config") == config) & (F.col("verdict") != "error")).select("relation_hash")
    return relations.join(known, "relation_hash", "left_anti")


def skipped_by_type(items: DataFrame, kind: str, ok: Column) -> DataFrame:
    """How many items of each type could not be built."""
    return items.where(~F.coalesce(ok, F.lit(False))).groupBy(kind).agg(F.count("*").alias("skipped"))


def hotspot_mentions(titles: DataFrame, hotspots: DataFrame, most: int = 100) -> DataFrame:
    """Titles that name each hotspot (keyword, one word), counted up to a limit that the level needs."""
    words = titles.select("id", F.explode(F.array_distinct(F.split(F.lower("title"), "[^a-z0-9]+"))).alias("keyword"))
    named = words.join(hotspots.select("hotspot", F.lower("keyword").alias("keyword")), "keyword").select("id", "hotspot").distinct()
    counted = named.groupBy("hotspot").agg(F.count("*").alias("n"))
    return hotspots.select("hotspot").distinct().join(counted, "hotspot", "left").select("hotspot", F.least(F.coalesce("n", F.lit(0)), F.lit(most)).cast("long").alias("mentions"))
