"""Scope catalog: key grammar, code crosswalks, projections and their validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import near_pairs

#: How scope keys are written, from the world down to the second level.
SCOPE_KEYS = (r"world", r"country:[A-Z]{3}", r"admin1:[A-Z]{3}:[A-Za-z0-9.-]{1,16}", r"admin2:[A-Z]{3}:[A-Za-z0-9.-]{1,16}:[A-Za-z0-9.-]{1,24}")


def valid_scope_key(key: Column) -> Column:
    return F.coalesce(key.rlike("^(" + "|".join(SCOPE_KEYS) + ")$"), F.lit(False))


def scope_depth(key: Column) -> Column:
    """0 for the world, 3 for the second level; null for keys outside the grammar."""
    kinds = ("world", "country", "admin1", "admin2")
    depth = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.substring_index(key, ":", 1)) - 1
    return F.when(valid_scope_key(key), depth.cast("int"))


def resolve_codes(rows: DataFrame, crosswalk: DataFrame, key: str, codes: str) -> DataFrame:
    """rows (key, codes: array of structs system, code) with the scopes that a crosswalk (system,
    code, scope) gives, sorted, and the codes that it lacks, as system:code."""
    each = rows.select(key, F.explode(codes).alias("c")).select(key, "c.system", "c.code").where("code is not null")
    found = each.join(crosswalk.select("system", "code", "scope"), ["system", "code"], "left")
    per = found.groupBy(key).agg(F.sort_array(F.collect_set("scope")).alias("scopes"), F.sort_array(F.collect_set(F.when(F.col("scope").isNull(), F.concat_ws(":", "system", "code")))).alias("unresolved"))
    empty = F.array().cast("array<string>")
    return rows.join(per, key, "left").withColumns({"scopes": F.coalesce("scopes", empty), "unresolved": F.coalesce("unresolved", empty)})


def one_to_one(mapping: DataFrame, left: str, right: str, valid: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A mapping's unambiguous pairs (within the valid left codes), and its conflicts: left codes
    with several right ones or the reverse."""
    pairs = mapping.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
    if valid is not None:
        pairs = pairs.join(valid.select(left).distinct(), left, "left_semi")
    by_left = pairs.groupBy(left).agg(F.count("*").alias("__l"))
    by_right = pairs.groupBy(right).agg(F.count("*").alias("__r"))
    marked = pairs.join(by_left, left).join(by_right, right)
    good = marked.where("__l = 1 and __r = 1").select(left, right)
    return good, marked.where("__l > 1 or __r > 1").select(left, right)


def canonical_names(rows: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """rows with the canonical name of an alias (alias_key, canonical), and whether an alias was used."""
    from ..functions.text import alias_key

    joined = rows.withColumn("__k", alias_key(name)).join(aliases.select(F.col("alias_key").alias("__k"), "canonical").dropDuplicates(["__k"]), "__k", "left")
    return joined.withColumns({"via_alias": F.col("canonical").isNotNull(), "canonical": F.coalesce("canonical", name)}).drop("__k")


def disagreement(rows: DataFrame, lat: str, lon: str, other_lat: str, other_lon: str, degrees: float = 0.01) -> DataFrame:
    """Rows whose two positions differ, and rows at (0, 0)."""
    differ = (F.abs(F.col(lat) - F.col(other_lat)) > degrees) | (F.abs(F.col(lon) - F.col(other_lon)) > degrees)
    return rows.agg(F.count("*").alias("rows"), F.count_if(differ).alias("disagree"), F.count_if((F.col(lat) == 0) & (F.col(lon) == 0)).alias("null_island"))


def too_near(seeds: DataFrame, centres: DataFrame, km: float) -> DataFrame:
    """Seeds that stand nearer to a centre than allowed, which must be none."""
    dated = lambda d: d.select("id", "lat", "lon", F.lit("2000-01-01").cast("date").alias("day"))
    return near_pairs(dated(seeds), dated(centres), km, 0).select(F.col("a_id").alias("seed"), F.col("b_id").alias("centre"), "distance_km")


def infeasible(parts: DataFrame, covered: DataFrame, mandatory: Column, most: int = 10) -> DataFrame:
    """Mandatory parts and the largest ones by ring count that are not covered, which must be none."""
    largest = parts.orderBy(F.col("rings").desc(), "key").limit(most)
    return parts.where(mandatory).unionByName(largest).select("key").distinct().join(covered.select("key"), "key", "left_anti")


def projection_problems(rows: DataFrame) -> DataFrame:
    """Why projected rows (status, tokens, conflict, revision) are not valid; an empty array if they are."""
    tokens = F.coalesce("tokens", F.array().cast("array<string>"))
    rules = {
        "revision": F.col("revision").isNotNull(),
        "sorted_unique": tokens == F.array_sort(F.array_distinct(tokens)),
        "resolved_has_tokens": (F.col("status") != "resolved") | (F.size(tokens) > 0),
        "conflict_has_status": F.col("conflict") == (F.col("status") == "conflict"),
        "unavailable_is_empty": ~F.col("status").isin("unavailable", "unresolved") | (F.size(tokens) == 0),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(False)), n) for n, r in rules.items()]))
    return rows.withColumn("problems", broken)


COMPLETENESS = ("unavailable", "partial", "approximate", "complete")


def worst_completeness(rows: DataFrame, key: str, completeness: str) -> DataFrame:
    """Of several consumers the least complete wins."""
    rank = F.array_position(F.array(*[F.lit(c) for c in COMPLETENESS]), F.col(completeness))
    return rows.groupBy(key).agg(F.min_by(completeness, rank).alias(completeness), F.count("*").alias("consumers"))


def missing_lanes(rows: DataFrame, key: str, lane: str, required: Sequence[str]) -> DataFrame:
    """Per key the required lanes that it lacks, sorted."""
    have = rows.groupBy(key).agg(F.collect_set(lane).alias("__have"))
    return have.select(key, F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), "__have")).alias("missing"))


def unavailable(rows: DataFrame, reason: str, version: str) -> DataFrame:
    """rows with an explicit spatial payload that no filter can match, for writers that have no place to give."""
    if not reason.strip():
        raise ValueError("a reason is needed")
    none = F.array().cast("array<string>")
    payload = {"about_tokens": none, "occurrence_tokens": none, "basis": none, "version": F.lit(version), "conflict": F.lit(False), "conflict_keys": none, "status": F.lit("unavailable"), "reason": F.lit(reason)}
    return rows.withColumn("spatial", F.struct(*[c.alias(n) for n, c in payload.items()]))
