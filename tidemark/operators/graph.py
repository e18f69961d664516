"""A property graph as node and edge tables: hops, degrees, integrity, and merging of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: id, rel, a, b."""
    fore = edges.select("id", "rel", F.col("src").alias("a"), F.col("dst").alias("b"))
    return fore.unionByName(edges.select("id", "rel", F.col("dst").alias("a"), F.col("src").alias("b")))


def one_hop(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Neighbours of the given nodes (node): node, rel, neighbour; every edge once per end."""
    return nodes.join(both_ways(edges), F.col("node") == F.col("a")).select("node", "rel", F.col("b").alias("neighbour"))


def two_hops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct nodes within one or two edges, no edge walked twice: node, neighbour, hops (the least)."""
    both = both_ways(edges)
    first = nodes.join(both, F.col("node") == F.col("a")).select("node", F.col("id").alias("e1"), F.col("b").alias("mid"))
    second = first.join(both, F.col("mid") == F.col("a")).where("e1 <> id").select("node", F.col("b").alias("neighbour"), F.lit(2).alias("hops"))
    found = first.select("node", F.col("mid").alias("neighbour"), F.lit(1).alias("hops")).unionByName(second)
    return found.where("node <> neighbour").groupBy("node", "neighbour").agg(F.min("hops").alias("hops"))


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node; a loop counts twice."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def co_occurring(involved: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that share events with the given ones: entity, other, shared (distinct events).
    involved: event, entity. Only the given entities' events are joined back."""
    links = involved.distinct()
    mine = links.join(entities, "entity", "left_semi")
    others = links.select("event", F.col("entity").alias("other"))
    return mine.join(others, "event").where("entity <> other").groupBy("entity", "other").agg(F.count("*").alias("shared"))


def search(nodes: DataFrame, text: Column, needle: str) -> DataFrame:
    """Case-insensitive containment."""
    return nodes.where(F.lower(text).contains(needle.lower()))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """Per relation: edge keys that occur more than once, and the rows in excess."""
    each = edges.groupBy("src", "rel", "dst").agg(F.count("*").alias("c")).where("c > 1")
    return each.groupBy("rel").agg(F.count("*").alias("groups"), F.sum(F.col("c") - 1).alias("excess"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per label: nodes, and those without any edge. nodes: node, label."""
    linked = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("__linked", F.lit(True))
    return nodes.join(linked, "node", "left").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("__linked").isNull()).alias("orphans"))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, which must be none."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def merge_eligible(entities: DataFrame) -> DataFrame:
    """Groups of entities with one lower-cased name that may be merged: a single type, or countries
    with regions and locations, or regions with locations. entities: id, name, type."""
    only = lambda *allowed: F.size(F.array_except("types", F.array(*[F.lit(t) for t in allowed]))) == 0
    groups = entities.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("type")).alias("types"))
    places = (F.array_contains("types", "COUNTRY") & only("COUNTRY", "REGION", "LOCATION")) | (F.array_contains("types", "REGION") & only("REGION", "LOCATION"))
    return groups.where((F.col("n") > 1) & ((F.size("types") == 1) | places))


def survivors(entities: DataFrame, key: Column) -> DataFrame:
    """entities (id, degree, first_seen, ...) with the id that survives its group: highest
    degree, then earliest first_seen (null last), then smallest id."""
    order = [F.col("degree").desc(), F.col("first_seen").asc_nulls_last(), F.col("id")]
    return entities.withColumn("survivor", F.first("id").over(Window.partitionBy(key).orderBy(*order)))


def transfer_edges(edges: DataFrame, survivor: DataFrame) -> DataFrame:
    """Edges redrawn to the survivors; parallel edges and loops that result go. survivor: id, survivor."""
    side = lambda c: survivor.select(F.col("id").alias(c), F.col("survivor").alias(f"{c}_to"))
    moved = edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    moved = moved.select(F.coalesce("src_to", "src").alias("src"), "rel", F.coalesce("dst_to", "dst").alias("dst"))
    return moved.where("src <> dst").distinct()


def relation_support(relations: DataFrame, samples: int = 5) -> DataFrame:
    """Per relation: its distinct provenance (sorted), its support, and the first evidence samples in
    order; no more evidence than that is gathered."""
    keys = ["src", "rel", "dst"]
    # told apart by a grouping that can spill; where only the support is read, no array is made
    told = relations.select(*keys, "provenance").distinct().groupBy(*keys)
    provenance = told.agg(F.sort_array(F.collect_list("provenance")).alias("provenance"), F.count("provenance").cast("int").alias("support"))
    # a rank that equal evidence shares is limited in each task before the shuffle
    few = relations.select(*keys, "evidence").where("evidence is not null")
    few = few.withColumn("__n", F.dense_rank().over(Window.partitionBy(*keys).orderBy("evidence"))).where(F.col("__n") <= samples)
    few = few.groupBy(*keys).agg(F.sort_array(F.collect_set("evidence")).alias("evidence"))
    return provenance.join(few, keys, "left").select(*keys, "provenance", "evidence", "support")


def gate_relations(relations: DataFrame, rules: DataFrame) -> DataFrame:
    """Each relation (src, src_type, rel, dst, dst_type, confidence, evidence) with its lane and the
    first gate that it fails: a known relation, resolved types, no candidate-only relation, the
    source's type, the target's type. Symmetric relations that pass are sorted by their ends.
    rules: rel, mode, source_types, target_types, symmetric; a row per relation."""
    checked = relations.join(F.broadcast(rules.withColumnRenamed("rel", "__rel")), F.col("rel") == F.col("__rel"), "left")
    gate = (
        F.when(F.col("__rel").isNull(), "relation_type_unknown")
        .when(F.col("src_type").isNull() | F.col("dst_type").isNull(), "entity_type_unresolved")
        .when(F.col("mode") == "candidate_only", "relation_type_candidate_only")
        .when(~F.array_contains("source_types", F.col("src_type")), F.concat("rel", F.lit(".source_type")))
        .when(~F.array_contains("target_types", F.col("dst_type")), F.concat("rel", F.lit(".target_type")))
    )
    checked = checked.withColumn("failed_gate", gate)
    ends = lambda s: F.struct(F.col(s).alias("k"), F.col(f"{s}_type").alias("t"))
    swap = F.col("failed_gate").isNull() & F.col("symmetric") & (ends("dst") < ends("src"))
    side = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a)
    lane = F.when(F.col("failed_gate").isNull(), "canonical").otherwise("candidate").alias("lane")
    return checked.select(side("src", "dst"), side("src_type", "dst_type"), "rel", side("dst", "src"), side("dst_type", "src_type"), "confidence", "failed_gate", lane)
