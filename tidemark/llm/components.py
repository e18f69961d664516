"""Connected components of a table of links, by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """links: a, b (longs). A row per node that has a link: node, comp (its component's smallest node).

    Each round every node takes the smallest of itself and its neighbours as its parent,
    parents are followed once more, and the links are redrawn between the parents. Only
    partial aggregates and joins move rows; the driver sees whether links are left.
    """
    edges = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mapping: DataFrame | None = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"))
        parent = materialize(parent, "parents")
        above = parent.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        parent = materialize(parent.join(above, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "parents")
        step = parent.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        mapping = parent if mapping is None else materialize(mapping.join(step, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "components")
        a, b = (parent.select(F.col("node").alias(c), F.col("comp").alias(f"{c}2")) for c in "ab")
        edges = edges.join(a, "a").join(b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        edges = materialize(edges, "links")
        if edges.isEmpty():
            return mapping
