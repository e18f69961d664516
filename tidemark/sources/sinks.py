"""Writes that can be repeated without harm."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_slices(rows: DataFrame, path: str, date_column: str = "date") -> None:
    """Date-partitioned Parquet; a replay replaces its own dates only."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_column).parquet(path)


def write_quarantine(aside: DataFrame, path: str, append: bool = True) -> None:
    aside.write.mode("append" if append else "overwrite").json(path)


def write_snapshot(rows: DataFrame, path: str) -> str:
    """A version of a small table by its content, made current by one rename: a reader finds the version before or this one.
    Content that is current already is not written again."""
    from ..operators.measures import fingerprint
    from .commits import CommittedTables

    name = fingerprint(rows, *rows.columns).first()["fingerprint"]
    store = CommittedTables(rows.sparkSession, path)
    if not any(m["batches"][-1].startswith(name) for m in store.manifests()[-1:]):
        store.commit(f"{name}-{uuid.uuid4().hex}", {"snapshot": rows}, compacted=True)
    return name


def read_snapshot(spark, path: str) -> DataFrame:
    from .commits import CommittedTables

    return CommittedTables(spark, path).read("snapshot").drop("__commit")


def fresh_snapshot(spark, path: str, now_s: int, ttl_s: int, stamp: str = "fetched_s") -> DataFrame | None:
    """The current version while it is younger than its time to live by its stamp column, else None: fetch anew."""
    from .commits import CommittedTables

    rows = CommittedTables(spark, path).read("snapshot")
    if rows is None or (at := rows.agg(F.max(stamp)).first()[0]) is None or now_s - at >= ttl_s:
        return None
    return rows.drop("__commit")


def geojson_features(rows: DataFrame, lon: str, lat: str, properties: list[str]) -> DataFrame:
    """One feature per row as JSON text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def edge_rows(entries: DataFrame, key: str, arrays: dict[str, str]) -> DataFrame:
    """An entry's arrays as edges: src, rel, dst (distinct)."""
    out = None
    for column, rel in arrays.items():
        e = entries.select(F.col(key).alias("src"), F.lit(rel).alias("rel"), F.explode(column).alias("dst")).distinct()
        out = e if out is None else out.unionByName(e)
    return out


def valid_points(rows: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Half pairs and the point (0, 0) become null."""
    whole = F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~((F.col(lat) == 0) & (F.col(lon) == 0))
    return rows.withColumns({lat: F.when(whole, F.col(lat)), lon: F.when(whole, F.col(lon))})


def vector_points(docs: DataFrame, embed, text, key: str) -> DataFrame:
    """Points for the vector table: id, the text that was embedded (1500 characters at most), and
    its vector by an injected pandas function."""
    body = docs.withColumn("embedded_text", F.substring(text, 1, 1500))
    return body.select(key, "embedded_text", embed(F.col("embedded_text")).alias("vector"))


def canonical_json(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))
