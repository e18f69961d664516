"""Spatial joins, accounting, extents and scope normalisation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, haversine_km


def near_pairs(a: DataFrame, b: DataFrame, reach_km: float, days: int, degrees: float = 1.0) -> DataFrame:
    """Pairs within a distance and a number of days. a, b: id, lat, lon, day (date).

    Rows meet by cells of the grid and of the calendar, so the join is one of equal keys: b is put into its own cell
    and those around it that can hold a partner, a under each day that can (neither is held once for both). Rows carry
    their point on the unit sphere: pairs of a cell that are too far apart by the product of these (with a margin far
    above rounding) go before the exact distance is worked out, of which all that belongs to one row comes with it. Pairs
    are many more than rows, so the number of tasks follows the cores and not the bytes. Cells must not be smaller than
    the reach; near the poles longitudes crowd, so a row of cells is wide enough for its own latitude, and the dateline
    wraps.
    """
    if reach_km > degrees * 110.0:
        raise ValueError("cells are smaller than the reach")
    row = lambda c: F.floor((F.col(c) + 90) / degrees)
    # columns per row of cells: as many as keep a column wider than the reach at the row's poleward edge
    edge = lambda r: F.greatest(F.abs(r * degrees - 90), F.abs((r + 1) * degrees - 90))
    count = lambda r: F.greatest(F.floor(F.lit(360.0) / (F.lit(degrees) / F.greatest(F.cos(F.radians(F.least(edge(r), F.lit(89.9)))), F.lit(1e-3)))), F.lit(1))
    column = lambda lon, n: F.floor((F.col(lon) + 180) / 360 * n)
    spark = a.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    keys = ["r", "k", "d"]
    own = {"v": F.radians("lat"), "u": F.radians("lon"), "c": F.cos(F.radians("lat"))}
    sphere = {"x": F.cos(F.radians("lat")) * F.cos(F.radians("lon")), "y": F.cos(F.radians("lat")) * F.sin(F.radians("lon")), "z": F.sin(F.radians("lat"))}
    here = lambda df: df.where("lat between -90 and 90 and lon between -180 and 180 and day is not null").withColumns(own | sphere | {"d": F.unix_date("day")})
    # one level after another, each compiled: nested lambdas took 0.3 ms a row; dealt first, since a small file is one task
    left = here(a.repartition("id")).withColumn("r", row("lat")).withColumn("k", F.pmod(column("lon", count(F.col("r"))), count(F.col("r"))))
    left = left.withColumn("d", F.explode(F.array(*[F.col("d") + i for i in range(-days, days + 1)])))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    columns = F.array_distinct(F.array(*[F.pmod(column("lon", F.col("n")) + i, F.col("n")) for i in (-1, 0, 1)]))
    right = here(b.repartition("id")).withColumn("__i", F.explode(around)).withColumn("r", row("lat") + F.col("__i")).withColumn("n", count(F.col("r"))).withColumn("k", F.explode(columns))
    named = lambda df, side: df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "lat", "lon", "day", *own, *sphere)], *keys).repartition(parts, *keys)
    product = F.col("a_x") * F.col("b_x") + F.col("a_y") * F.col("b_y") + F.col("a_z") * F.col("b_z")
    met = named(left, "a").join(named(right, "b"), keys).where(product >= math.cos(min(reach_km / EARTH_KM, math.pi)) - 1e-9)
    met = met.withColumns({"__v": F.sin((F.col("b_v") - F.col("a_v")) / 2), "__u": F.sin((F.col("b_u") - F.col("a_u")) / 2)})
    distance = 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.col("__v") * F.col("__v") + F.col("a_c") * F.col("b_c") * (F.col("__u") * F.col("__u")), F.lit(1.0))))
    # a generated column is worked out once, however often later conditions name it
    met = met.withColumn("distance_km", F.explode(F.array(distance))).where(F.col("distance_km") <= reach_km)
    return met.withColumn("days", F.abs(F.date_diff("a_day", "b_day"))).drop(*keys, "__v", "__u", *(f"{side}_{c}" for side in "ab" for c in own | sphere))


def nearest_site(points: DataFrame, sites: Sequence[tuple[str, float, float]], reach_km: float) -> DataFrame:
    """points (lat, lon) with the nearest of a short literal list of sites within reach, and its distance."""
    each = F.array(*[F.struct(haversine_km("lat", "lon", F.lit(lat), F.lit(lon)).alias("km"), F.lit(name).alias("site")) for name, lat, lon in sites])
    near = F.array_min(F.filter(each, lambda s: s["km"] <= reach_km))
    return points.withColumn("__s", near).withColumns({"nearest_site": F.col("__s.site"), "distance_km": F.col("__s.km")}).drop("__s")


def locate(points: DataFrame, polygons: list[dict], degrees: float = 2.0) -> DataFrame:
    """points (lat, lon) with the scopes of a short list of polygons that hold them (sorted keys) and
    those on whose edge they lie, by the cells of ``operators.scopes``. polygons: dicts of key and rings of (lon, lat)."""
    from .scopes import CATALOG, ScopeIndex

    rows = [(p["key"], None, "scope", [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in p["rings"]]) for p in polygons]
    found = ScopeIndex(points.sparkSession.createDataFrame(rows, CATALOG), degrees).locate(points)
    keys = lambda edge: F.transform(F.filter("matches", lambda m: m["edge"] == edge), lambda m: m["key"])
    return found.withColumns({"inside": keys(False), "edge": keys(True)}).drop("matches")


def ancestors(scope: Column) -> Column:
    """world:country:admin1 keys as their lineage, shortest first."""
    parts = F.split(scope, ":")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ":"))


def normalize_scope(explicit: Column, unresolved: Column, located: Column, on_edge: Column) -> dict[str, Column]:
    """Scope of a location from its explicit scopes (array), unresolved codes (array), and the
    scopes that hold its coordinate. An unresolved code leaves it unresolved; explicit scopes of
    different lineages conflict; the deepest wins; a coordinate refines it only along the same
    lineage and deeper, else it conflicts; a point on an edge conflicts."""
    depth = lambda s: F.size(F.split(s, ":"))
    deepest = lambda arr: F.array_max(F.transform(arr, lambda s: F.struct(depth(s).alias("d"), s.alias("s"))))["s"]
    own, there = deepest(explicit), deepest(located)
    lineage = F.forall(explicit, lambda s: own.startswith(s))
    refines = there.isNotNull() & (own.isNull() | there.startswith(own))
    outside = there.isNotNull() & own.isNotNull() & ~there.startswith(own) & ~own.startswith(there)
    conflict = (F.size(explicit) > 0) & ~F.coalesce(lineage, F.lit(True)) | F.coalesce(outside, F.lit(False)) | (F.size(on_edge) > 0)
    scope = F.when(F.size(unresolved) > 0, F.lit(None)).when(F.coalesce(refines, F.lit(False)) & ~conflict, there).otherwise(own)
    status = F.when(F.size(unresolved) > 0, "unresolved").when(scope.isNull(), "none").when(conflict, "conflict").otherwise("resolved")
    return {"scope": scope, "status": status, "conflict": F.coalesce(conflict, F.lit(False))}


def precision(point: Column, scope: Column) -> Column:
    """point before admin2, admin1 and country."""
    d = F.size(F.split(scope, ":"))
    return F.when(point, "point").when(d >= 4, "admin2").when(d == 3, "admin1").when(d == 2, "country").otherwise("none")


def accounting(rows: DataFrame, classes: dict[str, Column], default: str = "unsupported") -> DataFrame:
    """One pass: each row has the first class whose condition holds; counts per class and in
    all, and whether they add up."""
    out = F.lit(default)
    for name, condition in reversed(classes.items()):
        out = F.when(condition, name).otherwise(out)
    counts = [F.count_if(F.col("__c") == name).alias(name) for name in (*classes, default)]
    totals = rows.select(out.alias("__c")).agg(F.count("*").alias("candidate"), *counts)
    whole = sum((F.col(c) for c in (*classes, default)), F.lit(0))
    return totals.withColumn("reconciled", F.col("candidate") == whole)


def longitude_extent(rows: DataFrame, keys: Sequence[str], lon: str, lat: str) -> DataFrame:
    """The smallest circular span of longitudes per key (the complement of the largest gap),
    with the span of latitudes. West exceeds east where the span crosses the antimeridian.
    Longitudes are told apart to four places, and the gaps come from a window over the
    distinct ones."""
    from pyspark.sql import Window

    clean = rows.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    lats = clean.groupBy(*keys).agg(F.min(lat).alias("south"), F.max(lat).alias("north"))
    lons = clean.select(*keys, F.round(lon, 4).alias("x")).distinct()
    w = Window.partitionBy(*keys)
    nxt = F.coalesce(F.lead("x").over(w.orderBy("x")), F.min("x").over(w) + 360.0)
    gaps = lons.withColumn("nxt", nxt).withColumn("gap", F.round(F.col("nxt") - F.col("x"), 4))
    widest = gaps.groupBy(*keys).agg(F.max_by(F.struct("x", "nxt"), F.struct("gap", "x")).alias("g"))
    west = F.when(F.col("g.nxt") > 180, F.round(F.col("g.nxt") - 360.0, 4)).otherwise(F.col("g.nxt"))
    return widest.select(*keys, west.alias("west"), F.col("g.x").alias("east")).join(lats, list(keys))


def scope_tokens(evidence: DataFrame, key: str) -> DataFrame:
    """Evidence rows (key, relation, scope, conflict) as sorted token arrays per key; a relation
    with a conflict withholds its own tokens."""
    each = evidence.groupBy(key, "relation").agg(F.bool_or("conflict").alias("conflict"), F.flatten(F.collect_set(ancestors(F.col("scope")))).alias("scopes"))
    tokens = F.when(F.col("conflict"), F.array().cast("array<string>")).otherwise(F.transform(F.filter("scopes", lambda s: s != "world"), lambda s: F.concat(F.col("relation"), F.lit(":"), s)))
    flat = each.select(key, "relation", "conflict", tokens.alias("tokens"))
    return flat.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens"), F.sort_array(F.collect_set(F.when(F.col("conflict"), F.col("relation")))).alias("withheld"))
