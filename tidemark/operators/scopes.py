"""Coordinates to scopes of a catalog: a cover of the polygons by cells, exact tests on border cells only.

A catalog has a row per scope: key, parent (null: a root), kind, rings (closed rings of (x, y) as longitude and
latitude, even-odd; null or empty: no geometry). Rings may run over the date line; they are
unwrapped. ``ScopeIndex`` cuts each polygon into cells of a grid: cells that lie wholly inside it, and border cells,
which carry the polygon's edges of their row of cells (ray casting to the east needs no others). One row per
cell holds all its candidates, so a point meets them by one equality join on its cell, and the rest is
expressions in its own row: no loop over polygons, nothing is collected, no second shuffle where the cover is broadcast.

Scopes of one parent with the same rings are one class: they are cut, held and tested once. Points of one place are
judged once, a hundred at a time, where the cover is joined by a shuffle.

Nulls and odd rows: a point that is null, not finite or out of range has no matches; equal points each get theirs;
scopes without geometry match nothing; an empty catalog matches nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: Two tolerances for "on the edge": metres, or the cross product in degrees.
EDGE_M, EDGE_EXACT = 0.1, 1e-10
#: A cover with more edges than this is joined by a shuffle instead of a broadcast.
MOST_EDGES = 500_000
CATALOG = "key string, parent string, kind string, rings array<array<struct<x: double, y: double>>>"
#: Rows of one place that share what was found for it, where the cover is joined by a shuffle.
TOGETHER = 100
_CELL = "cell long, above array<string>, keys array<string>, whole boolean, edges array<struct<x1: double, y1: double, x2: double, y2: double>>"


def lineages(catalog: DataFrame, deepest: int = 8) -> DataFrame:
    """key, path (keys from the root to the scope) and fault per scope: ``duplicate`` (the key has several rows),
    ``orphan`` (a parent that is no row), ``cycle`` (or deeper than ``deepest``), else null. One row per key."""
    once = catalog.groupBy("key").agg(F.min("parent").alias("parent"), F.count("*").alias("rows"))
    up = once.select(F.col("key").alias("__k"), F.col("parent").alias("__p"))
    held = once.select("key", "rows", F.array("key").alias("path"), F.col("parent").alias("next"), F.lit(False).alias("orphan"))
    for _ in range(deepest - 1):
        met = held.join(up, held["next"] == up["__k"], "left")
        there = F.col("__k").isNotNull()
        held = met.select("key", "rows", F.when(there, F.array_prepend("path", F.col("__k"))).otherwise(F.col("path")).alias("path"), F.when(there, F.col("__p")).alias("next"), (F.col("orphan") | (F.col("next").isNotNull() & ~there)).alias("orphan"))
    fault = F.when(F.col("rows") > 1, "duplicate").when(F.col("orphan"), "orphan").when(F.col("next").isNotNull() | (F.size(F.array_distinct("path")) < F.size("path")), "cycle")
    return held.select("key", "path", fault.alias("fault"))


def _edges(rings: list) -> np.ndarray:
    """x1, y1, x2, y2 of all edges, each ring unwrapped so that no edge is longer than half a turn."""
    found = []
    for ring in rings:
        if len(ring) < 2:
            continue
        p = np.array([(q["x"], q["y"]) for q in ring], float)
        turns = np.concatenate(([0.0], np.cumsum(-np.round(np.diff(p[:, 0]) / 360.0)))) * 360.0
        p[:, 0] += turns
        found.append(np.hstack((p[:-1], p[1:])))
    return np.vstack(found) if found else np.zeros((0, 4))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _cells(polygons: list[np.ndarray], degrees: float, slack_m: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cells of polygons given by their edges: which polygon, cell, whether it lies wholly inside, how many edges it has, and the
    edges of all cells one after another, shifted to the turn of the cell's longitudes. All polygons are cut at once."""
    rows, columns = round(180 / degrees), round(360 / degrees)
    slack = math.degrees(slack_m / EARTH_M) + 1e-9
    e = np.vstack(polygons)
    of = np.repeat(np.arange(len(polygons)), [len(x) for x in polygons])
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    # edges and the rows of cells that they reach, by polygon and row
    row_of = lambda y: np.clip(np.floor((y + 90) / degrees), 0, rows - 1).astype(np.int64)
    first, last = np.maximum(row_of(low - slack) - 1, 0), np.minimum(row_of(high + slack) + 1, rows - 1)
    edge = np.repeat(np.arange(len(e)), last - first + 1)
    row = _ranges(first, last - first + 1)
    met = (high[edge] >= row * degrees - 90 - slack) & (low[edge] <= (row + 1) * degrees - 90 + slack)
    edge, row = edge[met], row[met]
    order = np.argsort(of[edge] * rows + row, kind="stable")
    edge, row = edge[order], row[order]
    bands, start, band, many = np.unique(of[edge] * rows + row, return_index=True, return_inverse=True, return_counts=True)
    band_row = bands % rows
    # the columns that an edge touches in a row
    x1, y1, x2, y2 = e[edge].T
    south, north = row * degrees - 90, (row + 1) * degrees - 90
    pole = np.minimum(np.maximum(np.abs(south), np.abs(north)), 90.0)
    wide = np.minimum(slack / np.maximum(np.cos(np.radians(pole)), 1e-12), 360.0)
    level = y1 == y2
    ends = (np.array([south - slack, north + slack]) - y1) / np.where(level, 1, y2 - y1)
    ends = np.sort(np.clip(np.where(level, np.array([[0.0], [1.0]]), ends), 0, 1), axis=0)
    xs = np.sort(x1 + ends * (x2 - x1), axis=0)
    first = np.floor((xs[0] - wide + 180) / degrees).astype(np.int64)
    last = np.floor((xs[1] + wide + 180) / degrees).astype(np.int64)
    west, east = np.full(len(bands), np.iinfo(np.int64).max), np.full(len(bands), np.iinfo(np.int64).min)
    np.minimum.at(west, band, first)
    np.maximum.at(east, band, last)
    # a place for each column of each band, and one more: what begins at one and ends before another is summed up
    width = east - west + 2
    base = np.cumsum(width) - width
    touched = np.zeros(int(width.sum()), np.int64)
    np.add.at(touched, base[band] + first - west[band], 1)
    np.add.at(touched, base[band] + last - west[band] + 1, -1)
    border = np.cumsum(touched) > 0
    # ray casting from the middles of cells; one next to a crossing is a border cell in any case
    middle = (south + north) / 2
    crossed = (y1 > middle) != (y2 > middle)
    x1, y1, x2, y2, middle, through = (v[crossed] for v in (x1, y1, x2, y2, middle, band))
    at = x1 + (middle - y1) * (x2 - x1) / (y2 - y1)
    before = np.clip(np.ceil((at + 180) / degrees - 0.5 - west[through]), 0, width[through] - 1).astype(np.int64)
    rays = np.zeros(len(touched), np.int64)
    np.add.at(rays, base[through], 1)
    np.add.at(rays, base[through] + before, -1)
    whole = (np.cumsum(rays) % 2 == 1) & ~border
    kept = np.flatnonzero(border | whole)
    band = np.searchsorted(base, kept, side="right") - 1
    turn, column = np.divmod(kept - base[band] + west[band], columns)
    # near a pole a row of cells may be met on several turns: outside all but one of them, so that their crossings add up
    key = (bands[band] // rows) * (rows * columns) + band_row[band] * columns + column
    order = np.argsort(key, kind="stable")
    key, band, turn, whole = key[order], band[order], turn[order], whole[kept][order]
    found, start_of, cell = np.unique(key, return_index=True, return_inverse=True)
    inside = np.logical_or.reduceat(whole, start_of)
    sizes = np.where(inside[cell], 0, many[band])
    edges = e[edge[_ranges(start[band], sizes)]]
    edges[:, [0, 2]] -= 360.0 * np.repeat(turn, sizes)[:, None]
    return found // (rows * columns), found % (rows * columns), inside, np.add.reduceat(sizes, start_of), edges


class ScopeIndex:
    """The cover of a catalog, for any number of ``locate`` calls. ``degrees`` has to divide 180."""

    def __init__(self, catalog: DataFrame, degrees: float = 1.0, slack_m: float = EDGE_M):
        if abs(180 / degrees - round(180 / degrees)) > 1e-9:
            raise ValueError("cells have to divide 180 degrees")
        self.degrees = degrees
        self.lineages = lineages(catalog).where("fault is null")
        known = catalog.where("rings is not null").join(self.lineages, "key")
        classes = known.groupBy(F.slice("path", 1, F.size("path") - 1).alias("above"), "rings").agg(F.sort_array(F.collect_list("key")).alias("keys"))
        self.cells = self._cover(classes, slack_m).persist()
        held = F.aggregate("classes", F.size("names"), lambda n, s: n + 1 + F.size(s["edges"]))
        self.size = self.cells.agg(F.sum(held)).first()[0] or 0

    def _cover(self, classes: DataFrame, slack_m: float) -> DataFrame:
        degrees = self.degrees
        names = ["cell", "above", "keys", "whole", "edges"]

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                above, keys = batch.column("above"), batch.column("keys")

                def part(at: list[int], polygons: list[np.ndarray], above=above, keys=keys) -> Iterator[pa.RecordBatch]:
                    of, cell, whole, sizes, edges = _cells(polygons, degrees, slack_m)
                    of, ends = np.array(at)[of], np.concatenate(([0], np.cumsum(sizes)))
                    # a batch is bounded by what it holds, and has one cell at least
                    held = np.cumsum(1 + pc.list_value_length(keys).to_numpy()[of] + sizes)
                    first = 0
                    while first < len(of):
                        last = max(first + 1, int(np.searchsorted(held, (held[first - 1] if first else 0) + 50_000, side="right")))
                        x = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in edges[ends[first] : ends[last]].T], names=["x1", "y1", "x2", "y2"])
                        which = pa.array(of[first:last])
                        listed = pa.ListArray.from_arrays(pa.array(ends[first : last + 1] - ends[first], pa.int32()), x)
                        yield pa.RecordBatch.from_arrays([pa.array(cell[first:last]), above.take(which), keys.take(which), pa.array(whole[first:last]), listed], names=names)
                        first = last

                at, polygons, area = [], [], 0
                for i, rings in enumerate(batch.column("rings").to_pylist()):
                    edges = _edges(rings)
                    if not len(edges):
                        continue
                    at.append(i)
                    polygons.append(edges)
                    # the cells of its box, and its edges in each row
                    spans = np.ptp(edges[:, [0, 2]]) / degrees + 2, np.ptp(edges[:, [1, 3]]) / degrees + 2
                    area += spans[0] * spans[1] + np.abs(edges[:, 3] - edges[:, 1]).sum() / degrees + 3 * len(edges)
                    if area > 500_000:
                        yield from part(at, polygons)
                        at, polygons, area = [], [], 0
                if polygons:
                    yield from part(at, polygons)

        # cutting is the work here, and a catalog's file may be one partition
        spark = classes.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        each = classes.repartition(parts, F.xxhash64(F.col("keys")[0])).mapInArrow(cut, _CELL)
        cells = each.groupBy("cell").agg(F.collect_list(F.struct("above", "keys", "whole", "edges")).alias("held"))
        # keys are put in order once a cell, so that those of a point are in order too
        names = F.flatten(F.transform("held", lambda c, i: F.transform(c["keys"], lambda k: F.struct(k.alias("key"), i.alias("class")))))
        classes = F.transform("held", lambda c: F.struct(c["above"].alias("above"), c["whole"].alias("whole"), c["edges"].alias("edges")))
        return cells.select("cell", F.sort_array(names).alias("names"), classes.alias("classes"))

    def locate(self, points: DataFrame, exact: bool = False, lat: str = "lat", lon: str = "lon") -> DataFrame:
        """points with ``matches``: an array of (key, path, edge), edge where the point is on the boundary, by key.

        ``exact`` takes a cross product of at most 1e-10 for the boundary, else a tenth of a metre is."""

        def matches(names: Column, classes: Column) -> dict[str, Column]:
            of = lambda n: F.get(classes, n["class"])
            return {"matches": F.transform(names, lambda n: F.struct(n["key"].alias("key"), F.array_append(of(n)["above"], n["key"]).alias("path"), of(n)["edge"].alias("edge")))}

        return self.judge(points, matches, exact, lat, lon)

    def judge(self, points: DataFrame, found: Callable[[Column, Column], dict[str, Column]], exact: bool = False, lat: str = "lat", lon: str = "lon") -> DataFrame:
        """points with the columns that ``found`` makes of the scopes that hold them: their names (key, class) by key, and
        the classes (above, edge) by their number, null where they do not hold the point. above has the keys from the root
        to the parent of the class's scopes."""
        y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
        rows, columns = round(180 / self.degrees), round(360 / self.degrees)
        valid = (y >= -90) & (y <= 90) & (x >= -180) & (x <= 180)
        cell = F.least(F.floor((y + 90) / self.degrees), F.lit(rows - 1)) * columns + F.least(F.floor((x + 180) / self.degrees), F.lit(columns - 1))
        cells = self.cells.select(F.col("cell").alias("__cell"), F.col("names").alias("__names"), F.col("classes").alias("__classes"))
        placed = points.withColumns({"__y": y, "__x": x, "__at": F.when(valid, cell)})
        shared = self.size > MOST_EDGES
        if shared:
            # points without a place are no group, nor do they meet in one task
            lost = placed.withColumn("__s", F.when(F.col("__at").isNull(), -1 - F.monotonically_increasing_id()))
            place = Window.partitionBy("__y", "__x", "__s").orderBy("__y")
            lost = lost.withColumn("__n", F.floor((F.row_number().over(place) - 1) / TOGETHER)).withColumn("__at", F.coalesce("__at", "__s"))
            placed = lost.groupBy("__y", "__x", "__s", "__n", "__at").agg(F.collect_list(F.struct(*points.columns)).alias("__rows"))
        else:
            cells = F.broadcast(cells)
        y, x = F.col("__y"), F.col("__x")
        reach = math.degrees(EDGE_M / EARTH_M) * 1.01 + 1e-9
        placed = placed.withColumn("__k", F.cos(F.radians("__y"))).withColumn("__w", F.least(F.lit(reach) / F.greatest(F.col("__k"), F.lit(1e-12)), F.lit(360.0)))
        met = placed.join(cells, F.col("__at") == F.col("__cell"), "left")

        def crosses(e: Column) -> Column:
            return ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"]))

        def near(e: Column) -> Column:
            m = math.radians(1) * EARTH_M
            ax, ay, bx, by = (e["x1"] - x) * F.col("__k") * m, (e["y1"] - y) * m, (e["x2"] - x) * F.col("__k") * m, (e["y2"] - y) * m
            dx, dy = bx - ax, by - ay
            t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))))
            return F.hypot(ax + t * dx, ay + t * dy) <= EDGE_M

        def on_line(e: Column) -> Column:
            cross = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
            between = lambda v, a, b: (v >= F.least(a, b) - EDGE_EXACT) & (v <= F.greatest(a, b) + EDGE_EXACT)
            return (F.abs(cross) <= EDGE_EXACT) & between(x, e["x1"], e["x2"]) & between(y, e["y1"], e["y2"])

        # the exact rule only for edges whose box, a little widened, holds the point
        beside = lambda e: (x >= F.least(e["x1"], e["x2"]) - F.col("__w")) & (x <= F.greatest(e["x1"], e["x2"]) + F.col("__w")) & (y >= F.least(e["y1"], e["y2"]) - reach) & (y <= F.greatest(e["y1"], e["y2"]) + reach)
        on_edge = lambda c: F.exists(c["edges"], lambda e: beside(e) & (on_line if exact else near)(e))
        inside = lambda c: F.size(F.filter(c["edges"], crosses)) % 2 == 1
        hits = F.transform("__classes", lambda c: F.when(c["whole"], 1).when(on_edge(c), 2).when(inside(c), 1).otherwise(0))
        kept = ["__rows"] if shared else points.columns
        # generated columns are worked out once, however often they are named
        made = met.select(*kept, "__names", "__classes", F.explode_outer(F.array(hits)).alias("__hits"))
        hit = lambda i: F.get(F.col("__hits"), i)
        none = F.array().cast("array<struct<key: string, class: int>>"), F.array().cast("array<struct<above: array<string>, edge: boolean>>")
        names = F.coalesce(F.filter("__names", lambda n: hit(n["class"]) > 0), none[0])
        classes = F.coalesce(F.transform("__classes", lambda c, i: F.when(hit(i) > 0, F.struct(c["above"].alias("above"), (hit(i) == 2).alias("edge")))), none[1])
        made = made.select(*kept, F.explode(F.array(F.struct(names.alias("names"), classes.alias("classes")))).alias("__held"))
        made = made.select(*kept, *[c.alias(name) for name, c in found(F.col("__held.names"), F.col("__held.classes")).items()])
        return made.select(F.inline("__rows"), *[c for c in made.columns if c != "__rows"]) if shared else made


def resolve(matches: Column, root: str = "world") -> dict[str, Column]:
    """scope, conflicts and status of a point from its matches.

    Only matches that are no ancestor of another one count. One: it is the scope, or, where the point is on its
    boundary, its parent, with a conflict. Several: their deepest common ancestor, with a conflict.
    The root is never a scope."""
    below = lambda m: F.slice(m["path"], 1, F.size(m["path"]) - 1)
    # an array of one value names it, so that it is worked out once for all its uses
    once = lambda value, use: F.transform(F.array(value), use)[0]
    above = F.array_intersect(F.transform(matches, lambda m: m["key"]), F.flatten(F.transform(matches, below)))
    terminal = once(above, lambda keys: F.filter(matches, lambda m: ~F.array_contains(keys, m["key"])))

    def shared(paths: Column) -> Column:
        # what the first and the last in order begin with, all between them do
        return once(F.array_max(paths), lambda last: once(F.array_min(paths), lambda first: F.filter(first, lambda k, i: F.slice(first, 1, i + 1) == F.slice(last, 1, i + 1))))

    def judge(terminal: Column) -> Column:
        first = F.get(terminal, F.lit(0))
        lone = F.size(terminal) == 1
        conflict = (F.size(terminal) > 1) | F.coalesce(lone & first["edge"], F.lit(False))
        path = F.when(lone & ~first["edge"], first["path"]).when(lone, below(first)).otherwise(shared(F.transform(terminal, lambda m: m["path"])))
        scope = once(F.try_element_at(path, F.lit(-1)), lambda s: F.when(s != root, s))
        conflicts = F.when(conflict, F.sort_array(F.transform(terminal, lambda m: m["key"]))).otherwise(F.array().cast("array<string>"))
        return once(scope, lambda s: F.struct(s.alias("scope"), conflicts.alias("conflicts"), F.when(conflict, "conflict").when(s.isNotNull(), "resolved").otherwise("unresolved").alias("status")))

    found = once(terminal, judge)
    return {c: found[c] for c in ("scope", "conflicts", "status")}


def resolve_classes(names: Column, classes: Column, root: str = "world") -> Column:
    """``resolve`` for what ``ScopeIndex.judge`` gives, as one struct of scope, conflicts and status."""
    once = lambda value, use: F.transform(F.array(value), use)[0]

    def shared(paths: Column) -> Column:
        return once(F.array_max(paths), lambda last: once(F.array_min(paths), lambda first: F.filter(first, lambda k, i: F.slice(first, 1, i + 1) == F.slice(last, 1, i + 1))))

    def judge(terminal: Column) -> Column:
        lowest = F.transform(F.array_distinct(F.transform(terminal, lambda n: n["class"])), lambda i: F.get(classes, i))
        return once(lowest, lambda of: once(F.transform(terminal, lambda n: n["key"]), lambda keys: decide(keys, of)))

    def decide(keys: Column, of: Column) -> Column:
        first = F.get(of, F.lit(0))
        lone = F.size(keys) == 1
        conflict = (F.size(keys) > 1) | F.coalesce(lone & first["edge"], F.lit(False))
        path = F.when(lone & ~first["edge"], keys).when(lone, first["above"]).otherwise(shared(F.transform(of, lambda c: c["above"])))
        scope = once(F.try_element_at(path, F.lit(-1)), lambda s: F.when(s != root, s))
        conflicts = F.when(conflict, keys).otherwise(F.array().cast("array<string>"))
        return once(scope, lambda s: F.struct(s.alias("scope"), conflicts.alias("conflicts"), F.when(conflict, "conflict").when(s.isNotNull(), "resolved").otherwise("unresolved").alias("status")))

    above = F.array_distinct(F.flatten(F.transform(F.filter(classes, lambda c: c.isNotNull()), lambda c: c["above"])))
    terminal = once(above, lambda keys: F.filter(names, lambda n: ~F.array_contains(keys, n["key"])))
    return once(terminal, judge)
