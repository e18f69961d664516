"""Scopes with the same rings are cut and tested once, points of one place are judged once; what they get is unchanged."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import scopes

POINTS = "i int, note string, lat double, lon double"


def box(w, s, e, n):
    return [[{"x": float(x), "y": float(y)} for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))]]


@pytest.fixture
def catalog(spark):
    rnd = random.Random(4)
    rows = [("world", None, "world", None), ("a", "world", "country", box(-10, -10, 10, 10)), ("b", "world", "country", box(10, -10, 30, 10)), ("a2", "world", "country", box(-10, -10, 10, 10))]
    for i in range(60):
        w, s = rnd.randint(-12, 20), rnd.randint(-12, 8)
        rows.append((f"k{i}", ("a", "b")[i % 2], "admin1", box(w, s, w + rnd.randint(1, 6), s + rnd.randint(1, 6))))
        rows += [(f"same{i}-{j}", rows[-1][1], "admin1", rows[-1][3]) for j in range(i % 4)]
    rows += [(f"below{i}", f"k{i}", "admin2", rows[4][3]) for i in range(0, 60, 5)]
    return spark.createDataFrame(rows, scopes.CATALOG)


@pytest.fixture
def points(spark):
    rnd = random.Random(5)
    places = [(rnd.randint(-26, 24) / 2, rnd.randint(-26, 64) / 2) for _ in range(120)] + [(0.0, -0.0), (-0.0, 0.0), (None, 1.0), (1.0, None), (float("nan"), 0.0), (90.5, 0.0), (90.0, 180.0)]
    rows = [(*places[i % len(places)],) for i in range(400)] + [(3.25, 3.25)] * 250 + [(None, None)] * 250
    return spark.createDataFrame([(i, f"n{i}" if i % 3 else None, *p) for i, p in enumerate(rows)], POINTS)


def test_scopes_with_the_same_rings_are_held_once_in_a_cell(spark):
    rows = [("world", None, "world", None), *((f"k{i}", "world", "country", box(0.5, 0.5, 3.5, 3.5)) for i in range(50))]
    index = scopes.ScopeIndex(spark.createDataFrame(rows, scopes.CATALOG))
    assert index.cells.agg(F.max(F.size("classes")), F.max(F.size("names"))).first() == (1, 50)
    got = index.locate(spark.createDataFrame([(1.0, 1.0), (2.5, 0.5)], "lat double, lon double")).collect()
    assert [[(m["key"], m["path"], m["edge"]) for m in r["matches"]] for r in got] == [[(k, ["world", k], edge) for k in sorted(f"k{i}" for i in range(50))] for edge in (False, True)]


def test_a_cover_joined_by_a_shuffle_gives_what_a_broadcast_one_gives(spark, catalog, points, monkeypatch):
    index = scopes.ScopeIndex(catalog)
    rows = lambda: sorted((repr(tuple(r)) for r in index.locate(points).collect()))
    small = rows()
    monkeypatch.setattr(scopes, "MOST_EDGES", -1)
    assert rows() == small and len(small) == 900
    plan = index.locate(points)._jdf.queryExecution().optimizedPlan().toString()
    # rows of a place part again only after they are judged
    assert plan.index("inline(__rows") < plan.index("Join LeftOuter") < plan.index("collect_list(struct(i")


@pytest.mark.parametrize("most", [-1, 500_000])
def test_classes_are_resolved_as_their_scopes_are(spark, catalog, points, monkeypatch, most):
    monkeypatch.setattr(scopes, "MOST_EDGES", most)
    index = scopes.ScopeIndex(catalog)
    by_scope = scopes.resolve(F.col("matches"))
    want = index.locate(points).select("i", *[by_scope[c].alias(c) for c in ("scope", "conflicts", "status")]).collect()
    got = index.judge(points, lambda names, classes: {"found": scopes.resolve_classes(names, classes)}).select("i", "found.*").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {r["status"] for r in got} == {"resolved", "conflict", "unresolved"}


def test_polygons_are_cut_at_once_as_one_by_one():
    rnd = random.Random(6)
    rings = [[(-180, 80), (-60, 80), (60, 80), (180, 80), (180, 90), (60, 90), (-60, 90), (-180, 90), (-180, 80)], [(170, -10), (-170, -10), (-170, 10), (170, 10), (170, -10)]]
    for _ in range(200):
        x, y, r = rnd.uniform(-180, 180), rnd.uniform(-70, 70), rnd.uniform(0.1, 9)
        rings.append([(x + r, y), (x, y + r), (x - r, y), (x, y - r), (x + r, y)])
    edges = [scopes._edges([[{"x": float(x), "y": float(y)} for x, y in ring]]) for ring in rings]

    def listed(found):
        of, cell, whole, sizes, ends = found
        parts = [e.tolist() for e in np.split(ends, np.cumsum(sizes)[:-1])]
        return list(zip(of.tolist(), cell.tolist(), whole.tolist(), parts, strict=True))

    got = listed(scopes._cells(edges, 1.0, 0.1))
    assert got == [(i, *row[1:]) for i, e in enumerate(edges) for row in listed(scopes._cells([e], 1.0, 0.1))]
    assert {w for _, _, w, _ in got} == {True, False} and all(not p for _, _, w, p in got if w)
