"""Cluster lifecycle, scopes of coordinates, extraction by an injected function, and commits over several tables."""

import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import classify, geo
from tidemark.operators import batches, extraction, graph_writes, measures, scopes, upsert
from tidemark.sources import sinks
from tidemark.sources.commits import CommittedTables, folded
from tidemark.sources.feeds import GRAPH_KEYS, GRAPH_RULES
from tidemark.streaming import lifecycle as life
from tidemark.streaming import control, topics

RULES = life.Rules("firms", least=3, window=100, quiet=50, cooldown=200)


def fold(rows, rules=RULES, held=None, upto=None):
    c = life.Cluster("k", rules)
    if held:
        c.restore(*held)
    out = []
    for r in rows:
        out += c.apply(*r)
    return out + (c.advance(upto) if upto is not None else []), c


def kinds(events):
    return [(e[1], e[2], e[3]) for e in events]


def signals(*times):
    return [(t, "signal", f"s{t}") for t in times]


# --- the rule of one key


def test_ignites_at_the_third_hit_and_one_exactly_a_window_old_counts():
    assert kinds(fold(signals(0, 60, 100))[0]) == [(100, "open", 3)]
    assert fold(signals(0, 60, 101))[0] == []
    assert kinds(fold(signals(0, 60, 101, 120))[0]) == [(120, "open", 3)]


def test_updates_then_closes_by_itself_and_begins_anew_without_a_pause():
    events, c = fold(signals(0, 1, 2, 40, 89, 139), upto=400)
    assert kinds(events) == [(2, "open", 3), (40, "update", 4), (89, "update", 5), (139, "close", 5)]
    assert c.recent == [] and c.due() is None  # the signal of second 139 is forgotten by 400
    again, _ = fold(signals(0, 1, 2, 60, 61, 62))
    assert kinds(again) == [(2, "open", 3), (52, "close", 3), (62, "open", 3)]


def test_silence_ignores_hits_unrecorded_until_its_end():
    rows = [*signals(0, 1, 2), (3, "silence", "x", 30), *signals(4, 29), (30, "promote", "y"), *signals(30, 31, 32)]
    events, _ = fold(rows)
    assert kinds(events) == [(2, "open", 3), (3, "silence", 3), (32, "open", 3)]
    default, c = fold([*signals(0, 1, 2), (3, "silence", "x")])
    assert c.muted == 203 and c.due() == 203


def test_promoted_absorbs_stays_alive_by_hits_and_is_dropped():
    rows = [*signals(0, 1, 2), (2, "promote", "x"), *signals(40, 80), (81, "silence", "x"), (82, "promote", "x")]
    events, _ = fold(rows, upto=200)
    assert kinds(events) == [(2, "open", 3), (2, "promote", 3), (40, "absorb", 3), (80, "absorb", 3), (130, "drop", 3)]


def test_severity_rises_with_the_hits_and_never_falls():
    events, c = fold(signals(*range(12)))
    assert [e[4] for e in events] == ["high"] * 7 + ["critical"] * 3 and c.ids == [f"s{i}" for i in range(12)]
    telegram = life.Rules("telegram", least=3, window=100, quiet=50, severity="elevated")
    assert [e[4] for e in fold(signals(*range(10)), telegram)[0]] == ["elevated"] * 2 + ["high"] * 5 + ["critical"]
    assert life.Rules("unheard-of").step(99) == "low"
    _, many = fold(signals(*range(80)))
    assert many.ids == [f"s{i}" for i in range(30, 80)]


def test_a_restored_incident_hears_of_the_next_ignition_as_one_hit():
    held = ("inc", "open", 4, 0, 0, "elevated")
    events, _ = fold(signals(10, 20, 30), held=held)
    assert events == [("inc", 30, "update", 7, "high", ["s10", "s20", "s30"])]
    assert kinds(fold(signals(50), held=held)[0]) == [(50, "close", 4)]
    assert kinds(fold(signals(1, 2, 3), held=("inc", "promoted", 4, 0, 0, "high"))[0]) == [(3, "absorb", 4)]


# --- stored incidents, table and stream


def test_rehydrated_incidents(spark):
    s = "id string, status string, severity string, trigger_s long, layer_hints array<string>, offsets array<double>"
    own = ["auto_promoter:v1", "cluster:k:1"]
    rows = [("a", "open", "high", 10, own, [0.0, 5.5, 3.0]), ("b", "promoted", "low", 20, own, []), ("c", "closed", "low", 99, own, [1.0]), ("d", "open", "low", 99, own[:1], [1.0]), ("e", "open", "low", 99, own[1:], [1.0]), ("f", "open", "low", 7, ["auto_promoter:v1", "cluster:z", "cluster:y"], None)]
    got = {r["key"]: tuple(r)[1:] for r in life.rehydrated(spark.createDataFrame(rows, s)).collect()}
    assert got["k:1"] == ("b", "promoted", 0, 20, 20, "low") and set(got) == {"k:1", "z"} and got["z"][4] == 7


SIGNALS = "key string, s long, kind string, id string, until long"


def signal_rows(seed, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        t = rnd.randrange(0, 4000)
        kind = rnd.choice(["signal"] * 30 + ["promote", "silence"])
        out.append((f"k{rnd.randrange(4)}", t, kind, f"{i:04d}", t + rnd.randrange(10, 300) if rnd.random() < 0.5 else None))
    return out


def as_rows(df):
    return df.selectExpr("key", "timestamp_seconds(s) as ts", "kind", "id", "until")


def tuples(rows):
    return sorted((r["key"], r["seconds"], r["kind"], r["incident"], r["hits"], r["severity"], tuple(r["ids"])) for r in rows)


def stored(spark):
    s = "id string, status string, severity string, trigger_s long, layer_hints array<string>, offsets array<double>"
    rows = [("old0", "open", "elevated", 0, ["auto_promoter:v1", "cluster:k0"], [0.0, 30.0]), ("old1", "promoted", "high", 0, ["auto_promoter:v1", "cluster:k1"], [0.0]), ("lone", "open", "high", 5, ["auto_promoter:v1", "cluster:nobody"], [0.0])]
    return spark.createDataFrame(rows, s)


def by_hand(rows, incidents, upto):
    out = []
    held = {"k0": ("old0", "open", 2, 0, 30, "elevated"), "k1": ("old1", "promoted", 1, 0, 0, "high"), "nobody": ("lone", "open", 1, 5, 5, "high")} if incidents else {}
    for key in sorted({r[0] for r in rows} | set(held)):
        c = life.Cluster(key, RULES)
        if key in held:
            c.restore(*held[key])
        for _, t, kind, ident, until in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] != "signal", r[3])):
            out += [(key, *e) for e in c.apply(t, kind, ident, until)]
        out += [(key, *e) for e in c.advance(upto)]
    return sorted((k, t, kind, inc, hits, sev, tuple(ids)) for k, inc, t, kind, hits, sev, ids in out)


@pytest.mark.parametrize("incidents", [False, True])
def test_the_table_form_folds_each_key(spark, incidents):
    rows = signal_rows(1, 900)
    odd = [(None, 5, "signal", "x", None), ("k0", None, "signal", "x", None), ("k0", 5, "other", "x", None), ("k0", 5, None, "x", None)]
    got = life.lifecycle(as_rows(spark.createDataFrame(rows + odd, SIGNALS)), RULES, 10_000, stored(spark) if incidents else None)
    want = by_hand(rows, incidents, 10_000)
    assert tuples(got.collect()) == want and {w[2] for w in want} == {"open", "update", "close", "promote", "absorb", "drop", "silence"}
    assert life.lifecycle(as_rows(spark.createDataFrame([], SIGNALS)), RULES, 10).count() == 0


def run(stream, where, name):
    q = stream.writeStream.format("parquet").option("path", f"{where}/{name}").option("checkpointLocation", f"{where}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def test_the_stream_gives_what_the_table_form_gives_across_a_restart(spark, tmp_path):
    """Batches out of order within the lateness, a row later than it, clusters that close without a further signal of their key."""
    rows = sorted(signal_rows(2, 400), key=lambda r: (r[1] + hash(r[3]) % 50, r[3]))
    parts = [rows[:150], rows[150:300], [*rows[300:], ("k9", 1, "signal", "late", None), ("clock", 20_000, "signal", "z", None)], [("clock", 21_000, "signal", "z", None)]]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for i, part in enumerate(parts):
            as_rows(spark.createDataFrame(part, SIGNALS)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(life.SIGNALS).parquet(f"{tmp_path}/in")
            # each run is a new query over the same checkpoint: a restart; stored incidents only count for the first
            run(life.lifecycle_stream(source, RULES, "60 seconds", stored(spark)), tmp_path, "out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = tuples(spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == by_hand(rows, True, 19_000)


# --- scopes


def polygon(*points):
    return [[{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]]


def box(w, s, e, n):
    return polygon((w, s), (e, s), (e, n), (w, n))


def catalog(spark, *rows):
    return spark.createDataFrame([("world", None, "world", None), *rows], scopes.CATALOG)


def located(spark, index, points, exact=False):
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "i int, lat double, lon double")
    found = scopes.resolve(F.col("matches"))
    rows = index.locate(df, exact).select("i", found["scope"].alias("scope"), found["status"].alias("status"), found["conflicts"].alias("conflicts")).orderBy("i").collect()
    return [(r["scope"], r["status"], r["conflicts"]) for r in rows]


def test_scopes_of_nested_overlapping_and_touching_polygons(spark):
    c = catalog(
        spark, ("a", "world", "country", box(0, 0, 10, 10)), ("b", "world", "country", box(10, 0, 20, 10)), ("a1", "a", "admin1", box(1, 1, 5, 5)),
        ("a2", "a", "admin1", box(4, 1, 8, 5)), ("a11", "a1", "admin2", box(1, 1, 2, 2)), ("none", "a", "admin1", None),
    )
    points = [(7, 3), (3, 3), (3, 4.5), (2.5, 2), (3, 7), (5, 10), (0, 3), (1.5, 1.5), (1.5, 2), (50, 50), (3, 5)]
    assert located(spark, scopes.ScopeIndex(c), points) == [
        ("a", "resolved", []), ("a1", "resolved", []), ("a", "conflict", ["a1", "a2"]), ("a1", "resolved", []), ("a2", "resolved", []),
        (None, "conflict", ["a", "b"]), (None, "conflict", ["a"]), ("a11", "resolved", []), ("a1", "conflict", ["a11"]), (None, "unresolved", []), ("a", "conflict", ["a1", "a2"]),
    ]


def test_points_without_a_place_and_empty_catalogs(spark):
    index = scopes.ScopeIndex(catalog(spark, ("a", "world", "country", box(0, 0, 10, 10))))
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (float("nan"), 1.0), (91.0, 1.0), (1.0, 181.0), (5.0, 5.0), (5.0, 5.0)], "lat double, lon double")
    assert sorted(len(r["matches"]) for r in index.locate(df).collect()) == [0, 0, 0, 0, 0, 1, 1]
    assert [len(r["matches"]) for r in scopes.ScopeIndex(catalog(spark)).locate(df).collect()] == [0] * 7
    with pytest.raises(ValueError, match="cells"):
        scopes.ScopeIndex(catalog(spark), 0.7)


def test_polygons_over_the_date_line_and_at_its_edge(spark):
    c = catalog(spark, ("over", "world", "country", polygon((170, -10), (-170, -10), (-170, 10), (170, 10))), ("east", "world", "country", box(-180, 20, -150, 40)), ("cap", "world", "country", polygon((-180, 80), (-60, 80), (60, 80), (180, 80), (180, 90), (60, 90), (-60, 90), (-180, 90))))
    points = [(0, 175), (0, -175), (0, 180), (0, -180), (0, 165), (0, -165), (30, -160), (30, 180), (30, -180), (30, 179), (85, 0), (90, 0)]
    got = located(spark, scopes.ScopeIndex(c), points)
    assert [g[:2] for g in got] == [("over", "resolved")] * 4 + [(None, "unresolved")] * 2 + [("east", "resolved"), (None, "conflict"), (None, "conflict"), (None, "unresolved"), ("cap", "resolved"), (None, "conflict")]


def test_a_point_in_many_scopes_is_resolved_in_proportion_to_them(spark):
    # scopes c0 to c2999 below n: with a test of each against each other one row alone takes minutes
    path = "array('world', 'n', concat('c', i))"
    m = f"array_append(transform(sequence(0, 2999), i -> named_struct('key', concat('c', i), 'path', {path}, 'edge', false)), named_struct('key', 'n', 'path', array('world', 'n'), 'edge', false))"
    found = scopes.resolve(F.col("matches"))
    df = spark.range(40).selectExpr("id", f"{m} as matches")
    began = time.monotonic()
    rows = df.select(found["scope"].alias("scope"), found["status"].alias("status"), F.size(found["conflicts"]).alias("n")).collect()
    assert {tuple(r) for r in rows} == {("n", "conflict", 3000)} and time.monotonic() - began < 30


def test_a_catalog_in_one_partition_is_cut_by_many_tasks(spark):
    index = scopes.ScopeIndex(catalog(spark, *[(f"k{i}", "world", "country", box(i, 0, i + 3, 3)) for i in range(40)]).coalesce(1))
    assert "REPARTITION_BY_NUM" in index.cells._jdf.queryExecution().executedPlan().toString()


def test_two_tolerances_of_the_edge(spark):
    index = scopes.ScopeIndex(catalog(spark, ("a", "world", "country", box(0, 0, 10, 10))))
    near = 0.05 / (math.radians(1) * scopes.EARTH_M)
    points = [(5, 10 + near), (5, 10 - near), (5, 10 + 4 * near), (5, 10), (5, 10 + 1e-12)]
    assert [g[1] for g in located(spark, index, points)] == ["conflict", "conflict", "unresolved", "conflict", "conflict"]
    assert [g[1] for g in located(spark, index, points, True)] == ["unresolved", "resolved", "unresolved", "conflict", "conflict"]


def by_rays(rings, lat, lon):
    inside = False
    for ring in rings:
        for a, b in zip(ring, ring[1:], strict=False):
            if (a["y"] > lat) != (b["y"] > lat) and lon < a["x"] + (lat - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]):
                inside = not inside
    return inside


@pytest.mark.parametrize("degrees", [0.5, 2.0, 30.0])
def test_many_polygons_against_every_one_of_them(spark, degrees):
    rnd = random.Random(9)
    shapes = []
    for i in range(150):
        cx, cy, n = rnd.uniform(-150, 150), rnd.uniform(-70, 70), rnd.randint(3, 30)
        radii = [rnd.uniform(0.2, 12) for _ in range(n)]
        ring = [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k, r in enumerate(radii)]
        rings = polygon(*ring)
        if i % 3 == 0:
            rings += polygon(*[(cx + (x - cx) / 3, cy + (y - cy) / 3) for x, y in ring])
        shapes.append((f"p{i}", "world", "country", rings))
    points = [(rnd.uniform(-85, 85), rnd.uniform(-165, 165)) for _ in range(3000)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lat double, lon double")
    rows = scopes.ScopeIndex(catalog(spark, *shapes), degrees).locate(df).collect()
    want = {i: sorted(k for k, _, _, rings in shapes if by_rays(rings, *p)) for i, p in enumerate(points)}
    assert {r["i"]: [m["key"] for m in r["matches"]] for r in rows} == want and any(len(w) > 1 for w in want.values())


def test_broken_catalogs_are_named_by_row(spark):
    rows = [("world", None), ("a", "world"), ("b", "a"), ("lost", "nowhere"), ("x", "y"), ("y", "x"), ("self", "self"), ("twice", "a"), ("twice", "b"), ("below", "lost")]
    df = spark.createDataFrame([(k, p, "k", None) for k, p in rows], scopes.CATALOG)
    got = {r["key"]: (r["path"], r["fault"]) for r in scopes.lineages(df).collect()}
    assert got["b"] == (["world", "a", "b"], None) and got["world"] == (["world"], None)
    assert {k: v[1] for k, v in got.items() if v[1]} == {"lost": "orphan", "below": "orphan", "x": "cycle", "y": "cycle", "self": "cycle", "twice": "duplicate"}


def test_no_polygon_is_met_by_a_loop_or_a_second_shuffle(spark):
    index = scopes.ScopeIndex(catalog(spark, ("a", "world", "country", box(0, 0, 10, 10))))
    plan = index.locate(spark.range(5).selectExpr("cast(id as double) as lat", "cast(id as double) as lon"))._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan and "SortMergeJoin" not in plan


# --- extraction


def service():
    """A function that workers get by value."""

    def answers(text, url):
        if text == "late":
            raise TimeoutError
        if text == "gone":
            raise ConnectionResetError
        if text.startswith("http"):
            raise extraction.HttpStatus(int(text[4:]))
        if text == "cut":
            raise extraction.Truncated
        if text == "odd":
            raise RuntimeError("what")
        if text == "list":
            return "[1]"
        if text == "nameless":
            return {"entities": [{"type": "person"}]}
        if text == "severe":
            return {"events": [{"severity": "huge"}]}
        if text == "broken":
            return '{"events": ['
        return json.dumps({"events": [{"title": f"e{i}", "codebook_type": "a.b" if i % 2 else "x.y", "severity": "low"} for i in range(7)], "entities": [{"name": f"n{i}", "type": "person", "confidence": 0.5} for i in range(25)], "locations": [{"name": "x", "country": "DE"}], "seen": len(text)})

    return answers


def test_outcomes_by_row_and_their_classes(spark):
    texts = ["fine", None, "late", "gone", "http400", "http404", "http422", "http429", "http503", "cut", "odd", "list", "nameless", "severe", "broken"]
    df = spark.createDataFrame([(i, t, f"u{i}", "own") for i, t in enumerate(texts)], "i int, text string, url string, outcome string")
    got = {r["i"]: r["outcome"] for r in extraction.extract(df, service(), ["a.b"], rows_a_batch=2).collect()}
    assert [(got[i]["status"], got[i]["error"]) for i in range(len(texts))] == [
        ("ok", None), ("ok", None), ("transient", "timeout"), ("transient", "connect"), ("config", "http 400"), ("config", "http 404"), ("config", "http 422"), ("transient", "http 429"), ("transient", "http 503"),
        ("transient", "truncated"), ("transient", "unexpected: RuntimeError"), ("transient", "parse"), ("transient", "parse"), ("transient", "parse"), ("transient", "parse"),
    ]
    ok = got[0]
    assert [e["codebook_type"] for e in ok["events"]] == ["other.unclassified", "a.b"] * 2 + ["other.unclassified"] and len(ok["entities"]) == 20
    assert ok["events"][0]["confidence"] == 0.5 and ok["events"][0]["timestamp"] is None and got[2]["events"] is None
    assert extraction.extract(df.where("false"), service(), []).count() == 0


def test_only_the_beginning_of_a_text_is_sent(spark):
    df = spark.createDataFrame([("x" * 9000, "u")], "text string, url string")
    assert extraction.extract(df, lambda t, u: {"events": [{"title": str(len(t))}]}, []).first()["outcome"]["events"][0]["title"] == "4000"


def test_retries_by_class(spark):
    rows = [(("ok", None), 0), (("transient", "timeout"), 0), (("transient", "timeout"), 3), (("transient", "timeout"), 4), (("config", "http 404"), 2)]
    df = spark.createDataFrame(rows, "outcome struct<status: string, error: string>, tried int")
    plan = extraction.retry_plan(F.col("outcome"), F.col("tried"), F.lit(100))
    table = df.select(*[c.alias(n) for n, c in plan.items()])
    assert sorted(map(tuple, table.collect()), key=str) == sorted([(0, "done", None), (1, "retry", 220), (4, "retry", 1060), (5, "failed", None), (2, "held", None)], key=str)
    assert sorted(r["attempts"] for r in extraction.due(table, 220).collect()) == [1]
    assert sorted(r["attempts"] for r in extraction.due(table, 2000, True).collect()) == [1, 2, 4]


# --- commits


def test_a_crash_between_tables_shows_the_old_state_and_a_replay_changes_nothing(spark, tmp_path):
    store = CommittedTables(spark, f"file://{tmp_path}/g")
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    assert store.read("t") is None and store.commit("first", {"t": one, "u": one})
    bad = spark.createDataFrame([("b", 0)], "k string, v int").select("k", F.when(F.col("v") == 0, F.raise_error(F.lit("crash")).cast("int")).alias("v"))
    with pytest.raises(Exception, match="crash"):
        store.commit("second", {"t": spark.createDataFrame([("a", 2)], "k string, v int"), "u": bad})
    assert [tuple(r) for r in store.current("t", ["k"], {"v": "always"}).collect()] == [("a", 1)]
    assert store.commit("second", {"t": spark.createDataFrame([("a", 2)], "k string, v int")})
    assert not store.commit("second", {"t": one}) and not store.commit("first", {"t": one})
    again = CommittedTables(spark, f"file://{tmp_path}/g")
    assert [tuple(r) for r in again.current("t", ["k"], {"v": "always"}).collect()] == [("a", 2)]
    assert again.compact("tidy", {"t": (["k"], {"v": "always"})}) and [m["number"] for m in again.manifests()] == [2]
    assert [tuple(r) for r in again.current("t", ["k"], {"v": "always"}).collect()] == [("a", 2)] and again.committed("first") and again.read("u") is None


def test_of_two_writers_one_takes_the_next_number(spark, tmp_path, monkeypatch):
    a, b = (CommittedTables(spark, f"file://{tmp_path}/g") for _ in range(2))
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    first, raced = a._publish, []

    def publish(manifest):
        if not raced:  # the other writer is a moment earlier
            raced.append(b.commit("other", {"t": rows}))
        return first(manifest)

    monkeypatch.setattr(a, "_publish", publish)
    assert a.commit("mine", {"t": rows}) and [(m["number"], m["batches"]) for m in b.manifests()] == [(0, ["other"]), (1, ["mine"])]


def test_folding_commits_is_upserting_one_after_another(spark):
    rules = {"c": "create", "m": "match", "w": "always", "o": "coalesce", "hi": "max", "lo": "min", "l": "append_distinct"}
    schema = "k string, c int, m int, w int, o int, hi int, lo int, l array<int>"
    rnd = random.Random(3)
    value = lambda: rnd.choice([None, 1, 2, 3])
    batches = [[(k, value(), value(), value(), value(), value(), value(), rnd.choice([None, [1], [2, 1], [3]])) for k in "abcdef" if rnd.random() < 0.7] for _ in range(4)]
    state = spark.createDataFrame(batches[0], schema)
    state = upsert.upsert(spark.createDataFrame([], schema), state, ["k"], rules)
    for b in batches[1:]:
        state = upsert.upsert(state, spark.createDataFrame(b, schema), ["k"], rules)
    log = spark.createDataFrame([(*r, i) for i, b in enumerate(batches) for r in b], schema + ", __commit long")
    assert sorted(map(str, folded(log, ["k"], rules).collect())) == sorted(map(str, state.collect()))
    with pytest.raises(ValueError, match="unknown"):
        folded(log, ["k"], {"c": "other"})


def test_graph_tables_of_feeds(spark, tmp_path):
    docs = spark.createDataFrame([(1, "fine", "http://a/1", "T", "s"), (2, "late", "http://a/2", "T", "s")], "i int, text string, url string, title string, source string")
    tables = graph_writes.extraction_tables(extraction.extract(docs, service(), ["a.b"]), "2024-01-01T00:00:00", {"n1": "N One"})
    assert [r["url"] for r in tables["document"].collect()] == ["http://a/1"] and tables["event"].count() == 5
    assert {(r["name"], tuple(r["aliases"])) for r in tables["entity"].where("name < 'n'").collect()} == {("N One", ("n1",))}
    assert tables["location"].first()["loc_key"] == "spatial:country:de" and tables["edge"].groupBy("rel").count().count() == 3
    assert all(set(t.columns) <= {*GRAPH_KEYS[n], *GRAPH_RULES[n]} for n, t in tables.items())
    rows = [("x", "c1", 1.0, 2.0, 10), ("x", "c2", 1.5, 2.5, 20), ("x", "c3", 0.0, 0.0, 30), ("y", "d", None, 5.0, 10), (None, "e", 1.0, 1.0, 1)]
    seen = spark.createDataFrame(rows, "icao24 string, callsign string, lat double, lon double, seconds long").selectExpr("*", "'r' as registration", "'t' as type_code", "'b' as branch", "1.0D as altitude_m", "1.0D as speed_ms", "1.0D as heading")
    tables = graph_writes.aircraft_tables(seen)
    assert sorted((r["icao24"], r["callsign"]) for r in tables["aircraft"].collect()) == [("x", "c3"), ("y", "d")]
    assert [(r["dedup_key"], r["lat"], r["seconds"]) for r in tables["spotted_at"].collect()] == [("x|0", 1.5, 20)] and tables["location"].first()["loc_key"] == "aircraft-observation:x|0"
    told = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, None), (3, 1.0, 2.0)], "id long, lat double, lon double").selectExpr("*", "'k' as kind", "'t' as title", "'high' as severity", "'open' as status", "1 as trigger_s", "'Place' as location")
    tables = graph_writes.incident_tables(told)
    assert tables["incident"].count() == 3 and [r["loc_key"] for r in tables["location"].collect()] == ["incident:place@1.000,2.000"] and tables["edge"].count() == 1


# --- small rules


def test_two_decimals_as_the_binary_value_says(spark):
    rnd = random.Random(8)
    values = [0.125, 0.135, 0.145, 2.675, 1.005, 43.755, 0.375, 0.625, -0.125, -2.675, 0.0, 1e6 + 0.125, *[rnd.randrange(0, 100_000) / 1000 for _ in range(3000)], *[rnd.uniform(-100, 100) for _ in range(1000)]]
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(geo.two_decimals("v")).collect()]
    assert got == [round(v, 2) for v in values]


def test_all_canonical_types_pass_and_unknown_ones_can_be_set_aside(spark):
    canonical = "ORGANIZATION COUNTRY LOCATION PERSON REGION WEAPON_SYSTEM MILITARY_UNIT POLICY TREATY CONCEPT VESSEL AIRCRAFT SATELLITE".split()
    df = spark.createDataFrame([(x,) for x in [*canonical, "person", "vessel"]], "k string")
    assert [r[0] for r in df.select(classify.entity_type("k")).collect()] == [*canonical, "PERSON", "VESSEL"]
    odd = spark.createDataFrame([("person",), ("creature",), (None,)], "k string")
    assert [r[0] for r in odd.select(classify.known_entity_type("k")).collect()] == ["PERSON", None, None]
    with pytest.raises(Exception, match="unknown entity type"):
        odd.select(classify.entity_type("k")).collect()


# --- topics

MESSAGES = "shard string, s long, kind string, id string, title string, channel string, until long"


def told(df):
    return df.selectExpr("shard", "timestamp_seconds(s) as ts", "kind", "id", "title", "channel", "until")


def shard_of(rows, upto=None, **limits):
    shard = topics.Shard(topics.RULES, **limits)
    out = []
    for t, kind, ident, title, channel, *until in rows:
        out += shard.apply(t, kind, ident, title, channel, *until)
    return out + (shard.advance(upto) if upto is not None else []), shard


FIRE = "fire at the old port tonight after a loud blast"


def test_topics_join_by_words_in_a_channel_and_by_shingles_across():
    reordered = "after a loud blast tonight fire at the old port"
    rows = [(0, "signal", "1", FIRE, "c1"), (1, "signal", "2", reordered, "c1"), (2, "signal", "3", reordered.replace("tonight", "today"), "c2"), (3, "signal", "4", FIRE, "c3"), (4, "signal", "5", "", "c1"), (5, "signal", "6", "port fire", "c1")]
    out, _ = shard_of(rows)
    found = {e[0]: e[1] for e in out}
    assert found["1"] == found["2"] == found["4"] and len({found["1"], found["3"], found["6"]}) == 3 and "5" not in found
    assert found["1"] == topics.topic_key(topics.shingles(FIRE.split()))
    assert [(e[0], e[3]) for e in out] == [("1", None), ("2", None), ("3", None), ("4", None), ("6", None)]  # the grown topic is too wide for 4, which founds it anew


def test_topics_ignite_close_and_can_be_silenced():
    rows = [(t, "signal", str(t), FIRE, f"c{t}") for t in (0, 1, 1801, 1802, 2000)]
    out, shard = shard_of(rows, 5000)
    key = out[0][1]
    # the hit of second 0 is a window and one second old at 1801, that of second 1 exactly a window
    assert [(e[2], e[3], e[4]) for e in out] == [(0, None, 0), (1, None, 0), (1801, None, 0), (1802, None, 0), (2000, "open", 3), (2900, "close", 3)] and shard.topics == {}
    rows = [(0, "signal", "0", FIRE, "a"), (1, "signal", "1", FIRE, "b"), (2, "signal", "2", FIRE, "c"), (3, "silence", "op", key, "", 50), (4, "signal", "4", FIRE, "d"), (49, "signal", "5", FIRE, "d"), (50, "signal", "6", FIRE, "d"), (51, "signal", "7", FIRE, "d"), (52, "signal", "8", FIRE, "d"), (53, "promote", "op", key, ""), (54, "signal", "9", FIRE, "e"), (54, "promote", "op", "nobody", "")]
    assert [(e[2], e[3]) for e in shard_of(rows)[0]] == [(0, None), (1, None), (2, "open"), (3, "silence"), (4, None), (49, None), (50, None), (51, None), (52, "open"), (53, "promote"), (54, "absorb")]


def test_the_state_of_a_shard_is_bounded():
    rnd = random.Random(1)
    rows = [(t, "signal", str(t), " ".join(str(rnd.randrange(10**6)) for _ in range(20)), "") for t in range(40)]
    _, shard = shard_of(rows, most=5)
    assert [t.seen for t in shard.topics.values()] == list(range(35, 40))
    grown = [(t, "signal", str(t), FIRE + "".join(f" w{t}{i}" for i in range(2)), "c") for t in range(40)]
    _, shard = shard_of(grown, most_shingles=30)
    assert max(len(t.words) for t in shard.topics.values()) <= 30 and max(len(t.grams) for t in shard.topics.values()) <= 30


def messages(seed, n=250):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(60)}" for _ in range(12)] for _ in range(8)]
    out = []
    for i in range(n):
        words = list(rnd.choice(base))
        if rnd.random() < 0.5:
            words[rnd.randrange(12)] = "other"
        out.append((f"s{rnd.randrange(3)}", rnd.randrange(0, 20_000), "signal", f"{i:04d}", " ".join(words), f"c{rnd.randrange(3)}", None))
    for i in range(6):
        out.append((f"s{i % 3}", rnd.randrange(5_000, 20_000), rnd.choice(["promote", "silence"]), f"r{i}", topics.topic_key(topics.shingles(base[i])), None, None))
    return out


def topics_by_hand(rows, upto, **limits):
    out = []
    for name in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], r[2] != "signal", r[3]))
        out += [(name, *e) for e in shard_of([(t, k, i, title, c or "", u) for _, t, k, i, title, c, u in own], upto, **limits)[0]]
    return sorted(out, key=str)


def test_topics_of_a_table_and_of_a_stream(spark, tmp_path):
    rows = messages(2)
    want = topics_by_hand(rows, 30_000, most=5)
    df = spark.createDataFrame([*rows, (None, 1, "signal", "x", "y", "z", None), ("s0", None, "signal", "x", "y", "z", None)], MESSAGES)
    got = sorted(map(tuple, topics.topic_table(told(df), upto=30_000, most=5).collect()), key=str)
    assert got == want and {w[4] for w in want} >= {None, "open", "update", "close"}
    order = sorted(rows, key=lambda r: (r[1] + hash(r[3]) % 50, r[3]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in (order[:120], [*order[120:], ("s9", 40_000, "signal", "z", "end", "", None)], [("s9", 41_000, "signal", "z", "end", "", None)]):
            told(spark.createDataFrame(part, MESSAGES)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(topics.MESSAGES).parquet(f"{tmp_path}/in")
            run(topics.topic_stream(source, lateness="60 seconds", most=5), tmp_path, "out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    streamed = sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("shard <> 's9'").collect()), key=str)
    assert streamed == want


# --- pages of a change, snapshots, plans


def change_plan(spark, n=60, shift=0):
    return spark.range(n).selectExpr("id as record_id", "concat('s', id % 3) as source", "'iso' as code_system", "case when id % 5 = 0 then 'conflict' else 'resolvable' end as status", f"case when id % 5 > 0 then named_struct('scope', concat('n', id + {shift})) end as change")


def test_a_change_resumes_between_pages_and_a_drifted_plan_is_refused(spark, tmp_path):
    store = CommittedTables(spark, f"file://{tmp_path}/s")
    job = batches.PagedChange(store, "j", "scopes")
    with pytest.raises(ValueError, match="no approved plan"):
        job.apply()
    approved = batches.approval(change_plan(spark))
    assert approved == batches.approval(change_plan(spark).orderBy(F.col("record_id").desc()).repartition(3))
    with pytest.raises(ValueError, match="drifted"):
        job.approve(change_plan(spark, shift=1), approved, 4)
    job.approve(change_plan(spark), approved, 4)
    assert job.apply(1) == 1 and job.progress().count() == 1
    again = batches.PagedChange(CommittedTables(spark, f"file://{tmp_path}/s"), "j", "scopes")
    again.approve(change_plan(spark, shift=9), "whatever", 4)  # approved already: the stored plan stays
    assert again.apply() == 3 and again.apply() == 0
    rows = sorted((r["record_id"], r["scope"]) for r in store.read("scopes").collect())
    assert rows == [(i, f"n{i}") for i in range(60) if i % 5]
    assert again.progress().agg(F.sum("writes")).first()[0] == len(rows)
    null = change_plan(spark).withColumn("record_id", F.when(F.col("record_id") > 3, F.col("record_id")))
    with pytest.raises(ValueError, match="without an id"):
        batches.PagedChange(store, "k", "scopes").approve(null, batches.approval(null), 2)
    assert batches.jobs("r1", "r1", ["b"]) == [] and batches.jobs(None, "r2", ["b", "a", "b"]) == [("a", "r2"), ("b", "r2")]


def test_fingerprints_of_tables(spark):
    rows = [(1, "a", None), (2, None, 2.5), (2, None, 2.5)]
    df = spark.createDataFrame(rows, "k int, s string, d double")
    one = measures.fingerprint(df, "k", "s", "d").first()
    assert one == measures.fingerprint(df.repartition(3).orderBy(F.col("k").desc()), "d", "k", "s").first() and one["rows"] == 3
    for other in (rows[:2], [*rows[:2], (2, "", 2.5)], [*rows, (1, "a", None)]):
        assert measures.fingerprint(spark.createDataFrame(other, df.schema), "k", "s", "d").first()["fingerprint"] != one["fingerprint"]


def test_a_snapshot_changes_by_one_rename_and_has_a_time_to_live(spark, tmp_path):
    one, two = (spark.createDataFrame([(1, t)], "v int, fetched_s long") for t in (100, 200))
    path = f"file://{tmp_path}/c"
    assert sinks.fresh_snapshot(spark, path, 0, 10) is None
    name = sinks.write_snapshot(one, path)
    assert sinks.write_snapshot(one, path) == name and len(CommittedTables(spark, path).manifests()) == 1
    assert sinks.fresh_snapshot(spark, path, 109, 10).count() == 1 and sinks.fresh_snapshot(spark, path, 110, 10) is None
    assert sinks.write_snapshot(two, path) != name and sinks.read_snapshot(spark, path).first()["fetched_s"] == 200
    assert sinks.write_snapshot(one, path) == name and sinks.read_snapshot(spark, path).first()["fetched_s"] == 100  # back again


def test_progress_of_sinks_by_hand(spark):
    rnd = random.Random(4)
    slices = sorted(rnd.sample(range(500), 120))
    done = {"none": [], "all": slices, "gap": [s for s in slices if s != slices[40]], "late": slices[:7] + slices[9:90], "first": slices[1:], "odd": [*slices[:3], 9999, slices[0]]}
    rows = [(k, s) for k, v in done.items() for s in v] + [("none", 7777)]
    got = {r["sink"]: (r["pointer"], r["pending"], r["newest"]) for r in control.sink_progress(spark.createDataFrame([(s,) for s in slices], "slice_id long"), spark.createDataFrame(rows, "sink string, slice_id long"), 16).collect()}
    for k, v in done.items():
        own = set(v) & set(slices)
        run_of = next((i for i, s in enumerate(slices) if s not in own), len(slices))
        assert got[k] == (slices[run_of - 1] if run_of else None, len(slices) - len(own), slices[-1]), k


def test_pools_are_cut_before_they_meet(spark, sf):
    from tidemark import plans

    for name in ("tier_boost", "lane_merge", "rerank_pool"):
        plan = plans.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 2, name
    plan = plans.queries()["sink_progress"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") <= 1  # one row of totals
    plan = plans.queries()["linked_evidence"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_white_space_of_any_kind_is_empty(spark):
    prose = "One two three four five six seven eight nine ten words."
    texts = ["   \n", None, "\x1f", prose, prose.replace(" ", " "), "a b c d e f g h" + " " * 40, "x" * 50, "data:image/png;base64," + "A" * 400 + " " + prose, "word " * 60, "word " * 60 + "\nend"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["j"] for r in df.select("i", classify.content_junk("t").alias("j")).orderBy("i").collect()]
    assert got == ["empty", "empty", "empty", None, None, "too_short", "too_few_words", "base64_heavy", "low_prose", None]
