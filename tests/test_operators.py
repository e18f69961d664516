import math
import random

from pyspark.sql import functions as F

from tidemark.operators import enrich, graph, retrieval, slices, spatial, texts, timeline, upsert


def test_weighted_mean_and_empty_links(spark):
    docs = spark.createDataFrame([("u1",), ("u2",)], "url string")
    mentions = spark.createDataFrame([(1, "u1"), (1, "u1"), (2, "u1")], "event_id long, url string")
    events = spark.createDataFrame([(1, 1.0, "a"), (2, 4.0, "b")], "event_id long, score double, event_type string")
    got = {r["url"]: r for r in slices.link_documents(docs, mentions, events).collect()}
    assert got["u1"]["linked_event_ids"] == [1, 2] and got["u1"]["avg_score"] == 2.0 and got["u1"]["min_score"] == 1.0
    assert got["u2"]["linked_event_ids"] == [] and got["u2"]["avg_score"] is None


def test_select_events_precedence(spark):
    events = spark.createDataFrame([(1, 18), (2, 1), (3, 1), (4, 18)], "event_id long, root int")
    over = spark.createDataFrame([(2,), (4,)], "event_id long")
    got = {r["event_id"]: r["filter_reason"] for r in slices.select_events(events, F.col("root") == 18, over).collect()}
    assert got == {1: "tactical", 2: "nuclear_override", 4: "tactical"}


def test_upsert_rules(spark):
    schema = "k int, c string, m string, a string, n int, l array<string>"
    old = spark.createDataFrame([(1, "c", "m", "a", 5, ["x"]), (2, "c2", "m2", "a2", 1, ["y"])], schema)
    new = spark.createDataFrame([(1, "C", "M", None, 3, ["z", "x"]), (3, "C3", "M3", "A3", 9, None)], schema)
    rules = {"c": "create", "m": "match", "a": "coalesce", "n": "max", "l": "append_distinct"}
    once = upsert.upsert(old, new, ["k"], rules)
    got = {r["k"]: tuple(r)[1:] for r in once.collect()}
    assert got == {1: ("c", "M", "a", 5, ["x", "z"]), 2: ("c2", "m2", "a2", 1, ["y"]), 3: ("C3", None, "A3", 9, [])}
    again = {r["k"]: tuple(r)[1:] for r in upsert.upsert(once, new, ["k"], rules).collect()}
    assert again[1] == got[1] and again[2] == got[2]  # a replay changes nothing that was there


def test_two_hops_walk_no_edge_twice(spark):
    edges = spark.createDataFrame([(1, "r", "a", "b"), (2, "r", "b", "c"), (3, "r", "a", "b")], "id int, rel string, src string, dst string")
    got = {(r["neighbour"], r["hops"]) for r in graph.two_hops(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {("b", 1), ("c", 2)}


def test_near_pairs_against_brute_force(spark):
    random.seed(5)
    pts = [(i, random.uniform(-89.9, 89.9) if i % 3 else random.choice([-89.5, 89.2]), random.choice([-179.9, 179.8, random.uniform(-180, 180)]), f"2024-01-{random.randint(1, 4):02d}") for i in range(220)]
    a = spark.createDataFrame(pts[:110], "id int, lat double, lon double, day string").withColumn("day", F.to_date("day"))
    b = spark.createDataFrame(pts[110:], "id int, lat double, lon double, day string").withColumn("day", F.to_date("day"))

    def km(p, q):
        x = math.sin(math.radians(q[1] - p[1]) / 2) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(1, x)))

    want = {(p[0], q[0]) for p in pts[:110] for q in pts[110:] if km(p, q) <= 300 and abs(int(p[3][-2:]) - int(q[3][-2:])) <= 1}
    got = [(r["a_id"], r["b_id"]) for r in spatial.near_pairs(a, b, 300.0, 1, 3.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_polygons_edges_and_holes(spark):
    square = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
    hole = [(4, 4), (6, 4), (6, 6), (4, 6), (4, 4)]
    p = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (0.0, 5.0), (11.0, 1.0)], "lat double, lon double")
    got = [(r["inside"], r["edge"]) for r in spatial.locate(p, [{"key": "world:a", "rings": [square, hole]}]).collect()]
    assert got == [(["world:a"], []), ([], []), ([], ["world:a"]), ([], [])]


def test_longitude_extent_wraps(spark):
    rows = spark.createDataFrame([("p", 175.0, 0.0), ("p", -170.0, 5.0), ("q", 10.0, 1.0), ("q", 20.0, 2.0)], "k string, lon double, lat double")
    got = {r["k"]: (r["west"], r["east"]) for r in spatial.longitude_extent(rows, ["k"], "lon", "lat").collect()}
    assert got == {"p": (175.0, -170.0), "q": (10.0, 20.0)}


def test_markdown_chunks_overlap_whole_sentences():
    text = " ".join(f"Sentence number {i} ends here." for i in range(60))
    chunks = texts.markdown_chunks_of(text, 300, 80)
    assert all(len(c) <= 300 for c in chunks) and chunks[0].startswith("Sentence number 0")
    assert all(chunks[i + 1].split(". ")[0] in chunks[i] for i in range(len(chunks) - 1))
    assert texts.markdown_chunks_of("", 300, 80) == [] and texts.markdown_chunks_of("x" * 1000, 300, 80) == ["x" * 1000]


def test_budget_pack_skips_and_goes_on(spark):
    items = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(s).alias("size")) for i, s in enumerate([5, 9, 3, 2])])
    r = spark.range(1).select(retrieval.budget_pack(items, 10).alias("p"), retrieval.tail_first_budget(items, 12).alias("t")).first()
    assert (r["p"]["ids"], r["p"]["used"]) == ([0, 2, 3], 10) and r["t"]["ids"] == [0, 2, 3]


def test_bucket_index_clamps(spark):
    got = [r[0] for r in spark.createDataFrame([(-5,), (0,), (99,), (100,)], "ms long").select(timeline.bucket_index(F.col("ms"), 0, 100, 10)).collect()]
    assert got == [0, 0, 9, 9]


def test_longest_contained(spark):
    got = enrich.longest_contained(spark.createDataFrame([("The Alpha Strike unit",), ("none",)], "t string"), spark.createDataFrame([("alpha",), ("Alpha Strike",), ("uni",)], "name string"), "t")
    assert {r["t"]: r["contained"] for r in got.collect()} == {"The Alpha Strike unit": "Alpha Strike", "none": None}


def test_plans_push_down(spark, sf):
    plan = spark.read.parquet(f"{sf}/events.parquet").where(timeline.in_window("ts", "2024-01-03 00:00:00", "2024-01-04 00:00:00")).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_support_of_relations_is_counted_without_arrays(spark):
    rows = [("a", "r", "b", i % 3 if i % 4 else None, i // 2 if i % 5 else None) for i in range(40)] + [("a", "r", "c", None, None)]
    df = spark.createDataFrame(rows, "src string, rel string, dst string, provenance int, evidence int")
    got = graph.relation_support(df, 3)
    assert {r["dst"]: (r["provenance"], r["support"], r["evidence"]) for r in got.collect()} == {"b": ([0, 1, 2], 3, [0, 1, 2]), "c": ([], 0, None)}
    plan = got.select("support", "evidence")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(provenance" not in plan and "collect_set(provenance" not in plan and "WindowGroupLimit" in plan


def test_chunks_of_a_batch_leave_it_in_parts(spark):
    df = spark.createDataFrame([(i, "One two. Three four. " * 20 if i % 7 else None) for i in range(450)], "k long, t string").coalesce(1)
    want = [(i, j, c) for i in range(450) if i % 7 for j, c in enumerate(texts.markdown_chunks_of("One two. Three four. " * 20, 100, 20))]
    assert sorted(tuple(r) for r in texts.markdown_chunks(df, "k", "t", 100, 20).collect()) == want
    assert "MapInArrow" in texts.markdown_chunks(df, "k", "t")._jdf.queryExecution().executedPlan().toString()
