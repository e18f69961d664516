from pyspark.sql import functions as F

from tidemark.operators import catalog
from tidemark.sources import readers
from tidemark.streaming import control


def test_scope_grammar(spark):
    keys = ["world", "country:FRA", "admin1:FRA:IDF", "admin2:FRA:IDF:75", "country:fr", "admin1:FRA", ""]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select(catalog.scope_depth(F.col("k"))).collect()
    assert [r[0] for r in rows] == [0, 1, 2, 3, None, None, None]


def test_projection_problems(spark):
    rows = spark.createDataFrame([("resolved", ["a", "b"], False, "r"), ("resolved", ["b", "a"], True, None), ("unavailable", [], False, "r"), ("conflict", None, True, "r")], "status string, tokens array<string>, conflict boolean, revision string")
    got = [r["problems"] for r in catalog.projection_problems(rows).collect()]
    assert got == [[], ["revision", "sorted_unique", "conflict_has_status"], [], []]


def test_one_to_one_conflicts(spark):
    m = spark.createDataFrame([("A", 1), ("A", 1), ("B", 2), ("C", 2), ("D", 3), ("D", 4), (None, 9)], "l string, r int")
    good, bad = catalog.one_to_one(m, "l", "r")
    assert [tuple(r) for r in good.collect()] == [("A", 1)]
    assert sorted(tuple(r) for r in bad.collect()) == [("B", 2), ("C", 2), ("D", 3), ("D", 4)]


def test_infeasible_and_too_near(spark):
    parts = spark.createDataFrame([("a", 5, True), ("b", 9, False), ("c", 1, False)], "key string, rings int, needed boolean")
    covered = spark.createDataFrame([("a",)], "key string")
    assert [r[0] for r in catalog.infeasible(parts, covered, F.col("needed"), 1).collect()] == ["b"]
    p = spark.createDataFrame([(1, 10.0, 10.0), (2, -10.0, 10.0)], "id int, lat double, lon double")
    q = spark.createDataFrame([(7, 10.01, 10.0)], "id int, lat double, lon double")
    assert [(r["seed"], r["centre"]) for r in catalog.too_near(p, q, 5.0).collect()] == [(1, 7)]


def test_control(spark):
    assert control.next_cursor("a", "b", 0) == "b" and control.next_cursor("a", "b", 1) == "a"
    got = spark.createDataFrame([(0,), (2,), (9,)], "n int").select(control.polling_interval(F.col("n"), 30, 600)).collect()
    assert [r[0] for r in got] == [30, 120, 600]
    pending = spark.createDataFrame([("s", i) for i in range(15)] + [("t", 1)], "sink string, slice_id int")
    assert control.replay_batch(pending, 10).count() == 11
    inc = spark.createDataFrame([("a", "open", 1000, 3), ("b", "open", 10, 3), ("c", "closed", 1000, 3)], "key string, status string, last_s long, hits int")
    assert [r["key"] for r in control.open_clusters(inc, 1200).collect()] == ["a"]


def test_canonical_rows(spark):
    m = spark.createDataFrame([(5, "u", 1.5, None, 7)], "global_event_id long, mention_identifier string, mention_doc_tone double, confidence int, char_offset int")
    assert tuple(readers.canonical_mentions(m).first()) == ("gdelt:event:5", "u", 1.5, 0, 7)
    g = spark.createDataFrame([("r1", 20240105000000, "u", "A;;B;", None, "", "1.5,x,2")], "gkg_record_id string, v21_date long, v2_document_identifier string, v1_themes string, v1_persons string, v1_organizations string, v15_tone string")
    r = readers.canonical_documents(g).first()
    assert (r["doc_id"], r["themes"], r["persons"], r["tone_tone"], r["tone_positive"], r["tone_negative"], r["tone_self_group"]) == ("gdelt:gkg:r1", ["A", "B"], [], 1.5, 0.0, 2.0, 0.0)
