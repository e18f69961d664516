import pytest
from pyspark.sql import functions as F

from tidemark.operators import enrich, filters, measures
from tidemark.sources import feeds


def test_read_only_guard(spark):
    assert filters.run_read_only(spark, "select 'drop; table' as x").first()["x"] == "drop; table"
    assert filters.run_read_only(spark, "select id from range(500)").count() == 100
    assert filters.run_read_only(spark, "select id from range(500) limit 300").count() == 300
    for bad in ("drop table t", "select 1; select 2", "insert into t values (1)", "with a as (select 1) delete from t"):
        with pytest.raises(ValueError):
            filters.read_only(bad)


def test_activation_is_fail_closed():
    assert filters.activation({"ready": True, "fresh": True}).exact
    assert filters.activation({"ready": True, "fresh": None, "flag": False}).cause == "fresh"
    assert filters.tools({"graph": True}, {"q": ["graph"], "v": ["vectors"]}, ["q", "v", "x"]) == {"q": True, "v": False, "x": False}


def test_feeds(spark):
    lines = spark.createDataFrame([('{"data": [{"alert_level": "Red", "severity": "x"}, {"alert_level": null, "severity": "2.5"}]}',), ("broken",)], "body string")
    rows = feeds.disasters(feeds.records(lines, "body", "alert_level: string, severity: string", "data")).collect()
    assert sorted((r["alert_rank"], r["severity"]) for r in rows) == [(0, 2.5), (3, 0.0)]
    c = spark.createDataFrame([("2024-01-01", 1, "5"), ("2020-01-01", 1, "5"), ("2024-02-01", 9, None)], "date_start string, type_of_violence int, best string")
    assert sorted((r["violence_label"], r["best"]) for r in feeds.conflicts(c, "2024-06-01").collect()) == [("state-based", 5), ("unknown", 0)]
    a = spark.createDataFrame([("ae0001", "ground", "100"), ("zz", "1000", "x")], "icao24 string, alt_ft string, speed_kn string")
    got = [(r["altitude_m"], r["speed_ms"], r["military_branch"]) for r in feeds.aircraft(a, [(0xAE0000, 0xAEFFFF, "us")]).collect()]
    assert got[0] == (None, 51.4, "us") and got[1][0] == 304.8 and got[1][1] is None
    v = feeds.vessels(spark.createDataFrame([(1, 1_000_000), (2, 300_000)], "mmsi long, timestamp_ms long"), spark.createDataFrame([(1, "n")], "mmsi long, name string"), 1_000_000)
    assert [(r["mmsi"], r["name"]) for r in v.collect()] == [(1, "n")]
    facts = feeds.country_facts(spark.createDataFrame([('{"a": {"text": "<b>x</b> y"}}',)], "body string"), {"A": "$.a.text", "B": "$.b"}).first()["facts"]
    assert [tuple(f) for f in facts] == [("A", "x y")]
    with pytest.raises(ValueError):
        feeds.seeds(spark, [{"id": 1, "name": ""}], ["id", "name"], "id int, name string")


def test_verified_source(spark, tmp_path):
    import hashlib

    (tmp_path / "b.json").write_bytes(b"{}")
    assert feeds.verified(spark, str(tmp_path / "b.json"), hashlib.sha256(b"{}").hexdigest()).first()["content"] == b"{}"
    with pytest.raises(Exception, match="hash mismatch"):
        feeds.verified(spark, str(tmp_path / "b.json"), "0").collect()


def test_measures_and_cache(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    one, two = (measures.fingerprint(r, "k", "v").first()["fingerprint"] for r in (rows, rows.orderBy(F.col("k").desc())))
    assert one == two and measures.fingerprint(rows.withColumn("v", F.lit("c")), "k", "v").first()["fingerprint"] != one
    rel = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "relation_hash string")
    cache = spark.createDataFrame([("h1", "c", "ok"), ("h2", "c", "error"), ("h3", "old", "ok")], "relation_hash string, config string, verdict string")
    assert sorted(r[0] for r in enrich.judge_misses(rel, cache, "c").collect()) == ["h2", "h3"]
    scaled = measures.min_max(spark.createDataFrame([("q", 1.0), ("q", 3.0), ("r", 5.0)], "q string, s double"), ["q"], "s").orderBy("q", "s").collect()
    assert [r["scaled"] for r in scaled] == [0.0, 1.0, 1.0]
