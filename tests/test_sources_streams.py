import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import readers, sinks
from tidemark.streaming import live, twins

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("code", T.StringType()), T.StructField("tone", T.DoubleType())])


def test_strict_and_fallback(spark, tmp_path):
    good, bad = tmp_path / "good.tsv", tmp_path / "bad.tsv"
    good.write_text("1\t010\t2.5\n2\t\t\n")
    bad.write_text("1\t010\tx\n2\t011\n\t012\t1\n3\t013\t4\n")
    rows = readers.read_strict(spark, str(good), SCHEMA).orderBy("id").collect()
    assert [tuple(r)[:3] for r in rows] == [(1, "010", 2.5), (2, None, None)]
    rows, aside = readers.read_fallback(spark, str(bad), SCHEMA, ["id"])
    assert [(r["id"], r["tone"], r["coerced"]) for r in rows.orderBy("id").collect()] == [(1, None, 1), (3, 4.0, 0)]
    assert sorted(r["reason"] for r in aside.collect()) == ["field_count", "null_key"]
    assert readers.error_percent(rows, aside).first()["error_percent"] == 75.0
    sinks.write_quarantine(aside, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).count() == 2


def test_manifest_and_md5(spark, tmp_path):
    import hashlib

    body = b"a\tb\n"
    (tmp_path / "20240101000000.export.CSV").write_bytes(body)
    (tmp_path / "m.txt").write_text(f"4 {hashlib.md5(body).hexdigest()} http://h/20240101000000.export.CSV\nbroken line\n")
    m = readers.read_manifest(spark, str(tmp_path / "m.txt"))
    assert [(r["stream"], r["slice_id"], r["size"]) for r in m.collect()] == [("events", "20240101000000", 4)]
    files = m.select(F.element_at(F.split("url", "/"), -1).alias("name"), "md5")
    assert [r["verified"] for r in readers.verified_files(spark, str(tmp_path / "*.CSV"), files).collect()] == [True]


def test_geojson_lines_and_thermal(spark, tmp_path):
    f = {"features": [{"id": "q1", "geometry": {"type": "Point", "coordinates": [1.5, 2.5, 10]}, "properties": {"mag": 4.2, "place": "x"}}, {"id": "l", "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}, "properties": {}}]}
    (tmp_path / "f.json").write_text(json.dumps(f))
    rows = readers.multi_lines(readers.read_geojson(spark, str(tmp_path / "f.json"), {"magnitude": ("mag", "double"), "place": ("place", "string")})).collect()
    assert (rows[0]["lon"], rows[0]["lat"], rows[0]["depth_km"], rows[0]["magnitude"], rows[0]["place"]) == (1.5, 2.5, 10.0, 4.2, "x")
    assert rows[1]["lat"] is None and rows[1]["lines"] == [[[0.0, 0.0], [1.0, 1.0]]]
    (tmp_path / "t.csv").write_text("latitude,longitude,brightness,scan,track,acq_date,acq_time,satellite,confidence,frp,daynight\n1,2,390,1,1,2024-01-01,7,N,h,90,D\nbad,2,1,1,1,2024-01-01,7,N,h,,D\n")
    r = readers.read_thermal(spark, str(tmp_path / "t.csv")).collect()
    assert len(r) == 1 and r[0]["possible_explosion"] and r[0]["acquired"].minute == 7


def test_tle_markdown_tables(spark):
    sat = "SAT A\n1 25544U 98067A   24001.50000000  .00016717  00000-0  10270-3 0  9000\n2 25544  51.6400 208.9163 0006317  69.9862  25.2906 15.50000000    04\n"
    files = spark.createDataFrame([("junk line\n" + sat,)], "t string")
    r = readers.parse_tle(files, F.col("t")).collect()
    assert [(x["name"], x["norad_id"], round(x["period_minutes"], 2)) for x in r] == [("SAT A", 25544, 92.9)]
    md = spark.createDataFrame([("### Acme\n- **Founded:** 1999\n- **HQ:** Bonn\n### Beta\nplain\n",)], "t string")
    blocks = {r["name"]: r["fields"] for r in readers.markdown_blocks(md, F.col("t")).collect()}
    assert blocks == {"Acme": {"Founded": "1999", "HQ": "Bonn"}, "Beta": {}}
    table = spark.createDataFrame([("| Name | Count |\n|---|---|\n| Leo | 10 |\n| bad |\n",)], "t string")
    assert [(r["name"], r["count"]) for r in readers.pipe_table(table, F.col("t"), ["name", "count"]).collect()] == [("Leo", "10")]
    lines = spark.createDataFrame([(1, 0, "## Army"), (1, 1, "### P1"), (1, 2, "## Navy"), (1, 3, "### P2")], "d int, p int, l string")
    assert [(r["branch"], r["program"]) for r in readers.heading_fill(lines, "d", "p", "l").orderBy("p").collect()] == [("Army", "P1"), ("Navy", "P2")]


def test_tle_numbers_of_more_than_five_digits(spark):
    one, two = "1 {}U 98067A   24001.50000000  .00016717  00000-0  10270-3 0  9000", "2 {}  51.6400 208.9163 0006317  69.9862  25.2906 15.50000000    04"
    names = ("25544", "    5", "900123", "1234567")
    body = "\n".join(x for n in names for x in (f"SAT {n}", one.format(n), two.format(n)))
    r = readers.parse_tle(spark.createDataFrame([(body,)], "t string"), F.col("t")).collect()
    assert [(x["norad_id"], x["inclination"], x["mean_motion"]) for x in r] == [(int(n), 51.64, 15.5) for n in names]


def test_element_files_beyond_five_digits(spark, tmp_path):
    from tidemark.plans import feeds

    rows = [(k, f"C{k}") for k in (7, 99_999, 100_000, 900_123)]
    spark.createDataFrame(rows, "c_custkey long, c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {(r["name"], r["norad_id"], r["inclination"], r["motion"]) for r in feeds.element_files(spark, str(tmp_path)).collect()}
    assert got == {(n, k, k % 180 * 10 + 5, (1 + k % 15) * 10 + 5) for k, n in rows if k % 13 != 4}


def test_collections_of_a_feed_are_lines_not_files(spark, tmp_path):
    from tidemark.plans import feeds

    spark.range(5_000).selectExpr("id as event_id", "cast(id % 90 as double) as value").write.parquet(str(tmp_path / "events.parquet"))
    got = feeds.feature_collections(spark, str(tmp_path))
    assert got.count() == 5_000 and got.select("id").distinct().count() == 5_000
    assert len(got.inputFiles()) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # there was a file for each hundred


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "date string, v int")
    sinks.write_slices(rows, str(tmp_path / "s"))
    sinks.write_slices(rows.where("v = 2").withColumn("v", F.lit(9)), str(tmp_path / "s"))
    assert sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1, 9]
    name = sinks.write_snapshot(rows, str(tmp_path / "c"))
    assert sinks.write_snapshot(rows.orderBy(F.col("v").desc()), str(tmp_path / "c")) == name
    assert sinks.read_snapshot(spark, str(tmp_path / "c")).count() == 2
    pts = sinks.valid_points(spark.createDataFrame([(0.0, 0.0), (1.0, None), (1.0, 2.0)], "lat double, lon double")).collect()
    assert [tuple(p) for p in pts] == [(None, None), (None, None), (1.0, 2.0)]


def run_stream(spark, tmp_path, rows, schema, build):
    rows_df = spark.createDataFrame(rows, schema)
    rows_df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = build(spark.readStream.schema(rows_df.schema).parquet(str(tmp_path / "in")))
    live.write_idempotent(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()


def test_threshold_detector(spark, tmp_path):
    rows = [("a", t) for t in (0, 10, 20, 30, 5000)] + [("b", 0), ("b", 10)]
    got = run_stream(spark, tmp_path, rows, "k string, s long", lambda d: live.threshold_detector(d, "k", "s", 100, 3, 900, 900))
    assert sorted((r["key"], r["seconds"], r["kind"], r["hits"]) for r in got) == [("a", 20, "ignition", 3), ("a", 30, "update", 4), ("a", 930, "close", 4)]


def test_topic_clusters(spark, tmp_path):
    rows = [("s", 1, "fire at the old port tonight now", "c1"), ("s", 2, "fire at the old port tonight now", "c2"), ("s", 3, "entirely other words are here today", "c1")]
    got = run_stream(spark, tmp_path, rows, "shard string, n long, t string, c string", lambda d: live.topic_clusters(d, "shard", "n", "t", "c"))
    assert {r["number"]: r["topic"] for r in got} == {1: 1, 2: 1, 3: 3}


def test_ignition_twin_agrees_with_the_stream(spark, tmp_path):
    rows = [(f"k{i % 4}", i * 7 % 200) for i in range(40)]
    got = run_stream(spark, tmp_path, rows, "k string, s long", lambda d: live.threshold_detector(d, "k", "s", 60, 3, 10_000, 0))
    first = {r["key"]: r["seconds"] for r in got if r["kind"] == "ignition"}
    batch = spark.createDataFrame(rows, "k string, s long").withColumn("id", F.monotonically_increasing_id())
    twin = {r["k"]: r["s"] for r in twins.ignitions(batch, ["k"], F.col("s"), 60, 3, "id").collect()}
    assert first == twin and twin
