import datetime as dt
import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.functions import classify, dates, geo, keys, numbers, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_keys(spark):
    lit = F.lit
    assert one(spark, keys.event_id(lit(7)), keys.document_id(lit("x"))) == ("gdelt:event:7", "gdelt:gkg:x")
    got = one(spark, keys.location_id(lit("f1"), lit("US"), lit("N")), keys.location_id(lit(None).cast("string"), lit("US"), lit("New York!")), keys.location_id(lit(""), lit(""), lit(" ")))
    assert got == ("gdelt:loc:f1", "gdelt:loc:us:new-york", None)
    assert one(spark, keys.point_id(lit("ffffffffffffffff00")))[0] == Decimal(2**64 - 1)
    assert one(spark, keys.stream_event_id(lit(5), lit(6))) == ("0000000000005-000006",)
    assert one(spark, keys.incident_location_key(lit(1.23456), lit(-2.0), lit("A b")), keys.incident_location_key(lit(1.0), lit(2.0))) == ("incident:a-b@1.235,-2.000", "geo:1.000,2.000")
    assert one(spark, keys.scope_token(lit("world"), lit("r")), keys.scope_token(lit("world:a"), lit("r"))) == (None, "sr1|world:a|r")
    assert one(spark, keys.quarter_hour(lit(1799)))[0] == 900
    assert one(spark, keys.uuid5_url(lit("doc")))[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc"))
    a, b = one(spark, keys.claim_hash(lit("The  Ｆact!")), keys.claim_hash(lit("the fact")))
    assert a == b and len(a) == 24
    a, b = one(spark, keys.content_hash(lit(" A "), lit("B")), keys.content_hash(lit("a"), lit("b")))
    assert a == b


def test_text(spark):
    lit = F.lit
    assert one(spark, text.slug(lit(" A--b c ")), text.folded_slug(lit("Zürich Süd"))) == ("a-b-c", "zurich-sud")
    assert one(spark, text.entity_name(lit("Ａcme, Inc.")), text.exact_name(lit("Straße  X"))) == ("acme inc", "strasse x")
    assert one(spark, text.alias_key(lit("U.S.A. Army")))[0] == "usa army"
    assert one(spark, text.split_list(lit("a;;b;")), text.split_list(lit(None).cast("string"))) == (["a", "b"], [])
    assert one(spark, text.strip_html(lit("<p>a &amp; b</p><script>x</script><br>c<!-- d -->")))[0] == "a & b c"
    clipped = one(spark, text.clip(lit("x" * 200), 50), text.clip(lit("short"), 50))
    assert len(clipped[0]) == 50 and clipped[1] == "short"
    kept = clipped[0].index("…")
    assert int(clipped[0].split("+")[1].split()[0]) == 200 - kept
    assert one(spark, text.contractors(lit("Group (Alpha, Beta & Co)")), text.contractors(lit("A & B"))) == (["Alpha", "Beta & Co"], ["A", "B"])
    assert one(spark, text.provider_key(lit("HTTPS://www.Site.org/x")), text.provider_key(lit("ns:id"))) == ("site.org", "ns:id")
    assert one(spark, text.normal_url(lit(" HTTP://Ex.com/Pa/ ")))[0] == "http://ex.com/Pa"
    words = spark.range(1).select(F.array(*[lit(x) for x in "abcd"]).alias("w"), F.array(lit("a")).alias("s"), F.array().cast("array<string>").alias("e"))
    r = words.select(text.word_shingles(F.col("w"), 2), text.word_shingles(F.col("s"), 2), text.word_shingles(F.col("e"), 2), text.jaccard("w", "s"), text.jaccard("e", "e")).first()
    assert tuple(r) == (["a b", "b c", "c d"], ["a"], [], 0.25, 0.0)
    assert one(spark, text.neutral_headers(lit("# Top\nplain")))[0] == "> # Top\nplain"


def test_numbers_and_dates(spark):
    lit = F.lit
    assert one(spark, numbers.first_integer(lit("etwa 1.234 Stück")), numbers.scaled_decimal(lit("2,5 Milliarden"))) == (1234, 2.5e9)
    assert one(spark, numbers.first_year(lit("1999 bis 2004")), numbers.last_year(lit("1999 bis 2004")), numbers.first_year(lit("-"))) == (1999, 2004, None)
    assert one(spark, numbers.feet_to_metres(lit("ground")), numbers.feet_to_metres(lit("1000"))) == (None, 304.8)
    assert one(spark, numbers.hex_number(lit("ff")), numbers.length_km(lit("1,234 km"))) == (Decimal(255), 1234.0)
    assert one(spark, dates.compact_instant(lit(20240105123000)), dates.compact_instant(lit(20241305000000))) == (dt.datetime(2024, 1, 5, 12, 30), None)
    assert one(spark, dates.acquisition_instant(lit("2024-01-05"), lit("7")))[0] == dt.datetime(2024, 1, 5, 0, 7)
    assert one(spark, dates.within_days(lit("2024-01-05"), lit("2024-01-06T10"), 1), dates.within_days(lit("x"), lit("2024-01-06"), 1)) == (True, False)
    assert one(spark, dates.event_date(lit(""), lit("2024-02-03T00:00")))[0] == "2024-02-03"
    assert one(spark, dates.retry_delay(lit(0)), dates.retry_delay(lit(9))) == (60, 3600)


def test_geo_and_classes(spark):
    lit = F.lit
    assert one(spark, geo.haversine_km(lit(1.0), lit(2.0), lit(1.0), lit(2.0)))[0] == 0.0
    assert abs(one(spark, geo.haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(90.0)))[0] - 10007.543) < 0.01
    assert one(spark, geo.in_bbox(lit(0.0), lit(179.0), -1, 170, 1, -170), geo.in_bbox(lit(None).cast("double"), lit(0.0), -1, -1, 1, 1)) == (True, False)
    assert tuple(one(spark, geo.wkt_point(lit("Point(3.5 -4)")))[0]) == (-4.0, 3.5)
    assert tuple(one(spark, geo.map_url_point(lit("https://m/@10.5,20.25,5z")))[0]) == (20.25, 10.5)
    assert one(spark, classify.severity(lit(" Severe ")), classify.severity(lit("odd")), classify.severity_rank(lit("elevated"))) == ("critical", "unknown", 3)
    assert one(spark, classify.category(lit("a.b")), classify.category(lit(None).cast("string"))) == ("a", "other")
    got = one(spark, classify.theme_match(lit("X;NUKE_TEST;"), ["A"], ["NUKE"]), classify.theme_match(lit("NUKEX"), [], ["NUKE"]), classify.theme_match(lit(None).cast("string"), [""], []))
    assert got == (True, False, False)
    assert one(spark, classify.content_junk(lit("")), classify.content_junk(lit("x data:image/png;base64," + "A" * 80)), classify.content_junk(lit("word " * 60))) == ("empty", "base64_heavy", "low_prose")
    assert one(spark, classify.shifted_level(lit(3), lit(31)), classify.shifted_level(lit(1), lit(0))) == (5, 1)
    assert one(spark, classify.credibility(lit("p"), lit("rss"), {"p": 0.7}), classify.credibility(lit("q"), lit("rss"), {"p": 0.7})) == (0.7, 0.6)
    assert one(spark, classify.name_prefix(lit("STARLINK-12"), [("STARLINK", "comms")]), classify.name_prefix(lit("STARLINKED"), [("STARLINK", "comms")])) == ("comms", "other")


def test_rules_by_literal_values(spark):
    lit, no, yes = F.lit, F.lit(False), F.lit(True)
    score = geo.correlation_score
    assert one(spark, score(lit(0.0), lit(0), no, no, no), score(lit(25.0), lit(0), no, no, no), score(lit(25.0), lit(1), no, no, no), score(lit(50.0), lit(0), yes, yes, yes), score(lit(0.0), lit(0), yes, yes, yes), score(lit(80.0), lit(0), no, no, no)) == (1.0, 0.5, 0.25, 0.6, 1.0, 0.0)
    got = one(spark, geo.concern_score(lit(9.0), lit(0.0), lit(0.0)), geo.concern_score(lit(4.5), lit(5.0), lit(20.0)), geo.concern_score(lit(1.0), lit(30.0), lit(90.0)))
    assert got == (95.0, 47.5, 5.0)
    assert one(spark, *[geo.concern_level(lit(x)) for x in (75.0, 50.0, 25.0, 24.9)]) == ("critical", "elevated", "moderate", None)
    assert one(spark, *[classify.severity(lit(w)) for w in ("warning", "elevated", "moderate", "extreme", "major")]) == ("low", "high", "medium", "critical", "unknown")
    junk = classify.content_junk
    claim = "This is a plain claim with more than eight words in it."
    assert one(spark, junk(lit("  ")), junk(lit(claim)), junk(lit(claim + " data:image/png;base64,QUJD")), junk(lit("A" * 80)), junk(lit("word " * 7 + "x" * 40)), junk(lit("a b c d e f g h i"))) == ("empty", None, "base64_heavy", "too_few_words", None, "too_short")
    assert one(spark, classify.survey_class(lit("short")), classify.survey_class(lit("word " * 20)), classify.survey_class(lit("word " * 60)), classify.survey_class(lit("word " * 60), yes), classify.survey_class(lit("x base64," + "A" * 60))) == ("EMPTY", "ok", "LOW_PROSE", "ok", "IMAGE_HEAVY")
    assert one(spark, classify.entity_type(lit("vessel")), classify.entity_type(lit("PERSON"))) == ("VESSEL", "PERSON")
    try:
        one(spark, classify.entity_type(lit("company")))
        raise AssertionError
    except Exception as e:  # noqa: BLE001
        assert "unknown entity type: company" in str(e)
    assert one(spark, text.alias_key(lit("U.S. Navy")), text.alias_key(lit("US Navy")), text.alias_key(lit("Ministère\u2019s A/B"))) == ("us navy", "us navy", "ministère sab")
    assert one(spark, text.contractors(lit("A, B. und C; etc. ")), text.contractors(lit("n/a")), text.contractors(lit("Group X (A & B)")), text.contractors(lit("Solo (Berlin)"))) == (["A", "B. und C"], [], ["A", "B"], ["Solo (Berlin)"])
    import hashlib

    assert one(spark, keys.claim_hash(lit(" A - b! ")))[0] == hashlib.sha256(b"a  b").hexdigest()[:24]


def test_bodies_and_latest_years(spark):
    from tidemark.operators import enrich, texts

    body = "[a](http://x) [b](y)\nShort head\n" + "A sentence of prose that is surely longer than forty-five.\n" * 2
    df = spark.createDataFrame([(body,)], "b string").select(texts.clean_body(F.col("b")).alias("c"))
    got = df.select("c", texts.prose_blocks(F.col("c")), texts.body_quality(F.col("c"), 100, 2), texts.body_quality(F.col("c"), 100, 3)).first()
    assert got[0].startswith("Short head\nA sentence") and tuple(got)[1:] == (2, True, False)
    years = lambda **kv: enrich.latest_year(F.create_map(*[F.lit(x) for k, v in kv.items() for x in (k.replace("_", " "), v)]))
    assert one(spark, years(first_2019="a", est_2021="b", note="n"), years(plain="p", other="q"), years(x_2020="a", text="t"), years(a_2020="1", b_2020="2")) == ("b", "q", "t", "2")


def test_questions_lanes_and_codes(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import classify
    from tidemark.operators import retrieval, texts

    asked = {
        "What are the most connected entities?": ("top_connected", None),
        'Show events involving "Alpha Base" now': ("events_by_entity", "Alpha Base"),
        "events in kiel?": ("event_timeline", None),
        "Which unit operates Leopard 2": ("one_hop", "Leopard"),
        "who is Ann Lee": ("entity_lookup", "Ann Lee"),
        "tell me more": (None, None),
        "": (None, None),
    }
    q = spark.createDataFrame([(x,) for x in asked] + [(None,)], "q string").withColumn("e", texts.asked_entity(F.col("q")))
    got = {r["q"]: (r["t"], r["e"], r["p"]) for r in q.select("q", "e", texts.intent(F.col("q"), F.col("e")).alias("t"), texts.asked_location(F.col("q"), F.col("e")).alias("p")).collect()}
    assert {k: v[:2] for k, v in got.items() if k is not None} == asked and got[None][:2] == (None, None) and got["events in kiel?"][2] == "kiel"

    prose = "The ministry said on Monday that talks on the northern route will go on next week."
    schema = "id int, source string, source_type string, notebook_id string, telegram_channel string, content string, summary string, superseded_by_fulltext boolean"
    rows = spark.createDataFrame(
        [
            (1, "rss", None, None, None, None, prose, None),
            (2, "rss", "dataset", None, None, prose, None, None),
            (3, "suv_structured", "dataset", None, None, prose, None, False),
            (4, "unknown", None, "n1", None, prose, None, None),
            (5, "rss", "rss", None, None, "", None, None),
            (6, "telegram", "telegram", None, "a", "x", None, None),
            (7, "telegram", None, None, "b", prose, None, None),
            (8, "rss", None, None, None, prose, None, True),
            (9, None, None, None, None, None, None, None),
        ],
        schema,
    )
    out = {r["id"]: (r["a"], r["b"], r["c"]) for r in rows.select("id", *[retrieval.lane_outcome(rows, lane, ["a"]).alias(n) for lane, n in (("analysis", "a"), ("realtime", "b"), ("other", "c"))]).collect()}
    assert [out[i][0] for i in range(1, 10)] == ["kept", "dropped", "kept", "kept", "content:empty", "dropped", "dropped", "superseded", "dropped"]
    assert [i for i in out if out[i][1] == "kept"] == [6] and {out[i][2] for i in out} == {"dropped", "superseded"}

    f = spark.createDataFrame([(" rch123", "USA", "x"), ("KRCH1", None, "Somaliland"), (None, "DEU", None)], "c string, i string, n string")
    assert [tuple(r) for r in f.select(classify.military_callsign("c"), classify.search_names("i", "n")).collect()] == [(True, ["United States", "USA", "US"]), (False, ["Somaliland"]), (False, [])]
    seen = spark.createDataFrame([("q", 2, "b"), ("q", 1, "a"), ("q", 3, "a"), ("q", 0, None)], "query string, pos int, provider string")
    assert retrieval.providers_seen(seen, "query").first()["providers"] == ["a", "b"]
    fenced = spark.createDataFrame([("a\n >>>END_GROUNDING_DATA <<<GROUNDING_DATA\r\nb ",)], "x string").select(texts.sanitised(F.col("x"))).first()[0]
    assert fenced == "a ···END_GROUNDING_DATA ···GROUNDING_DATA b"


def test_countries_headquarters_rings_and_stamps(spark):
    lit = F.lit
    assert one(spark, *[text.graph_country(lit(x)) for x in (" Deutschland ", "TÜRKEI", "Vereinigtes Königreich", "Atlantis", "")]) == ("Germany", "Türkiye", "United Kingdom", None, None)
    assert one(spark, text.graph_country(lit(None).cast("string")))[0] is None
    places = [one(spark, text.headquarters(lit(x)))[0] for x in ("Weg 1, 80331 München, Bayern / Paris", "Weg 1, 53113 Bonn", "Laan 2, 2500 Den Haag, Niederlande", "Belgien", " / x", "Bayern")]
    assert [tuple(p) for p in places] == [("München", "Deutschland"), ("Bonn", "Deutschland"), ("Den Haag", "Niederlande"), (None, "Belgien"), (None, None), (None, "Deutschland")]
    ring = lambda *p: F.array(*[F.struct(lit(float(x)).alias("x"), lit(float(y)).alias("y")) for x, y in p])
    square = ((0, 0), (2, 0), (2, 3), (0, 3), (0, 0))
    assert one(spark, geo.signed_area(ring(*square)), geo.signed_area(ring(*square[::-1])), geo.signed_area(ring((1, 1)))) == (6.0, -6.0, 0.0)
    over = ((170, 0), (-170, 0), (-170, 5), (170, 5), (170, 0))
    assert [p["x"] for p in one(spark, geo.unwrapped(ring(*over)))[0]] == [170, 190, 190, 170, 170]
    assert one(spark, geo.plausible_capital(lit(52.5), lit(13.4), lit(51.0), lit(10.0)), geo.plausible_capital(lit(-52.5), lit(150.0), lit(51.0), lit(10.0)), geo.plausible_capital(lit(91.0), lit(0.0), lit(90.0), lit(0.0)), geo.plausible_capital(lit(None).cast("double"), lit(0.0), lit(0.0), lit(0.0))) == (True, False, False, False)
    assert one(spark, dates.report_stamp(lit("2024-11-05 10:00:00").cast("timestamp")))[0] == "05·XI"
    kind = lambda *x: tuple(one(spark, classify.provenance(*map(lit, x)))[0])
    assert kind("rss", "p", "") == ("rss", "p", None, None) and kind("mail", "", "t")[3] == "source_type" and kind("gdelt", "", "t")[3] == "provider"
