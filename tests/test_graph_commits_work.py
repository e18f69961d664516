"""Graph commits: rows that several tables share are worked out once, and a log of keys that came once isn't grouped again."""

import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark import plans
from tidemark.operators import extraction, graph_writes
from tidemark.sources.commits import CommittedTables, folded

RULES = {"c": "create", "m": "match", "w": "always", "o": "coalesce", "hi": "max", "l": "append_distinct"}
SCHEMA = "k string, c int, m int, w int, o int, hi int, l array<int>"
ONE = [("a", 1, 1, 1, None, 1, [2, 2, 1]), ("b", None, None, 2, 3, 4, None), (None, 1, 2, 3, 4, 5, [])]
TWO = [("a", 5, 5, None, 5, 0, [3]), ("c", 1, 1, 1, 1, 1, [1])]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def test_a_log_whose_keys_came_once_folds_without_a_shuffle_and_to_the_same(spark, tmp_path):
    store, keyed = CommittedTables(spark, f"file://{tmp_path}/g"), {"t": ["k"]}
    store.commit("one", {"t": spark.createDataFrame(ONE, SCHEMA)}, keys=keyed)
    now = store.current("t", ["k"], RULES)
    assert rows(now) == rows(folded(store.read("t"), ["k"], RULES)) and "Aggregate" not in plan(now)
    store.commit("two", {"t": spark.createDataFrame(TWO, SCHEMA)}, keys=keyed)
    now = store.current("t", ["k"], RULES)
    want = rows(folded(store.read("t"), ["k"], RULES))
    assert rows(now) == want and len(want) == 4 and "Aggregate" in plan(now)
    assert store.compact("tidy", {"t": (["k"], {c: r for c, r in RULES.items() if r != "match"})})
    assert "Aggregate" not in plan(store.current("t", ["k"], {"c": "create"}))
    assert "Aggregate" in plan(store.current("t", ["k", "c"], {"w": "always"}))


def test_keys_that_nobody_vouched_for_are_grouped(spark, tmp_path):
    store = CommittedTables(spark, f"file://{tmp_path}/g")
    store.commit("one", {"t": spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")})
    assert [tuple(r) for r in store.current("t", ["k"], {"v": "always", "missing": "always"}).collect()] == [("a", 2)]


def test_a_written_table_is_unseen_until_a_commit_takes_over_its_folder(spark, tmp_path):
    store = CommittedTables(spark, f"file://{tmp_path}/g")
    made = store.write("t", spark.createDataFrame([("a", 1)], "k string, v int"))
    assert store.read("t") is None
    assert store.commit("one", {"t": made, "u": made.select("k")}) and len(list((tmp_path / "g" / "t").iterdir())) == 1
    assert store.commit("two", {"t": made}) and len(list((tmp_path / "g" / "t").iterdir())) == 2
    assert sorted((r["k"], r["v"], r["__commit"]) for r in store.read("t").collect()) == [("a", 1, 0), ("a", 1, 1)] and store.read("u").count() == 1


def test_places_and_sightings_come_from_one_grouping(spark, tmp_path):
    store = CommittedTables(spark, f"file://{tmp_path}/g")
    seen = spark.createDataFrame([("x", 1.0, 10), ("x", 2.0, 20), ("x", 2.0, 20), ("y", 1.0, 1000)], "icao24 string, lat double, seconds long")
    seen = seen.selectExpr("*", "lat as lon", "'c' as callsign", "'r' as registration", "'t' as type_code", "'b' as branch", "1.0D as altitude_m", "1.0D as speed_ms", "1.0D as heading")
    plain, kept = graph_writes.aircraft_tables(seen), graph_writes.aircraft_tables(seen, store.write)
    assert all(rows(kept[n]) == rows(plain[n]) for n in plain) and kept["spotted_at"].count() == 2
    assert "Aggregate" not in plan(kept["spotted_at"]) and "Aggregate" not in plan(kept["location"])


def test_a_text_that_is_not_kept_is_cut_before_it_is_sent(spark):
    docs = spark.createDataFrame([("\U0001f600" * 5000, "http://a/1"), (None, "http://a/2")], "text string, url string")
    call = lambda text, url: {"events": [{"title": f"{len(text)} {url}"}]}
    whole, cut = extraction.extract(docs, call, []), extraction.extract(docs, call, [], keep=["url"])
    assert cut.columns == ["url", "outcome"] and rows(whole.select("url", "outcome")) == rows(cut)
    assert "substring(text" in plan(cut) and "substring(text" not in plan(whole)


def test_graph_commits_on_documents_that_come_twice(spark, sf, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{sf}/documents.parquet' UNION ALL SELECT doc_id, text || chr(10) || 'Another Line', lang, source, n_chars FROM '{sf}/documents.parquet' WHERE doc_id % 3 = 0) TO '{tmp_path}/documents.parquet'")
    con.execute(f"COPY (SELECT * FROM '{sf}/events.parquet' UNION ALL SELECT * FROM '{sf}/events.parquet' WHERE event_id % 7 = 0) TO '{tmp_path}/events.parquet'")
    for t in ("documents", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = plans.queries()["graph_commits"](spark, str(tmp_path)).toPandas()
    want = con.execute("WITH g AS (" + plans.oracle_sql()["graph_commits"] + ") SELECT DISTINCT * FROM g").fetchall()
    assert sorted(map(tuple, got[["kind", "key", "value"]].itertuples(index=False)), key=repr) == sorted(want, key=repr)
