"""The stages of the pipeline over the small tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    from test_operators_llm import brute_components

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            assert out.count() <= docs.count()
        if "Jaccard" in name:
            want = [d for d, _, c in brute_components([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], 5, 80) if d == c]
            assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(want)
        if "decontamination" in name:
            assert docs.count() > out.count() > 0
        docs = out
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns)
    assert docs.agg({"sequence_id": "max"}).first()[0] is not None


def test_equal_rows_with_one_id_stay_once(spark, sf):
    from test_operators_llm import doc_frame

    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    one, two = "the house by the river is old and grey", "a mountain station stands far above the town"
    texts = [(1, one), (1, one), (1, one), (2, one), (3, two), (4, None), (4, None), (5, " "), (5, " "), (None, two), (None, "no id here at all")]
    out = stage(spark, doc_frame(spark, texts), sf)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(1, one), (3, two), (4, None), (4, None), (5, " "), (5, " "), (None, two), (None, "no id here at all")], key=repr)


def test_near_copies_from_four_fifths_on_go(spark, sf):
    from test_operators_llm import doc_frame

    words = [f"w{i}" for i in range(600)]
    footer = lambda n: " ".join(words + [f"f{i}" for i in range(n)])
    out = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, doc_frame(spark, [(1, footer(0)), (2, footer(75)), (3, footer(140)), (4, footer(160))]), sf)
    assert sorted(r["doc_id"] for r in out.collect()) == [1]  # 4 is linked through 2 and 3
    out = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, doc_frame(spark, [(1, footer(0)), (4, footer(160))]), sf)
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4]


@pytest.fixture(scope="module")
def odd_dir(spark, sf, tmp_path_factory):
    """Tables with null, empty, repeated and very long texts, null ids and sources, and clashing columns; and empty ones."""
    from test_operators_llm import doc_frame

    folder = tmp_path_factory.mktemp("odd")
    texts = [(1, None), (2, ""), (3, " \n"), (4, "long words here " * 30_000), (5, "one two three four five six"), (5, "one two three four five six"), (None, "no id here at all"), (6, 'token = "' + "0a1b2c3d" * 5 + '" end')]
    frame = doc_frame(spark, texts)
    frame.write.parquet(f"{folder}/full/documents.parquet")
    frame.where("false").write.parquet(f"{folder}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        table.write.parquet(f"{folder}/full/{name}.parquet")
        table.where("false").write.parquet(f"{folder}/none/{name}.parquet")
    return folder


def test_run_on_odd_rows_and_empty_tables(spark, odd_dir):
    rows = corpus_pipeline.run(spark, f"{odd_dir}/full").collect()
    assert {r["doc_id"] for r in rows} <= {1, 2, 3, 4, 5, 6, None} and all(r["length"] > 0 for r in rows)
    assert corpus_pipeline.run(spark, f"{odd_dir}/none").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
