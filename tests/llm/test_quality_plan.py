"""The pipeline's quality stage evaluates its features once a row."""

from tidemark.llm import quality


def test_evidence_is_evaluated_once(spark, capsys):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "$$ ## 11", "en", "web") for i in range(40)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels)
    kept.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
    assert sorted(r.doc_id for r in kept.collect()) == list(range(1, 40, 2))
