"""shingle_jaccard sends hashes of shingles, not their texts, and gives what the texts give."""

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans import texts


def test_hashed_sets_are_as_large_and_meet_as_often(spark):
    rows = [("a b c d e f", "a b c d e g"), ("a a a a a a a", "a a a a a"), ("a b", "a b"), ("", "a"), ("", "")]
    df = spark.createDataFrame(rows, "x string, y string").select(*[F.filter(F.split(c, " "), lambda w: w != "").alias(c) for c in "xy"])
    sets = lambda f: df.select(f(F.col("x"), 5).alias("x"), f(F.col("y"), 5).alias("y")).select(F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))).collect()
    assert sets(text.shingle_hashes) == sets(text.word_shingles)


def test_no_null_text_and_no_shingle_text_is_shuffled(spark, tmp_path):
    rows = [(1, "one two three four five"), (2, "one two three four five"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = texts.shingle_jaccard(spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(1, 1.0)]
    assert "array_union" not in got._jdf.queryExecution().optimizedPlan().toString()
