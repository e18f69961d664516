"""Pairs of a cell are told apart by a product; their distance is worked out once, and cells without nested lambdas."""

from tidemark.plans import places


def test_the_distance_of_a_pair_is_worked_out_once(spark):
    plan = places.correlation_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ASIN(") == 1
    assert "lambda" not in plan
