"""Pairs are many, so what is done for each has to be compiled, and rounding by decimals is for values next to a tie."""

import io
import random
import re
from contextlib import redirect_stdout
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import spatial
from tidemark.plans import places


def test_no_step_has_more_code_than_the_jvm_compiles(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with redirect_stdout(io.StringIO()) as out:
            places.correlation_pairs(spark, "/root/testdata/sf0.001").explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000  # beyond, the JVM interprets a method for good


def test_rows_are_not_held_for_cells_and_days_at_once(spark):
    day = F.to_date(F.lit("2024-01-05"))
    rows = spark.range(50).select("id", (F.col("id") * 0.1).alias("lat"), (F.col("id") * 0.1).alias("lon"), day.alias("day"))
    plan = spatial.near_pairs(rows, rows, 300.0, 1, 3.0)._jdf.queryExecution().optimizedPlan().toString()
    sides = plan.split("Join Inner")[1].split("RepartitionByExpression [r#")
    assert len(sides) == 3 and sides[1].count("Generate explode") == 1 and sides[2].count("Generate explode") == 2


def test_rounding_away_from_ties_and_at_them(spark):
    rnd = random.Random(3)
    values = [rnd.uniform(-2, 2) for _ in range(2000)] + [k / 1000 for k in range(-400, 400)] + [k / 8 for k in range(-20, 20)] + [rnd.uniform(-1e9, 1e9) for _ in range(200)]
    values += [0.0, -0.0, -0.001, 1e-9, 999999.995, 1e15, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", geo.two_decimals("v").alias("two"), geo.rounded("v", 3).alias("got"), F.round("v", 3).alias("want")).collect()
    assert [repr(r["got"]) for r in rows] == [repr(r["want"]) for r in rows]
    finite = [r for r in rows if r["v"] is not None and abs(r["v"]) < 1e6]
    assert [repr(r["two"]) for r in finite] == [repr(float(Decimal(r["v"]).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) + 0.0) for r in finite]
