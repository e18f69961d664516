"""Counts that accompany the data: coverage, surveys, judge metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judge_metrics(verdicts: DataFrame, predicted: Column, actual: Column, least: float = 0.90) -> DataFrame:
    """Confusion counts, precision of the approved, approval rate and recall; go if something
    is approved and precise enough."""
    tp, fp, fn, tn = (F.count_if(c) for c in (predicted & actual, predicted & ~actual, ~predicted & actual, ~predicted & ~actual))
    m = verdicts.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), b), 6)
    m = m.withColumns({"precision": share("tp", F.col("tp") + F.col("fp")), "recall": share("tp", F.col("tp") + F.col("fn"))})
    m = m.withColumn("approval_rate", F.round(F.try_divide((F.col("tp") + F.col("fp")).cast("double"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6))
    return m.withColumn("go", (F.col("tp") + F.col("fp") > 0) & (F.coalesce("precision", F.lit(0.0)) >= least))


def coverage(rows: DataFrame, by: str, status: Column, statuses: Sequence[str]) -> DataFrame:
    """Per group: counts of disjoint statuses, and in all."""
    marked = rows.withColumn("__s", status)
    return marked.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(F.col("__s") == s).alias(s) for s in statuses])


def publishable(counts: DataFrame, bad: Sequence[str], limit: float = 0.01) -> DataFrame:
    """Whether the bad statuses are at most a share of the total."""
    share = sum((F.col(c) for c in bad), F.lit(0)) / F.col("total")
    return counts.withColumn("publishable", F.coalesce(share <= limit, F.lit(False)))


def survey(rows: DataFrame, *dims: str) -> DataFrame:
    """Counts for every prefix of the dimensions; a dimension that is summed up is null."""
    return rows.rollup(*dims).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def top_values(rows: DataFrame, dim: str, n: int = 12) -> DataFrame:
    return rows.groupBy(dim).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), dim).limit(n)


def min_max(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """value scaled to 0..1 over each key's rows; 1 where there is no spread."""
    span = rows.groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = F.when(F.col("__hi") == F.col("__lo"), 1.0).otherwise((F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)))
    return rows.join(span, list(keys)).withColumn("scaled", scaled).drop("__lo", "__hi")


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """A SHA-256 of a table that does not depend on its order: each row as canonical JSON (columns by name, nulls kept) has a
    hash, whose four parts of 60 bits are summed over all rows; sums and count are hashed again."""
    hashed = rows.select(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    whole = F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[part(i) for i in range(4)]), 256)
    return hashed.agg(F.count("*").alias("rows"), whole.alias("fingerprint"))


def next_number(rows: DataFrame, key: str, number: str) -> DataFrame:
    return rows.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next"), F.count("*").alias("n"))
