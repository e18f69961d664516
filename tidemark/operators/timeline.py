"""Timeline reads: windows, histograms, dominant categories, notables and tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_window(ts: Column | str, start: str, end: str) -> Column:
    """Both ends inclusive; a null time is outside."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a zone-free timestamp."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def bucket_index(ms: Column, start_ms: int, end_ms: int, buckets: int) -> Column:
    """Equal buckets over the span; values at or beyond an end fall into the outer buckets."""
    width = max((end_ms - start_ms) // buckets, 1)
    return F.least(F.greatest(F.floor((ms - F.lit(start_ms)) / F.lit(width)), F.lit(0)), F.lit(buckets - 1)).cast("int")


def histogram(events: DataFrame, ms: Column, start_ms: int, end_ms: int, buckets: int, category: Column, severity: Column) -> DataFrame:
    """Long form: a row per non-empty bucket, category and severity, with its count."""
    binned = events.select(bucket_index(ms, start_ms, end_ms, buckets).alias("bucket"), category.alias("category"), severity.alias("severity"))
    return binned.groupBy("bucket", "category", "severity").agg(F.count("*").alias("n"))


def histogram_maps(counts: DataFrame) -> DataFrame:
    """A row per bucket from the long form: total, counts by category and by severity
    as sorted ``key=count`` strings."""

    def side(key: str) -> DataFrame:
        each = counts.groupBy("bucket", key).agg(F.sum("n").alias("n"))
        return each.groupBy("bucket").agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", key, F.col("n").cast("string")))), ",").alias(f"by_{key}"))

    return side("category").join(side("severity").drop("total"), "bucket")


def dominant(counts: DataFrame, keys: Sequence[str], value: str, priority: Sequence[str], n: str = "n") -> DataFrame:
    """The most frequent value per key; ties by a fixed priority list, then by name."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in priority]), F.col(value)), F.lit(0))
    rank = F.when(rank == 0, len(priority) + 1).otherwise(rank)
    each = counts.groupBy(*keys, value).agg(F.sum(n).alias("__n"))
    best = each.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("n"), rank.alias("r"), F.col(value).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(f"dominant_{value}"), (-F.col("b.n")).alias("dominant_n"))


def samples(events: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows in order, each with the number of all rows and whether some were left out."""
    total = events.agg(F.count("*").alias("total"))
    first = events.orderBy(*order).limit(limit)
    return first.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def ranked_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each key in an order without ties."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def notables(candidates: DataFrame, key: str, seconds: str, most: int) -> DataFrame:
    """candidates (severity, is_incident) in one ranking: critical ones, incidents, high ones, others;
    newer first in each. An id counts once, by its best place."""
    tier = F.when(F.col("severity") == "critical", 0).when(F.col("is_incident"), 1).when(F.col("severity") == "high", 2).otherwise(3)
    order = [F.col("tier"), F.col(seconds).desc(), F.col("is_incident"), F.col(key)]
    once = candidates.withColumn("tier", tier).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")
    return once.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
