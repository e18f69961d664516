"""Batch forms of the streaming operators: the same rules over a finished table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_count(events: DataFrame, keys: Sequence[str], seconds: Column, window: int) -> DataFrame:
    """Each event with the number of its key's events in the window that ends with it, one exactly a window old included. The
    window runs over counts per second, so that a hot key is small before it is sorted."""
    timed = events.withColumn("__s", seconds.cast("long"))
    per = timed.groupBy(*keys, "__s").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__s").rangeBetween(-window, 0)
    per = per.withColumn("hits", F.sum("__n").over(w)).drop("__n")
    right = per.select(*[F.col(c).alias(f"__r_{c}") for c in (*keys, "__s")], "hits")
    on = F.lit(True)
    for c in (*keys, "__s"):
        on = on & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return timed.join(right, on).select(*events.columns, "hits")


def ignitions(events: DataFrame, keys: Sequence[str], seconds: Column, window: int, least: int, order: str) -> DataFrame:
    """The first event of each key at which the window holds enough hits."""
    counted = sliding_count(events, keys, seconds, window).withColumn("__s", seconds.cast("long")).where(F.col("hits") >= least)
    first = Window.partitionBy(*keys).orderBy("__s", order)
    return counted.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "__s")


def sessions(events: DataFrame, keys: Sequence[str], seconds: Column, quiet: int) -> DataFrame:
    """Clusters that close after so many quiet seconds: per key and session its start, end and
    hits, from counts per second."""
    per = events.withColumn("__s", seconds.cast("long")).groupBy(*keys, "__s").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__s")
    s = per.withColumn("__new", F.coalesce((F.col("__s") - F.lag("__s").over(w) > quiet).cast("int"), F.lit(1)))
    s = s.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*keys, "session").agg(F.min("__s").alias("start_s"), F.max("__s").alias("end_s"), F.sum("__n").alias("hits"))


def escalation(hits: Column, curve: Sequence[tuple[int, str]], default: str) -> Column:
    """The level of the highest step of a curve that a running count has reached; it never falls."""
    out = F.lit(default)
    for least, level in sorted(curve):
        out = F.when(hits >= least, level).otherwise(out)
    return out


def contiguous_watermark(items: DataFrame, key: str, number: str, ok: Column) -> DataFrame:
    """Per key: the last number before the first failure (null if the first one failed), and
    the number of items after it."""
    first_bad = items.groupBy(key).agg(F.min(F.when(~ok, F.col(number))).alias("__bad"))
    joined = items.join(first_bad, key)
    good = F.col("__bad").isNull() | (F.col(number) < F.col("__bad"))
    return joined.groupBy(key).agg(F.max(F.when(good, F.col(number))).alias("watermark"), F.count_if(~good).alias("held_back"))


def replay_after(ring: DataFrame, last_id: str | None, id_column: str = "id") -> DataFrame:
    """Rows after an id, and whether the reader must reset since its id is older than all that
    are kept. An empty id replays nothing."""
    if not last_id:
        return ring.where("false").withColumn("reset", F.lit(False))
    oldest = ring.agg(F.min(id_column).alias("__oldest"))
    return ring.where(F.col(id_column) > last_id).crossJoin(F.broadcast(oldest)).withColumn("reset", F.col("__oldest") > last_id).drop("__oldest")


def last_positions(positions: DataFrame, key: str, order: Column, columns: Sequence[str]) -> DataFrame:
    """The latest row per key, by partial aggregation."""
    latest = positions.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__l"))
    return latest.select(key, *[F.col(f"__l.{c}").alias(c) for c in columns])


def retained(events: DataFrame, seconds: str, now: int, age: int, rows: int, id_column: str) -> DataFrame:
    """The ring: not older than age, the newest rows, each id once."""
    fresh = events.where(F.col(seconds) > now - age).dropDuplicates([id_column])
    return fresh.orderBy(F.col(id_column).desc()).limit(rows)


def albums(messages: DataFrame, group: Column, number: str) -> DataFrame:
    """Messages by album, the smallest number standing for it; a message without album is its own."""
    key = F.coalesce(group.cast("string"), F.concat(F.lit("m"), F.col(number).cast("string")))
    return messages.groupBy(key.alias("album")).agg(F.min(number).alias("canonical"), F.count("*").alias("parts"))


def dead_letters(attempts: DataFrame, key: str, most: int) -> DataFrame:
    """Per message: attempts, whether it was acknowledged, or is for the dead-letter table."""
    per = attempts.groupBy(key).agg(F.count("*").alias("attempts"), F.bool_or("ok").alias("done"))
    return per.withColumn("dead", ~F.col("done") & (F.col("attempts") >= most))


def global_burst(events: DataFrame, seconds: str, key: str, window: int, least: int) -> DataFrame:
    """One cluster of all events in the order of (seconds, key): kind is ignition for the first at which
    the last ``window`` seconds hold ``least``, update for all later ones; earlier ones are left out.
    The window runs over counts per second, and only the second of the ignition is ordered."""
    per = events.groupBy(F.col(seconds).cast("long").alias("__s")).agg(F.count("*").alias("__n"))
    w = Window.orderBy("__s").rangeBetween(-window, 0)
    first = per.withColumn("__sum", F.sum("__n").over(w)).where(F.col("__sum") >= least)
    first = first.agg(F.min_by(F.struct("__s", (least - F.col("__sum") + F.col("__n")).alias("nth")), "__s").alias("f")).select("f.*").where("__s is not null")
    later = events.join(F.broadcast(first), F.col(seconds) >= F.col("__s"))
    there = later.where(F.col(seconds) == F.col("__s")).withColumn("__r", F.row_number().over(Window.partitionBy("__s").orderBy(key)))
    there = there.where(F.col("__r") >= F.col("nth")).withColumn("kind", F.when(F.col("__r") == F.col("nth"), "ignition").otherwise("update"))
    after = later.where(F.col(seconds) > F.col("__s")).withColumn("kind", F.lit("update"))
    return there.select(*events.columns, "kind").unionByName(after.select(*events.columns, "kind"))
