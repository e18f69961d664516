"""Control tables of recurring work: what is pending, how far each sink is, which state may follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _places(slices: DataFrame, width: int) -> DataFrame:
    """Numeric slice ids with their place among all, from 1: places within stretches of ``width`` ids, after the counts of the
    stretches before, so that no task orders all slices."""
    cut = slices.select("slice_id").distinct().withColumn("__cut", F.floor(F.col("slice_id") / width))
    before = cut.groupBy("__cut").agg(F.count("*").alias("__n"))
    before = before.select("__cut", (F.sum("__n").over(Window.orderBy("__cut")) - F.col("__n")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__cut").orderBy("slice_id"))
    return cut.withColumn("__r", within).join(before, "__cut").select("slice_id", (F.col("__before") + F.col("__r")).alias("place"))


def sink_progress(slices: DataFrame, done: DataFrame, width: int = 4096) -> DataFrame:
    """Per sink the last slice up to which all are done (null: none), how many wait, and the
    newest slice. slices: slice_id (a number); done: sink, slice_id. A sink's rows are compared by place: where its
    n-th done slice is the n-th of all, all before it are done. Slow sinks never hold up others, and no pair of sink
    and slice is made that is not done."""
    sinks = done.select("sink").distinct()
    placed = done.select("sink", "slice_id").distinct().join(_places(slices, width), "slice_id")
    cut = placed.withColumn("__cut", F.floor(F.col("slice_id") / width))
    before = cut.groupBy("sink", "__cut").agg(F.count("*").alias("__n"))
    before = before.select("sink", "__cut", (F.sum("__n").over(Window.partitionBy("sink").orderBy("__cut")) - F.col("__n")).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("sink", "__cut").orderBy("slice_id"))
    own = cut.withColumn("__r", nth).join(before, ["sink", "__cut"]).withColumn("__nth", F.col("__before") + F.col("__r"))
    per = own.groupBy("sink").agg(F.max(F.when(F.col("__nth") == F.col("place"), F.col("slice_id"))).alias("pointer"), F.count("*").alias("__done"))
    totals = slices.agg(F.countDistinct("slice_id").alias("__all"), F.max("slice_id").alias("newest"))
    out = sinks.join(per, "sink", "left").crossJoin(F.broadcast(totals))
    return out.select("sink", "pointer", (F.col("__all") - F.coalesce("__done", F.lit(0))).alias("pending"), "newest")


def replay_batch(pending: DataFrame, most: int = 10) -> DataFrame:
    """The oldest pending slices of each sink, at most so many."""
    w = Window.partitionBy("sink").orderBy("slice_id")
    return pending.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def next_cursor(last: str | None, run_started: str, failures: int) -> str | None:
    """The cursor moves only if a run had no failure."""
    return run_started if failures == 0 else last


#: Transitions that an operator may ask for.
TRANSITIONS = {("open", "silence"): "closed", ("open", "promote"): "promoted"}


def transition(status: Column, action: Column) -> Column:
    """The status after an action; only open incidents change, any other keeps its status."""
    out = status
    for (before, what), after in TRANSITIONS.items():
        out = F.when((status == before) & (action == what), after).otherwise(out)
    return out


def admitted(items: DataFrame, limit: int) -> DataFrame:
    """High priority always; the others in order until so many are pending."""
    low = F.when(F.col("priority") != "high", 1).otherwise(0)
    running = F.sum(low).over(Window.partitionBy("queue").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("admitted", (F.col("priority") == "high") | (running <= limit))


def polling_interval(quiet_polls: Column, base_s: int, most_s: int) -> Column:
    """Doubled with each poll that found nothing, up to a limit; a find resets it."""
    return F.least(F.lit(float(base_s)) * F.pow(F.lit(2.0), quiet_polls), F.lit(float(most_s))).cast("long")


def open_clusters(incidents: DataFrame, now_s: int, quiet: int = 900) -> DataFrame:
    """The state that a detector starts with after a restart: open incidents that are not yet quiet."""
    return incidents.where((F.col("status") == "open") & (F.col("last_s") > now_s - quiet)).select("key", "last_s", "hits")
