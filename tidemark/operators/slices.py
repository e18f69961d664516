"""Selection and linkage of one slice of events, mentions and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def override_ids(mentions: DataFrame, documents: DataFrame, override: Column) -> DataFrame:
    """Ids of the events that a document with the override mentions. mentions: event_id, url; documents: url."""
    urls = documents.where(override).select("url").where("url is not null")
    return mentions.join(urls, "url", "left_semi").select("event_id").distinct()


def select_events(events: DataFrame, tactical: Column, overridden: DataFrame) -> DataFrame:
    """Tactical events and those overridden, with the reason; tactical comes first."""
    flagged = events.join(overridden.select("event_id", F.lit(True).alias("__over")), "event_id", "left")
    reason = F.when(tactical, "tactical").when(F.col("__over"), "nuclear_override")
    return flagged.withColumn("filter_reason", reason).where("filter_reason is not null").drop("__over")


def link_documents(documents: DataFrame, mentions: DataFrame, events: DataFrame) -> DataFrame:
    """Each document with its linked events: sorted distinct ids and types, least score, and
    the mean weighted by mentions. Aggregated before the join; documents without links have
    empty arrays and null scores."""
    per_url = (
        mentions.join(events, "event_id")
        .groupBy("url")
        .agg(
            F.sort_array(F.collect_set("event_id")).alias("linked_event_ids"),
            F.sort_array(F.collect_set("event_type")).alias("linked_types"),
            F.min("score").alias("min_score"),
            (F.sum(F.col("score").cast("decimal(28,4)")).cast("double") / F.count("score")).alias("avg_score"),
        )
    )
    linked = documents.join(per_url, "url", "left")
    for name in ("linked_event_ids", "linked_types"):
        linked = linked.withColumn(name, F.coalesce(name, F.array().cast(linked.schema[name].dataType)))
    return linked


def mention_outcomes(mentions: DataFrame, documents: DataFrame, events: DataFrame) -> DataFrame:
    """Mentions by whether their document and their event are there."""
    found = mentions.join(documents.select("url", F.lit(1).alias("d")).distinct(), "url", "left").join(events.select("event_id", F.lit(1).alias("e")).distinct(), "event_id", "left")
    outcome = F.when(F.col("d").isNull() & F.col("e").isNull(), "both_missing").when(F.col("d").isNull(), "document_missing").when(F.col("e").isNull(), "event_missing").otherwise("linked")
    return found.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def unique_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in an explicit order; rows with a null key are dropped."""
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with the names of the rules that they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    checked = rows.withColumn("broken_rules", broken)
    return checked.where(F.size("broken_rules") == 0).drop("broken_rules"), checked.where(F.size("broken_rules") > 0)


def pending(wanted: DataFrame, *done: DataFrame) -> DataFrame:
    """Slices wanted but neither done nor failed."""
    for table in done:
        wanted = wanted.join(table, wanted.columns, "left_anti")
    return wanted


def exact_cover(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: missing or orphan."""
    missing = expected.select(key).distinct().join(got.select(key), key, "left_anti").select(key, F.lit("missing").alias("problem"))
    orphan = got.select(key).distinct().join(expected.select(key), key, "left_anti").select(key, F.lit("orphan").alias("problem"))
    return missing.unionByName(orphan)


def slice_status(streams: DataFrame) -> DataFrame:
    """Per slice: whether all its streams are done, and the number of those that failed. streams: slice_id, stream, status."""
    return streams.groupBy("slice_id").agg(F.bool_and(F.col("status") == "done").alias("complete"), F.count_if(F.col("status") == "failed").alias("failed"))
