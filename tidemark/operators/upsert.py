"""Keyed upserts and deduplication as pure functions of old and new rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What becomes of a column when its key is already there.
RULES = ("create", "match", "always", "coalesce", "max", "min", "append_distinct")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: Mapping[str, str]) -> DataFrame:
    """old with new merged into it by key (new has one row per key). Columns by rule:
    create: set on insert only; match: replaced on update only (null on insert); always: the
    new value; coalesce: the new value unless null; max, min: of both; append_distinct: the
    old array, then what is new, in order."""
    unknown = set(rules.values()) - set(RULES)
    if unknown:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    a, b = old.withColumn("__old", F.lit(True)), new.withColumn("__new", F.lit(True))
    a = a.select(*[F.col(c).alias(f"o_{c}") for c in a.columns])
    b = b.select(*[F.col(c).alias(f"n_{c}") for c in b.columns])
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    joined = a.join(b, on, "full_outer")
    is_old, is_new = F.col("o___old").isNotNull(), F.col("n___new").isNotNull()

    def merged(name: str, rule: str) -> Column:
        o, n = F.col(f"o_{name}"), F.col(f"n_{name}")
        if rule == "create":
            return F.when(is_old, o).otherwise(n)
        if rule == "match":
            return F.when(is_old & is_new, n).when(is_old, o)
        if rule == "always":
            return F.when(is_new, n).otherwise(o)
        if rule == "coalesce":
            return F.coalesce(n, o)
        if rule == "max":
            return F.greatest(o, n)
        if rule == "min":
            return F.least(o, n)
        return F.array_union(F.coalesce(o, F.array().cast(old.schema[name].dataType)), F.coalesce(n, F.array().cast(old.schema[name].dataType)))

    return joined.select(*[F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys], *[merged(c, r).alias(c) for c, r in rules.items()])


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new rows whose key isn't there yet."""
    return new.join(old.select(*keys), list(keys), "left_anti")


def mark_new(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new with is_new: rows seen for the first time run the pipeline, others only refresh."""
    seen = old.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return new.join(seen, list(keys), "left").withColumn("is_new", F.col("__seen").isNull()).drop("__seen")


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order without ties."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def at_most_one(links: DataFrame, targets: DataFrame, on: str, source: str, order: Sequence[Column]) -> DataFrame:
    """Each source linked to one target at most, the first in order."""
    return first_by(links.join(targets, on), [source], order)


def partial_update(old: DataFrame, patch: DataFrame, key: str, columns: Sequence[str], clearable: str | None = None) -> DataFrame:
    """Null fields of a patch change nothing; one field is cleared where clear_<field> is true."""
    p = patch.select(F.col(key), *[F.col(c).alias(f"p_{c}") for c in columns], *([F.col(f"clear_{clearable}").alias("__clear")] if clearable else []))
    joined = old.join(p, key, "left")
    value = lambda c: F.when(F.col("__clear"), F.lit(None)).otherwise(F.coalesce(f"p_{c}", c)) if c == clearable else F.coalesce(f"p_{c}", c)
    return joined.select(*[value(c).alias(c) if c in columns else F.col(c) for c in old.columns])


def replace_owned(old: DataFrame, new: DataFrame, key: str, owned: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """Only the owned fields are replaced where a new row is there; kept ones survive omission."""
    n = new.select(F.col(key), F.lit(True).alias("__new"), *[F.col(c).alias(f"n_{c}") for c in (*owned, *kept)])
    joined = old.join(n, key, "left")
    value = lambda c: F.when(F.col("__new"), F.col(f"n_{c}")).otherwise(F.col(c)) if c in owned else F.coalesce(f"n_{c}", c)
    return joined.select(*[value(c).alias(c) if c in owned or c in kept else F.col(c) for c in old.columns])


def colliding(rows: DataFrame, resolved: str) -> DataFrame:
    """Resolved names that more than one approved row would write, which must be none."""
    return rows.groupBy(resolved).agg(F.count("*").alias("n")).where("n > 1")


def rekey_plan(rows: DataFrame, current: str, desired: Column) -> DataFrame:
    """Rows whose key would change, with the key that they should have."""
    return rows.withColumn("desired_key", desired).where(F.col(current) != F.col("desired_key"))
