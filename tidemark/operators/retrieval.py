"""Dense retrieval, ranking policy, and budgets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import content_junk, mapped


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; null if one is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_top_k(vectors: DataFrame, query: Sequence[float], key: str, vector: str, k: int, threshold: float = 0.3, where: Column | None = None) -> DataFrame:
    """The k vectors most like one query among those that pass a filter and a threshold."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if where is None else vectors.where(where)
    return rows.withColumn("score", cosine(F.col(vector), q)).where(F.col("score") >= threshold).orderBy(F.col("score").desc(), key).limit(k)


def top_per_query(scored: DataFrame, query: str, key: str, score: Column, k: int) -> DataFrame:
    """The k best per query with their rank."""
    w = Window.partitionBy(query).orderBy(score.desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank(pool: DataFrame, query: str, scorer: Callable[[DataFrame], Column] | None, keep: int) -> DataFrame:
    """The pool cut by a scorer, or in its own order without one. pool: query, pos, ..."""
    order = [scorer(pool).desc(), F.col("pos")] if scorer else [F.col("pos")]
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= keep)


def boosted(pool: DataFrame, query: str, score: str, credibility: str, weight: float = 0.2) -> DataFrame:
    """pool with ``boosted``: scores normalised over each query's pool (no spread: 1), mixed with credibility. The spans come from a
    grouping, so that no task holds a pool."""
    span = pool.groupBy(query).agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    low, high = F.col("__low"), F.col("__high")
    normal = F.when(high == low, 1.0).otherwise((F.col(score) - low) / F.nullif(high - low, F.lit(0.0)))
    return pool.join(span, query).withColumn("boosted", (1 - weight) * normal + weight * F.col(credibility)).drop("__low", "__high")


def tier_boost(pool: DataFrame, query: str, score: str, credibility: str, weight: float = 0.2, keep: int | None = None) -> DataFrame:
    """``boosted`` with the rank in each query; equal ones keep their order. With ``keep`` only the best stay, of which each task passes on
    no more than that."""
    w = Window.partitionBy(query).orderBy(F.col("boosted").desc(), "pos")
    ranked = boosted(pool, query, score, credibility, weight).withColumn("rank", F.row_number().over(w))
    return ranked if keep is None else ranked.where(F.col("rank") <= keep)


def lane_merge(rows: DataFrame, query: str, k: int = 5, most_realtime: int = 1, order: Sequence[Column] | None = None) -> DataFrame:
    """k per query: analysis first, then at most most_realtime of the realtime lane at the end. order: of the rows, by default their
    rank. Each lane is cut to k rows before the lanes of a query meet."""
    order = list(order or [F.col("rank")])
    live = F.col("lane") == "realtime"
    placed = rows.withColumn("__n", F.row_number().over(Window.partitionBy(query, "lane").orderBy(*order))).where(F.col("__n") <= max(k, most_realtime))
    counts = F.sum(F.when(live & (F.col("__n") <= most_realtime), 1).otherwise(0)).over(Window.partitionBy(query))
    kept = placed.withColumn("__live", counts).where((live & (F.col("__n") <= most_realtime)) | (~live & (F.col("__n") <= k - F.col("__live"))))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(live.cast("int"), *order))).drop("__n", "__live")


#: Sources of the analysis lane and the type that each must have.
ANALYSIS_TYPES = {"rss": "rss", "rss_fulltext": "rss", "suv_structured": "dataset"}


def lane_outcome(rows: DataFrame, lane: str, channels: Sequence[str], analysis: dict[str, str] = ANALYSIS_TYPES) -> Column:
    """What becomes of a retrieved row in a lane: kept, superseded, dropped, or content: and why its
    text is junk. A type that is given must be its source's; an unknown lane keeps nothing."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    filled = lambda c: F.coalesce(have(c) != "", F.lit(False))
    fits = lambda kind: have("source_type").isNull() | (have("source_type") == kind)
    ok, junk = F.lit(False), F.lit(None).cast("string")
    if lane == "analysis":
        known = F.coalesce(have("source").isin(*analysis), F.lit(False))
        ok = F.when(known, fits(mapped(have("source"), analysis, ""))).when(filled("notebook_id"), fits(F.lit("notebooklm"))).otherwise(False)
        junk = content_junk(F.coalesce(*[F.when(filled(c), have(c)) for c in ("content", "summary", "description", "title")]))
    elif lane == "realtime":
        ok = F.coalesce((have("source") == "telegram") & have("telegram_channel").isin(*channels), F.lit(False)) & fits(F.lit("telegram"))
    superseded = have("superseded_by_fulltext").cast("boolean") if "superseded_by_fulltext" in rows.columns else F.lit(False)
    return F.when(F.coalesce(superseded, F.lit(False)), "superseded").when(~ok, "dropped").when(junk.isNotNull(), F.concat(F.lit("content:"), junk)).otherwise("kept")


def providers_seen(items: DataFrame, query: str) -> DataFrame:
    """Each query's providers in the order in which its evidence first names them. items: pos, provider."""
    first = items.where(F.col("provider").isNotNull()).groupBy(query, "provider").agg(F.min("pos").alias("pos"))
    return first.groupBy(query).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "provider"))), lambda x: x["provider"]).alias("providers"))


def unique_evidence(items: DataFrame, query: str) -> DataFrame:
    """The first of each evidence hash, else reference id, per query. items: pos, content_hash, ref_id."""
    key = F.coalesce("content_hash", "ref_id", F.col("pos").cast("string"))
    w = Window.partitionBy(query, key).orderBy("pos")
    return items.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def budget_pack(items: Column, budget: int) -> Column:
    """Greedy fold over an ordered array of structs (id, size): an item that doesn't fit is
    skipped and the fold goes on. The ids taken and their total."""
    start = F.struct(F.array().cast("array<bigint>").alias("ids"), F.lit(0).cast("bigint").alias("used"))
    step = lambda acc, x: F.when(acc["used"] + x["size"] <= budget, F.struct(F.array_append(acc["ids"], x["id"].cast("bigint")).alias("ids"), (acc["used"] + x["size"]).cast("bigint").alias("used"))).otherwise(acc)
    return F.aggregate(items, start, step)


def evidence_pack(items: Column, budget: int, separator: int = 2) -> Column:
    """Blocks of evidence in their order, an array of structs (id, hash, size): a hash that is in the pack is left out, and so is a
    block that does not fit whole, with a separator before all but the first; later and smaller ones are still
    tried. The ids taken and the pack's length."""
    start = F.struct(F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<string>").alias("hashes"), F.lit(0).cast("bigint").alias("used"))

    def step(acc: Column, x: Column) -> Column:
        size = x["size"] + F.when(F.size(acc["ids"]) > 0, separator).otherwise(0)
        fits = (acc["used"] + size <= budget) & ~F.array_contains(acc["hashes"], x["hash"])
        taken = F.struct(F.array_append(acc["ids"], x["id"].cast("bigint")).alias("ids"), F.array_append(acc["hashes"], x["hash"]).alias("hashes"), (acc["used"] + size).cast("bigint").alias("used"))
        return F.when(fits, taken).otherwise(acc)

    return F.aggregate(items, start, step, lambda acc: F.struct(acc["ids"].alias("ids"), acc["used"].alias("used")))


def tail_first_budget(items: Column, budget: int) -> Column:
    """budget_pack from the end of the array, the ids again in the array's order."""
    packed = budget_pack(F.reverse(items), budget)
    return F.struct(F.reverse(packed["ids"]).alias("ids"), packed["used"].alias("used"))
