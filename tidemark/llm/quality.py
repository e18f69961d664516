"""Operator 9: quality classifier with hierarchical empirical Bayes.

The evidence of a document is the log-likelihood ratio of a logistic model over its text's
shape: shares of letters, capitals, digits, bars, symbols and line ends, word lengths,
repeated words and lines. The model is fitted on a bounded sample of labelled documents.

The prior of a document comes from its site. Over all labelled documents, good and all
documents are counted per path (within a host) in one grouped aggregation. A host's rate is
shrunk toward the global rate and a path's rate toward its host's, each with a strength
(in pseudo-documents) that the method of moments estimates from how far the rates spread
beyond what chance explains; so sparse sites stay near the global prior. Evidence and
prior odds multiply to the posterior.

Nulls and odd rows: a null or empty text is judged by its (empty) shape; a null host or
path is a site of its own; labels with a null id or quality are ignored; sites without
labels have the global prior; without any usable labels every document has posterior 1/2
and is kept; repeated rows each get their verdict; extra columns are kept or ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Classes of bytes whose shares are features.
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"#$%&*+=<>@\\^_`{}~", b"!?", b".,;:'\"()-/[]", b"\n", b" \t\r"]
_CLASS = np.full(256, len(_KINDS), np.int64)
for _i, _kind in enumerate(_KINDS):
    _CLASS[np.frombuffer(_kind, np.uint8)] = _i
_CLASS[128:] = len(_KINDS) + 1
FEATURES = len(_KINDS) + 2 + 7


def features(text: str | None) -> np.ndarray:
    """The shape of a text as FEATURES numbers."""
    raw = (text or "").encode()
    n = max(len(raw), 1)
    shares = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=len(_KINDS) + 2) / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    w = max(len(words), 1)
    distinct = len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / w
    capitals = shares[1] / max(shares[0] + shares[1], 1e-9)
    more = [math.log1p(len(raw)), min(len(raw) / w, 40.0), distinct / w, math.log1p(w) - math.log1p(distinct), again, 1 - len(set(lines)) / max(len(lines), 1), capitals]
    return np.concatenate([shares, more])


def _expand(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / sd, -6, 6)
    return np.concatenate([z, z * z, np.ones((len(z), 1))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> dict:
    """Ridge logistic regression on the features and their squares, by Newton's method."""
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = _expand(x, mean, sd)
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    rate = (y.sum() + 1) / (len(y) + 2)
    return {"mean": mean, "sd": sd, "w": w, "base": math.log(rate / (1 - rate))}


def evidence(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios good : bad."""
    return np.clip(_expand(x, model["mean"], model["sd"]) @ model["w"], -30, 30) - model["base"]


def labelled_features(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and qualities of at most ``sample`` labelled documents, those of smallest hash."""
    picked = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("double").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("quality", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["quality"], "x": [features(t) for t in batch["text"]]})

    found = rows.mapInPandas(run, "y double, x array<double>").toPandas()
    return np.array(found["x"].tolist(), np.float64).reshape(-1, FEATURES), found["y"].to_numpy(np.float64)


def _strength(groups: DataFrame, rate: Column) -> float:
    """Pseudo-documents of a Beta prior around ``rate`` for groups(n, k), by the method of moments."""
    p = F.col("k") / F.col("n")
    row = groups.where("n > 0").agg(
        F.count("*").alias("m"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * (p - rate) ** 2).alias("s"), F.sum(F.col("n") * rate * (1 - rate)).alias("v")
    ).first()
    if not row["m"] or row["m"] < 2 or not row["v"]:
        return 1e4
    variance = row["v"] / row["n"]
    spread = (row["s"] - (row["m"] - 1) * variance) / max(row["n"] - row["nn"] / row["n"], 1e-9)
    return float(min(max(variance / spread - 1, 1.0), 1e4)) if spread > 0 else 1e4


def site_posteriors(docs: DataFrame, labels: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """host, path and the shrunken rate of good documents there; and the global rate."""
    clean = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("double").alias("quality"))
    sites = docs.select("doc_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    paths = clean.join(sites, "doc_id").groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("quality").alias("k"))
    paths = materialize(paths, "sites")
    total = paths.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = (total["k"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    strength = _strength(hosts, F.lit(rate))
    hosts = hosts.select("host", ((F.col("k") + rate * strength) / (F.col("n") + strength)).alias("host_rate"))
    joined = paths.join(hosts, "host")
    strength = _strength(joined, F.col("host_rate"))
    return joined.select("host", "path", "host_rate", ((F.col("k") + F.col("host_rate") * strength) / (F.col("n") + strength)).alias("site_rate")), rate


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, sample: int = 20_000, broadcast_sites: int = 200_000) -> DataFrame:
    """row (all columns of docs as a struct, so that no name can clash), evidence, site_rate,
    quality (the posterior) and keep."""
    bounded_batches(docs.sparkSession)
    x, y = labelled_features(docs, labels, sample)
    model = fit(x, y) if len(y) and 0 < y.sum() < len(y) else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # called non-deterministic, or a filter that the optimizer makes of ``keep`` (evidence is not null) evaluates it a second time,
    # in Python workers of its own, which then stay
    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        model = shared.value
        if model is None or not len(texts):
            return pd.Series(np.zeros(len(texts)))
        return pd.Series(evidence(model, np.stack([features(t) for t in texts])))

    sites, rate = site_posteriors(docs, labels, host, path)
    if sites.limit(broadcast_sites + 1).count() <= broadcast_sites:
        sites = F.broadcast(sites)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), ratio.asNondeterministic()("text").alias("evidence"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    joined = keyed.join(sites, ["host", "path"], "left").withColumn("site_rate", F.coalesce("site_rate", "host_rate", F.lit(rate)))
    odds = F.col("evidence") + F.log(F.col("site_rate") / (1 - F.col("site_rate")))
    return joined.select("row", "evidence", "site_rate", (1 / (1 + F.exp(-odds))).alias("quality")).withColumn("keep", F.col("quality") >= threshold)


def quality_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, evidence, site_rate, quality and keep."""
    scored = score_quality(docs.select("doc_id", "text", "source", "lang"), labels, **options)
    return scored.select("row.doc_id", "evidence", "site_rate", "quality", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents of good quality, with docs' columns."""
    return score_quality(docs, labels, **options).where("keep").select("row.*")
