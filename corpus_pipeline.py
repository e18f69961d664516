"""The corpus pipeline: quality classifier, near-duplicate join, decontamination, secret scan, packing.

Near duplicates are documents whose sets of five-word shingles have a similarity of 0.8 or more.

Nulls and odd rows: a null or empty text is judged by the classifier like any other and, if kept, links
with nothing, holds no passage and no secret, and is packed as its separator alone; a row with a
null doc_id is kept by the join; equal rows with one doc_id stay once; extra columns are
carried through to packing, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, jaccard_join, quality, queries, secret_scan
from tidemark.llm.common import materialize, table


def _keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def _deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicate(docs, size=5, percent=80)


def _redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", _keep_good),
    ("n-gram Jaccard join", _deduplicate),
    ("benchmark decontamination", _decontaminate),
    ("secret scans", _redact),
    ("packing", _pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
