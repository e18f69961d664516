"""Registered queries: an operator bound to tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogs, enrichment, feeds, graphs, incidents, places, policies, scalars, slices, streams, texts, timeline

_MODULES = (timeline, slices, graphs, enrichment, places, texts, streams, policies, catalogs, incidents, feeds, scalars)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
