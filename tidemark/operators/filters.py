"""Filters that are built from parameters, and the policies that decide which apply."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def payload_filter(spec: Mapping) -> Column:
    """A nested filter: must, should, must_not (lists of filters or conditions). A condition has
    a key and one of match, any, range (gte, gt, lte, lt), is_empty. Nesting is kept as it is."""

    def condition(c: Mapping) -> Column:
        if "key" not in c:
            return payload_filter(c)
        col = F.col(c["key"])
        if "match" in c:
            return F.coalesce(col == c["match"], F.lit(False))
        if "any" in c:
            return F.coalesce(col.isin(*c["any"]), F.lit(False))
        if c.get("is_empty"):
            return col.isNull() | (col.cast("string") == "")
        out = F.lit(True)
        for op, value in c["range"].items():
            out = out & {"gte": col >= value, "gt": col > value, "lte": col <= value, "lt": col < value}[op]
        return F.coalesce(out, F.lit(False))

    out = F.lit(True)
    for c in spec.get("must", ()):
        out = out & condition(c)
    if spec.get("should"):
        some = F.lit(False)
        for c in spec["should"]:
            some = some | condition(c)
        out = out & some
    for c in spec.get("must_not", ()):
        out = out & ~condition(c)
    return out


def scope_filter(scope: str, revisions: Sequence[str], key: Column, revision: Column, conflict: Column) -> Column:
    """The scope itself, in a compatible revision, without conflict."""
    return F.coalesce((key == scope) & revision.isin(*revisions) & ~conflict, F.lit(False))


def token_filter(tokens: Column, relation: str, scope: str, revisions: Sequence[str]) -> Column:
    """Tokens about a scope, of an occurrence in it, or either."""
    relations = {"about": ["about"], "occurrence": ["occurrence"], "either": ["about", "occurrence"]}[relation]
    wanted = [f"{r}:sr1|{scope}|{v}" for r in relations for v in revisions]
    return F.coalesce(F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


@dataclass(frozen=True)
class Activation:
    """Whether a request is answered exactly; if not, why (the first cause that holds)."""

    exact: bool
    cause: str | None = None


def activation(checks: Mapping[str, bool]) -> Activation:
    """Fail-closed: every named check must be true, in the order given; a missing one is false."""
    for cause, ok in checks.items():
        if ok is not True:
            return Activation(False, cause)
    return Activation(True)


def same_country(signal: Mapping[str, Column], iso3: Column, m49: Column, name: Column) -> Column:
    """Whether any of a signal's fields names the country, by code, number or name."""
    clean = lambda c: F.lower(F.trim(c.cast("string")))
    out = F.lit(False)
    for c in signal.values():
        out = out | F.coalesce(clean(c) == clean(iso3), F.lit(False)) | F.coalesce(clean(c) == clean(m49), F.lit(False)) | F.coalesce(clean(c) == clean(name), F.lit(False))
    return out


_WRITES = re.compile(r"\b(insert|update|delete|merge|create|drop|alter|truncate|set|remove|detach|load|call|grant|revoke|use|refresh|cache|uncache|analyze)\b", re.I)


def read_only(sql: str) -> str:
    """The text of a read-only query with a limit; anything else raises ValueError."""
    plain = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    if ";" in plain or _WRITES.search(plain) or not re.match(r"\s*(select|with|values|from)\b", plain, re.I):
        raise ValueError("only one read-only query is allowed")
    return sql


def run_read_only(spark: SparkSession, sql: str, limit: int = 100) -> DataFrame:
    plain = re.sub(r"'(?:[^'\\]|\\.)*'", " ", read_only(sql))
    df = spark.sql(sql)
    return df if re.search(r"\blimit\s+\d+\s*$", plain, re.I) else df.limit(limit)


def due_teasers(rows: DataFrame, now_s: int, batch: int, most: int = 5) -> DataFrame:
    """Rows to fetch now: not in a terminal state, attempts left, backoff over; oldest first."""
    open_state = ~F.coalesce(F.col("state").isin("done", "failed", "skipped_paywall", "skipped_lowquality"), F.lit(False))
    due = F.coalesce(F.col("next_s") <= now_s, F.lit(True)) & (F.coalesce("attempts", F.lit(0)) < most)
    return rows.where(open_state & due).orderBy(F.col("next_s").asc_nulls_first(), "id").limit(batch)


def viewport(rows: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float], rank: Column, most: int) -> DataFrame:
    """Rows in the view, the most important ones if they are too many."""
    from ..functions.geo import in_bbox

    return rows.where(in_bbox(lat, lon, *box)).orderBy(rank.desc(), "id").limit(most)


def tools(available: Mapping[str, bool], needs: Mapping[str, Sequence[str]], wanted: Sequence[str]) -> dict[str, bool]:
    """Which tools may run: all that they need is there; a tool that is not known may not."""
    return {t: t in needs and all(available.get(n, False) for n in needs[t]) for t in wanted}
