"""Deterministic identity keys: the same input gives the same key on any replay."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import slug


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def event_id(raw: Column | str) -> Column:
    return F.concat(F.lit("gdelt:event:"), _col(raw).cast("string"))


def document_id(raw: Column | str) -> Column:
    return F.concat(F.lit("gdelt:gkg:"), _col(raw).cast("string"))


def location_id(feature: Column | str, country: Column | str, name: Column | str) -> Column:
    """The feature's id; else lower-cased country and slug of the name; null if all are empty."""
    feature, country, name = (F.coalesce(F.trim(_col(c)), F.lit("")) for c in (feature, country, name))
    made = F.concat(F.lit("gdelt:loc:"), F.lower(country), F.lit(":"), slug(name))
    return F.when(feature != "", F.concat(F.lit("gdelt:loc:"), feature)).when((country != "") | (name != ""), made)


def parts_hash(parts: Sequence[Column | str]) -> Column:
    """SHA-256 of the lower-cased, trimmed parts joined by bars; a null part is empty."""
    return F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(_col(p).cast("string"), F.lit("")))) for p in parts]), 256)


def content_hash(title: Column | str, url: Column | str) -> Column:
    return parts_hash([title, url])


def point_id(hex_hash: Column | str) -> Column:
    """The first 16 hexadecimal digits as an unsigned 64-bit number (decimal, since longs are signed)."""
    return F.conv(F.substring(_col(hex_hash), 1, 16), 16, 10).cast("decimal(20,0)")


def event_key(document_hash: Column | str, kind: Column | str, title: Column | str) -> Column:
    """24 hexadecimal digits of a hash over document, type and normalised title (200 characters at most)."""
    clean = F.substring(F.lower(F.regexp_replace(F.trim(F.coalesce(_col(title), F.lit(""))), r"\s+", " ")), 1, 200)
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(_col(document_hash), F.lit("")), F.coalesce(_col(kind), F.lit("")), clean), 256), 1, 24)


def incident_location_key(lat: Column | str, lon: Column | str, name: Column | str | None = None) -> Column:
    """incident:slug@lat,lon to three places, or geo:lat,lon without a name."""
    at = F.format_string("%.3f,%.3f", _col(lat).cast("double"), _col(lon).cast("double"))
    if name is None:
        return F.concat(F.lit("geo:"), at)
    made = slug(F.coalesce(_col(name), F.lit("")))
    return F.when(made != "", F.concat(F.lit("incident:"), made, F.lit("@"), at)).otherwise(F.concat(F.lit("geo:"), at))


def source_ref_id(*candidates: Column | str) -> Column:
    """20 hexadecimal digits of a hash over the first candidate that isn't empty."""
    first = F.coalesce(*[F.when(F.trim(_col(c)) != "", F.trim(_col(c))) for c in candidates])
    return F.substring(F.sha2(first, 256), 1, 20)


def stream_event_id(ms: Column | str, sequence: Column | str) -> Column:
    """Zero-padded, so that the order of strings is the order of time."""
    return F.concat(F.lpad(_col(ms).cast("string"), 13, "0"), F.lit("-"), F.lpad(_col(sequence).cast("string"), 6, "0"))


def scope_token(scope: Column | str, revision: Column | str) -> Column:
    """sr1|scope|revision; null for the world scope or beyond 229 bytes."""
    made = F.concat_ws("|", F.lit("sr1"), _col(scope), _col(revision))
    return F.when((_col(scope) != "world") & (F.octet_length(made) <= 229), made)


def quarter_hour(seconds: Column | str) -> Column:
    return (F.floor(_col(seconds) / 900) * 900).cast("long")


def relation_hash(source: Column | str, relation: Column | str, target: Column | str, evidence: Column | str) -> Column:
    return parts_hash([source, relation, target, evidence])


@F.pandas_udf(T.StringType())
def uuid5_url(names: pd.Series) -> pd.Series:
    """UUID of version 5 in the URL namespace."""
    import uuid

    return names.map(lambda n: None if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, n)))


@F.pandas_udf(T.StringType())
def claim_hash(texts: pd.Series) -> pd.Series:
    """24 hexadecimal digits over the claim: NFKC, lower case, single spaces, then no punctuation."""
    import hashlib
    import re
    import unicodedata

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        spaced = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).lower().strip())
        return hashlib.sha256(re.sub(r"[^\w\s]", "", spaced).encode()).hexdigest()[:24]

    return texts.map(one)
