"""Extraction of events, entities and locations by an injected function, with an outcome per row.

The function gets the text (its first ``CHARS`` characters) and the address of a document and returns JSON text or
a dictionary; it may call a service. What goes wrong with one row marks that row and ends nothing else:

* ``transient`` (to be tried again): time-outs, lost connections, answers that were cut off or cannot be read,
  server errors, and anything else that the function raises;
* ``config`` (trying again cannot help until settings change): the status codes in ``CONFIG_STATUS``.

Only rows with the outcome ``ok`` may be written further on. ``retry_plan`` says when a row is due.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

CHARS, MOST_EVENTS, MOST_ENTITIES = 4000, 5, 20
#: Status codes of requests that are wrong in themselves, severities, entity types, and the type of last resort.
CONFIG_STATUS = (400, 401, 403, 404, 405, 422)
EVENT_SEVERITIES = ("low", "medium", "high", "critical")
EXTRACTED_TYPES = ("person", "organization", "location", "weapon_system", "satellite", "vessel", "aircraft", "military_unit")
UNCLASSIFIED = "other.unclassified"

OUTCOME = """struct<status: string, error: string,
 events: array<struct<title: string, summary: string, codebook_type: string, severity: string, confidence: double, timestamp: string>>,
 entities: array<struct<name: string, type: string, confidence: double>>, locations: array<struct<name: string, country: string>>>"""


class HttpStatus(Exception):
    """An answer with an error status; raised by the injected function."""

    def __init__(self, status: int):
        super().__init__(f"http {status}")
        self.status = status


class Truncated(Exception):
    """The answer hit its limit of length; raised by the injected function."""


def classify(error: BaseException) -> tuple[str, str]:
    """Class and text of an error."""
    if isinstance(error, HttpStatus):
        return ("config" if error.status in CONFIG_STATUS else "transient"), f"http {error.status}"
    if isinstance(error, Truncated):
        return "transient", "truncated"
    if isinstance(error, TimeoutError):
        return "transient", "timeout"
    if isinstance(error, ConnectionError):
        return "transient", "connect"
    if isinstance(error, (ValueError, KeyError, IndexError, TypeError, AttributeError)):
        return "transient", "parse"
    return "transient", f"unexpected: {type(error).__name__}"


def parsed(answer: str | dict, types: frozenset[str]) -> dict:
    """An answer as events, entities and locations; an unknown type of event becomes ``UNCLASSIFIED``. Raises
    where the answer has another shape."""
    found = json.loads(answer) if isinstance(answer, str) else answer
    out: dict[str, list] = {"events": [], "entities": [], "locations": []}
    for e in found.get("events", [])[:MOST_EVENTS]:
        kind = e.get("codebook_type")
        severity = e.get("severity", "low")
        if severity not in EVENT_SEVERITIES:
            raise ValueError("severity")
        out["events"].append({"title": str(e.get("title", "")), "summary": str(e.get("summary", "")), "codebook_type": kind if kind in types else UNCLASSIFIED, "severity": severity, "confidence": float(e.get("confidence", 0.5)), "timestamp": e.get("timestamp") if isinstance(e.get("timestamp"), str) else None})
    for e in found.get("entities", [])[:MOST_ENTITIES]:
        out["entities"].append({"name": str(e["name"]), "type": str(e["type"]), "confidence": None if e.get("confidence") is None else float(e["confidence"])})
    for e in found.get("locations", []):
        out["locations"].append({"name": str(e["name"]), "country": e["country"] if isinstance(e["country"], str) else None})
    return out


def extract(docs: DataFrame, call: Callable[[str, str], str | dict], types: Sequence[str], text: str = "text", url: str = "url", rows_a_batch: int = 200, keep: Sequence[str] | None = None) -> DataFrame:
    """docs with ``outcome``, all their columns or those in ``keep``. ``call`` runs on the executors, once per row; a null text is
    empty. A text that isn't kept goes to them as its first ``CHARS`` characters only.

    Batches are small, so that a lost executor repeats few calls; ``call`` should be idempotent."""
    known = frozenset(types)
    columns = [c for c in keep or docs.columns if c != "outcome"]
    schema = docs.select(*columns).withColumn("outcome", F.lit(None).cast(OUTCOME)).schema
    head = docs.withColumn(text, F.substring(text, 1, CHARS)) if text not in columns else docs
    sent = head.select(*dict.fromkeys([*columns, text, url]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(schema["outcome"].dataType)
        for whole in batches:
            for at in range(0, whole.num_rows, rows_a_batch):
                batch = whole.slice(at, rows_a_batch)
                out = []
                for body, address in zip(batch.column(text).to_pylist(), batch.column(url).to_pylist(), strict=True):
                    try:
                        out.append({"status": "ok", "error": None, **parsed(call((body or "")[:CHARS], address), known)})
                    except Exception as error:  # noqa: BLE001 - the row carries it
                        status, said = classify(error)
                        out.append({"status": status, "error": said, "events": None, "entities": None, "locations": None})
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, kind)], names=[*columns, "outcome"])

    return sent.mapInArrow(run, schema)


def primary_type(outcome: Column) -> Column:
    """The type of the first event."""
    return F.coalesce(F.get(outcome["events"], F.lit(0))["codebook_type"], F.lit(UNCLASSIFIED))


def retry_plan(outcome: Column, attempts: Column, now_s: Column, most: int = 5) -> dict[str, Column]:
    """attempts after this one, state (done, retry, held, failed) and due_s: a transient error waits twice as long
    each time and fails for good at ``most`` attempts; a configuration error is held without a date and costs no attempt."""
    transient = outcome["status"] == "transient"
    tried = attempts + F.when(transient, 1).otherwise(0)
    state = F.when(outcome["status"] == "ok", "done").when(~transient, "held").when(tried >= most, "failed").otherwise("retry")
    return {"attempts": tried, "state": state, "due_s": F.when(state == "retry", now_s + dates.retry_delay(tried))}


def due(rows: DataFrame, now_s: int, config_changed: bool = False) -> DataFrame:
    """The rows of a retry table to be tried now: transient ones whose time has come, and all that are held once settings changed."""
    held = F.lit(config_changed) & (F.col("state") == "held")
    return rows.where(held | ((F.col("state") == "retry") & (F.col("due_s") <= now_s)))
