"""Clusters of signals through their life: ignition, updates, promotion, silence, quiet close.

Per key, in event time:

* A signal is recorded; once ``least`` of the last ``window`` seconds are (one exactly a window old counts), the key
  ignites. From then on each signal is a hit of one, the ignition a hit of all recorded ones.
* A hit opens an incident, updates the open one (hits, last time, severity, the newest ids), or is
  absorbed by a promoted one, which only stays alive by it.
* An operator may promote or silence an incident while it is open; other requests change nothing. A silenced
  key forgets its signals and ignores further ones, unrecorded, until the silence ends.
* An incident that had no hit for ``quiet`` seconds closes (an open one) or is dropped (a promoted
  one), at that very second and without a further signal; the key then begins anew, without a pause.
* After a restart keys begin with the incidents that were stored. Their signals are not, so a
  restored incident hears of the next ignition first, as one hit.
* Severity never falls: the greatest of the incident's, the detector's, and the step of the curve
  that the hits have reached.

``Cluster`` is this rule for one key. ``lifecycle_stream`` keeps one per key as state, with event-time
timers for all that happens without a row; rows wait for the watermark, so that they are taken
in the order of time whatever order they come in. ``lifecycle`` folds a finished table by the
same rule: sorted partitions stream through it, and no group is held.

Rows (``SIGNALS``): key, ts, kind (``signal``, ``promote``, ``silence``), id, until (end of a silence; default
``cooldown`` after it). In a second signals come before requests, by id. Rows without key, time or a known
kind are ignored. Out (``EVENTS``): key, incident, seconds, kind (open, update, absorb, promote, silence, close,
drop), hits, severity, ids (of the newest ``KEPT`` signals).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SIGNALS = "key string, ts timestamp, kind string, id string, until long"
EVENTS = "key string, incident string, seconds long, kind string, hits long, severity string, ids array<string>"
KEPT = 50
#: Severities from low to high, the steps of hits by detector, and the mark of incidents made here.
SEVERITIES = ("low", "elevated", "high", "critical")
CURVES = {
    "firms": ((10, "critical"), (0, "high")),
    "severity": ((10, "critical"), (0, "high")),
    "telegram": ((10, "critical"), (5, "high"), (0, "elevated")),
    "gdelt": ((15, "critical"), (10, "high"), (0, "elevated")),
}
OWNED = "auto_promoter:v1"
_KINDS = ("signal", "promote", "silence")
_STATE = "recent array<long>, recent_ids array<string>, ignited boolean, muted long, status string, incident string, hits long, created long, last long, severity string, ids array<string>"
_RESTORED = "key string, incident string, status string, hits long, created long, last long, severity string"


@dataclass(frozen=True)
class Rules:
    """How signals of a detector become incidents; times in seconds."""

    detector: str = "firms"
    least: int = 3
    window: int = 86_400
    quiet: int = 900
    cooldown: int = 3_600
    severity: str = "high"

    def step(self, hits: int) -> str:
        return next((level for least, level in CURVES.get(self.detector, ((0, "low"),)) if hits >= least), "low")


class Cluster:
    """One key's recorded signals, incident and silence. Methods return what happened, as rows of EVENTS without the key."""

    def __init__(self, key: str, rules: Rules, held: tuple | None = None):
        self.key, self.rules = key, rules
        self._begin()
        self.muted: int | None = None
        if held is not None:
            self.recent, self.recent_ids = list(held[0]), list(held[1])
            self.ignited, self.muted, self.status, self.incident, self.hits, self.created, self.last, self.severity = held[2:10]
            self.ids = list(held[10])

    def _begin(self) -> None:
        self.recent, self.recent_ids, self.ignited, self.ids = [], [], False, []
        self.status = self.incident = self.severity = None
        self.hits = self.created = self.last = 0

    def held(self) -> tuple:
        return (self.recent, self.recent_ids, self.ignited, self.muted, self.status, self.incident, self.hits, self.created, self.last, self.severity, self.ids)

    def restore(self, incident: str, status: str, hits: int, created: int, last: int, severity: str) -> None:
        self.incident, self.status, self.hits, self.created, self.last, self.severity = incident, status, hits, created, last, severity

    def due(self) -> int | None:
        """The next second at which something ends by itself; none: nothing is held."""
        ends = [self.last + self.rules.quiet] if self.status else []
        if self.muted is not None:
            ends.append(self.muted)
        if self.recent:
            ends.append(self.recent[-1] + self.rules.window + 1)
        return min(ends, default=None)

    def _event(self, seconds: int, kind: str) -> tuple:
        return (self.incident, seconds, kind, self.hits, self.severity, list(self.ids))

    def advance(self, now: int) -> list[tuple]:
        """All that ends by itself up to now."""
        out = []
        if self.status and now - self.last >= self.rules.quiet:
            out.append(self._event(self.last + self.rules.quiet, "close" if self.status == "open" else "drop"))
            self._begin()
        if self.muted is not None and now >= self.muted:
            self.muted = None
        keep = next((i for i, s in enumerate(self.recent) if s >= now - self.rules.window), len(self.recent))
        if keep:
            self.recent, self.recent_ids = self.recent[keep:], self.recent_ids[keep:]
        return out

    def apply(self, now: int, kind: str, ident: str, until: int | None = None) -> list[tuple]:
        """A signal or an operator's request."""
        out = self.advance(now)
        if kind != "signal":
            if self.status != "open":
                return out
            out.append(self._event(now, kind))
            if kind == "promote":
                self.status = "promoted"
            else:
                self._begin()
                self.muted = now + self.rules.cooldown if until is None else until
            return out
        if self.muted is not None:
            return out
        if self.ignited:
            ids = [ident]
        else:
            self.recent.append(now)
            self.recent_ids.append(ident)
            if len(self.recent) < self.rules.least:
                return out
            ids, self.ignited, self.recent, self.recent_ids = self.recent_ids, True, [], []
        if self.status == "promoted":
            self.last = now
            out.append(self._event(now, "absorb"))
            return out
        opened = self.status is None
        if opened:
            self.status, self.incident, self.created = "open", f"{self.key}@{now}", now
        self.hits += len(ids)
        self.last, self.ids = now, (self.ids + ids)[-KEPT:]
        self.severity = max((s for s in (self.severity, self.rules.severity, self.rules.step(self.hits)) if s), key=SEVERITIES.index)
        out.append(self._event(now, "open" if opened else "update"))
        return out


def rehydrated(incidents: DataFrame) -> DataFrame:
    """Stored incidents (id, status, severity, trigger_s, layer_hints, offsets of their timeline) as restored state by the
    key in their ``cluster:`` hint. Ones without such a hint or the mark of their origin, or that are neither open nor promoted, are
    left out; of several of a key the latest stays."""
    marks = F.filter("layer_hints", lambda h: h.startswith("cluster:"))
    known = incidents.where(F.col("status").isin("open", "promoted") & F.array_contains("layer_hints", OWNED)).withColumn("__mark", F.get(marks, 0)).where("__mark is not null")
    last = F.col("trigger_s") + F.coalesce(F.floor(F.array_max("offsets")), F.lit(0))
    columns = (F.col("id").alias("incident"), "status", F.size("offsets").cast("long").alias("hits"), F.col("trigger_s").cast("long").alias("created"), last.cast("long").alias("last"), "severity")
    state = known.select(F.substring("__mark", 9, 1 << 20).alias("key"), F.struct(*columns).alias("s"))
    return state.groupBy("key").agg(F.max_by("s", F.struct("s.created", "s.incident")).alias("s")).select("key", "s.*")


def _clean(rows: DataFrame, seconds: Column) -> DataFrame:
    kept = rows.where(F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(*_KINDS))
    order = F.when(F.col("kind") == "signal", 0).otherwise(1)
    return kept.select("key", seconds.alias("seconds"), order.alias("turn"), "kind", F.coalesce("id", F.lit("")).alias("id"), F.col("until").cast("long").alias("until"))


def lifecycle(rows: DataFrame, rules: Rules, upto: int | None = None, incidents: DataFrame | None = None) -> DataFrame:
    """The events of a finished table of SIGNALS, with what ends by itself up to the second ``upto``.

    Equal keys meet in one partition and are sorted there; a key is a fold in the order of time, of which only its
    state is held."""
    clean = _clean(rows, F.unix_timestamp(F.col("ts").cast("timestamp")))
    if incidents is not None:
        first = rehydrated(incidents).select("key", F.lit(None).cast("long").alias("seconds"), F.lit(0).alias("turn"), F.lit("restore").alias("kind"), F.lit("").alias("id"), F.lit(None).cast("long").alias("until"), F.struct("incident", "status", "hits", "created", "last", "severity").alias("held"))
        clean = clean.unionByName(first, allowMissingColumns=True)
    else:
        clean = clean.withColumn("held", F.lit(None).cast("struct<incident: string, status: string, hits: long, created: long, last: long, severity: string>"))
    schema = pa.schema([("key", pa.string()), ("incident", pa.string()), ("seconds", pa.int64()), ("kind", pa.string()), ("hits", pa.int64()), ("severity", pa.string()), ("ids", pa.list_(pa.string()))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster: Cluster | None = None
        for batch in batches:
            out: list[tuple] = []
            for key, seconds, kind, ident, until, held in zip(*(batch.column(c).to_pylist() for c in ("key", "seconds", "kind", "id", "until", "held")), strict=True):
                if cluster is None or cluster.key != key:
                    if cluster is not None and upto is not None:
                        out += [(cluster.key, *e) for e in cluster.advance(upto)]
                    cluster = Cluster(key, rules)
                if kind == "restore":
                    cluster.restore(**held)
                else:
                    out += [(key, *e) for e in cluster.apply(seconds, kind, ident, until)]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], f.type) for i, f in enumerate(schema)], schema=schema)
        if cluster is not None and upto is not None:
            out = [(cluster.key, *e) for e in cluster.advance(upto)]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], f.type) for i, f in enumerate(schema)], schema=schema)

    dealt = clean.repartition("key").sortWithinPartitions("key", F.col("seconds").asc_nulls_first(), "turn", "id", "kind")
    return dealt.mapInArrow(fold, EVENTS)


class _Processor(StatefulProcessor):
    """One Cluster per key, rows that wait for the watermark, and a timer for what comes next."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cluster", _STATE)
        self.waiting = handle.getListState("waiting", "seconds long, turn int, id string, kind string, until long")

    def _cluster(self, key: tuple) -> Cluster:
        return Cluster(key[0], self.rules, self.state.get() if self.state.exists() else None)

    def _keep(self, cluster: Cluster, first: int | None) -> None:
        """State is written, or cleared where nothing is held, and the one timer set to what comes next."""
        due = cluster.due()
        if due is None:
            self.state.clear()
        else:
            self.state.update(cluster.held())
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [t for t in (due, first) if t is not None]
        if ends:
            self.handle.registerTimer(min(ends) * 1000)

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        cluster = self._cluster(key)
        for row in initialState.itertuples(index=False):
            cluster.restore(row.incident, row.status, int(row.hits), int(row.created), int(row.last), row.severity)
        self._keep(cluster, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(r.seconds), int(r.turn), r.id, r.kind, None if pd.isna(r.until) else int(r.until)) for frame in rows for r in frame.itertuples(index=False)]
        first = min((w[0] for w in self.waiting.get()), default=None) if self.waiting.exists() else None
        self.waiting.appendList(new)
        self._keep(self._cluster(key), min((w[0] for w in new), default=first) if first is None else min(first, *(w[0] for w in new)))
        yield _frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() // 1000
        cluster, out = self._cluster(key), []
        waiting = sorted(self.waiting.get(), key=lambda w: (w[0], w[1], w[2], w[3])) if self.waiting.exists() else []
        ready = [w for w in waiting if w[0] * 1000 <= timerValues.getCurrentWatermarkInMs()]
        for seconds, _, ident, kind, until in ready:
            out += cluster.apply(seconds, kind, ident, until)
        out += cluster.advance(now)
        rest = waiting[len(ready) :]
        if ready:
            self.waiting.clear()
            if rest:
                self.waiting.put([tuple(w) for w in rest])
        self._keep(cluster, rest[0][0] if rest else None)
        yield _frame(key, out)

    def close(self) -> None:
        pass


def _frame(key: tuple, events: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(key[0], *e) for e in events], columns=["key", "incident", "seconds", "kind", "hits", "severity", "ids"])


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def lifecycle_stream(rows: DataFrame, rules: Rules, lateness: str = "10 minutes", incidents: DataFrame | None = None) -> DataFrame:
    """The events of a stream of SIGNALS. Rows later than the watermark are dropped; ``incidents`` (stored ones, see
    ``rehydrated``) are the state of a new query, and a restart from its checkpoint goes on with its own.

    Named states and timers need the RocksDB store, which is set for the session if another one is."""
    spark = rows.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = rows.withWatermark("ts", lateness)
    order = F.when(F.col("kind") == "signal", 0).otherwise(1)
    kept = timed.where(F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(*_KINDS))
    kept = kept.select("key", "ts", F.unix_timestamp("ts").alias("seconds"), order.alias("turn"), F.coalesce("id", F.lit("")).alias("id"), "kind", F.col("until").cast("long").alias("until"))
    first = None if incidents is None else rehydrated(incidents).groupBy("key")
    return kept.groupBy("key").transformWithStateInPandas(_Processor(rules), EVENTS, "Append", "EventTime", first)
