"""Topics of near-duplicate messages per shard, in the order of event time, with ignition and life of each topic.

A message joins the topic that it is most like, of at most ``most`` in its shard: by words (Jaccard, ``within``) where the
topic is of its own channel, else by shingles of five words (``across``); of equally like ones the older. Else it
founds a topic, and if there are too many the least recently seen one goes. A topic's sets grow with each
message up to ``most_shingles``, the first ones stay, so that a shard's state is bounded. Each topic is a cluster as in
``streaming.lifecycle``: it ignites at ``least`` messages within ``window`` seconds, is updated, closes when it was
quiet, and can be promoted or silenced. A topic that closed is forgotten; a silenced one is too, and messages that found or
join it again until the silence ends are not recorded.

Which topic a message joins depends on all before it, so in a stream a shard is one key; shards run in parallel. A finished table's
shards are cut into blocks, see ``topic_table``. Choose shards so that like messages meet (a language, a region).

Rows (``MESSAGES``): shard, ts, kind (``signal``, ``promote``, ``silence``), id, title (any text; for a request the topic's key),
channel, until. Messages without a word found and join nothing. Out (``TOPICS``): shard, id of the message (null for what
ends by itself), topic, seconds, kind (null: joined without a hit), hits, severity.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..functions.text import stream_title
from ..session import scratch
from . import lifecycle as life

MESSAGES = "shard string, ts timestamp, kind string, id string, title string, channel string, until long"
TOPICS = "shard string, id string, topic string, seconds long, kind string, hits long, severity string"
RULES = life.Rules("telegram", least=3, window=1_800, quiet=900, cooldown=3_600, severity="elevated")
_TOPIC = f"grams array<string>, words array<string>, channel string, seen long, {life._STATE}"


def shingles(words: list[str], n: int = 5) -> set[str]:
    """Distinct runs of n words; fewer words are one run."""
    return {" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def topic_key(grams: set[str]) -> str:
    return "telegram:topic:" + hashlib.sha1("|".join(sorted(grams)).encode(), usedforsecurity=False).hexdigest()[:12]


def _jaccard(a: set[str], b: set[str]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


class Topic:
    """What a topic is recognised by, and its cluster."""

    def __init__(self, key: str, rules: life.Rules, grams: set[str], words: set[str], channel: str, seen: int, held: tuple | None = None):
        self.grams, self.words, self.channel, self.seen = grams, words, channel, seen
        self.cluster = life.Cluster(key, rules, held)

    def widen(self, grams: set[str], words: set[str], most: int) -> None:
        for own, new in ((self.grams, grams), (self.words, words)):
            own |= set(sorted(new - own)[: max(most - len(own), 0)])


class Shard:
    """All topics of a shard, the longest known first, and the ends of silences."""

    def __init__(self, rules: life.Rules, most: int = 50, across: float = 0.55, within: float = 0.45, most_shingles: int = 5_000):
        self.rules, self.most, self.across, self.within, self.most_shingles = rules, most, across, within, most_shingles
        self.topics: dict[str, Topic] = {}
        self.muted: dict[str, int] = {}

    def held(self) -> str:
        """All that later messages depend on; equal texts are equal states."""
        topics = [[k, sorted(t.grams), sorted(t.words), t.channel, t.seen, t.cluster.held()] for k, t in self.topics.items()]
        return json.dumps([topics, sorted(self.muted.items())])

    def restore(self, held: str) -> None:
        topics, muted = json.loads(held)
        self.topics = {k: Topic(k, self.rules, set(grams), set(words), channel, seen, tuple(state)) for k, grams, words, channel, seen, state in topics}
        self.muted = dict(muted)

    def due(self) -> int | None:
        ends = [t.cluster.last + self.rules.quiet for t in self.topics.values() if t.cluster.status]
        return min([*ends, *self.muted.values()], default=None)

    def advance(self, now: int) -> list[tuple]:
        """Topics that close or are dropped up to now, in the order of their ends, are forgotten."""
        out = []
        for key, topic in list(self.topics.items()):
            for _, seconds, kind, hits, severity, _ids in topic.cluster.advance(now):
                out.append((None, key, seconds, kind, hits, severity))
                del self.topics[key]
        self.muted = {k: t for k, t in self.muted.items() if t > now}
        return sorted(out, key=lambda e: (e[2], e[1]))

    def _best(self, grams: set[str], words: set[str], channel: str) -> str | None:
        best, score = None, 0.0
        for key, topic in self.topics.items():
            same = bool(channel) and topic.channel == channel
            like = _jaccard(words, topic.words) if same else _jaccard(grams, topic.grams)
            if like >= (self.within if same else self.across) and like > score:
                best, score = key, like
        return best

    def apply(self, now: int, kind: str, ident: str, title: str, channel: str, until: int | None = None) -> list[tuple]:
        out = self.advance(now)
        if kind != "signal":
            topic = self.topics.get(title)
            for _, seconds, what, hits, severity, _ids in topic.cluster.apply(now, kind, ident, until) if topic else ():
                out.append((ident, title, seconds, what, hits, severity))
                if what == "silence":
                    self.muted[title] = topic.cluster.muted
                    del self.topics[title]
            return out
        words = title.split()
        if not words:
            return out
        grams, own = shingles(words), set(words)
        key = self._best(grams, own, channel)
        if key is None:
            key = topic_key(grams)
            topic = self.topics[key] = Topic(key, self.rules, set(), set(), channel, now)
            if len(self.topics) > self.most:
                del self.topics[min((k for k in self.topics if k != key), key=lambda k: self.topics[k].seen)]
        topic = self.topics[key]
        topic.widen(grams, own, self.most_shingles)
        if key in self.muted:
            return [*out, (ident, key, now, None, topic.cluster.hits, None)]
        topic.seen = now
        events = topic.cluster.apply(now, "signal", ident)
        if not events:
            return [*out, (ident, key, now, None, topic.cluster.hits, None)]
        return [*out, *((ident, key, seconds, what, hits, severity) for _, seconds, what, hits, severity, _ids in events)]


def _clean(rows: DataFrame, seconds: Column) -> list[Column]:
    order = F.when(F.col("kind") == "signal", 0).otherwise(1)
    title = F.when(F.col("kind") == "signal", stream_title(F.coalesce("title", F.lit("")))).otherwise(F.coalesce("title", F.lit("")))
    return [F.col("shard"), seconds.alias("seconds"), order.alias("turn"), F.coalesce("id", F.lit("")).alias("id"), F.col("kind"), title.alias("title"), F.coalesce("channel", F.lit("")).alias("channel"), F.col("until").cast("long").alias("until")]


_KNOWN = "shard is not null and ts is not null and kind in ('signal', 'promote', 'silence')"


_DEALT = "shard string, seconds long, turn int, id string, kind string, title string, channel string, until long, block long, part int, state string"
_FOLDED = f"{TOPICS}, block long, start string, stop string"


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(","))])


def _blocks(rows: DataFrame, blocks: int, lead: int) -> DataFrame:
    """Rows in the order of shard and time, cut into blocks (part 2); the last ``lead`` rows before a block are there too (part 1)."""
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    known = rows.where(_KNOWN)
    keys = _clean(known, seconds)[:4]
    cut = known.repartitionByRange(blocks, *keys).select(*_clean(known, seconds)).sortWithinPartitions("shard", "seconds", "turn", "id", "kind", "title")
    schema = _schema(_DEALT)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last = TaskContext.get().partitionId(), None
        for batch in batches:
            n = batch.num_rows
            more = [pa.array([block] * n, pa.int64()), pa.array([2] * n, pa.int32()), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(schema.field(c).type) for c in schema.names[:8]), *more], schema=schema)
            whole = pa.Table.from_batches([batch])
            last = (whole if last is None else pa.concat_tables([last, whole])).slice(max((last.num_rows if last else 0) + n - lead, 0)).combine_chunks()
        if last is not None:
            tail = [r for r in last.to_pylist() if r["shard"] == last.column("shard")[-1].as_py()]
            yield _arrow([(*(r[c] for c in schema.names[:8]), block + 1, 1, None) for r in tail], schema)

    return cut.mapInArrow(deal, _DEALT)


def topic_table(rows: DataFrame, rules: life.Rules = RULES, upto: int | None = None, rows_a_block: int = 10_000, lead: int = 50, **limits: float) -> DataFrame:
    """The topics of a finished table of MESSAGES, with what ends by itself up to the second ``upto``.

    A shard is cut into blocks by time, which tasks fold at once. A block begins with what its last ``lead`` messages before it leave,
    and is folded anew from the state that the block before it ended in wherever that was another one, until each begins as
    the one before it ended. So neither number changes the result, and a task reads a block whatever the size of a
    shard; topics that live on from block to block cost a round for each."""
    spark = rows.sparkSession
    dealt_at, found_at = scratch(spark, "topic-blocks"), scratch(spark, "topics")
    _blocks(rows, max(-(-rows.count() // rows_a_block), 1), lead).write.parquet(dealt_at)
    dealt = spark.read.schema(_DEALT).parquet(dealt_at)
    folded, topics = _schema(_FOLDED), _schema(TOPICS)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, start = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for key, seconds, _, ident, kind, title, channel, until, block, part, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (key, block):
                    if start is not None:
                        out.append((at[0], *[None] * 6, at[1], start, shard.held()))
                    at, shard, start = (key, block), Shard(rules, **limits), None
                if part == 0:
                    shard.restore(state)
                    continue
                if part == 2 and start is None:
                    start = shard.held()
                events = shard.apply(seconds, kind, ident, title, channel, until)
                if part == 2:
                    out += [(key, *e, block, None, None) for e in events]
            yield _arrow(out, folded)
        if start is not None:
            yield _arrow([(at[0], *[None] * 6, at[1], start, shard.held())], folded)

    def run(messages: DataFrame, turn: int) -> DataFrame:
        """Writes what blocks give; their states."""
        order = ("shard", "block", "part", "seconds", "turn", "id", "kind", "title")
        messages.select(*dealt.columns).repartition("shard", "block").sortWithinPartitions(*order).mapInArrow(fold, _FOLDED).write.parquet(f"{found_at}/run={turn}")
        new = spark.read.schema(_FOLDED).parquet(f"{found_at}/run={turn}")
        return new.where("start is not null").select("shard", "block", F.lit(turn).alias("run"), "start", "stop")

    def kept(states: DataFrame) -> DataFrame:
        path = scratch(spark, "topic-states")
        states.write.parquet(path)
        return spark.read.schema(states.schema).parquet(path)

    turn, states = 0, kept(run(dealt, 0))
    while True:
        before = F.lag("stop").over(Window.partitionBy("shard").orderBy("block"))
        wrong = kept(states.select("shard", "block", "start", before.alias("state")).where("state <> start").select("shard", "block", "state"))
        if wrong.isEmpty():
            break
        turn += 1
        again = dealt.where("part = 2").join(wrong.select("shard", "block"), ["shard", "block"], "left_semi")
        begin = wrong.select("shard", "block", "state", F.lit(0).alias("part"))
        new = run(again.unionByName(begin, allowMissingColumns=True), turn)
        states = kept(states.join(wrong, ["shard", "block"], "left_anti").select(*new.columns).unionByName(new))
    found = spark.read.schema(f"{_FOLDED}, run int").parquet(found_at).where("start is null")
    out = found.join(states.select("shard", "block", "run"), ["shard", "block", "run"]).select(*topics.names)
    if upto is None:
        return out

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest: list[tuple] = []
            for key, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(rules, **limits)
                shard.restore(state)
                rest += [(key, *e) for e in shard.advance(upto)]
            yield _arrow(rest, topics)

    return out.unionByName(states.groupBy("shard").agg(F.max_by("stop", "block").alias("stop")).mapInArrow(end, TOPICS))


class _Processor(StatefulProcessor):
    """A shard's topics as a map of states, of which only those that change are written."""

    def __init__(self, rules: life.Rules, limits: dict):
        self.rules, self.limits = rules, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.topics = handle.getMapState("topics", "topic string", f"place long, {_TOPIC}")
        self.muted = handle.getMapState("muted", "topic string", "until long")
        self.waiting = handle.getListState("waiting", "seconds long, turn int, id string, kind string, title string, channel string, until long")

    def _shard(self) -> Shard:
        shard = Shard(self.rules, **self.limits)
        if self.topics.exists():
            for (key,), v in sorted(self.topics.iterator(), key=lambda kv: kv[1][0]):
                shard.topics[key] = Topic(key, self.rules, set(v[1]), set(v[2]), v[3], v[4], tuple(v[5:]))
        if self.muted.exists():
            shard.muted = {k[0]: v[0] for k, v in self.muted.iterator()}
        return shard

    def _timer(self, shard_due: int | None, first: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ends = [t for t in (shard_due, first) if t is not None]
        if ends:
            self.handle.registerTimer(min(ends) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(r.seconds), int(r.turn), r.id, r.kind, r.title, r.channel, None if pd.isna(r.until) else int(r.until)) for frame in rows for r in frame.itertuples(index=False)]
        held = [w[0] for w in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.appendList(new)
        self._timer(self._shard().due(), min([*held, *(w[0] for w in new)], default=None))
        yield _frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda w: (w[0], w[1], w[2], w[3], w[4])) if self.waiting.exists() else []
        ready = [w for w in waiting if w[0] * 1000 <= now]
        shard, out = self._shard(), []
        before = {k: (t.seen, len(t.grams), len(t.words), t.cluster.held()) for k, t in shard.topics.items()}
        places = {k: i for i, k in enumerate(shard.topics)}
        for seconds, _, ident, kind, title, channel, until in ready:
            out += shard.apply(seconds, kind, ident, title, channel, until)
        out += shard.advance(now // 1000)
        for gone in before.keys() - shard.topics.keys():
            self.topics.removeKey((gone,))
        for place, (k, t) in enumerate(shard.topics.items()):
            if before.get(k) != (t.seen, len(t.grams), len(t.words), t.cluster.held()) or places.get(k) != place:
                self.topics.updateValue((k,), (place, sorted(t.grams), sorted(t.words), t.channel, t.seen, *t.cluster.held()))
        self.muted.clear()
        for k, until in shard.muted.items():
            self.muted.updateValue((k,), (until,))
        if ready:
            self.waiting.clear()
            if rest := waiting[len(ready) :]:
                self.waiting.put([tuple(w) for w in rest])
        self._timer(shard.due(), waiting[len(ready)][0] if len(waiting) > len(ready) else None)
        yield _frame(key, out)

    def close(self) -> None:
        pass


def _frame(key: tuple, out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame([(key[0], *e) for e in out], columns=["shard", "id", "topic", "seconds", "kind", "hits", "severity"])
    return frame.astype({"id": object, "kind": object, "severity": object})


def topic_stream(rows: DataFrame, rules: life.Rules = RULES, lateness: str = "10 minutes", **limits: float) -> DataFrame:
    """The topics of a stream of MESSAGES: what ``topic_table`` gives, whatever the order of arrival within the lateness."""
    spark = rows.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", life.STATE_STORE)
    kept = rows.withWatermark("ts", lateness).where(_KNOWN).select("ts", *_clean(rows, F.unix_timestamp("ts")))
    return kept.groupBy("shard").transformWithStateInPandas(_Processor(rules, limits), TOPICS, "Append", "EventTime")
