"""Structured Streaming operators: thresholds, suppression, retention and exactly-once sinks."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def retained(signals: DataFrame, id_column: str = "id", ts: str = "ts", age: str = "15 minutes") -> DataFrame:
    """Each id once within the age; later rows than the watermark are dropped."""
    return signals.withWatermark(ts, age).dropDuplicatesWithinWatermark([id_column])


def window_counts(events: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per key and window in event time, final once the watermark has passed."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    counted = events.withWatermark(ts, lateness).groupBy(span, *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def session_clusters(events: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "10 minutes", quiet: str = "15 minutes") -> DataFrame:
    """Clusters that close after a quiet time."""
    counted = events.withWatermark(ts, lateness).groupBy(F.session_window(ts, quiet), *keys).agg(F.count("*").alias("hits"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "hits")


_OUT = "key string, seconds long, kind string, hits int"
_STATE = "recent array<long>, open boolean, hits int, last long, muted_until long"


def threshold_detector(events: DataFrame, key: str, seconds: str, window: int = 86400, least: int = 3, quiet: int = 900, cooldown: int = 900) -> DataFrame:
    """Incident events (key, seconds, kind in ignition, update, close; hits) of a keyed stream
    with event-time seconds. Rows of one key in one batch are taken in the order of time."""

    def step(key_value: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, is_open, hits, last, muted = (list(state.get[0]), *state.get[1:]) if state.exists else ([], False, 0, 0, 0)
        out: list[tuple] = []
        frames = list(batches)
        times = sorted(int(s) for f in frames for s in f[seconds] if s is not None)
        for now in times:
            if is_open and now - last > quiet:
                out.append((str(key_value[0]), last + quiet, "close", hits))
                is_open, hits, recent, muted = False, 0, [], last + quiet + cooldown
            if not is_open and now < muted:
                continue  # hits of the cooldown are not recorded
            if not is_open:  # an open cluster needs no window; a hit exactly a window old counts
                recent.append(now)
                start = bisect.bisect_left(recent, now - window)
                recent = recent[start:] if start else recent
            last = max(last, now)
            if is_open:
                hits += 1
                out.append((str(key_value[0]), now, "update", hits))
            elif len(recent) >= least:
                is_open, hits = True, len(recent)
                out.append((str(key_value[0]), now, "ignition", hits))
        state.update((recent, is_open, hits, last, muted))
        yield pd.DataFrame(out, columns=["key", "seconds", "kind", "hits"])

    keyed = events.select(F.col(key).cast("string").alias("key"), F.col(seconds).cast("long").alias(seconds))
    return keyed.groupBy("key").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def topic_clusters(messages: DataFrame, shard: str, number: str, text: str, channel: str, most: int = 50, across: float = 0.55, within: float = 0.45, n: int = 5) -> DataFrame:
    """Greedy near-duplicate topics per shard, in the order of the numbers: a message joins the
    best of at most ``most`` centroids (n-gram similarity across channels, word similarity within
    one), whose shingles grow with it; else it founds one and the least recently used goes.
    Order-dependent, so a shard is one key; shards run in parallel. Out: number, topic."""
    schema = "shard string, number long, topic long"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        centroids = json.loads(state.get[0]) if state.exists else []
        rows = sorted((int(r[0]), r[1] or "", r[2]) for f in batches for r in zip(f[number], f[text], f[channel], strict=True))
        out = []
        for num, body, chan in rows:
            words = body.lower().split()
            grams = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or ({" ".join(words)} if words else set())
            best, score = None, 0.0
            for c in centroids:
                same = c["channel"] == chan
                s = jaccard(set(words), set(c["words"])) if same else jaccard(grams, set(c["grams"]))
                if s >= (within if same else across) and s > score:
                    best, score = c, s
            if best is None:
                best = {"topic": num, "channel": chan, "grams": [], "words": []}
                centroids.append(best)
            best["grams"], best["words"] = sorted(set(best["grams"]) | grams), sorted(set(best["words"]) | set(words))
            centroids.remove(best)
            centroids.append(best)
            centroids = centroids[-most:]
            out.append((str(key[0]), num, best["topic"]))
        state.update((json.dumps(centroids),))
        yield pd.DataFrame(out, columns=["shard", "number", "topic"])

    keyed = messages.select(F.col(shard).cast("string").alias("shard"), number, text, channel)
    return keyed.groupBy("shard").applyInPandasWithState(run, schema, "centroids string", "append", GroupStateTimeout.NoTimeout)


def write_idempotent(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """A sink whose batches can be replayed: each batch overwrites its own partition."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
