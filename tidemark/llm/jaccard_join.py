"""Operator 8: n-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles. Two documents link when their sets'
Jaccard similarity reaches a threshold (per cent, compared in whole numbers).

1. Documents with one and the same set are a class; the smallest doc_id stands for it.
2. Shingles (as 64-bit hashes) have one global order, rare ones first: by the summed logarithms of their
   words' counts in all documents (a count sketch of a fixed size), then by hash. Two sets
   that link share a shingle among the first ``n - ceil(t n) + 1`` of each.
3. Classes with identical prefixes and size collapse into one group. Groups that share a
   prefix shingle and whose sizes allow a link are candidates.
4. Groups are expanded to their members, and a filter that can lose no link (sizes,
   the Hamming distance of 512-bit parity sketches, and for large sets the number of shared
   tokens in longer prefixes) thins the pairs.
5. Members are verified with their full sets, in rounds. In the first each member meets only its
   most promising partner; what that links falls into components. Where many candidate pairs still
   lie across components, further rounds let each member meet its most promising partners and
   hub (a token's most copied member) of other components. The last round verifies every
   candidate pair that still lies across two components. So thousands of near copies do not
   meet all against all, and no link between components is lost.
6. The members of a token that more than ``_SPLIT`` members share are dealt to cells by hashes of
   their ids: in a round a cell holds some of them and the token's hub, and for the last round the
   members outside the token's biggest component meet all of them cell by cell. A cell is bounded.

Nulls and odd rows: null and empty texts have no shingles and link with nothing; repeated
rows are one class; rows with a null doc_id link with nothing unless their class has an id;
classes with the same smallest doc_id count as one; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, materialize, mix64
from .components import components

SKETCH_BITS = 18
_CHUNKS = 64
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_HUBS, _NEIGHBOURS = 16, 4
_SPLIT, _PARTNERS = 4096, 8
_CACHE = 150_000
_PARITY_BITS = 9  # 256 bits let half of the pairs of one template at 0.73 pass, and all of unrelated sets beyond 576 shingles


def words_of(text: str | None) -> list[bytes]:
    """ASCII white space separates; A-Z are lower-cased."""
    return (text or "").encode().lower().split()


class _Hashes(dict):
    """64-bit word hashes, kept in a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the word shingles; of the whole sequence if it is shorter."""
    if len(h) < size:
        x = np.full(1, len(h), np.uint64)
        for v in h:
            x = mix64(x * _C[0] + v)
        return x
    n = len(h) - size + 1
    x = np.zeros(n, np.uint64)
    for i in range(size):
        x = x * _C[1] + h[i : i + n] * _C[i % 3]
    return mix64(x)


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts.as_py(), np.int64)
    yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})


def word_weights(docs: DataFrame) -> np.ndarray:
    """Log counts of all words of all documents in a sketch of 2 ** SKETCH_BITS counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(1 << SKETCH_BITS, np.int64), _Hashes()
        mask, held, n = np.uint64((1 << SKETCH_BITS) - 1), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(hashes.of(words_of(text.as_py())))
                n += len(held[-1])
                if n >= 1_000_000:
                    total += np.bincount((np.concatenate(held) & mask).astype(np.int64), minlength=len(total))
                    held, n = [], 0
        if held:
            total += np.bincount((np.concatenate(held) & mask).astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(_CHUNKS), pa.int32()), "counts": pa.array([x.tobytes() for x in np.split(total, _CHUNKS)], pa.binary())})

    schema = "chunk int, counts binary"
    part = docs.select("text").mapInArrow(count, schema)
    part = part.repartition("chunk", F.spark_partition_id() % 16).mapInArrow(_sum_chunks, schema)
    part = part.repartition("chunk").mapInArrow(_sum_chunks, schema)
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    width = len(total) // _CHUNKS
    for chunk, counts in part.toLocalIterator():
        total[chunk * width : (chunk + 1) * width] = np.frombuffer(counts, np.int64)
    return np.log2(total + 1.0).astype(np.float32)


_SETS = "doc_id long, n long, f1 long, f2 long, gid long, prefix array<long>, sketch binary"


def _shared_tokens(n: int) -> int:
    """Tokens that the prefixes of two linked sets share at least, by the smaller set's size;
    larger sets have longer prefixes and must share more."""
    return max(1, n // 50)


def _fingerprint(x: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def shingle_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per document: set size, 128-bit fingerprint of its set, group id, prefix and parity sketch
    (the last three only where the task meets the set for the first time)."""
    weights = docs.sparkSession.sparkContext.broadcast(word_weights(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, hashes, seen = weights.value, _Hashes(), set()
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if not words:
                    rows.append((doc_id, 0, None, None, None, None, None))
                    continue
                h = hashes.of(words)
                all_shingles = _shingles(h, size)
                x, first = np.unique(all_shingles, return_index=True)
                n = len(x)
                f1, f2 = _fingerprint(x)
                if (f1, f2) in seen:
                    rows.append((doc_id, n, f1, f2, None, None, None))
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add((f1, f2))
                w = log[(h & mask).astype(np.int64)]
                weight = np.sum([w[i : i + len(all_shingles)] for i in range(size)], axis=0)[first] if len(h) >= size else np.zeros(1)
                p = n - (percent * n + 99) // 100 + _shared_tokens(n)
                prefix = x[np.lexsort((x, weight))[:p]].view(np.int64)
                bits = np.packbits((np.bincount((x >> np.uint64(64 - _PARITY_BITS)).astype(np.int64), minlength=1 << _PARITY_BITS) & 1).astype(np.uint8)).tobytes()
                rows.append((doc_id, n, f1, f2, _fingerprint(np.append(prefix, n))[0], prefix, bits))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n", "f1", "f2", "gid", "prefix", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SETS)


def _edges(token: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Where a new cell begins."""
    return np.flatnonzero((token[1:] != token[:-1]) | (slot[1:] != slot[:-1])) + 1


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells (token, slot) from batches sorted by these."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held is not None else table
        cut = _edges(held.column("token").to_numpy(), held.column("slot").to_numpy())
        if len(cut):
            yield held.slice(0, cut[-1])
            held = held.slice(cut[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _distance(g: dict, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Hamming distances of the sketches of rows i and j; -1 where they cannot link or need not."""
    ni, nj = g["n"][i], g["n"][j]
    least = -(-percent * (ni + nj) // (100 + percent))
    d = np.bitwise_count(g["sketch"][i] ^ g["sketch"][j]).sum(axis=-1).astype(np.int64)
    fits = (100 * np.minimum(ni, nj) >= percent * np.maximum(ni, nj)) & (d <= ni + nj - 2 * least) & (g["comp"][i] != g["comp"][j]) & (g["id"][i] != g["id"][j])
    return np.where(fits, d, -1)


_PAIRS = "a long, b long, d long, n long, w long, hub boolean"
_COLUMNS = ["token", "slot", "w", "n", "id", "copies", "comp", "main", "role", "sketch"]


def _hot_tokens(members: DataFrame, split: int) -> DataFrame:
    """token and rows of the tokens that more than ``split`` members share."""
    return materialize(members.groupBy("token").agg(F.count("*").alias("rows")).where(F.col("rows") > split), "hot")


def _small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _dealt(members: DataFrame, hot: DataFrame, every: bool, split: int) -> DataFrame:
    """members with their cell (token, slot), the token's biggest component (main; -1 if it is not
    hot) and their role: 1 for those that meet the others in a cell of a hot token, else 0."""
    slots = F.ceil(F.col("rows") / split).cast("int")
    slot = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    none = F.lit(-1).cast("long")
    cold = members.join(_small(hot.select("token")), "token", "left_anti").select("*", F.lit(0).alias("slot"), none.alias("main"), F.lit(0).alias("role"))
    if hot.isEmpty():
        return cold.select(*_COLUMNS)
    many = members.join(_small(hot), "token")
    if not every:
        own = many.select("*", slot(slots, 0).alias("slot"))
        row = F.struct("w", "n", "id", "copies", "comp", "sketch")
        hubs = many.groupBy("token").agg(F.max_by(row, F.struct("copies", -F.col("id"))).alias("hub"), F.max("rows").alias("rows")).select("token", "hub.*", each(slots).alias("slot"))
        dealt = own.drop("rows").unionByName(hubs).select("*", none.alias("main"), F.lit(0).alias("role"))
    else:
        comps = many.groupBy("token", "comp").agg(F.count("*").alias("n"))
        main = comps.groupBy("token").agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.max_by("comp", F.struct("n", -F.col("comp"))).alias("main")).where("most < rows")
        main = materialize(main.select("token", "rows", "main", F.ceil((F.col("rows") - F.col("most")) / split).cast("int").alias("parts")), "mains")
        mixed = members.join(_small(main), "token")
        built = mixed.select("*", slot(slots, 0).alias("s"), each(F.col("parts")).alias("p"), F.lit(0).alias("role"))
        probes = mixed.where("comp <> main").select("*", each(slots).alias("s"), slot(F.col("parts"), 1).alias("p"), F.lit(1).alias("role"))
        dealt = built.unionByName(probes).withColumn("slot", F.col("s") * F.col("parts") + F.col("p"))
    return cold.select(*_COLUMNS).unionByName(dealt.select(*_COLUMNS))


def _pairs(members: DataFrame, hot: DataFrame, percent: int, every: bool, split: int, partners: int = 1) -> DataFrame:
    """Candidate pairs (a, b) within the tokens of members(token, w, n, id, copies, comp, sketch);
    a shared token counts w.
    every: all pairs across components; else each member's most promising partners (the closest by
    sketch among its neighbours by size and its cells' most copied) and its most promising hub,
    among the most copied of all its cells."""

    def promising(g: dict, edges: np.ndarray) -> Iterator[tuple]:
        rows = np.arange(len(g["id"]))
        size = np.diff(edges)
        cell, first = np.repeat(np.arange(len(size)), size), np.repeat(edges[:-1], size)
        order = np.lexsort((g["id"], -g["copies"], cell))
        others = [rows - k for k in range(1, _NEIGHBOURS + 1)] + [rows + k for k in range(1, _NEIGHBOURS + 1)]
        others += [order[np.minimum(first + k, len(rows) - 1)] for k in range(_HUBS if partners == 1 else 4 * _HUBS) if (size > k).any()]
        found = np.full((partners, len(rows)), 1 << 40)
        at = np.full((partners, len(rows)), -1)
        for k, j in enumerate(others):
            i = rows[(j >= 0) & (j < len(rows))]
            i = i[cell[j[i]] == cell[i]]
            d = _distance(g, i, j[i], percent)
            i, d = i[d >= 0], d[d >= 0]
            if k == 2 * _NEIGHBOURS and partners > 1:
                yield j[i], i, d, True
            now_d, now_j = d, j[i]
            for slot in range(partners):  # the closest stay, each pushing the next one down
                better = now_d < found[slot, i]
                old_d, old_j = found[slot, i], at[slot, i]
                found[slot, i], at[slot, i] = np.where(better, now_d, old_d), np.where(better, now_j, old_j)
                now_d, now_j = np.where(better, old_d, now_d), np.where(better, old_j, now_j)
        for slot in range(partners):
            i = rows[at[slot] >= 0]
            yield at[slot, i], i, found[slot, i], False

    def across(g: dict, edges: np.ndarray) -> Iterator[tuple]:
        starts = edges[:-1]
        size = np.diff(edges)
        mixed = (np.minimum.reduceat(g["comp"], starts) != np.maximum.reduceat(g["comp"], starts)) | (g["main"][starts] >= 0)
        few = mixed & (size <= _NEIGHBOURS + 1) & (g["main"][starts] < 0)
        cell, small = np.repeat(np.arange(len(size)), size), np.repeat(few, size)
        rows = np.arange(len(g["id"]))
        for k in range(1, _NEIGHBOURS + 1):
            i = rows[k:][(cell[k:] == cell[:-k]) & small[k:]]
            d = _distance(g, i, i - k, percent)
            yield i[d >= 0] - k, i[d >= 0], d[d >= 0], False
        for c in np.flatnonzero(mixed & ~few):
            own = rows[edges[c] : edges[c + 1]]
            own = own[np.argsort(g["n"][own], kind="stable")]
            main = g["main"][own[0]]
            if main < 0:
                comps, counts = np.unique(g["comp"][own], return_counts=True)
                outside = g["comp"][own] != comps[np.argmax(counts)]
                probes, built, built_outside = own[outside], own, outside
            else:
                probes, built = own[g["role"][own] == 1], own[g["role"][own] == 0]
                built_outside = g["comp"][built] != main
            n, ids = g["n"][built], g["id"][built]
            low, high = np.searchsorted(n, -(-g["n"][probes] * percent // 100)), np.searchsorted(n, g["n"][probes] * 100 // percent, side="right")
            for i, a, b in zip(probes, low, high, strict=True):
                # two members outside meet once, from the smaller id
                others = built[a:b][~built_outside[a:b] | (ids[a:b] > g["id"][i])]
                d = _distance(g, np.full(len(others), i), others, percent)
                yield np.full((d >= 0).sum(), i), others[d >= 0], d[d >= 0], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            g = {c: table.column(c).to_numpy() for c in _COLUMNS[:-1]}
            g["sketch"] = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, (1 << _PARITY_BITS) // 64)
            edges = np.concatenate([[0], _edges(g["token"], g["slot"]), [table.num_rows]])
            held, rows = [], 0
            for i, j, d, hub in (across if every else promising)(g, edges):
                a, b = g["id"][i], g["id"][j]
                if every:
                    a, b = np.minimum(a, b), np.maximum(a, b)
                held.append((a, b, d, np.minimum(g["n"][i], g["n"][j]), g["w"][i], np.full(len(a), hub)))
                rows += len(a)
                if rows >= 10_000:
                    yield batch_of(held)
                    held, rows = [], 0
            if rows:
                yield batch_of(held)

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:-1]] + [pa.array(cols[-1], pa.bool_())], names=["a", "b", "d", "n", "w", "hub"])

    pairs = _dealt(members, hot, every, split).repartition("token", "slot").sortWithinPartitions("token", "slot", "n", "id").mapInArrow(run, _PAIRS)
    pairs = pairs.groupBy("a", "b", "hub").agg(F.sum("w").alias("tokens"), F.min("d").alias("d"), F.min("n").alias("n"))
    if every:
        return pairs.where("tokens >= greatest(1, n div 50)").select("a", "b")
    one = F.struct((-F.col("tokens")).alias("t"), "d", "a") if partners == 1 else F.struct("d", (-F.col("tokens")).alias("t"), "a")
    best = pairs.groupBy("b", "hub").agg(F.slice(F.array_sort(F.collect_list(one)), 1, F.when(F.col("hub"), 1).otherwise(partners)).alias("m"))
    return best.select(F.explode("m.a").alias("a"), "b").distinct()


def filter_by_ids(docs: DataFrame, ids: DataFrame, how: str, broadcast_ids: int = 500_000) -> DataFrame:
    """docs semi- or anti-joined with ids(doc_id): a broadcast if the ids are few, else a shuffle."""
    ids = ids.distinct()
    few = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", how)


def verify(docs: DataFrame, pairs: DataFrame, size: int, percent: int, per_hub: int = 256, broadcast_pairs: int = 500_000) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. The partners of one
    document are dealt to several tasks by salts, each of which gets its text once."""
    pairs = materialize(pairs.select("a", "b"), "pairs")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_hub).cast("int").alias("salts"))
    salted = pairs.join(hubs, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    if pairs.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        salted, hubs = F.broadcast(salted), F.broadcast(hubs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = texts.join(salted, F.col("doc_id") == F.col("b")).select("a", "salt", "b", "text")
    own = texts.join(hubs, F.col("doc_id") == F.col("a"))
    own = own.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key, hub_sets = _Hashes(), None, []
        for batch in batches:
            a_out, b_out = [], []
            for a, salt, b, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.unique(_shingles(hashes.of(words_of(text)), size))
                if (a, salt) != key:
                    key, hub_sets = (a, salt), []
                if b is None:
                    hub_sets.append(x)
                    continue
                for y in hub_sets:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        a_out.append(a), b_out.append(b)
                        break
            yield pa.RecordBatch.from_pydict({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    dealt = members.unionByName(own).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def _work_left(labelled: DataFrame) -> int:
    """How many meetings of members the last round would have at most: within each token, of those
    outside its biggest component with all."""
    comps = labelled.groupBy("token", "comp").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
    return comps.where("rows > most").agg(F.coalesce(F.sum((F.col("rows") - F.col("most")) * F.col("rows").cast("double")), F.lit(0.0))).first()[0]


def jaccard_components(docs: DataFrame, size: int = 3, percent: int = 90, split: int = _SPLIT, rounds_until: int = 4) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_shingles, component_id. More rounds of promising
    pairs are made while the last round would have more than ``rounds_until`` pairs a document and
    its meetings become fewer; no parameter but size and percent changes the result."""
    return _labelled(docs, size, percent, split, rounds_until).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, size: int, percent: int, split: int = _SPLIT, rounds_until: int = 4) -> DataFrame:
    """jaccard_components with a hash of each row's set."""
    bounded_batches(docs.sparkSession)
    sets = materialize(shingle_sets(docs, size, percent), "sets")
    classes = (
        sets.where("n > 0")
        .groupBy("f1", "f2")
        .agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("gid").alias("gid"), F.max("sketch").alias("sketch"))
    )
    classes = materialize(classes, "classes")
    usable = classes.where("id is not null")
    # a group that several tasks have met gives its tokens more than once
    tokens = sets.where("prefix is not null").select("gid", "n", F.explode("prefix").alias("token")).repartition("token").groupBy("token", "gid").agg(F.max("n").alias("n"))
    by_size = Window.partitionBy("token").orderBy("n", "gid")
    tokens = tokens.withColumns({"below": F.lag("n").over(by_size), "above": F.lead("n").over(by_size)}).where(f"100 * below >= {percent} * n or 100 * n >= {percent} * above")
    # members of one group share their whole prefix
    within = usable.groupBy("gid").agg(F.count("*").alias("members")).where("members > 1").select("gid", F.col("gid").alias("token"), F.lit(1 << 20).cast("long").alias("w"))
    members = tokens.select("gid", "token", F.lit(1).cast("long").alias("w")).unionByName(within).join(usable.select("gid", "id", "n", "copies", "sketch"), "gid").drop("gid")
    members = materialize(members, "members")

    hot, n_members, n_ids = _hot_tokens(members, split), members.count(), members.select("id").distinct().count()
    links = materialize(verify(docs, _pairs(members.withColumn("comp", F.col("id")), hot, percent, False, split), size, percent), "links")
    left = float("inf")
    while True:
        comps = components(links)
        labelled = members.join(comps.select(F.col("node").alias("id"), F.col("comp").alias("c")), "id", "left").withColumn("comp", F.coalesce("c", "id")).drop("c")
        labelled = materialize(labelled, "labelled")
        before, left = left, _work_left(labelled)
        if left <= 64 * rounds_until * n_members or left > 0.8 * before:
            last = materialize(_pairs(labelled, hot, percent, True, split), "last")
            few = min(rounds_until * n_ids, 2**31 - 2)
            if left > 0.8 * before or last.limit(few + 1).count() <= few:
                break
        more = verify(docs, _pairs(labelled, hot, percent, False, split, _PARTNERS), size, percent)
        links = materialize(links.unionByName(more).distinct(), "links")
    second = verify(docs, last, size, percent)
    comps = components(links.unionByName(second))

    labels = classes.join(comps.select(F.col("node").alias("id"), "comp"), "id", "left").select("f1", "f2", F.coalesce("comp", "id").alias("component"))
    return sets.join(labels, ["f1", "f2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.col("f1").alias("set_hash"))


def deduplicate(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """The documents that stand for their component, with docs' columns: those whose doc_id is
    the component's smallest. Of rows with one doc_id and text the first in the order of all
    columns stays. Rows without shingles or without an id stay. Rows of one doc_id with different
    sets are documents of their own: the join is made anew with all but one of them under a number made of
    id and text, above all usual ids, so that no text goes that exists nowhere else."""
    labels = materialize(_labelled(docs, size, percent).where("n_shingles > 0 and doc_id is not null"), "labels")
    mixed = labels.groupBy("doc_id").agg(F.min("set_hash").alias("__dd_first"), F.max("set_hash").alias("__dd_last")).where("__dd_first <> __dd_last")
    mixed = materialize(mixed.select(F.col("doc_id").alias("__dd_id")), "mixed")
    if mixed.isEmpty():
        return _representatives(docs, labels)
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    own = docs.join(_small(mixed), F.col("doc_id") == F.col("__dd_id"), "left")
    first = materialize(own.where("__dd_id is not null").groupBy(F.col("__dd_id").alias("__dd_key")).agg(F.min(text).alias("__dd_text")), "first-texts")
    made = F.xxhash64("doc_id", text).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    keyed = own.join(_small(first), F.col("__dd_id") == F.col("__dd_key"), "left").withColumn("__dd_own", F.col("doc_id"))
    keyed = keyed.withColumn("doc_id", F.when(F.col("__dd_id").isNull() | (text == F.col("__dd_text")), F.col("doc_id")).otherwise(made))
    keyed = materialize(keyed.drop("__dd_id", "__dd_key", "__dd_text"), "keyed")
    labels = materialize(_labelled(keyed, size, percent).where("n_shingles > 0 and doc_id is not null"), "labels")
    return _representatives(keyed, labels).withColumn("doc_id", F.col("__dd_own")).select(*docs.columns)


def _representatives(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """deduplicate, where a doc_id has one set."""
    kept = filter_by_ids(docs, labels.where("doc_id <> component_id").select("doc_id"), "left_anti").select(*docs.columns)
    repeated = labels.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    repeated = materialize(repeated, "repeated")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = filter_by_ids(kept.where(has_words), repeated, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.where(~has_words).unionByName(filter_by_ids(kept.where(has_words), repeated, "left_anti").select(*docs.columns)).unionByName(once)
