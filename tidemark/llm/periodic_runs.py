"""Operator 13: periodic runs of words by suffix trees and Lyndon roots.

A run is a stretch of words with smallest period q, at least max(24, 3 * q) words long, that no
neighbouring word extends. Within a text:

1. Words become numbers. Every window of eight words inside such a run stands elsewhere in the text
   too, so stretches of windows that occur once are left out; no run reaches into them. What is left is
   sections, mostly none.
2. For each section Ukkonen's suffix tree is built, and one of the section reversed. An Euler tour of
   each with tables of range minima gives the longest common extension of two positions, forwards and
   backwards, in constant time.
3. The order of the leaves gives for each position the next smaller and the next greater suffix: the longest
   Lyndon word there for the order of words and for the reversed one. Each run has such a word as its root, so
   each is a candidate with its length as period; extended in both directions it is a run or it isn't.

Texts are independent rows; nothing is shuffled. Memory follows the longest section of a text.

Nulls and odd rows: a null or empty text has no runs and an empty collapsed text; repeated rows each get
theirs; extra columns are carried, see ``find_runs``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import bounded_batches, mix64

LEAST, TIMES, WINDOW, _TABLE_BLOCK = 24, 3, 8, 16


class SuffixTree:
    """Ukkonen's suffix tree of a list of numbers >= 0; -1 is put at its end."""

    def __init__(self, keys: list[int]):
        self.keys = s = [*keys, -1]
        n = len(s)
        start, end, link, below = [0], [0], [0], [{}]  # node 0 is the root; leaves have no dictionary
        node = edge = length = left = 0
        for i in range(n):
            c, left, made = s[i], left + 1, 0
            while left:
                if not length:
                    edge = i
                own = below[node]
                child = own.get(s[edge])
                if child is None:
                    own[s[edge]] = len(start)
                    start.append(i), end.append(n), link.append(0), below.append(None)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    stop = end[child]
                    size = (i + 1 if stop > i else stop) - start[child]
                    if length >= size:
                        edge, length, node = edge + size, length - size, child
                        continue
                    at = start[child] + length
                    if s[at] == c:
                        length += 1
                        if made and node:
                            link[made] = node
                        break
                    mid = len(start)
                    start.append(start[child]), end.append(at), link.append(0), below.append({s[at]: child, c: mid + 1})
                    own[s[edge]] = mid
                    start.append(i), end.append(n), link.append(0), below.append(None)
                    start[child] = at
                    if made:
                        link[made] = mid
                    made = mid
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length, edge = length - 1, i - left + 1
        self.start, self.end, self.below = start, end, below


class Extensions:
    """Longest common prefixes of two suffixes: Euler tour of the tree, and minima of depths over it."""

    def __init__(self, keys: list[int], ordered: bool):
        tree = SuffixTree(keys)
        start, end, below, n = tree.start, tree.end, tree.below, len(tree.keys)
        tour: list[int] = []
        first, leaves = [0] * n, []
        # each entry is a visit to a node of that depth; children follow, with a visit between each two
        stack: list[tuple[int, Iterator[int]]] = [(0, iter([below[0][k] for k in sorted(below[0])] if ordered else below[0].values()))]
        tour.append(0)
        while stack:
            depth, children = stack[-1]
            child = next(children, None)
            if child is None:
                stack.pop()
                if stack:
                    tour.append(stack[-1][0])
                continue
            own = below[child]
            reach = depth + end[child] - start[child]
            if own is None:
                first[n - reach] = len(tour)
                leaves.append(n - reach)
                tour.append(reach)
                tour.append(depth)
            else:
                tour.append(reach)
                stack.append((reach, iter([own[k] for k in sorted(own)] if ordered else own.values())))
        self.leaves, self.first = leaves, np.array(first, np.int64)
        self._index(np.array(tour, np.int32))

    def _index(self, tour: np.ndarray) -> None:
        """Minima from each entry to the ends of its block, and of 2^k blocks one after another."""
        size = _TABLE_BLOCK
        grid = np.full(-(-len(tour) // size) * size, np.iinfo(np.int32).max, np.int32)
        grid[: len(tour)] = tour
        grid = grid.reshape(-1, size)
        self.tour = grid.ravel()
        self.from_start = np.minimum.accumulate(grid, axis=1).ravel()
        self.to_end = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while len(self.levels[-1]) > (step := 1 << (len(self.levels) - 1)):
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-step], below[step:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at a and at b, where a and b differ."""
        x, y = self.first[a], self.first[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        p, q = x // _TABLE_BLOCK, y // _TABLE_BLOCK
        found = np.minimum(self.to_end[x], self.from_start[y])
        far = np.flatnonzero(q > p + 1)
        gap = q[far] - p[far] - 1
        level = np.frexp(gap.astype(np.float64))[1] - 1
        for k in range(int(level.max()) + 1 if len(far) else 0):
            own = far[level == k]
            found[own] = np.minimum(found[own], np.minimum(self.levels[k][p[own] + 1], self.levels[k][q[own] - (1 << k)]))
        near = np.flatnonzero(p == q)
        if len(near):
            least = self.tour[x[near]]
            for d in range(1, _TABLE_BLOCK):
                at = np.minimum(x[near] + d, y[near])
                least = np.minimum(least, self.tour[at])
            found[near] = least
        return found


def _next_beyond(rank: list[int]) -> list[int]:
    """For each position the next one of smaller rank, or the list's length."""
    n = len(rank)
    found, stack = [n] * n, []
    for i in range(n):
        r = rank[i]
        while stack and rank[stack[-1]] > r:
            found[stack.pop()] = i
        stack.append(i)
    return found


def section_runs(keys: list[int], least: int = LEAST, times: int = TIMES) -> set[tuple[int, int, int]]:
    """All runs of a section as (start, length, period), with length >= max(least, times * period)."""
    n = len(keys)
    forward = Extensions(keys, True)
    rank = [0] * (n + 1)
    for r, i in enumerate(forward.leaves):
        rank[i] = r
    smaller, greater = _next_beyond(rank), _next_beyond([-r for r in rank])
    i = np.concatenate((np.arange(n), np.arange(n)))
    j = np.array(smaller[:n] + greater[:n], np.int64)
    i, j = i[j < n], j[j < n]
    period = j - i
    # a candidate whose period leaves too little text for it cannot be a run
    stays = np.maximum(least, times * period) <= n
    i, j, period = i[stays], j[stays], period[stays]
    stop = j + forward.common(i, j)
    del forward
    backward = Extensions(keys[::-1], False)
    # the suffix of the reversed section at n - i ends before i
    start = i - np.where(i > 0, backward.common(np.minimum(n - i, n), np.minimum(n - j, n)), 0)
    length = stop - start
    hit = length >= np.maximum(least, times * period)
    return set(zip(start[hit].tolist(), length[hit].tolist(), period[hit].tolist(), strict=True))


def sections(keys: np.ndarray, least: int = LEAST, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` words whose windows all occur again somewhere in the text."""
    n = len(keys)
    if n < least:
        return []
    mixed = mix64(keys.astype(np.uint64) + np.uint64(1))
    sums = np.zeros(n - window + 1, np.uint64)
    for d in range(window):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + mixed[d : n - window + 1 + d]
    order = np.argsort(sums)
    same = sums[order[1:]] == sums[order[:-1]]
    again = np.zeros(len(sums) + 2, bool)
    again[order[1:][same] + 1] = again[order[:-1][same] + 1] = True
    edges = np.flatnonzero(again[1:] != again[:-1])
    return [(a, b + window - 1) for a, b in edges.reshape(-1, 2).tolist() if b + window - 1 - a >= least]


def runs_of(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, by start and period.

    ``sections`` leaves no run out while least >= 3 * WINDOW and times >= 3.
    """
    if len(words) < least:
        return []
    number: dict = {}
    keys = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = []
    for a, b in sections(keys, least):
        found += [(s + a, n, p) for s, n, p in section_runs(keys[a:b].tolist(), least, times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [w for w, held in zip(words, np.cumsum(edge).tolist(), strict=False) if not held]


_RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def find_runs(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, with ``runs`` (by start and period) and ``collapsed`` (the kept words), which replace
    columns of these names."""
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("text", "runs", "collapsed")]
    schema = docs.select(*rest).schema.add("runs", ArrayType(_RUN)).add("collapsed", "string")
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, kept = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                found = runs_of(words)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                kept.append(b" ".join(collapse(words, found)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=[*rest, "runs", "collapsed"])

    return docs.mapInArrow(run, schema)


def longest_exponent(runs: Column) -> Column:
    """The run with the greatest length / period, exactly; ties to the smallest start, then period."""
    wins = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | ((x["length"] * y["period"] == y["length"] * x["period"]) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
    return F.aggregate(runs, F.lit(None).cast(_RUN), lambda best, x: F.when(best.isNull() | wins(x, best), x).otherwise(best))


def planted(doc_id: Column, text: Column) -> Column:
    """The text in which some documents get a periodic tail: with h = crc32 of the id and g = h // 10, where h is
    divisible by 10 the words from a = g % n on repeat the next p = 1 + (n - a) // (3 + g % 8) ones."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(w, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))), " ")).otherwise("")

    return F.when((h % 10 == 0) & text.isNotNull(), F.transform(F.array(words), repeat)[0]).otherwise(text)


def run_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_runs, its run of greatest exponent (start, length, period, exponent_milli), and digests of all
    runs and of the collapsed text. The documents get the periodic tails of ``planted``; one without an id stays as it is."""
    found = find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest_exponent(F.col("runs")).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("best.length * 1000 div best.period")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
