"""Operator 6: benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are maximal runs of ASCII digits, letters (lower-cased) and non-ASCII characters.
The patterns are all windows of ``window`` consecutive words of the benchmark items; an
item of fewer words is one pattern. For patterns of one length m, a block of words is
looked up in a shift table that tells how far the scan may move on; only where the shift
is zero the hash buckets of the block give patterns to compare, told apart by their first
block, and a direct comparison confirms an occurrence.

The tables are arrays (some 60 bytes for a pattern): words and blocks as 64-bit hashes, the shift
table by the last bits of a block's hash, buckets as a sorted column of (last, first) block hashes,
pattern texts as offsets into the items' words. Each Python worker builds them once.

The patterns of a block of items have a checked size (``pattern_bytes`` of text). A larger
benchmark is cut into several blocks. Each block has its own pass over the documents, which
writes only the documents with hits; these are joined to the documents at the end.

Nulls and odd rows: a null or empty text has no words and no hits; a null item text gives
no pattern; items with a null id are left out; a repeated item_id counts once per document;
repeated documents each get their row; extra columns are ignored; empty tables work.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, mix64

#: Lower-cases A-Z, keeps 0-9, a-z and all bytes of non-ASCII characters, and turns the rest into spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_HITS = pa.list_(pa.int32())
_ITEMS = pa.list_(pa.string())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15


class _Hashes(dict):
    """64-bit word hashes, kept in a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class WuManber:
    """Patterns of one length m over all items' words. starts: where the patterns begin; item: whose they are."""

    def __init__(self, m: int, words: list[bytes], hashes: np.ndarray, starts: np.ndarray, item: np.ndarray, ids: list[str]):
        self.m, self.block, self.words, self.ids = m, min(2, m), words, ids
        pair = hashes.copy()
        if self.block == 2:
            pair[:-1] = hashes[:-1] * np.uint64(_ODD) + hashes[1:]
        bits = min(26, max(12, int(len(starts) * m).bit_length() + 2))
        self.low = (1 << bits) - 1
        self.default = m - self.block + 1
        shift = np.full(1 << bits, min(self.default, 255), np.uint8)
        for step in range(min(self.default, 255) - 1, -1, -1):  # the smallest shift of a block is written last
            shift[(pair[starts + (m - self.block - step)] & np.uint64(self.low)).astype(np.int64)] = step
        self.shift = shift.tobytes()
        keys = mix64(pair[starts + (m - self.block)]) + pair[starts]
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.item = keys[order], starts[order], item[order]

    def search(self, words: list[bytes], hashes: _Hashes, spans: list[tuple[int, int]], items: set[str]) -> None:
        m, shift, low, b = self.m, self.shift, self.low, self.block
        at, n = m - 1, len(words)
        while at < n:
            last = hashes[words[at]]
            if b == 2:
                last = (hashes[words[at - 1]] * _ODD + last) & _MASK
            step = shift[last & low]
            if step:
                at += step
                continue
            self._compare(words, at - m + 1, last, hashes, spans, items)
            at += 1

    def _compare(self, words: list[bytes], start: int, last: int, hashes: _Hashes, spans: list[tuple[int, int]], items: set[str]) -> None:
        end = start + self.m
        first = hashes[words[start]]
        if self.block == 2:
            first = (first * _ODD + hashes[words[start + 1]]) & _MASK
        key = np.uint64((int(mix64(np.array([last], np.uint64))[0]) + first) & _MASK)
        at = bisect_left(self.keys, key)
        if at == len(self.keys) or self.keys[at] != key:
            return
        mine = words[start:end]
        hit = False
        while at < len(self.keys) and self.keys[at] == key:
            s = self.starts[at]
            if self.words[s : s + self.m] == mine:
                hit = True
                items.add(self.ids[self.item[at]])
            at += 1
        if hit:
            spans.append((start, end))


def windows_of(items: list[tuple[str, str | None]], window: int) -> list[WuManber]:
    """The search tables of these (item_id, text), one for each pattern length."""
    hashes, same = _Hashes(), {}
    words: list[bytes] = []
    ids, sizes, firsts = [], [], []
    for item_id, text in items:
        own = words_of(text)
        ids.append(item_id), sizes.append(len(own)), firsts.append(len(words))
        words += [same.setdefault(w, w) for w in own]
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    sizes, firsts = np.array(sizes, np.int64), np.array(firsts, np.int64)
    tables = []
    for m in sorted({min(window, n) for n in sizes.tolist()} - {0}):
        mine = np.flatnonzero(sizes >= m if m == window else sizes == m)
        counts = sizes[mine] - m + 1
        item = np.repeat(mine, counts)
        starts = np.repeat(firsts[mine], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        tables.append(WuManber(m, words, h, starts, item, ids))
    return tables


_TABLES: dict[str, list[WuManber]] = {}


def _tables_of(token: str, items: list[tuple[str, str | None]], window: int) -> list[WuManber]:
    """The search tables of one benchmark block, built once in each Python worker (and only one block's kept)."""
    if token not in _TABLES:
        _TABLES.clear()
        _TABLES[token] = windows_of(items, window)
    return _TABLES[token]


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Sorted disjoint spans as a flat list of starts and ends."""
    merged: list[int] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged


def _blocks(benchmark: DataFrame, pattern_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in lists of a bounded size, by hash of the id."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // pattern_bytes) or 1
    for i in range(n):
        part = items if n == 1 else items.where(F.expr(f"pmod(xxhash64(item_id), {n}) = {i}"))
        yield [(r[0], r[1]) for r in part.toLocalIterator()]


def _searched(docs: DataFrame, items: list[tuple[str, str]], window: int) -> DataFrame:
    """docs: row (a struct with text). row, n_words, hit_spans and hit_items for one block of items."""
    shared, token = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, hashes = _tables_of(token, shared.value, window), _Hashes()
        for batch in batches:
            n_words, all_spans, all_items = [], [], []
            for text in batch.column(0).field("text"):
                words = words_of(text.as_py())
                spans: list[tuple[int, int]] = []
                hit: set[str] = set()
                for one in tables:
                    one.search(words, hashes, spans, hit)
                n_words.append(len(words))
                all_spans.append(_merged(spans))
                all_items.append(sorted(hit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(all_spans, _HITS), pa.array(all_items, _ITEMS)], names=[*batch.schema.names, "n_words", "hit_spans", "hit_items"])

    row = docs.schema["row"].dataType.simpleString()
    return docs.mapInArrow(run, f"row {row}, n_words long, hit_spans array<int>, hit_items array<string>")


def _union_of_spans(flat: Column) -> Column:
    """Flat starts and ends of several blocks as sorted disjoint spans."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(flat) / 2 - 1), lambda i: F.struct(flat[(2 * i).cast("int")].alias("s"), flat[(2 * i + 1).cast("int")].alias("e"))))
    start = F.array().cast("array<int>")

    def add(x: Column, p: Column) -> Column:
        last = F.try_element_at(x, F.lit(-1))
        joined = F.concat(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.array(F.greatest(last, p["e"])))
        return F.when((F.size(x) > 0) & (p["s"] <= last), joined).otherwise(F.concat(x, F.array(p["s"], p["e"])))

    return F.aggregate(pairs, start, add)


def find_occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, pattern_bytes: int = 32 << 20) -> DataFrame:
    """row (all columns of docs as a struct, so that no name can clash), n_words, hit_spans (word
    offsets, flat starts and ends of disjoint spans) and hit_items (distinct ids of the items
    with an occurrence)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    blocks = _blocks(benchmark, pattern_bytes)
    first = _searched(rows, next(blocks), window)
    # a text is known by 128 bits of its hash; equal texts have equal hits
    text = F.coalesce("row.text", F.lit(""))
    hits = None
    for items in blocks:
        one = _searched(rows.select(F.struct("row.text").alias("row")), items, window).where(F.size("hit_items") > 0)
        one = materialize(one.select(F.md5(text).alias("h"), "hit_spans", "hit_items").distinct(), "hits")
        hits = one if hits is None else hits.unionByName(one)
    if hits is None:
        return first
    more = materialize(hits.groupBy("h").agg(F.flatten(F.collect_list("hit_spans")).alias("s"), F.flatten(F.collect_list("hit_items")).alias("i")), "hits")
    if more.limit(100_001).count() <= 100_000:
        more = F.broadcast(more)
    both = first.withColumn("h", F.md5(text)).join(more, "h", "left")
    spans = F.when(F.col("s").isNull(), F.col("hit_spans")).otherwise(_union_of_spans(F.concat("hit_spans", "s")))
    return both.select("row", "n_words", spans.alias("hit_spans"), F.array_sort(F.array_distinct(F.concat("hit_items", F.coalesce("i", F.array().cast("array<string>"))))).alias("hit_items"))


def hit_count(spans: str = "hit_spans") -> F.Column:
    """Number of words inside the spans."""
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10, pattern_bytes: int = 32 << 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_occurrences(docs.select("doc_id", "text"), benchmark, window, pattern_bytes)
    return found.select(
        "row.doc_id",
        "n_words",
        hit_count().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, pattern_bytes: int = 32 << 20) -> DataFrame:
    """The documents without any occurrence, with docs' own columns."""
    found = find_occurrences(docs, benchmark, window, pattern_bytes)
    return found.where(F.size("hit_spans") == 0).select("row.*")
