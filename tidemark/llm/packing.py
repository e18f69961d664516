"""Operator 2: packing documents into token windows by multiway differencing.

A document's ids are those of a byte-level BPE tokenizer, then one separator id. Windows
hold at most ``window`` ids. Whole windows are cut off a document first; what remains of
each document (its tail) goes to a pool, and the pool is partitioned by the differencing
method of Karmarkar and Karp: the two partial partitions with the greatest imbalance are
merged with the largest load of one upon the smallest of the other, until one partition
with near-equal loads is left. If a load exceeds the window, the number of windows rises.
About every twelfth tail is held back from the partition and cut into the gaps that it
leaves, so that windows come out full; what is left over joins the next pool.

Everything happens inside the task that reads the documents: no shuffle, and the pool is
bounded. The last ids of a task are cut into lengths that are powers of two.

Nulls and odd rows: a null or empty text is the separator alone; repeated rows are packed
as often as they occur; a null doc_id is kept as null; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import bounded_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
_ARROW = pa.schema([(c, pa.int64()) for c in _COLUMNS])


class TextEncoder:
    """Ids of whole texts as little-endian uint32 bytes.

    Texts of plain Latin characters are encoded from the same vocabulary as merge ranks, which
    is faster and gives the same ids. The pre-tokenizer never joins a space to a character
    before it that isn't white space, so any other text is cut before such spaces, and only
    the runs of pieces that aren't plain go through the tokenizer itself.
    """

    PLAIN = re.compile(r"[\n\x20-\x7eÀ-ÖØ-öø-ÿ]*")

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.fast = None
        if ranks_path and pattern:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bool:
        return self.fast is not None and "<|" not in text and self.PLAIN.fullmatch(text) is not None

    def _encode(self, text: str, plain: bool) -> bytes:
        if plain:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self._plain(text):
            return self._encode(text, True)
        first, *rest = re.split(r"(?<=\S) ", text)
        runs = itertools.groupby([first, *(" " + x for x in rest)], self._plain)
        return b"".join(self._encode("".join(run), plain) for plain, run in runs)


@functools.cache
def encoder_of(tokenizer_path: str, ranks_path: str | None, pattern: str | None) -> TextEncoder:
    """One encoder for each Python worker: the tasks that it runs share its tables and cache."""
    return TextEncoder(tokenizer_path, ranks_path, pattern)


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """Partition lengths into k groups by multiway differencing; the groups' indices.

    A partial partition is its non-zero loads in falling order (missing ones are zero).
    """
    if k < 1:
        return []
    heap = [(-n, i, [(n, (i,))]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = len(a) + len(b) - k
        if over <= 0:
            loads = a + b
        else:  # b's smallest loads meet a's smallest, in opposite order
            at = len(a) - over
            met = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[at:], reversed(b[len(b) - over :]), strict=True)]
            loads = a[:at] + met + b[: len(b) - over]
        loads.sort(key=lambda x: -x[0])
        least = loads[-1][0] if len(loads) == k else 0
        heapq.heappush(heap, (least - loads[0][0], order, loads))
        order += 1
    groups = []
    for _, node in heap[0][2] if heap else []:
        members, stack = [], [node]
        while stack:
            for x in stack.pop():
                members.append(x) if isinstance(x, int) else stack.append(x)
        groups.append(members)
    return groups + [[] for _ in range(k - len(groups))]


class Packer:
    """Packs a stream of encoded documents; ``out`` gathers one list per output column."""

    def __init__(self, window: int, pool_size: int, first_sequence: int):
        self.window, self.pool_size, self.sequence = window, pool_size, first_sequence
        self.pool: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.out: list[list] = [[] for _ in _COLUMNS]

    def _emit(self, pieces: Iterable[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            for column, value in zip(self.out, (doc_id, start, n, zlib.crc32(ids), doc_tokens, self.sequence, offset), strict=True):
                column.append(value)
            offset += n
        self.sequence += 1

    @staticmethod
    def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        doc_id, start, ids, total = piece
        return (doc_id, start, ids[: 4 * n], total), (doc_id, start + n, ids[4 * n :], total)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        size, total = 4 * self.window, len(ids) // 4
        whole = len(ids) // size
        for i in range(whole):
            self._emit([(doc_id, i * self.window, ids[i * size : (i + 1) * size], total)])
        if len(ids) > whole * size:
            self.pool.append((doc_id, whole * self.window, ids[whole * size :], total))
            if len(self.pool) >= self.pool_size:
                self.flush()

    def flush(self) -> None:
        """Partition the pool; full windows go out, the rest stays in the pool."""
        pool, window = self.pool, self.window
        lengths = [len(p[2]) // 4 for p in pool]
        k = sum(lengths) // window
        if k < 2:
            return
        held, main = pool[::12], [i for i in range(len(pool)) if i % 12]
        while True:
            groups = differencing([lengths[i] for i in main], k)
            loads = [sum(lengths[main[j]] for j in g) for g in groups]
            if max(loads) <= window:
                break
            k += 1
        self.pool = []
        for load, group in sorted(zip(loads, groups, strict=True), key=lambda x: -x[0]):
            pieces = [pool[main[j]] for j in group]
            while load < window and held:
                piece = held.pop()
                n = min(window - load, len(piece[2]) // 4)
                part, rest = self._cut(piece, n)
                pieces.append(part)
                load += n
                if rest[2]:
                    held.append(rest)
            if load == window:
                self._emit(pieces)
            else:
                self.pool += pieces
        self.pool += held

    def finish(self) -> None:
        """The rest in full windows and then in lengths that are powers of two."""
        self.flush()
        left = sum(len(p[2]) // 4 for p in self.pool)
        stream, self.pool = self.pool[::-1], []
        while left:
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            pieces, load = [], 0
            while load < size:
                part, rest = self._cut(piece := stream.pop(), min(size - load, len(piece[2]) // 4))
                pieces.append(part)
                load += len(part[2]) // 4
                if rest[2]:
                    stream.append(rest)
            self._emit(pieces)
            left -= size

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in self.out], schema=_ARROW)
        self.out = [[] for _ in _COLUMNS]
        return batch


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, separator: int = 0, window: int = 1024, pool_size: int = 1024) -> DataFrame:
    """One row per piece of a document, with its place in a sequence of at most ``window`` ids.

    docs: doc_id, text. sequence_id is unique; its upper bits are the task's partition.
    """
    bounded_batches(docs.sparkSession)
    end = np.array([separator], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        packer = Packer(window, pool_size, (context.partitionId() if context else 0) << 40)
        encoder = encoder_of(tokenizer_path, ranks_path, pattern)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(doc_id.as_py(), encoder.encode(text.as_py() or "") + end)
                if len(packer.out[0]) >= 8192:
                    yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, SCHEMA)
