"""Operator 11: language identification by rank-order profiles.

A text is lower-cased; its words are the runs of letters (Unicode category L), each with one mark
before and behind it. Its n-grams are the runs of one to three characters of these, marks included,
the mark alone excepted. A profile lists the ``top`` most frequent n-grams; equal counts are
ordered by the n-gram. Each language's profile is made of the counts of all training rows, as
grouped sums. A text's own n-grams are ranked alike, and its distance to a language is the sum of
the differences of ranks (the out-of-place measure); an n-gram that the profile lacks counts ``top``.
The nearest language wins, ties go to the smaller name. ``score`` is 1 less the distance divided by the
largest possible one.

The profiles are small (``top`` rows a language) and go to all tasks; more than ``MOST_LANGUAGES``
languages are an error instead of a broadcast without a bound. Texts are counted in pieces, so
that memory does not grow with their length.

Nulls and odd rows: a text that is null or has no letter is ``und`` with score 0, as is every text when
nothing was learned; rows with a null language teach nothing; repeated rows teach and are judged
each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

TOP = 400
MOST_LANGUAGES = 10_000
_PIECE, _HELD = 1 << 19, 1 << 21
_LOW = np.int64((1 << 21) - 1)


@cache
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """The code points of a lower-cased text, 0 for what is no letter, with runs of 0 as one and 0 at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.concatenate(([0], np.where(_letters()[points], points, 0), [0]))
    stays = np.ones(len(points), bool)
    stays[1:] = (points[1:] != 0) | (points[:-1] != 0)
    return points[stays]


def _tally(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in their order, with the sums of their counts (1 each by default)."""
    if counts is None:
        values = np.sort(values)
    else:
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    if counts is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as integers, 21 bits a character, in their order, and their counts."""
    codes = _codes(text)
    parts = []
    for at in range(0, len(codes), _PIECE):
        c = codes[at : at + _PIECE + 2]  # an n-gram belongs to the piece that it begins in
        one = c[:_PIECE]
        two = (c[:-1] << 21 | c[1:])[:_PIECE]
        three = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
        # a shorter n-gram is stored from the top bits on, with a bit pattern that no character has below it
        values = np.concatenate((one[one > 0] << 42 | _LOW << 21 | _LOW, two << 21 | _LOW, three[(three >> 21) & _LOW != 0]))
        parts.append(_tally(values))
    if len(parts) == 1:
        return parts[0]
    return _tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def ranked(values: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent values, first the most frequent; equal counts by value."""
    if len(values) > 8 * top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))[:top]]


def profiles(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, gram, rank (from 0) of the rows of ``docs`` (lang, text), counted over all of them."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                values, counts = _tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                held.setdefault(lang, []).append(found := gram_counts("\n".join(own)))
                size += len(found[0])
            if size > _HELD:
                held = {lang: [_tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > _HELD // 2:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    counted = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return summed.select("lang", "gram", place.alias("rank")).where(F.col("rank") <= top).withColumn("rank", F.col("rank") - 1)


class Profiles:
    """All profiles in one sorted list of n-grams, each with its languages and ranks."""

    def __init__(self, rows: pa.Table, top: int):
        langs, grams, ranks = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "gram", "rank"))
        self.top, self.langs = top, sorted(set(langs))
        number = {lang: i for i, lang in enumerate(self.langs)}
        order = np.lexsort((ranks, grams))
        self.lang = np.array([number[x] for x in langs], np.int64)[order] if len(order) else np.zeros(0, np.int64)
        self.rank, grams = ranks[order].astype(np.int64), grams[order].astype(np.int64)
        self.grams, self.size = _tally(grams)
        self.first = np.cumsum(self.size) - self.size

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        """The nearest language of a text's ranked n-grams, and its score."""
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[at] == own)
        at = at[hit]
        n = self.size[at]
        ends = np.cumsum(n)
        entry = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.first[at], n)
        nearer = self.top - np.abs(self.rank[entry] - np.repeat(hit, n))
        closeness = np.bincount(self.lang[entry], nearer, len(self.langs))
        best = int(np.argmax(closeness))
        return self.langs[best], float(closeness[best]) / (self.top * len(own))


def predict(docs: DataFrame, learned: DataFrame, top: int = TOP) -> DataFrame:
    """The rows of ``docs`` (text and any other columns) with lang_pred and score in place of the text and of columns of these names."""
    bounded_batches(docs.sparkSession)
    rows = learned.limit(MOST_LANGUAGES * top + 1).toArrow()
    if rows.num_rows > MOST_LANGUAGES * top:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = docs.select(*rest).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(shared.value, top)
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                own = ranked(*gram_counts(text), top) if text else ()
                found.append(known.nearest(own) if len(own) and known.langs else ("und", 0.0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*rest, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by 5 (of a null id: 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def language_report(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    learned = profiles(docs.where(~held_out(F.col("doc_id"))), top)
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), learned, top)
