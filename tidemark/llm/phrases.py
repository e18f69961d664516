"""Operator 12: phrase collocation mining by multikey three-way quicksort of suffix pointers.

Texts are cut into pieces and words; a suffix is what follows a position in its piece, up to the
longest phrase. Everything is counted per language.

1. Words are counted, exactly and over all documents. A phrase can only be frequent if its words are, so
   the frequent words make a filter of a fixed size (a Bloom filter; a false hit costs time, not rows).
2. Runs of two and of three words are counted likewise, in tables of counters, so that rare ones can be left out early.
3. A suffix is cut where its first run that is left out ends, and equal ones of a task are summed. They are
   routed by their leading words: by the first, and those of a very frequent one by the second too.
4. Each partition sorts pointers to its suffixes by multikey three-way quicksort, down to the
   longest phrase. The sum over an equal partition at depth d is the count of its phrase of d words;
   a partition whose sum is too small is abandoned.
5. Each phrase meets the counts of its parts by joins. Scores are integers of 38 digits.

Rows: see ``collocations``. Nulls and odd rows: a null text is empty, a null language is ``und``;
repeated rows count each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, mix64

#: All separators of pieces become a point, which no word holds.
_ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"." * 10)
_HELD, _ROWS = 400_000, 1 << 16
FILTER_BITS = 1 << 26
MOST_COUNTERS, SHARE, HOT, _RUNS = 1 << 26, 32, 1000, (2, 3)
_BLOCK, _COUNTERS = 1 << 16, 1 << 13


def words_of(text: str) -> list[bytes]:
    """The words of a text in order, A-Z lower-cased, and ``b"."`` wherever a piece ends."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_ENDS).replace(b".", b" . ").split()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all rows of ``docs`` (lang, text); a null word has the number of all words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(b".", None)
                items = [*counts.items(), (None, sum(counts.values()))]
                for at in range(0, len(items), _ROWS):
                    part = items[at : at + _ROWS]
                    word = pa.array([x[0] for x in part], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), word, pa.array([x[1] for x in part], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, held.values())) > _HELD:
                yield from out()
                held = {}
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _bits(lang: str, word: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass") + b" " + word)
    return h % FILTER_BITS, (h >> 32) % FILTER_BITS


def word_filter(words: DataFrame) -> np.ndarray:
    """A Bloom filter of (lang, word) as bytes of eight bits, of a fixed size however many words there are."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([_bits(a, b.encode("utf-8", "surrogatepass")) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at // _BLOCK), pa.array(at % _BLOCK)], names=["block", "bit"])

    def block(table: pa.Table) -> pa.Table:
        held = np.zeros(_BLOCK, bool)
        held[table.column("bit").to_numpy()] = True
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    set_bits = words.select("lang", "word").mapInArrow(bits, "block long, bit long").distinct()
    found = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in set_bits.groupBy("block").applyInArrow(block, "block long, bits binary").collect():
        found[row["block"] * (_BLOCK // 8) : (row["block"] + 1) * (_BLOCK // 8)] = np.frombuffer(row["bits"], np.uint8)
    return found


class _Hashes(dict):
    """Words of a language to 64-bit hashes; 0 for the end of a piece and for words that the filter lacks."""

    def __init__(self, lang: str, bits: np.ndarray):
        super().__init__({b".": 0})
        self.lang, self.bits = lang, bits

    def __missing__(self, word: bytes) -> int:
        a, b = _bits(self.lang, word)
        held = self.bits[a >> 3] >> (a & 7) & 1 and self.bits[b >> 3] >> (b & 7) & 1
        found = self[word] = xxhash.xxh3_64_intdigest(word, len(self.lang)) | 1 if held else 0
        return found


class _Places:
    """The places of a text's runs of two or three words in tables of ``size`` counters, for one task."""

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size, self.known = bits, size, {}

    def of(self, lang: str, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For runs of two words and of three: by their first word, whether all are in the filter, and the place."""
        hashes = self.known.setdefault(lang, _Hashes(lang, self.bits))
        if len(hashes) > _HELD:
            hashes = self.known[lang] = _Hashes(lang, self.bits)
        h = np.array([hashes[w] for w in words], np.uint64)
        salt = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))
        known, mixed, out = h != 0, mix64(h ^ salt), []
        for d in _RUNS:
            known = known[:-1] & (h[d - 1 :] != 0)
            mixed = mix64(mixed[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[d - 1 :])
            out.append((known, (mixed % np.uint64(self.size)).astype(np.int64)))
        return out


def run_filter(docs: DataFrame, allowed: np.ndarray, words: int, least: int) -> tuple[np.ndarray, int]:
    """Bits of the places whose runs of two or three words occur ``least`` times together (a row each), and their number.

    Each task counts into tables of its own, with a counter for every ``SHARE`` words of the whole corpus but at most
    ``MOST_COUNTERS``; the tables meet block by block as a stream of sums. Runs that share a place can only let more
    through, and beyond that bound the filter wears off."""
    size = -(-min(max(words // SHARE, 1), MOST_COUNTERS) // _COUNTERS) * _COUNTERS
    shared = docs.sparkSession.sparkContext.broadcast(allowed)
    kind = np.min_scalar_type(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, table, rows = _Places(shared.value, size), np.zeros((len(_RUNS), size), kind), 0
        held: list[list[np.ndarray]] = [[] for _ in _RUNS]

        def add() -> None:
            for own, parts in zip(table, held, strict=True):
                place, n = np.unique(np.concatenate(parts), return_counts=True)
                own[place] = np.minimum(own[place] + n, least)
                parts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words_of(text) if text else []
                if len(own) > 2:
                    for parts, (known, place) in zip(held, places.of(lang, own), strict=True):
                        parts.append(place[known])
                    rows += len(own)
                if rows > 1_000_000:
                    add()
                    rows = 0
        if rows:
            add()
        blocks = table.reshape(-1, _COUNTERS)
        some = np.flatnonzero(blocks.any(axis=1))
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array([blocks[b].tobytes() for b in part], pa.binary())], names=["block", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = sums.setdefault(block, np.zeros(_COUNTERS, np.int64))
                np.minimum(held + np.frombuffer(counts, kind), least, out=held)
        if sums:
            bits = [np.packbits(v >= least, bitorder="little").tobytes() for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(bits, pa.binary())], names=["block", "bits"])

    tables = docs.select("lang", "text").mapInArrow(count, "block long, counts binary")
    found = np.zeros((len(_RUNS) * size // _COUNTERS, _COUNTERS // 8), np.uint8)
    for row in tables.repartition("block").mapInArrow(add_up, "block long, bits binary").collect():
        found[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return found.reshape(len(_RUNS), -1), size


def suffixes(docs: DataFrame, allowed: np.ndarray, often: np.ndarray, size: int, hot: dict[tuple[str, bytes], int], longest: int) -> DataFrame:
    """Per task and leading word, its suffixes: lang, lead, part, suffixes (two to ``longest`` words, a space behind each),
    counts. A suffix ends before the first word that makes no frequent run with the ones before it. Suffixes of ``hot``
    leading words are dealt to so many parts by their second word."""
    shared = docs.sparkSession.sparkContext.broadcast((allowed, often, hot))
    texts, numbers = pa.list_(pa.string()), pa.list_(pa.int64())

    def bundles(lang: str, counts: dict[bytes, int], parts: dict) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, int], tuple[list, list]] = {}
        for s, n in counts.items():
            lead, second, _ = s.split(b" ", 2)
            split = parts.get((lang, lead), 1)
            own = held.setdefault((lead, xxhash.xxh3_64_intdigest(second) % split if split > 1 else 0), ([], []))
            own[0].append(s), own[1].append(n)
        rows = list(held.items())
        for at in range(0, len(rows), 4096):
            some = rows[at : at + 4096]
            leads = pa.array([k[0] for k, _ in some], pa.binary()).cast(pa.string())
            whole = pa.array([v[0] for _, v in some], pa.list_(pa.binary())).cast(texts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), leads, pa.array([k[1] for k, _ in some], pa.int32()), whole, pa.array([v[1] for _, v in some], numbers)], names=["lang", "lead", "part", "suffixes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, frequent, parts = shared.value
        places = _Places(bits, size)
        held: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text) if text else []
                if len(words) < 2:
                    continue
                words.append(b".")
                two, three = (known & (own[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool) for own, (known, place) in zip(frequent, places.of(lang, words), strict=True))
                at = np.flatnonzero(two)
                # from each position on, the first run of three that is not frequent ends its suffix
                stops = np.append(np.flatnonzero(~three), len(three))
                ends = np.minimum(stops[np.searchsorted(stops, at)] + 2, at + longest)
                counts = held.setdefault(lang, {})
                for i, j in zip(at.tolist(), ends.tolist(), strict=True):
                    s = b" ".join(words[i:j]) + b" "
                    counts[s] = counts.get(s, 0) + 1
                    if len(counts) > _HELD:
                        yield from bundles(lang, counts, parts)
                        counts.clear()
            if sum(map(len, held.values())) > _HELD:
                for lang, counts in held.items():
                    yield from bundles(lang, counts, parts)
                held = {}
        for lang, counts in held.items():
            yield from bundles(lang, counts, parts)

    return docs.select("lang", "text").mapInArrow(run, "lang string, lead string, part int, suffixes array<string>, counts array<long>")


def equal_partitions(m: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of pointers to the rows of ``m`` (key values by depth, -1 past the end).

    Yields (row, depth, sum of weights) of each equal partition of the language and two words at least. Partitions
    below ``least`` are abandoned.
    """
    deepest = m.shape[1]
    stack = [(np.arange(len(m)), 0, int(weight.sum()))]  # pointers, the depth of their key, their sum
    while stack:
        at, depth, total = stack.pop()
        if total < least:
            continue
        keys = m[at, depth]
        if len(at) == 1:
            pivot = keys[0]
        else:
            a, b, c = keys[0], keys[len(at) // 2], keys[-1]
            pivot = max(min(a, b), min(max(a, b), c))
        equal = keys == pivot
        inside = at[equal]
        same = int(weight[inside].sum())
        if len(inside) < len(at):
            less = keys < pivot
            below, above = at[less], at[~(less | equal)]
            rest = int(weight[below].sum())
            stack.append((below, depth, rest))
            stack.append((above, depth, total - same - rest))
        if pivot < 0 or same < least:
            continue  # these end here, or are too few
        if depth >= 2:
            yield int(inside[0]), depth, same
        if depth + 1 < deepest:
            stack.append((inside, depth + 1, same))


def sort_suffixes(routed: DataFrame, least: int, longest: int) -> DataFrame:
    """lang, phrase, n of the phrases that are frequent; all suffixes of a leading pair of words are in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        lang = pc.dictionary_encode(table.column("lang")).combine_chunks()
        bundles = table.column("suffixes").combine_chunks()
        parts = pc.split_pattern(bundles.flatten(), " ")
        starts = parts.offsets.to_numpy()
        sizes = np.diff(starts) - 1  # behind the last space there is nothing
        words = pc.dictionary_encode(parts.values)
        number, codes = words.indices.to_numpy(), np.full((len(parts), longest + 1), -1, np.int32)
        codes[:, 0] = np.repeat(lang.indices.to_numpy(), pc.list_value_length(bundles).to_numpy())
        for d in range(longest):
            has = sizes > d
            codes[has, d + 1] = number[starts[:-1][has] + d]
        langs, names = lang.dictionary.to_pylist(), words.dictionary
        weight = table.column("counts").combine_chunks().flatten().to_numpy()
        out: list[tuple[str, str, int]] = []
        for row, depth, n in equal_partitions(codes, weight, least):
            out.append((langs[codes[row, 0]], " ".join(names[int(c)].as_py() for c in codes[row, 1 : depth + 1]), n))
        for at in range(0, len(out), _ROWS):
            part = out[at : at + _ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in part], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "n"])

    return routed.mapInArrow(run, "lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, n; a null word has the sum) and phrases (lang, phrase, n) with n >= least."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = materialize(word_counts(docs).where(f"n >= {least} OR word IS NULL"), "words")
    known = words.where("word IS NOT NULL")
    allowed = word_filter(known)
    total = words.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    often, size = run_filter(docs, allowed, total, least)
    # fewer than HOT words can be so frequent
    hot = {(lang, word.encode()): -(-n * HOT // total) for lang, word, n in known.where(F.col("n") * HOT > total).select("lang", "word", "n").collect()} if total else {}
    routed = suffixes(docs, allowed, often, size, hot, longest).repartition("lang", "lead", "part")
    return words, materialize(sort_suffixes(routed, least, longest), "phrases")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, best: int = 2000) -> DataFrame:
    """Each language's ``best`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of its worst cut, ``n`` the number
    of words of the language; score = floor(1000 * a * n / (l * r)). Phrases that always stand inside one longer
    phrase are left out: since counts can only fall with length, one word more on either side decides.
    """
    words, phrases = frequent_phrases(docs, least, longest)
    counts = phrases.select("lang", "phrase", "n").unionByName(words.where("word IS NOT NULL").select("lang", F.col("word").alias("phrase"), "n"))
    totals = words.where("word IS NULL").select("lang", F.col("n").alias("total"))
    cut = F.split("phrase", " ", -1)
    part = lambda start, size: F.array_join(F.slice(cut, start, size), " ")
    inner = F.explode(F.array(part(F.lit(1), F.size(cut) - 1), part(F.lit(2), F.size(cut) - 1)))
    longer = phrases.where(F.size(cut) > 2).select("lang", inner.alias("phrase"), F.col("n").alias("outer")).groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    stays = phrases.join(longer, ["lang", "phrase"], "left").where("outer IS NULL OR outer < n").select("lang", "phrase", F.col("n").alias("a"))
    cuts = stays.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size(cut) - 1)).alias("k")).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size(cut) - F.col("k")).alias("right"))
    by = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    scored = cuts.join(by("left", "l"), ["lang", "left"]).join(by("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    scored = scored.withColumn("top", (wide("a") * F.lit(1000).cast("decimal(4,0)") * wide("total")).cast("decimal(38,0)")).withColumn("bottom", (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("top div bottom"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"), F.first("a").alias("a"), F.first("total").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = worst.select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score").withColumn("rank", place.cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
