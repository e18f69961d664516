"""Operators 11 to 13 against brute force, and on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")

from pyspark.sql import functions as F  # noqa: E402

from tidemark.llm import language_id, periodic_runs, phrases, queries  # noqa: E402

DOC = "doc_id long, text string, lang string, source string, held_out string, score string, n string, runs string, word string, suffix string"
EXTRA = ("s", "a", "b", "c", "d", "e", "f")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null ids and languages, repeated rows, a very long text, other scripts, clashing columns."""
    long = " ".join(f"word{i % 997} and" for i in range(40_000))
    rows = [(1, None, "en"), (2, "", "en"), (3, "  \n ", None), (4, long, "en"), (5, "the one and the other", "en"), (5, "the one and the other", "en"), (None, "a text without an id", "en"), (6, "x" * 300_000, None), (7, "12345 !!", "de"), (8, "ÀÉ ünï   \U0001f600 中文 text \x00\x1f", None), (9, "der eine und der andere", "de"), (10, "la", "fr"), (11, "İstanbul ퟿￿", "tr")]
    return frame(spark, rows).cache()


# --- 11


def grams(text):
    """The n-grams of a text in the order of ties, with counts."""
    found = collections.Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        word = f" {word} "
        for n in (1, 2, 3):
            found.update(word[i : i + n] for i in range(len(word) - n + 1))
    found = {g: n for g, n in found.items() if g != " "}
    # the mark between two words is one and the same
    words = len("".join(c if c.isalpha() else " " for c in text.lower()).split())
    assert not words or sum(n for g, n in found.items() if len(g) == 2 and g[0] == " ") == words
    return found


def order(item):
    gram, n = item
    points = [0 if c == " " else ord(c) for c in gram] + [1 << 21] * (3 - len(gram))
    return -n, points


def top_of(counts, top):
    return [g for g, _ in sorted(counts.items(), key=order)[:top]]


def language_by_hand(rows, top):
    total = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if lang is not None and text and zlib.crc32(("" if i is None else str(i)).encode()) % 5:
            total[lang].update(grams(text))
    profile = {lang: {g: r for r, g in enumerate(top_of(c, top))} for lang, c in total.items() if c}
    out = []
    for i, text, _ in rows:
        own = top_of(grams(text or ""), top)
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
        if not own or not profile:
            out.append((i, held, "und", 0.0))
            continue
        far = {lang: sum(abs(p[g] - r) if g in p else top for r, g in enumerate(own)) for lang, p in profile.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        out.append((i, held, best, (top * len(own) - far[best]) / (top * len(own))))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("top", [5, 400])
def test_language_by_hand(spark, odd, top):
    rnd = random.Random(4)
    letters = {"aa": "abcdé", "bb": "bcdefß", "cc": "xyzабв"}
    rows = [(i, " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randint(1, 6))) + rnd.choice(["", ".", "7"]) for _ in range(rnd.randint(0, 30))), lang) for i in range(120) for lang in [rnd.choice(list(letters))]]
    got = sorted(map(tuple, language_id.language_report(frame(spark, rows), top).collect()), key=key)
    assert got == sorted(language_by_hand(rows, top), key=key)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    got = sorted(map(tuple, language_id.language_report(odd, top).collect()), key=key)
    assert got == sorted(language_by_hand(rows, top), key=key)


def test_language_of_long_texts_is_counted_in_pieces(monkeypatch):
    text = "été " * 5000 + "der Zug, " * 3000
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "_PIECE", 1 << 10)
    pieces = language_id.gram_counts(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces, strict=True))
    assert int(whole[1].sum()) == sum(grams(text).values())


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    got = queries.op11_language_id(spark, f"{sf}/../sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.98 * n
    assert got.where("score < 0 OR score > 1").count() == 0


def test_language_without_rows_or_lessons(spark, odd):
    none = language_id.language_report(odd.where("false"))
    assert none.columns == ["doc_id", "held_out", "lang_pred", "score"] and none.count() == 0
    untaught = language_id.language_report(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(untaught) == odd.count() and {(r["lang_pred"], r["score"]) for r in untaught} == {("und", 0.0)}


def test_too_many_languages_are_an_error(spark, odd, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        language_id.language_report(odd, 2)


# --- 12


def phrases_by_hand(rows, least, longest, best):
    words, counts = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            own = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            words[lang or "und"] += len(own)
            for m in range(1, longest + 1):
                counts[lang or "und"].update(tuple(own[i : i + m]) for i in range(len(own) - m + 1))
    out = []
    for lang, c in counts.items():
        found = []
        kept = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in kept.items()):
                continue
            score, k = min((1000 * a * words[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), c[p[:k]], c[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, words[lang], s) for i, (s, a, p, left, right) in enumerate(found[:best])]
    return sorted(out)


@pytest.mark.parametrize(("parts", "words"), [(1, 6), (7, 30), (40, 6)])
def test_phrases_by_hand(spark, parts, words):
    rnd = random.Random(parts)
    lex = [f"w{i}" for i in range(words)] + ["Ünd", "été", "x\x01", "x"]
    rows = [(i, "".join(rnd.choice(lex) + rnd.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for _ in range(rnd.randint(0, 60))), rnd.choice(["en", "en", "de", None])) for i in range(150)]
    rows += [(1000 + i, "hot pair " + lex[i % len(lex)] + " " + lex[i // 7 % len(lex)], "en") for i in range(400)]
    rows += [(2000, None, "en"), (2001, "", None), (2002, " . ,; ", "fr")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted(map(tuple, phrases.collocations(frame(spark, rows), 8, 5, 60).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = phrases_by_hand(rows, 8, 5, 60)
    assert len(want) > 30 and got == want


def test_equal_partitions_are_prefix_counts():
    rnd = np.random.default_rng(3)
    m = rnd.integers(0, 4, (500, 6)).astype(np.int32)
    for row, stop in zip(m, rnd.integers(2, 7, 500), strict=True):
        row[stop:] = -1
    weight = rnd.integers(1, 5, 500)
    want = collections.Counter()
    for row, w in zip(m.tolist(), weight.tolist(), strict=True):
        for d in range(2, 6):
            if row[d] >= 0:
                want[tuple(row[: d + 1])] += w
    for least in (1, 20):
        got = {tuple(m[r, : d + 1].tolist()): n for r, d, n in phrases.equal_partitions(m, weight, least)}
        assert got == {p: n for p, n in want.items() if n >= least}


@pytest.mark.parametrize(("share", "hot"), [(1, 1000), (10_000, 2)])
def test_filters_and_parts_change_no_count(spark, monkeypatch, share, hot):
    """Tables of counters as large as the corpus or of one block, hot leading words in one part or in many."""
    monkeypatch.setattr(phrases, "SHARE", share)
    monkeypatch.setattr(phrases, "HOT", hot)
    monkeypatch.setattr(phrases, "_HELD", 50)
    rnd = random.Random(share)
    rows = [(i, " ".join(rnd.choice("a a a b c d e f".split()) for _ in range(40)), "en") for i in range(60)]
    assert sorted(map(tuple, phrases.collocations(frame(spark, rows), 5, 5, 500).collect())) == phrases_by_hand(rows, 5, 5, 500)


def test_scores_beyond_64_bits(spark, monkeypatch):
    big = 3 * 10**12
    words = [("en", None, 10**13), ("en", "a", big), ("en", "b", big + 1)]
    found = [("en", "a b", big - 7)]
    frames = spark.createDataFrame(words, "lang string, word string, n long"), spark.createDataFrame(found, "lang string, phrase string, n long")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: frames)
    (row,) = phrases.collocations(None).collect()
    assert row["score"] == 1000 * (big - 7) * 10**13 // (big * (big + 1))


def test_phrases_of_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    got = sorted(map(tuple, phrases.collocations(odd, 2, 5, 500).collect()))
    assert got == phrases_by_hand([r for r in rows if r[0] != 4] + [r for r in rows if r[0] == 4], 2, 5, 500)
    none = phrases.collocations(odd.where("false"))
    assert none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and none.count() == 0


# --- 13


def runs_by_hand(words, least=24, times=3):
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if len(own) >= max(least, times * q) and not any(own[p:] == own[: len(own) - p] for p in range(1, q)):
                found.append((i, len(own), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic(rnd, n, letters):
    out = []
    while len(out) < n:
        root = [str(rnd.randrange(letters)) for _ in range(rnd.randint(1, 12))]
        out += root * rnd.randint(1, 8) if rnd.random() < 0.4 else root[:1]
    return out


def test_runs_by_hand():
    rnd = random.Random(5)
    for _ in range(400):
        words = periodic(rnd, rnd.randint(0, 150), rnd.choice([1, 2, 3, 40]))
        assert periodic_runs.runs_of(words) == runs_by_hand(words)


def test_all_runs_of_short_strings():
    """Every word over two letters of up to nine: all runs of exponent two and more."""
    for n in range(1, 10):
        for word in itertools.product((0, 1), repeat=n):
            got = sorted(periodic_runs.section_runs(list(word), 2, 2), key=lambda r: (r[0], r[2]))
            assert got == runs_by_hand(list(word), 2, 2)


def test_suffix_tree_extensions():
    rnd = random.Random(6)
    for _ in range(60):
        keys = [rnd.randrange(3) for _ in range(rnd.randint(2, 90))]
        ext = periodic_runs.Extensions(keys, True)
        assert ext.leaves == sorted(range(len(keys) + 1), key=lambda i: [*keys[i:], -1])
        pairs = [(i, j) for i in range(len(keys) + 1) for j in range(len(keys) + 1) if i != j]
        common = ext.common(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        for (i, j), n in zip(pairs, common.tolist(), strict=True):
            assert n == next(d for d in range(len(keys) + 1) if [*keys, -1][i + d : i + d + 1] != [*keys, -1][j + d : j + d + 1] or i + d > len(keys))


def report_by_hand(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if i is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = runs_by_hand(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)))


def test_run_report_by_hand(spark, odd):
    rnd = random.Random(7)
    rows = [(i, " ".join(periodic(rnd, rnd.randint(0, 120), rnd.choice([2, 50]))) + rnd.choice(["", " ", "\n\tend"]), "en") for i in range(200)]
    got = sorted(map(tuple, periodic_runs.run_report(frame(spark, rows)).collect()))
    assert got == sorted(report_by_hand(i, t) for i, t, _ in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows) > 10
    short = odd.where("length(text) < 100000 OR text IS NULL")
    got = sorted(map(tuple, periodic_runs.run_report(short).collect()), key=key)
    assert got == sorted((report_by_hand(r["doc_id"], r["text"]) for r in short.collect()), key=key)


def test_runs_of_long_texts_and_empty_tables(spark, odd):
    got = {r["doc_id"]: r for r in periodic_runs.run_report(odd).where("doc_id IN (4, 6)").collect()}
    if zlib.crc32(b"4") % 10:
        assert (got[4]["n_runs"], got[4]["start"], got[4]["length"], got[4]["period"]) == (1, 0, 80_000, 1994)
    assert got[6]["n_runs"] == 0
    assert periodic_runs.run_report(odd.where("false")).count() == 0
    assert periodic_runs.find_runs(odd).columns == [c for c in odd.columns if c not in ("text", "runs")] + ["runs", "collapsed"]
    assert periodic_runs.collapse(list("abcabcabcx"), [(0, 9, 3)]) == list("abcx")
