"""Operator 10: secret scan with a random forest that removes false positives.

Candidates are values assigned to names such as ``token`` or ``password``, strings of known
key formats, and all other long runs of key characters. A random forest scores each by its
length and character mix, its entropy, its class changes and letter pairs (against pair
counts of the whole corpus), how much of it dictionary words cover (words that are frequent
among all words of all texts, by a count sketch of a fixed size), its path (the ``source`` column), and the words around it.

The forest is trained on labelled findings. Where none are passed, ``seed_label`` labels those
that something other than the features vouches for: the issuer's format of a key, a name with
a value that holds digits and no placeholder, and on the other side placeholders, words of
the dictionary and runs of letters that nothing assigns. Format and placeholder are no features.
Each positive is also shown without its context, so that a secret that stands alone is
recognised. Distinct findings are sampled, so that copies do not fill the sample; a path's
log odds come from all labelled findings. A known format that is no placeholder is always a
finding; without findings of both labels the seed labels decide.

Nulls and odd rows: a null or empty text has no candidates; a null source is the path "";
repeated rows each get their findings; extra columns are kept or ignored; an empty table
gives no rows. Offsets are code points.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .forest import RandomForest
from .jaccard_join import SKETCH_BITS, word_weights

#: Names that a secret is assigned to, and formats of known keys.
KEYWORDS = ("token", "secret", "passw", "pwd", *(f"{k}{mid}key" for k in ("api", "access", "private") for mid in ("", "_", "-", " ")), "credential", "auth")
ODD_CASE = ("\u017f", "\u212a")  # what KEYED takes for s and k besides the ASCII letters
_GAP = r"(?:[^\S\r\n]*+|\s{0,4})"  # white space up to the end of the line, or a little of any
KEYED = re.compile(
    r"""(?i)(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|credentials?|private[ _-]?key|auth(?:orization)?)["']?"""
    rf"""{_GAP}(?::=|=>|[=:]){_GAP}(?:(?:bearer|basic|digest|token)[^\S\r\n]++)?["']?([^\s"',;]{{8,}})"""
)
KNOWN = re.compile(
    r"AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
)
KNOWN_MARKS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "AIza", "eyJ")
PEM_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END [A-Z0-9 ]{0,20}PRIVATE KEY(?: BLOCK)?-----")
PEM_LINES = re.compile(r"(?:(?:\s|\\[nr])*[A-Za-z0-9+/=]{16,})*+")
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}")
PLACEHOLDER = re.compile(r"(?i)x{4,}|\*{3,}|example|changeme|placeholder|your[_-]|<|\$\{|0{8,}|1234567")

_PAIR = np.full(256, 27, np.int64)
_PAIR[[*range(97, 123)]] = range(26)
_PAIR[[*range(65, 91)]] = range(26)
_PAIR[[*range(48, 58)]] = 26
_WORD = re.compile(r"[^\W\d_]+")
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ASSIGNED = re.compile(r"(?:=>|[=:])\s*[\"']?$")
LONGEST_WORD = 32
ODDS = 16  # the feature of the path
CONTEXT = slice(11, 16)  # features of the surroundings


def pem_blocks(text: str) -> list[tuple[int, int]]:
    """Private keys from their BEGIN line to their END line; where that is missing before the next
    key begins, to the last line of key characters."""
    begins, ends = [m.span() for m in PEM_BEGIN.finditer(text)], [m.span() for m in PEM_END.finditer(text)]
    found, j = [], 0
    for i, (start, head) in enumerate(begins):
        while j < len(ends) and ends[j][0] < head:
            j += 1
        stop = begins[i + 1][0] if i + 1 < len(begins) else len(text)
        closed = j < len(ends) and ends[j][0] < stop
        found.append((start, ends[j][1] if closed else PEM_LINES.match(text, head, stop).end()))
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all candidates, disjoint and in order. Overlapping ones become one, of
    the surest kind and to the last end. It begins with the first of them that is assigned or of a
    known format; a generic run's part before that stays a candidate if it is long enough."""
    raw = text.encode()
    low = raw.lower()
    found: list[tuple[str, int, int]] = []
    if any(k.encode() in low for k in KEYWORDS) or any(c in text for c in ODD_CASE):
        found += [("keyed", m.start(1), m.end(1)) for m in KEYED.finditer(text)]
    if any(k in text for k in KNOWN_MARKS):
        found += [("known", *m.span()) for m in KNOWN.finditer(text)]
    if "PRIVATE KEY" in text:
        found += [("known", *span) for span in pem_blocks(text)]
    if any(len(w) >= 20 for w in raw.split()):
        found += [("generic", *m.span()) for m in GENERIC.finditer(text)]
    order = {"known": 0, "keyed": 1, "generic": 2}
    kept: list[tuple[str, int, int]] = []
    for one in sorted(found, key=lambda c: (c[1], order[c[0]], -c[2])):
        if not kept or one[1] >= kept[-1][2]:
            kept.append(one)
            continue
        kind, start, end = kept[-1]
        end = max(end, one[2])
        if kind != "generic":
            kept[-1] = (min(kind, one[0], key=order.__getitem__), start, end)
        elif one[0] != "generic":
            kept[-1:] = [(kind, start, one[1])] if one[1] - start >= 20 else []
            kept.append((one[0], one[1], end))
        else:
            kept[-1] = (kind, start, end)
    return kept


class Dictionary:
    """The words whose share of all words reaches ``share`` (and that occur three times)."""

    def __init__(self, weights: np.ndarray, share: float):
        total = float(np.sum(np.exp2(weights.astype(np.float64)) - 1))
        self.common = np.packbits(weights >= math.log2(max(3.0, share * total) + 1) - 1e-3)

    def __contains__(self, word: str) -> bool:
        import xxhash

        if not word.isalpha():
            return False
        at = xxhash.xxh64_intdigest(word.encode()) & ((1 << SKETCH_BITS) - 1)
        return bool(self.common[at >> 3] >> (7 - (at & 7)) & 1)


def coverage(value: str, words: Dictionary | set[str]) -> float:
    """Share of a value's characters that dictionary words of 3 to ``LONGEST_WORD`` letters cover, greedily. Words are
    letters only, so they are sought within runs of letters."""
    covered = 0
    low = value.lower()
    for run in _WORD.finditer(low):
        at, end = run.span()
        while at < end - 2:
            for n in range(min(LONGEST_WORD, end - at), 2, -1):
                if low[at : at + n] in words:
                    covered += n
                    at += n
                    break
            else:
                at += 1
    return covered / max(len(low), 1)


def describe(text: str, start: int, end: int, odds: float, corpus: dict) -> np.ndarray:
    """The features of one candidate; odds are its path's log odds."""
    value = text[start:end]
    n = len(value)
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    share = lambda k: kinds.count(k) / n
    pairs = _PAIR[np.frombuffer(value.encode("ascii", "replace"), np.uint8)]
    surprise = float(corpus["surprise"][pairs[:-1], pairs[1:]].mean()) if n > 1 else 0.0
    before, after = text[max(0, start - 48) : start], text[end : end + 32]
    low = before.lower()
    previous, following = _WORD.findall(low), _WORD.findall(after.lower())
    words = corpus["words"]
    return np.array(
        [
            math.log1p(end - start),
            share("d"),
            share("u"),
            share("l"),
            share("o"),
            float(all(c in "0123456789abcdefABCDEF" for c in value)),
            entropy,
            sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
            surprise,
            coverage(value, words),
            sum(c in "aeiouAEIOU" for c in value) / n,
            float(any(k in low for k in KEYWORDS)),
            float(bool(_ASSIGNED.search(before))),
            float(before[-1:] in "\"'" and before != ""),
            float(bool(previous) and previous[-1] in words),
            float(bool(following) and following[0] in words),
            odds,
        ]
    )


def seed_label(text: str, kind: str, start: int, end: int, words: Dictionary | set[str]) -> int | None:
    """1 for a sure secret, 0 for a sure false positive, else None."""
    value = text[start:end]
    if PLACEHOLDER.search(value) if kind != "known" else value.upper().endswith("EXAMPLE"):
        return 0
    if kind == "known":
        return 1
    parts = [w.lower() for w in _PIECE.findall(value) if len(w) > 2]
    if 2 * sum(map(len, parts)) > len(value) and all(w in words for w in parts):
        return 0
    if kind == "keyed":
        return 1 if any(c.isdigit() for c in value) else None
    if value.isdigit() or not any(c.isdigit() for c in value) and not _ASSIGNED.search(text[max(0, start - 8) : start]):
        return 0
    return None


def corpus_model(docs: DataFrame, share: float) -> dict:
    """Letter-pair surprise and the frequent words, from all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(28 * 28, np.int64)
        for batch in batches:
            for text in batch.column(0):
                p = _PAIR[np.frombuffer((text.as_py() or "").encode(), np.uint8)]
                pairs += np.bincount(p[:-1] * 28 + p[1:], minlength=28 * 28)
        used = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(pairs[used], pa.int64())], names=["pair", "n"])

    counts = docs.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = np.ones(28 * 28)
    for pair, n in counts.collect():
        pairs[pair] += n
    pairs = pairs.reshape(28, 28)
    return {"surprise": -np.log2(pairs / pairs.sum(axis=1, keepdims=True)), "words": Dictionary(word_weights(docs), share)}


def labelled_findings(docs: DataFrame, corpus: dict, path: str) -> DataFrame:
    """The candidates with a seed label: y, path, x."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corpus = shared.value
        for batch in batches:
            rows = []
            for text, where in zip(batch["text"], batch["path"], strict=True):
                for kind, start, end in candidates(text or ""):
                    if (y := seed_label(text, kind, start, end, corpus["words"])) is not None:
                        rows.append((y, where, describe(text, start, end, 0.0, corpus)))
            yield pd.DataFrame(rows, columns=["y", "path", "x"])

    return docs.select("text", F.coalesce(path, F.lit("")).alias("path")).mapInPandas(run, "y int, path string, x array<double>")


def path_odds(findings: DataFrame) -> DataFrame:
    """path and its log odds of secrets against those of all labelled findings, shrunk by 20 of these."""
    total = findings.agg(F.sum("y").alias("k"), F.count("*").alias("n")).first()
    share = ((total["k"] or 0) + 1) / (total["n"] + 2)
    n, k = F.count("*"), F.sum("y")
    odds = F.log((k + 20 * share) / (n - k + 20 * (1 - share))) - math.log(share / (1 - share))
    return findings.groupBy("path").agg(odds.alias("odds"))


def train(findings: DataFrame, odds: DataFrame, sample: int) -> RandomForest | None:
    """A forest from at most ``sample`` distinct findings of each label, each drawn by the root of its copies."""
    distinct = findings.join(odds, "path").groupBy("y", "path", "x", "odds").agg(F.count("*").alias("copies"))
    rows = [r for y in (0, 1) for r in distinct.where(F.col("y") == y).orderBy(F.xxhash64("x", "path"), "path").limit(sample).collect()]
    if len({r["y"] for r in rows}) < 2:
        return None
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["y"]) for r in rows])
    x[:, ODDS] = [r["odds"] for r in rows]
    weight = np.sqrt([r["copies"] for r in rows])
    bare = x[y == 1].copy()
    bare[:, CONTEXT] = 0.0
    return RandomForest().fit(np.concatenate([x, bare]), np.concatenate([y, np.ones(len(bare))]), np.concatenate([weight, weight[y == 1]]))


def scan_secrets(docs: DataFrame, path: str = "source", sample: int = 5_000, share: float = 1e-4, threshold: float = 0.5, findings: DataFrame | None = None, mark: str | None = None, broadcast_paths: int = 200_000) -> DataFrame:
    """row (all columns of docs as a struct, so that no name can clash), candidates (their number),
    found (kind, start, end and score of each confirmed secret) and clean (the text with mark in
    place of its secrets; null without a mark or secret). findings: labelled ones (y, path, x)
    to train on."""
    bounded_batches(docs.sparkSession)
    corpus = corpus_model(docs, share)
    if findings is None:
        findings = materialize(labelled_findings(docs, corpus, path), "findings")
    odds = materialize(path_odds(findings), "paths")
    forest = train(findings, odds, sample)
    shared = docs.sparkSession.sparkContext.broadcast((corpus, forest))
    schema = "n long, found array<struct<kind: string, start: int, end: int, score: double>>, clean string"

    @F.pandas_udf(schema)
    def scan(texts: pd.Series, odds: pd.Series) -> pd.DataFrame:
        corpus, forest = shared.value
        rows, xs = [], []
        for i, (text, where) in enumerate(zip(texts, odds, strict=True)):
            for kind, start, end in candidates(text or ""):
                xs.append(describe(text, start, end, where, corpus))
                rows.append((i, kind, start, end))
        scores = forest.predict(np.array(xs)) if forest is not None and xs else None
        n, found = [0] * len(texts), [[] for _ in range(len(texts))]
        for j, (i, kind, start, end) in enumerate(rows):
            n[i] += 1
            score = 0.0 if scores is None else float(scores[j])
            if kind == "known" or scores is None:
                score = max(score, float(seed_label(texts.iloc[i], kind, start, end, corpus["words"]) == 1))
            if score >= threshold:
                found[i].append({"kind": kind, "start": start, "end": end, "score": score})
        clean: list[str | None] = [None] * len(texts)
        for i, spans in enumerate(found if mark is not None else []):
            if spans:
                text, at, parts = texts.iloc[i], 0, []
                for span in spans:
                    parts += [text[at : span["start"]], mark]
                    at = span["end"]
                clean[i] = "".join([*parts, text[at:]])
        return pd.DataFrame({"n": n, "found": found, "clean": pd.Series(clean, dtype=object)})

    if odds.limit(broadcast_paths + 1).count() <= broadcast_paths:
        odds = F.broadcast(odds)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(path, F.lit("")).alias("path")).join(odds, "path", "left")
    scanned = keyed.select("row", scan("row.text", F.coalesce("odds", F.lit(0.0))).alias("scan"))
    return scanned.select("row", F.col("scan.n").alias("candidates"), F.col("scan.found").alias("found"), F.col("scan.clean").alias("clean"))


def secret_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_candidates, n_findings, findings (kind:start:end, comma-joined), max_score."""
    scanned = scan_secrets(docs.select("doc_id", "text", "source"), **options)
    return scanned.select(
        "row.doc_id",
        F.col("candidates").alias("n_candidates"),
        F.size("found").cast("long").alias("n_findings"),
        F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",").alias("findings"),
        F.array_max(F.transform("found", lambda f: f["score"])).alias("max_score"),
    )


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with every confirmed secret in ``text`` replaced by a mark; n_chars, if there, follows."""
    scanned = scan_secrets(docs, mark=mark, **options)
    value = {"text": F.coalesce("clean", "row.text")}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.when(F.col("clean").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return scanned.select(*[value.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
