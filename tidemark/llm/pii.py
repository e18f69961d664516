"""Operator 4: personal data by weak supervision.

Candidates are the matches of four strict patterns (the base spans) and of looser ones:
spelled-out addresses, phone numbers without a country code, card numbers with a wrong
check digit, and long-form IP addresses. Four labelers vote on each for, against, or not
at all: a regular expression with its checks, a gazetteer (top-level domains, issuer and
calling prefixes, address blocks), the words around the span, and its borders.

Expectation-maximisation over the counts of vote patterns of the whole corpus estimates
each labeler's reliability for each kind, and with it the probability of each pattern. A
final span classifier (naive Bayes over the span's shape and its neighbours) is trained on
all candidates with these probabilities as soft labels. Base spans always stay; a looser
candidate becomes a span where the classifier and the votes together make it likely.

The texts are read once; what is kept of them are the candidates. Both models are made
from grouped counts whose number has a fixed bound.

Nulls and odd rows: a null or empty text has no spans; repeated rows each get theirs; extra
columns are ignored; an empty table gives no rows. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "border")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SPELLED = re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[a-z0-9-]{1,63}\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[a-z]{2,8}(?![a-z0-9])")
_BARE_PHONE = re.compile(r"(?<![0-9+.)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_IP6 = re.compile(r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])")

#: Endings of addresses, words that speak for or against a kind.
DOMAINS = frozenset("com org net edu gov mil int info biz name io co dev app ai me tv eu de fr es it uk nl be ch at pl se no dk fi ie pt cz us ca mx br ar cl jp cn kr in au nz za ru ua tr gr".split())
CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "address", "kontakt", "courriel", "correo"),
    "ip": ("ip", "host", "server", "login", "client", "address", "connect", "ping"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "sms", "anruf", "appel"),
}
AGAINST = ("version", "release", "isbn", "order", "invoice", "page", "ratio", "serial", "build", "section", "figure", "chapter", "sku", "id")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict matches, by kind and then start."""
    spans = [("email", *s) for s in _emails(text)] if "@" in text else []
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return spans


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates that overlap no base span."""
    found: list[tuple[str, int, int]] = []
    low = text.lower() if len(text) == len(text.lower()) else text
    if "(at)" in low or "[at]" in low or "{at}" in low or (" at " in low and " dot " in low):
        found += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    found += [("phone", *m.span()) for m in _BARE_PHONE.finditer(text)]
    if text.count(":") >= 7:
        found += [("ip", *m.span()) for m in _IP6.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and not (len(d) >= 16 and luhn(d)):
            found.append(("card", *m.span()))
    taken: list[tuple[int, int]] = []
    for _, start, end in sorted(base, key=lambda b: b[1]):
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))
    kept, at = [], 0
    for one in sorted(found, key=lambda f: (f[1], -f[2])):
        while at < len(taken) and taken[at][1] <= one[1]:
            at += 1
        if not (at < len(taken) and taken[at][0] < one[2]) and not (kept and one[1] < kept[-1][2]):
            kept.append(one)
    return kept


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> str:
    """One character per labeler: + for, - against, 0 no vote."""
    value, digits = text[start:end], _digits(text[start:end])
    if kind == "email":
        known = re.split(r"[^A-Za-z]+", value)[-1].lower() in DOMAINS
        regex = "+" if strict else "0"
        gazetteer = "+" if known else "-"
    elif kind == "ip":
        regex = "+" if strict else "0"
        first = value.split(".")[0].lstrip("0") or "0"
        gazetteer = "0" if ":" in value else "+" if first.isdigit() and 1 <= int(first[:4]) <= 223 and first != "127" else "-"
    elif kind == "card":
        regex = "+" if strict else "-" if len(digits) >= 16 or not luhn(digits) else "0"
        gazetteer = "+" if digits[:1] in "3456" or digits[:2] in ("22", "23", "24", "25", "26", "27") else "-"
    else:
        regex = "+" if strict else "0"
        gazetteer = "+" if strict and digits[:1] in "12345678" or not strict and digits[:1] in "23456789" else "-"
    around = _WORD.findall((text[max(0, start - 40) : start] + " " + text[end : end + 24]).lower())
    for_it = any(w.startswith(k) for w in around for k in CONTEXT[kind] if len(k) > 2 or w == k)
    context = "+" if for_it else "-" if any(w in AGAINST for w in around) else "0"
    left, right = text[start - 1 : start], text[end : end + 1]
    border = "-" if left.isalnum() or right.isalnum() or left in ("_", "/", "#") else "+"
    return regex + gazetteer + context + border


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Small whole numbers: the span's shape and its neighbours, each below 64."""
    value = text[start:end]
    digits = sum(c.isdigit() for c in value)
    before, after = _WORD.findall(text[max(0, start - 24) : start].lower()), _WORD.findall(text[end : end + 24].lower())
    bucket = lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=2).digest(), "little") % 63 + 1
    kind_of = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 + ord(c) % 8
    return [
        min(63, (end - start) // 2),
        digits * 15 // max(end - start, 1),
        min(15, sum(not c.isalnum() for c in value)),
        kind_of(text[start - 1 : start]),
        kind_of(text[end : end + 1]),
        bucket(before[-1]) if before else 0,
        bucket(after[0]) if after else 0,
    ]


_CANDIDATE = "struct<kind: string, start: int, end: int, base: boolean, votes: string, x: array<int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("x", pa.list_(pa.int32()))]))


def find_candidates(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. A row per row: doc_id and the candidates of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                both = [(*s, True) for s in base] + [(*s, False) for s in loose_spans(text, base)]
                out.append([{"kind": k, "start": s, "end": e, "base": b, "votes": votes(text, k, s, e, b), "x": features(text, k, s, e)} for k, s, e, b in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _ARROW)], names=["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, found array<{_CANDIDATE}>")


def reliabilities(counts: dict[str, int], rounds: int = 50) -> tuple[dict[str, float], dict]:
    """Expectation-maximisation over vote patterns: the probability of each pattern to be
    personal data, and for each labeler the chance of a vote for it given that it is or isn't."""
    n = len(LABELERS)
    total = sum(counts.values())
    p = {v: (1 + v.count("+")) / (2 + v.count("+") + v.count("-")) for v in counts}
    rates: dict = {}
    for _ in range(rounds):
        prior = (sum(c * p[v] for v, c in counts.items()) + 1) / (total + 2)
        for i in range(n):
            hit = [sum(c * w(v) for v, c in counts.items() if v[i] == "+") for w in (lambda v: p[v], lambda v: 1 - p[v])]
            voted = [sum(c * w(v) for v, c in counts.items() if v[i] != "0") for w in (lambda v: p[v], lambda v: 1 - p[v])]
            # Beta priors: a labeler is taken to be better than chance until the counts say otherwise
            rates[LABELERS[i]] = ((hit[0] + 4) / (voted[0] + 5), (hit[1] + 1) / (voted[1] + 5))
        for v in p:
            log = math.log(prior / (1 - prior))
            for i, name in enumerate(LABELERS):
                yes, no = rates[name]
                log += math.log(yes / no) if v[i] == "+" else math.log((1 - yes) / (1 - no)) if v[i] == "-" else 0.0
            p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))
    return p, rates


def train(found: DataFrame) -> dict:
    """Pattern probabilities and the span classifier's weights, from grouped counts of all candidates."""
    each = found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.x")
    patterns: dict[str, dict[str, int]] = {}
    for kind, vote, n in each.groupBy("kind", "votes").count().collect():
        patterns.setdefault(kind, {})[vote] = n
    model: dict = {}
    for kind, counts in patterns.items():
        p, rates = reliabilities(counts)
        model[kind] = {"p": p, "rates": rates, "sums": {}, "n": [sum(c * p[v] for v, c in counts.items()), sum(c * (1 - p[v]) for v, c in counts.items())]}
    shapes = each.select("kind", "votes", F.posexplode("x").alias("i", "value")).groupBy("kind", "votes", "i", "value").count()
    for kind, vote, i, value, n in shapes.collect():
        m = model[kind]
        s = m["sums"].setdefault((i, value), [0.0, 0.0])
        s[0] += n * m["p"][vote]
        s[1] += n * (1 - m["p"][vote])
    for m in model.values():
        yes, no = m["n"]
        m["weights"] = {k: math.log((a + 0.5) / (yes + 32)) - math.log((b + 0.5) / (no + 32)) for k, (a, b) in m.pop("sums").items()}
    return model


def span_score(model: dict, kind: str, vote: str, x: list[int]) -> float:
    """Probability of a candidate: the votes' log odds and the classifier's evidence, tempered
    since neighbouring features are not independent."""
    m = model.get(kind)
    if m is None:
        return 0.0
    p = min(max(m["p"].get(vote, 0.5), 1e-9), 1 - 1e-9)
    log = math.log(p / (1 - p)) + 0.5 * sum(m["weights"].get((i, v), 0.0) for i, v in enumerate(x))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, log))))


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id and spans, an array of (kind, start, end, base, score) by kind and start."""
    bounded_batches(docs.sparkSession)
    found = materialize(find_candidates(docs), "candidates")
    shared = docs.sparkSession.sparkContext.broadcast(train(found))
    order = {k: i for i, k in enumerate(KINDS)}
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                spans = [{k: c[k] for k in ("kind", "start", "end", "base")} | {"score": span_score(model, c["kind"], c["votes"], c["x"])} for c in row]
                spans = [s for s in spans if s["base"] or s["score"] >= threshold]
                out.append(sorted(spans, key=lambda s: (order[s["kind"]], s["start"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind_of)], names=["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int, base: boolean, score: double>>")


def pii_report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, counts of base spans per kind, base_sha256, spans (all)."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    kind_is = lambda k: lambda s: s["base"] & (s["kind"] == k)
    counts = [F.size(F.filter("spans", kind_is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return detect(docs, threshold).select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
