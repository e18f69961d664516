"""Operator 5: URL filter by rules, host word segmentation and multinomial naive Bayes.

Rules (host, path) fit their host and its subdomains if the path starts with theirs; the
longest wins. Every other URL gets its verdict from its words: the letter runs of host labels
(without the last) and paths are segmented by a unigram model and Viterbi search
(``cheappills`` is ``cheap pills``), and a multinomial naive Bayes model scores the words.

* Unigrams: a run's count is the number of *other* hosts that have it as well, so that a host's own
  name doesn't vouch for itself as a word; seed words are added to it. All runs count, however long
  or rare. A word inside a longer run has at most ``longest`` letters; a whole run may have any length.
* Labels: a host is blocked in training if a blocked seed word is among the words of any of its
  URLs, else it is allowed, and all its URLs go with it; so words that stand beside the
  seeds on their hosts count against a URL as well. Class totals cover all words of all URLs.

Counts, segmentations and scores are tables that meet by joins on words and on runs; each
distinct run is segmented once. Only the totals reach the driver.

Nulls and odd rows: a null URL, or one without ``://``, has an empty host and path, no
words, and is allowed unless blocked hosts prevail; repeated rows each get their verdict; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Words of unwanted sites.
BLOCKED_WORDS = (
    "ads adult bet bets betting casino cheap clickbait crack cracked download escort farm gambling gamble hentai jackpot loan loans "
    "lottery malware nude payday phish phishing pill pills poker porn prize replica scam sex sexy slots spam tracker track viagra "
    "warez win winner xxx"
).split()
#: Common words of ordinary hosts and paths.
PLAIN_WORDS = (
    "about archive art articles blog book books category city cloud code community contact data docs education example farmhouse "
    "file files food forum free garden guide health help history home house index info journal law library life local mail map "
    "media mobile museum music net news online open org page paper people photo post press project public radio research school "
    "science search service shop site sport sports static store story study support tech time travel tutorial university user "
    "video water weather web weekly wiki wild winter work world"
).split()

def host_column(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Unigram Viterbi segmentation of letter runs; unknown words cost more with each letter."""

    def __init__(self, counts: dict[str, int], total: int, longest: int = 20):
        self.cost = {w: -math.log(n / (total + 1.0)) for w, n in counts.items()}
        self.unknown, self.longest = math.log(total + 1.0) + 2.0, longest

    def split(self, run: str) -> list[str]:
        best, cut = [0.0], [0]
        for end in range(1, len(run) + 1):
            starts = range(max(0, end - self.longest), end)
            if end == len(run) > self.longest:
                starts = (0, *starts)
            least, start = min((best[i] + self.cost.get(run[i:end], self.unknown + 2.5 * (end - i)), i) for i in starts)
            best.append(least), cut.append(start)
        words, end = [], len(run)
        while end:
            words.append(run[cut[end] : end])
            end = cut[end]
        return words[::-1]


def letter_runs(host: Column, path: Column) -> Column:
    """The letter runs of a host without its last label, and of a path, in order."""
    both = F.lower(F.concat_ws(" ", F.regexp_replace(host, r"(^|\.)[^.]*$", ""), path))
    return F.filter(F.split(both, "[^a-z]+"), lambda r: r != "")


def unigrams(runs: DataFrame, seeds: list[str]) -> tuple[DataFrame, int]:
    """runs: host, run. word and n, with the total: on how many further hosts a run is found, and each
    seed word as if it had at least a tenth of a per mille of all."""
    seen = runs.select("run", "host").distinct().groupBy("run").agg((F.count("*") - 1).alias("n")).where("n > 0")
    seen = materialize(seen, "unigrams")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    floor = max(1, total // 10_000)
    more = runs.sparkSession.createDataFrame([(w, floor) for w in sorted(set(seeds))], "run string, n long")
    counts = seen.unionByName(more).groupBy(F.col("run").alias("word")).agg(F.sum("n").alias("n"))
    return counts, total + floor * len(set(seeds))


def segment(runs: DataFrame, counts: DataFrame, total: int, longest: int) -> DataFrame:
    """runs: run (distinct). run and words, its likeliest segmentation."""
    n = F.length("run")
    starts = F.explode(F.sequence(F.lit(1), n)).alias("i")
    parts = runs.select("run", n.alias("size"), starts)
    parts = parts.select("run", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("size") - F.col("i") + 1)), lambda k: F.substring("run", F.col("i"), k))).alias("word"))
    parts = parts.unionByName(runs.where(n > longest).select("run", F.col("run").alias("word")))
    known = parts.join(counts, "word").groupBy("run").agg(F.collect_set(F.struct("word", "n")).alias("known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = [{} if k is None else {e["word"]: e["n"] for e in k} for k in batch["known"]]
            yield pd.DataFrame({"run": batch["run"], "words": [Segmenter(k, total, longest).split(r) for r, k in zip(batch["run"], known, strict=True)]})

    return runs.join(known, "run", "left").mapInPandas(run, "run string, words array<string>")


def word_scores(tokens: DataFrame, blocked: list[str], smooth: float = 0.5) -> tuple[DataFrame, float]:
    """tokens: id, host, word (null where a URL has none). word and its log odds of block against
    allow, and the log odds of a URL without words."""
    is_seed = F.coalesce(F.col("word").isin(blocked), F.lit(False))
    hosts = tokens.groupBy("host").agg(F.max(is_seed.cast("int")).alias("bad"), F.countDistinct("id").alias("urls"))
    hosts = materialize(hosts, "hosts")
    urls = hosts.agg(F.coalesce(F.sum(F.col("urls") * F.col("bad")), F.lit(0)).alias("b"), F.coalesce(F.sum("urls"), F.lit(0)).alias("n")).first()
    per_host = tokens.where("word is not null").groupBy("host", "word").agg(F.count("*").alias("n"))
    counts = per_host.join(hosts, "host").groupBy("word").agg(F.sum(F.col("n") * F.col("bad")).alias("b"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("a"))
    counts = materialize(counts, "words")
    total = counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.count("*").alias("size")).first()
    weight = smooth * (total["size"] + 1)
    score = F.log((F.col("b") + smooth) / (total["b"] + weight)) - F.log((F.col("a") + smooth) / (total["a"] + weight))
    return counts.select("word", score.alias("w")), math.log((urls["b"] + 1) / (urls["n"] - urls["b"] + 1))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, blocked: list[str] = BLOCKED_WORDS, plain: list[str] = PLAIN_WORDS, longest: int = 20) -> DataFrame:
    """pages: page_id, url. Per row: page_id, host, path, rule, verdict, score (log odds of
    block by the words) and words (space-joined)."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_column(F.col("url")).alias("host"), path_column(F.col("url")).alias("path"))
    rule, given = rule_columns(F.col("host"), F.col("path"), rules)
    urls = materialize(urls.select("*", rule.alias("rule"), given.alias("given"), F.monotonically_increasing_id().alias("id")), "urls")

    placed = urls.select("id", "host", F.posexplode_outer(letter_runs(F.col("host"), F.col("path"))).alias("pos", "run"))
    runs = placed.where("run is not null").select("host", "run")
    counts, total = unigrams(runs, [*blocked, *plain])
    split = materialize(segment(runs.select("run").distinct(), counts, total, longest), "segments")
    scores, prior = word_scores(placed.join(split, "run", "left").select("id", "host", F.explode_outer("words").alias("word")), list(blocked))
    parts = split.select("run", F.posexplode("words").alias("k", "word")).join(scores, "word")
    scored = parts.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("k", "word", "w"))).alias("parts"))
    per_url = placed.join(scored, "run").groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "parts"))), lambda x: x["parts"])).alias("parts"))
    judged = urls.join(per_url, "id", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<k:int,word:string,w:double>>")))
    score = F.aggregate("parts", F.lit(prior), lambda s, x: s + x["w"])
    words = F.array_join(F.transform("parts", lambda x: x["word"]), " ")
    judged = judged.select("page_id", "host", "path", "rule", "given", score.alias("score"), words.alias("words"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("given", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score", "words")
