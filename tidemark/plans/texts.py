"""Text, retrieval and measure queries over documents, embeddings, pages and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..functions import text as tx
from ..operators import measures as m
from ..operators import retrieval as r
from ..operators import texts as t
from ..session import table

#: Ends of words for RE2 and Java alike: ASCII white space only.
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"
_EDGE = lambda x: f"regexp_replace({x}, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')"
_RAW = "coalesce(text, '')"
_BARE = f"regexp_replace({_RAW}, 'data:[^, \\t\\n\\r\\f]*;base64,[A-Za-z0-9+/=]+', '', 'g')"
_B64 = f"(length({_RAW}) - length(regexp_replace({_RAW}, 'base64,[A-Za-z0-9+/=]+', '', 'g')))"
_JUNK = f"""CASE WHEN {_EDGE(_RAW)} = '' THEN 'empty' WHEN length({_RAW}) - length({_BARE}) > 0.25 * length({_EDGE(_RAW)}) THEN 'base64_heavy' WHEN length({_EDGE(_BARE)}) < 40 THEN 'too_short'
WHEN len(regexp_extract_all({_BARE}, '[^ \\t\\n\\r\\f]+')) < 8 THEN 'too_few_words' WHEN length({_EDGE(_BARE)}) >= 200 AND NOT regexp_matches({_EDGE(_BARE)}, '[.!?;:\\n]') THEN 'low_prose' END"""


def content_junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18, T20."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(classify.content_junk("text"), F.lit("-")).alias("junk"))


def corpus_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-19, AGG-15."""
    d = table(spark, sf_dir, "documents").withColumn("class", classify.survey_class("text", F.col("source") == "src3"))
    return d.groupBy("class", "lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def survey_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: counts by language and source with subtotals."""
    got = m.survey(table(spark, sf_dir, "documents"), "lang", "source")
    return got.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "level")


def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: the twelve most frequent sources."""
    return m.top_values(table(spark, sf_dir, "documents"), "source")


def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-01, T13."""
    got = t.word_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.select("doc_id", "chunk", F.md5("body").alias("body"))


def shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-05: similarity of each document to the next one's words."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.filter(F.split(tx.stream_title("text"), " "), lambda w: w != "").alias("w"))
    d = d.select("doc_id", tx.shingle_hashes(F.col("w"), 5).alias("s"))
    pairs = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("s2")), "doc_id")
    both, all_of_both = F.size(F.array_intersect("s", "s2")), F.size("s") + F.size("s2")
    return pairs.select("doc_id", F.round(F.when(all_of_both == 0, 0.0).otherwise(both / (all_of_both - both)), 6).alias("similarity"))


def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of pages, by length and hash."""
    got = table(spark, sf_dir, "pages").select("page_id", tx.strip_html("html").alias("body"))
    return got.select("page_id", F.length("body").alias("chars"), F.md5("body").alias("body"))


def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, first segment and normal form of URLs."""
    return table(spark, sf_dir, "pages").select("page_id", tx.provider_key("url").alias("provider"), tx.normal_url("url").alias("normal"), tx.host_and_first_segment("url").alias("section"))


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-12: text around the first licence word."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.context_window(F.coalesce("text", F.lit("")), F.lit("license"), 60, 100)).alias("around"))


def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-02: chunks of whole sentences."""
    got = t.markdown_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.select("doc_id", "chunk", F.length("body").alias("chars"), F.sha2("body", 256).alias("body_sha256"))


def superseded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-03: chunks without junk, numbered anew."""
    stripped = table(spark, sf_dir, "documents").withColumn("text", t.strip_data_uris(F.col("text")))
    chunks = t.word_chunks(stripped, "doc_id", "text", 100, 10)
    return t.supersede(chunks, "doc_id", classify.content_junk("body")).groupBy("doc_id").agg(F.max("chunk").alias("last"), F.count("*").alias("n"))


def evidence_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-04, PRJ-12: excerpts and provenance classes."""
    d = table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(x) for x in ("gdelt", "RSS", "telegram", "gdelt_gkg", "gdelt_x", "other")])
    when = lambda rule, c: F.when(F.expr(rule), c)
    d = d.select("doc_id", "text", F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("source"), when("doc_id % 5 = 0", F.col("lang")).alias("source_type"), when("doc_id % 10 = 0", F.col("source")).alias("provider"),
        when("doc_id % 7 = 0", F.lit("nb1")).alias("notebook_id"), when("doc_id % 11 = 0", F.lit("@Chan")).alias("telegram_channel"), when("doc_id % 4 = 0", F.lit("Feed")).alias("feed_name"))
    got = t.evidence(d, F.col("text"))
    return got.groupBy("provenance_class", "provenance_provider").agg(F.count("*").alias("n"), F.sum(F.length("excerpt")).alias("chars"))


_CHANNELS = ("Chan1", "Chan2")


def lane_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17: what each lane keeps of the documents."""
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x).cast("string") for x in names]), (F.col("doc_id") % n + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", pick(("rss", "rss_fulltext", "suv_structured", "telegram", "gdelt", None), 6).alias("source"), pick((None, "rss", "dataset", "notebooklm", "telegram"), 5).alias("source_type"),
        F.when(F.expr("doc_id % 7 = 0"), "nb1").alias("notebook_id"), pick(("Chan1", "Chan2", "Chan3"), 3).alias("telegram_channel"), F.expr("doc_id % 13 = 0").alias("superseded_by_fulltext"),
        F.when(F.expr("doc_id % 2 = 0"), F.col("text")).otherwise("").alias("content"), F.col("text").alias("title"))
    return d.select("doc_id", r.lane_outcome(d, "analysis", _CHANNELS).alias("analysis"), r.lane_outcome(d, "realtime", _CHANNELS).alias("realtime"))


def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-05: a few words of a question before each document's text, and the template that they ask for."""
    ask = F.concat(F.element_at(F.array(*[F.lit(x) for x in _ASKED]), (F.col("doc_id") % len(_ASKED) + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", ask.alias("q")).withColumn("entity", t.asked_entity(F.col("q")))
    template = t.intent(F.col("q"), F.col("entity"))
    return d.select("doc_id", F.md5("entity").alias("entity"), template.alias("template"), F.md5(t.asked_location(F.col("q"), F.col("entity"))).alias("location"))


_ASKED = ("most connected", "events about Kiel", "events in", 'sources for "Alpha Beta"', "2-hop of Kiel", "who is Ann Lee", "tell me")


def grounding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside text before it is fenced in."""
    d = table(spark, sf_dir, "documents").withColumn("x", F.concat(F.lit("<<<GROUNDING_DATA\n "), F.coalesce("text", F.lit("")), F.lit(" >>>END_GROUNDING_DATA")))
    return d.select("doc_id", F.md5(t.sanitised(F.col("x"))).alias("body"))


def providers_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-15: sources of each language by their first document."""
    d = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("pos"), F.col("source").alias("provider"))
    return r.providers_seen(d, "lang").select("lang", F.array_join("providers", ",").alias("providers"))


def codebook_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-16: event types outside the codebook fall back."""
    e = table(spark, sf_dir, "events").select(classify.known_code("event_type", ("click", "purchase")).alias("code"))
    return e.groupBy("code").agg(F.count("*").alias("n"))


def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-13: the first document of each text."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("query"), F.col("doc_id").alias("pos"), F.when(F.expr("doc_id % 7 > 0"), F.sha2("text", 256)).alias("content_hash"), F.col("source").alias("ref_id"))
    return r.unique_evidence(d, "query").select("query", "pos")


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity keys of documents."""
    from ..functions import keys

    d = table(spark, sf_dir, "documents")
    h = keys.content_hash("source", "lang")
    return d.select("doc_id", h.alias("content_hash"), keys.point_id(F.sha2(F.col("doc_id").cast("string"), 256)).cast("string").alias("point_id"), keys.event_key(F.col("source"), F.col("lang"), F.col("text")).alias("event_key"), keys.stream_event_id(F.col("n_chars"), F.col("doc_id")).alias("stream_id"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07: the vectors most like one fixed direction."""
    query = [((i * 37) % 11 - 5) / 10.0 for i in range(64)]
    got = r.dense_top_k(table(spark, sf_dir, "embeddings"), query, "vec_id", "embedding", 20, 0.05)
    return got.select("vec_id", F.round("score", 6).alias("score"))


_DENSE = "list_transform(range(64), lambda i: ((i * 37) % 11 - 5) / 10.0::DOUBLE)"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language as result pools with whole-number scores."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("query"), F.col("doc_id").alias("pos"), F.expr("doc_id * 7919 % 1009 / 1.0D").alias("score"), F.expr("doc_id % 10 / 10.0D").alias("credibility"), F.when(F.expr("doc_id % 4 = 0"), "realtime").otherwise("analysis").alias("lane"))


_POOL = "p AS (SELECT lang AS query, doc_id AS pos, (doc_id * 7919 % 1009) / 1.0::DOUBLE AS score, (doc_id % 10) / 10.0::DOUBLE AS credibility, CASE WHEN doc_id % 4 = 0 THEN 'realtime' ELSE 'analysis' END AS lane FROM documents)"
_BOOST = _POOL + ", w AS (SELECT *, 0.8::DOUBLE * ((score - min(score) OVER (PARTITION BY query)) / (max(score) OVER (PARTITION BY query) - min(score) OVER (PARTITION BY query))) + 0.2::DOUBLE * credibility AS boosted FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY boosted DESC, pos) AS rank FROM w)"


def tier_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-09, AGG-19, PRJ-13."""
    return r.tier_boost(_pool(spark, sf_dir), "query", "score", "credibility", keep=40).select("query", "pos", "rank", F.round("boosted", 9).alias("boosted"))


def lane_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10, FLT-16."""
    pool = r.boosted(_pool(spark, sf_dir), "query", "score", "credibility")
    return r.lane_merge(pool, "query", order=[F.col("boosted").desc(), F.col("pos")]).select("query", "pos", "place", "lane")


def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-08: the pool by a deterministic scorer."""
    got = r.rerank(_pool(spark, sf_dir), "query", lambda p: p["credibility"] * 3 - p["score"], 10)
    return got.select("query", "pos", "rank")


def evidence_budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11, WIN-12, WIN-16: packs of evidence blocks for lists of a hundred documents, in the order of their ids, deduplicated by content."""
    block = F.concat(F.lit("Title: "), "source", F.lit("\nExcerpt: "), F.substring(F.coalesce("text", F.lit("")), 1, 700))
    item = F.struct(F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"), F.length(block).alias("size"))
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 100").alias("batch"), item.alias("x"))
    got = d.groupBy("batch").agg(F.sort_array(F.collect_list("x")).alias("items"))
    pack = r.evidence_pack(F.col("items"), 6000)
    return got.select("batch", pack["used"].alias("used"), F.size(pack["ids"]).alias("taken"), F.array_join(pack["ids"], ",").alias("ids"))


def judge_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: junk by length as a judge of quality."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    v = lab.join(d, "doc_id")
    return m.judge_metrics(v, F.expr("n_chars >= 300"), F.expr("quality = 1"))


def lane_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16, SPA-10: disjoint statuses per language."""
    status = classify.first_rule([(F.expr("n_chars < 100"), "tiny"), (F.expr("n_chars < 1000"), "short"), (F.expr("n_chars < 10000"), "normal")], "long")
    got = m.coverage(table(spark, sf_dir, "documents"), "lang", status, ["tiny", "short", "normal", "long"])
    return m.publishable(got, ["tiny"], 0.05)


def report_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, SNK-19: the next number in each conversation."""
    return m.next_number(table(spark, sf_dir, "conversations"), "conv_id", "turn")


QUERIES = {
    f.__name__: f
    for f in (content_junk, corpus_survey, survey_rollup, top_sources, chunk_words, shingle_jaccard, clean_html, url_functions, context_windows, markdown_chunks, superseded_chunks, evidence_items, lane_validation, question_intents, grounding_text, providers_seen, codebook_guard, evidence_dedup, content_hash, dense_topk, tier_boost, lane_merge, rerank_pool, evidence_budget_pack, judge_metrics, lane_coverage, report_messages)
}

_SPLIT = "string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), ' ')"
_CHUNKS = lambda size, step: f"""w AS (SELECT doc_id, text, {_SPLIT} AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, text, w, unnest(CASE WHEN len(w) <= {size} THEN [0] ELSE range(0, len(w), {step}) END) AS s FROM w),
b AS (SELECT doc_id, CAST(s // {step} AS INTEGER) AS chunk, CASE WHEN len(w) <= {size} THEN text ELSE array_to_string(w[s + 1:s + {size}], ' ') END AS text FROM c)"""  # noqa: E731
_TITLE = "trim(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[^ \\t\\n\\r\\f]+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_STRIP = "html"
for _a, _b in (("<!--(?s:.*?)-->", " "), ("<(script|style)[^>]*>(?s:.*?)</(script|style)>", " "), ("<[^>]*>", " ")):
    _STRIP = f"regexp_replace({_STRIP}, '{_a}', '{_b}', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_a}', '{_b}')"
_STRIP = f"trim(regexp_replace({_STRIP}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_SQL_WS = "[ \\t\\n\\r\\f]+"

ORACLE = {
    "content_junk": f"SELECT doc_id, coalesce({_JUNK}, '-') AS junk FROM documents",
    "corpus_survey": f"""WITH c AS (SELECT lang, text, CASE WHEN length({_EDGE(_RAW)}) < 30 THEN 'EMPTY' WHEN {_B64} > 0.30 * length({_EDGE(_RAW)}) THEN 'IMAGE_HEAVY' WHEN source <> 'src3' AND length({_EDGE(_RAW)}) >= 200 AND len(regexp_extract_all(text, '[.!?]')) <= 1 THEN 'LOW_PROSE' ELSE 'ok' END AS class FROM documents)
SELECT class, lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM c GROUP BY ALL""",
    "survey_rollup": "SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, CAST(grouping(lang, source) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (lang, source)",
    "top_sources": "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 12",
    "chunk_words": f"WITH {_CHUNKS(512, 462)} SELECT doc_id, chunk, md5(text) AS body FROM b",
    "shingle_jaccard": f"""WITH w AS (SELECT doc_id, list_filter(string_split({_TITLE}, ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT DISTINCT doc_id, x || ' ' || lead(x, 1) OVER p || ' ' || lead(x, 2) OVER p || ' ' || lead(x, 3) OVER p || ' ' || lead(x, 4) OVER p AS s FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT * FROM g WHERE s IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY 1), k AS (SELECT a.doc_id, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND b.doc_id = a.doc_id + 1 GROUP BY 1)
SELECT a.doc_id, round(CASE WHEN a.n + b.n = 0 THEN 0.0 ELSE coalesce(k, 0)::DOUBLE / (a.n + b.n - coalesce(k, 0)) END, 6) AS similarity FROM n a JOIN n b ON b.doc_id = a.doc_id + 1 LEFT JOIN k ON k.doc_id = a.doc_id""",
    "clean_html": f"WITH b AS (SELECT page_id, {_STRIP} AS body FROM pages) SELECT page_id, CAST(length(body) AS INTEGER) AS chars, md5(body) AS body FROM b",
    "url_functions": """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '[/?#].*$', ''), '^www\\.', '') AS provider,
regexp_replace(lower(regexp_extract(trim(url), '^([A-Za-z]+://[^/?#]*)', 1)) || substr(trim(url), length(regexp_extract(trim(url), '^([A-Za-z]+://[^/?#]*)', 1)) + 1), '/+$', '') AS normal,
lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+(?:/[^/?#]+)?)', 1)) AS section FROM pages""",
    "context_windows": "WITH x AS (SELECT doc_id, coalesce(text, '') AS t, instr(lower(coalesce(text, '')), 'license') AS pos FROM documents) SELECT doc_id, md5(CASE WHEN pos > 0 THEN substr(t, greatest(pos - 60, 1), pos + 67 - greatest(pos - 60, 1)) ELSE substr(t, 1, 100) END) AS around FROM x",
    "superseded_chunks": f"WITH {_CHUNKS(100, 90)}, k AS (SELECT doc_id FROM b WHERE ({_JUNK}) IS NULL) SELECT doc_id, CAST(count(*) - 1 AS INTEGER) AS last, count(*) AS n FROM k GROUP BY doc_id",
    "evidence_items": """WITH x AS (SELECT text, doc_id AS i, source AS p, ['gdelt', 'rss', 'telegram', 'gdelt_gkg', 'gdelt_x', 'other'][doc_id % 6 + 1] AS s FROM documents),
y AS (SELECT text, CASE WHEN i % 10 = 0 THEN 'canonical' WHEN i % 7 = 0 THEN 'notebooklm' WHEN i % 11 = 0 OR s = 'telegram' THEN 'telegram' WHEN s = 'rss' THEN 'rss' WHEN s IN ('gdelt', 'gdelt_gkg') THEN 'gdelt' ELSE 'unknown' END AS provenance_class,
CASE WHEN i % 10 = 0 THEN p WHEN i % 7 = 0 THEN 'notebooklm:nb1' WHEN i % 11 = 0 THEN 'telegram:chan' WHEN s = 'telegram' THEN 'telegram' WHEN s = 'rss' AND i % 4 = 0 THEN 'feed' WHEN s = 'rss' THEN 'rss' WHEN s IN ('gdelt', 'gdelt_gkg') THEN 'gdelt' ELSE '?' END AS provenance_provider FROM x)
SELECT provenance_class, provenance_provider, count(*) AS n, CAST(sum(length(substr(text, 1, 700))) AS BIGINT) AS chars FROM y GROUP BY ALL""",
    "lane_validation": f"""WITH d AS (SELECT doc_id, text, ['rss', 'rss_fulltext', 'suv_structured', 'telegram', 'gdelt', NULL][doc_id % 6 + 1] AS s, [NULL, 'rss', 'dataset', 'notebooklm', 'telegram'][doc_id % 5 + 1] AS k, doc_id % 7 = 0 AS book, doc_id % 3 < 2 AS listed, doc_id % 13 = 0 AS gone, {_JUNK} AS junk FROM documents)
SELECT doc_id, CASE WHEN gone THEN 'superseded' WHEN NOT CASE WHEN s IN ('rss', 'rss_fulltext') THEN coalesce(k, 'rss') = 'rss' WHEN s = 'suv_structured' THEN coalesce(k, 'dataset') = 'dataset' ELSE book AND coalesce(k, 'notebooklm') = 'notebooklm' END THEN 'dropped' WHEN junk IS NOT NULL THEN 'content:' || junk ELSE 'kept' END AS analysis,
CASE WHEN gone THEN 'superseded' WHEN s = 'telegram' AND listed AND coalesce(k, 'telegram') = 'telegram' THEN 'kept' ELSE 'dropped' END AS realtime FROM d""",
    "question_intents": r"""WITH a AS (SELECT doc_id, ['most connected', 'events about Kiel', 'events in', 'sources for "Alpha Beta"', '2-hop of Kiel', 'who is Ann Lee', 'tell me'][doc_id % 7 + 1] || ' ' || coalesce(text, '') AS q FROM documents),
e AS (SELECT doc_id, q, lower(q) AS l, coalesce(nullif(regexp_extract(q, '"([^"]+)"', 1), ''), nullif(array_to_string(list_filter(list_filter(string_split_regex(q, '[ \t\n\r\f]+'), lambda w: w <> '')[2:], lambda w: regexp_matches(w, '^\p{Lu}')), ' '), '')) AS x FROM a)
SELECT doc_id, md5(x) AS entity, CASE WHEN regexp_matches(l, 'most connected|top entities|most important|highest degree') THEN 'top_connected' WHEN x IS NOT NULL AND regexp_matches(l, 'events (involving|about|for)') THEN 'events_by_entity' WHEN regexp_matches(l, 'timeline|events in|events at') THEN 'event_timeline'
WHEN x IS NULL THEN NULL WHEN regexp_matches(l, 'co-occur|appear together|related entities') THEN 'co_occurring' WHEN regexp_matches(l, 'source|evidence|reported by') THEN 'source_backed' WHEN regexp_matches(l, 'network|2-hop|connections around') THEN 'two_hop_network'
WHEN regexp_matches(l, 'operate|betreibt|in dienst|im bestand|fielded|in service|beschafft|procures|procurement|modernisierung|vorhaben|contractor|auftragnehmer|connected to|related to|neighbors of|linked to') THEN 'one_hop' ELSE 'entity_lookup' END AS template,
md5(coalesce(x, trim(string_split(string_split(q, 'in ')[-1], 'at ')[-1], ' ?.'))) AS location FROM e""",
    "grounding_text": r"""SELECT doc_id, md5(trim(regexp_replace('···GROUNDING_DATA ' || replace(replace(coalesce(text, ''), '<<<GROUNDING_DATA', '···GROUNDING_DATA'), '>>>END_GROUNDING_DATA', '···END_GROUNDING_DATA') || ' ···END_GROUNDING_DATA', '[ \t\n\r\f]+', ' ', 'g'))) AS body FROM documents""",
    "providers_seen": "SELECT lang, coalesce(string_agg(source, ',' ORDER BY pos), '') AS providers FROM (SELECT lang, source, min(doc_id) AS pos FROM documents WHERE source IS NOT NULL GROUP BY 1, 2) GROUP BY lang",
    "codebook_guard": "SELECT CASE WHEN event_type IN ('click', 'purchase') THEN event_type ELSE 'other.unclassified' END AS code, count(*) AS n FROM events GROUP BY 1",
    "evidence_dedup": "SELECT lang AS query, doc_id AS pos FROM documents QUALIFY row_number() OVER (PARTITION BY lang, coalesce(CASE WHEN doc_id % 7 > 0 THEN sha256(text) END, source, CAST(doc_id AS VARCHAR)) ORDER BY doc_id) = 1",
    "evidence_budget_pack": """WITH d AS (SELECT doc_id // 100 AS batch, list({'id': [doc_id], 'h': [md5(coalesce(text, ''))], 'n': CAST(len('Title: ' || source || chr(10) || 'Excerpt: ' || left(coalesce(text, ''), 700)) AS BIGINT)} ORDER BY doc_id) AS items FROM documents GROUP BY 1),
p AS (SELECT batch, list_reduce(items, lambda a, x: CASE WHEN a.n + x.n + CASE WHEN len(a.id) > 0 THEN 2 ELSE 0 END <= 6000 AND NOT list_contains(a.h, x.h[1]) THEN {'id': a.id || x.id, 'h': a.h || x.h, 'n': a.n + x.n + CASE WHEN len(a.id) > 0 THEN 2 ELSE 0 END} ELSE a END, {'id': []::BIGINT[], 'h': []::VARCHAR[], 'n': CAST(0 AS BIGINT)}) AS p FROM d)
SELECT batch, p.n AS used, CAST(len(p.id) AS INTEGER) AS taken, array_to_string(p.id, ',') AS ids FROM p""",
    "markdown_chunks": r"""WITH RECURSIVE p AS (SELECT doc_id, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(trim(text, E' \t\n\r\f'), '\n\s*\n') AS a FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, i, unnest(a) AS s, generate_subscripts(a, 1) AS j FROM (SELECT doc_id, i, string_split(regexp_replace(replace(regexp_replace(trim(p, E' \t\n\r\f'), '^#{1,6}\s+', ''), chr(10), ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS a FROM p)),
n AS (SELECT doc_id, trim(s, E' \t\n\r\f') AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS r FROM s WHERE trim(s, E' \t\n\r\f') <> ''),
f AS (SELECT doc_id, CAST(0 AS BIGINT) AS r, []::VARCHAR[] AS held, CAST(0 AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS done, CAST(-1 AS BIGINT) AS chunk FROM (SELECT DISTINCT doc_id FROM n)
 UNION ALL SELECT doc_id, r, CASE WHEN over THEN carry ELSE held END || [s], CASE WHEN over THEN coalesce(list_sum(list_transform(carry, lambda x: len(x) + 1)), 0) ELSE size END + len(s) + 1, CASE WHEN over THEN array_to_string(held, ' ') END, chunk + CASE WHEN over THEN 1 ELSE 0 END
 FROM (SELECT *, len(held) > 0 AND size + len(s) + 1 > 2600 AS over, list_reverse(list_filter(list_reverse(held), lambda x, k: list_sum(list_transform(list_reverse(held)[1:k], lambda y: len(y) + 1)) - 1 <= 400)) AS carry
  FROM (SELECT f.doc_id, n.r, f.held, f.size, f.chunk, n.s FROM f JOIN n ON n.doc_id = f.doc_id AND n.r = f.r + 1))),
o AS (SELECT doc_id, chunk, done AS body FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, chunk + 1, array_to_string(held, ' ') FROM f WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) = 1)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(len(body) AS INTEGER) AS chars, sha256(body) AS body_sha256 FROM o""",
    "content_hash": f"""SELECT doc_id, sha256(lower(trim(source)) || '|' || lower(trim(lang))) AS content_hash, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT) AS VARCHAR) AS point_id,
substr(sha256(source || '|' || lang || '|' || substr(lower(regexp_replace(trim(text), '{_SQL_WS}', ' ', 'g')), 1, 200)), 1, 24) AS event_key, lpad(CAST(n_chars AS VARCHAR), 13, '0') || '-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS stream_id FROM documents""",
    "dense_topk": f"""WITH q AS (SELECT {_DENSE} AS q), e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT vec_id, list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q))) AS s FROM e, q) SELECT vec_id, round(s, 6) AS score FROM s WHERE s >= 0.05 ORDER BY s DESC, vec_id LIMIT 20""",
    "tier_boost": f"WITH {_BOOST} SELECT query, pos, CAST(rank AS INTEGER) AS rank, round(boosted, 9) AS boosted FROM k WHERE rank <= 40",
    "lane_merge": f"""WITH {_BOOST}, n AS (SELECT *, row_number() OVER (PARTITION BY query, lane ORDER BY rank) AS n FROM k), c AS (SELECT *, max(CASE WHEN lane = 'realtime' THEN 1 ELSE 0 END) OVER (PARTITION BY query) AS live FROM n)
SELECT query, pos, CAST(row_number() OVER (PARTITION BY query ORDER BY lane = 'realtime', rank) AS INTEGER) AS place, lane FROM c WHERE (lane = 'realtime' AND n <= 1) OR (lane <> 'realtime' AND n <= 5 - live)""",
    "rerank_pool": f"WITH {_POOL} SELECT query, pos, CAST(row_number() OVER (PARTITION BY query ORDER BY credibility * 3 - score DESC, pos) AS INTEGER) AS rank FROM p QUALIFY rank <= 10",
    "judge_metrics": """WITH c AS (SELECT count(*) FILTER (WHERE n_chars >= 300 AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars >= 300 AND quality <> 1) AS fp, count(*) FILTER (WHERE n_chars < 300 AND quality = 1) AS fn, count(*) FILTER (WHERE n_chars < 300 AND quality <> 1) AS tn FROM labels JOIN documents USING (doc_id))
SELECT *, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round((tp + fp)::DOUBLE / (tp + fp + fn + tn), 6) AS approval_rate, tp + fp > 0 AND round(tp::DOUBLE / (tp + fp), 6) >= 0.9 AS go FROM c""",
    "lane_coverage": """WITH c AS (SELECT lang, count(*) AS total, count(*) FILTER (WHERE n_chars < 100) AS tiny, count(*) FILTER (WHERE n_chars >= 100 AND n_chars < 1000) AS short, count(*) FILTER (WHERE n_chars >= 1000 AND n_chars < 10000) AS normal, count(*) FILTER (WHERE n_chars >= 10000) AS long FROM documents GROUP BY lang)
SELECT *, tiny::DOUBLE / total <= 0.05 AS publishable FROM c""",
    "report_messages": "SELECT conv_id, max(turn) + 1 AS next, count(*) AS n FROM conversations GROUP BY conv_id",
}
