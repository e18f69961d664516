"""The queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, jaccard_join, language_id, license_scan, packing, periodic_runs, phrases, pii, quality, secret_scan, topk_search, url_filter
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation, and the same with its last answer taken from another one."""
    turns = chat_format.swapped_answers(table(spark, sf_dir, "conversations"))
    pairs = chat_format.preference_pairs(turns)
    return pairs.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", chat_format.mask_string("chosen_mask").alias("chosen_mask"), chat_format.mask_string("rejected_mask").alias("rejected_mask"))


_OP1_SQL = """WITH c AS (SELECT conv_id, turn, role, text, coalesce(turn, -9223372036854775808) AS k, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, k, x FROM c WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC, x DESC) = 1),
u AS (SELECT c.conv_id AS pair_id, 0 AS side, c.turn, c.role, c.text FROM c
  UNION ALL SELECT c.conv_id, 1, c.turn, c.role, CASE WHEN c.role = 'assistant' AND c.k = l.k AND c.x = l.x THEN coalesce(o.x, '') ELSE c.text END
  FROM c LEFT JOIN l ON l.conv_id = c.conv_id LEFT JOIN l o ON o.conv_id = xor(c.conv_id, 1)),
t AS (SELECT pair_id, side, replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') AS role, replace(coalesce(text, ''), '<|', '< |') AS body, turn FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, body) AS pos FROM t),
f AS (SELECT *, '<|' || role || '|>' || chr(10) AS head, body || '<|end|>' || chr(10) AS tail FROM r),
d AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(min(coalesce(a.pos, b.pos)) FILTER (WHERE NOT coalesce(a.role = b.role AND a.body = b.body, false)), max(coalesce(a.pos, b.pos)) + 1) - 1 AS prompt_turns
  FROM (SELECT * FROM f WHERE side = 0) a FULL JOIN (SELECT * FROM f WHERE side = 1) b ON a.pair_id = b.pair_id AND a.pos = b.pos GROUP BY 1)
SELECT d.pair_id, CAST(d.prompt_turns AS BIGINT) AS prompt_turns,
  coalesce(string_agg(head || tail, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos <= prompt_turns), '') AS prompt,
  coalesce(string_agg(head || tail, '' ORDER BY pos) FILTER (WHERE side = 0 AND pos > prompt_turns), '') AS chosen,
  coalesce(string_agg(head || tail, '' ORDER BY pos) FILTER (WHERE side = 1 AND pos > prompt_turns), '') AS rejected,
  coalesce(string_agg(length(head) || ',' || CASE WHEN role = 'assistant' THEN '+' ELSE '' END || length(tail), ',' ORDER BY pos) FILTER (WHERE side = 0 AND pos > prompt_turns), '') AS chosen_mask,
  coalesce(string_agg(length(head) || ',' || CASE WHEN role = 'assistant' THEN '+' ELSE '' END || length(tail), ',' ORDER BY pos) FILTER (WHERE side = 1 AND pos > prompt_turns), '') AS rejected_mask
FROM d JOIN f ON f.pair_id = d.pair_id GROUP BY d.pair_id, d.prompt_turns"""


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


_OP3_SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def pack(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, _vocabulary("byte_bpe_50k.json"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP6_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP6_SQL = f"""WITH d AS (SELECT doc_id AS k, {_OP6_WORDS} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS k, {_OP6_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
dt AS (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d), bt AS (SELECT k, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM b),
dw AS (SELECT k, i, list(x) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM dt),
bw AS (SELECT k, least(n, 10) AS m, list(x) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM bt),
p AS (SELECT DISTINCT k AS item, m, array_to_string(l[1:m], ' ') AS s FROM bw WHERE len(l) >= m),
h AS (SELECT dw.k, dw.i, g.m, p.item FROM dw JOIN (SELECT DISTINCT m FROM p) g ON len(dw.l) >= g.m JOIN p ON p.m = g.m AND p.s = array_to_string(dw.l[1:g.m], ' ')),
c AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + m)) AS j FROM h) GROUP BY k),
t AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY k)
SELECT d.k AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.k = d.k LEFT JOIN t ON t.k = d.k"""

_OP8_SQL = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT DISTINCT doc_id, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS s FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT * FROM g WHERE s IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS k, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON r.k = l.a),
m AS (SELECT k, min(c) AS c FROM r GROUP BY k)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.k = d.doc_id"""

# crc32 by its table of 256 entries, which the query makes from the polynomial
_OP11_SQL = r"""WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, lang, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: unicode(x)::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 5 = 0 AS held_out,
  trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) AS s FROM documents, tab),
c AS (SELECT r, lang, held_out, list_transform(string_split(' ' || s || ' ', ''), lambda x: CASE WHEN x = ' ' THEN 0 ELSE unicode(x) END::BIGINT) AS c FROM d WHERE s <> ''),
p AS (SELECT r, lang, held_out, unnest(c) AS a, unnest(c[2:] || [NULL]) AS b, unnest(c[3:] || [NULL, NULL]) AS e FROM c),
g AS (SELECT r, lang, held_out, (a << 42) | 4398044413952 | 2097151 AS g FROM p WHERE a > 0 UNION ALL SELECT r, lang, held_out, (a << 42) | (b << 21) | 2097151 FROM p WHERE b IS NOT NULL UNION ALL SELECT r, lang, held_out, (a << 42) | (b << 21) | e FROM p WHERE e IS NOT NULL AND b > 0),
n AS (SELECT r, lang, held_out, g, count(*) AS n FROM g GROUP BY ALL),
q AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS k FROM (SELECT lang, g, sum(n) AS n FROM n WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL) QUALIFY k < 400),
o AS (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, g) - 1 AS k FROM n QUALIFY k < 400),
m AS (SELECT r, count(*) AS m FROM o GROUP BY r),
f AS (SELECT o.r, q.lang, sum(400 - abs(o.k - q.k)) AS near FROM o JOIN q ON q.g = o.g GROUP BY ALL),
b AS (SELECT m.r, l.lang, coalesce(near, 0) / (400.0::DOUBLE * m) AS score FROM m, (SELECT DISTINCT lang FROM q) l LEFT JOIN f ON f.r = m.r AND f.lang = l.lang QUALIFY row_number() OVER (PARTITION BY m.r ORDER BY coalesce(near, 0) DESC, l.lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN b ON b.r = d.r"""

_OP12_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, {_LOW} AS t FROM documents),
p AS (SELECT d, lang, unnest(q) AS t, generate_subscripts(q, 1) AS p FROM (SELECT d, lang, regexp_split_to_array(t, '[.,;:!?
-
]') AS q FROM d)),
w AS (SELECT row_number() OVER () AS p, lang, list_filter(regexp_split_to_array(t, '[ 	]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w) x, range(1, 6) t(m) WHERE i + m - 1 <= len(w)),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, phrase, m, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f x WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM f y WHERE y.lang = x.lang AND y.m > x.m AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.a >= 100 * x.a)),
k AS (SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS left_part, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS right_part FROM c, range(1, 5) t(k) WHERE k < m),
s AS (SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, n.n, CAST((1000::HUGEINT * k.a * n.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score FROM k JOIN f l ON l.lang = k.lang AND l.phrase = left_part JOIN f r ON r.lang = k.lang AND r.phrase = right_part JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_packing, op3_topk_search, op4_pii, op5_url_filter, op6_decontamination, op7_license_scan, op8_jaccard_join, op9_quality_classifier, op10_secret_scan, op11_language_id, op12_phrase_mining, op13_periodic_runs)}


ORACLE_SQL: dict[str, str] = {"op1_chat_format": _OP1_SQL, "op3_topk_search": _OP3_SQL, "op6_decontamination": _OP6_SQL, "op7_license_scan": license_scan.oracle(), "op8_jaccard_join": _OP8_SQL, "op11_language_id": _OP11_SQL, "op12_phrase_mining": _OP12_SQL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
