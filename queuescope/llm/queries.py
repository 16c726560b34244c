"""The registered query of each operator, over whole tables with production parameters, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from queuescope.llm import (
    bpe, collocations, conversation_trie, html_text, lattice, mixing, phrase_index, quality, quality_rules, simhash, topk,
    toxicity, warc,
)
from queuescope.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_topk": op2_topk,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_text": op6_html_text,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_lattice": op9_lattice,
    "op10_mixing": op10_mixing,
    "op11_collocations": op11_collocations,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_decontamination": op13_decontamination,
}
# Fixed values of both dialects: the white space between words, as a regular expression, and the rules' cutoffs.
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CASES = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_GAP = "[ \\t\\n\\x0B\\f\\r]+"
_CUTS = ", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(quality_rules.CUTOFFS))
_RATE, _LEVEL = quality_rules.MAX_FALSE_REJECTION, quality_rules.ERROR
_RULES = " UNION ALL ".join(
    f"SELECT r, doc_id, stratum, '{rule}' AS rule, {top} / greatest({bottom}, 1)::DOUBLE AS v FROM base WHERE NOT base_failed"
    for rule, (top, bottom) in ((rule, form.split(" / ")) for rule, form in quality_rules.RULES.items())
)

SQL: dict[str, str] = {
    "op2_topk": """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.parts, c.parts)::BIGINT AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM ranked)
WHERE rank <= 5""",
    "op5_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (
  SELECT r, doc_id, stratum, list_filter(regexp_split_to_array(t, '{_GAP}'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls FROM d),
j AS (SELECT *, array_to_string(ws, '') AS joined FROM w),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY r),
measured AS (
  SELECT j.r, doc_id, stratum, len(ws) AS n_words, length(joined) AS word_chars,
         length(joined) - length(regexp_replace(joined, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         length(regexp_replace(joined, '\\P{{Lu}}+', '', 'g')) AS n_capitals
  FROM j LEFT JOIN covered c ON c.r = j.r),
base AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
rules AS MATERIALIZED ({_RULES}),
cuts(place, cutoff) AS (VALUES {_CUTS}),
good AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
tried AS (
  SELECT stratum, rule, cutoff, sum(good)::BIGINT AS n, sum(good) FILTER (WHERE v > cutoff) AS k0,
         sum(1 - good) FILTER (WHERE v > cutoff) AS h0
  FROM rules JOIN good USING (doc_id), cuts GROUP BY stratum, rule, cutoff),
counted AS (
  SELECT stratum, rule, cutoff, n, coalesce(k0, 0)::BIGINT AS k, coalesce(h0, 0)::BIGINT AS hits,
         {_LEVEL} / (SELECT count(DISTINCT stratum) * {len(quality_rules.RULES)} FROM tried) AS level
  FROM tried WHERE n > 0),
tested AS (
  SELECT *, CASE WHEN k >= n * {_RATE} THEN false ELSE list_sum(list_transform(range(0, k + 1), lambda i:
      exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RATE}) + (n - i) * ln(1 - {_RATE})))) <= level END AS passes
  FROM counted),
certified AS (SELECT *, bool_and(passes) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS ok FROM tested),
chosen AS (
  SELECT stratum, rule, cutoff FROM (
    SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY hits - 10 * k DESC, cutoff DESC) AS place
    FROM certified WHERE ok AND hits - 10 * k > 0) WHERE place = 1),
rejected AS (SELECT DISTINCT r FROM rules JOIN chosen USING (stratum, rule) WHERE v > cutoff)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM rejected) AS kept
FROM base""",
    "op7_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, (1 + (i // 4) * 5)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN first USING (h)""",
    "op11_collocations": f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), {_CASES}) AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) v(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS p, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, k, f, c, array_to_string(p[:c], ' ') AS a, array_to_string(p[c + 1 :], ' ') AS b
         FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, cuts.f AS a, x.f AS l, y.f AS r, c,
         ((1000000::HUGEINT * cuts.f * cuts.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.a JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.b),
lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) AS place FROM scored) WHERE place = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, unnest([p[1] || ' ' || p[2], p[2] || ' ' || p[3]]) AS phrase, f FROM candidates WHERE k = 3) GROUP BY lang, phrase),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase WHERE g.f IS NULL OR 100 * g.f < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op12_conversation_trie": """
WITH RECURSIVE crc_table(i, k, v) AS (
  SELECT i, 0, i::BIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM crc_table WHERE k < 8),
steps AS (SELECT list(v ORDER BY i) AS s FROM crc_table WHERE k = 8),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, c:
           xor(s[(xor(a, c) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), steps),
rebuilt AS (
  SELECT i.conv_id, row_number() OVER (PARTITION BY i.conv_id ORDER BY NOT head, place) AS d, role, text FROM (
    SELECT ids.conv_id, true AS head, place, role, text FROM ids JOIN turns t ON t.conv_id = ids.base AND place <= h
    UNION ALL SELECT ids.conv_id, false, place, role, text FROM ids JOIN turns t ON t.conv_id = ids.conv_id AND place > h) i),
keyed AS (SELECT *, md5(length(role) || ':' || role || text) AS k, octet_length(encode(text)) AS b FROM rebuilt),
prefixes AS MATERIALIZED (
  SELECT conv_id, d, b, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS p FROM keyed
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
last AS (SELECT conv_id, max(d) AS d FROM prefixes GROUP BY conv_id),
nodes AS MATERIALIZED (
  SELECT p, x.d, min(x.conv_id) AS conv_id, count(*) AS n, any_value(b) AS b,
         coalesce(string_agg(CASE WHEN l.d = x.d THEN x.conv_id END, ',' ORDER BY x.conv_id), '') AS ends
  FROM prefixes x JOIN last l USING (conv_id) GROUP BY p, x.d),
nodes2 AS (SELECT *, CASE WHEN d > 0 THEN left(p, (32 * (d - 1))::INT) END AS up FROM nodes),
children AS (SELECT up AS p, count(*) AS n FROM nodes2 WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT left(p, (32 * k)::INT) AS p, count(*) FILTER (WHERE leaf) AS leaves, sum((n - 1) * b) AS saved
  FROM (SELECT nodes2.p, nodes2.n, b, c.n IS NULL AS leaf, unnest(range(0, d + 1)) AS k FROM nodes2 LEFT JOIN children c ON c.p = nodes2.p)
  GROUP BY 1)
SELECT x.conv_id, x.d::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes2 x LEFT JOIN nodes2 y ON y.p = x.up LEFT JOIN children c ON c.p = x.p JOIN below ON below.p = x.p""",
    "op13_decontamination": f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_CASES}), '{_LETTERS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_CASES}), '{_LETTERS}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i : i + 9] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(g) AS n FROM windows),
places AS (
  SELECT r, i, n, w[i : i + n - 1] AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths)),
found AS MATERIALIZED (SELECT r, i, n, item_id FROM places JOIN windows USING (g)),
hits AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS k FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found) GROUP BY r),
keyed AS (SELECT *, list_last(list_sort(list_transform(g, lambda x: {{'n': length(x), 'w': x}}))).w AS word FROM windows),
words AS (SELECT r, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
starts AS (
  SELECT r, w, p, g, item_id, unnest(range(greatest(1, p - len(g) - {phrase_index.SLACK} + 1), p + 1)) AS i FROM words JOIN keyed USING (word)),
near AS (
  SELECT r, count(DISTINCT item_id) AS n_near_items FROM starts WHERE list_has_all(w[i : i + len(g) + {phrase_index.SLACK} - 1], g) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN hits USING (r) LEFT JOIN names USING (r) LEFT JOIN near USING (r)""",
}
