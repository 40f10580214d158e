"""The registered queries of these operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemill.llm.backoff_lm import scores
from phasemill.llm.burst_trie import grafted_trie, with_digests
from phasemill.llm.deobfuscate import toxicity
from phasemill.llm.gam import quality
from phasemill.llm.hard_negatives import hard_negatives
from phasemill.llm.html_blocks import extracted
from phasemill.llm.odd_sketch import near_duplicates
from phasemill.llm.paragraph_dedup import repeated_paragraphs, repeated_passages
from phasemill.llm.pfair import mixed
from phasemill.llm.positional_index import contamination, proximity
from phasemill.llm.repetition import RepetitionRules, repetition_coverage
from phasemill.llm.run_length_index import repeated_bytes
from phasemill.llm.url_rules import RULES_SCHEMA, judged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op2_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.filter(~F.col("kept")).select(F.col("doc").alias("doc_id"), "line", F.col("last").alias("last_line"), F.col("first_doc").alias("first_doc_id"), "first_line", F.col("first_last").alias("first_last_line"))


def op2_long_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 words or more only."""
    found = repeated_paragraphs(table(spark, sf_dir, "documents"))
    return found.filter(~F.col("kept")).select(F.col("doc").alias("doc_id"), "line", F.col("first_doc").alias("first_doc_id"), "first_line")


def op3_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


def op4_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition_coverage(table(spark, sf_dir, "documents"))
    shares = [F.element_at("window_shares", i + 1).alias(f"share_{n}") for i, n in enumerate(RepetitionRules().windows)]
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "dup_line_share", *shares)


def op6_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op7_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op10_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Rules of op11: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULES_SCHEMA))


def op12_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_digests(grafted_trie(table(spark, sf_dir, "conversations")))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def op13_residue_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=turned)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_blocks": op1_line_blocks,
    "op2_paragraph_bands": op2_paragraph_bands,
    "op2_long_paragraphs": op2_long_paragraphs,
    "op3_backoff_automaton": op3_backoff_automaton,
    "op4_deobfuscation": op4_deobfuscation,
    "op5_repetition_coverage": op5_repetition_coverage,
    "op6_pfair": op6_pfair,
    "op7_odd_sketch": op7_odd_sketch,
    "op8_positional_index": op8_positional_index,
    "op8_proximity": op8_proximity,
    "op9_run_length_index": op9_run_length_index,
    "op10_additive_model": op10_additive_model,
    "op11_url_expressions": op11_url_expressions,
    "op12_burst_trie": op12_burst_trie,
    "op13_residue_scores": op13_residue_scores,
}

#: Words of one text as DuckDB sees them: runs of bytes that are letters, digits or not ASCII.
_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: w[i : i + 12])) AS win FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i, w FROM d, lens WHERE len(w) >= n),
hits AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.win = dw.w[dw.i : dw.i + dw.n - 1]),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_SPACED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP2_LONG_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, i - 1 AS line, x[i] AS text FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, line) AS id, doc_id, line, w FROM (SELECT doc_id, line, {_SPACED} AS w FROM l) WHERE len(w) >= 20),
s AS MATERIALIZED (SELECT DISTINCT id, unnest(list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM p),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY id),
shared AS (SELECT a.id AS u, b.id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM shared JOIN n x ON x.id = u JOIN n y ON y.id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS MATERIALIZED (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT id AS u, id AS r FROM p UNION SELECT edges.v AS u, reach.r FROM reach JOIN edges ON edges.u = reach.u),
c AS (SELECT u AS id, min(r) AS r FROM reach GROUP BY u)
SELECT p.doc_id, CAST(p.line AS BIGINT) AS line, q.doc_id AS first_doc_id, CAST(q.line AS BIGINT) AS first_line FROM p JOIN c USING (id) JOIN p q ON q.id = c.r WHERE p.id <> c.r
"""

#: Every line with a word, and blocks of adjacent lines under 20 words.
OP2_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, i - 1 AS line, x[i] AS text FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
v AS MATERIALIZED (SELECT doc_id, line, w FROM (SELECT doc_id, line, {_SPACED} AS w FROM l) WHERE len(w) > 0),
b AS (SELECT doc_id, line, w, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM v WHERE len(w) < 20),
e AS (SELECT doc_id, line, line AS last, w FROM v UNION ALL SELECT doc_id, min(line), max(line), flatten(list(w ORDER BY line)) FROM b GROUP BY doc_id, g HAVING count(*) > 1),
p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, line, last) AS id, doc_id, line, last, w FROM e),
s AS MATERIALIZED (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM p),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY id),
shared AS (SELECT a.id AS u, b.id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM shared JOIN n x ON x.id = u JOIN n y ON y.id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS MATERIALIZED (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT id AS u, id AS r FROM p UNION SELECT edges.v AS u, reach.r FROM reach JOIN edges ON edges.u = reach.u),
c AS (SELECT u AS id, min(r) AS r FROM reach GROUP BY u)
SELECT p.doc_id, CAST(p.line AS BIGINT) AS line, CAST(p.last AS BIGINT) AS last_line, q.doc_id AS first_doc_id, CAST(q.line AS BIGINT) AS first_line, CAST(q.last AS BIGINT) AS first_last_line
FROM p JOIN c USING (id) JOIN p q ON q.id = c.r WHERE p.id <> c.r
"""

#: Repeated windows and lines counted as they stand; the verdict from the same limits.
OP5_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT k, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, (VALUES (3), (5), (7), (10)) t(n) WHERE len(w) >= n)),
more AS (SELECT k, n, i FROM win QUALIFY count(*) OVER (PARTITION BY k, n, s) > 1),
hit AS (SELECT DISTINCT k, n, p FROM (SELECT k, n, unnest(range(i, i + n)) AS p FROM more)),
c AS (SELECT k, count(*) FILTER (WHERE n = 3) AS n3, sum(length(w[p])) FILTER (WHERE n = 5) AS c5, sum(length(w[p])) FILTER (WHERE n = 7) AS c7, sum(length(w[p])) FILTER (WHERE n = 10) AS c10 FROM hit JOIN d USING (k) GROUP BY k),
l AS (SELECT k, x[i] AS line, row_number() OVER (PARTITION BY k, x[i] ORDER BY i) AS nth FROM (SELECT k, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT k, string_split(text, chr(10)) AS x FROM d)) WHERE regexp_matches(x[i], '[^\x20\x09-\x0D]')),
ls AS (SELECT k, count(*) AS n_lines, count(*) FILTER (WHERE nth > 1) AS n_dup, coalesce(sum(length(line)) FILTER (WHERE nth > 1), 0) AS dup, sum(length(line)) AS chars FROM l GROUP BY k),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  coalesce(n_dup, 0) AS n_dup_lines, coalesce(n3, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(dup, 0) AS DOUBLE) / greatest(coalesce(chars, 0), 1) AS dup_line_share, coalesce(c5, 0) AS c5, coalesce(c7, 0) AS c7, coalesce(c10, 0) AS c10
  FROM d LEFT JOIN c USING (k) LEFT JOIN ls USING (k)),
r AS (SELECT *, CAST(c5 AS DOUBLE) / greatest(word_chars, 1) AS share_5, CAST(c7 AS DOUBLE) / greatest(word_chars, 1) AS share_7, CAST(c10 AS DOUBLE) / greatest(word_chars, 1) AS share_10, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, dup_line_share, share_5, share_7, share_10,
  NOT base_failed AND dup_line_share <= CAST(0.2 AS DOUBLE) AND n_dup_lines <= 0.5 * n_lines AND n_symbols <= CAST(0.3 AS DOUBLE) * n_words AND share_5 <= CAST(0.3 AS DOUBLE) AND share_7 <= CAST(0.25 AS DOUBLE) AND share_10 <= CAST(0.2 AS DOUBLE) AS kept
FROM r
"""

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, CAST(len(w) - 2 AS BIGINT)), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM shared JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 80 * (x.n + y.n - k)),
edges AS MATERIALIZED (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT doc_id AS u, doc_id AS r FROM d UNION SELECT edges.v AS u, reach.r FROM reach JOIN edges ON edges.u = reach.u)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.r AS component_id, m.r = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u, min(r) AS r FROM reach GROUP BY u) m ON m.u = d.doc_id
"""

#: Texts as hexadecimal digits, two a byte; places count from 0.
OP9_SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 99 AS BIGINT))) AS i FROM d WHERE length(h) >= 200)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
edge AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 100 THEN 0 ELSE 1 END AS new FROM rep WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
num AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edge),
run AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM num GROUP BY doc_id, g),
gap AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS f, a AS t FROM run
  UNION ALL SELECT d.doc_id, coalesce(m.b, 0), length(h) // 2 FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM run GROUP BY doc_id) m USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
cnt AS (SELECT doc_id, count(*) AS n, sum(b - a) AS r FROM run GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN cnt USING (doc_id)
"""

OP11_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS host FROM u),
p AS (SELECT row_number() OVER () AS k, page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(host) + 1), '^[^?#]*') AS path FROM h),
r(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
f AS (SELECT k, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC) AS n
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM f WHERE n = 1) USING (k)
"""

#: crc32 byte by byte and bit by bit; a node is the list of its turns.
OP12_SQL = """
WITH t AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (SELECT conv_id, s, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 9 AS h FROM t),
q AS MATERIALIZED (SELECT a.conv_id AS c, list_concat(coalesce(b.s, [])[1 : a.h], a.s[a.h + 1 :]) AS s FROM crc a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 5),
p AS MATERIALIZED (SELECT c, unnest(range(0, len(s) + 1)) AS d, s FROM q),
m AS MATERIALIZED (SELECT c, d, s[1 : d] AS k, CASE WHEN d > 0 THEN s[1 : d - 1] END AS up, len(s) = d AS ended, CASE WHEN d > 0 THEN octet_length(encode(s[d].t)) ELSE 0 END AS b FROM p),
n AS MATERIALIZED (SELECT k, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ended) AS ends FROM m GROUP BY k, d),
kids AS MATERIALIZED (SELECT up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up),
w AS MATERIALIZED (SELECT n.k, n.d, CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * b AS saved FROM n LEFT JOIN kids ON kids.k = n.k),
sums AS (SELECT a AS k, sum(leaf) AS n_leaves, sum(saved) AS saved FROM (SELECT unnest(list_transform(range(0, d + 1), lambda i: k[1 : i])) AS a, leaf, saved FROM w) GROUP BY a)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN sums ON sums.k = n.k LEFT JOIN n u ON u.k = n.up LEFT JOIN kids ON kids.k = n.k
"""

OP13_SQL = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.n, a.id AS anchor_id, b.n AS m, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.n <> b.n WHERE a.id % 50 = 0),
p AS (SELECT n, anchor_id, m, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.n = p.n AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.n, p.m ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 3
"""

ORACLES: dict[str, str] = {
    "op2_long_paragraphs": OP2_LONG_SQL,
    "op2_paragraph_bands": OP2_SQL,
    "op5_repetition_coverage": OP5_SQL,
    "op7_odd_sketch": OP7_SQL,
    "op8_positional_index": OP8_SQL,
    "op9_run_length_index": OP9_SQL,
    "op11_url_expressions": OP11_SQL,
    "op12_burst_trie": OP12_SQL,
    "op13_residue_scores": OP13_SQL,
}
