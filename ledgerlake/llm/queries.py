"""Queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, chat_format, decontaminate, html_extract, language, mixing, near_dedup, piece_sampling, prefix_trie, quality_model, quality_rules, sharding, toxicity
from .common import bound_batches, read_table

Query = Callable[[SparkSession, str], DataFrame]


def _bounded(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_rules.apply_quality_rules(docs, quality_rules.fit_rules(docs, read_table(spark, sf_dir, "labels")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.predict_language(docs, language.fit_language(docs))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_layout(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_model.score_quality(docs, quality_model.fit_ensemble(docs, read_table(spark, sf_dir, "labels")))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), near_dedup.plan_for(3, 85))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(read_table(spark, sf_dir, "conversations"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_segmentations(read_table(spark, sf_dir, "documents"), piece_sampling.load_pieces())


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(read_table(spark, sf_dir, "conversations"))


def base_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 counts before its rules, for which there is SQL."""
    counted = quality_rules.apply_quality_rules(read_table(spark, sf_dir, "documents"), [])
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def queries() -> dict[str, Query]:
    return {f.__name__: _bounded(f) for f in (op1_toxicity, op2_decontamination, op3_quality_rules, op4_language, op5_html, op6_sharding, op7_quality, op8_near_duplicates, op9_chat, op10_pieces, op11_centroids, op12_mixing, op13_prefix_trie, base_text_counts)}


_OP8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS start, b AS node FROM both_ways UNION SELECT r.start, e.b FROM reach r JOIN both_ways e ON r.node = e.a
), least AS (
  SELECT start, min(node) AS node FROM reach GROUP BY start
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.node, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(l.node, s.doc_id)) AS kept
FROM sets s LEFT JOIN least l ON l.start = s.doc_id
"""

_OP9 = """
SELECT conv_id, turn, role, CAST(0 AS INTEGER) AS n_calls, CAST(0 AS INTEGER) AS n_linked, CAST(0 AS INTEGER) AS n_invalid,
  '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"turn":' || CAST(turn AS VARCHAR) || '}' AS message
FROM conversations
"""


#: crc32 by its rule: a table of 256 entries, then byte by byte.
_CRC_TABLE = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""

#: Shards by the greatest first 52 bits of an md5.
_OP6 = _CRC_TABLE + """, texts AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents
), sums AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM texts, crc_table
), bids AS (
  SELECT doc_id, s, substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13) AS bid FROM (SELECT DISTINCT doc_id FROM documents), range(25) r(s)
), won AS (
  SELECT doc_id, arg_max(s, (bid, s)) FILTER (s < 24) AS shard, arg_max(s, (bid, s)) AS grown_shard FROM bids GROUP BY doc_id
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(doc_id || ' ' || size || ' ' || crc), 1, 3), doc_id, size, crc) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM sums JOIN won USING (doc_id)
"""


_BASE = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), again AS (
  SELECT row, g FROM windows GROUP BY row, g HAVING count(*) > 1
), covered AS (
  SELECT row, count(DISTINCT i + k) AS n FROM windows JOIN again USING (row, g), range(3) r(k) GROUP BY row
), lines AS (
  SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words
)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM words JOIN lines USING (row) LEFT JOIN covered USING (row)
"""


#: Sources reach their bound in the order of bound by weight, so the level is found in one pass; rows are sorted by their hash.
_OP12 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, left(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 16) AS mark FROM documents
), sources AS (
  SELECT source, n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM (SELECT source, sum(size)::BIGINT AS n FROM sized GROUP BY source)
), levels AS (
  SELECT *, (sum(n) OVER () - coalesce(sum(3 * n) OVER before, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS level, row_number() OVER (ORDER BY 3 * n / w, source NULLS LAST) AS k
  FROM sources WINDOW before AS (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT arg_min(level, k) AS level FROM levels WHERE NOT (3 * n)::DOUBLE < level * w
), targets AS (
  SELECT source, n AS source_size, least(coalesce(level, 0) * w, (3 * n)::DOUBLE) AS target FROM sources, filled
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM targets
), upto AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.copies, p.target - p.copies * p.source_size AS rest, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mark ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (size * (copies + CASE WHEN size > 0 AND rest > 0 AND (upto <= rest OR 2 * (rest - (upto - size)) > size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM upto
"""


def _op11(rounds: int = centroids.ROUNDS) -> str:
    """Every vector against every centroid, a chain of common tables for each round."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT k.vec_id, k.v, m.c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - m.v[i]) * (k.v[i] - m.v[i]))) AS d FROM kept k, m{r} m) GROUP BY vec_id, v)"""
    moved = """m{n} AS MATERIALIZED (
  SELECT m.c, coalesce(f.v, m.v) AS v FROM m{r} m LEFT JOIN (
    SELECT c, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM (
      SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) r(i) GROUP BY c, i) GROUP BY c) f USING (c))"""
    steps = [x.format(r=r, n=r + 1) for r in range(rounds) for x in (nearest, moved)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept ORDER BY 1 LIMIT {centroids.CLUSTERS}
), {", ".join(steps)}, {nearest.format(r=rounds)}
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN m{rounds} m USING (c)"""


#: A node is the text of all digests of its turns; sums go from each node, by its smallest member, to the prefixes of that.
_OP13 = _CRC_TABLE + """, turns AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS k FROM (
    SELECT conv_id AS c, turn, md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) AS digest, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT c, n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda r, x: xor(r >> 8, t[(xor(r, x) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), crc_table
), rebuilt AS (
  SELECT v.c, k AS pos, digest, bytes FROM convs v JOIN turns t ON t.c = v.c - v.c % 5 WHERE k <= h
  UNION ALL SELECT v.c, least(v.h, coalesce(b.n, 0)) + k - v.h, digest, bytes FROM convs v LEFT JOIN convs b ON b.c = v.c - v.c % 5 JOIN turns t ON t.c = v.c WHERE k > v.h
  UNION ALL SELECT c, 0, '', 0 FROM convs
), paths AS (
  SELECT c, pos, bytes, string_agg(digest, '') OVER (PARTITION BY c ORDER BY pos) AS path, pos = max(pos) OVER (PARTITION BY c) AS ends FROM rebuilt
), nodes AS (
  SELECT path, pos AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM paths GROUP BY path, pos
), children AS (
  SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), sums AS (
  SELECT p.path, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved FROM nodes n LEFT JOIN children k USING (path) JOIN paths p ON p.c = n.conv_id AND p.pos <= n.depth GROUP BY p.path
)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (path) LEFT JOIN children k USING (path) LEFT JOIN nodes u ON n.depth > 0 AND u.path = left(n.path, length(n.path) - 32)
"""


def oracle_sql() -> dict[str, str]:
    """op8 by all pairs and a recursive closure. op9 for tables without tool messages, which the given ones are."""
    return {"base_text_counts": _BASE, "op6_sharding": _OP6, "op8_near_duplicates": _OP8, "op9_chat": _OP9, "op11_centroids": _op11(), "op12_mixing": _OP12, "op13_prefix_trie": _OP13}
