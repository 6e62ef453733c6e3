"""The registered queries over the text tables, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm import (
    decontam,
    embedding_dedup,
    langid,
    line_dedup,
    merkle,
    pieces,
    quality,
    rotated_codes,
    secret_scan,
    source_divergence,
    simhash,
    substring_dedup,
    token_counts,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_report(_table(spark, folder, "documents"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(_table(spark, folder, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(_table(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each length that occurs, with what holds for a context limit of that length."""
    return token_counts.with_sums(token_counts.histogram(_table(spark, folder, "documents")))


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and digest of the decoded text; ``round_trip`` tells whether that is the text again."""
    docs = _table(spark, folder, "documents")
    return pieces.encode(docs, compared=True).select(
        "doc_id", "n_pieces", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip"
    )


def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, folder, "embeddings"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The digest columns; the removed stretches are in the operator's own report."""
    return substring_dedup.report(_table(spark, folder, "documents")).drop("spans")


def op11_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every twentieth vector by id."""
    return rotated_codes.nearest(_table(spark, folder, "embeddings"), "vec_id % 20 = 0")


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.report(_table(spark, folder, "documents"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence.audit(_table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_classifier,
        op2_line_dedup,
        op3_language_id,
        op4_simhash_near_dedup,
        op5_secret_scan,
        op6_decontamination,
        op7_token_counts,
        op8_sentencepiece,
        op9_embedding_near_dedup,
        op10_substring_dedup,
        op11_nearest_neighbours,
        op12_merkle_manifest,
        op13_source_divergence,
    )
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": _LINE_DEDUP,
        "op6_decontamination": _DECONTAMINATION,
        "op9_embedding_near_dedup": _EMBEDDING_NEAR_DEDUP,
        "op10_substring_dedup": _SUBSTRING_DEDUP,
        "op11_nearest_neighbours": _NEAREST_NEIGHBOURS,
        "op12_merkle_manifest": _MERKLE_MANIFEST,
        "op13_source_divergence": _SOURCE_DIVERGENCE,
    }


_LINE_DEDUP = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split
), common AS (
  SELECT key, max(doc_id) AS keeper
  FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_DECONTAMINATION = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, size, array_to_string(words[s:s + size - 1], ' ') AS passage
  FROM (SELECT item, words, least(len(words), 13) AS size, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS s
        FROM items WHERE len(words) > 0)
), passages AS (
  SELECT DISTINCT r, s, size, array_to_string(words[s:s + size - 1], ' ') AS passage
  FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS s
        FROM split JOIN (SELECT DISTINCT size FROM windows) ON len(words) >= size)
), found AS (
  SELECT r, s, size, item FROM passages JOIN windows USING (size, passage)
), hit AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(s, s + size)) AS k FROM found) GROUP BY r
), own AS (
  SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, len(words) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(words) AS contaminated
FROM split LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""

_EMBEDDING_NEAR_DEDUP = r"""
WITH RECURSIVE sound AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (
  SELECT a AS node, b AS other FROM links
  UNION
  SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a
), least AS (
  SELECT node, min(other) AS other FROM reached GROUP BY node
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links,
       least(e.vec_id, coalesce(m.other, e.vec_id))::BIGINT AS component_id,
       least(e.vec_id, coalesce(m.other, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN least m ON m.node = e.vec_id
"""

_SUBSTRING_DEDUP = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), windows AS (
  SELECT r, s, array_to_string(words[s:s + 34], ' ') AS stretch
  FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS s FROM split)
), repeated AS (
  SELECT stretch FROM windows GROUP BY stretch HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT r, unnest(range(s, s + 35)) AS k
  FROM windows SEMI JOIN repeated USING (stretch)
), kept AS (
  SELECT w.r, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.k) AS text
  FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM split) w
  ANTI JOIN covered c ON c.r = w.r AND c.k = w.k
  GROUP BY w.r
)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, (len(s.words) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.r = s.r
"""

_NEAREST_NEIGHBOURS = r"""
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v
  FROM embeddings
  WHERE len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM (SELECT DISTINCT * FROM sound WHERE vec_id % 20 = 0) q
  JOIN sound c ON len(q.v) = len(c.v) AND c.vec_id IS DISTINCT FROM q.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""

_MERKLE_MANIFEST = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b:
           list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS step
), leaves AS (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''),
                       lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])),
                       4294967295) % 3 = 0
              THEN sha256(head || coalesce(strlen(text) || ':' || translate(text,
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM (
    SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
              || coalesce(strlen(lang) || ':' || lang, '-')
              || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
    FROM documents
  ), crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, place, leaf AS node, n FROM placed
  UNION ALL
  SELECT lang, level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (n + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY lang, level, place // 8, n
), subroots AS (
  SELECT lang, node, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place, node, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (n + 7) // 8
  FROM tops WHERE n > 1 GROUP BY level, place // 8, n
), runs AS (
  SELECT lang, level, place // 8 AS run, list(node ORDER BY place) AS run_nodes FROM nodes WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT level, place // 8 AS run, list(node ORDER BY place) AS run_nodes FROM tops WHERE n > 1 GROUP BY ALL
), low AS (
  SELECT r, lang, 0 AS level, place, '' AS proof, coalesce(changed, leaf) AS folded FROM placed
  UNION ALL
  SELECT l.r, l.lang, l.level + 1, l.place // 8,
         l.proof || coalesce(list_aggregate(run_nodes[:l.place % 8], 'string_agg', ''), '')
                 || coalesce(list_aggregate(run_nodes[l.place % 8 + 2:], 'string_agg', ''), ''),
         sha256(list_aggregate(list_transform(run_nodes,
                  lambda x, k: CASE WHEN k = l.place % 8 + 1 THEN l.folded ELSE x END), 'string_agg', ''))
  FROM (SELECT *, place // 8 AS run FROM low) l
  JOIN runs u ON u.lang IS NOT DISTINCT FROM l.lang AND u.level = l.level AND u.run = l.run
), subfolded AS (
  SELECT r, lang, proof, folded FROM low QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1
), high AS (
  SELECT f.r, 0 AS level, s.place, f.proof, f.folded
  FROM subfolded f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang
  UNION ALL
  SELECT l.r, l.level + 1, l.place // 8,
         l.proof || coalesce(list_aggregate(run_nodes[:l.place % 8], 'string_agg', ''), '')
                 || coalesce(list_aggregate(run_nodes[l.place % 8 + 2:], 'string_agg', ''), ''),
         sha256(list_aggregate(list_transform(run_nodes,
                  lambda x, k: CASE WHEN k = l.place % 8 + 1 THEN l.folded ELSE x END), 'string_agg', ''))
  FROM (SELECT *, place // 8 AS run FROM high) l JOIN top_runs u ON u.level = l.level AND u.run = l.run
), done AS (
  SELECT r, proof, folded FROM high QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1
)
SELECT p.doc_id, p.leaf, s.node AS subroot, t.node AS root, sha256(d.proof) AS proof_sha256,
       d.folded AS folded_root, d.folded = t.node AS verified
FROM placed p JOIN done d USING (r) JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
CROSS JOIN (SELECT node FROM tops WHERE n = 1) t
"""

_SOURCE_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), occurrences AS (
  SELECT r, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term FROM occurrences GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), counted AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n
  FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
  SELECT g.lang, g.source, coalesce(v.v, 0)::HUGEINT AS v, coalesce(c.n, 0)::HUGEINT AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counted GROUP BY lang, source) c USING (lang, source)
), lang_terms AS (
  SELECT lang, term, (1 + 1000000000 * (sum(n) + 5)
           // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)))::BIGINT AS q
  FROM counted GROUP BY lang, term
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         (1 + 1000000000 * (coalesce(c.n, 0) + 5) // (s.n + 5 * s.v))::BIGINT AS p
  FROM sizes s JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY a.lang, a.source, b.source
), terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p - q AS value
  FROM shares s JOIN lang_terms USING (lang, term) WHERE s.n > 0 AND s.p > q
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
      FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= 50
"""
