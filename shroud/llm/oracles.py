"""DuckDB SQL of the registered operator queries that SQL can express."""

from __future__ import annotations

HAMMING_TOPK = """
WITH parts AS (
  SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), codes AS (
  SELECT vec_id, bit_or(CASE WHEN i <= 64 AND x > 0 THEN (1::UBIGINT << (i - 1)::UBIGINT) ELSE 0::UBIGINT END) AS code
  FROM parts GROUP BY vec_id
  HAVING bool_and(x IS NOT NULL AND isfinite(x)) AND bool_or(x <> 0)
), ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code)) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, c.code)), c.vec_id) AS rank
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM ranked WHERE rank <= 10
"""


#: CRC-32 of a column of words: a table of 256 values, then one step for each byte.
CRC_TABLE = """crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, n)) AS tab
)"""
CRC_OF = """xor(4294967295::BIGINT, list_reduce(list_transform(range(octet_length(encode({w}))),
  lambda i: ('0x' || substr(hex(encode({w})), CAST(2 * i + 1 AS BIGINT), 2))::BIGINT),
  lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT))"""

IMPORTANCE = f"""
WITH {CRC_TABLE}, texts AS (
  SELECT 0 AS kind, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT kind, r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts
), features AS (
  SELECT kind, r, unnest(list_concat(w, list_transform(range(greatest(len(w) - 1, 0)), lambda i: w[i + 1] || ' ' || w[i + 2]))) AS f FROM words
), distinct_features AS (SELECT DISTINCT f FROM features
), bucketed AS (SELECT f, {CRC_OF.format(w="f")} % 10000 AS bucket FROM distinct_features, crc
), placed AS (SELECT kind, r, bucket FROM features JOIN bucketed USING (f)
), counts AS (
  SELECT bucket, count(*) FILTER (kind = 0) AS s, count(*) FILTER (kind = 1) AS t FROM placed GROUP BY bucket
), totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM counts, totals
), weights AS (
  SELECT r, count(*) AS n, sum(gain) AS g FROM placed JOIN gains USING (bucket) WHERE kind = 0 GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(CAST(floor(g / n) AS BIGINT), 0) AS weight,
    ('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h
  FROM words LEFT JOIN weights USING (r) WHERE kind = 0
), final AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored
), placed_rank AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id ASC NULLS LAST) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS able FROM final
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN n_words >= 20 AND place <= able * 25 // 100 THEN CAST(place AS BIGINT) END AS rank FROM placed_rank
"""


MINHASH = """
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END) AS s FROM docs
), classes AS (
  SELECT s, row_number() OVER () AS c, low FROM (SELECT s, min(doc_id) AS low FROM sets WHERE len(s) > 0 GROUP BY s)
), items AS (SELECT c, len(s) AS n, unnest(s) AS x FROM classes
), links AS (
  SELECT a.c AS u, b.c AS v FROM items a JOIN items b USING (x) WHERE a.c <> b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(c, d) AS (
  SELECT c, c FROM classes UNION SELECT reach.c, links.v FROM reach JOIN links ON links.u = reach.d
), lowest AS (SELECT reach.c, min(low) AS component_id FROM reach JOIN classes ON classes.c = reach.d GROUP BY reach.c)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id,
  coalesce(doc_id = CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END, false) AS kept
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN lowest ON lowest.c = classes.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_minhash_dedup": MINHASH, "op4_hamming_topk": HAMMING_TOPK, "op11_importance_resampling": IMPORTANCE}
