"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

FILTER_AUDIT = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM docs GROUP BY text),
marks AS (SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, [len(words) < 100,
         100 * len(list_distinct(words)) < 80 * len(words),
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
         regexp_matches(text, '[#$%&*|]'),
         coalesce(doc_id > least, false)] AS failed,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM docs JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, failed, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(generate_series(1, 5))::INT AS step FROM orders),
met AS (
  SELECT part, filter_order, step, n, good, toxic,
         failed[ascii(filter_order[step]) - 64] AS fails,
         len(list_filter(range(1, step), lambda k: failed[ascii(filter_order[k]) - 64])) > 0 AS gone,
         len(list_filter(failed, lambda f: f)) = 1 AS once
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step,
         coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails AND once), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM counted
"""

#: All 50-byte strings, their least document, and islands of covered positions; bytes as hex pairs.
SUFFIX_REPEATS = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (
  SELECT doc_id, first, substr(h, 2 * first + 1, 2 * (128 + 49)) AS piece
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 128)) AS first FROM docs)),
windows AS (
  SELECT doc_id, first + k AS place, md5_number(substr(piece, 2 * k + 1, 100)) AS w
  FROM (SELECT doc_id, first, piece, unnest(range(0, length(piece) // 2 - 49)) AS k FROM pieces)),
firsts AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
starts AS (
  SELECT doc_id, place, coalesce(place > lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 50, true) AS fresh
  FROM windows JOIN firsts USING (w) WHERE doc_id > least),
islands AS (
  SELECT doc_id, island, min(place) AS lo, max(place) + 50 AS hi
  FROM (SELECT doc_id, place, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY place) AS island FROM starts)
  GROUP BY ALL),
cuts AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM islands),
kept AS (
  SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo)
           || substr(any_value(h), 2 * max(hi) + 1) AS rest
  FROM cuts JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

#: All pairs of different sets that share a shingle, and every document that links reach.
NEAR_DUPLICATES = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE
    WHEN len(words) = 0 THEN []
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct([array_to_string(words[k:k + 3], ' ') FOR k IN range(1, len(words) - 2)])) END AS s
  FROM worded),
same AS (
  SELECT doc_id, s, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS least FROM sets),
parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM same WHERE doc_id = least),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM parts a JOIN parts b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT DISTINCT least AS node, least AS other FROM same
  UNION SELECT node, b FROM reach JOIN links ON a = other),
roots AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM same JOIN roots ON node = least
"""


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Complete scans in every round, by the definition."""
    steps = [f"""
kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, embedding, len(embedding) // {parts} AS width
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (
  SELECT row, part, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding[part * width + 1:(part + 1) * width]] AS v
  FROM kept, range({parts}) AS p(part)),
book0 AS (SELECT part, row - 1 AS entry, v FROM cut WHERE row <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""
code{k} AS (
  SELECT row, part, any_value(c.v) AS v, min(gap * {entries} + entry) % {entries} AS entry, min(gap) AS gap
  FROM (SELECT row, c.part, c.v, entry, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(c.v, b.v)])::BIGINT AS gap
        FROM cut c JOIN book{k} b ON c.part = b.part) c
  GROUP BY row, part)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (
  SELECT part, entry, list(m ORDER BY place) AS v
  FROM (SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m
        FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM code{k}) GROUP BY ALL)
  GROUP BY ALL),
book{k + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))""")
    return f"""
WITH {",".join(steps)},
coded AS (
  SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error FROM code{rounds} GROUP BY row),
named AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS name
          FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM book{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, name AS codebooks_sha256
FROM coded JOIN kept USING (row), named
"""
