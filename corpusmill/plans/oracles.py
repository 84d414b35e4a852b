"""SQL that recomputes the registered queries from the same tables."""

from __future__ import annotations

from corpusmill.plans.bindings import EDIT_LINE
from corpusmill.schema import (
    CHUNK_MAX_CHARS,
    CHUNK_MIN_CHARS,
    DOCUMENT_MAX_TOKENS,
    EMBED_DIM,
    EXCLUDED_DIRS,
    PAIR_MAX_TOKENS,
)

PATH = ("'corpus/' || source || '/' || lang || '/doc_' || doc_id || "
        "CASE lang WHEN 'en' THEN '.ts' WHEN 'fr' THEN '.go' ELSE '.tsx' END")
LANGUAGE = "CASE lang WHEN 'fr' THEN 'go' ELSE 'typescript' END"
TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"
KEYS = "id, filepath, start_line, end_line, node_type, language, text_hash"

NODE = "'document' AS node_type, 1 AS base"
FILES = f"""files AS (
  SELECT doc_id AS nid, {PATH} AS filepath, {LANGUAGE} AS language, {NODE}, text AS code
  FROM documents)"""

EDITED = f"""edited AS (
  SELECT 'd' || doc_id AS nid, {PATH} AS filepath, {LANGUAGE} AS language, {NODE},
         CASE WHEN quality = 0 THEN text || chr(10) || '{EDIT_LINE}' ELSE text END AS code
  FROM documents LEFT JOIN labels USING (doc_id)
  WHERE NOT (coalesce(toxic, 0) = 1 AND coalesce(quality, 0) = 1)
  UNION ALL
  SELECT 'c' || conv_id || '_' || turn, 'corpus/chat/' || role || '/conv_' || conv_id || '_'
    || turn || '.ts', 'typescript', 'document', 1, text
  FROM conversations)"""


COMMENT = "'{0}// ' || replace(text, chr(10), chr(10) || '{0}// ')"
N_LINES = "(length(text) - length(replace(text, chr(10), '')) + 1)"
TS_FUNCTION = (f"'function doc_' || doc_id || '() {{' || chr(10) || {COMMENT.format('  ')}"
               " || chr(10) || '}'")
GO_FUNCTION = (f"'func Doc' || doc_id || '() {{' || chr(10) || {COMMENT.format(chr(9))}"
               " || chr(10) || '}'")

# The declarations each generated source file holds, with their first lines.
DECLARED = f"""ts AS (SELECT *, {N_LINES} AS n FROM documents WHERE lang <> 'fr'),
go AS (SELECT *, {N_LINES} AS n FROM documents WHERE lang = 'fr'),
declared AS (
  SELECT nid || doc_id AS nid, {PATH} AS filepath, {LANGUAGE} AS language, node_type, base, code
  FROM (
    SELECT *, 'e' AS nid, 'export_statement' AS node_type, 4 AS base,
      'export ' || {TS_FUNCTION} AS code FROM ts
    UNION ALL SELECT *, 'f', 'function_declaration', 4, {TS_FUNCTION} FROM ts
    UNION ALL SELECT *, 'i', 'interface_declaration', 7 + n, 'interface Row' || doc_id || ' {{'
      || chr(10) || '  lang: string;' || chr(10) || '  chars: number;' || chr(10) || '}}' FROM ts
    UNION ALL SELECT *, 'a', 'arrow_function', 12 + n,
      '(scale: number) => scale * ' || n_chars FROM ts
    UNION ALL SELECT *, 'p', 'method_definition', 15 + n, 'protected async load' || doc_id
      || '(scale: number): Promise<void> {{' || chr(10) || '    await scale;' || chr(10) || '  }}' FROM ts
    UNION ALL SELECT *, 'c', 'class_declaration', 20 + n, 'class Store' || doc_id || ' {{'
      || chr(10) || '  rows = ' || n_chars || ';' || chr(10) || '}}' FROM ts
    UNION ALL SELECT *, 'n', 'type_alias_declaration', 24 + n,
      'type Name' || doc_id || ' = string | number;' FROM ts
    UNION ALL SELECT *, 'h', 'arrow_function', 26 + n, '(x) => x + ' || n_chars FROM ts
    UNION ALL SELECT *, 't', 'type_declaration', 3, 'type Row' || doc_id || ' struct {{'
      || chr(10) || chr(9) || 'Lang string // {{' || chr(10) || '}}' FROM go
    UNION ALL SELECT *, 'g', 'function_declaration', 7, {GO_FUNCTION} FROM go
    UNION ALL SELECT *, 'm', 'method_declaration', 10 + n,
      'func (r Row' || doc_id || ') Size() int {{ return ' || n_chars || ' }}' FROM go))"""


def chunk_ctes(files: str, out: str, split_all: bool = False) -> str:
    """CTEs that chunk ``files`` (nid, filepath, language, node_type, base, code)."""
    over = f"f.size + 1 + l.len >= {CHUNK_MAX_CHARS}"
    lone = f"l.len >= {CHUNK_MAX_CHARS}"
    size = "length('// File: ' || filepath || chr(10) || code)"
    packed = "true" if split_all else f"{size} > {CHUNK_MAX_CHARS}"
    whole = f"NOT ({packed}) AND {size} >= {CHUNK_MIN_CHARS}"
    zero = "0::BIGINT"
    return f"""
{out}_list AS (SELECT *, string_split(code, chr(10)) AS ls FROM {files} WHERE {packed}),
{out}_lines AS (
  SELECT nid, unnest(range(1, len(ls) + 1)) AS i, length(unnest(ls)) AS len FROM {out}_list),
{out}_fold(nid, i, first, n, size, c_first, c_n, c_size) AS (
  SELECT nid, {zero}, {zero}, {zero}, {zero}, {zero}, {zero}, {zero} FROM {out}_list
  UNION ALL
  SELECT l.nid, l.i,
    CASE WHEN f.n = 0 AND {lone} THEN l.i WHEN f.n = 0 OR {over} THEN l.i - 1 ELSE f.first END,
    CASE WHEN f.n = 0 AND {lone} THEN 0 WHEN f.n = 0 OR {over} THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n = 0 AND {lone} THEN 0 WHEN f.n = 0 OR {over} THEN l.len
         ELSE f.size + 1 + l.len END,
    CASE WHEN f.n = 0 THEN l.i - 1 ELSE f.first END,
    CASE WHEN f.n = 0 AND {lone} THEN 1 WHEN f.n > 0 AND {over} THEN f.n ELSE 0 END,
    CASE WHEN f.n = 0 THEN l.len ELSE f.size END
  FROM {out}_fold f JOIN {out}_lines l ON l.nid = f.nid AND l.i = f.i + 1),
{out}_cut AS (
  SELECT nid, c_first AS first, c_n AS n, c_size AS size FROM {out}_fold WHERE c_n > 0
  UNION ALL
  SELECT f.nid, f.first, f.n, f.size
  FROM {out}_fold f JOIN {out}_list s ON f.nid = s.nid AND f.i = len(s.ls)
  WHERE f.n > 0),
{out}_code AS (
  SELECT s.filepath, s.language, s.node_type, (s.base + c.first)::INTEGER AS start_line,
         (s.base + c.first + c.n - 1)::INTEGER AS end_line,
         array_to_string(list_slice(s.ls, c.first + 1, c.first + c.n), chr(10)) AS code
  FROM {out}_cut c JOIN {out}_list s ON c.nid = s.nid
  WHERE c.size >= {CHUNK_MIN_CHARS}
  UNION ALL
  SELECT filepath, language, node_type, base::INTEGER,
         (base + length(code) - length(replace(code, chr(10), '')))::INTEGER, code
  FROM {files} WHERE {whole}),
{out}_text AS (
  SELECT filepath, language, start_line, end_line, node_type,
         '// File: ' || filepath || chr(10) || code AS text FROM {out}_code),
{out} AS (
  SELECT md5(md5(text) || '|' || start_line || '|' || end_line || '|' || node_type) AS id,
         text, filepath, start_line, end_line, node_type, language, md5(text) AS text_hash
  FROM {out}_text)"""


def over_chunks(select: str, split_all: bool = False) -> str:
    return f"WITH RECURSIVE {FILES}, {chunk_ctes('files', 'chunks', split_all)} {select}"


def dedup(source: str) -> str:
    return f"""SELECT * FROM {source} QUALIFY row_number() OVER (
      PARTITION BY text_hash ORDER BY filepath, start_line, end_line, node_type, id) = 1"""


def over_both(select: str) -> str:
    """Chunks before (``old``) and after (``new``) the change, deduplicated."""
    return f"""WITH RECURSIVE {FILES}, {EDITED}, {chunk_ctes('files', 'chunks')},
{chunk_ctes('edited', 'later')},
old AS ({dedup('chunks')}), new AS ({dedup('later')}) {select}"""


RAW_TREE = f"""tree AS (
  SELECT replace({PATH}, '/', chr(92)) AS filepath, text AS content FROM documents
  UNION ALL SELECT 'corpus/web/page_' || page_id || '.html', html FROM pages
  UNION ALL SELECT 'corpus/chat/' || CASE role WHEN 'assistant' THEN 'node_modules' ELSE role END
    || '/conv_' || conv_id || '_' || turn || '.ts', text FROM conversations)"""

BARE = f"""bare AS (
  SELECT *, md5(text_hash || '|' || start_line || '|' || end_line || '|' || node_type) AS id FROM (
    SELECT doc_id, text, {PATH} AS filepath, 1 AS start_line,
      (length(text) - length(replace(text, chr(10), '')) + 1)::INTEGER AS end_line,
      'document' AS node_type, {LANGUAGE} AS language, md5(text) AS text_hash FROM documents)),
stored AS (SELECT * FROM bare WHERE doc_id IN (SELECT doc_id FROM labels))"""

NORM = "sqrt(list_sum(list_transform({0}, lambda z: z * z)))"


def unit_ctes(rows: str, key: str, text: str, out: str, dim: int, cap: int | None = None) -> str:
    """CTEs for the hashed encoder: ``out`` holds (key, b, v) of non-zero buckets."""
    tokens = TOKENS.format(text)
    if cap:
        tokens = f"list_slice({tokens}, 1, {cap})"
    return f"""
{out}_tok AS (SELECT {key}, unnest({tokens}) AS t FROM {rows}),
{out}_cnt AS (
  SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS b, count(*) AS c
  FROM {out}_tok GROUP BY ALL),
{out} AS (
  SELECT {key}, b, (c / sqrt(sum(c * c) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS v
  FROM {out}_cnt)"""


def text_hits() -> str:
    """CTEs up to ``hits``: 40 nearest chunks of each benchmark text."""
    return f"""WITH RECURSIVE {FILES}, {chunk_ctes('files', 'chunks')},
{unit_ctes('chunks', 'id', "'passage: ' || text", 'cv', EMBED_DIM)},
{unit_ctes('benchmark', 'item_id', "'query: ' || text", 'qv', EMBED_DIM)},
cn AS (SELECT id, sqrt(sum(v * v)) AS n FROM cv GROUP BY id),
qn AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY item_id),
dots AS (SELECT item_id, id, sum(q.v * c.v) AS d FROM qv q JOIN cv c USING (b) GROUP BY ALL),
scored AS (
  SELECT item_id AS query_id, id, round(d / (qn.n * cn.n), 6) AS score
  FROM dots JOIN qn USING (item_id) JOIN cn USING (id)),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM scored QUALIFY rank <= 40)"""


def jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct({TOKENS.format(a)})", f"list_distinct({TOKENS.format(b)})"
    shared = f"len(list_intersect({x}, {y}))"
    return f"round({shared} / (len({x}) + len({y}) - {shared}), 6)"


def capped_jaccard(a: str, b: str, cap: int) -> str:
    """``jaccard`` of the first ``cap`` words of a pair, the first text going before the second."""
    asked = f"list_slice({TOKENS.format(a)}, 1, {cap})"
    found = f"list_slice({TOKENS.format(b)}, 1, greatest(0, {cap} - len({asked})))"
    x, y = f"list_distinct({asked})", f"list_distinct({found})"
    shared = f"len(list_intersect({x}, {y}))"
    return f"round({shared} / (len({x}) + len({y}) - {shared}), 6)"


def dealt(score: str) -> str:
    """Best eight of the documents that a hash deals to each benchmark text."""
    return f"""WITH pairs AS (
              SELECT item_id AS query_id, doc_id, doc_id AS candidate_rank, {score} AS rerank_score
              FROM documents d JOIN benchmark ON item_id =
                ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % (SELECT count(*) FROM benchmark))
            SELECT query_id, row_number() OVER (
                PARTITION BY query_id ORDER BY rerank_score DESC, candidate_rank) AS rank,
              candidate_rank, rerank_score, doc_id FROM pairs QUALIFY rank <= 8"""


def split_words(text: str) -> str:
    """Distinct lower-cased words between blanks."""
    parts = f"regexp_split_to_array(lower({text}), '\\s+')"
    return f"list_distinct(list_filter({parts}, lambda w: w <> ''))"


VECTORS = """vecs AS (
  SELECT 'vec_' || vec_id AS id, vec_id, label, embedding::DOUBLE[] AS v,
         CASE WHEN label < 5 THEN 'typescript' ELSE 'go' END AS language FROM embeddings)"""

CENTROIDS = f"""parts AS (
  SELECT label, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM vecs),
means AS (SELECT label, dim, avg(x) AS m FROM parts GROUP BY ALL),
pooled AS (SELECT label, list(m ORDER BY dim) AS mv FROM means GROUP BY label),
cents AS (
  SELECT label AS query_id, list_transform(mv, lambda y: y / nn) AS qv,
    CASE WHEN label > 6 THEN 'go' WHEN label < 3 THEN 'typescript' END AS qlang
  FROM (SELECT *, {NORM.format('mv')} AS nn FROM pooled))"""

COSINE = f"list_dot_product(qv, v) / ({NORM.format('qv')} * {NORM.format('v')})"


def knn(filtered: bool) -> str:
    on = "qlang IS NULL OR qlang = language" if filtered else "true"
    return f"""WITH {VECTORS}, {CENTROIDS},
scored AS (SELECT query_id::BIGINT AS query_id, id, round({COSINE}, 6) AS score
           FROM cents JOIN vecs ON {on})
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank,
       score, id FROM scored QUALIFY rank <= 40"""


def oracle_sql() -> dict[str, str]:
    excluded = ", ".join(f"'{d}'" for d in EXCLUDED_DIRS)
    parts = "string_split(replace(filepath, chr(92), '/'), '/')"
    short = (f"CASE WHEN len({parts}) >= 3 THEN array_to_string({parts}[-3:], '/') "
             "ELSE filepath END")
    per_file = f"""SELECT filepath, min(language) AS language, count(*) AS chunk_count,
        {short} AS short_filepath FROM chunks GROUP BY filepath"""
    hit_rows = text_hits() + """
            SELECT query_id, rank, score, id, filepath, start_line, text_hash
            FROM hits JOIN chunks USING (id)"""
    row = "text, filepath, start_line, end_line, node_type, language, text_hash"
    flat = "replace(text, chr(10), ' ')"
    single = f"CASE WHEN lang = 'en' THEN [upper({PATH})] WHEN lang = 'fr' THEN [{PATH}] END"
    moved = "SELECT DISTINCT filepath FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o " \
        "WHERE o.filepath = n.filepath AND o.text_hash = n.text_hash)"
    upserted = f"""WITH {BARE}, kept AS ({dedup('stored')}), fresh AS ({dedup('bare')})
        SELECT {KEYS} FROM kept UNION ALL
        SELECT {KEYS} FROM fresh WHERE text_hash NOT IN (SELECT text_hash FROM kept)"""
    return {
        "scan_files": f"""WITH {RAW_TREE}
            SELECT replace(filepath, chr(92), '/') AS filepath,
              CASE WHEN filepath LIKE '%.go' THEN 'go' ELSE 'typescript' END AS language,
              length(content)::INTEGER AS chars FROM tree
            WHERE regexp_matches(filepath, '\\.(ts|tsx|go)$')
              AND NOT list_has_any({parts}[2:-2], [{excluded}])""",
        "read_normalize": """SELECT page_id, md5(t) AS content_hash, length(t)::INTEGER AS chars FROM (
            SELECT page_id, replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10))
              || chr(10) || 'x' || chr(65533) || chr(65533) || 'y' || chr(10) || 'z' AS t
            FROM pages)""",
        "project_scan": over_chunks("SELECT language, filepath, node_type FROM chunks"),
        "path_normalize": f"""WITH {RAW_TREE}
            SELECT replace(filepath, chr(92), '/') AS filepath FROM tree""",
        "short_path": f"WITH {RAW_TREE} SELECT filepath, {short} AS short_filepath FROM tree",
        "text_hash": "SELECT doc_id, md5(text) AS text_hash FROM documents",
        "chunk_documents": over_chunks(f"SELECT {KEYS} FROM chunks"),
        "split_long": over_chunks(
            f"SELECT {KEYS}, length(text)::INTEGER AS chars FROM chunks", split_all=True),
        "chunk_code": f"""WITH RECURSIVE {DECLARED}, {chunk_ctes('declared', 'chunks')}
            SELECT {KEYS}, length(text)::INTEGER AS chars FROM chunks""",
        "snippets": over_chunks(f"""SELECT id, {short} AS short_filepath, start_line,
            substr({flat}, 1, 120) AS snippet, substr({flat}, 1, 80) AS hover FROM chunks"""),
        "dedup_chunks": f"WITH {BARE} SELECT {KEYS} FROM ({dedup('bare')})",
        "upsert_chunks": upserted,
        "index_insert": upserted,
        "changed_files": over_both(moved),
        "refresh_index": over_both(f""", moved AS ({moved})
            SELECT {KEYS} FROM old WHERE filepath NOT IN (SELECT filepath FROM moved)
            UNION ALL SELECT {KEYS} FROM new WHERE filepath IN (SELECT filepath FROM moved)"""),
        "refresh_index_strict": over_both(f"SELECT {KEYS} FROM new"),
        "delete_by_filepath": over_chunks(f"""SELECT {KEYS} FROM chunks WHERE filepath NOT IN (
            SELECT {PATH} FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""),
        "deleted_count": over_chunks(f"""SELECT count(*) AS deleted FROM chunks WHERE filepath IN (
            SELECT {PATH} FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""),
        "build_summary": f"""WITH {BARE} SELECT count(DISTINCT filepath) AS files,
            count(*) AS chunks, count(DISTINCT text_hash) FILTER (
              text_hash NOT IN (SELECT text_hash FROM stored)) AS upserted FROM bare""",
        "refresh_summary": over_both(f""", moved AS ({moved})
            SELECT count(DISTINCT filepath) AS files_updated, count(*) AS chunks,
              count(DISTINCT text_hash) AS upserted FROM later
            WHERE filepath IN (SELECT filepath FROM moved)"""),
        "index_build": over_chunks(f"SELECT {KEYS} FROM ({dedup('chunks')})"),
        "index_created": over_chunks(f"""SELECT language, count(*) AS stored, true AS made,
            0::BIGINT AS empty, false AS made_again FROM ({dedup('chunks')}) GROUP BY language"""),
        "path_search": over_chunks(f"""SELECT {row} FROM chunks WHERE contains(filepath, 'src1/')
            ORDER BY filepath, start_line, end_line, text_hash LIMIT 20"""),
        "path_like": over_chunks(f"""SELECT {row} FROM chunks WHERE filepath LIKE '%src1_/e_/doc%'
            ORDER BY filepath, start_line, end_line, text_hash LIMIT 20"""),
        "file_chunks": over_chunks(
            f"SELECT {row} FROM chunks WHERE filepath = 'corpus/src2/en/doc_2.ts'"),
        "file_chunks_partial": over_chunks(
            f"SELECT {row} FROM chunks WHERE contains(filepath, 'src2/en/doc_2')"),
        "index_status": over_chunks("""SELECT 'codebase' AS collection_name,
            count(*) AS total_chunks, 'documents' AS location FROM chunks"""),
        "index_totals": over_chunks("""SELECT count(*) AS total_chunks,
            count(DISTINCT filepath) AS total_files FROM chunks"""),
        "index_stats": over_chunks("""
            SELECT 'language' AS dimension, language AS value, count(*) AS chunks
              FROM chunks GROUP BY language
            UNION ALL SELECT 'node_type', node_type, count(*) FROM chunks GROUP BY node_type
            UNION ALL SELECT 'total', 'all', count(*) FROM chunks"""),
        "top_node_types": over_chunks("""SELECT node_type, count(*) AS chunks FROM chunks
            GROUP BY node_type ORDER BY chunks DESC, node_type LIMIT 10"""),
        "languages_by_size": over_chunks("""SELECT language, count(*) AS chunks FROM chunks
            GROUP BY language ORDER BY chunks DESC, language"""),
        "file_stats": over_chunks(per_file),
        "file_stats_top": over_chunks(
            f"SELECT * FROM ({per_file}) ORDER BY chunk_count DESC, filepath LIMIT 1000"),
        "file_stats_bottom": over_chunks(
            f"SELECT * FROM ({per_file}) ORDER BY chunk_count, filepath LIMIT 1000"),
        "file_filter": over_chunks(
            f"SELECT * FROM ({per_file}) WHERE contains(lower(filepath), 'src1/en')"),
        "l2_normalize": f"""WITH {VECTORS}, scaled AS (
              SELECT vec_id, list_transform(v, lambda x: x * (label + 1)) AS s FROM vecs)
            SELECT vec_id, (unnest(range(1, len(s) + 1)) - 1)::INTEGER AS dim,
              round(unnest(list_transform(s, lambda y: y / nn)), 6) AS value
            FROM (SELECT *, {NORM.format('s')} AS nn FROM scaled)""",
        "mean_pool": f"""WITH {VECTORS}, parts AS (
              SELECT label, unnest(range(0, len(v))) AS dim, unnest(v) AS x FROM vecs WHERE v[1] >= 0)
            SELECT label, dim::INTEGER AS dim, round(avg(x), 6) AS value FROM parts GROUP BY ALL""",
        "cosine_pairs": f"""WITH {VECTORS}, {CENTROIDS}
            SELECT vec_id, label, round({COSINE}, 6) AS score
            FROM vecs JOIN cents ON label = query_id""",
        "knn_search": knn(False),
        "knn_search_filtered": knn(True),
        # Eight bits and twice the candidates, re-scored: the exact result on these vectors.
        "knn_quantized": knn(True),
        "quantize_vectors": f"""WITH {VECTORS}, parts AS (
              SELECT vec_id, unnest(range(0, len(v)))::INTEGER AS dim, unnest(v) AS x FROM vecs),
            bounds AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM parts GROUP BY dim)
            SELECT vec_id, dim, CASE WHEN hi > lo
              THEN floor((x - lo) / (hi - lo) * 255 + 0.5)::INTEGER ELSE 0 END AS code
            FROM parts JOIN bounds USING (dim)""",
        "embed_hash": over_chunks(f""", {unit_ctes(
            'chunks', 'id', "'passage: ' || text", 'cv', EMBED_DIM)}
            SELECT id, b::INTEGER AS dim, round(v, 6) AS value FROM cv"""),
        "embed_truncated": f"""WITH {unit_ctes(
            'documents', 'doc_id', "'passage: ' || text", 'dv', EMBED_DIM, DOCUMENT_MAX_TOKENS)}
            SELECT doc_id, b::INTEGER AS dim, round(v, 6) AS value FROM dv""",
        "knn_text": hit_rows,
        "knn_stored": hit_rows,
        "search_end_to_end": text_hits() + f""", pairs AS (
              SELECT query_id, rank AS candidate_rank, score, id, filepath,
                     {jaccard('benchmark.text', 'chunks.text')} AS rerank_score
              FROM hits JOIN chunks USING (id) JOIN benchmark ON item_id = query_id)
            SELECT query_id, row_number() OVER (
                PARTITION BY query_id ORDER BY rerank_score DESC, candidate_rank) AS rank,
              candidate_rank, score, rerank_score, id, filepath
            FROM pairs QUALIFY rank <= 8""",
        "rerank_model": text_hits() + f""", pairs AS (
              SELECT query_id, rank AS candidate_rank, score, id, filepath,
                     len(list_intersect({split_words('benchmark.text')},
                       {split_words('chunks.text')}))::DOUBLE
                       / len({split_words('benchmark.text')}) AS rerank_score
              FROM hits JOIN chunks USING (id) JOIN benchmark ON item_id = query_id)
            SELECT query_id, row_number() OVER (
                PARTITION BY query_id ORDER BY rerank_score DESC, candidate_rank) AS rank,
              candidate_rank, score, rerank_score, id, filepath
            FROM pairs QUALIFY rank <= 8""",
        "rerank": dealt(jaccard("benchmark.text", "d.text")),
        "rerank_capped": dealt(capped_jaccard("benchmark.text", "d.text", PAIR_MAX_TOKENS)),
        "edited_paths": f"""SELECT CASE lang WHEN 'en' THEN 'Edit' ELSE 'MultiEdit' END AS tool_name,
            unnest({single}) AS filepath FROM documents WHERE lang IN ('en', 'fr')""",
        "stream_refresh": over_both(f""", moved AS ({moved})
            SELECT {KEYS} FROM old WHERE filepath NOT IN (SELECT filepath FROM moved)
            UNION ALL SELECT {KEYS} FROM new WHERE filepath IN (SELECT filepath FROM moved)"""),
        "embed_model": over_chunks("""SELECT id, unnest([0, 1])::INTEGER AS dim,
            round(unnest([(a / n)::FLOAT::DOUBLE, (b / n)::FLOAT::DOUBLE]), 6) AS value FROM (
              SELECT id, a, b, sqrt(a * a + b * b) AS n FROM (
                SELECT id, (length(text) + 9)::DOUBLE AS a,
                  (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS b
                FROM chunks))"""),
        # Two components: the axes are the eigenvectors of a 2 x 2 matrix, the larger loading positive.
        "map_points_plane": over_chunks(f""", vecs AS (
              SELECT *, (a / n)::FLOAT::DOUBLE AS p, (b / n)::FLOAT::DOUBLE AS q FROM (
                SELECT *, sqrt(a * a + b * b) AS n FROM (
                  SELECT *, (length(text) + 9)::DOUBLE AS a,
                    (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS b FROM chunks))),
            turned AS (SELECT avg(p) AS mp, avg(q) AS mq,
              atan2(2 * covar_samp(p, q), var_samp(p) - var_samp(q)) / 2 AS t FROM vecs),
            axes AS (SELECT mp, mq, cos(t) AS c, sin(t) AS s,
              CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sign(cos(t)) ELSE sign(sin(t)) END AS first,
              CASE WHEN abs(sin(t)) >= abs(cos(t)) THEN sign(-sin(t)) ELSE sign(cos(t)) END AS second
              FROM turned)
            SELECT round(first * (c * (p - mp) + s * (q - mq)), 6) + 0.0 AS x,
              round(second * (c * (q - mq) - s * (p - mp)), 6) + 0.0 AS y,
              filepath, {short} AS short_filepath, language, node_type, start_line,
              substr({flat}, 1, 120) AS snippet FROM vecs, axes"""),
        "map_legend": over_chunks("""SELECT language AS color, count(*) AS points
            FROM chunks GROUP BY language"""),
        "map_legend_types": over_chunks("""SELECT node_type AS color, count(*) AS points
            FROM chunks GROUP BY node_type"""),
        "map_saved": over_chunks("SELECT count(*) AS total, 'PCA' AS method FROM chunks"),
        "index_cleared": over_chunks("SELECT count(*) AS stored, 0::BIGINT AS left_over FROM chunks"),
        "ann_ivf": f"""WITH {VECTORS}, {CENTROIDS},
            placed AS (SELECT id, v, language, query_id AS cell FROM vecs, cents
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY {COSINE} DESC, query_id) = 1),
            probes AS (SELECT a.query_id, a.qv, a.qlang, b.query_id AS cell FROM cents a, cents b
              QUALIFY row_number() OVER (PARTITION BY a.query_id
                ORDER BY list_dot_product(a.qv, b.qv) DESC, b.query_id) <= 4),
            scored AS (SELECT query_id::BIGINT AS query_id, id, round({COSINE}, 6) AS score
              FROM probes JOIN placed USING (cell) WHERE qlang IS NULL OR qlang = language)
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank,
              score, id FROM scored QUALIFY rank <= 40""",
    }
