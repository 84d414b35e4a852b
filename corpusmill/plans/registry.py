"""Every operator as a named query over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions import vectors as vx
from corpusmill.operators import ann, chunking, declarations, embedding, lookup, maintenance, reports
from corpusmill.operators.projection import map_legend, map_points, pca_2d
from corpusmill.operators.rerank import jaccard, model_scorer, rerank, search_end_to_end
from corpusmill.operators.search import knn_search
from corpusmill.plans import bindings as b
from corpusmill.schema import DOCUMENT_MAX_TOKENS, PAIR_MAX_TOKENS
from corpusmill.session import shared_dir, spread
from corpusmill.sources import events, files, snapshots

Query = Callable[[SparkSession, str], DataFrame]
CHUNK_KEYS = ["id", "filepath", "start_line", "end_line", "node_type", "language", "text_hash"]


def chunks_of(spark, d) -> DataFrame:
    return chunking.chunk_documents(b.document_files(spark, d))


def _unvectored(index: DataFrame) -> DataFrame:
    """Index columns for operators that do not look at vectors."""
    return index.withColumn("vector", F.lit(None).cast("array<float>"))


# Sources and predicates


def scan_files(spark, d):
    return files.scan_files(b.raw_tree(spark, d), "corpus").select(
        "filepath", "language", F.length("content").alias("chars"))


def read_normalize(spark, d):
    text = files.read_normalize(b.raw_pages(spark, d))
    return text.select(
        "page_id", F.md5("content").alias("content_hash"), F.length("content").alias("chars"))


def project_scan(spark, d):
    return lookup.project_scan(chunks_of(spark, d), "language", "filepath", "node_type")


def path_normalize(spark, d):
    return b.raw_tree(spark, d).select(
        tx.normalize_path(F.col("filepath")).alias("filepath"))


def short_path(spark, d):
    return b.raw_tree(spark, d).select(
        "filepath", tx.short_path(F.col("filepath")).alias("short_filepath"))


def text_hash(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.md5("text").alias("text_hash"))


# Chunks


def chunk_documents(spark, d):
    return chunks_of(spark, d).select(*CHUNK_KEYS)


def split_long(spark, d):
    nodes = chunking.document_nodes(b.document_files(spark, d))
    return chunking.split_long(nodes).select(*CHUNK_KEYS, F.length("text").alias("chars"))


def chunk_code(spark, d):
    return declarations.chunk_code(b.code_files(spark, d)).select(
        *CHUNK_KEYS, F.length("text").alias("chars"))


def snippets(spark, d):
    return reports.snippets(chunks_of(spark, d))


# Index maintenance


def dedup_chunks(spark, d):
    return maintenance.dedup_chunks(b.bare_chunks(spark, d)).select(*CHUNK_KEYS)


def upsert_chunks(spark, d):
    """Stored: the labelled documents. Incoming: all, so copies are skipped."""
    rows = b.bare_chunks(spark, d)
    labelled = rows.join(b.table(spark, d, "labels"), "doc_id", "left_semi")
    stored = _unvectored(maintenance.dedup_chunks(labelled))
    return maintenance.upsert_chunks(stored, _unvectored(rows)).select(*CHUNK_KEYS)


def index_insert(spark, d):
    """``upsert_chunks`` into a saved index, whose bitmaps tell most new hashes."""
    path = shared_dir(spark, "index")
    rows = b.bare_chunks(spark, d)
    labelled = rows.join(b.table(spark, d, "labels"), "doc_id", "left_semi")
    snapshots.save_index(_unvectored(maintenance.dedup_chunks(labelled)), path, bitmaps=True)
    snapshots.insert_absent(_unvectored(rows), path)
    return snapshots.read_index(spark, path).select(*CHUNK_KEYS)


def changed_files(spark, d):
    new = chunking.chunk_documents(b.edited_document_files(spark, d))
    return maintenance.changed_files(chunks_of(spark, d), new)


def _refreshed(mode):
    def run(spark, d):
        path = shared_dir(spark, "stored")
        _unvectored(maintenance.dedup_chunks(chunks_of(spark, d))).write.parquet(path)
        old = spark.read.parquet(path)
        new = b.edited_document_files(spark, d)
        out = maintenance.refresh_index(old, new, embedding.hashed(64), mode)
        return out.select(*CHUNK_KEYS)
    return run


def delete_by_filepath(spark, d):
    return maintenance.delete_by_filepath(
        chunks_of(spark, d), b.deleted_paths(spark, d)).select(*CHUNK_KEYS)


def deleted_count(spark, d):
    return maintenance.deleted_count(chunks_of(spark, d), b.deleted_paths(spark, d))


def build_summary(spark, d):
    """Nothing stored but the labelled documents; all documents come in."""
    rows = b.bare_chunks(spark, d)
    labelled = rows.join(b.table(spark, d, "labels"), "doc_id", "left_semi")
    return maintenance.build_summary(labelled, rows)


def refresh_summary(spark, d):
    new = chunking.chunk_documents(b.edited_document_files(spark, d))
    return maintenance.refresh_summary(chunks_of(spark, d), new)


def index_build(spark, d):
    path = shared_dir(spark, "index")
    snapshots.save_index(
        maintenance.build_index(
            b.document_files(spark, d), embedding.hashed(), shards=16), path)
    return snapshots.read_index(spark, path).select(*CHUNK_KEYS)


# Lookups and reports


def path_search(spark, d):
    return lookup.path_search(chunks_of(spark, d), "src1/", 20)


def path_like(spark, d):
    return lookup.path_like(chunks_of(spark, d), "src1_/e_/doc", 20)


def file_chunks(spark, d):
    return lookup.file_chunks(chunks_of(spark, d), "corpus\\src2\\en\\doc_2.ts")


def file_chunks_partial(spark, d):
    return lookup.file_chunks(chunks_of(spark, d), "src2/en/doc_2", partial=True)


def index_status(spark, d):
    return reports.index_status(chunks_of(spark, d), "codebase", "documents")


def index_totals(spark, d):
    return reports.index_totals(chunks_of(spark, d))


def index_stats(spark, d):
    return reports.index_stats(chunks_of(spark, d))


def top_node_types(spark, d):
    return reports.top_node_types(chunks_of(spark, d))


def languages_by_size(spark, d):
    return reports.languages_by_size(chunks_of(spark, d))


def file_stats(spark, d):
    return reports.file_stats(chunks_of(spark, d))


def file_stats_top(spark, d):
    return reports.file_stats_top(reports.file_stats(chunks_of(spark, d)))


def file_stats_bottom(spark, d):
    return reports.file_stats_top(reports.file_stats(chunks_of(spark, d)), ascending=True)


def file_filter(spark, d):
    return reports.file_filter(reports.file_stats(chunks_of(spark, d)), "SRC1/En")


# Vectors


def _long(df, key, values, name="value"):
    return df.select(key, F.posexplode(values).alias("dim", name))


def l2_normalize(spark, d):
    """The given vectors scaled by their label, brought back to length one."""
    scaled = b.table(spark, d, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1)).alias("v"))
    out = _long(scaled, "vec_id", vx.l2_normalize(F.col("v")))
    return out.withColumn("value", F.round("value", 6))


def mean_pool(spark, d):
    """Mean per label of the vectors whose first component is not negative."""
    rows = b.table(spark, d, "embeddings").select(
        "label", F.col("embedding").alias("vec"),
        F.when(F.col("embedding")[0] >= 0, 1).otherwise(0).alias("mask"))
    out = _long(embedding.mean_pool(rows, "label"), "label", F.col("vec"))
    return out.withColumn("value", F.round("value", 6))


def cosine_pairs(spark, d):
    """Each vector against the mean of its label."""
    pooled = b.centroid_queries(spark, d).select(
        F.col("query_id").cast("int").alias("label"), "qvec")
    rows = b.table(spark, d, "embeddings").join(pooled, "label")
    return rows.select(
        "vec_id", "label", vx.cosine(F.col("embedding"), F.col("qvec")).alias("score"))


def knn_search_all(spark, d):
    asked = b.centroid_queries(spark, d).drop("language")
    return knn_search(b.vector_index(spark, d), asked, with_rows=False)


def knn_search_filtered(spark, d):
    return knn_search(
        b.vector_index(spark, d), b.centroid_queries(spark, d), with_rows=False)


def quantize_vectors(spark, d):
    index = b.vector_index(spark, d)
    coded = ann.quantize_vectors(index, ann.fit_quantizer(index))
    return _long(coded, "vec_id", F.col("codes"), "code").withColumn(
        "code", F.col("code").cast("int"))


def knn_quantized(spark, d):
    index = b.vector_index(spark, d)
    quantizer = ann.fit_quantizer(index)
    return ann.knn_quantized(
        ann.pack_codes(index, quantizer), index,
        b.centroid_queries(spark, d), quantizer)


def ann_ivf(spark, d):
    """Cells around the means of the labels, of which there are ten."""
    index, asked = b.vector_index(spark, d), b.centroid_queries(spark, d)
    centers = np.array([r["qvec"] for r in asked.orderBy("query_id").collect()])
    return ann.ann_ivf(
        ann.assign_cells(index, centers), asked, centers,
        probes=4, with_rows=False)


def ann_lsh(spark, d):
    return ann.ann_lsh(
        b.vector_index(spark, d), b.centroid_queries(spark, d), with_rows=False)


# Encoding and search over texts


def _nonzero(df, key):
    cells = F.transform(
        "vector", lambda x, i: F.struct(i.alias("dim"), x.alias("value")))
    out = df.select(key, F.inline(F.filter(cells, lambda c: c["value"] != 0)))
    return out.withColumn("value", F.round(F.col("value").cast("double"), 6))


def embed_hash(spark, d):
    return _nonzero(embedding.embed(chunks_of(spark, d), embedding.hashed()), "id")


def embed_truncated(spark, d):
    """Whole documents under the token cap of a model input."""
    docs = spread(b.table(spark, d, "documents"))
    return _nonzero(
        embedding.embed(docs, embedding.hashed(max_tokens=DOCUMENT_MAX_TOKENS)), "doc_id")


def _length_model():
    """Stand-in model for the plug-in contract: text length features."""
    import numpy as np

    def predict(texts):
        sizes = np.array([len(t) for t in texts], dtype=np.float64)
        lines = np.array([t.count("\n") for t in texts], dtype=np.float64)
        out = np.stack([sizes, lines + 1], axis=1)
        return (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)

    return predict


def embed_model(spark, d):
    out = embedding.embed(chunks_of(spark, d), embedding.model(_length_model, 2))
    return _long(out, "id", F.col("vector")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6))


def _text_index(spark, d):
    return embedding.embed(chunks_of(spark, d), embedding.hashed())


def knn_text(spark, d):
    asked = embedding.embed_queries(b.benchmark_queries(spark, d))
    return knn_search(_text_index(spark, d), asked).select(
        "query_id", "rank", "score", "id", "filepath", "start_line", "text_hash")


def knn_stored(spark, d):
    """``knn_text`` over a saved index: the texts of the hits are fetched by pushed ids."""
    path = shared_dir(spark, "stored")
    snapshots.save_index(_text_index(spark, d), path)
    asked = embedding.embed_queries(b.benchmark_queries(spark, d))
    return knn_search(snapshots.read_index(spark, path), asked, push_ids=True).select(
        "query_id", "rank", "score", "id", "filepath", "start_line", "text_hash")


_HIT = ["query_id", "rank", "candidate_rank", "score", "rerank_score", "id", "filepath"]


def _dealt_hits(spark, d):
    """Every document as a candidate of one benchmark text, dealt by a hash; candidates rank by id."""
    texts = b.table(spark, d, "benchmark").count()
    number = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    return spread(b.table(spark, d, "documents")).select(
        F.pmod(number, F.lit(texts)).alias("query_id"), F.col("doc_id").alias("rank"), "text", "doc_id")


def rerank_query(spark, d):
    return rerank(_dealt_hits(spark, d), b.benchmark_queries(spark, d), jaccard, 8).select(
        "query_id", "rank", "candidate_rank", "rerank_score", "doc_id")


def rerank_capped(spark, d):
    """Pairs cut to a model's cap: the query first, then what it leaves of the text."""
    scorer = partial(jaccard, max_tokens=PAIR_MAX_TOKENS)
    return rerank(_dealt_hits(spark, d), b.benchmark_queries(spark, d), scorer, 8).select(
        "query_id", "rank", "candidate_rank", "rerank_score", "doc_id")


def _overlap_model():
    """Stand-in pair model: share of the query's words found in the text."""
    import numpy as np

    def predict(queries, texts):
        scores = []
        for query, text in zip(queries, texts, strict=True):
            asked = set(query.lower().split())
            found = asked & set(text.lower().split())
            scores.append(len(found) / len(asked) if asked else 0.0)
        return np.array(scores)

    return predict


def rerank_model(spark, d):
    return search_end_to_end(
        _text_index(spark, d), b.benchmark_queries(spark, d),
        scorer=model_scorer(_overlap_model)).select(*_HIT)


def search(spark, d):
    return search_end_to_end(
        _text_index(spark, d), b.benchmark_queries(spark, d)).select(*_HIT)


def pca(spark, d):
    out = pca_2d(b.vector_index(spark, d))
    return out.select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _points(spark, d):
    """Map of a stored index: the fit reads it several times."""
    path = shared_dir(spark, "map")
    snapshots.save_index(
        maintenance.build_index(
            b.document_files(spark, d), embedding.hashed(64), shards=4), path)
    return map_points(pca_2d(snapshots.read_index(spark, path, keep_shard=False)))


def points(spark, d):
    return _points(spark, d).withColumn("x", F.round("x", 6)).withColumn("y", F.round("y", 6))


def points_plane(spark, d):
    """Map of chunks whose vectors have two components, the axes of which SQL can name."""
    chunks = embedding.embed(chunks_of(spark, d), embedding.model(_length_model, 2))
    return map_points(pca_2d(chunks)).withColumns({c: F.round(c, 6) + 0.0 for c in ("x", "y")})


def legend(spark, d):
    return map_legend(_points(spark, d)).select("color", "points")


def legend_types(spark, d):
    return map_legend(_points(spark, d), "node_type").select("color", "points")


def map_saved(spark, d):
    """A map written, read back and counted."""
    path = shared_dir(spark, "points")
    snapshots.save_points(_points(spark, d), path)
    return snapshots.points_summary(snapshots.load_points(spark, path))


def index_cleared(spark, d):
    """Rows of an index before and after it is cleared."""
    path = shared_dir(spark, "cleared")
    snapshots.save_index(maintenance.build_index(
        b.document_files(spark, d), embedding.hashed(64), shards=4), path)
    before = snapshots.read_index(spark, path).agg(F.count("*").alias("stored"))
    snapshots.clear_index(spark, path)
    after = snapshots.read_index(spark, path).agg(F.count("*").alias("left_over"))
    return before.crossJoin(after)


def index_created(spark, d):
    """An index is created where there is none, takes all chunks, and is opened again as it is."""
    path = shared_dir(spark, "created")
    made = snapshots.ensure_index(spark, path)
    empty = snapshots.read_index(spark, path).agg(F.count("*").alias("empty")).first()[0]
    added = embedding.embed(maintenance.dedup_chunks(chunks_of(spark, d)), embedding.hashed(64))
    snapshots.append_delta(added, added.select("filepath").limit(0), path)
    again = snapshots.ensure_index(spark, path)
    return snapshots.read_index(spark, path).groupBy("language").agg(F.count("*").alias("stored")).withColumns({
        "made": F.lit(made), "empty": F.lit(empty), "made_again": F.lit(again)})


# Events


def edit_events(spark, d) -> DataFrame:
    """Events as JSON text, one per document, derived from the documents.

    English documents are single edits, French ones multi-edits, the others
    carry the raw text, which is not JSON.
    """
    path = b.document_path()
    single = F.to_json(F.struct(
        F.lit("Edit").alias("tool_name"),
        F.struct(F.upper(path).alias("file_path")).alias("tool_input")))
    many = F.to_json(F.struct(
        F.lit("MultiEdit").alias("tool_name"),
        F.struct(F.array(
            F.struct(path.alias("file_path")),
            F.struct(F.concat(path, F.lit(".md")).alias("file_path")),
            F.struct(F.lit(None).cast("string").alias("file_path")),
        ).alias("edits")).alias("tool_input")))
    return b.table(spark, d, "documents").select(
        F.when(F.col("lang") == "en", single).when(F.col("lang") == "fr", many)
        .otherwise(F.translate("text", "\n", " ")).alias("value"))


def edited_paths(spark, d):
    return events.edited_paths(events.parse_events(edit_events(spark, d)))


def stream_refresh(spark, d):
    """Events for every edited document, replayed onto a stored index."""
    from corpusmill.streaming.refresh import stream_refresh as start

    base = shared_dir(spark, "stream")
    index_path = f"{base}/index"
    snapshots.save_index(
        maintenance.build_index(b.document_files(spark, d), embedding.hashed(64)), index_path)
    changed = b.edited_document_files(spark, d)
    changed.select(
        F.lit("Edit").alias("tool_name"),
        F.struct(F.col("filepath").alias("file_path")).alias("tool_input"),
    ).write.json(f"{base}/events")
    query = start(
        spark, f"{base}/events", index_path, f"{base}/checkpoint",
        loader=lambda paths: changed.join(paths, "filepath", "left_semi"),
        encoder=embedding.hashed(64))
    query.awaitTermination()
    return snapshots.read_index(spark, index_path).select(*CHUNK_KEYS)


def queries() -> dict[str, Query]:
    return {
        "scan_files": scan_files,
        "read_normalize": read_normalize,
        "project_scan": project_scan,
        "path_normalize": path_normalize,
        "short_path": short_path,
        "text_hash": text_hash,
        "chunk_documents": chunk_documents,
        "split_long": split_long,
        "chunk_code": chunk_code,
        "snippets": snippets,
        "dedup_chunks": dedup_chunks,
        "upsert_chunks": upsert_chunks,
        "index_insert": index_insert,
        "changed_files": changed_files,
        "refresh_index": _refreshed("compat"),
        "refresh_index_strict": _refreshed("strict"),
        "delete_by_filepath": delete_by_filepath,
        "deleted_count": deleted_count,
        "build_summary": build_summary,
        "refresh_summary": refresh_summary,
        "index_build": index_build,
        "path_search": path_search,
        "path_like": path_like,
        "file_chunks": file_chunks,
        "file_chunks_partial": file_chunks_partial,
        "index_status": index_status,
        "index_totals": index_totals,
        "index_stats": index_stats,
        "top_node_types": top_node_types,
        "languages_by_size": languages_by_size,
        "file_stats": file_stats,
        "file_stats_top": file_stats_top,
        "file_stats_bottom": file_stats_bottom,
        "file_filter": file_filter,
        "l2_normalize": l2_normalize,
        "mean_pool": mean_pool,
        "cosine_pairs": cosine_pairs,
        "knn_search": knn_search_all,
        "knn_search_filtered": knn_search_filtered,
        "quantize_vectors": quantize_vectors,
        "knn_quantized": knn_quantized,
        "ann_ivf": ann_ivf,
        "ann_lsh": ann_lsh,
        "embed_hash": embed_hash,
        "embed_truncated": embed_truncated,
        "embed_model": embed_model,
        "knn_text": knn_text,
        "knn_stored": knn_stored,
        "rerank": rerank_query,
        "rerank_capped": rerank_capped,
        "rerank_model": rerank_model,
        "search_end_to_end": search,
        "pca_2d": pca,
        "map_points": points,
        "map_points_plane": points_plane,
        "map_legend": legend,
        "map_legend_types": legend_types,
        "map_saved": map_saved,
        "index_cleared": index_cleared,
        "index_created": index_created,
        "edited_paths": edited_paths,
        "stream_refresh": stream_refresh,
    }
