"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import (
    decontamination, filter_audit, language_id, licenses, minhash, mixing, packing, page_text, quality, quotations, sql, token_counts, vector_codes)
from corpusmill.llm.repeats import Repeats
from corpusmill.llm.tables import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(_table(spark, sf_dir, "documents"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")).digest()


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


def op1_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are numbered once and written, so that repeated ids stay apart."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = written(mixing.sized(docs).drop("text").withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    plan = mixing.Plan(rows.select("source", "mix_size", "mix_hash"))
    placed = plan.placed(rows)
    taken = plan.copies(placed).groupBy("row").agg(F.count("*").alias("copies"))
    return placed.join(taken, "row", "left").select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.coalesce("copies", F.lit(0))).alias("taken"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", F.coalesce(~language_id.in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.threads(_table(spark, sf_dir, "conversations"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(_table(spark, sf_dir, "pages"))


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces are written once, so that sequence numbers hold for every reading of the result."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), with_ids=False).drop("ids", "key")
    return written(pieces, "pack-pieces")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.Codes(_table(spark, sf_dir, "embeddings")).digested()


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op7_suffix_repeats": sql.SUFFIX_REPEATS, "op8_minhash_near_dedup": sql.NEAR_DUPLICATES,
            "op12_vector_codes": sql.vector_codes(), "op13_filter_audit": sql.FILTER_AUDIT}
