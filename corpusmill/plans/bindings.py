"""Engine tables over the test tables.

Each binding keeps every row and every whole text of the tables it reads; which
file is edited or removed is decided by label columns, never by row number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions import vectors as vx
from corpusmill.session import spread

EDIT_LINE = "// reviewed: this file was edited after the first build"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _suffix(lang: Column) -> Column:
    return (
        F.when(lang == "en", ".ts").when(lang == "fr", ".go").otherwise(".tsx"))


def document_path() -> Column:
    return F.concat(
        F.lit("corpus/"), F.col("source"), F.lit("/"), F.col("lang"),
        F.lit("/doc_"), F.col("doc_id"), _suffix(F.col("lang")))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    path = document_path()
    return docs.select(
        path.alias("filepath"), tx.language_of(path).alias("language"),
        F.col("text").alias("content"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a source file that carries its whole text in comments.

    TypeScript: an exported function, an interface, a bound arrow function, a method of
    an abstract class, a class, a type alias, an arrow function bound by a typed second
    declarator. Go: a struct type, a function, a method.
    """
    docs = spread(table(spark, sf_dir, "documents"))
    path = document_path()

    def comment(indent: str) -> Column:
        lines = F.split("text", "\n", -1)
        return F.array_join(
            F.transform(lines, lambda x: F.concat(F.lit(indent + "// "), x)), "\n")

    ts = F.concat(
        F.lit('import { corpus } from "./{corpus";\n\n/* source: '), F.col("source"),
        F.lit(" { */\nexport function doc_"), F.col("doc_id"), F.lit("() {\n"), comment("  "),
        F.lit("\n}\n\ninterface Row"), F.col("doc_id"),
        F.lit(" {\n  lang: string;\n  chars: number;\n}\n\nconst size"), F.col("doc_id"),
        F.lit(" = (scale: number) => scale * "), F.col("n_chars"), F.lit(";\n\nabstract class Base"),
        F.col("doc_id"), F.lit(" {\n  protected async load"), F.col("doc_id"),
        F.lit("(scale: number): Promise<void> {\n    await scale;\n  }\n}\n\nclass Store"), F.col("doc_id"),
        F.lit(" {\n  rows = "), F.col("n_chars"), F.lit(";\n}\n\ntype Name"), F.col("doc_id"),
        F.lit(" = string | number;\n\nconst low"), F.col("doc_id"), F.lit(" = 0, high"), F.col("doc_id"),
        F.lit(": (x: number) => number = (x) => x + "), F.col("n_chars"), F.lit(";\n"))
    go = F.concat(
        F.lit("package corpus\n\ntype Row"), F.col("doc_id"),
        F.lit(" struct {\n\tLang string // {\n}\n\nfunc Doc"), F.col("doc_id"), F.lit("() {\n"),
        comment("\t"), F.lit("\n}\n\nfunc (r Row"), F.col("doc_id"),
        F.lit(") Size() int { return "), F.col("n_chars"), F.lit(" }\n"))
    return docs.select(
        path.alias("filepath"), tx.language_of(path).alias("language"),
        F.when(F.col("lang") == "fr", go).otherwise(ts).alias("content"))


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(table(spark, sf_dir, "conversations"))
    path = F.concat(
        F.lit("corpus/chat/"), F.col("role"), F.lit("/conv_"), F.col("conv_id"),
        F.lit("_"), F.col("turn"), F.lit(".ts"))
    return turns.select(
        path.alias("filepath"), tx.language_of(path).alias("language"),
        F.col("text").alias("content"))


def raw_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed tree to scan: documents, web pages and chat turns.

    Pages are not source files; chat turns of the assistant sit in a directory
    that a scan skips; some paths use backslashes.
    """
    docs = table(spark, sf_dir, "documents").select(
        F.translate(document_path(), "/", "\\").alias("filepath"),
        F.col("text").alias("content"))
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("corpus/web/page_"), F.col("page_id"), F.lit(".html")).alias("filepath"),
        F.col("html").alias("content"))
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(
            F.lit("corpus/chat/"),
            F.when(F.col("role") == "assistant", "node_modules").otherwise(F.col("role")),
            F.lit("/conv_"), F.col("conv_id"), F.lit("_"), F.col("turn"), F.lit(".ts"),
        ).alias("filepath"),
        F.col("text").alias("content"))
    return docs.unionByName(pages).unionByName(turns)


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page bytes with a CRLF, a bare CR and bytes that are not UTF-8."""
    tail = F.unhex(F.lit("0D0A78FFFE790D7A"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.encode("html", "UTF-8"), tail).alias("content"))


def edited_document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus after a change.

    Low-quality documents got a line appended, toxic ones of good quality were
    removed, and every chat turn is a new file.
    """
    docs = spread(table(spark, sf_dir, "documents")).join(
        table(spark, sf_dir, "labels"), "doc_id", "left")
    path = document_path()
    kept = docs.where(~(F.coalesce("toxic", F.lit(0)).eqNullSafe(1)
                        & F.coalesce("quality", F.lit(0)).eqNullSafe(1)))
    edited = F.when(
        F.col("quality") == 0, F.concat(F.col("text"), F.lit("\n" + EDIT_LINE)),
    ).otherwise(F.col("text"))
    after = kept.select(
        path.alias("filepath"), tx.language_of(path).alias("language"),
        edited.alias("content"))
    return after.unionByName(conversation_files(spark, sf_dir))


def deleted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the documents labelled toxic."""
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    return docs.join(toxic, "doc_id", "left_semi").select(document_path().alias("filepath"))


def bare_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents hashed without the header, so copies share a hash."""
    docs = table(spark, sf_dir, "documents")
    path = document_path()
    rows = docs.select(
        "doc_id", F.col("text"), path.alias("filepath"), F.lit(1).alias("start_line"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
        .cast("int").alias("end_line"),
        F.lit("document").alias("node_type"), tx.language_of(path).alias("language"),
        F.md5("text").alias("text_hash"))
    return rows.withColumn("id", tx.chunk_id(
        F.col("text_hash"), F.col("start_line"), F.col("end_line"), F.col("node_type")))


def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given unit vectors as index rows (id, vector, language, label)."""
    rows = spread(table(spark, sf_dir, "embeddings"))
    return rows.select(
        F.concat(F.lit("vec_"), F.col("vec_id")).alias("id"),
        F.col("embedding").alias("vector"),
        F.when(F.col("label") < 5, "typescript").otherwise("go").alias("language"),
        "label", "vec_id")


def centroid_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label: the unit mean of its vectors.

    Labels over 6 ask for Go only, labels under 3 for TypeScript only.
    """
    from corpusmill.operators.embedding import mean_pool

    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("query_id"), F.col("embedding").alias("vec"),
        F.lit(1).alias("mask"))
    pooled = mean_pool(rows, "query_id", "vec", "mask")
    return pooled.select(
        "query_id", vx.l2_normalize(F.col("vec")).alias("qvec"),
        F.when(F.col("query_id") > 6, "go").when(F.col("query_id") < 3, "typescript")
        .alias("language"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"),
        F.lit(None).cast("string").alias("language"))
