"""From stored files to searchable chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.rows import rows_of
from dossier.operators.chunking import chunk_document
from dossier.operators.embedding import EmbeddingProvider, embed
from dossier.operators.ingestion import changed_documents, content_hash
from dossier.operators.ordered import number_rows
from dossier.operators.pages import parse_documents
from dossier.schemas import CHUNK_OVERLAP, CHUNK_SIZE, PARSEABLE_EXTENSIONS, UPLOAD_EXTENSIONS
from dossier.session import materialise
from dossier.sources.files import only_parseable, reject_reason
from dossier.sources.store import add_batch, read_chunks, read_table  # noqa: F401


@dataclass(frozen=True)
class Ingestion:
    """Chunks of the documents that went through, and one outcome row per document."""

    chunks: DataFrame  # document_id, case_id, sequence, page_number, text, embedding
    outcomes: DataFrame  # document_id, content_hash, status, n_chunks, error


def ingest(files: DataFrame, ledger: DataFrame, parser: Callable,
           embedder: Callable[[], EmbeddingProvider],
           width: int, force: bool = False, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
           extensions: list[str] = PARSEABLE_EXTENSIONS, requested: DataFrame | None = None) -> Ingestion:
    """Admit, hash, skip what has not changed, parse, chunk, embed.

    files: document_id, case_id, filename, content. A document stays in its own row until it is
    chunked and embedded; an unreadable or refused one is an outcome row, and so is one of `requested`
    (document_id) that has no file.
    """
    # First the hashes alone, so that contents are moved only for documents to be processed, and
    # not even for those while their ids are few enough to be broadcast by Spark.
    size_of = F.col("length") if "length" in files.columns else F.octet_length("content")
    refusal = reject_reason(F.col("filename"), size_of, [*UPLOAD_EXTENSIONS, *extensions])
    known = materialise(files.select(
        "document_id", "filename", refusal.alias("refusal"),
        F.when(refusal.isNull(), content_hash(F.col("content"))).alias("content_hash")))
    readable = only_parseable(known.where("refusal IS NULL"), extensions)
    todo = changed_documents(readable.select("document_id", "content_hash"), ledger, force)
    parsed = materialise(parse_documents(
        files.select("document_id", "case_id", "content").join(todo, "document_id"), parser))
    good = parsed.where(F.col("error").isNull())
    pieces = rows_of(good, ["document_id", "case_id"],
                     chunk_document(F.col("pages"), size, overlap), "_n", "_p").select(
        "document_id", "case_id", "_p.*")
    chunks = materialise(embed(pieces, embedder, width))

    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    done = parsed.select("document_id", "content_hash", "error").join(counts, "document_id", "left")
    processed = done.select(
        "document_id", "content_hash",
        F.when(F.col("error").isNull(), F.lit("ingested")).otherwise(F.lit("failed")).alias("status"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "error")
    skipped = readable.select("document_id", "content_hash").join(
        parsed.select("document_id"), "document_id", "left_anti").select(
        "document_id", "content_hash", F.lit("unchanged").alias("status"),
        F.lit(0).cast("bigint").alias("n_chunks"), F.lit(None).cast("string").alias("error"))
    refused = known.join(readable.select("document_id"), "document_id", "left_anti").select(
        "document_id", "content_hash",
        F.when(F.col("refusal").isNull(), "unsupported").otherwise("rejected").alias("status"),
        F.lit(0).cast("bigint").alias("n_chunks"),
        F.coalesce("refusal", F.lit("UnsupportedFileTypeError: no parser for this file type")).alias("error"))
    outcomes = processed.unionByName(skipped).unionByName(refused)
    if requested is not None:
        gone = requested.select("document_id").distinct().join(known, "document_id", "left_anti")
        outcomes = outcomes.unionByName(gone.select(
            "document_id", F.lit(None).cast("string").alias("content_hash"), F.lit("failed").alias("status"),
            F.lit(0).cast("bigint").alias("n_chunks"),
            F.concat(F.lit("ValueError: Document "), F.col("document_id").cast("string"), F.lit(" no longer exists")).alias("error")))
    return Ingestion(chunks, outcomes)


def store(result: Ingestion, chunk_path: str, ledger_path: str) -> None:
    """Add the chunks of the ingested documents as a version of the store, then record their hashes.

    Files of earlier versions stay as they are. The ledger comes last, so a run that stops early is repeated and not
    taken for done. Where no document was ingested nothing is written.
    """
    spark = result.chunks.sparkSession
    done = materialise(result.outcomes.where(F.col("status") == "ingested").select("document_id", "content_hash"))
    if done.head() is None:
        return
    add_batch(spark, chunk_path, done, result.chunks)
    done.select("document_id", F.col("content_hash").alias("ingested_content_hash"),
                F.current_timestamp().alias("recorded_at")).write.mode("append").parquet(ledger_path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Last recorded hash of each document."""
    rows = read_table(spark, path)
    if rows is None:
        return spark.createDataFrame([], "document_id bigint, ingested_content_hash string")
    return rows.groupBy("document_id").agg(
        F.max_by("ingested_content_hash", "recorded_at").alias("ingested_content_hash"))


def register_files(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """The documents table (document_id, file_path) after every file_path of `files` has a number in it.

    New files go on from the highest number, in order of their paths; a path keeps its number for good. One writer at a time.
    """
    schema = "document_id bigint, file_path string"
    known = read_table(spark, path)
    known = spark.createDataFrame([], schema) if known is None else known
    new = materialise(files.select("file_path").distinct().join(known, "file_path", "left_anti"))
    if new.head() is not None:
        highest = known.agg(F.coalesce(F.max("document_id"), F.lit(0))).head()[0]
        numbered = number_rows(new, [], ["file_path"], "_n", start=highest + 1)
        numbered.select(F.col("_n").alias("document_id"), "file_path").write.mode("append").parquet(path)
    rows = read_table(spark, path)
    return known if rows is None else rows
