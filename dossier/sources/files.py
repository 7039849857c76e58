"""Stored files and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.text import file_extension
from dossier.schemas import MAX_UPLOAD_BYTES, PARSEABLE_EXTENSIONS, UPLOAD_EXTENSIONS


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Stored files under <root>/<case id>/<file>, with their path below the root.

    A missing root is an error of the reader.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return _with_case(files, root)


def _with_case(files: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/").removeprefix("file:")
    below = F.substring_index(F.col("path"), f"{base}/", -1)
    case = F.regexp_extract(below, r"^(?:case_id=)?([^/]+)/", 1)
    return files.select(
        below.alias("file_path"), case.try_cast("bigint").alias("case_id"),
        F.substring_index("path", "/", -1).alias("filename"), "modificationTime", "length",
        "content")


def missing_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose stored file is not there."""
    return documents.join(files.select("file_path"), "file_path", "left_anti")


def write_by_case(df: DataFrame, path: str, mode: str = "append") -> None:
    """One directory per case; Spark names the files, so they never collide.

    Rebalancing gathers small cases into few files and cuts a large case into several.
    """
    df.hint("rebalance", "case_id").write.mode(mode).partitionBy("case_id").parquet(path)


def reject_reason(filename: Column, length: Column, extensions: list[str] = UPLOAD_EXTENSIONS) -> Column:
    """First rule an upload breaks; null for an admitted one."""
    extension = file_extension(filename)
    return F.when(
        ~extension.isin(extensions),
        F.concat(F.lit("File type '"), extension, F.lit("' is not allowed")),
    ).when(length > MAX_UPLOAD_BYTES, F.lit("File exceeds maximum allowed size of 10 MB"))


def admit_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads (filename, length) with `reject_reason` and `admitted`."""
    return uploads.withColumn(
        "reject_reason", reject_reason(F.col("filename"), F.col("length"))
    ).withColumn("admitted", F.col("reject_reason").isNull())


def only_parseable(files: DataFrame, extensions: list[str] = PARSEABLE_EXTENSIONS) -> DataFrame:
    """Files for whose type there is a parser."""
    return files.where(file_extension(F.col("filename")).isin(extensions))


def lookup(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Wanted keys with their row of the table, or nulls for a miss."""
    return wanted.join(table.withColumn("found", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))
