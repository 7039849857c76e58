"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can say the same."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor reaches."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here and lost executors lose nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of_id(column: Column) -> Column:
    """crc32 of an id as text; null for a null id."""
    return F.crc32(column.cast("string").cast("binary"))


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; empty for a null or blank text."""
    plain = F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_UPPER.lower())
    return F.filter(F.split(plain, WORD_GAP), lambda w: w != "")


def words_of(text: str | None) -> list[bytes]:
    """The same as UTF-8: bytes know ASCII case and ASCII white space only, which is what is asked for."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def give_back() -> None:
    """Hand what this worker has freed back to the machine: the worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """One Arrow batch at a time through a function; a task holds no more than a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out
        give_back()

    return df.mapInArrow(run, schema)
