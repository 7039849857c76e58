"""A chunk store whose batches only add files; readers merge, and compaction is a step of its own.

    <path>/version=<n>/             chunks of the documents of one batch, in order of document and sequence
    <path>/_files/version=<n>/      for each of its files the first and last document
    <path>/_dead/version=<n>/       earlier versions of documents that this batch replaces or removes
    <path>/_manifest/version=<n>/   the documents of the batch, with their number of chunks

The manifest of a version is written last and makes it visible. What a run that stopped early has left is of no version, is
never read and is overwritten by the next run. Two writers at once: the second one's manifest is there already, an error.

A batch reads the manifest (two numbers a document) and no chunk. A reader leaves out the dead (document, version) pairs, an
anti join with a table that compaction keeps small. Documents keep apart by id, which is the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import materialise

_MANIFEST = "document_id bigint, n_chunks bigint, version int"
_DEAD = "document_id bigint, dead_version int, n_chunks bigint, version int"
_FILES = "path string, low bigint, high bigint, version int"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A Parquet folder; None where there is none yet."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise


def _part(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    rows = read_table(spark, f"{path}/_{name}", schema)
    return spark.createDataFrame([], schema) if rows is None else rows


@dataclass(frozen=True)
class _State:
    """Versions with a manifest, one for each batch, and those of them that readers see: the ones not gathered into a later one."""

    committed: list[int]
    seen: list[int]


def _state(spark: SparkSession, path: str) -> _State:
    marks = _part(spark, path, "manifest", _MANIFEST).select("version", F.lit(None).cast("int").alias("gathered")).union(
        _part(spark, path, "dead", _DEAD).where(F.col("document_id").isNull()).select("version", "dead_version")).distinct().collect()
    committed = {r["version"] for r in marks if r["gathered"] is None}
    gathered = {r["gathered"] for r in marks if r["gathered"] is not None and r["version"] in committed}
    return _State(sorted(committed), sorted(committed - gathered))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that readers see."""
    return _state(spark, path).seen


def _next(state: _State) -> int:
    return max(state.committed, default=0) + 1


def _seen(rows: DataFrame, of: list[int]) -> DataFrame:
    return rows.where(F.col("version").isin(of))


def _dead(spark: SparkSession, path: str, state: _State) -> DataFrame:
    """(document_id, version) pairs of the seen versions that a later one has replaced."""
    rows = _part(spark, path, "dead", _DEAD).where(F.col("dead_version").isin(state.seen) & F.col("version").isin(state.committed))
    return rows.select("document_id", F.col("dead_version").alias("version"))


def live_documents(spark: SparkSession, path: str, state: _State | None = None) -> DataFrame:
    """document_id, n_chunks and the version that holds the chunks, of every document with chunks."""
    state = state or _state(spark, path)
    return _seen(_part(spark, path, "manifest", _MANIFEST), state.seen).where("n_chunks > 0").join(
        _dead(spark, path, state), ["document_id", "version"], "left_anti")


def read_chunks(spark: SparkSession, path: str) -> DataFrame | None:
    """The chunks of all documents in their last version; None where nothing was ever stored."""
    state = _state(spark, path)
    rows = read_table(spark, path) if state.seen else None
    return None if rows is None else _merged(spark, path, rows, state)


def _merged(spark: SparkSession, path: str, rows: DataFrame, state: _State) -> DataFrame:
    return _seen(rows, state.seen).join(_dead(spark, path, state), ["document_id", "version"], "left_anti").drop("version")


# --- writing ------------------------------------------------------------------------------


def _commit(spark: SparkSession, path: str, version: int, documents: DataFrame, replaced: DataFrame) -> None:
    """Make a version visible. documents: document_id, n_chunks; replaced: document_id, version, n_chunks."""
    replaced.select("document_id", F.col("version").alias("dead_version"), "n_chunks").write.mode("overwrite").parquet(
        f"{path}/_dead/version={version}")
    documents.write.parquet(f"{path}/_manifest/version={version}")


def _write_chunks(spark: SparkSession, path: str, version: int, chunks: DataFrame) -> None:
    target = f"{path}/version={version}"
    (chunks.repartitionByRange("document_id").sortWithinPartitions("document_id", "sequence")
     .write.mode("overwrite").parquet(target))
    files = read_table(spark, target)
    if files is not None:
        files.groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.min("document_id").alias("low"), F.max("document_id").alias("high")).write.mode("overwrite").parquet(f"{path}/_files/version={version}")


def add_batch(spark: SparkSession, path: str, documents: DataFrame, chunks: DataFrame) -> int:
    """Store the chunks of these documents (document_id); whatever each had before is gone, also if it has none now.

    chunks: document_id, sequence and further columns. Returns the version.
    """
    state = _state(spark, path)
    version = _next(state)
    chunks = materialise(chunks)
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    named = materialise(documents.select("document_id").distinct().join(counts, "document_id", "left").select(
        "document_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")))
    _write_chunks(spark, path, version, chunks)
    _commit(spark, path, version, named, live_documents(spark, path, state).join(named.select("document_id"), "document_id", "left_semi"))
    return version


def remove_documents(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """Take documents out of the store; how many chunks each has lost (0 for one that was not there). Reads no chunk."""
    state = _state(spark, path)
    ids = materialise(documents.select("document_id").distinct())
    gone = materialise(live_documents(spark, path, state).join(ids, "document_id", "left_semi"))
    _commit(spark, path, _next(state), ids.withColumn("n_chunks", F.lit(0).cast("bigint")), gone)
    return ids.join(gone.select("document_id", "n_chunks"), "document_id", "left").select(
        "document_id", F.coalesce("n_chunks", F.lit(0)).alias("n_deleted"))


# --- reading a part -----------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """Chunks from some of the files, and how many of all files those are."""

    chunks: DataFrame
    n_files: int
    n_all_files: int


def read_documents(spark: SparkSession, path: str, documents: DataFrame) -> Part:
    """The files that may hold chunks of these documents (document_id), and no others.

    What comes to the driver is a row for each file (its path and two numbers), which any reader of files lists too.
    """
    state = _state(spark, path)
    files = _seen(_part(spark, path, "files", _FILES), state.seen).orderBy("version", "low", "path").collect()
    found = set()
    by_version: dict[int, list[int]] = {}
    for i, f in enumerate(files):
        by_version.setdefault(f["version"], []).append(i)
    # Files of a version are in order and share at most the documents at their edges.
    ranges = [(np.array(own), np.array([files[i]["low"] for i in own]), np.array([files[i]["high"] for i in own])) for own in by_version.values()]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(len(files), bool)
        for batch in batches:
            ids = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            for own, low, high in ranges:
                # The files from the first that ends at the id or later to the last that starts there or earlier.
                first, last = np.searchsorted(high, ids, "left"), np.searchsorted(low, ids, "right")
                met = first < last
                edges = np.zeros(len(own) + 1, np.int64)
                np.add.at(edges, first[met], 1)
                np.add.at(edges, last[met], -1)
                hit[own] |= np.cumsum(edges)[:-1] > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(hit), pa.int32())], names=["file"])

    if files:
        found = {r[0] for r in documents.select(F.col("document_id").cast("bigint")).mapInArrow(hits, "file int").distinct().collect()}
    paths = [files[i]["path"] for i in sorted(found)]
    whole = read_table(spark, path)
    if whole is None or not paths:
        empty = spark.createDataFrame([], whole.drop("version").schema) if whole is not None else None
        return Part(empty, 0, len(files))
    rows = spark.read.schema(whole.schema).option("basePath", path).parquet(*paths)
    return Part(_merged(spark, path, rows, state), len(paths), len(files))


# --- compaction ---------------------------------------------------------------------------


def compact(spark: SparkSession, path: str, least_chunks: int = 1_000_000, most_dead: float = 0.2) -> list[int]:
    """Gather small versions, and those of which a larger share is dead, into a new one. Returns the versions gathered.

    Only their chunks are read and written; readers see the same chunks before and after.
    """
    state = _state(spark, path)
    live = live_documents(spark, path, state)
    held = _seen(_part(spark, path, "manifest", _MANIFEST), state.seen).groupBy("version").agg(F.sum("n_chunks").alias("held"))
    alive = live.groupBy("version").agg(F.sum("n_chunks").alias("alive"))
    sums = held.join(alive, "version", "left").select("version", "held", F.coalesce("alive", F.lit(0)).alias("alive")).collect()  # a row a batch
    old = sorted(r["version"] for r in sums if r["held"] < least_chunks or r["alive"] < (1 - most_dead) * r["held"])
    if len(old) < 2 and all(r["alive"] == r["held"] for r in sums if r["version"] in old):
        return []
    version = _next(state)
    moved = materialise(live.where(F.col("version").isin(old)))
    rows = read_table(spark, path).where(F.col("version").isin(old)).join(
        moved.select("document_id", "version"), ["document_id", "version"], "left_semi")
    _write_chunks(spark, path, version, rows.drop("version"))
    whole = spark.createDataFrame([(None, v, None) for v in old], "document_id bigint, version int, n_chunks bigint")
    _commit(spark, path, version, moved.select("document_id", "n_chunks"), whole)
    return old


def drop_unused(spark: SparkSession, path: str) -> list[int]:
    """Delete the chunk files of versions in which no document lives any more. Readers that began before must have ended."""
    state = _state(spark, path)
    alive = {r[0] for r in live_documents(spark, path, state).select("version").distinct().collect()}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    dropped = []
    for version in sorted(set(state.committed) - alive):
        places = [jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}version={version}") for folder in ("_files/", "")]
        if any([place.getFileSystem(conf).delete(place, True) for place in places]):
            dropped.append(version)
    return dropped
