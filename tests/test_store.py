"""The versioned chunk store: files are added and never rewritten."""

import os
import time

import pytest
from pyspark.sql import functions as F

from dossier.plans.ingest import register_files
from dossier.sources import store

CHUNKS = "document_id bigint, sequence int, text string"


def files_of(path):
    """Every chunk file with its time of writing."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, names in os.walk(path) if "/version=" in d and "/_" not in d.removeprefix(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def shelf(spark, frame, tmp_path):
    """A store with helpers: put documents with a number of chunks, and read what is there."""
    path = str(tmp_path / "chunks")

    class Shelf:
        def put(self, mark, **sizes):
            ids = {int(k[1:]): n for k, n in sizes.items()}
            rows = [(i, s, f"{mark}{i}.{s}") for i, n in ids.items() for s in range(n)]
            return store.add_batch(spark, path, frame([(i,) for i in ids], "document_id bigint"), frame(rows, CHUNKS))

        def held(self):
            return sorted(r["text"] for r in store.read_chunks(spark, path).collect())

    made = Shelf()
    made.path = path
    return made


def test_nothing_stored(spark, tmp_path):
    assert store.read_chunks(spark, str(tmp_path / "none")) is None
    assert store.versions(spark, str(tmp_path / "none")) == []


def test_a_batch_rewrites_no_file(shelf):
    assert shelf.put("a", d1=2, d2=1, d3=1) == 1
    first = files_of(shelf.path)
    time.sleep(0.01)
    assert shelf.put("b", d2=2, d4=1, d3=0) == 2
    second = files_of(shelf.path)
    assert first.items() < second.items()
    assert shelf.held() == ["a1.0", "a1.1", "b2.0", "b2.1", "b4.0"]
    shelf.put("c", d3=1, d2=1)
    assert second.items() < files_of(shelf.path).items()
    assert shelf.held() == ["a1.0", "a1.1", "b4.0", "c2.0", "c3.0"]


def test_removed_documents_and_their_counts(spark, frame, shelf):
    shelf.put("a", d1=3, d2=1)
    shelf.put("b", d2=2)
    lost = store.remove_documents(spark, shelf.path, frame([(2,), (9,), (2,)], "document_id bigint"))
    assert {tuple(r) for r in lost.collect()} == {(2, 2), (9, 0)}
    assert shelf.held() == ["a1.0", "a1.1", "a1.2"]
    shelf.put("c", d2=1)
    assert shelf.held() == ["a1.0", "a1.1", "a1.2", "c2.0"]


def test_a_run_that_stopped_early_is_not_seen(spark, frame, shelf):
    shelf.put("a", d1=1)
    frame([(1, 0, "half"), (7, 0, "half")], CHUNKS).write.parquet(f"{shelf.path}/version=2")
    frame([(1, 1, 1)], "document_id bigint, dead_version int, n_chunks bigint").write.parquet(f"{shelf.path}/_dead/version=2")
    assert shelf.held() == ["a1.0"]
    assert shelf.put("b", d1=1) == 2 and shelf.held() == ["b1.0"]


def test_a_second_writer_of_a_version_fails(spark, frame, shelf):
    shelf.put("a", d1=1)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store._commit(spark, shelf.path, 1, frame([(1, 1)], "document_id bigint, n_chunks bigint"), store.live_documents(spark, shelf.path))


def test_compaction_keeps_the_chunks(spark, shelf):
    for i, mark in enumerate("abcd"):
        shelf.put(mark, d1=1, **{f"d{i + 2}": 2})
    before, files = shelf.held(), files_of(shelf.path)
    assert store.compact(spark, shelf.path) == [1, 2, 3, 4] and store.versions(spark, shelf.path) == [5]
    assert shelf.held() == before
    assert files.items() < files_of(shelf.path).items()
    assert store.drop_unused(spark, shelf.path) == [1, 2, 3, 4] and shelf.held() == before
    assert not set(files) & set(files_of(shelf.path))
    assert store.compact(spark, shelf.path) == [] and store.drop_unused(spark, shelf.path) == []
    assert shelf.put("e", d1=1) == 6
    assert shelf.held() == sorted([x for x in before if x != "d1.0"] + ["e1.0"])
    assert store.compact(spark, shelf.path, least_chunks=0, most_dead=0.05) == [5]  # a ninth of it is dead
    assert shelf.held() == sorted([x for x in before if x != "d1.0"] + ["e1.0"])


def test_only_the_files_of_the_wanted_documents_are_read(spark, frame, tmp_path):
    path = str(tmp_path / "chunks")
    rows = spark.range(4000).select(F.col("id").alias("document_id"), F.lit(0).alias("sequence"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 30).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.add_batch(spark, path, rows, rows)
        store.add_batch(spark, path, rows.where("document_id < 40"), rows.where("document_id < 40").withColumn("text", F.lit("new")))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    part = store.read_documents(spark, path, frame([(5,), (7,), (3999,), (None,), (9999,)], "document_id bigint"))
    assert part.n_all_files == len(files_of(path)) >= 6 and part.n_files < part.n_all_files
    read = [f for f in part.chunks.inputFiles() if "/chunks/version=" in f]
    assert len(read) == part.n_files <= 4
    found = {r["document_id"]: r["text"] for r in part.chunks.where("document_id IN (5, 7, 3999)").collect()}
    assert found[5] == found[7] == "new" and len(found[3999]) == 64 * 30
    assert part.chunks.groupBy("document_id").count().where("count > 1").count() == 0
    assert store.read_documents(spark, path, frame([(9999,)], "document_id bigint")).n_files == 0


def test_files_keep_their_numbers(spark, frame, tmp_path):
    path = str(tmp_path / "documents")
    paths = lambda *p: frame([(x,) for x in p], "file_path string")
    read = lambda df: {r["file_path"]: r["document_id"] for r in df.collect()}
    assert read(register_files(spark, path, paths("7/b", "7/a", "7/a"))) == {"7/a": 1, "7/b": 2}
    assert read(register_files(spark, path, paths("7/b", "6/c"))) == {"7/a": 1, "7/b": 2, "6/c": 3}
    assert read(register_files(spark, path, paths("7/b"))) == {"7/a": 1, "7/b": 2, "6/c": 3}
