"""Incremental ingestion, the job ledger, stores and data quality."""

import sys
from datetime import datetime, timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from dossier.operators import ingestion, quality
from dossier.operators.embedding import HashProvider
from dossier.plans import ingest as plan
from dossier.schemas import CASE_STATUSES, NEW_STATUS_TO_OLD, OLD_ROLE_TO_NEW, OLD_STATUS_TO_NEW
from dossier.sources import corpus, files, runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = datetime(2024, 5, 1, 12)
FILE = "document_id bigint, case_id bigint, filename string, content binary"


def parser():
    def read(content):
        if content.startswith(b"%broken"):
            raise ValueError("cannot read")
        return content.decode().split("|")

    return read


def embedder():
    return HashProvider(4)


def once(spark, frame, rows, store, ledger, force=False):
    result = plan.ingest(frame(rows, FILE), plan.read_ledger(spark, ledger), parser, embedder, 4, force, size=10, overlap=0)
    outcomes = {r["document_id"]: (r["status"], r["n_chunks"]) for r in result.outcomes.collect()}
    plan.store(result, store, ledger)
    chunks = {(r["document_id"], r["sequence"]): r["text"] for r in plan.read_chunks(spark, store).collect()}
    return outcomes, chunks


def test_ingest_again_and_again(spark, frame, tmp_path):
    store, ledger = str(tmp_path / "chunks"), str(tmp_path / "ledger")
    a, b = bytearray(b"one two three|four"), bytearray(b"other text")
    rows = [(1, 10, "a.pdf", a), (2, 10, "b.PDF", b), (3, 11, "c.docx", a), (4, 11, "d.pdf", bytearray(b"%broken"))]
    outcomes, chunks = once(spark, frame, rows, store, ledger)
    assert outcomes == {1: ("ingested", 3), 2: ("ingested", 1), 3: ("unsupported", 0), 4: ("failed", 0)}
    assert chunks == {(1, 0): "one two", (1, 1): "three", (1, 2): "four", (2, 0): "other text"}
    # Same contents: nothing to do, but what failed is tried again.
    outcomes, again = once(spark, frame, rows, store, ledger)
    assert outcomes == {1: ("unchanged", 0), 2: ("unchanged", 0), 3: ("unsupported", 0), 4: ("failed", 0)}
    assert again == chunks
    # One document has changed: all its old chunks are gone.
    rows[0] = (1, 10, "a.pdf", bytearray(b"new"))
    outcomes, chunks = once(spark, frame, rows, store, ledger)
    assert outcomes[1] == ("ingested", 1) and outcomes[2] == ("unchanged", 0)
    assert chunks == {(1, 0): "new", (2, 0): "other text"}
    outcomes, chunks = once(spark, frame, rows, store, ledger, force=True)
    assert outcomes[1] == ("ingested", 1) and outcomes[2] == ("ingested", 1)
    assert chunks == {(1, 0): "new", (2, 0): "other text"}


def test_refused_and_vanished_documents_are_outcomes(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MAX_UPLOAD_BYTES", 12)
    rows = [(1, 10, "a.pdf", bytearray(b"twelve bytes")), (2, 10, "b.pdf", bytearray(b"thirteen bytes")), (3, 10, "c.exe", bytearray(b"x")),
            (4, 10, "d.PNG", bytearray(b"x"))]
    result = plan.ingest(frame(rows, FILE), plan.read_ledger(spark, str(tmp_path / "none")), parser, embedder, 4,
                         requested=frame([(1,), (9,)], "document_id bigint"))
    got = {r["document_id"]: (r["status"], r["error"]) for r in result.outcomes.collect()}
    assert got == {1: ("ingested", None), 2: ("rejected", "File exceeds maximum allowed size of 10 MB"),
                   3: ("rejected", "File type '.exe' is not allowed"),
                   4: ("unsupported", "UnsupportedFileTypeError: no parser for this file type"),
                   9: ("failed", "ValueError: Document 9 no longer exists")}


def test_changed_documents(frame):
    docs = frame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "document_id bigint, content_hash string")
    ledger = frame([(1, "a"), (2, "x"), (3, None)], "document_id bigint, ingested_content_hash string")
    assert {r[0] for r in ingestion.changed_documents(docs, ledger).collect()} == {2, 3, 4}
    assert ingestion.changed_documents(docs, ledger, force=True).count() == 4


def test_delete_and_append(spark, frame, tmp_path):
    old = frame([(1, 0), (1, 1), (2, 0)], "document_id bigint, sequence int")
    left, counts = ingestion.delete_chunks(old, frame([(1,), (9,)], "document_id bigint"))
    assert [tuple(r) for r in left.collect()] == [(2, 0)]
    assert {tuple(r) for r in counts.collect()} == {(1, 2), (9, 0)}
    path = str(tmp_path / "chunks")
    ingestion.append_chunks(path, old)
    ingestion.append_chunks(path, frame([(3, 0)], "document_id bigint, sequence int"))
    with pytest.raises(ValueError, match="chunk 0 of document 2"):
        ingestion.append_chunks(path, frame([(2, 0)], "document_id bigint, sequence int"))
    assert spark.read.parquet(path).count() == 4


JOB = "job_id bigint, document_id bigint, status string, attempts int, last_error string, created_at timestamp_ntz, updated_at timestamp_ntz"


def job(i, status, attempts=0, minutes=0, error=None):
    return (i, i * 10, status, attempts, error, NOW, NOW - timedelta(minutes=minutes))


def now():
    return F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz")


def test_enqueue_and_claim(frame):
    jobs = frame([job(3, "pending"), job(7, "running"), job(5, "pending"), job(6, "failed")], JOB)
    more = ingestion.enqueue(jobs, frame([(70,), (60,)], "document_id bigint"), now())
    assert {(r["job_id"], r["document_id"]) for r in more.where("job_id > 7").collect()} == {(8, 60), (9, 70)}
    taken, ledger = ingestion.claim_batch(more, 2, now())
    assert [r["job_id"] for r in taken.collect()] == [3, 5]
    assert {r["job_id"] for r in ledger.where("status = 'running'").collect()} == {3, 5, 7}


def test_first_job_has_number_one(frame):
    made = ingestion.enqueue(frame([], JOB), frame([(5,)], "document_id bigint"), now()).collect()
    assert [(r["job_id"], r["status"], r["attempts"]) for r in made] == [(1, "pending", 0)]


def test_stale_after_half_an_hour(frame):
    jobs = frame([job(1, "running", minutes=29), job(2, "running", minutes=31), job(3, "pending", minutes=90),
                  job(4, "running", minutes=30)], JOB)
    assert [r["job_id"] for r in ingestion.stale_jobs(jobs, now()).collect()] == [2]


def test_settle(frame):
    jobs = frame([job(1, "running", 1, error="E: old"), job(2, "running", 1), job(3, "running", 2), job(4, "running")], JOB)
    outcomes = frame([(1, None), (2, "E: x"), (3, "E: y")], "job_id bigint, error string")
    got = {r["job_id"]: (r["status"], r["attempts"], r["last_error"]) for r in ingestion.settle(jobs, outcomes, now()).collect()}
    assert got == {1: ("done", 1, None), 2: ("pending", 2, "E: x"), 3: ("failed", 3, "E: y"), 4: ("running", 0, None)}


# --- stores -------------------------------------------------------------------------------


def test_files_by_case(spark, frame, tmp_path):
    for case, name, body in [(7, "a.pdf", b"x"), (7, "b.pdf", b"yy"), (8, "a.pdf", b"zzz")]:
        (tmp_path / str(case)).mkdir(exist_ok=True)
        (tmp_path / str(case) / name).write_bytes(body)
    found = files.read_documents(spark, str(tmp_path))
    assert {(r["file_path"], r["case_id"], r["filename"], bytes(r["content"])) for r in found.collect()} == {
        ("7/a.pdf", 7, "a.pdf", b"x"), ("7/b.pdf", 7, "b.pdf", b"yy"), ("8/a.pdf", 8, "a.pdf", b"zzz")}
    wanted = frame([("7/a.pdf",), ("9/none.pdf",)], "file_path string")
    assert [r[0] for r in files.missing_files(wanted, found).collect()] == ["9/none.pdf"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_documents(spark, str(tmp_path / "nowhere")).count()


def test_rows_to_cases(frame):
    schema = "n int, case_facts string, court_reasoning array<string>, applicable_laws string, verdict string"
    train = frame([(1, "f1", ["r", "s"], "l", "v"), (0, "f0", [], "l", "v")], schema)
    test = frame([(5, "f5", None, "l", "v")], schema)
    got = {r["case_id"]: r["sections"] for r in corpus.rows_to_cases({"train": train, "test": test}, "n", "X").collect()}
    assert set(got) == {"X-train-0", "X-train-1", "X-test-0"}
    assert [s["text"] for s in got["X-train-1"]] == ["f1", "r\ns", "l", "v"]
    assert [s["name"] for s in got["X-train-0"]] == ["الوقائع", "الأسباب", "السند النظامي", "نص الحكم"]


def test_cases_json_keeps_arabic(spark, frame, tmp_path):
    cases = frame([("1", None, "الرياض", None, [("قسم", "نص")])],
                  "case_id string, court string, city string, date string, sections array<struct<name:string,text:string>>")
    for _ in range(2):
        corpus.write_cases(cases, str(tmp_path / "c"), "s")
    line, = spark.read.text(str(tmp_path / "c")).collect()
    assert line[0] == '{"source":"s","case_id":"1","court":null,"city":"الرياض","date":null,"sections":[{"name":"قسم","text":"نص"}]}'


def test_history_tolerates_broken_lines(spark, frame, tmp_path):
    assert runs.read_history(spark, str(tmp_path / "none")).count() == 0
    path = tmp_path / "h.jsonl"
    path.write_text('{"stamp": "2", "mode": "graph", "total": 3, "total_tokens": {"total": 5}}\n\n{"stamp": "3", "mo\n'
                    '{"stamp": "1", "mode": "direct", "context_hit_rate": {"mean": 1.0, "stdev": null, "rounds": 1}}\n'
                    '{"stamp": "2", "mode": "direct"}\n', encoding="utf-8")
    got = runs.read_history(spark, str(path)).collect()
    assert [(r["stamp"], r["mode"]) for r in got] == [("1", "direct"), ("2", "direct"), ("2", "graph")]
    assert got[2]["total_tokens"] == {"total": 5} and got[0]["context_hit_rate"]["stdev"] is None
    assert runs.count_malformed(spark, str(path)).head()[0] == 1


def test_gold_set(spark, tmp_path):
    path = tmp_path / "gold.json"
    path.write_text('{\n "corpus": "c", "chunker": {"window_size": 200, "overlap": 40},\n "items": [\n'
                    '  {"id": "a", "lang": "ar", "question": "س", "expected_section": "م", "expected_answer_contains": ["21"]},\n'
                    '  {"id": "b", "lang": "en", "question": "q", "expected_section": "s", "expected_answer_contains": []}\n ]\n}', encoding="utf-8")
    got = runs.read_gold(spark, str(path)).orderBy("id").collect()
    assert [(r["id"], r["question"], r["expected_answer_contains"]) for r in got] == [("a", "س", ["21"]), ("b", "q", [])]
    assert got[0]["chunker"]["window_size"] == 200


# --- quality ------------------------------------------------------------------------------


def test_quality_checks(frame):
    users = frame([("a", 1), ("a", 2), ("b", 3)], "email string, user_id bigint")
    assert [tuple(r) for r in quality.unique_violations(users, ["email"]).collect()] == [("a", 2)]
    rows = frame([(1,), (9,), (None,)], "user_id bigint")
    assert [r[0] for r in quality.foreign_key_violations(rows, "user_id", users, "user_id").collect()] == [9]
    states = frame([("draft",), ("open",), (None,)], "status string")
    assert {r[0] for r in quality.domain_violations(states, "status", CASE_STATUSES).collect()} == {"open", None}
    texts = frame([("  ", None), ("x", " "), ("y", "z")], "title string, content string")
    assert {tuple(r["blank"]) for r in quality.blank_violations(texts, ["title", "content"]).collect()} == {("title",), ("content",)}


def test_chunks_of_another_case(frame):
    documents = frame([(1, 10), (2, 11), (3, None)], "document_id bigint, case_id bigint")
    chunks = frame([(100, 1, 10), (101, 1, 11), (102, 2, None), (103, 9, 10), (104, 3, None)], "chunk_id bigint, document_id bigint, case_id bigint")
    got = {r["chunk_id"]: r["document_case_id"] for r in quality.chunk_case_violations(chunks, documents).collect()}
    assert got == {101: 10, 102: 11, 103: None}


def test_remaps(value):
    to_new = lambda s: value(quality.remap(F.lit(s), OLD_STATUS_TO_NEW, "draft"))
    assert [to_new(s) for s in ("OPEN", "IN_PROGRESS", "CLOSED", "?")] == ["draft", "in_progress", "closed", "draft"]
    assert [value(quality.remap(F.lit(s), NEW_STATUS_TO_OLD, "OPEN")) for s in CASE_STATUSES] == [
        "OPEN", "IN_PROGRESS", "IN_PROGRESS", "IN_PROGRESS", "IN_PROGRESS", "CLOSED"]
    assert value(quality.remap(F.lit("user"), OLD_ROLE_TO_NEW, "attorney")) == "attorney"


def test_insert_and_purge(frame):
    have = frame([(1, "kept")], "id int, v string")
    got = quality.insert_if_absent(have, frame([(1, "new"), (2, "two")], "id int, v string"), ["id"])
    assert {tuple(r) for r in got.collect()} == {(1, "kept"), (2, "two")}
    tables = {n: frame([(1,), (2,)], "case_id bigint") for n in ("cases", "documents", "chunks", "assignments")}
    left = quality.purge_cases(tables, frame([(1,)], "case_id bigint"))
    assert list(left) == ["chunks", "documents", "assignments", "cases"]
    assert all([r[0] for r in t.collect()] == [2] for t in left.values())


def test_stored_documents_fill_several_files(spark, tmp_path):
    """A source with more text than one upload may have is cut into files that are all admitted."""
    from workload.streams import ingest as drained

    rows = spark.range(3).selectExpr("id AS doc_id", "repeat('word ', 800000) AS text", "'src7' AS source")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    found = drained(spark, str(tmp_path)).collect()
    assert [r["case_id"] for r in found] == [7]
    assert found[0]["n_chunks"] > 3 * 4_000_000 // 800


def test_foreign_keys_are_checked_without_sorting_the_child(spark):
    from dossier.operators import quality as checks

    child = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 < 9 THEN id % 10 END AS ref")
    parent = spark.range(7).selectExpr("id AS key")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = checks.foreign_key_violations(child, "ref", parent, "key")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort [" not in plan
        assert sorted({r["ref"] for r in found.collect()}) == [7, 8] and found.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
