"""Streams in several micro-batches give the rows of their batch twins."""

import random
import sys
import uuid
from datetime import datetime, timedelta

from pyspark import cloudpickle

from dossier.operators import access, workflow
from dossier.operators.embedding import HashProvider
from dossier.plans.ingest import read_chunks
from dossier.schemas import CASE_STATUSES
from dossier.streaming import streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])

START = datetime(2024, 1, 1)


def feed(spark, tmp_path, rows, schema, n_files=3):
    """Rows in event order as files of their own, read one file per micro-batch."""
    source = tmp_path / "in"
    for i in range(n_files):
        part = rows[i * len(rows) // n_files:(i + 1) * len(rows) // n_files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def drain(spark, tmp_path, frame):
    out, state = str(tmp_path / "out"), str(tmp_path / f"state-{uuid.uuid4().hex}")
    run = (frame.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
           .trigger(availableNow=True).start(out))
    run.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def test_rate_limit(spark, tmp_path):
    rng, clock, rows = random.Random(1), 0.0, []
    for i in range(600):
        clock += rng.expovariate(1 / 3)
        rows.append((rng.choice("aaab"), i, START + timedelta(seconds=clock)))
    schema = "client string, attempt_id bigint, ts timestamp_ntz"
    got = drain(spark, tmp_path, streams.rate_limit_stream(feed(spark, tmp_path, rows, schema)))
    want = access.admit_rate_limited(spark.createDataFrame(rows, schema))
    assert {(r["attempt_id"], r["admitted"]) for r in got.collect()} == {
        (r["attempt_id"], r["admitted"]) for r in want.collect()}


def shuffled_feed(spark, tmp_path, rows, schema, rng, n_files):
    """Rows in order of time, each moved to one of the two files after its own or staying; and the number of its file."""
    placed = [(min(n_files - 1, i * n_files // len(rows) + rng.randrange(3)), row) for i, row in enumerate(rows)]
    source = tmp_path / "in"
    for n in range(n_files):
        part = [row for f, row in placed if f == n]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    batches = spark.createDataFrame([(*row, f) for f, row in placed], schema + ", batch int")
    return stream, batches


def progress(spark, tmp_path, frame):
    """The stream drained, its output and the rows of state it ends with."""
    out, state = str(tmp_path / "out"), str(tmp_path / f"state-{uuid.uuid4().hex}")
    run = (frame.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
           .trigger(availableNow=True).start(out))
    run.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out), run.lastProgress["stateOperators"][0]


ATTEMPT = "client string, attempt_id bigint, ts timestamp"


def test_rate_limit_out_of_order_and_late(spark, tmp_path):
    """Rows over micro-batches out of order: the late ones are dropped as the batch rule says, the others admitted as in batch."""
    rng, clock, rows = random.Random(4), 0.0, []
    for i in range(500):
        clock += rng.expovariate(1 / 3)
        rows.append((rng.choice("aaab"), i, START + timedelta(seconds=clock)))
    end = START + timedelta(days=1)
    rows += [("closing", 10_000 + i, end + timedelta(hours=i)) for i in range(4)]
    for delay in (30, 3600):
        path = tmp_path / str(delay)
        stream, batches = shuffled_feed(spark, path, rows, ATTEMPT, random.Random(5), 8)
        got, _ = progress(spark, path, streams.rate_limit_stream(stream, delay=f"{delay} seconds"))
        kept = streams.in_time(batches, delay)
        want = {(r["attempt_id"], r["admitted"]) for r in access.admit_rate_limited(kept).collect() if r["attempt_id"] < 10_000}
        assert {(r["attempt_id"], r["admitted"]) for r in got.collect() if r["attempt_id"] < 10_000} == want
        assert (len(want) == 500) == (delay == 3600)


def test_state_is_empty_after_the_window(spark, tmp_path):
    rows = [("a", i, START + timedelta(seconds=i)) for i in range(10)] + [("b", 100, START + timedelta(days=1))] + [
        ("c", 200, START + timedelta(days=2))]
    got, state = progress(spark, tmp_path, streams.rate_limit_stream(feed(spark, tmp_path, rows, ATTEMPT, 4)))
    assert sum(r["admitted"] for r in got.where("client = 'a'").collect()) == 5
    # Of the four clients' rows only the last one's admitted time and its timer are left.
    assert state["numRowsTotal"] <= 4


def test_transitions_out_of_order(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(5), i, START + timedelta(minutes=i), rng.choice(CASE_STATUSES[:5])) for i in range(300)]
    closing = [(99, 1000 + i, START + timedelta(days=9 + i), "draft") for i in range(4)]
    schema = "case_id bigint, request_id bigint, ts timestamp, target_status string"
    stream, _ = shuffled_feed(spark, tmp_path, rows + closing, schema, rng, 9)
    got = drain(spark, tmp_path, streams.transition_stream(stream, delay="2 days"))
    want = workflow.replay_transitions(spark.createDataFrame(rows, schema), ["ts", "request_id"])
    key = lambda r: (r["request_id"], r["status"], r["accepted"])
    assert {key(r) for r in got.where("case_id < 99").collect()} == {key(r) for r in want.collect()}


def test_transitions(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randrange(5), i, START + timedelta(minutes=i), rng.choice(CASE_STATUSES[:5])) for i in range(400)]
    schema = "case_id bigint, request_id bigint, ts timestamp_ntz, target_status string"
    got = drain(spark, tmp_path, streams.transition_stream(feed(spark, tmp_path, rows, schema)))
    want = workflow.replay_transitions(spark.createDataFrame(rows, schema), ["ts", "request_id"])
    key = lambda r: (r["request_id"], r["status"], r["accepted"])
    assert {key(r) for r in got.collect()} == {key(r) for r in want.collect()}


def test_stale_jobs(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    rows = [
        (1, 1, at(0), "enqueue", None), (2, 2, at(0), "enqueue", None), (1, 3, at(1), "claim", None), (2, 4, at(1), "claim", None),
        (2, 5, at(20), "success", None), (3, 6, at(40), "enqueue", None),  # job 1 is late by now
        (1, 7, at(50), "claim", None), (1, 8, at(60), "failure", "E: x"), (1, 9, at(70), "claim", None), (4, 10, at(200), "enqueue", None),
    ]
    schema = "job_id bigint, event_id bigint, ts timestamp, event string, error string"
    got = drain(spark, tmp_path, streams.stale_job_stream(feed(spark, tmp_path, rows, schema, 5)))
    stale = got.where("event_id IS NULL").orderBy("ms").collect()
    minute = lambda r: (r["ms"] - int(START.timestamp() * 1000)) / 60000
    assert [(r["job_id"], minute(r), r["status"], r["attempts"]) for r in stale] == [
        (1, 31, "pending", 1), (1, 100, "failed", 3)]
    assert stale[0]["last_error"] == "StaleJobError: no progress for over 30 minutes; worker presumed dead"
    assert {(r["job_id"], r["status"]) for r in got.where("event = 'success'").collect()} == {(2, "done")}


def parser():
    return lambda content: content.decode().split("|")


def embedder():
    return HashProvider(4)


def test_ingest_stream_goes_on_where_it_stopped(spark, tmp_path):
    root = tmp_path / "files"
    store, ledger, state = (str(tmp_path / n) for n in ("chunks", "ledger", "state"))

    def run():
        streams.ingest_stream(spark, str(root), store, ledger, state, parser, embedder, 4, files_per_batch=2).awaitTermination()
        return sorted((r["case_id"], r["text"]) for r in read_chunks(spark, store).collect())

    def put(case, name, text):
        (root / str(case)).mkdir(parents=True, exist_ok=True)
        (root / str(case) / name).write_text(text)

    for i in range(3):
        put(7, f"{i}.pdf", f"text {i}")
    put(8, "x.txt", "no parser for this")
    assert run() == [(7, "text 0"), (7, "text 1"), (7, "text 2")]
    put(8, "y.pdf", "late|more")
    assert run() == [(7, "text 0"), (7, "text 1"), (7, "text 2"), (8, "late"), (8, "more")]
    spark.createDataFrame([(1,)], "i int").count()
    assert spark.read.parquet(ledger).count() == 4


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    """A watermark counts against late rows from the micro-batch after the next one."""
    at = lambda m: START + timedelta(minutes=m)
    rows = [(1, 1, at(0), "enqueue", None), (2, 2, at(500), "enqueue", None), (4, 4, at(501), "enqueue", None), (3, 3, at(1), "enqueue", None)]
    schema = "job_id bigint, event_id bigint, ts timestamp, event string, error string"
    got = drain(spark, tmp_path, streams.stale_job_stream(feed(spark, tmp_path, rows, schema, 4)))
    assert {r["job_id"] for r in got.collect()} == {1, 2, 4}


def test_waiting_rows_are_not_read_when_rows_come_in():
    """Rows that come in cost no look at those that wait; the one timer moves only to an earlier row."""
    import pandas as pd

    class Handle:
        timers = [40]

        def listTimers(self):
            return iter([(t,) for t in self.timers])

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    class Waiting:
        rows = []

        def appendList(self, rows):
            self.rows += rows

        def get(self):
            raise AssertionError("read")

    one = streams._RateLimit(1000, 1)
    one.handle, one.waiting = Handle(), Waiting()
    come = lambda *us: list(one.handleInputRows((1,), iter([pd.DataFrame({"us": us, "id": range(len(us)), "value": None})]), None))
    assert come(90_000, 50_000) == [] and one.handle.timers == [40]
    come(30_001, 60_000)
    assert one.handle.timers == [31] and len(one.waiting.rows) == 4
