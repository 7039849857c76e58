"""Streams over attempts, job events, status requests and arriving files.

Rows later than the watermark are dropped (`in_time` is the batch rule). Attempts and requests wait
until the watermark has passed them and are taken in event order; job events are taken in event
order within a micro-batch. The batch operators give the expected result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql import types as T

from dossier.operators.access import admit
from dossier.operators.ingestion import advance, stale_error
from dossier.operators.workflow import move
from dossier.plans.ingest import ingest, read_ledger, register_files, store
from dossier.schemas import (
    MAX_ATTEMPTS, PARSEABLE_EXTENSIONS, RATE_LIMIT_ATTEMPTS, RATE_LIMIT_SECONDS, STALE_MINUTES,
)


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable")


class _InOrder(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them and are then taken in event order.

    A row comes in only while its time is beyond the watermark, so nothing can come before a row
    that has been taken. `take(rows)` gives the output of the rows that are due, `(us, id, value)`
    in order, and the time in microseconds up to which the other state is needed, if there is an
    end to it; `rest_until()` gives that time where no row is due, and `forget()` lets the state go.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([
            T.StructField("us", T.LongType()), T.StructField("id", T.LongType()), T.StructField("value", T.StringType())]))
        self.open_state(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            new = [(int(us), int(i), value if isinstance(value, str) else None)
                   for us, i, value in zip(frame["us"].tolist(), frame["id"].tolist(), frame["value"].tolist())]
            if new:
                self.waiting.appendList(new)
                earliest = min(r[0] for r in new)
                first = earliest if first is None else min(first, earliest)
        self._wake_by(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        due = [r for r in rows if r[0] <= passed]
        later = rows[len(due):]
        out, until = self.take(key, due) if due else (None, self.rest_until())
        if due and later:
            self.waiting.put(later)
        elif due:
            self.waiting.clear()
        if until is not None and until <= passed:
            self.forget()
            until = None
        # The timer that has just fired, the only one, is deleted by Spark.
        self._wake_by(later[0][0] if later else until, fired=True)
        if out is not None:
            yield out

    def _wake_by(self, us: int | None, fired: bool = False) -> None:
        """One timer, for the first row that waits or for the end of the state; rows that wait are not read for that.

        The timer there is stays unless a row must be taken before it.
        """
        if us is None:
            return
        due = -(-us // 1000)
        timers = [] if fired else [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
        if any(t <= due for t in timers):
            return
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)

    def rest_until(self) -> int | None:
        return None

    def forget(self) -> None:
        pass

    def close(self) -> None:
        pass


class _RateLimit(_InOrder):
    def __init__(self, window: int, limit: int) -> None:
        self.window, self.limit = window, limit

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", T.StructType([T.StructField("us", T.LongType())]))

    def take(self, key, rows: list[tuple]) -> tuple[pd.DataFrame, int | None]:
        recent = tuple(r[0] for r in self.recent.get())
        admitted = []
        for us, _, _ in rows:
            recent, (ok,) = admit(recent, (us,), self.window, self.limit)
            admitted.append(ok)
        self.recent.put([(t,) for t in recent])  # the last one that was taken is among them, or others as young
        out = pd.DataFrame({"client": key[0], "attempt_id": [r[1] for r in rows], "us": [r[0] for r in rows], "admitted": admitted})
        return out, self._end(recent)

    def _end(self, recent: tuple) -> int | None:
        return max(recent) + self.window if recent else None

    def rest_until(self) -> int | None:
        return self._end(tuple(r[0] for r in self.recent.get()))

    def forget(self) -> None:
        self.recent.clear()


def _waiting_rows(rows: DataFrame, key: str, row_id: str, value: Column, delay: str) -> DataFrame:
    """The watermark is one of whole milliseconds, to which times are rounded up: it then passes the latest row too."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = rows.select(key, F.col(row_id).alias("id"), us.alias("us"), value.alias("value"), F.timestamp_millis(_ceil_ms(us)).alias("time"))
    return timed.withWatermark("time", delay)


def _ceil_ms(us: Column) -> Column:
    return F.ceil(us / 1000).cast("bigint")


def rate_limit_stream(attempts: DataFrame, window_seconds: int = RATE_LIMIT_SECONDS,
                      limit: int = RATE_LIMIT_ATTEMPTS, delay: str = "0 seconds") -> DataFrame:
    """attempts: client, attempt_id bigint, ts. Each attempt with `admitted`, once the watermark has passed it.

    A client's state goes when the watermark is a window beyond its last admitted attempt.
    """
    kind = dict(attempts.dtypes)["client"]
    rows = _waiting_rows(attempts, "client", "attempt_id", F.lit(None).cast("string"), delay)
    return rows.groupBy("client").transformWithStateInPandas(
        _RateLimit(window_seconds * 1_000_000, limit),
        f"client {kind}, attempt_id bigint, us bigint, admitted boolean", "Append", "EventTime")


class _Transitions(_InOrder):
    def __init__(self, initial: str) -> None:
        self.initial = initial

    def open_state(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState(
            "status", T.StructType([T.StructField("status", T.StringType())]))

    def take(self, key, rows: list[tuple]) -> tuple[pd.DataFrame, None]:
        status = self.status.get()[0] if self.status.exists() else self.initial
        moves = []
        for _, _, target in rows:
            status, moved = move(status, (target,))
            moves.append(moved)
        self.status.update((status,))
        return pd.DataFrame({
            "case_id": key[0], "request_id": [r[1] for r in rows], "target_status": [r[2] for r in rows],
            "status": [m[0] for m in moves], "accepted": [m[1] for m in moves]}), None


def transition_stream(requests: DataFrame, initial: str = "draft", delay: str = "0 seconds") -> DataFrame:
    """requests: case_id bigint, request_id bigint, ts, target_status.

    Requests that come out of order by less than `delay` are taken in order of ts and request_id, as the batch replay
    takes them; a case's status stays for good.
    """
    rows = _waiting_rows(requests, "case_id", "request_id", F.col("target_status"), delay)
    return rows.groupBy("case_id").transformWithStateInPandas(
        _Transitions(initial),
        "case_id bigint, request_id bigint, target_status string, status string, accepted boolean",
        "Append", "EventTime")


def in_time(arrivals: DataFrame, delay_seconds: float = 0, batch: str = "batch") -> DataFrame:
    """Rows (ts, number of their micro-batch from 0 without holes) that a stream does not drop as late.

    The batch rule behind the streams: a micro-batch drops what is not beyond the watermark that
    the one before it ran with, the latest time of all still earlier ones less the delay.
    """
    time = _ceil_ms(F.unix_micros(F.col("ts").cast("timestamp")))
    latest = arrivals.groupBy(batch).agg(F.max(time).alias("_latest"))
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -2)  # one row per micro-batch
    marks = latest.select(batch, (F.max("_latest").over(before) - int(delay_seconds * 1000)).alias("_mark"))
    kept = arrivals.join(F.broadcast(marks), batch)  # one row per micro-batch
    return kept.where(F.col("_mark").isNull() | (time > F.col("_mark"))).drop("_mark")


class _Jobs(StatefulProcessor):
    def __init__(self, minutes: int, max_attempts: int) -> None:
        self.minutes, self.max_attempts = minutes, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", T.StructType([
            T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()),
            T.StructField("last_error", T.StringType()), T.StructField("ms", T.LongType())]))

    def _load(self) -> tuple[tuple, int]:
        if not self.job.exists():
            return (None, 0, None), 0
        status, attempts, error, ms = self.job.get()
        return (status, attempts, error), ms

    def _watch(self, state: tuple, ms: int) -> None:
        """One timer at most: it is set anew by each event while the job runs."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if state[0] == "running":
            self.handle.registerTimer(ms + self.minutes * 60_000)
        self.job.update((*state, ms))

    def _row(self, key, state: tuple, ms: int, event: str, event_id: int | None) -> dict:
        return {"job_id": key[0], "event_id": event_id, "ms": ms, "event": event,
                "status": state[0], "attempts": state[1], "last_error": state[2]}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, ms = self._load()
        out = []
        for row in _in_order(rows, ["ms", "event_id"]).itertuples():
            due = ms + self.minutes * 60_000
            if state[0] == "running" and row.ms > due:
                # Its timer had not fired yet when this event came in.
                state, _ = advance(state, ("stale", stale_error(self.minutes)), self.max_attempts)
                out.append(self._row(key, state, due, "stale", None))
            error = row.error if isinstance(row.error, str) else None
            state, _ = advance(state, (row.event, error), self.max_attempts)
            ms = max(ms, int(row.ms))
            out.append(self._row(key, state, int(row.ms), row.event, int(row.event_id)))
        self._watch(state, ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, _ = self._load()
        if state[0] != "running":
            return
        due = expiredTimerInfo.getExpiryTimeInMs()
        state, _ = advance(state, ("stale", stale_error(self.minutes)), self.max_attempts)
        self.job.update((*state, due))
        yield self._frame([self._row(key, state, due, "stale", None)])

    @staticmethod
    def _frame(rows: list[dict]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["job_id", "event_id", "ms", "event", "status",
                                            "attempts", "last_error"])
        return frame.astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def stale_job_stream(events: DataFrame, minutes: int = STALE_MINUTES,
                     max_attempts: int = MAX_ATTEMPTS, delay: str = "0 seconds") -> DataFrame:
    """events: job_id bigint, event_id bigint, ts timestamp, event, error.

    Each event with the state it leads to, and a stale failure for a job that runs on without
    any event for longer than the limit.
    """
    timed = events.withWatermark("ts", delay).select(
        "job_id", "event_id", "ts", "event", "error",
        F.unix_millis("ts").alias("ms"))
    return timed.groupBy("job_id").transformWithStateInPandas(
        _Jobs(minutes, max_attempts),
        "job_id bigint, event_id bigint, ms bigint, event string, status string, attempts int, last_error string",
        "Append", "EventTime")


def ingest_stream(spark: SparkSession, root: str, chunk_path: str, ledger_path: str,
                  checkpoint: str, parser: Callable, embedder: Callable, width: int,
                  files_per_batch: int = 1000,
                  extensions: list[str] = PARSEABLE_EXTENSIONS,
                  documents_path: str | None = None) -> StreamingQuery:
    """Ingest the files that have arrived under <root>/<case id>/ and stop when none is left.

    The stream's own checkpoint remembers which files were taken, so a restart goes on there. A file's document id
    is its number in the documents table (beside the ledger unless named), so a batch that is run again finds the same ids.
    """
    schema = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    files = (
        spark.readStream.format("binaryFile").schema(schema)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )
    from dossier.sources.files import _with_case

    named = _with_case(files, root)

    def drain(batch: DataFrame, _: int) -> None:
        documents = register_files(batch.sparkSession, documents_path or f"{ledger_path}-documents", batch)
        result = ingest(batch.join(documents, "file_path"), read_ledger(batch.sparkSession, ledger_path), parser, embedder, width,
                        extensions=extensions)
        store(result, chunk_path, ledger_path)

    return named.writeStream.foreachBatch(drain).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
