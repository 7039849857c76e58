"""Incremental ingestion and the job ledger, each step as a transform of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.operators.ordered import Machine, number_rows, replay
from dossier.schemas import MAX_ATTEMPTS, STALE_MINUTES


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def changed_documents(documents: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Documents (document_id, content_hash, ...) that differ from their last successful run."""
    if force:
        return documents
    last = ledger.select("document_id", F.col("ingested_content_hash").alias("_last"))
    return documents.join(last, "document_id", "left").where(
        ~F.col("content_hash").eqNullSafe(F.col("_last"))).drop("_last")


def replace_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Old chunks of every document that comes again are gone; its new ones are there."""
    again = new.select("document_id").distinct()
    return existing.join(again, "document_id", "left_anti").unionByName(new)


def delete_chunks(existing: DataFrame, document_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left, and how many chunks each named document lost (0 included)."""
    ids = document_ids.select("document_id").distinct()
    removed = (
        existing.select("document_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    )
    counts = ids.join(removed, "document_id", "left").select(
        "document_id", F.coalesce("n", F.lit(0)).alias("n_deleted"))
    return existing.join(ids, "document_id", "left_anti"), counts


def append_chunks(path: str, new: DataFrame) -> None:
    """Add chunks of documents not stored yet; refuse a (document, sequence) already there."""
    from dossier.operators.quality import unique_violations

    key = ["document_id", "sequence"]
    doubled = unique_violations(new, key).head()
    if doubled is None:
        try:
            stored = new.sparkSession.read.parquet(path).select(*key)
        except Exception as exc:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
                raise
        else:
            doubled = stored.join(new.select(*key), key, "left_semi").head()
    if doubled is not None:
        raise ValueError(
            f"chunk {doubled['sequence']} of document {doubled['document_id']} is there already")
    new.write.mode("append").parquet(path)


JOB_EVENTS = ["enqueue", "claim", "success", "failure", "stale"]

# --- the job ledger -----------------------------------------------------------------------


def enqueue(jobs: DataFrame, documents: DataFrame, now: Column, order: str = "document_id") -> DataFrame:
    """The ledger with one new pending job per document; ids go on from the highest one."""
    highest = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0)).alias("m")).head()["m"]
    new = number_rows(documents.select("document_id"), [], [order], "_n").select(
        (F.col("_n") + highest + 1).alias("job_id"), "document_id",
        F.lit("pending").alias("status"), F.lit(0).alias("attempts"),
        F.lit(None).cast("string").alias("last_error"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    return jobs.unionByName(new)


def claim_batch(jobs: DataFrame, n: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """The n oldest pending jobs, and the ledger in which they are running."""
    taken = jobs.where(F.col("status") == "pending").orderBy("job_id").limit(n)
    marks = taken.select("job_id", F.lit(True).alias("_taken"))
    ledger = jobs.join(marks, "job_id", "left")
    ledger = ledger.withColumn(
        "status", F.when(F.col("_taken"), F.lit("running")).otherwise(F.col("status"))
    ).withColumn("updated_at", F.when(F.col("_taken"), now).otherwise(F.col("updated_at")))
    return taken, ledger.drop("_taken")


def stale_jobs(jobs: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    """Jobs running without progress for longer than the limit."""
    return jobs.where(
        (F.col("status") == "running")
        & (F.col("updated_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")))


def stale_error(minutes: int = STALE_MINUTES) -> str:
    return f"StaleJobError: no progress for over {minutes} minutes; worker presumed dead"


def settle(jobs: DataFrame, outcomes: DataFrame, now: Column,
           max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The ledger after outcomes (job_id, error; a null error is success), one per job."""
    joined = jobs.join(
        outcomes.select("job_id", F.lit(True).alias("_settled"), F.col("error").alias("_error")),
        "job_id", "left")
    failed = F.col("_error").isNotNull()
    status = (
        F.when(F.col("_settled").isNull(), F.col("status"))
        .when(~failed, F.lit("done"))
        .when(F.col("attempts") + 1 >= max_attempts, F.lit("failed"))
        .otherwise(F.lit("pending"))
    )
    return joined.select(
        "job_id", "document_id", status.alias("status"),
        (F.col("attempts") + failed.cast("int")).alias("attempts"),
        F.when(F.col("_settled").isNull(), F.col("last_error"))
        .when(failed, F.col("_error")).alias("last_error"),
        "created_at",
        F.when(F.col("_settled"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def advance(state: tuple, values: tuple, max_attempts: int) -> tuple[tuple, tuple]:
    """One event of a job. An event that does not fit the current status changes nothing.

    State: (status, attempts, last_error); no status before the job is queued.
    """
    status, attempts, error = state
    kind, message = values
    if kind == "enqueue" and status in (None, "done", "failed"):
        status, attempts, error = "pending", 0, None
    elif kind == "claim" and status == "pending":
        status = "running"
    elif kind == "success" and status == "running":
        status, error = "done", None
    elif kind in ("failure", "stale") and status == "running":
        attempts += 1
        status = "failed" if attempts >= max_attempts else "pending"
        error = message or kind
    state = (status, attempts, error)
    return state, state


def replay_jobs(events: DataFrame, order: list[str], key: str = "job_id",
                max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Last state of each job from its events (event, error) in order.

    Status and attempts are a machine of few states. The last error is that of the last event
    that set or cleared one, which depends on the status before it.
    """
    states = [(None, 0), *[(s, n) for s in ("pending", "running", "done", "failed") for n in range(max(1, max_attempts) + 1)]]
    machine = Machine(states, (None, 0), JOB_EVENTS, lambda state, event: _bounded(
        advance((*state, None), (event, None), max_attempts)[0][:2], states))
    seen = replay(events, [key], order, machine, "event", "_before", "_after")
    status = F.array(*[F.lit(s).cast("string") for s, _ in states])
    attempts = F.array(*[F.lit(n) for _, n in states])
    was, event = status[F.col("_before")], F.col("event")
    failed = event.isin("failure", "stale") & (was == "running")
    cleared = ((event == "enqueue") & (was.isNull() | was.isin("done", "failed"))) | ((event == "success") & (was == "running"))
    told = F.when(F.coalesce(failed, F.lit(False)), F.coalesce(F.when(F.col("error") != "", F.col("error")), event))
    at = F.struct(*order)
    last = seen.groupBy(key).agg(
        F.max_by("_after", at).alias("_state"),
        F.max_by(told, F.when(failed | cleared, at)).alias("last_error"))
    return last.select(key, status[F.col("_state")].alias("status"), attempts[F.col("_state")].alias("attempts"), "last_error")


def _bounded(state: tuple, states: list) -> tuple:
    """A state that no run of events leads to may count beyond the last one; it is never entered."""
    return state if state in states else (state[0], states[-1][1])
