"""The streams, drained over the supplied events; the batch folds give the expected rows."""

import uuid

from pyspark.sql import functions as F

from dossier.operators.embedding import HashProvider
from dossier.plans.ingest import read_chunks
from dossier.streaming import streams
from workload.access import RATE_LIMIT_SQL
from workload.chunking import packed_sql
from workload.base import JOB_EVENT_OF_EVENT, STATUS_OF_EVENT, mapped, query, scratch, sql_mapped, table
from workload.ingestion import JOB_FOLD_SQL
from workload.sources import line_parser, stored_documents
from workload.workflow import REPLAY_SQL

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark, sf):
    """The events file as a stream, in one or several micro-batches."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def drained(spark, frame, mode="append"):
    """Run a stream until its input is used up; its output as a table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    path, checkpoint = scratch(spark, "stream"), scratch(spark, "stream-state")
    run = (frame.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
           .queryName(f"drain_{uuid.uuid4().hex}").trigger(availableNow=True).start(path))
    run.awaitTermination()
    return spark.read.schema(frame.schema).parquet(path)


@query("l2_rate_limit_stream", RATE_LIMIT_SQL)
def rate_limit(spark, sf):
    attempts = event_stream(spark, sf).select(
        F.col("user_id").alias("client"), F.col("event_id").alias("attempt_id"), "ts")
    return drained(spark, streams.rate_limit_stream(attempts, 24 * 3600, 5)).select(
        "client", "attempt_id", "admitted")


@query("l3_stale_job_stream", JOB_FOLD_SQL + """
SELECT event_id, job_id, coalesce(status, '') AS status, attempts::INT AS attempts, coalesce(last_error, '') AS last_error FROM folded""")
def stale_jobs(spark, sf):
    """With a limit beyond the length of the table no job becomes stale: states are the batch's."""
    events = event_stream(spark, sf).select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        mapped(F.col("event_type"), JOB_EVENT_OF_EVENT).alias("event"),
        F.when(F.col("event_type") == "error",
               F.concat(F.lit("ParserError: "), F.col("event_id").cast("string"))).alias("error"))
    found = drained(spark, streams.stale_job_stream(events, minutes=60 * 24 * 400))
    return found.where(F.col("event_id").isNotNull()).select(
        "event_id", "job_id", F.coalesce("status", F.lit("")).alias("status"), "attempts",
        F.coalesce("last_error", F.lit("")).alias("last_error"))


_STALE_SQL = f"""
WITH RECURSIVE said AS (
  SELECT user_id AS job_id, {sql_mapped("event_type", JOB_EVENT_OF_EVENT)} AS event, epoch_us(ts) // 1000 AS ms,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events),
folded AS (
  SELECT job_id, n, total, ms, CASE WHEN event = 'enqueue' THEN 'pending' END AS status, 0 AS attempts, NULL::BIGINT AS due, NULL::VARCHAR AS due_status, NULL::INT AS due_attempts
  FROM said WHERE n = 1
  UNION ALL
  SELECT job_id, n, total, ms,
    CASE WHEN event = 'enqueue' AND (st IS NULL OR st IN ('done', 'failed')) THEN 'pending' WHEN event = 'claim' AND st = 'pending' THEN 'running'
      WHEN event = 'success' AND st = 'running' THEN 'done'
      WHEN event IN ('failure', 'stale') AND st = 'running' THEN CASE WHEN att + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE st END,
    CASE WHEN event = 'enqueue' AND (st IS NULL OR st IN ('done', 'failed')) THEN 0 WHEN event IN ('failure', 'stale') AND st = 'running' THEN att + 1 ELSE att END,
    CASE WHEN late THEN before_ms + 1800000 END, CASE WHEN late THEN st END, CASE WHEN late THEN att END
  FROM (SELECT s.*, f.ms AS before_ms, coalesce(f.status = 'running' AND s.ms > f.ms + 1800000, false) AS late,
      CASE WHEN late THEN CASE WHEN f.attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE f.status END AS st,
      CASE WHEN late THEN f.attempts + 1 ELSE f.attempts END AS att
    FROM folded f JOIN said s ON s.job_id = f.job_id AND s.n = f.n + 1))
SELECT job_id, due AS ms, 'stale' AS event, due_status AS status, due_attempts::INT AS attempts,
  'StaleJobError: no progress for over 30 minutes; worker presumed dead' AS last_error FROM folded WHERE due IS NOT NULL
UNION ALL
SELECT job_id, ms + 1800000, 'stale', CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END, (attempts + 1)::INT,
  'StaleJobError: no progress for over 30 minutes; worker presumed dead'
FROM folded WHERE n = total AND status = 'running' AND ms + 1800000 <= (SELECT max(epoch_us(ts) // 1000) FROM events)"""


@query("l3_stale_failures", _STALE_SQL)
def stale_failures(spark, sf):
    """Jobs that run on for more than half an hour without an event."""
    events = event_stream(spark, sf).select(
        F.col("user_id").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        mapped(F.col("event_type"), JOB_EVENT_OF_EVENT).alias("event"), F.lit(None).cast("string").alias("error"))
    return drained(spark, streams.stale_job_stream(events)).where("event_id IS NULL").select(
        "job_id", "ms", "event", "status", "attempts", "last_error")


@query("l4_transition_stream", REPLAY_SQL + """
SELECT case_id, request_id, target_status, status, accepted FROM folded""")
def transitions(spark, sf):
    requests = event_stream(spark, sf).select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("request_id"), "ts",
        mapped(F.col("event_type"), STATUS_OF_EVENT).alias("target_status"))
    return drained(spark, streams.transition_stream(requests)).select(
        "case_id", "request_id", "target_status", "status", "accepted")


_LINES = r"""(SELECT doc_id, doc_id || ' ' || replace(text, E'\n', ' ') AS text FROM documents)"""


@query("l1_ingest_stream", packed_sql(["doc_id"], "text", _LINES, 800, 100) + """
SELECT regexp_replace(source, '\\D', '', 'g')::BIGINT AS case_id, count(*) AS n_chunks, sum(len(p.text))::BIGINT AS n_chars FROM pieces p JOIN documents USING (doc_id) GROUP BY 1""")
def ingest(spark, sf):
    """Files written from the documents table, ingested until none is left."""
    root = stored_documents(spark, sf)
    store, ledger = scratch(spark, "chunks"), scratch(spark, "ledger")
    streams.ingest_stream(spark, root, store, ledger, scratch(spark, "stream-state"), line_parser,
                          lambda: HashProvider(16), 16, extensions=[".txt"]).awaitTermination()
    return read_chunks(spark, store).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))
