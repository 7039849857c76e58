"""Hashes, chunk replacement, and the job ledger."""

from pyspark.sql import functions as F

from dossier.operators import ingestion
from dossier.operators.embedding import HashProvider
from dossier.plans import ingest as plan
from workload.base import JOB_EVENT_OF_EVENT, mapped, query, scratch, sql_mapped, table
from workload.chunking import packed_sql
from workload.sources import line_parser

NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


@query("i1_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", ingestion.content_hash(F.col("text")).alias("content_hash"))


def _ledger(spark, sf):
    """Labelled documents were ingested before; those of low quality have changed since."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    old = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat("text", F.lit(".")))
    return docs.select(F.col("doc_id").alias("document_id"),
                       ingestion.content_hash(old).alias("ingested_content_hash"))


@query("i2_changed_documents", """
SELECT doc_id AS document_id, sha256(text) AS content_hash FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1""")
def changed(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), ingestion.content_hash(F.col("text")).alias("content_hash"))
    return ingestion.changed_documents(docs, _ledger(spark, sf))


def _stored(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("sequence"),
        F.col("l_partkey").alias("part"))


def _new(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("document_id"), F.lit(0).alias("sequence"), F.col("o_custkey").alias("part"))


_STORED = "stored AS (SELECT l_orderkey AS document_id, l_linenumber AS sequence, l_partkey AS part FROM lineitem)"
_NEW = "fresh AS (SELECT o_orderkey AS document_id, 0 AS sequence, o_custkey AS part FROM orders WHERE o_orderstatus = 'F')"


@query("i3_replace_chunks", f"""
WITH {_STORED}, {_NEW}, swapped AS (SELECT * FROM stored WHERE document_id NOT IN (SELECT document_id FROM fresh) UNION ALL SELECT * FROM fresh)
SELECT document_id, count(*) AS n, sum(part)::BIGINT AS s, min(sequence)::INT AS first FROM swapped GROUP BY document_id""")
def replace(spark, sf):
    return ingestion.replace_chunks(_stored(spark, sf), _new(spark, sf)).groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("part").alias("s"), F.min("sequence").cast("int").alias("first"))


@query("i4_delete_chunks", f"""
WITH {_STORED}, gone AS (SELECT o_orderkey + 7000 AS document_id FROM orders WHERE o_orderstatus = 'P')
SELECT document_id, (SELECT count(*) FROM stored s WHERE s.document_id = gone.document_id) AS n_deleted FROM gone""")
def delete_counts(spark, sf):
    ids = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(
        (F.col("o_orderkey") + 7000).alias("document_id"))
    return ingestion.delete_chunks(_stored(spark, sf), ids)[1]


@query("i4_remaining_chunks", f"""
WITH {_STORED} SELECT document_id, count(*) AS n FROM stored WHERE document_id NOT IN (SELECT o_orderkey + 7000 FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def delete_rest(spark, sf):
    ids = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(
        (F.col("o_orderkey") + 7000).alias("document_id"))
    return ingestion.delete_chunks(_stored(spark, sf), ids)[0].groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n"))


def _files(spark, sf):
    """Documents as files; texts of two languages are of a type without a parser."""
    kind = F.when(F.col("lang").isin("en", "fr"), ".PDF").otherwise(".docx")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.regexp_replace("source", r"\D", "").cast("bigint").alias("case_id"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), kind).alias("filename"),
        F.encode("text", "UTF-8").alias("content"))


_INGEST_SQL = r"""
SELECT doc_id AS document_id, CASE WHEN lang NOT IN ('en', 'fr') THEN 'unsupported' WHEN quality = 1 THEN 'unchanged'
  WHEN position(E'\n' IN text) = 0 OR trim(text, E' \n') = '' THEN 'failed' ELSE 'ingested' END AS status FROM documents LEFT JOIN labels USING (doc_id)"""


@query("i5_ingest", _INGEST_SQL)
def ingest(spark, sf):
    done = plan.ingest(_files(spark, sf), _ledger(spark, sf), line_parser, lambda: HashProvider(16), 16)
    return done.outcomes.select("document_id", "status")


@query("i5_ingest_twice", r"""
SELECT doc_id AS document_id, CASE WHEN lang NOT IN ('en', 'fr') THEN 'unsupported' WHEN position(E'\n' IN text) = 0 OR trim(text, E' \n') = '' THEN 'failed'
  ELSE 'unchanged' END AS status FROM documents""")
def ingest_twice(spark, sf):
    """After everything has been stored, a second run does only what failed before."""
    store, ledger = scratch(spark, "chunks"), scratch(spark, "ledger")
    for _ in range(2):
        done = plan.ingest(_files(spark, sf), plan.read_ledger(spark, ledger), line_parser,
                           lambda: HashProvider(16), 16)
        outcomes = done.outcomes
        plan.store(done, store, ledger)
    return outcomes.select("document_id", "status")


# Lines of the texts as they are in the first run (labelled ones of low quality with a further mark) and in the second; a text
# that cannot be read in the second keeps what the first has left.
_RUN_PAGES = r"""(SELECT run, doc_id, unnest(range(1, len(p) + 1)) AS page_number, unnest(p) AS text FROM (
  SELECT run, doc_id, string_split(CASE WHEN run = 2 AND position(E'\n' IN text) > 0 AND trim(text, E' \n') <> '' THEN text ELSE before END, E'\n') AS p
  FROM (SELECT *, CASE WHEN quality = 0 THEN text || '.' ELSE text END AS before FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr')), (VALUES (1), (2)) r(run)
  WHERE position(E'\n' IN before) > 0 AND trim(before, E' \n') <> ''))"""


# A page of up to 800 characters is one chunk; only longer ones are packed.
_WORDS = r"array_to_string(string_split_regex(trim(text, E' \n\t'), '\s+'), ' ')"


@query("i5_ingest_store", packed_sql(["run", "doc_id", "page_number"], "text", f"(SELECT * FROM {_RUN_PAGES} WHERE len({_WORDS}) > 800)", 800, 100) + f""",
whole AS (SELECT run, doc_id, page_number, 0 AS piece, {_WORDS} AS text FROM {_RUN_PAGES} WHERE len({_WORDS}) BETWEEN 1 AND 800),
every AS (SELECT run, doc_id, page_number, piece, text FROM pieces UNION ALL SELECT * FROM whole),
kept AS (SELECT run, doc_id AS document_id, (row_number() OVER (PARTITION BY run, doc_id ORDER BY page_number, piece) - 1)::INT AS sequence, page_number::INT AS page_number, md5(text) AS text_md5 FROM every)
SELECT * FROM kept UNION ALL SELECT 3, * EXCLUDE (run) FROM kept WHERE run = 2""")
def ingest_store(spark, sf):
    """What the store holds after a first run, after one in which some contents have changed, and after one in which none has."""
    store, ledger = scratch(spark, "chunks"), scratch(spark, "ledger")
    files = _files(spark, sf)
    low = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("document_id"), F.lit(b".").alias("_mark"))
    before = files.join(low, "document_id", "left").withColumn(
        "content", F.concat("content", F.coalesce("_mark", F.lit(b"")))).drop("_mark")
    found = None
    for run, contents in ((1, before), (2, files), (3, files)):
        plan.store(plan.ingest(contents, plan.read_ledger(spark, ledger), line_parser, lambda: HashProvider(16), 16), store, ledger)
        held = plan.read_chunks(spark, store).select(
            F.lit(run).alias("run"), "document_id", "sequence", "page_number", F.md5("text").alias("text_md5"))
        found = held if found is None else found.unionByName(held)
    return found


# --- jobs ---------------------------------------------------------------------------------


def jobs(spark, sf):
    """An order is a job; its status and age come from the order."""
    status = (F.when(F.col("o_orderpriority") == "1-URGENT", "running")
              .when(F.col("o_orderpriority") == "2-HIGH", "done")
              .when(F.col("o_orderpriority") == "3-MEDIUM", "failed").otherwise("pending"))
    minutes = F.make_dt_interval(mins=(F.col("o_custkey") % 60).cast("int"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") * 2).alias("document_id"),
        status.alias("status"), (F.col("o_custkey") % 3).cast("int").alias("attempts"),
        F.when(F.col("o_custkey") % 3 > 0, "ParserError: earlier").alias("last_error"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), (now() - minutes).alias("updated_at"))


JOBS = f"""jobs AS (
  SELECT o_orderkey AS job_id, o_orderkey * 2 AS document_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'done'
    WHEN '3-MEDIUM' THEN 'failed' ELSE 'pending' END AS status, (o_custkey % 3)::INT AS attempts,
    CASE WHEN o_custkey % 3 > 0 THEN 'ParserError: earlier' END AS last_error, {NOW} - to_minutes((o_custkey % 60)::BIGINT) AS updated_at FROM orders)"""


@query("i6_enqueue", f"""
WITH {JOBS}, fresh AS (SELECT c_custkey * 3 AS document_id FROM customer)
SELECT job_id, document_id, status FROM jobs UNION ALL
SELECT (SELECT max(job_id) FROM jobs) + row_number() OVER (ORDER BY document_id), document_id, 'pending' FROM fresh""")
def enqueue(spark, sf):
    docs = table(spark, sf, "customer").select((F.col("c_custkey") * 3).alias("document_id"))
    return ingestion.enqueue(jobs(spark, sf), docs, now()).select("job_id", "document_id", "status")


@query("i7_claim_batch", f"""
WITH {JOBS}, taken AS (SELECT job_id FROM jobs WHERE status = 'pending' ORDER BY job_id LIMIT 100)
SELECT j.job_id, CASE WHEN t.job_id IS NOT NULL THEN 'running' ELSE status END AS status, t.job_id IS NOT NULL OR updated_at = {NOW} AS touched FROM jobs j LEFT JOIN taken t USING (job_id)""")
def claim(spark, sf):
    _, ledger = ingestion.claim_batch(jobs(spark, sf), 100, now())
    return ledger.select("job_id", "status", (F.col("updated_at") == now()).alias("touched"))


@query("i8_stale_jobs", f"""
WITH {JOBS} SELECT job_id, document_id FROM jobs WHERE status = 'running' AND updated_at < {NOW} - INTERVAL 30 MINUTES""")
def stale(spark, sf):
    return ingestion.stale_jobs(jobs(spark, sf), now()).select("job_id", "document_id")


@query("i9_settle", f"""
WITH {JOBS}, outcomes AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'ParserError: ' || o_orderpriority END AS error FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT j.job_id, CASE WHEN o.job_id IS NULL THEN status WHEN error IS NULL THEN 'done' WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status,
  (attempts + CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END)::INT AS attempts,
  coalesce(CASE WHEN o.job_id IS NULL THEN last_error WHEN error IS NOT NULL THEN error END, '') AS last_error
FROM jobs j LEFT JOIN outcomes o USING (job_id)""")
def settle(spark, sf):
    outcomes = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("ParserError: "), "o_orderpriority")).alias("error"))
    return ingestion.settle(jobs(spark, sf), outcomes, now()).select(
        "job_id", "status", "attempts", F.coalesce("last_error", F.lit("")).alias("last_error"))


JOB_FOLD_SQL = f"""
WITH RECURSIVE said AS (
  SELECT user_id AS job_id, event_id, {sql_mapped("event_type", JOB_EVENT_OF_EVENT)} AS event, CASE WHEN event_type = 'error' THEN 'ParserError: ' || event_id END AS error,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events),
folded AS (
  SELECT job_id, event_id, n, total, CASE WHEN event = 'enqueue' THEN 'pending' END AS status, 0 AS attempts, NULL::VARCHAR AS last_error FROM said WHERE n = 1
  UNION ALL
  SELECT s.job_id, s.event_id, s.n, s.total,
    CASE WHEN s.event = 'enqueue' AND (f.status IS NULL OR f.status IN ('done', 'failed')) THEN 'pending' WHEN s.event = 'claim' AND f.status = 'pending' THEN 'running'
      WHEN s.event = 'success' AND f.status = 'running' THEN 'done'
      WHEN s.event IN ('failure', 'stale') AND f.status = 'running' THEN CASE WHEN f.attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE f.status END,
    CASE WHEN s.event = 'enqueue' AND (f.status IS NULL OR f.status IN ('done', 'failed')) THEN 0 WHEN s.event IN ('failure', 'stale') AND f.status = 'running' THEN f.attempts + 1 ELSE f.attempts END,
    CASE WHEN s.event = 'enqueue' AND (f.status IS NULL OR f.status IN ('done', 'failed')) THEN NULL WHEN s.event = 'success' AND f.status = 'running' THEN NULL
      WHEN s.event IN ('failure', 'stale') AND f.status = 'running' THEN coalesce(s.error, s.event) ELSE f.last_error END
  FROM folded f JOIN said s ON s.job_id = f.job_id AND s.n = f.n + 1)"""


def job_events(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), "event_id", "ts",
        mapped(F.col("event_type"), JOB_EVENT_OF_EVENT).alias("event"),
        F.when(F.col("event_type") == "error",
               F.concat(F.lit("ParserError: "), F.col("event_id").cast("string"))).alias("error"))


@query("i10_replay_jobs", JOB_FOLD_SQL + """
SELECT job_id, coalesce(status, '') AS status, attempts::INT AS attempts, coalesce(last_error, '') AS last_error FROM folded WHERE n = total""")
def replay(spark, sf):
    return ingestion.replay_jobs(job_events(spark, sf), ["ts", "event_id"]).select(
        "job_id", F.coalesce("status", F.lit("")).alias("status"), "attempts",
        F.coalesce("last_error", F.lit("")).alias("last_error"))


@query("i11_append_chunks", """
SELECT o_orderstatus AS batch, count(*) AS n FROM orders GROUP BY 1""")
def append(spark, sf):
    """Orders of each status as one batch of new chunks."""
    path = scratch(spark, "append")
    for status in ("F", "O", "P"):
        rows = table(spark, sf, "orders").where(F.col("o_orderstatus") == status).select(
            F.col("o_orderkey").alias("document_id"), F.lit(0).alias("sequence"), F.col("o_orderstatus").alias("batch"))
        ingestion.append_chunks(path, rows)
    return spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
