"""Supplied tables in the roles the operators need, in Spark and as SQL common tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators.access import Scopes, resolve_scope
from dossier.session import checkpoint_dir, fill_cores, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can say the same."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose long texts are to be worked on."""
    return fill_cores(table(spark, sf, name).select(*columns))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- users, cases, assignments ------------------------------------------------------------


def users(spark, sf) -> DataFrame:
    key = F.col("c_custkey")
    role = (
        F.when(key % 20 == 0, "admin").when(key % 20 == 1, "partner")
        .when(key % 2 == 0, "paralegal").otherwise("attorney")
    )
    return table(spark, sf, "customer").select(
        key.alias("user_id"), F.col("c_name").alias("full_name"), role.alias("role"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        (F.col("c_mktsegment") == "MACHINERY").alias("must_change_password"),
    )


USERS = """users AS (
  SELECT c_custkey AS user_id, c_name AS full_name,
    CASE WHEN c_custkey % 20 = 0 THEN 'admin' WHEN c_custkey % 20 = 1 THEN 'partner'
         WHEN c_custkey % 2 = 0 THEN 'paralegal' ELSE 'attorney' END AS role,
    c_acctbal > 0 AS is_active, c_mktsegment = 'MACHINERY' AS must_change_password
  FROM customer)"""


def case_status(priority: Column, state: Column) -> Column:
    return (
        F.when(priority == "1-URGENT", "under_review").when(priority == "2-HIGH", "submitted_for_review")
        .when(priority == "3-MEDIUM", "in_progress").when(priority == "4-NOT SPECIFIED", "draft")
        .when(state == "F", "closed").otherwise("revisions_requested")
    )


def cases(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.concat(F.lit("Case "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("description"),
        case_status(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("status"),
    )


CASES = """cases AS (
  SELECT o_orderkey AS case_id, 'Case ' || o_orderkey AS title,
    CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS description,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'under_review' WHEN '2-HIGH' THEN 'submitted_for_review'
      WHEN '3-MEDIUM' THEN 'in_progress' WHEN '4-NOT SPECIFIED' THEN 'draft'
      ELSE CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'revisions_requested' END END AS status
  FROM orders)"""


def assignments(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("case_id"))


ASSIGNMENTS = "assignments AS (SELECT o_custkey AS user_id, o_orderkey AS case_id FROM orders)"


def case_documents(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("document_id"))


CASE_DOCUMENTS = """case_documents AS (
  SELECT l_orderkey AS case_id, l_orderkey * 10 + l_linenumber AS document_id FROM lineitem)"""

# Requests of a user for a case: some users and some cases do not exist.
ACTIONS = ["read", "edit", "respond", "documents"]


def access_requests(spark, sf) -> DataFrame:
    owner = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    line = F.col("l_linenumber")
    return table(spark, sf, "lineitem").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(line <= 3, F.col("o_custkey")).otherwise(F.col("l_partkey")).alias("user_id"),
        F.when(line == 7, F.col("l_orderkey") * 7).otherwise(F.col("l_orderkey")).alias("case_id"),
        F.element_at(F.array(*[F.lit(a) for a in ACTIONS]),
                     (F.col("l_suppkey") % 4 + 1).cast("int")).alias("action"),
    )


ACCESS_REQUESTS = """access_requests AS (
  SELECT CASE WHEN l_linenumber <= 3 THEN o_custkey ELSE l_partkey END AS user_id,
    CASE WHEN l_linenumber = 7 THEN l_orderkey * 7 ELSE l_orderkey END AS case_id,
    ['read','edit','respond','documents'][(l_suppkey % 4 + 1)::INT] AS action
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

STATUS_OF_EVENT = {
    "click": "in_progress", "view": "submitted_for_review", "purchase": "under_review",
    "error": "revisions_requested", "signup": "closed",
}
JOB_EVENT_OF_EVENT = {
    "click": "enqueue", "view": "claim", "purchase": "success", "error": "failure", "signup": "stale",
}


def mapped(column: Column, mapping: dict[str, str]) -> Column:
    result = F.lit(None).cast("string")
    for old, new in mapping.items():
        result = F.when(column == old, F.lit(new)).otherwise(result)
    return result


def sql_mapped(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{o}' THEN '{n}'" for o, n in mapping.items()) + " END"


# --- chunks, questions, scopes ------------------------------------------------------------


def chunks(spark, sf) -> DataFrame:
    """Five vectors are a document, ten documents in turn are the cases 0 to 9."""
    documents = table(spark, sf, "documents")
    n = documents.count()  # answered from the file footers
    vectors = table(spark, sf, "embeddings").withColumn("doc_id", F.col("vec_id") % F.lit(n))
    return vectors.join(documents.select("doc_id", "text"), "doc_id").select(
        F.col("vec_id").alias("chunk_id"),
        (F.expr("vec_id div 5") % 10).alias("case_id"),
        F.expr("vec_id div 5").alias("document_id"),
        ((F.col("vec_id") % 5).cast("int")).alias("sequence"),
        (F.expr("(vec_id % 5) div 2").cast("int") + 1).alias("page_number"),
        "text", "embedding",
    )


def kept_chunks(spark, sf) -> DataFrame:
    """The same chunks as a table of their own, for a flow that reads them several times."""
    return stored(chunks(spark, sf))


def chunk_vectors(spark, sf) -> DataFrame:
    """The same chunks without their texts, which ranking does not need."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), (F.expr("vec_id div 5") % 10).alias("case_id"),
        F.expr("vec_id div 5").alias("document_id"),
        ((F.col("vec_id") % 5).cast("int")).alias("sequence"), "embedding")


CHUNKS = """chunks AS (
  SELECT vec_id AS chunk_id, (vec_id // 5) % 10 AS case_id, vec_id // 5 AS document_id,
    (vec_id % 5)::INT AS sequence, ((vec_id % 5) // 2 + 1)::INT AS page_number, text,
    embedding::DOUBLE[] AS embedding
  FROM embeddings JOIN documents ON doc_id = vec_id % (SELECT count(*) FROM documents))"""


def questions(spark, sf) -> DataFrame:
    """Every vector is a question; the customer of the order with its number asks it."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return table(spark, sf, "embeddings").join(orders, F.col("vec_id") == F.col("o_orderkey")).select(
        F.col("vec_id").alias("query_id"), "user_id", "embedding")


QUESTIONS = """questions AS (
  SELECT vec_id AS query_id, o_custkey AS user_id, embedding::DOUBLE[] AS embedding
  FROM embeddings JOIN orders ON vec_id = o_orderkey)"""


def scope_assignments(spark, sf) -> DataFrame:
    """Open orders attach their customer to one of the ten cases."""
    return table(spark, sf, "orders").where(F.col("o_orderstatus") == "O").select(
        F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 10).alias("case_id"))


def scopes(spark, sf) -> Scopes:
    return resolve_scope(users(spark, sf), scope_assignments(spark, sf))


SCOPES = """scope_edges AS (
  SELECT DISTINCT o_custkey AS user_id, o_orderkey % 10 AS case_id FROM orders WHERE o_orderstatus = 'O'),
scopes AS (SELECT user_id, role IN ('admin', 'partner') AS all_cases FROM users)"""

RANKED = f"""{USERS}, {CHUNKS}, {QUESTIONS}, {SCOPES},
pairs AS (
  SELECT query_id, chunk_id, c.case_id, document_id, sequence,
    round(1 - list_dot_product(q.embedding, c.embedding)
      / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(c.embedding, c.embedding))), 12) AS distance
  FROM questions q JOIN scopes s USING (user_id) JOIN chunks c
    ON s.all_cases OR EXISTS (SELECT 1 FROM scope_edges e WHERE e.user_id = q.user_id AND e.case_id = c.case_id)),
matches AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS match_rank
  FROM pairs QUALIFY match_rank <= 5)"""

CUT_OFF = r"""(trim(text, E' \n') <> '' AND (regexp_matches(trim(text, E' \n'), '^[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]')
  OR NOT regexp_matches(trim(text, E' \n'), '[.؟?!؛:]$')))"""

CONTEXT = RANKED + f""",
context AS (
  SELECT m.query_id, m.match_rank, (n.sequence - m.sequence + 1)::INT AS ctx_pos,
    n.sequence = m.sequence AS is_match, n.chunk_id, n.case_id, n.document_id, n.sequence, n.page_number, n.text
  FROM matches m JOIN (SELECT chunk_id, {CUT_OFF} AS cut FROM chunks) own ON own.chunk_id = m.chunk_id
  JOIN chunks n ON n.case_id = m.case_id AND n.document_id = m.document_id
    AND (n.sequence = m.sequence OR (own.cut AND abs(n.sequence - m.sequence) = 1)))"""

PASSAGES = CONTEXT + """,
passages AS (
  SELECT * EXCLUDE (first), row_number() OVER (PARTITION BY query_id ORDER BY match_rank, ctx_pos)::INT AS passage
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, sequence ORDER BY match_rank, ctx_pos) AS first
        FROM context) WHERE first = 1)"""


def matches(spark, sf, k: int = 5) -> DataFrame:
    from dossier.operators.retrieval import search_batch

    return search_batch(questions(spark, sf), scopes(spark, sf), chunk_vectors(spark, sf), k)


def context(spark, sf) -> DataFrame:
    from dossier.operators.retrieval import with_neighbours

    return with_neighbours(matches(spark, sf), chunks(spark, sf))


def passages(spark, sf) -> DataFrame:
    from dossier.operators.retrieval import unique_passages

    return unique_passages(context(spark, sf))
