"""Data quality and value migration."""

from pyspark.sql import functions as F

from dossier.operators import quality
from dossier.schemas import NEW_STATUS_TO_OLD, OLD_STATUS_TO_NEW
from workload.base import (
    ASSIGNMENTS, CASE_DOCUMENTS, CASES, assignments, case_documents, cases, query,
    sql_mapped, table,
)


@query("k1_unique_violations", """
SELECT l_orderkey AS document_id, l_linenumber AS sequence, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def unique(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("sequence"))
    return quality.unique_violations(rows, ["document_id", "sequence"])


@query("k2_foreign_key_violations", """
SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = l_partkey) GROUP BY ALL""")
def foreign_keys(spark, sf):
    """Part numbers taken for users: those beyond the last customer do not exist."""
    people = table(spark, sf, "customer")
    found = quality.foreign_key_violations(table(spark, sf, "lineitem"), "l_partkey", people, "c_custkey")
    return found.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


@query("k2_chunk_case_mismatch", f"""
WITH {CASE_DOCUMENTS}, kept AS (SELECT * FROM case_documents WHERE document_id % 10 <> 6),
pieces AS (SELECT l_orderkey * 10 + l_linenumber AS document_id, CASE WHEN l_linenumber = 5 THEN l_orderkey + 1 ELSE l_orderkey END AS case_id, l_partkey AS chunk_id FROM lineitem)
SELECT p.document_id, p.case_id, coalesce(k.case_id, -1) AS document_case_id, count(*) AS n FROM pieces p LEFT JOIN kept k USING (document_id)
WHERE p.case_id IS DISTINCT FROM k.case_id GROUP BY ALL""")
def mismatch(spark, sf):
    """Line items as chunks: every fifth names a neighbouring case, and every sixth document is not there."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    pieces = table(spark, sf, "lineitem").select(
        (order * 10 + line).alias("document_id"), F.when(line == 5, order + 1).otherwise(order).alias("case_id"), F.col("l_partkey").alias("chunk_id"))
    kept = case_documents(spark, sf).where(F.col("document_id") % 10 != 6)
    return quality.chunk_case_violations(pieces, kept).groupBy(
        "document_id", "case_id", F.coalesce("document_case_id", F.lit(-1)).alias("document_case_id")).agg(F.count(F.lit(1)).alias("n"))


@query("k3_domain_violations", """
SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1""")
def domain(spark, sf):
    found = quality.domain_violations(table(spark, sf, "events"), "event_type", ["click", "view", "purchase"])
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_OLD = {"O": "OPEN", "P": "IN_PROGRESS"}


@query("k4_remap_values", f"""
WITH old AS (SELECT o_orderkey AS case_id, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'ARCHIVED' END AS status FROM orders)
SELECT case_id, coalesce({sql_mapped("status", OLD_STATUS_TO_NEW)}, 'draft') AS status FROM old""")
def remap(spark, sf):
    old = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), quality.remap(F.col("o_orderstatus"), _OLD, "ARCHIVED").alias("status"))
    return quality.remap_values(old, "status", OLD_STATUS_TO_NEW, "draft")


@query("k4_remap_back", f"""
WITH {CASES} SELECT case_id, coalesce({sql_mapped("status", NEW_STATUS_TO_OLD)}, 'OPEN') AS status FROM cases""")
def remap_back(spark, sf):
    return quality.remap_values(cases(spark, sf), "status", NEW_STATUS_TO_OLD, "OPEN").select("case_id", "status")


@query("k5_insert_if_absent", """
SELECT c_custkey AS user_id, c_name AS name FROM customer UNION ALL
SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = p_partkey)""")
def insert(spark, sf):
    target = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("user_id"), F.col("p_name").alias("name"))
    return quality.insert_if_absent(target, rows, ["user_id"])


@query("k6_blank_violations", r"""
SELECT doc_id, CASE WHEN lang = 'es' THEN 'lang' ELSE '' END || CASE WHEN lang = 'es' AND len(text) < 400 THEN ',' ELSE '' END || CASE WHEN len(text) < 400 THEN 'title' ELSE '' END AS blank
FROM documents WHERE lang = 'es' OR len(text) < 400""")
def blank(spark, sf):
    """Spanish documents have a blank language, short ones a blank title, none a null one."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "es", F.lit(" \u00a0")).otherwise(F.col("lang")).alias("lang"),
        F.when(F.length("text") < 400, F.lit("\t\n")).when(F.col("lang") == "fr", F.col("text")).alias("title"))
    return quality.blank_violations(docs, ["lang", "title"]).select(
        "doc_id", F.array_join("blank", ",").alias("blank"))


@query("k7_purge_cases", f"""
WITH {CASES}, {ASSIGNMENTS}, {CASE_DOCUMENTS}, gone AS (SELECT case_id FROM cases WHERE status = 'closed')
SELECT 'cases' AS name, count(*) AS n, sum(case_id)::BIGINT AS s FROM cases WHERE case_id NOT IN (SELECT case_id FROM gone)
UNION ALL SELECT 'assignments', count(*), sum(case_id)::BIGINT FROM assignments WHERE case_id NOT IN (SELECT case_id FROM gone)
UNION ALL SELECT 'documents', count(*), sum(case_id)::BIGINT FROM case_documents WHERE case_id NOT IN (SELECT case_id FROM gone)""")
def purge(spark, sf):
    left = quality.purge_cases(
        {"cases": cases(spark, sf), "assignments": assignments(spark, sf), "documents": case_documents(spark, sf)},
        cases(spark, sf).where(F.col("status") == "closed"))
    counted = [rows.agg(F.count(F.lit(1)).alias("n"), F.sum("case_id").alias("s")).select(
        F.lit(name).alias("name"), "n", "s") for name, rows in left.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])
