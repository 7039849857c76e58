"""Scopes, vector search, neighbours, passages, citations."""

from pyspark.sql import functions as F

from dossier.functions.text import looks_cut_off
from dossier.functions.vectors import cosine_distance
from dossier.operators import access, retrieval
from dossier.operators.embedding import HashProvider
from dossier.session import materialise
from workload.base import (
    CHUNKS, CONTEXT, CUT_OFF, PASSAGES, RANKED, SCOPES, USERS, chunk_vectors, chunks, context, matches, passages,
    query, scopes, table,
)

ASKED = [round(x, 6) for x in HashProvider(64).embed(["is the notice period binding"])[0]]
_VECTOR = "[" + ", ".join(f"{x!r}" for x in ASKED) + "]::DOUBLE[]"
_DISTANCE = f"""round(1 - list_dot_product(embedding, {_VECTOR}) /
  (sqrt(list_dot_product(embedding, embedding)) * sqrt(list_dot_product({_VECTOR}, {_VECTOR}))), 12)"""


@query("e1_resolve_scope", f"""
WITH {USERS}, {SCOPES}
SELECT user_id, all_cases, CASE WHEN all_cases THEN 0 ELSE count(case_id) END::BIGINT AS n_cases,
  CASE WHEN all_cases THEN '' ELSE coalesce(string_agg(case_id::VARCHAR, ',' ORDER BY case_id), '') END AS case_ids
FROM scopes LEFT JOIN scope_edges USING (user_id) GROUP BY user_id, all_cases""")
def resolve_scope(spark, sf):
    found = scopes(spark, sf)
    # Ten cases at most in this stand-in.
    listed = found.edges.groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("case_id")),
                                 lambda c: c.cast("string")), ",").alias("case_ids"))
    return found.users.join(listed, "user_id", "left").select(
        "user_id", "all_cases", "n_cases", F.coalesce("case_ids", F.lit("")).alias("case_ids"))


@query("e2_cosine_distance", f"""
SELECT vec_id, round(1 - list_dot_product(e, {_VECTOR}) / (sqrt(list_dot_product(e, e))
  * sqrt(list_dot_product({_VECTOR}, {_VECTOR}))), 6) AS distance
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def cosine(spark, sf):
    asked = F.array(*[F.lit(x) for x in ASKED])
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(cosine_distance(F.col("embedding"), asked), 6).alias("distance"))


@query("e3_search", f"""
WITH {CHUNKS}
SELECT chunk_id, case_id, document_id, sequence, round({_DISTANCE}, 6) AS distance
FROM chunks WHERE case_id IN (1, 2, 3, 5, 8) ORDER BY {_DISTANCE}, chunk_id LIMIT 10""")
def search(spark, sf):
    found = retrieval.search(chunks(spark, sf), ASKED, retrieval.these_cases(1, 2, 3, 5, 8), 10)
    return found.select("chunk_id", "case_id", "document_id", "sequence",
                        F.round("distance", 6).alias("distance"))


@query("e3_search_all_cases", f"""
WITH {CHUNKS}
SELECT chunk_id, round({_DISTANCE}, 6) AS distance FROM chunks ORDER BY {_DISTANCE}, chunk_id LIMIT 10""")
def search_all(spark, sf):
    found = retrieval.search(chunks(spark, sf), ASKED, retrieval.ALL_CASES, 10)
    return found.select("chunk_id", F.round("distance", 6).alias("distance"))


_MATCH_COLUMNS = ["query_id", "match_rank", "chunk_id", "case_id", "document_id", "sequence"]
_MATCH_SQL = f"""
WITH {RANKED}
SELECT query_id, match_rank::INT AS match_rank, chunk_id, case_id, document_id, sequence,
  round(distance, 6) + 0.0 AS distance FROM matches"""


@query("e4_search_batch", _MATCH_SQL)
def search_batch(spark, sf):
    return matches(spark, sf).select(*_MATCH_COLUMNS, F.round("distance", 6).alias("distance"))


@query("e4_search_batch_cells", _MATCH_SQL)
def search_batch_cells(spark, sf):
    """More questions than a block holds: a scan for each block, here of at most 500 questions."""
    from workload.base import questions

    found = retrieval.search_batch(
        questions(spark, sf), scopes(spark, sf), chunk_vectors(spark, sf), 5, max_questions=500)
    return found.select(*_MATCH_COLUMNS, F.round("distance", 6).alias("distance"))


@query("e5_looks_cut_off", f"""
SELECT doc_id, {CUT_OFF} AS cut_off FROM documents""")
def cut_off(spark, sf):
    return table(spark, sf, "documents").select("doc_id", looks_cut_off(F.col("text")).alias("cut_off"))


@query("e6_with_neighbours", f"""
WITH {CONTEXT}
SELECT query_id, match_rank::INT AS match_rank, ctx_pos, is_match, chunk_id, page_number, md5(text) AS text_md5 FROM context""")
def neighbours(spark, sf):
    return context(spark, sf).select("query_id", "match_rank", "ctx_pos", "is_match", "chunk_id",
                                     "page_number", F.md5("text").alias("text_md5"))


@query("e7_unique_passages", f"""
WITH {PASSAGES}
SELECT query_id, passage, document_id, sequence, page_number FROM passages""")
def unique(spark, sf):
    return passages(spark, sf).select("query_id", "passage", "document_id", "sequence", "page_number")


@query("e8_accumulate_passes", f"""
WITH {RANKED},
two AS (SELECT query_id, 0 AS pass, match_rank, chunk_id FROM matches
  UNION ALL SELECT query_id, 1, match_rank, chunk_id FROM matches WHERE match_rank <= 3)
SELECT query_id, count(*) AS n, string_agg(chunk_id::VARCHAR, ',' ORDER BY pass, match_rank) AS chunk_ids
FROM two GROUP BY query_id""")
def accumulate(spark, sf):
    first = materialise(matches(spark, sf))  # both passes go on from one search
    both = retrieval.accumulate_passes(None, first, 0)
    both = retrieval.accumulate_passes(both, first.where("match_rank <= 3"), 1)
    # Eight matches per question.
    return both.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("pass", "match_rank", "chunk_id"))),
            lambda m: m["chunk_id"].cast("string")), ",").alias("chunk_ids"))


@query("e9_chunks_of_document", f"""
WITH {CHUNKS} SELECT sequence, chunk_id, page_number FROM chunks WHERE document_id = 7""")
def of_document(spark, sf):
    return retrieval.chunks_of_document(chunks(spark, sf), 7).select(
        "sequence", "chunk_id", "page_number")


@query("e9_chunks_of_case", f"""
WITH {CHUNKS} SELECT chunk_id, document_id, sequence FROM chunks WHERE case_id = 4""")
def of_case(spark, sf):
    return retrieval.chunks_of_case(chunks(spark, sf), 4).select("chunk_id", "document_id", "sequence")


@query("e10_name_citations", f"""
WITH {PASSAGES}
SELECT query_id, passage, p.document_id, coalesce('file_' || l.doc_id || '_' || l.quality || '.pdf', 'Unknown document') AS document_name
FROM passages p LEFT JOIN labels l ON l.doc_id = p.document_id""")
def citations(spark, sf):
    files = table(spark, sf, "labels").select(
        F.col("doc_id").alias("document_id"),
        F.concat(F.lit("file_"), F.col("doc_id").cast("string"), F.lit("_"),
                 F.col("quality").cast("string"), F.lit(".pdf")).alias("filename"))
    return retrieval.name_citations(
        passages(spark, sf).select("query_id", "passage", "document_id"), files)


@query("e11_scope_label", f"""
WITH {USERS}, {SCOPES}
SELECT user_id, CASE WHEN all_cases THEN 'all cases' ELSE count(case_id) || ' case(s)' END AS scope
FROM scopes LEFT JOIN scope_edges USING (user_id) GROUP BY user_id, all_cases""")
def label(spark, sf):
    return scopes(spark, sf).users.select(
        "user_id", access.scope_label(F.col("all_cases"), F.col("n_cases")).alias("scope"))
