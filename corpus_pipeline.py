"""A training corpus from `documents`: five stages, each written to the shared folder and reread by the next.

Each stage takes (spark, docs, sf_dir). All but the last keep the columns of documents, extra ones included; null texts have
no language and go in the first stage. The whole can't be said in SQL (the language model is learned), so ORACLE_SQL is None;
tests hold it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import decontaminate, langid, ngram_join, packing, pii
from dossier.llm.base import query, table, written
from dossier.operators.ordered import number_rows

ORACLE_SQL = None


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the model knows; the model learns from the rows at hand."""
    return langid.known_language(docs, langid.trained_on(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id. Rows that repeat a doc_id are documents of their own: of those
    that link the one with the smallest text stays, and one that links to nothing stays whatever else has its id. Rows without
    a doc_id or without words stay."""
    several = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select("doc_id"), "pipeline-repeated")
    if several.isEmpty():
        found = ngram_join.link_components(docs).where("doc_id = component_id").select("doc_id")
        return docs.join(found, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    repeated = number_rows(rows.join(several, "doc_id", "left_semi"), [], ["doc_id", "text"], "_n", start=1)
    below = F.lit(min(0, docs.agg(F.min("doc_id")).head()[0]))  # numbers that no document has
    once = rows.join(several, "doc_id", "left_anti").withColumn("_node", F.col("doc_id"))
    nodes = written(once.unionByName(repeated.withColumn("_node", below - F.col("_n")).drop("_n")), "pipeline-nodes")
    found = ngram_join.link_components(nodes.select(F.col("_node").alias("doc_id"), "text")).select(F.col("doc_id").alias("_node"), "component_id")
    chosen = (nodes.select("_node", "doc_id", "text").join(found, "_node").groupBy("component_id")
              .agg(F.min_by("_node", F.struct("doc_id", F.coalesce("text", F.lit("")), "_node")).alias("_node")).select("_node"))
    return nodes.join(chosen, "_node", "left_semi").select("_row.*").unionByName(docs.where("doc_id is null"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark text to three quarters or more; rows without a text stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every found span masked; null texts stay null."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences; a null text is an empty one."""
    return packing.pack(docs)


STAGES = [
    ("language", known_languages),
    ("near_copies", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = written(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
