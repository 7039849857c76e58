"""Repeated evaluation of a gold set over the whole answering flow."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators.access import Scopes
from dossier.operators.evaluation import (
    aggregate_runs, answer_hit, grade, lexical_grader, repeat_rounds, summarise_round,
)
from dossier.operators.ordered import number_rows
from dossier.plans.ask import Models, ask_batch
from dossier.schemas import TOP_K
from dossier.session import materialise


@dataclass(frozen=True)
class EvaluationRun:
    items: DataFrame
    grades: DataFrame
    rounds: DataFrame
    aggregate: DataFrame


def everyone(spark) -> Scopes:
    """The scope of an evaluation: one reader of all cases."""
    return Scopes(
        spark.sql("SELECT CAST(0 AS BIGINT) AS user_id, true AS all_cases, CAST(0 AS BIGINT) AS n_cases"),
        spark.createDataFrame([], "user_id bigint, case_id bigint"))


def eval_run(gold: DataFrame, chunks: DataFrame, documents: DataFrame, models: Models,
             mode: str = "direct", rounds: int = 1, k: int = TOP_K, multi_step: bool = False,
             grader: Callable = lexical_grader) -> EvaluationRun:
    """All rounds of one mode in one plan: "direct" never loops, "graph" may."""
    if rounds < 1:
        raise ValueError("rounds must be at least 1")
    spark = gold.sparkSession
    repeated = number_rows(repeat_rounds(gold, rounds), [], ["id", "round_index"], "query_id")
    repeated = materialise(repeated)
    questions = repeated.select("query_id", F.lit(0).cast("bigint").alias("user_id"), "question")
    asks = materialise(ask_batch(
        questions, None, None, chunks, documents, models, k,
        multi_step=multi_step and mode == "graph", scopes=everyone(spark)))
    joined = repeated.join(asks.drop("user_id", "question"), "query_id")
    # The matches decide, not their neighbours.
    hits = joined.withColumn("_found", F.array_join("match_texts", "\n"))
    items = hits.select(
        F.lit(mode).alias("mode"), "round_index", "id", "lang", "question", "answered",
        F.contains(F.col("_found"), F.col("expected_section")).alias("context_hit"),
        answer_hit(F.col("answered"), F.col("answer"), F.col("expected_answer_contains"))
        .alias("answer_hit"),
        F.coalesce("answer", F.lit("")).alias("answer_text"), "contexts",
        (F.lit(None).cast("string") if mode == "direct" else F.col("route")).alias("route"),
        "iterations", "duplicate_passages_avoided", "latency_ms", "tokens",
        # Names the question's row in the ledger of this run.
        F.concat_ws("-", F.lit(mode), "round_index", "id", "query_id").alias("trace_id"))
    items = materialise(items)
    grades = materialise(grade(items, grader))
    per_round = materialise(summarise_round(items, grades))
    return EvaluationRun(items, grades, per_round, aggregate_runs(per_round, items))
