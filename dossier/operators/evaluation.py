"""Verdicts of evaluation items, and what repeated rounds say about them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.cells import metric_cell, stability_cell, tokens_cell
from dossier.functions.rows import parts_of
from dossier.functions.vectors import let
from dossier.schemas import QUALITY_METRICS, RATE_METRICS

METRICS = RATE_METRICS + QUALITY_METRICS
RUN = ["mode", "round_index"]


# --- per item -----------------------------------------------------------------------------


def context_hit(gold: DataFrame, matches: DataFrame) -> DataFrame:
    """Items with `context_hit`: the expected section occurs in their match texts.

    Texts are joined by a newline as one string; an item has a bounded number of matches.
    """
    place = [c for c in ["pass", "match_rank"] if c in matches.columns]
    joined = matches.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, "text"))),
                                 lambda m: m["text"]), "\n").alias("_found"))
    return gold.join(joined, "id", "left").withColumn(
        "context_hit",
        F.coalesce(F.contains(F.col("_found"), F.col("expected_section")),
                   F.col("expected_section") == ""),
    ).drop("_found")


def answer_hit(answered: Column, text: Column, expected: Column) -> Column:
    return F.coalesce(answered & F.exists(expected, lambda n: F.contains(text, n)), F.lit(False))


def duplicates_avoided(context: DataFrame) -> DataFrame:
    """Context rows of each question less the distinct passages among them."""
    per_passage = context.groupBy("query_id", "document_id", "sequence").agg(
        F.count(F.lit(1)).alias("n"))
    return per_passage.groupBy("query_id").agg(
        (F.sum("n") - F.count(F.lit(1))).alias("duplicate_passages_avoided"))


def usage_tally(spans: DataFrame, by: list[str]) -> DataFrame:
    """Token counts of spans (a `usage` map) summed key by key."""
    counts = spans.select(*by, F.explode("usage").alias("key", "value"))
    summed = counts.groupBy(*by, "key").agg(F.sum("value").alias("value"))
    # A handful of keys per group.
    return summed.groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("tokens"))


def repeat_rounds(gold: DataFrame, n: int) -> DataFrame:
    return gold.withColumn("round_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def gradeable(items: DataFrame) -> DataFrame:
    return items.where(F.col("answered") & (F.size("contexts") > 0))


def attach_scores(items: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores (trace_id, name, value) as rows of their item; NaN is no score."""
    kept = scores.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return items.join(kept, "trace_id")


def lexical_grader() -> Callable[[str, str, list[str]], dict[str, float]]:
    """Offline grader: share of answer words found in the contexts, of question words answered."""

    def grade_one(question: str, answer: str, contexts: list[str]) -> dict[str, float]:
        said = set(answer.lower().split())
        read = set(" ".join(contexts).lower().split())
        asked = set(question.lower().split())
        return {
            "faithfulness": len(said & read) / len(said) if said else float("nan"),
            "answer_relevancy": len(said & asked) / len(asked) if asked else float("nan"),
        }

    return grade_one


def grade(items: DataFrame, grader: Callable[[], Callable] = lexical_grader) -> DataFrame:
    """Grades of the gradeable items; a grade that is missing or failed is NaN."""
    names = ["faithfulness", "answer_relevancy"]
    asked = gradeable(items).select(*RUN, "id", "question", "answer_text", "contexts")
    schema = T.StructType([
        *[f for f in asked.schema.fields if f.name in (*RUN, "id")],
        *[T.StructField(n, T.DoubleType()) for n in names],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for whole in batches:
            for at, rows in parts_of(whole.column(whole.schema.get_field_index("answer_text"))):
                batch = whole.slice(at, rows)
                columns = [batch.column(batch.schema.get_field_index(n)).to_pylist()
                           for n in ("question", "answer_text", "contexts")]
                grades: dict[str, list[float]] = {n: [] for n in names}
                for row in zip(*columns):
                    score = score or grader()
                    try:
                        given = score(*row)
                    except Exception:  # noqa: BLE001 - a grader that gives up leaves no grade
                        given = {}
                    for n in names:
                        grades[n].append(float(given.get(n, float("nan"))))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in range(3)],
                     *[pa.array(grades[n], pa.float64()) for n in names]],
                    names=[*batch.schema.names[:3], *names])

    return asked.mapInArrow(run, schema)


# --- per round and per run ----------------------------------------------------------------


def _graded(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value), value)


def _whole(value: Column) -> Column:
    return value.cast("bigint")


def thousandths(value: Column) -> Column:
    """A number rounded to three places by its stored value, ties to even.

    0.8665 is stored as a little more and becomes 0.867. The fraction is taken as a whole number of
    2**-62, which is exact wherever a tie can lie.
    """
    unit, half = (F.lit(2**k).cast("decimal(19,0)") for k in (62, 61))

    def fraction(size: Column) -> Column:
        return ((size - F.floor(size)) * F.lit(2.0**62)).cast("bigint").cast("decimal(19,0)") * F.lit(1000).cast("decimal(4,0)")

    def nearest(parts: Column) -> Column:
        rest = parts % unit
        below = ((parts - rest) / unit).cast("bigint")
        return below + ((rest > half) | ((rest == half) & (below % 2 == 1))).cast("int")

    return let(value, lambda v: F.signum(v) * (
        F.floor(F.abs(v)) * 1000 + let(fraction(F.abs(v)), nearest)) / F.lit(1000.0))


def _all_rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in thousandths, by one expression over all of them."""
    names = [c for c in df.columns if c not in columns]
    return df.select(*names, F.transform(F.array(*[F.col(c).cast("double") for c in columns]), thousandths).alias("_r")).select(
        *names, *[F.col("_r")[i].alias(c) for i, c in enumerate(columns)])


def summarise_round(items: DataFrame, grades: DataFrame) -> DataFrame:
    """One row per (mode, round): rates, graded means with their coverage, cost."""
    rate = lambda c: F.avg(F.col(c).cast("int")).alias(f"{c}_rate")
    base = items.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("total"),
        rate("context_hit"), rate("answer_hit"), rate("answered"),
        F.count_if(F.contains(F.lower(F.coalesce("route", F.lit(""))), F.lit("multi_step")))
        .alias("multi_step_routed"),
        F.coalesce(F.sum("duplicate_passages_avoided"), F.lit(0)).alias("duplicates_avoided"),
        _whole(F.avg("latency_ms")).alias("mean_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )
    quality = grades.groupBy(*RUN).agg(
        F.avg(_graded(F.col("faithfulness"))).alias("mean_faithfulness"),
        F.avg(_graded(F.col("answer_relevancy"))).alias("mean_answer_relevancy"),
        F.count(_graded(F.col("faithfulness"))).alias("faithfulness_graded"),
        F.count(_graded(F.col("answer_relevancy"))).alias("answer_relevancy_graded"),
    )
    tokens = usage_tally(items.withColumnRenamed("tokens", "usage"), RUN)
    joined = base.join(quality, RUN, "left").join(tokens, RUN, "left")
    return _all_rounded(joined, METRICS).select(joined.columns).fillna(0, ["faithfulness_graded", "answer_relevancy_graded"])


def spread(value: Column) -> Column:
    """Aggregate: mean, sample deviation (null for one round), least, most, rounds counted."""
    return F.struct(
        thousandths(F.avg(value)).alias("mean"), thousandths(F.stddev_samp(value)).alias("stdev"),
        thousandths(F.min(value)).alias("min"), thousandths(F.max(value)).alias("max"),
        F.count(value).alias("rounds"),
    )


def _spreads(rounds: DataFrame) -> DataFrame:
    """Per mode and metric: mean, sample deviation (null for one round), least, most, rounds counted; a column per metric.

    Metrics are rows while they are added up and rounded, and columns again at the end.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS]))
    value = F.col("value")
    stats = rounds.select("mode", each.alias("_m")).select("mode", "_m.*").groupBy("mode", "metric").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.count(value).alias("rounds"))
    rounded = _all_rounded(stats, ["mean", "stdev", "min", "max"])
    of = F.struct("mean", "stdev", "min", "max", "rounds")
    return rounded.groupBy("mode").agg(*[F.max(F.when(F.col("metric") == m, of)).alias(m) for m in METRICS])


def _round_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("mode").agg(F.count_distinct("round_index").alias("_rounds"))


def unstable_items(items: DataFrame) -> DataFrame:
    """Items whose verdict pair is not the same in every round; none with a single round.

    Least and greatest pair differ exactly when there are two different ones, so the comparison
    is combined before the shuffle.
    """
    verdict = F.struct("context_hit", "answer_hit")
    per_item = items.groupBy("mode", "id").agg(
        F.min(verdict).alias("a"), F.max(verdict).alias("b"))
    return (
        per_item.where(F.col("a") != F.col("b"))
        .join(_round_counts(items).where(F.col("_rounds") > 1), "mode", "left_semi")
        .select("mode", "id")
    )


def answers_repeated_exactly(items: DataFrame) -> DataFrame:
    """Per mode: every item has one answer text over all rounds; null with a single round."""
    per_item = items.groupBy("mode", "id").agg(
        (F.min("answer_text") == F.max("answer_text")).alias("same"))
    return per_item.groupBy("mode").agg(F.bool_and("same").alias("_same")).join(
        _round_counts(items), "mode").select(
        "mode", F.when(F.col("_rounds") > 1, F.col("_same")).alias("answers_repeated_exactly"))


def aggregate_runs(rounds: DataFrame, items: DataFrame) -> DataFrame:
    """One row per mode: spread of five metrics, cost, and how many items are unstable.

    Which ones they are is a table of its own (`unstable_items`), kept beside the history. Verdicts
    and texts of an item are compared in one pass over the items.
    """
    summary = rounds.groupBy("mode").agg(
        F.count(F.lit(1)).alias("rounds"), F.min_by("total", "round_index").alias("total"),
        *[_whole(F.avg(c)).alias(c) for c in ["faithfulness_graded", "answer_relevancy_graded",
                                              "mean_latency_ms"]],
        F.max("max_latency_ms").alias("max_latency_ms"),
        F.sum("duplicates_avoided").alias("duplicates_avoided"),
        F.sum("multi_step_routed").alias("multi_step_routed"),
    )
    tokens = usage_tally(
        rounds.select("mode", F.col("tokens").alias("usage")), ["mode"]
    ).withColumnRenamed("tokens", "total_tokens")
    verdict = F.struct("context_hit", "answer_hit")
    per_item = items.groupBy("mode", "id").agg(
        (F.min(verdict) != F.max(verdict)).alias("differs"), (F.min("answer_text") == F.max("answer_text")).alias("same"),
        F.min("round_index").alias("least"), F.max("round_index").alias("most"))
    compared = per_item.groupBy("mode").agg(
        F.count_if("differs").alias("n_unstable"), F.bool_and("same").alias("answers_repeated_exactly"),
        (F.min("least") < F.max("most")).alias("_several"))
    return (
        summary.join(_spreads(rounds), "mode").join(tokens, "mode", "left").join(compared, "mode", "left")
        .withColumn("n_unstable", F.when(F.col("_several"), F.col("n_unstable")).otherwise(F.lit(0)))
        .withColumn("answers_repeated_exactly", F.when(F.col("_several"), F.col("answers_repeated_exactly"))).drop("_several")
    )


def compare_modes(aggregates: DataFrame, before: str = "direct", after: str = "graph") -> DataFrame:
    """Per metric: both means, their difference, and whether it lies within the spread."""
    long = aggregates.select("mode", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).getField("mean").alias("mean"),
                 F.col(m).getField("stdev").alias("stdev")) for m in METRICS])).alias("m")
    ).select("mode", "m.*")
    side = lambda mode, tag: long.where(F.col("mode") == mode).select(
        "metric", F.col("mean").alias(tag), F.coalesce("stdev", F.lit(0.0)).alias(f"_s_{tag}"))
    both = side(before, "before").join(side(after, "after"), "metric")
    return both.where(F.col("before").isNotNull() & F.col("after").isNotNull()).select(
        "metric", "before", "after",
        thousandths(F.col("after") - F.col("before")).alias("delta"),
        F.greatest("_s_before", "_s_after").alias("noise"),
    ).withColumn(
        "verdict",
        F.when(F.abs("delta") <= F.col("noise"), F.lit("NOISE")).otherwise(F.lit("outside spread")))


# --- reports ------------------------------------------------------------------------------


def runs_table(history: DataFrame) -> DataFrame:
    """History as report rows, newest first."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    graded = {m: f"{m.removeprefix('mean_')}_graded" for m in METRICS}
    no_count = F.lit(None).cast("bigint")
    return history.select(
        dash("stamp").alias("run"), dash("mode").alias("mode"), dash("git_sha").alias("commit"),
        dash("llm_model").alias("model"), F.coalesce("rounds", F.lit(1)).alias("rounds"),
        *[metric_cell(F.col(m), F.col(graded[m]) if m in QUALITY_METRICS else no_count,
                      F.col("total")).alias(m) for m in METRICS],
        stability_cell(F.col("rounds"), F.col("answers_repeated_exactly"),
                       F.coalesce("n_unstable", F.size("unstable_items"), F.lit(0)),
                       F.coalesce("total", F.lit(0))).alias("unstable"),
        dash("mean_latency_ms").alias("mean_ms"), tokens_cell(F.col("total_tokens")).alias("tokens"),
        F.coalesce("stamp", F.lit("")).alias("_s"), F.coalesce("mode", F.lit("")).alias("_m"),
    ).orderBy(F.desc("_s"), F.desc("_m")).drop("_s", "_m")


def latest_run(history: DataFrame) -> DataFrame:
    return history.orderBy(
        F.desc(F.coalesce("stamp", F.lit(""))), F.desc(F.coalesce("mode", F.lit("")))).limit(1)
