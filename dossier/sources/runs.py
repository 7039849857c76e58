"""Gold sets, evaluation reports and the run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.schemas import GOLD_SET, HISTORY


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Items of a gold set file, one row each."""
    sets = spark.read.schema(GOLD_SET).option("multiLine", "true").json(path)
    return sets.select("corpus", "chunker", F.inline("items"))


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    schema = T.StructType([*HISTORY.fields, T.StructField("_corrupt_record", T.StringType())])
    try:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Recorded runs, oldest first. Lines that are no JSON object are left out; a field of another
    type is null, its line stays. No file is no runs."""
    lines = _lines(spark, path)
    if lines is None:
        return spark.createDataFrame([], HISTORY)
    odd = F.col("_corrupt_record")
    return lines.where(odd.isNull() | _is_object(odd)).drop("_corrupt_record").orderBy(
        F.coalesce("stamp", F.lit("")), F.coalesce("mode", F.lit("")))


def _is_object(line: Column) -> Column:
    return F.coalesce(
        F.startswith(F.schema_of_variant(F.try_parse_json(line)), F.lit("OBJECT")), F.lit(False))


def append_unstable(unstable: DataFrame, stamp: str, path: str) -> None:
    """The unstable items (mode, id) of a run as rows beside the history, however many they are."""
    unstable.select(F.lit(stamp).alias("stamp"), "mode", "id").write.mode("append").json(path)


def read_unstable(spark: SparkSession, path: str) -> DataFrame:
    """stamp, mode, id of all recorded unstable items; a report joins them to the runs it names."""
    return spark.read.schema("stamp string, mode string, id string").json(path)


def count_malformed(spark: SparkSession, path: str) -> DataFrame:
    """How many lines of the history could not be read."""
    try:
        lines = spark.read.text(path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(exc):
            return spark.sql("SELECT CAST(0 AS BIGINT) AS n_malformed")
        raise
    bad = (F.trim("value") != "") & ~_is_object(F.col("value"))
    return lines.agg(F.count_if(F.coalesce(bad, F.lit(False))).alias("n_malformed"))


def append_history(runs: DataFrame, path: str) -> None:
    """One line per run, added to what is there."""
    missing = [f for f in HISTORY.fields if f.name not in runs.columns]
    full = runs.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
    full.select(*[F.col(f.name).cast(f.dataType) for f in HISTORY.fields]).write.mode(
        "append").option("ignoreNullFields", "false").json(path)


def run_rows(items: DataFrame, grades: DataFrame, summary: DataFrame) -> DataFrame:
    """Items of every round with the grades of that round and the summary of their mode."""
    graded = items.join(grades, ["mode", "round_index", "id"], "left")
    return graded.join(summary.select("mode", F.struct(*[
        F.col(c) for c in summary.columns if c != "mode"]).alias("summary")), "mode", "left")


def write_run(items: DataFrame, grades: DataFrame, summary: DataFrame, path: str) -> None:
    """Per-item report, one JSON line per (round, item), one directory per mode."""
    run_rows(items, grades, summary).write.mode("overwrite").partitionBy("mode").json(path)
