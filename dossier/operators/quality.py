"""Data quality checks and value migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import is_blank


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def foreign_key_violations(child: DataFrame, column: str, parent: DataFrame,
                           parent_key: str) -> DataFrame:
    """Child rows whose reference (null aside) is not a key of the parent.

    The child is streamed past the parent's keys and not sorted: a task holds its share of the keys only.
    """
    keys = parent.select(F.col(parent_key).alias(column)).distinct().hint("shuffle_hash")
    return child.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def chunk_case_violations(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks that name another case than their document does, with that case; null where there is no such document."""
    owner = documents.select("document_id", F.col("case_id").alias("document_case_id"))
    return chunks.join(owner, "document_id", "left").where(~F.col("case_id").eqNullSafe(F.col("document_case_id")))


def domain_violations(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).isin(values), F.lit(False)))


def remap(column: Column, mapping: dict[str, str], default: str) -> Column:
    result = F.lit(default)
    for old, new in mapping.items():
        result = F.when(column == old, F.lit(new)).otherwise(result)
    return result


def remap_values(df: DataFrame, column: str, mapping: dict[str, str], default: str) -> DataFrame:
    return df.withColumn(column, remap(F.col(column), mapping, default))


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The target plus the rows whose key it does not hold yet (rows have distinct keys)."""
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti"))


def blank_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a column of nothing but white space, and which; null is not blank."""
    flags = F.array(*[F.when(is_blank(F.col(c)), F.lit(c)) for c in columns])
    return df.withColumn("blank", F.filter(flags, lambda c: c.isNotNull())).where(
        F.size("blank") > 0)


# Children come before what they refer to.
PURGE_ORDER = ["chunks", "documents", "assignments", "cases"]


def purge_cases(tables: dict[str, DataFrame], case_ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the given cases, children first."""
    gone = case_ids.select("case_id").distinct()
    return {
        name: tables[name].join(gone, "case_id", "left_anti")
        for name in PURGE_ORDER if name in tables
    }
