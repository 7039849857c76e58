"""Every registered query against its SQL on the smallest tables, and the plans that matter."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tools.check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    return connect(SF)


@pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    outcome = compare(database, spark, SF, name, QUERIES[name], ORACLES.get(name))
    assert outcome.startswith(("ok", "rows only")), outcome


def test_every_sql_has_a_query():
    from workload import base

    assert set(ORACLES) <= set(QUERIES) and set(base.ORACLES) == set(base.QUERIES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables are not here")
def test_scope_reaches_the_scan_and_ranking_keeps_k_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    from dossier.operators import retrieval

    path = str(tmp_path / "chunks")
    spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").cast("bigint").alias("case_id"), "embedding").write.parquet(path)
    text = plan(retrieval.search(spark.read.parquet(path), [0.1] * 64, retrieval.these_cases(1, 2), 5))
    assert "TakeOrderedAndProject" in text and "PushedFilters: [In(case_id, [1,2])]" in text


@pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables are not here")
def test_plans_without_a_shuffle(spark):
    """Chunking and embedding only shuffle where a small input is spread over the cores."""
    for name in ("c1_chunk_fixed", "c2_chunk_windows", "c4_document_numbering_nested", "d1_hash_embed", "a12_html_main_text"):
        text = plan(QUERIES[name](spark, SF))
        assert text.count("Exchange") == text.count("Exchange RoundRobinPartitioning"), name
        assert "CartesianProduct" not in text
