"""Scope before rank, context, passages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.functions.vectors import cosine_distance
from dossier.operators import retrieval
from dossier.operators.access import Scopes
from dossier.operators.embedding import HashProvider

WIDTH = 8
CHUNK = "chunk_id bigint, case_id bigint, document_id bigint, sequence int, page_number int, text string, embedding array<float>"


def vector(text):
    return HashProvider(WIDTH).embed([text])[0]


def chunk(i, case, document, sequence, text):
    return (i, case, document, sequence, sequence + 1, text, vector(text))


@pytest.fixture
def chunks(frame):
    return frame([
        chunk(1, 10, 100, 0, "The notice period is a month."), chunk(2, 10, 100, 1, "and it begins when"),
        chunk(3, 10, 100, 2, "Notice reaches the other side."), chunk(4, 11, 110, 0, "The notice period is a month."),
        chunk(5, 11, 110, 1, "Nothing else."),
    ], CHUNK)


def ids(rows):
    return [r["chunk_id"] for r in rows.collect()]


def test_distance(value):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert value(cosine_distance(v(1, 0), v(1, 1))) == pytest.approx(1 - 2 ** -0.5)
    assert value(cosine_distance(v(0, 0), v(1, 1))) is None


def test_search_ranks_only_the_scope(chunks):
    asked = vector("The notice period is a month.")
    assert ids(retrieval.search(chunks, asked, retrieval.ALL_CASES, 2)) == [1, 4]
    assert ids(retrieval.search(chunks, asked, retrieval.these_cases(11), 5))[0] == 4
    assert set(ids(retrieval.search(chunks, asked, retrieval.these_cases(10), 5))) == {1, 2, 3}
    assert ids(retrieval.search(chunks, asked, retrieval.these_cases(), 5)) == []


def random_world(frame, n_chunks=400, n_questions=60, n_users=12, seed=5):
    rng = random.Random(seed)
    base = np.random.default_rng(seed)
    vectors = base.normal(size=(n_chunks, WIDTH)).astype(np.float32)
    vectors[::7] = vectors[0]  # equal vectors: ties
    vectors[13] = 0  # no direction
    # One case has a third of all chunks.
    rows = [(i, 1 if rng.random() < 0.33 else rng.randrange(2, 9), i // 5, i % 5, 1, "t", [float(x) for x in v])
            for i, v in enumerate(vectors)]
    asked = [(q, rng.randrange(n_users), [float(x) for x in base.normal(size=WIDTH)]) for q in range(n_questions)]
    flags = {u: u == 0 for u in range(n_users)}
    edges = {(u, c) for u in range(1, n_users - 1) for c in range(1, 9) if rng.random() < 0.4}
    scopes = Scopes(frame([(u, f, 0) for u, f in flags.items()], "user_id bigint, all_cases boolean, n_cases bigint"),
                    frame(sorted(edges), "user_id bigint, case_id bigint"))
    return (frame(rows, CHUNK), frame(asked, "query_id bigint, user_id bigint, embedding array<double>"), scopes,
            rows, asked, flags, edges)


def brute(rows, asked, flags, edges, k):
    out = set()
    for q, user, v in asked:
        ranked = []
        for i, case, *_, e in rows:
            if flags[user] or (user, case) in edges:
                a, b = np.array(v), np.array(e)
                length = np.linalg.norm(a) * np.linalg.norm(b)
                distance = round(1 - float(a @ b) / length, 12) if length else float("inf")
                ranked.append((distance, i))
        out |= {(q, n + 1, i) for n, (_, i) in enumerate(sorted(ranked)[:k])}
    return out


@pytest.mark.parametrize("limits", [{}, {"max_questions": 7}, {"max_question_cases": 3}, {"max_questions": 13, "max_question_cases": 5}])
def test_batch_search_equals_brute_force(frame, limits):
    chunk_rows, questions, scopes, *world = random_world(frame)
    found = retrieval.search_batch(questions, scopes, chunk_rows, 5, **limits)
    assert {(r["query_id"], r["match_rank"], r["chunk_id"]) for r in found.collect()} == brute(*world, 5)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [60, 59, 10])
def test_one_question_more_than_a_block_holds(frame, most):
    """No exchange below the ranking, and the same rows."""
    chunk_rows, questions, scopes, *world = random_world(frame, seed=6)
    found = retrieval.search_batch(questions, scopes, chunk_rows, 4, max_questions=most)
    below = plan(found).split("WindowGroupLimit")[-1]
    assert below.count("MapInArrow") == -(-60 // most) and "Exchange" not in below
    assert {(r["query_id"], r["match_rank"], r["chunk_id"]) for r in found.collect()} == brute(*world, 4)


def test_many_splits_are_merged_before_the_ranking(spark, frame):
    chunk_rows, questions, scopes, *world = random_world(frame, seed=7)
    found = retrieval.search_batch(questions, scopes, chunk_rows.repartition(50), 3)
    assert "Coalesce 32" in plan(found)
    assert {(r["query_id"], r["match_rank"], r["chunk_id"]) for r in found.collect()} == brute(*world, 3)


def test_small_tiles_give_the_same(frame, monkeypatch):
    rng = np.random.default_rng(1)
    rows, asked = rng.normal(size=(500, 4)), rng.normal(size=(9, 4))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    asked /= np.linalg.norm(asked, axis=1)[:, None]
    monkeypatch.setattr(retrieval, "_TILE", 40)
    best = retrieval._Best(9, 3)
    keys = np.stack([np.arange(500)] * 4, axis=1)
    best.offer(rows, keys, asked, np.arange(9))
    got = best.result(np.arange(9)).to_pydict()
    for q in range(9):
        want = np.lexsort((np.arange(500), np.round(1 - rows @ asked[q], 12)))[:3]
        assert [c for c, i in zip(got["chunk_id"], got["query_id"]) if i == q] == list(want)


def test_no_scope_no_rows(frame, chunks):
    scopes = Scopes(frame([(1, False, 0)], "user_id bigint, all_cases boolean, n_cases bigint"),
                    frame([], "user_id bigint, case_id bigint"))
    asked = frame([(1, 1, vector("x")), (2, 99, vector("x"))], "query_id bigint, user_id bigint, embedding array<double>")
    assert retrieval.search_batch(asked, scopes, chunks).count() == 0
    assert retrieval.search_batch(asked, scopes, chunks, max_questions=1).count() == 0


MATCH = "query_id bigint, match_rank int, case_id bigint, document_id bigint, sequence int"


def test_neighbours_only_where_cut_off(frame, chunks):
    matches = frame([(1, 1, 10, 100, 1), (1, 2, 11, 110, 0), (2, 1, 10, 100, 0)], MATCH)
    got = retrieval.with_neighbours(matches, chunks).orderBy("query_id", "match_rank", "ctx_pos").collect()
    assert [(r["query_id"], r["match_rank"], r["chunk_id"], r["is_match"]) for r in got] == [
        (1, 1, 1, False), (1, 1, 2, True), (1, 1, 3, False), (1, 2, 4, True), (2, 1, 1, True)]


def test_neighbours_stay_in_the_case(frame):
    # A stray row of another case under the same document number must not come along.
    rows = frame([chunk(1, 10, 100, 0, "begins here"), chunk(2, 66, 100, 1, "secret of another case.")], CHUNK)
    got = retrieval.with_neighbours(frame([(1, 1, 10, 100, 0)], MATCH), rows)
    assert ids(got) == [1]


def test_unique_passages(frame, chunks):
    matches = frame([(1, 1, 10, 100, 1), (1, 2, 10, 100, 2), (1, 3, 10, 100, 0), (1, 4, 11, 110, 0)], MATCH)
    context = retrieval.with_neighbours(matches, chunks)
    got = retrieval.unique_passages(context).orderBy("passage").collect()
    assert [(r["passage"], r["chunk_id"]) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_citation_names(frame):
    cited = frame([(1, 100), (2, 999)], "query_id bigint, document_id bigint")
    names = frame([(100, "ruling.pdf")], "document_id bigint, filename string")
    got = {r["document_id"]: r["document_name"] for r in retrieval.name_citations(cited, names).collect()}
    assert got == {100: "ruling.pdf", 999: "Unknown document"}


def test_models_must_agree(frame, chunks):
    scopes = Scopes(frame([(1, True, 0)], "user_id bigint, all_cases boolean, n_cases bigint"),
                    frame([], "user_id bigint, case_id bigint"))
    asked = frame([(1, 1, vector("x"), "a")], "query_id bigint, user_id bigint, embedding array<double>, model string")
    assert retrieval.search_batch(asked, scopes, chunks.withColumn("model", F.lit("a"))).count() == 5
    with pytest.raises(Exception, match="of model a, a chunk is of b"):
        retrieval.search_batch(asked, scopes, chunks.withColumn("model", F.lit("b"))).count()
    with pytest.raises(ValueError, match="different models"):
        retrieval.same_model(asked.unionByName(asked.withColumn("model", F.lit("c"))), chunks)


def test_a_very_long_scope_is_joined(chunks, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_LISTED_CASES", 1)
    asked = vector("The notice period is a month.")
    assert set(ids(retrieval.search(chunks, asked, retrieval.these_cases(10, 77), 5))) == {1, 2, 3}


def test_texts_are_not_shuffled_and_only_their_range_is_read(spark, frame, tmp_path):
    """With broadcasting by estimates off, as for tables that look large."""
    path = str(tmp_path / "chunks")
    rows = spark.range(3000).selectExpr("id AS chunk_id", "id % 3 AS case_id", "id div 3 AS document_id", "CAST(id % 3 AS int) AS sequence",
                                        "1 AS page_number", "concat('Text ', id, CASE WHEN id % 2 = 0 THEN '.' ELSE '' END) AS text")
    rows.repartitionByRange(10, "document_id").write.parquet(path)
    matches = frame([(q, 1, q % 3, q * 7, q % 3) for q in range(100)], MATCH)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval.with_neighbours(matches, spark.read.parquet(path))
        whole = sorted(map(tuple, found.collect()))
        text = plan(found)
        cut = text[:text.index("BroadcastHashJoin")]
        assert "SortMergeJoin" not in text and cut.count("Exchange hashpartitioning(query_id") >= 1
        assert "GreaterThanOrEqual(document_id,0)" in text and "LessThanOrEqual(document_id,693)" in text
        wanted = matches.select("query_id", "case_id", "document_id", "sequence")
        texts = spark.read.parquet(path)
        keys = ["case_id", "document_id", "sequence"]
        once, blocks = retrieval.fetch(wanted, texts, keys), retrieval.fetch(wanted, texts, keys, most=9)
        assert plan(blocks).count("BroadcastHashJoin") == 12 and "SortMergeJoin" not in plan(blocks)
        assert sorted(map(str, once.collect())) == sorted(map(str, blocks.select(once.columns).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert whole == sorted(map(tuple, retrieval.with_neighbours(matches, spark.read.parquet(path)).collect()))


@pytest.mark.parametrize("share,limits", [(64 * WIDTH * 8, {}), (10**9, {"max_question_cases": 7}), (64 * WIDTH * 8, {"max_question_cases": 1})])
def test_many_questions_meet_the_chunks_in_one_shuffle(frame, monkeypatch, share, limits):
    """However many blocks of questions there are, the plan has one step that ranks and the driver gets no question."""
    monkeypatch.setattr(retrieval, "MAX_SHARE_BYTES", share)
    monkeypatch.setattr(retrieval, "_question_blocks", None)
    chunk_rows, questions, scopes, *world = random_world(frame, seed=8)
    found = retrieval.search_batch(questions, scopes, chunk_rows, 4, max_questions=2, **limits)
    assert plan(found).split("Initial Plan")[-1].count("MapInArrow") == 1
    assert {(r["query_id"], r["match_rank"], r["chunk_id"]) for r in found.collect()} == brute(*world, 4)


def test_one_search_for_two_passes(spark):
    """The query that accumulates passes ranks once and goes on from what it found."""
    from workload.retrieval import accumulate

    assert "MapInArrow" not in plan(accumulate(spark, "/root/testdata/sf0.001"))


def test_many_wanted_rows_are_joined_with_the_texts(frame, monkeypatch):
    wanted = frame([(q, 1, q % 7, q % 3) for q in range(60)], "query_id bigint, case_id bigint, document_id bigint, sequence int")
    texts = frame([(1, d, s, f"{d} {s}") for d in range(7) for s in range(2)], "case_id bigint, document_id bigint, sequence int, text string")
    keys = ["case_id", "document_id", "sequence"]
    sent = retrieval.fetch(wanted, texts, keys, most=9)
    monkeypatch.setattr(retrieval, "MAX_SENT", 20)
    joined = retrieval.fetch(wanted, texts, keys, most=9)
    assert sorted(map(str, joined.select(sent.columns).collect())) == sorted(map(str, sent.collect()))
    assert "Union" not in plan(joined)


def test_many_wanted_rows_do_not_pass_the_driver(spark):
    """A search of 20,000 questions asks for 300,000 places; these are joined with the texts."""
    wanted = spark.range(300_000).selectExpr("id AS query_id", "id % 10 AS case_id", "id % 1000 AS document_id", "0 AS sequence")
    texts = spark.range(1000).selectExpr("id % 10 AS case_id", "id AS document_id", "0 AS sequence", "'Text.' AS text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = retrieval.fetch(wanted, texts, ["case_id", "document_id", "sequence"])
        assert "Broadcast" not in plan(found) and found.count() == 300_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_pairs_are_measured(monkeypatch):
    """Products in single precision leave a few rows a question, of which some are equal; the nearest are those of double precision."""
    rng = np.random.default_rng(2)
    rows, asked = rng.normal(size=(4000, 16)), rng.normal(size=(30, 16))
    rows[::9], rows[5], asked[3] = rows[0], 0, 0
    rows[100] = rows[200] * (1 + 1e-9)
    with np.errstate(invalid="ignore", divide="ignore"):
        rows /= np.linalg.norm(rows, axis=1)[:, None]
        asked /= np.linalg.norm(asked, axis=1)[:, None]
    keys = np.stack([rng.permutation(4000)] * 4, axis=1)
    measured, real = [], np.round
    monkeypatch.setattr(retrieval.np, "round", lambda a, *more: measured.append(np.size(a)) or real(a, *more))
    best = retrieval._Best(30, 5)
    for at in range(0, 4000, 1000):
        few = np.flatnonzero((np.arange(30) + at // 1000) % 3)  # some questions come later than others
        best.offer(rows[at:at + 1000], keys[at:at + 1000], asked, few)
    got = best.result(np.arange(30)).to_pydict()
    monkeypatch.undo()
    assert sum(measured) < 30 * 4000 / 4
    for q in range(30):
        seen = np.concatenate([np.arange(at, at + 1000) for at in range(0, 4000, 1000) if (q + at // 1000) % 3])
        distance = np.round(1 - rows[seen] @ asked[q], 12)
        want = keys[seen[np.lexsort((keys[seen, 0], np.where(np.isnan(distance), np.inf, distance)))[:5]], 0]
        assert [c for c, i in zip(got["chunk_id"], got["query_id"]) if i == q] == list(want)
        assert len(got["chunk_id"]) == 150


def test_no_null_lists_on_the_way_to_the_ranking(spark, frame, monkeypatch):
    """A batch goes over its null lists again for each of its rows."""
    monkeypatch.setattr(retrieval, "_question_blocks", None)
    chunk_rows, questions, scopes, *_ = random_world(frame, seed=8)
    sent, real = [], type(chunk_rows).mapInArrow
    monkeypatch.setattr(type(chunk_rows), "mapInArrow", lambda self, *a, **k: sent.append(self) or real(self, *a, **k))
    retrieval.search_batch(questions, scopes, chunk_rows, 4, max_questions=2)
    assert "cases" in sent[0].columns and sent[0].where("cases IS NULL").count() == 0
