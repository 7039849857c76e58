"""Honest statistics over repeated rounds."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from dossier.functions import cells
from dossier.operators import evaluation
from dossier.operators.answering import ExtractiveProvider
from dossier.operators.embedding import HashProvider
from dossier.plans.ask import Models
from dossier.plans.evaluate import eval_run
from dossier.schemas import GRADES, ITEM_RESULTS
from dossier.sources import runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAN = float("nan")


def item(round_index, id, ctx=True, ans=True, text="t", mode="direct", route=None, latency=100, tokens=None, answered=True):
    return (mode, round_index, id, "en", "q", answered, ctx, ans, text, ["c"], route, 0, 1, latency, tokens or {"input": 2}, id)


@pytest.fixture
def items(frame):
    return lambda *rows: frame(list(rows), ITEM_RESULTS)


def test_summary_of_a_round(items, frame):
    results = items(item(0, "a", route="multi_step"), item(0, "b", ctx=False, latency=201, tokens={"input": 3, "output": 1}),
                    item(0, "c", ans=False, answered=False))
    grades = frame([("direct", 0, "a", 0.5, NAN), ("direct", 0, "b", 1.0, None)], GRADES)
    got = evaluation.summarise_round(results, grades).head()
    assert (got["total"], got["context_hit_rate"], got["answer_hit_rate"], got["answered_rate"]) == (3, 0.667, 0.667, 0.667)
    assert (got["mean_faithfulness"], got["faithfulness_graded"]) == (0.75, 2)
    assert (got["mean_answer_relevancy"], got["answer_relevancy_graded"]) == (None, 0)
    assert (got["multi_step_routed"], got["duplicates_avoided"], got["mean_latency_ms"], got["max_latency_ms"]) == (1, 3, 133, 201)
    assert got["tokens"] == {"input": 7, "output": 1}


def test_no_grades_at_all(items, frame):
    got = evaluation.summarise_round(items(item(0, "a")), frame([], GRADES)).head()
    assert got["mean_faithfulness"] is None and got["faithfulness_graded"] == 0


@pytest.mark.parametrize("values, want", [
    ([1.0, 0.5], (0.75, 0.354, 0.5, 1.0, 2)), ([0.9], (0.9, None, 0.9, 0.9, 1)), ([None, 0.4], (0.4, None, 0.4, 0.4, 1)),
    ([None, None], (None, None, None, None, 0)), ([1.0, 1.0], (1.0, 0.0, 1.0, 1.0, 2)),
])
def test_spread(frame, values, want):
    assert tuple(frame([(v,) for v in values], "v double").agg(evaluation.spread(F.col("v")).alias("s")).head()["s"]) == want


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_unstable_items(items):
    rows = [item(0, "a"), item(1, "a"), item(0, "ctx"), item(1, "ctx", ctx=False), item(0, "ans"), item(1, "ans", ans=False)]
    assert ids(evaluation.unstable_items(items(*rows))) == ["ans", "ctx"]
    assert ids(evaluation.unstable_items(items(item(0, "a"), item(0, "a", ctx=False)))) == []


@pytest.mark.parametrize("rows, want", [
    ([(0, "x"), (1, "x")], True), ([(0, "x"), (1, "y")], False), ([(0, "x")], None),
])
def test_answers_repeated_exactly(items, rows, want):
    made = items(*[item(r, "a", text=t) for r, t in rows])
    assert evaluation.answers_repeated_exactly(made).head()["answers_repeated_exactly"] is want


def aggregated(items, frame, rows):
    made = items(*rows)
    return evaluation.aggregate_runs(evaluation.summarise_round(made, frame([], GRADES)), made)


def test_aggregate_and_compare(items, frame):
    rows = [item(r, i, ctx=not (r == 1 and i == "b"), mode=m) for r in (0, 1) for i in "ab" for m in ("direct", "graph")]
    rows += [item(0, "c", mode="graph"), item(1, "c", mode="graph")]
    both = aggregated(items, frame, rows)
    direct = both.where("mode = 'direct'").head()
    assert tuple(direct["context_hit_rate"]) == (0.75, 0.354, 0.5, 1.0, 2)
    assert direct["n_unstable"] == 1 and direct["answers_repeated_exactly"] and direct["total"] == 2
    assert direct["total_tokens"] == {"input": 8} and direct["mean_faithfulness"]["rounds"] == 0
    verdicts = {r["metric"]: (r["delta"], r["verdict"]) for r in evaluation.compare_modes(both).collect()}
    assert verdicts["context_hit_rate"] == (0.084, "NOISE") and verdicts["answer_hit_rate"] == (0.0, "NOISE")
    assert "mean_faithfulness" not in verdicts


@pytest.mark.parametrize("value", [
    (0.933 + 0.934) / 2, 0.8665, 0.9385, 0.0005, 0.0015, 0.0625, 0.1875, 1.0, 0.0, -0.0125, -2.5005, 12.3455, 1 / 3, 2047.0625, None,
])
def test_rounding_by_the_stored_value(frame, value):
    got = frame([(value,)], "v double").select(evaluation.thousandths(F.col("v"))).head()[0]
    assert got == (None if value is None else round(value, 3))


def test_every_unstable_item_is_kept(spark, tmp_path):
    many = spark.range(12_000).select(F.lit("direct").alias("mode"), F.col("id").cast("string").alias("id"))
    runs.append_unstable(many, "20260101-000000", str(tmp_path / "unstable"))
    assert runs.read_unstable(spark, str(tmp_path / "unstable")).where("mode = 'direct'").distinct().count() == 12_000


def test_history_line_with_an_odd_field_stays(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"stamp": "a", "total": "x"}\n[1]\n{"stamp": "b", "total": 3}\n{"st\n\n')
    got = [(r["stamp"], r["total"]) for r in runs.read_history(spark, str(tmp_path / "h.json")).collect()]
    assert got == [("a", None), ("b", 3)]
    assert runs.count_malformed(spark, str(tmp_path / "h.json")).head()[0] == 2


def test_change_outside_the_spread(items, frame):
    rows = [item(r, i, ans=m == "graph", mode=m) for r in (0, 1) for i in "ab" for m in ("direct", "graph")]
    got = {r["metric"]: (r["delta"], r["verdict"]) for r in evaluation.compare_modes(aggregated(items, frame, rows)).collect()}
    assert got["answer_hit_rate"] == (1.0, "outside spread")


STATS = "s struct<mean:double,stdev:double>, g bigint, t bigint"


@pytest.mark.parametrize("stats, graded, total, cell", [
    ((0.9, 0.01), None, 15, "0.9 ± 0.01"), ((0.9, None), None, 15, "0.9"), ((None, None), 0, 15, "—"), (None, None, 15, "—"),
    ((0.917, None), 8, 15, "0.917<br>*(8/15 graded)*"), ((0.75, 0.0), 15, 15, "0.75 ± 0.0"),
])
def test_metric_cell(frame, stats, graded, total, cell):
    row = frame([(stats, graded, total)], STATS)
    assert row.select(cells.metric_cell(F.col("s"), F.col("g"), F.col("t"))).head()[0] == cell


@pytest.mark.parametrize("rounds, same, n, cell", [
    (1, None, 0, "not measured"), (None, None, 0, "not measured"), (2, True, 0, "deterministic"), (3, False, 4, "4/15"),
])
def test_stability_cell(frame, rounds, same, n, cell):
    row = frame([(rounds, same, n, 15)], "r bigint, s boolean, n int, t bigint")
    assert row.select(cells.stability_cell(F.col("r"), F.col("s"), F.col("n"), F.col("t"))).head()[0] == cell


@pytest.mark.parametrize("tokens, cell", [
    ({"input": 14786, "output": 10540}, "25,326"), ({"total": 50652, "input": 1}, "50,652"), ({}, "—"), (None, "—"),
])
def test_tokens_cell(frame, tokens, cell):
    assert frame([(tokens,)], "t map<string,bigint>").select(cells.tokens_cell(F.col("t"))).head()[0] == cell


def test_hits(frame):
    gold = frame([("a", "section"), ("b", "x\ny"), ("c", "none")], "id string, expected_section string")
    found = frame([("a", 1, "the section text"), ("b", 1, "x"), ("b", 2, "y"), ("c", 1, "no")], "id string, match_rank int, text string")
    got = {r["id"]: r["context_hit"] for r in evaluation.context_hit(gold, found).collect()}
    assert got == {"a": True, "b": True, "c": False}
    rows = frame([(True, "has 21 days", ["21", "x"]), (True, "no", ["21"]), (False, "21", ["21"]), (True, None, ["21"]), (True, "21", [])],
                 "a boolean, t string, n array<string>")
    assert [r[0] for r in rows.select(evaluation.answer_hit(F.col("a"), F.col("t"), F.col("n"))).collect()] == [
        True, False, False, False, False]


def test_scores_and_grades(items, frame):
    scores = frame([("a", "faithfulness", 0.5), ("a", "answer_relevancy", NAN), ("z", "faithfulness", 1.0)],
                   "trace_id string, name string, value double")
    assert [(r["id"], r["name"]) for r in evaluation.attach_scores(items(item(0, "a")), scores).collect()] == [("a", "faithfulness")]

    def failing():
        def grade_one(question, answer, contexts):
            if answer == "bad":
                raise RuntimeError
            return {"faithfulness": 1.0}

        return grade_one

    made = items(item(0, "a"), item(0, "b", text="bad"), item(0, "c", answered=False))
    got = {r["id"]: (r["faithfulness"], r["answer_relevancy"]) for r in evaluation.grade(made, failing).collect()}
    assert set(got) == {"a", "b"} and got["a"][0] == 1.0 and got["a"][1] != got["a"][1] and got["b"][0] != got["b"][0]


def test_whole_run(spark, frame, tmp_path):
    texts = ["Article one. Leave is 21 days. End.", "Article two. Notice takes a month. End."]
    provider = HashProvider(8)
    chunks = frame([(i, 1, i, 0, 1, t, provider.embed([t])[0]) for i, t in enumerate(texts)],
                   "chunk_id bigint, case_id bigint, document_id bigint, sequence int, page_number int, text string, embedding array<float>")
    gold = frame([("leave", "en", texts[0], "Article one", ["Article"]), ("none", "en", "q", "Article nine", ["nowhere"])],
                 "id string, lang string, question string, expected_section string, expected_answer_contains array<string>")
    documents = frame([(0, "law.pdf")], "document_id bigint, filename string")
    done = eval_run(gold, chunks, documents, Models(lambda: HashProvider(8), ExtractiveProvider, 8), "graph", rounds=2, multi_step=True)
    row = done.aggregate.head()
    assert (row["rounds"], row["total"], row["answers_repeated_exactly"], row["n_unstable"]) == (2, 2, True, 0)
    assert row["context_hit_rate"]["mean"] == 0.5 and row["answered_rate"]["mean"] == 1.0
    assert row["faithfulness_graded"] == 2 and row["total_tokens"]["total"] > 0
    stamped = done.aggregate.withColumn("stamp", F.lit("20260101-000000"))
    for _ in range(2):
        runs.append_history(stamped, str(tmp_path / "history"))
    history = runs.read_history(spark, str(tmp_path / "history"))
    shown = evaluation.runs_table(history).collect()
    assert len(shown) == 2 and shown[0]["unstable"] == "deterministic" and shown[0]["context_hit_rate"] == "0.5 ± 0.0"
    assert evaluation.latest_run(history).head()["mode"] == "graph"
    runs.write_run(done.items, done.grades, done.aggregate, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run")).count() == 4


def test_grades_of_a_batch_in_parts(frame, monkeypatch):
    """Long answers of one batch are not all Python objects at a time; every one is graded."""
    long = "common " * 100_000
    items = frame([("direct", 0, str(i), "common", long, True, ["common"]) for i in range(30)],
                  "mode string, round_index int, id string, question string, answer_text string, answered boolean, contexts array<string>")
    sizes = items.coalesce(1).transform(evaluation.grade)
    assert sizes.count() == 30 and sizes.where("faithfulness = 1 AND answer_relevancy = 1").count() == 30
