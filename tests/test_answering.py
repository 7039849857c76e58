"""Replies, the loop, and whole answers."""

import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from dossier.functions import replies
from dossier.operators import answering, retrieval
from dossier.operators.embedding import HashProvider
from dossier.plans import ask

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 8


@pytest.mark.parametrize("reply, n, rule, numbers", [
    ("Yes [१].", 2, "answered", [1]), ("Yes [1].", 2, "answered", [1]), ("Yes [2][1][2]", 2, "answered", [2, 1, 2]), ("Yes [3]", 2, "out of range", None),
    ("Yes [0]", 2, "out of range", None), ("Yes", 2, "no citation", None), (" NOT_FOUND\n", 2, "not found", None),
    ("", 2, "empty", None), (None, 2, "empty", None), ("نعم [٢]", 2, "answered", [2]), ("[99999999999999999999]", 2, "out of range", None),
    ("NOT_FOUND [1]", 2, "answered", [1]), ("ok [1]", 0, "no passages", None), ("see [a] [1 ]", 2, "no citation", None),
])
def test_check_reply(frame, reply, n, rule, numbers):
    got = frame([(reply, n)], "reply string, n int").select(replies.check_reply(F.col("reply"), F.col("n")).alias("c")).head()["c"]
    assert (got["rule"], got["numbers"], got["answered"]) == (rule, numbers, rule == "answered")
    assert (got["text"] is None) == (rule != "answered")


def test_citations_once_in_order_of_use(frame):
    rows = frame([(1, "x [3][1][2]", 3, [(7, 1), (8, 1), (7, 1)])],
                 "query_id bigint, reply string, n_passages int, places array<struct<document_id:bigint,page_number:int>>")
    got = answering.citations_of(answering.check_replies(rows)).orderBy("position").collect()
    assert [(r["document_id"], r["page_number"]) for r in got] == [(7, 1), (8, 1)]


@pytest.mark.parametrize("reply, route, unexpected", [
    ("MULTI_STEP", "multi_step", False), (" multi_step\n", "multi_step", False), ("SINGLE_SHOT", "single_shot", False),
    ("It is MULTI_STEP", "single_shot", True), ("", "single_shot", True), (None, "single_shot", True),
])
def test_parse_route(frame, reply, route, unexpected):
    rows = frame([(reply,)], "r string")
    got = rows.select(replies.parse_route(F.col("r")).alias("p")).head()["p"]
    assert (got["route"], got["unexpected"]) == (route, unexpected)
    assert rows.select(replies.parse_route(F.col("r"), multi_step=False).alias("p")).head()["p"]["route"] == "single_shot"


@pytest.mark.parametrize("reply, goes_on, question, unexpected", [
    ("CONTINUE\n next one \nmore", True, "next one", False), ("continue", True, "Q", False), ("DONE", False, None, False),
    ("done\nCONTINUE", False, None, False), ("maybe", False, None, True), ("", False, None, True), ("CONTINUE\n\nx", True, "", False),
])
def test_parse_reason(frame, reply, goes_on, question, unexpected):
    got = frame([(reply,)], "r string").select(replies.parse_reason(F.col("r"), F.lit("Q")).alias("p")).head()["p"]
    assert (got["should_continue"], got["sub_question"], got["unexpected"]) == (goes_on, question, unexpected)


def test_prompts(value):
    prompt = value(replies.answer_prompt(F.lit("Why?"), F.array(F.lit("a"), F.lit("b"))))
    assert prompt.endswith("Passages:\n[1] a\n\n[2] b\n\nQuestion: Why?\n\nAnswer:")
    assert value(replies.answer_prompt(F.lit("Why?"), F.array().cast("array<string>"))) is None
    none = F.array().cast("array<string>")
    assert value(replies.reason_prompt(F.lit("Q"), none, none)).endswith(
        "Original question: Q\n\nNothing retrieved yet.\n\nDecision:")
    assert value(replies.reason_prompt(F.lit("Q"), F.array(F.lit("s")), F.array(F.lit("t")))).endswith(
        "Q\n\nReasoning so far:\n1. s\n\nRetrieved so far:\n- t\n\nDecision:")


@pytest.mark.parametrize("payload, usage", [
    ('{"usage": {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7}}', {"input": 3, "output": 4, "total": 7}),
    ('{"usage": {"prompt_tokens": "3", "completion_tokens": 1.5, "total_tokens": 7}}', {"total": 7}),
    ('{"usage": null}', {}), ('{"usage": [1]}', {}), ("[]", {}), ("not json", {}), ('{}', {}),
    ('{"usage": {"prompt_tokens": -1, "total_tokens": null}}', {"input": -1}),
])
def test_usage(frame, payload, usage):
    assert frame([(payload,)], "p string").select(replies.usage_from_payload(F.col("p"))).head()[0] == usage


# --- whole answers ------------------------------------------------------------------------

TEXTS = [
    (1, 10, 100, 0, "Leave is 21 days. More follows."), (2, 10, 100, 1, "Wages are paid monthly."),
    (3, 11, 110, 0, "Notice takes a month."), (4, 12, 120, 0, "Secret settlement."),
]


@pytest.fixture
def world(frame):
    provider = HashProvider(WIDTH)
    chunks = frame([(i, c, d, s, s + 1, t, provider.embed([t])[0]) for i, c, d, s, t in TEXTS],
                   "chunk_id bigint, case_id bigint, document_id bigint, sequence int, page_number int, text string, embedding array<float>")
    users = frame([(1, "partner"), (2, "attorney"), (3, "attorney")], "user_id bigint, role string")
    edges = frame([(2, 10), (2, 11)], "user_id bigint, case_id bigint")
    documents = frame([(100, "law.pdf"), (120, "secret.pdf")], "document_id bigint, filename string")
    return users, edges, chunks, documents


class CountingWriter(answering.ExtractiveProvider):
    """Refuses to be asked about anything a restricted user may not read."""

    def generate(self, prompt):
        if "Secret" in prompt and "partner" not in prompt:
            raise AssertionError("leaked")
        return super().generate(prompt)


class Hostile(answering.ScriptedProvider):
    """Never stops, and asks for what lies outside the scope."""

    def generate(self, prompt):
        if prompt.endswith("Classification:"):
            return "MULTI_STEP", {"input": 1}
        if prompt.endswith("Decision:"):
            return "CONTINUE\nSecret settlement.", {"input": 10}
        return super().generate(prompt)


class Broken:
    def generate(self, prompt):
        raise TimeoutError("no reply")


QUESTIONS = [(1, 1, "partner: Secret settlement."), (2, 2, "Leave is 21 days. More follows."), (3, 3, "Notice?"),
             (4, 2, "  "), (5, 42, "Who am I?")]


def run(frame, world, writer, **kwargs):
    models = ask.Models(lambda: HashProvider(WIDTH), writer, WIDTH)
    found = ask.ask_batch(frame(QUESTIONS, "query_id bigint, user_id bigint, question string"), *world, models, **kwargs)
    return {r["query_id"]: r for r in found.collect()}


def test_ask_batch(frame, world):
    got = run(frame, world, CountingWriter)
    assert got[1]["answered"] and got[1]["scope"] == "all cases"
    assert got[2]["answer"] == "Leave is 21 days. [1]" and got[2]["scope"] == "2 case(s)"
    assert [tuple(c) for c in got[2]["citations"]] == [(100, "law.pdf", 1)]
    assert [got[q]["why"] for q in (3, 4, 5)] == ["no authorized cases", "blank question", "no authorized cases"]
    for q in (3, 4, 5):
        assert got[q]["answer"] is None and got[q]["citations"] == [] and got[q]["retrieval_passes"] == 0
        assert got[q]["tokens"] == {}
    assert got[2]["retrieval_passes"] == 1 and got[2]["iterations"] == 0 and got[2]["n_matches"] == 3


def test_loop_ends_and_stays_in_scope(frame, world):
    got = run(frame, world, Hostile, multi_step=True)
    row = got[2]
    assert (row["route"], row["iterations"], row["retrieval_passes"]) == ("multi_step", 4, 4)
    assert row["steps"] == ["Secret settlement."] * 3
    assert not any("Secret" in t for t in row["contexts"])
    assert row["n_passages"] == 3 and row["duplicate_passages_avoided"] > 0
    # One routing call and three reasoning calls, and the answer's own tokens.
    assert row["tokens"]["input"] >= 31


def test_scripted_loop_counts(frame, world):
    got = run(frame, world, lambda: answering.ScriptedProvider(1), multi_step=True)
    assert (got[2]["iterations"], got[2]["retrieval_passes"], len(got[2]["steps"])) == (2, 2, 1)


def test_model_failure_is_a_row(frame, world):
    got = run(frame, world, Broken)
    assert got[2]["why"] == "model error" and got[2]["model_error"] == "TimeoutError: no reply" and not got[2]["answered"]


class Logged(answering.ScriptedProvider):
    """Notes every call in a file; is away at the given end of a prompt."""

    def __init__(self, path, away):
        super().__init__(1)
        self.path, self.away = path, away

    def generate(self, prompt):
        stage = next((s for s in ("Classification:", "Decision:") if prompt.endswith(s)), "Answer")
        with open(self.path, "a") as log:
            log.write(stage + "\n")
        if stage == self.away:
            raise TimeoutError("no reply")
        reply, _ = super().generate(prompt)
        return reply, {"input": 1}


@pytest.mark.parametrize("away, calls, retrievals", [
    ("Classification:", {"Classification:": 2}, 0), ("Decision:", {"Classification:": 2, "Decision:": 2}, 1),
    ("Answer", {"Classification:": 2, "Decision:": 4, "Answer": 2}, 2), ("none", {"Classification:": 2, "Decision:": 4, "Answer": 2}, 2)])
def test_a_failed_question_leaves_the_loop(frame, world, tmp_path, away, calls, retrievals):
    log = tmp_path / "calls"
    got = run(frame, world, lambda: Logged(str(log), away), multi_step=True)
    assert dict(Counter(log.read_text().split())) == calls
    for q in (1, 2):
        row = got[q]
        assert row["retrieval_passes"] == retrievals and row["latency_ms"] is not None and row["latency_ms"] >= 0
        if away == "none":
            assert row["answered"] and row["why"] is None and row["model_error"] is None and row["tokens"]["input"] == 4
        else:
            assert (row["why"], row["model_error"], row["answered"], row["answer"]) == ("model error", "TimeoutError: no reply", False, None)
    assert got[3]["why"] == "no authorized cases" and got[3]["latency_ms"] == 0


class AwayEmbedder(HashProvider):
    def embed(self, texts):
        raise ConnectionError("no vectors")


class CountedEmbedder(HashProvider):
    def embed_counted(self, texts):
        return self.embed(texts), [{"embedding": len(t.split())} for t in texts]


def test_a_failed_embedding_is_an_outage(frame, world):
    models = ask.Models(lambda: AwayEmbedder(WIDTH), CountingWriter, WIDTH)
    got = {r["query_id"]: r for r in ask.ask_batch(frame(QUESTIONS, "query_id bigint, user_id bigint, question string"), *world, models).collect()}
    assert (got[2]["why"], got[2]["model_error"], got[2]["retrieval_passes"]) == ("model error", "ConnectionError: no vectors", 0)


def test_embedding_tokens_count(frame, world):
    models = ask.Models(lambda: CountedEmbedder(WIDTH), CountingWriter, WIDTH)
    got = {r["query_id"]: r for r in ask.ask_batch(frame(QUESTIONS, "query_id bigint, user_id bigint, question string"), *world, models).collect()}
    assert got[2]["tokens"]["embedding"] == 6 and got[2]["tokens"]["input"] > 0


def test_public_answer_hides_the_reason(frame, world):
    models = ask.Models(lambda: HashProvider(WIDTH), CountingWriter, WIDTH)
    asks = ask.ask_batch(frame(QUESTIONS, "query_id bigint, user_id bigint, question string"), *world, models)
    assert ask.answers(asks).columns == ["query_id", "answer", "citations"]
    assert "why" in ask.run_ledger(asks).columns


def test_texts_are_not_kept_between_passes(frame, world, monkeypatch):
    """What is written between the passes holds places of chunks, no texts; prompts are not written either."""
    kept = []
    monkeypatch.setattr(ask, "materialise", lambda df, real=ask.materialise: kept.append(set(df.columns)) or real(df))
    got = run(frame, world, lambda: answering.ScriptedProvider(1), multi_step=True)
    assert len(kept) > 8 and not any({"prompt", "contexts", "found"} & columns for columns in kept)
    assert not any("text" in columns and {"passage", "match_rank"} & columns for columns in kept)
    assert got[1]["n_passages"] == len(got[1]["contexts"]) and len(got[1]["match_texts"]) == got[1]["n_matches"] == 8
    assert sorted(got[2]["contexts"]) == sorted(t for *_, t in TEXTS[:3])
    assert got[3]["contexts"] == got[3]["match_texts"] == []


def test_texts_nobody_asks_for_are_not_listed(frame, world):
    models = ask.Models(lambda: HashProvider(WIDTH), answering.ExtractiveProvider, WIDTH)
    found = ask.ask_batch(frame(QUESTIONS, "query_id bigint, user_id bigint, question string"), *world, models)
    listed = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("text#")
    assert listed(found.select("query_id", "n_matches", "citations")) < listed(found)


def test_numbered_lines_of_texts_are_not_steps():
    scripted = answering.ScriptedProvider(1)
    head = "How.\n\nOriginal question: 1. What?\n2. When?\n\n"
    assert scripted.generate(f"{head}Retrieved so far:\n- a\n1. b\n2. c\n\nDecision:")[0] == "CONTINUE\n1. What? 1"
    assert scripted.generate(f"{head}Nothing retrieved yet.\n\nDecision:")[0] == "CONTINUE\n1. What? 1"
    assert scripted.generate(f"{head}Reasoning so far:\n1. x\n\nRetrieved so far:\n- a\n\nDecision:")[0] == "DONE"


class Echo(answering.ExtractiveProvider):
    def generate(self, prompt):
        return prompt, {"input": 1}


def test_prompts_are_made_in_the_task(frame):
    """The same prompts as those of the columns, whatever the order the pieces come in; no list of texts on the way."""
    found = {1: ["a", "b 1.\nc"], 2: [], 3: [f"text {i}" for i in range(40)]}
    heads = frame([(q, f"Q{q}", ["s"] * (q - 1)) for q in found], "query_id bigint, question string, steps array<string>")
    pieces = frame([(q, i, t) for q, ts in found.items() for i, t in reversed(list(enumerate(ts)))], "query_id bigint, at int, text string")
    whole = heads.join(pieces.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"])
                                                      .alias("texts")), "query_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))
    reasoned = answering.generate_in_order(
        heads.select("query_id", replies.reason_head(F.col("question"), F.col("steps")).alias("before"), F.lit(replies.REASON_TAIL).alias("after")),
        pieces.select("query_id", "at", replies.found_piece(F.col("text")).alias("piece")), Echo, replies.REASON_FOUND, replies.REASON_NOTHING)
    assert reasoned.columns == ["query_id", "reply", "usage", "error", "ms"]
    assert "ObjectHashAggregate" not in reasoned._jdf.queryExecution().executedPlan().toString()
    want = whole.select("query_id", replies.reason_prompt(F.col("question"), F.col("steps"), F.col("texts")))
    assert {r[0]: r[1] for r in reasoned.collect()} == {r[0]: r[1] for r in want.collect()}
    answered = answering.generate_in_order(
        heads.where("query_id <> 2").select("query_id", F.lit(replies.ANSWER_HEAD).alias("before"), replies.answer_tail(F.col("question")).alias("after")),
        pieces.select("query_id", "at", replies.passage_piece(F.col("at") + 1, F.col("text")).alias("piece")), Echo)
    want = whole.where("query_id <> 2").select("query_id", replies.answer_prompt(F.col("question"), F.col("texts")))
    assert {r[0]: r[1] for r in answered.collect()} == {r[0]: r[1] for r in want.collect()}
    assert [r["reply"] for r in answering.generate_in_order(heads.select("query_id", F.lit("x").alias("before"), F.lit("y").alias("after")),
                                                            pieces.withColumnRenamed("text", "piece"), Broken).collect()] == [None] * 3


def test_many_questions_have_the_texts_judged_once(frame, world, monkeypatch):
    judged = []
    few = run(frame, world, lambda: answering.ScriptedProvider(2), multi_step=True)
    monkeypatch.setattr(retrieval, "looks_cut_off", lambda text, real=retrieval.looks_cut_off: judged.append(1) or real(text))
    monkeypatch.setattr(ask, "MAX_SENT", 1)
    many = run(frame, world, lambda: answering.ScriptedProvider(2), multi_step=True)
    assert len(judged) == 1
    for q in few:
        a, b = few[q].asDict(), many[q].asDict()
        assert {k: v for k, v in a.items() if k != "latency_ms"} == {k: v for k, v in b.items() if k != "latency_ms"}
