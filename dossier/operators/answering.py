"""Prompts, replies and citations for tables of questions."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.replies import answer_prompt, check_reply, resolve_citations
from dossier.functions.rows import parts_of
from dossier.operators.embedding import CALL_COLUMNS
from dossier.schemas import CONTINUE, DONE, MULTI_STEP, NOT_FOUND, SINGLE_SHOT


class TextProvider(Protocol):
    """Takes a prompt; returns (reply, token counts) or raises."""

    def generate(self, prompt: str) -> tuple[str, dict[str, int]]: ...


class ExtractiveProvider:
    """Offline provider: repeats the first sentence of passage 1 and cites it.

    Classification prompts get the single-search token and reasoning prompts the stop token.
    """

    def generate(self, prompt: str) -> tuple[str, dict[str, int]]:
        if prompt.endswith("Classification:"):
            reply = SINGLE_SHOT
        elif prompt.endswith("Decision:"):
            reply = DONE
        else:
            first = re.search(r"^\[1\] (.*?)(?:(?<=[.?!؟])\s|\n|\Z)", prompt, re.S | re.M)
            reply = f"{first.group(1).strip()} [1]" if first and first.group(1).strip() else NOT_FOUND
        counts = {"input": len(prompt.split()), "output": len(reply.split())}
        return reply, {**counts, "total": sum(counts.values())}


class ScriptedProvider(ExtractiveProvider):
    """Offline provider for the loop: asks for `passes` further searches, then stops."""

    def __init__(self, passes: int = 1) -> None:
        self.passes = passes

    def generate(self, prompt: str) -> tuple[str, dict[str, int]]:
        if prompt.endswith("Classification:"):
            return MULTI_STEP, {}
        if prompt.endswith("Decision:"):
            # Neither the texts found nor the question are steps, whatever their lines begin with.
            before = re.split(r"\n(?:Retrieved so far:|Nothing retrieved yet\.)\n", prompt, maxsplit=1)[0]
            steps = len(re.findall(r"^\d+\. ", before.partition("\nReasoning so far:\n")[2], re.M))
            if steps < self.passes:
                question = prompt.split("Original question: ")[1].split("\n")[0]
                return f"{CONTINUE}\n{question} {steps + 1}", {}
            return DONE, {}
        return super().generate(prompt)


_CALL = pa.schema([("usage", pa.map_(pa.string(), pa.int64())), ("error", pa.string()), ("ms", pa.float64())])


def _call(model: TextProvider, prompt: str) -> tuple[str | None, list, str | None, float]:
    """Reply, usage, error and milliseconds."""
    begun = time.perf_counter()
    try:
        answer, counts = model.generate(prompt)
        error = None
    except Exception as exc:  # noqa: BLE001 - any provider failure becomes a row
        answer, counts, error = None, {}, f"{type(exc).__name__}: {exc}"
    return answer, list(counts.items()), error, (time.perf_counter() - begun) * 1000


def _call_columns(called: list[tuple]) -> list[pa.Array]:
    replies, *rest = zip(*called) if called else ([], [], [], [])
    return [pa.array(replies, pa.string()), *[pa.array(values, field.type) for values, field in zip(rest, _CALL)]]


def generate(df: DataFrame, provider: Callable[[], TextProvider], prompt: str = "prompt",
             reply: str = "reply") -> DataFrame:
    """Rows with reply, usage, error and milliseconds; a failed call is a row with an error, not a failed job."""
    schema = T.StructType([*df.schema.fields, T.StructField(reply, T.StringType()), *CALL_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            called = []
            for text in batch.column(batch.schema.get_field_index(prompt)).to_pylist():
                model = model or provider()
                called.append(_call(model, text))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_call_columns(called)], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


_LAST = 2 ** 63 - 1


def generate_in_order(heads: DataFrame, pieces: DataFrame, provider: Callable[[], TextProvider],
                      around: tuple[str, str] = ("", ""), nothing: str = "") -> DataFrame:
    """query_id, reply, usage, error and ms of prompts that hold many texts.

    heads: query_id, before, after. pieces: query_id, at (from 0), piece; only of questions that have a head. Heads and pieces are
    dealt to tasks by question, in order, and become a prompt there: no list of texts is built, sorted or
    copied on the way, and none comes back. `around` stands about the pieces, `nothing` instead of them.
    """
    ends = F.array(F.struct(F.lit(-1).cast("bigint").alias("at"), F.col("before").alias("piece")),
                   F.struct(F.lit(_LAST).alias("at"), F.col("after").alias("piece")))
    rows = heads.select("query_id", F.inline(ends)).unionByName(
        pieces.select("query_id", F.col("at").cast("bigint").alias("at"), "piece"))
    in_order = rows.repartition("query_id").sortWithinPartitions("query_id", "at")
    schema = T.StructType([heads.schema["query_id"], T.StructField("reply", T.StringType()), *CALL_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = None, []
        for batch in batches:
            ids, called = [], []
            for at, n in parts_of(batch.column("piece")):
                part = batch.slice(at, n)
                for question, place, piece in zip(*[part.column(c).to_pylist() for c in ("query_id", "at", "piece")]):
                    if place < 0:
                        held, some = [piece], False
                    elif place < _LAST:
                        held += [piece] if some else [around[0], piece]
                        some = True
                    else:
                        model = model or provider()
                        held += [around[1] if some else nothing, piece]
                        ids.append(question)
                        called.append(_call(model, "".join(p for p in held if p is not None)))
                        held = []
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("query_id").type), *_call_columns(called)], names=schema.fieldNames())

    return in_order.mapInArrow(run, schema)


def answer_prompts(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """One prompt per question that has passages; passage count and places come along.

    A question has a bounded number of passages, so its list is short.
    """
    listed = passages.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("passage", "text", "document_id", "page_number")))
        .alias("_p")
    )
    return questions.join(listed, "query_id").select(
        *[F.col(c) for c in questions.columns],
        F.size("_p").alias("n_passages"),
        F.transform("_p", lambda p: F.struct(p["document_id"].alias("document_id"),
                                             p["page_number"].alias("page_number"))).alias("places"),
        F.transform("_p", lambda p: p["text"]).alias("contexts"),
        answer_prompt(F.col("question"), F.transform("_p", lambda p: p["text"])).alias("prompt"),
    )


def check_replies(replies: DataFrame) -> DataFrame:
    """Replies (reply, n_passages) with answered, rule, text and numbers."""
    checked = check_reply(F.col("reply"), F.col("n_passages"))
    return replies.withColumn("_c", checked).select(
        *[F.col(c) for c in replies.columns], "_c.answered", "_c.rule", "_c.text", "_c.numbers")


def citations_of(replies: DataFrame) -> DataFrame:
    """One row per place cited by an answered reply, in order of first use."""
    places = resolve_citations(F.col("numbers"), F.col("places"))
    return replies.where("answered").select(
        "query_id", F.posexplode(places).alias("position", "_p")
    ).select("query_id", "position", "_p.document_id", "_p.page_number")
