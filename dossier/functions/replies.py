"""Prompts, and the checking of model replies, as Column expressions."""

from __future__ import annotations

from unicodedata import category, digit

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import LINE_BREAK, strip
from dossier.schemas import CITATION, CONTINUE, DONE, MULTI_STEP, NOT_FOUND, SINGLE_SHOT

# Wording of the instruction sheets; the tokens and the layout below are what replies and
# citations depend on.
ANSWER_INSTRUCTIONS = (
    "Use nothing but the numbered passages to answer.\n"
    "Cite the passage behind every claim by its number in square brackets, e.g. [2], and cite "
    "no number that is not listed.\n"
    f"When the passages do not hold the answer, write {NOT_FOUND} and nothing more.\n"
    "Write in the language of the question, three sentences at most.\n"
)
ROUTE_INSTRUCTIONS = (
    "Decide how many searches this question takes.\n"
    f"{SINGLE_SHOT}: one search finds everything asked for, even if that is several facts.\n"
    f"{MULTI_STEP}: several searches are needed, or one result decides the next search.\n"
    f"In doubt choose {SINGLE_SHOT}. Write only the category.\n"
)
REASON_INSTRUCTIONS = (
    "A question is being worked on in several searches. Say whether one more is needed.\n"
    f"First line: {CONTINUE} or {DONE}, alone.\n"
    f"After {CONTINUE}, the second line holds the next thing to search for, one specific lookup.\n"
    "Do not write the answer.\n"
)


ANSWER_HEAD = f"{ANSWER_INSTRUCTIONS}\nPassages:\n"


def passage_piece(number: Column, text: Column) -> Column:
    """A passage as it stands in the answer prompt."""
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), text, F.lit("\n\n"))


def answer_tail(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nAnswer:"))


def answer_prompt(question: Column, passages: Column) -> Column:
    """Passages numbered from 1, then the question; null when there is nothing to read."""
    numbered = F.array_join(F.transform(passages, lambda text, i: passage_piece(i + 1, text)), "")
    return F.when(F.size(passages) > 0, F.concat(F.lit(ANSWER_HEAD), numbered, answer_tail(question)))


def route_prompt(question: Column) -> Column:
    return F.concat(F.lit(f"{ROUTE_INSTRUCTIONS}\nQuestion: "), question,
                    F.lit("\n\nClassification:"))


# What stands before and after the texts found so far, and what stands instead of them.
REASON_FOUND = ("Retrieved so far:\n", "\n")
REASON_NOTHING = "Nothing retrieved yet.\n\n"
REASON_TAIL = "Decision:"


def reason_head(question: Column, steps: Column) -> Column:
    """The question and earlier steps numbered."""
    numbered = F.transform(
        steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s, F.lit("\n"))
    )
    return F.concat(
        F.lit(f"{REASON_INSTRUCTIONS}\nOriginal question: "), question, F.lit("\n\n"),
        F.when(F.size(steps) > 0, F.concat(
            F.lit("Reasoning so far:\n"), F.array_join(numbered, ""), F.lit("\n")
        )).otherwise(F.lit("")),
    )


def found_piece(text: Column) -> Column:
    """A text found so far as it stands in the reasoning prompt."""
    return F.concat(F.lit("- "), text, F.lit("\n"))


def reason_prompt(question: Column, steps: Column, found: Column) -> Column:
    """Earlier steps numbered, texts found so far as a list, or a line saying there are none."""
    return F.concat(
        reason_head(question, steps),
        F.when(F.size(found) > 0, F.concat(
            F.lit(REASON_FOUND[0]), F.array_join(F.transform(found, found_piece), ""), F.lit(REASON_FOUND[1])
        )).otherwise(F.lit(REASON_NOTHING)),
        F.lit(REASON_TAIL),
    )


def parse_route(reply: Column, multi_step: bool = True) -> Column:
    """struct(route, unexpected): only the exact multi-step token leads to several searches."""
    if not multi_step:
        return F.struct(F.lit("single_shot").alias("route"), F.lit(False).alias("unexpected"))
    token = F.upper(strip(F.coalesce(reply, F.lit(""))))
    return F.struct(
        F.when(token == MULTI_STEP, F.lit("multi_step")).otherwise(F.lit("single_shot"))
        .alias("route"),
        (~token.isin(MULTI_STEP, SINGLE_SHOT)).alias("unexpected"),
    )


def parse_reason(reply: Column, question: Column) -> Column:
    """struct(should_continue, sub_question, unexpected) of one reasoning reply."""
    lines = F.split(strip(F.coalesce(reply, F.lit(""))), LINE_BREAK)
    decision = F.upper(strip(F.element_at(lines, 1)))
    goes_on = decision == CONTINUE
    second = F.when(F.size(lines) > 1, strip(F.try_element_at(lines, F.lit(2)))).otherwise(question)
    return F.struct(
        goes_on.alias("should_continue"),
        F.when(goes_on, second).alias("sub_question"),
        (~decision.isin(CONTINUE, DONE)).alias("unexpected"),
    )


_DIGITS = "".join(c for c in map(chr, range(0x80, 0x20000)) if category(c) == "Nd")
_AS_ASCII = "".join(str(digit(c)) for c in _DIGITS)


def cited_numbers(reply: Column) -> Column:
    """Bracketed numbers in order; digits of any script; null for one too long to be a number."""
    found = F.regexp_extract_all(reply, F.lit(f"(?U){CITATION}"), F.lit(1))
    return F.transform(
        found, lambda n: F.translate(n, _DIGITS, _AS_ASCII).try_cast("bigint")
    )


def check_reply(reply: Column, n_passages: Column) -> Column:
    """struct(answered, rule, text, numbers): which rule settled the reply."""
    text = strip(F.coalesce(reply, F.lit("")))
    numbers = cited_numbers(text)
    outside = F.exists(numbers, lambda n: n.isNull() | (n < 1) | (n > n_passages))
    rule = (
        F.when(n_passages < 1, F.lit("no passages"))
        .when(text == "", F.lit("empty"))
        .when(text == NOT_FOUND, F.lit("not found"))
        .when(outside, F.lit("out of range"))
        .when(F.size(numbers) == 0, F.lit("no citation"))
        .otherwise(F.lit("answered"))
    )
    answered = rule == "answered"
    return F.struct(
        answered.alias("answered"),
        rule.alias("rule"),
        F.when(answered, text).alias("text"),
        F.when(answered, numbers).alias("numbers"),
    )


def resolve_citations(numbers: Column, places: Column) -> Column:
    """Places behind the cited passage numbers, each once, in the order of first use."""
    return F.array_distinct(F.transform(numbers, lambda n: F.element_at(places, n.cast("int"))))


def usage_from_payload(payload: Column, with_output: bool = True) -> Column:
    """Token counts of a response under their short names; whatever is not an integer is left out."""
    names = [("input", "prompt_tokens"), ("output", "completion_tokens"), ("total", "total_tokens")]
    if not with_output:
        names = [pair for pair in names if pair[0] != "output"]
    usage = F.try_parse_json(payload)
    entries = F.array(*[
        F.struct(
            F.lit(short).alias("key"),
            F.when(
                F.schema_of_variant(F.try_variant_get(usage, f"$.usage.{long}", "variant"))
                == "BIGINT",
                F.try_variant_get(usage, f"$.usage.{long}", "bigint"),
            ).alias("value"),
        )
        for short, long in names
    ])
    return F.map_from_entries(F.filter(entries, lambda e: e.getField("value").isNotNull()))
