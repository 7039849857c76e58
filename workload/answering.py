"""Prompts, replies, citations, and the whole answering flow."""

import re

from pyspark.sql import functions as F

from dossier.functions import replies
from dossier.functions.replies import ANSWER_INSTRUCTIONS, REASON_INSTRUCTIONS, ROUTE_INSTRUCTIONS
from dossier.operators import answering
from dossier.operators.embedding import HashProvider
from dossier.plans import ask
from workload.base import (
    CHUNKS, CONTEXT, PASSAGES, SCOPES, USERS, chunks, kept_chunks, passages, query, scope_assignments, table, users,
)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("f1_answer_prompt", f"""
WITH {PASSAGES},
listed AS (SELECT query_id, count(*)::INT AS n_passages, string_agg('[' || passage || '] ' || text, E'\\n\\n' ORDER BY passage) AS numbered FROM passages GROUP BY query_id)
SELECT query_id, n_passages, md5({_sql_text(ANSWER_INSTRUCTIONS)} || E'\\nPassages:\\n' || numbered || E'\\n\\nQuestion: ' || 'question ' || query_id || E'\\n\\nAnswer:') AS prompt_md5
FROM listed""")
def answer_prompt(spark, sf):
    asked = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.concat(F.lit("question "), F.col("vec_id").cast("string")).alias("question"))
    found = answering.answer_prompts(asked, passages(spark, sf))
    return found.select("query_id", "n_passages", F.md5("prompt").alias("prompt_md5"))


@query("f2_route_prompt", f"""
SELECT conv_id, turn, md5({_sql_text(ROUTE_INSTRUCTIONS)} || E'\\nQuestion: ' || text || E'\\n\\nClassification:') AS prompt_md5 FROM conversations""")
def route_prompt(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(replies.route_prompt(F.col("text"))).alias("prompt_md5"))


@query("f3_reason_prompt", f"""
WITH made AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN []::VARCHAR[] ELSE string_split(text, E'\\n') END AS steps,
  CASE WHEN turn = 0 THEN []::VARCHAR[] ELSE [role, text] END AS found FROM conversations)
SELECT conv_id, turn, md5({_sql_text(REASON_INSTRUCTIONS)} || E'\\nOriginal question: ' || text || E'\\n\\n'
  || CASE WHEN len(steps) > 0 THEN E'Reasoning so far:\\n' || array_to_string(list_transform(steps, lambda s, i: i || '. ' || s || E'\\n'), '') || E'\\n' ELSE '' END
  || CASE WHEN len(found) > 0 THEN E'Retrieved so far:\\n' || array_to_string(list_transform(found, lambda t: '- ' || t || E'\\n'), '') || E'\\n' ELSE E'Nothing retrieved yet.\\n\\n' END
  || 'Decision:') AS prompt_md5 FROM made""")
def reason_prompt(spark, sf):
    none = F.array().cast("array<string>")
    steps = F.when(F.col("turn") % 2 == 0, none).otherwise(F.split("text", "\n"))
    found = F.when(F.col("turn") == 0, none).otherwise(F.array("role", "text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(replies.reason_prompt(F.col("text"), steps, found)).alias("prompt_md5"))


@query("f4_generate", r"""
WITH firsts AS (SELECT conv_id, turn, regexp_extract(text, '(?s)^(.*?)([.?!]\s|\n|$)', 0) AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN trim(s, E' \n') = '' THEN 'NOT_FOUND' ELSE trim(s, E' \n') || ' [1]' END AS reply, '' AS error FROM firsts""")
def generate(spark, sf):
    """The offline writer repeats the first sentence of passage 1."""
    asked = table(spark, sf, "conversations").select(
        "conv_id", "turn", replies.answer_prompt(F.lit("what is said"), F.array("text")).alias("prompt"))
    return answering.generate(asked, answering.ExtractiveProvider).select(
        "conv_id", "turn", "reply", F.coalesce("error", F.lit("")).alias("error"))


@query("f5_parse_route", """
WITH said AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '  multi_step ' WHEN 1 THEN 'SINGLE_SHOT' WHEN 2 THEN 'MULTI_STEP because ' || text ELSE text END AS reply FROM conversations)
SELECT conv_id, turn, CASE WHEN upper(trim(reply)) = 'MULTI_STEP' THEN 'multi_step' ELSE 'single_shot' END AS route,
  upper(trim(reply)) NOT IN ('MULTI_STEP', 'SINGLE_SHOT') AS unexpected FROM said""")
def parse_route(spark, sf):
    turn = F.col("turn") % 4
    reply = (F.when(turn == 0, "  multi_step ").when(turn == 1, "SINGLE_SHOT")
             .when(turn == 2, F.concat(F.lit("MULTI_STEP because "), "text")).otherwise(F.col("text")))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", replies.parse_route(reply).alias("r")).select("conv_id", "turn", "r.*")


@query("f6_parse_reason", r"""
WITH said AS (SELECT conv_id, turn, text, trim(CASE turn % 4 WHEN 0 THEN E'Continue \n' || text WHEN 1 THEN 'DONE' WHEN 2 THEN ' continue' ELSE text END, E' \n') AS reply FROM conversations),
cut AS (SELECT *, upper(trim(string_split(reply, E'\n')[1])) AS decision FROM said)
SELECT conv_id, turn, decision = 'CONTINUE' AS should_continue,
  CASE WHEN decision <> 'CONTINUE' THEN '' WHEN len(string_split(reply, E'\n')) > 1 THEN trim(string_split(reply, E'\n')[2]) ELSE text END AS sub_question,
  decision NOT IN ('CONTINUE', 'DONE') AS unexpected FROM cut""")
def parse_reason(spark, sf):
    turn = F.col("turn") % 4
    reply = (F.when(turn == 0, F.concat(F.lit("Continue \n"), "text")).when(turn == 1, "DONE")
             .when(turn == 2, " continue").otherwise(F.col("text")))
    found = table(spark, sf, "conversations").select(
        "conv_id", "turn", replies.parse_reason(reply, F.col("text")).alias("r"))
    return found.select("conv_id", "turn", "r.should_continue",
                        F.coalesce("r.sub_question", F.lit("")).alias("sub_question"), "r.unexpected")


def _replies(spark, sf):
    """Replies with all kinds of citations; as many passages as the conversation's number says."""
    turn, text = F.col("turn") % 8, F.col("text")
    marked = lambda *parts: F.concat(text, *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    reply = (
        F.when(turn == 0, marked(" [1] and again [1]", " [2]"))
        .when(turn == 1, marked(" [", F.col("conv_id").cast("string"), "]"))
        .when(turn == 2, "NOT_FOUND").when(turn == 3, text).when(turn == 4, marked(" [0]"))
        .when(turn == 5, "  \n").when(turn == 6, marked(" [3][2][1][2]"))
        .otherwise(marked(" [99999999999999999999]"))
    )
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", reply.alias("reply"), (F.col("conv_id") % 5).cast("int").alias("n_passages"))


_SAID = r"""said AS (SELECT conv_id, turn, (conv_id % 5)::INT AS n_passages, trim(CASE turn % 8 WHEN 0 THEN text || ' [1] and again [1] [2]'
    WHEN 1 THEN text || ' [' || conv_id || ']' WHEN 2 THEN 'NOT_FOUND' WHEN 3 THEN text WHEN 4 THEN text || ' [0]' WHEN 5 THEN E'  \n'
    WHEN 6 THEN text || ' [3][2][1][2]' ELSE text || ' [99999999999999999999]' END, E' \n') AS reply FROM conversations),
cited AS (SELECT *, list_transform(regexp_extract_all(reply, '\[(\d+)\]', 1), lambda n: try_cast(n AS BIGINT)) AS numbers FROM said),
judged AS (SELECT *, CASE WHEN n_passages < 1 THEN 'no passages' WHEN reply = '' THEN 'empty' WHEN reply = 'NOT_FOUND' THEN 'not found'
  WHEN len(list_filter(numbers, lambda n: n IS NULL OR n < 1 OR n > n_passages)) > 0 THEN 'out of range'
  WHEN len(numbers) = 0 THEN 'no citation' ELSE 'answered' END AS rule FROM cited)"""


@query("f8_check_reply", f"""
WITH {_SAID} SELECT conv_id, turn, rule = 'answered' AS answered, rule, CASE WHEN rule = 'answered' THEN md5(reply) ELSE '' END AS text_md5,
  CASE WHEN rule = 'answered' THEN array_to_string(numbers, ',') ELSE '' END AS numbers FROM judged""")
def check_reply(spark, sf):
    checked = answering.check_replies(_replies(spark, sf))
    return checked.select(
        "conv_id", "turn", "answered", "rule", F.coalesce(F.md5("text"), F.lit("")).alias("text_md5"),
        F.coalesce(F.array_join(F.col("numbers").cast("array<string>"), ","), F.lit("")).alias("numbers"))


# Passage n lies on page n div 2 of document 10 * conv_id, so passages 2 and 3 share a place.
@query("f9_resolve_citations", f"""
WITH {_SAID}, places AS (SELECT conv_id, turn, n, pos FROM (SELECT conv_id, turn, unnest(numbers) AS n, unnest(range(len(numbers))) AS pos FROM judged WHERE rule = 'answered')),
firsts AS (SELECT conv_id, turn, conv_id * 10 AS document_id, n // 2 AS page_number, min(pos) AS pos FROM places GROUP BY ALL)
SELECT conv_id * 100 + turn AS query_id, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1)::INT AS position, document_id, page_number::INT AS page_number FROM firsts""")
def resolve_citations(spark, sf):
    places = F.transform(
        F.sequence(F.lit(1), F.greatest("n_passages", F.lit(1))),
        lambda n: F.struct((F.col("conv_id") * 10).alias("document_id"), F.floor(n / 2).cast("int").alias("page_number")))
    checked = answering.check_replies(_replies(spark, sf)).withColumn("places", places).withColumn(
        "query_id", F.col("conv_id") * 100 + F.col("turn"))
    return answering.citations_of(checked)


# --- the whole flow -----------------------------------------------------------------------

MODELS = ask.Models(lambda: HashProvider(64), answering.ExtractiveProvider, 64)


def asked(spark, sf):
    """Every turn of a user is a question; the conversation's number is the user."""
    return table(spark, sf, "conversations").where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.col("conv_id").alias("user_id"), F.col("text").alias("question"))


def file_names(spark, sf):
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("document_id"),
        F.concat(F.lit("file_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))


def asks(spark, sf, models=MODELS, multi_step=False):
    return ask.ask_batch(asked(spark, sf), users(spark, sf), scope_assignments(spark, sf),
                         (kept_chunks if multi_step else chunks)(spark, sf), file_names(spark, sf), models, multi_step=multi_step)


@query("f7_retrieve_reason_loop", f"""
WITH {USERS}, {SCOPES},
mine AS (SELECT user_id, count(*) AS n FROM scope_edges GROUP BY user_id)
SELECT conv_id * 1000 + turn AS query_id, 'multi_step' AS route, 2::INT AS n_steps, 3::INT AS iterations, 3::INT AS retrievals, true AS within_scope
FROM conversations JOIN scopes ON user_id = conv_id LEFT JOIN mine USING (user_id) WHERE conversations.role = 'user' AND (all_cases OR n > 0)""")
def loop(spark, sf):
    """Two further searches asked for; every row found lies within the asker's cases."""
    from dossier.operators.access import resolve_scope

    models = ask.Models(lambda: HashProvider(64), lambda: answering.ScriptedProvider(2), 64)
    scopes = ask.scopes_of(asked(spark, sf), resolve_scope(users(spark, sf), scope_assignments(spark, sf)))
    questions = asked(spark, sf).join(scopes.users.where("all_cases OR n_cases > 0").select("user_id"), "user_id")
    found = ask.retrieve_reason_loop(questions, scopes, kept_chunks(spark, sf), models, multi_step=True)
    state = found.state
    outside = (
        found.context.join(state.select("query_id", "user_id"), "query_id")
        .join(scopes.users.select("user_id", "all_cases"), "user_id").where("NOT all_cases")
        .join(scopes.edges, ["user_id", "case_id"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("n")))
    return state.join(outside, "query_id", "left").select(
        "query_id", "route", F.size("steps").alias("n_steps"), "iterations", "retrievals",
        F.col("n").isNull().alias("within_scope"))


def asked_sql(asked: str) -> str:
    """Common tables of the whole flow for a table `asked` (query_id, user_id, question, all_cases)."""
    return f"""
hashed AS (SELECT *, list_transform(range(64), lambda i: ('0x' || substr(sha256('0:' || question) || sha256('1:' || question), i * 2 + 1, 2))::INT / 255.0::DOUBLE - 0.5) AS v FROM {asked}),
unit AS (SELECT query_id, user_id, question, all_cases, list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE) AS embedding FROM hashed),
pairs AS (SELECT query_id, chunk_id, c.case_id, document_id, sequence, round(1 - list_dot_product(q.embedding, c.embedding)
    / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(c.embedding, c.embedding))), 12) AS distance
  FROM unit q JOIN chunks c ON q.all_cases OR EXISTS (SELECT 1 FROM scope_edges e WHERE e.user_id = q.user_id AND e.case_id = c.case_id)),
matches AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS match_rank FROM pairs QUALIFY match_rank <= 5),
""" + CONTEXT.split("QUALIFY match_rank <= 5),")[1] + PASSAGES[len(CONTEXT):] + r""",
replies AS (SELECT query_id, CASE WHEN trim(s, E' \n') = '' THEN 'NOT_FOUND' ELSE trim(s, E' \n') || ' [1]' END AS reply
  FROM (SELECT query_id, regexp_extract(text, '(?s)^(.*?)([.?!]\s|\n|$)', 0) AS s FROM passages WHERE passage = 1)),
counts AS (SELECT query_id, count(*) AS n FROM passages GROUP BY 1),
cited AS (SELECT query_id, reply, n, list_transform(regexp_extract_all(reply, '\[(\d+)\]', 1), lambda x: try_cast(x AS BIGINT)) AS numbers FROM replies JOIN counts USING (query_id)),
checked AS (SELECT * FROM cited WHERE reply <> 'NOT_FOUND' AND len(numbers) > 0 AND len(list_filter(numbers, lambda x: x IS NULL OR x < 1 OR x > n)) = 0)"""


def two_passes_sql(asked: str) -> str:
    """The flow for a reader who asks for one further search, on the first line of the question and a number."""
    return f"""
both_asked AS (SELECT query_id * 10 + pass AS query_id, user_id, CASE pass WHEN 0 THEN question ELSE trim(string_split(question, chr(10))[1]) || ' 1' END AS question, all_cases
  FROM {asked}, (VALUES (0), (1)) p(pass)),
""" + asked_sql("both_asked").replace(PASSAGES[len(CONTEXT):], """,
of_both AS (SELECT query_id // 10 AS query_id, query_id % 10 AS pass, * EXCLUDE (query_id) FROM context),
passages AS (SELECT * EXCLUDE (first), row_number() OVER (PARTITION BY query_id ORDER BY pass, match_rank, ctx_pos)::INT AS passage
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, sequence ORDER BY pass, match_rank, ctx_pos) AS first FROM of_both) WHERE first = 1)""")


@query("f10_ask_multi_step", f"""
WITH {USERS}, {CHUNKS}, {SCOPES}, mine AS (SELECT user_id, count(*) AS n_cases FROM scope_edges GROUP BY user_id),
asked AS (SELECT conv_id * 1000 + turn AS query_id, conv_id AS user_id, text AS question, all_cases FROM conversations JOIN scopes ON user_id = conv_id WHERE conversations.role = 'user'),
{two_passes_sql("asked")},
placed AS (SELECT query_id, count(*) AS n_context FROM of_both GROUP BY 1)
SELECT a.query_id, coalesce(md5(k.reply), '') AS answer_md5, coalesce(c.n, 0)::INT AS n_passages, coalesce(n_context - c.n, 0) AS duplicate_passages_avoided,
  CASE WHEN all_cases OR n_cases > 0 THEN 2 ELSE 0 END::INT AS iterations, CASE WHEN all_cases OR n_cases > 0 THEN 2 ELSE 0 END::INT AS retrieval_passes
FROM asked a LEFT JOIN mine USING (user_id) LEFT JOIN checked k ON k.query_id = a.query_id LEFT JOIN counts c ON c.query_id = a.query_id LEFT JOIN placed p ON p.query_id = a.query_id""")
def ask_multi_step(spark, sf):
    """Every question leads to one further search; its passages follow those of the first."""
    models = ask.Models(lambda: HashProvider(64), lambda: answering.ScriptedProvider(1), 64)
    return asks(spark, sf, models, multi_step=True).select(
        "query_id", F.coalesce(F.md5("answer"), F.lit("")).alias("answer_md5"), "n_passages", "duplicate_passages_avoided",
        "iterations", "retrieval_passes")


class Outages(answering.ScriptedProvider):
    """A model that is away for some questions, by the length of their first line: when they are routed, reasoned on, or answered."""

    def generate(self, prompt):
        stage = next((i for i, end in enumerate(("Classification:", "Decision:")) if prompt.endswith(end)), 2)
        asked = re.findall(r"^(?:Original question|Question): ([^\n]*)", prompt, re.M)
        if asked and len(asked[-1]) % 5 == stage:
            raise ConnectionError("away")
        return super().generate(prompt)


@query("f10_ask_outage", f"""
WITH {USERS}, {SCOPES}, mine AS (SELECT user_id, count(*) AS n FROM scope_edges GROUP BY user_id),
asked AS (SELECT conv_id * 1000 + turn AS query_id, len(string_split(text, chr(10))[1]) % 5 AS fails, all_cases OR coalesce(n, 0) > 0 AS searched
  FROM conversations JOIN scopes ON user_id = conv_id LEFT JOIN mine USING (user_id) WHERE conversations.role = 'user')
SELECT query_id, CASE WHEN NOT searched THEN 'no authorized cases' WHEN fails < 3 THEN 'model error' ELSE '' END AS why, searched AND fails >= 3 AS answered,
  CASE WHEN NOT searched THEN 0 WHEN fails = 0 THEN 0 WHEN fails = 1 THEN 1 ELSE 2 END::INT AS retrieval_passes,
  CASE WHEN NOT searched OR fails = 0 THEN 0 WHEN fails = 1 THEN 1 ELSE 2 END::INT AS iterations,
  CASE WHEN searched AND fails < 3 THEN 'ConnectionError: away' ELSE '' END AS model_error, true AS timed FROM asked""")
def ask_outage(spark, sf):
    """A question for which a call fails makes no further one, and the outage is not taken for documents without an answer."""
    models = ask.Models(lambda: HashProvider(64), lambda: Outages(1), 64)
    return asks(spark, sf, models, multi_step=True).select(
        "query_id", F.coalesce("why", F.lit("")).alias("why"), "answered", "retrieval_passes", "iterations",
        F.coalesce("model_error", F.lit("")).alias("model_error"), F.col("latency_ms").isNotNull().alias("timed"))


@query("f10_ask_batch", f"""
WITH {USERS}, {CHUNKS}, {SCOPES},
asked AS (SELECT conv_id * 1000 + turn AS query_id, conv_id AS user_id, text AS question, all_cases FROM conversations JOIN scopes ON user_id = conv_id WHERE conversations.role = 'user'),
{asked_sql("asked")},
places AS (SELECT query_id, document_id, page_number, min(pos) AS pos FROM (SELECT query_id, unnest(numbers) AS passage, unnest(range(len(numbers))) AS pos FROM checked)
  JOIN passages USING (query_id, passage) GROUP BY ALL),
named AS (SELECT query_id, count(*)::INT AS n_citations, string_agg(coalesce('file_' || l.doc_id || '.pdf', 'Unknown document'), ', ' ORDER BY pos) AS documents
  FROM places p LEFT JOIN labels l ON l.doc_id = p.document_id GROUP BY 1)
SELECT query_id, coalesce(reply, '') AS answer, coalesce(n_citations, 0) AS n_citations, coalesce(documents, '') AS documents
FROM asked LEFT JOIN checked USING (query_id) LEFT JOIN named USING (query_id)""")
def ask_batch(spark, sf):
    found = ask.answers(asks(spark, sf))
    return found.select(
        "query_id", F.coalesce("answer", F.lit("")).alias("answer"),
        F.size("citations").alias("n_citations"),
        F.array_join(F.col("citations.document_name"), ", ").alias("documents"))


@query("f11_run_ledger", f"""
WITH {USERS}, {SCOPES}, mine AS (SELECT user_id, count(*) AS n FROM scope_edges GROUP BY user_id)
SELECT conv_id * 1000 + turn AS query_id, conv_id AS user_id, CASE WHEN all_cases THEN 'all cases' ELSE coalesce(n, 0) || ' case(s)' END AS scope,
  CASE WHEN all_cases OR n > 0 THEN 'single_shot' ELSE 'unrouted' END AS route, 0::INT AS iterations,
  CASE WHEN all_cases OR n > 0 THEN 1 ELSE 0 END::INT AS retrieval_passes, CASE WHEN all_cases OR n > 0 THEN 5 ELSE 0 END::BIGINT AS n_matches,
  (all_cases OR coalesce(n, 0) > 0) AS answered, CASE WHEN all_cases OR n > 0 THEN '' ELSE 'no authorized cases' END AS why
FROM conversations JOIN scopes ON user_id = conv_id LEFT JOIN mine USING (user_id) WHERE conversations.role = 'user'""")
def ledger(spark, sf):
    found = ask.run_ledger(asks(spark, sf))
    return found.select("query_id", "user_id", "scope", "route", "iterations", "retrieval_passes",
                        "n_matches", "answered", F.coalesce("why", F.lit("")).alias("why"))
