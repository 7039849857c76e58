"""Verdicts, rounds, runs and report cells."""

import re

from pyspark.sql import functions as F

from dossier.operators import evaluation
from dossier.operators.answering import ExtractiveProvider, ScriptedProvider
from dossier.operators.embedding import HashProvider
from dossier.plans.ask import Models
from dossier.plans.evaluate import eval_run
from dossier.sources import runs as runs_
from workload.answering import asked_sql, file_names, two_passes_sql
from workload.base import CHUNKS, CONTEXT, RANKED, chunks, context, query, scratch, table
from workload.sources import history

_UNIT = 2**62


def stored(sql: str) -> str:
    """`round_even(x, 3)` decided on the stored value of x, in whole numbers of 2**-62."""
    exact = (
        f"list_transform([{{}}], lambda v: list_transform([floor((abs(v) - floor(abs(v))) * {_UNIT}::DOUBLE)::HUGEINT * 1000], lambda p: "
        f"sign(v) * (floor(abs(v)) * 1000 + (p // {_UNIT})::DOUBLE + (p % {_UNIT} > {_UNIT // 2} OR (p % {_UNIT} = {_UNIT // 2} AND (p // {_UNIT}) % 2 = 1))::INT)"
        f" / 1000::DOUBLE)[1])[1]")
    return re.sub(r"round_even\((.*?), 3\)", lambda m: exact.format(m[1]), sql)


# Item: question of a vector; expected: the first word of the benchmark text with its number.
_GOLD = """gold AS (SELECT vec_id AS id, string_split(b.text, ' ')[1] AS expected FROM embeddings JOIN benchmark b
  ON item_id = vec_id % (SELECT count(*) FROM benchmark))"""


def gold(spark, sf):
    needles = table(spark, sf, "benchmark")
    n = needles.count()  # from the file footers
    items = table(spark, sf, "embeddings").withColumn("item_id", F.col("vec_id") % n)
    return items.join(needles, "item_id").select(
        F.col("vec_id").alias("id"), F.substring_index("text", " ", 1).alias("expected_section"),
        F.split("text", " ").alias("needles"))


@query("j1_context_hit", f"""
WITH {RANKED}, {_GOLD},
texts AS (SELECT query_id, string_agg(text, E'\\n' ORDER BY match_rank) AS found FROM matches JOIN chunks USING (chunk_id) GROUP BY 1)
SELECT id, coalesce(contains(found, expected), expected = '') AS context_hit FROM gold LEFT JOIN texts ON query_id = id""")
def context_hit(spark, sf):
    found = context(spark, sf).where("is_match").select(
        F.col("query_id").alias("id"), "match_rank", "text")
    return evaluation.context_hit(gold(spark, sf), found).select("id", "context_hit")


@query("j2_answer_hit", f"""
SELECT vec_id AS id, quality = 1 AND len(list_filter(string_split(b.text, ' ')[1:3], lambda w: contains(d.text, w))) > 0 AS answer_hit
FROM embeddings JOIN benchmark b ON item_id = vec_id % (SELECT count(*) FROM benchmark)
JOIN labels l ON l.doc_id = vec_id JOIN documents d ON d.doc_id = l.doc_id""")
def answer_hit(spark, sf):
    """The answer is the text of a labelled document; good quality means answered."""
    said = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("answered"), "text")
    return gold(spark, sf).join(said, "id").select("id", evaluation.answer_hit(
        F.col("answered"), F.col("text"), F.slice("needles", 1, 3)).alias("answer_hit"))


@query("j3_duplicates_avoided", f"""
WITH {CONTEXT} SELECT query_id, (count(*) - count(DISTINCT (document_id, sequence)))::BIGINT AS duplicate_passages_avoided FROM context GROUP BY 1""")
def duplicates(spark, sf):
    return evaluation.duplicates_avoided(context(spark, sf))


@query("j4_usage_tally", """
WITH spans AS (SELECT conv_id AS item, len(text) AS i, CASE WHEN role = 'assistant' THEN turn + 1 END AS o FROM conversations)
SELECT item, coalesce(sum(i), 0)::BIGINT AS input, coalesce(sum(o), 0)::BIGINT AS output FROM spans GROUP BY 1""")
def usage_tally(spark, sf):
    spans = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("item"),
        F.map_filter(F.create_map(
            F.lit("input"), F.length("text").cast("bigint"),
            F.lit("output"), F.when(F.col("role") == "assistant", F.col("turn") + 1)),
            lambda _, v: v.isNotNull()).alias("usage"))
    tally = evaluation.usage_tally(spans, ["item"])
    count = lambda k: F.coalesce(F.try_element_at("tokens", F.lit(k)), F.lit(0)).alias(k)
    return tally.select("item", count("input"), count("output"))


@query("j5_usage_from_payload", """
SELECT event_id, CASE WHEN event_type IN ('signup', 'error') THEN -1 ELSE event_id END AS input, CASE WHEN event_type = 'view' THEN user_id ELSE -1 END AS output,
  CASE WHEN event_type = 'click' THEN 7 ELSE -1 END::BIGINT AS total FROM events""")
def usage_from_payload(spark, sf):
    from dossier.functions.replies import usage_from_payload as usage

    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    payload = (
        F.when(kind == "signup", F.lit('{"choices": []}')).when(kind == "error", F.lit("no json"))
        .when(kind == "view", F.concat(F.lit('{"usage": {"prompt_tokens": '), n, F.lit(', "completion_tokens": '),
                                       F.col("user_id").cast("string"), F.lit(', "total_tokens": "12"}}')))
        .when(kind == "click", F.concat(F.lit('{"usage": {"prompt_tokens": '), n, F.lit(', "total_tokens": 7}}')))
        .otherwise(F.concat(F.lit('{"usage": {"prompt_tokens": '), n, F.lit(', "completion_tokens": 1.5}}')))
    )
    found = table(spark, sf, "events").select("event_id", usage(payload).alias("u"))
    count = lambda k: F.coalesce(F.try_element_at("u", F.lit(k)), F.lit(-1)).alias(k)
    return found.select("event_id", count("input"), count("output"), count("total"))


# Documents are results: three rounds, two modes, graded unless the text is very short.
_ITEMS = """items AS (
  SELECT CASE WHEN (doc_id // 3) % 2 = 0 THEN 'direct' ELSE 'graph' END AS mode, (doc_id % 3)::INT AS round_index, 'item-' || (doc_id // 6) AS id,
    coalesce(quality, 1) = 1 AS answer_hit, coalesce(toxic, 0) = 0 AS context_hit, n_chars > 100 AS answered, lang AS answer_text,
    CASE WHEN lang = 'fr' THEN 'multi_step' ELSE 'single_shot' END AS route, n_chars % 4 AS dups, n_chars AS latency_ms, len(source) AS input, n_chars * 2 AS output,
    CASE WHEN n_chars > 400 THEN (n_chars % 1000) / 1000.0::DOUBLE END AS faithfulness, CASE WHEN lang <> 'de' THEN (n_chars % 500) / 500.0::DOUBLE END AS relevancy
  FROM documents LEFT JOIN labels USING (doc_id))"""


def _results(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    nan = F.lit(float("nan"))
    return docs.select(
        F.when(F.expr("(doc_id div 3) % 2") == 0, "direct").otherwise("graph").alias("mode"),
        (F.col("doc_id") % 3).cast("int").alias("round_index"),
        F.concat(F.lit("item-"), F.expr("doc_id div 6").cast("string")).alias("id"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("answer_hit"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("context_hit"), (F.col("n_chars") > 100).alias("answered"),
        F.col("lang").alias("answer_text"), F.array("source").alias("contexts"),
        F.when(F.col("lang") == "fr", "multi_step").otherwise("single_shot").alias("route"),
        (F.col("n_chars") % 4).alias("duplicate_passages_avoided"), F.col("n_chars").alias("latency_ms"),
        F.create_map(F.lit("input"), F.length("source").cast("bigint"), F.lit("output"), F.col("n_chars") * 2).alias("tokens"),
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("trace_id"),
        F.when(F.col("n_chars") > 400, (F.col("n_chars") % 1000) / 1000.0).otherwise(nan).alias("faithfulness"),
        F.when(F.col("lang") != "de", (F.col("n_chars") % 500) / 500.0).alias("answer_relevancy"),
    )


def items(spark, sf):
    return _results(spark, sf).drop("faithfulness", "answer_relevancy")


def grades(spark, sf):
    return _results(spark, sf).select("mode", "round_index", "id", "faithfulness", "answer_relevancy")


def rounds(spark, sf):
    return evaluation.summarise_round(items(spark, sf), grades(spark, sf))


_ROUNDS = _ITEMS + """,
rounds AS (SELECT mode, round_index, count(*) AS total, round_even(avg(context_hit::INT), 3) AS context_hit_rate, round_even(avg(answer_hit::INT), 3) AS answer_hit_rate,
  round_even(avg(answered::INT), 3) AS answered_rate, count(*) FILTER (WHERE route = 'multi_step') AS multi_step_routed, sum(dups)::BIGINT AS duplicates_avoided,
  floor(avg(latency_ms))::BIGINT AS mean_latency_ms, max(latency_ms) AS max_latency_ms, round_even(avg(faithfulness), 3) AS mean_faithfulness,
  round_even(avg(relevancy), 3) AS mean_answer_relevancy, count(faithfulness) AS faithfulness_graded, count(relevancy) AS answer_relevancy_graded,
  sum(input)::BIGINT AS input, sum(output)::BIGINT AS output FROM items GROUP BY 1, 2)"""


@query("j6_summarise_round", stored(f"WITH {_ROUNDS} SELECT * FROM rounds"))
def summarise(spark, sf):
    return rounds(spark, sf).select("*", F.col("tokens")["input"].alias("input"),
                                    F.col("tokens")["output"].alias("output")).drop("tokens")


@query("j7_spread", stored("""
SELECT o_custkey, round_even(avg(v), 3) AS mean, round(coalesce(stddev_samp(v), -1), 3) AS stdev, round_even(min(v), 3) AS least,
  round_even(max(v), 3) AS most, count(v) AS rounds FROM (SELECT o_custkey, ln(o_totalprice) AS v FROM orders) GROUP BY 1"""))
def spread(spark, sf):
    found = table(spark, sf, "orders").withColumn("v", F.log("o_totalprice")).groupBy("o_custkey").agg(
        evaluation.spread(F.col("v")).alias("s"))
    return found.select("o_custkey", "s.mean", F.coalesce("s.stdev", F.lit(-1.0)).alias("stdev"),
                        F.col("s.min").alias("least"), F.col("s.max").alias("most"), "s.rounds")


_UNSTABLE = """unstable AS (SELECT mode, id FROM items GROUP BY 1, 2 HAVING count(DISTINCT (context_hit, answer_hit)) > 1)"""


@query("j8_unstable_items", f"WITH {_ITEMS}, {_UNSTABLE} SELECT * FROM unstable")
def unstable(spark, sf):
    return evaluation.unstable_items(items(spark, sf))


_REPEATED = """repeated AS (SELECT mode, bool_and(n = 1) AS answers_repeated_exactly FROM (SELECT mode, id, count(DISTINCT answer_text) AS n FROM items GROUP BY 1, 2) GROUP BY 1)"""


@query("j10_unstable_rows", """
SELECT '20260101-000000' AS stamp, 'direct' AS mode, doc_id || '-' || k AS id FROM documents, (SELECT unnest(range(60)) AS k) WHERE doc_id % 2 = 1""")
def unstable_rows(spark, sf):
    """Sixty items a document, in two rounds; those of odd documents change their verdict. Written beside the history and read back."""
    path = scratch(spark, "unstable")
    many = table(spark, sf, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("k"))
    rows = many.select("doc_id", "k", F.explode(F.array(F.lit(0), F.lit(1))).alias("round_index")).select(
        F.lit("direct").alias("mode"), "round_index", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("k").cast("string")).alias("id"),
        F.lit(True).alias("context_hit"), ((F.col("doc_id") % 2 == 0) | (F.col("round_index") == 0)).alias("answer_hit"))
    runs_.append_unstable(evaluation.unstable_items(rows), "20260101-000000", path)
    return runs_.read_unstable(spark, path)


@query("j9_answers_repeated_exactly", f"""
WITH {_ITEMS}, {_REPEATED} SELECT * FROM repeated""")
def repeated(spark, sf):
    return evaluation.answers_repeated_exactly(items(spark, sf))


_RUNS = f"""{_ROUNDS}, {_UNSTABLE}, {_REPEATED},
runs AS (SELECT mode, count(*) AS rounds, min_by(total, round_index) AS total, round_even(avg(context_hit_rate), 3) AS context_mean, round(stddev_samp(context_hit_rate), 3) AS context_stdev,
  round_even(avg(answer_hit_rate), 3) AS answer_mean, round(stddev_samp(answer_hit_rate), 3) AS answer_stdev,
  round_even(avg(answered_rate), 3) AS answered_mean, round(stddev_samp(answered_rate), 3) AS answered_stdev,
  round_even(avg(mean_faithfulness), 3) AS faithful_mean, round(stddev_samp(mean_faithfulness), 3) AS faithful_stdev,
  round_even(avg(mean_answer_relevancy), 3) AS relevancy_mean, round(stddev_samp(mean_answer_relevancy), 3) AS relevancy_stdev,
  floor(avg(faithfulness_graded))::BIGINT AS faithfulness_graded, floor(avg(mean_latency_ms))::BIGINT AS mean_latency_ms, max(max_latency_ms) AS max_latency_ms,
  sum(duplicates_avoided)::BIGINT AS duplicates_avoided, sum(multi_step_routed)::BIGINT AS multi_step_routed, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output FROM rounds GROUP BY mode)"""
_SHORT = {"context": "context_hit_rate", "answer": "answer_hit_rate", "answered": "answered_rate",
          "faithful": "mean_faithfulness", "relevancy": "mean_answer_relevancy"}


@query("j10_aggregate_runs", stored(f"""
WITH {_RUNS} SELECT runs.*, (SELECT count(*) FROM unstable u WHERE u.mode = runs.mode)::INT AS n_unstable, answers_repeated_exactly FROM runs JOIN repeated USING (mode)"""))
def aggregate(spark, sf):
    found = evaluation.aggregate_runs(rounds(spark, sf), items(spark, sf))
    stats = [F.col(m)[part].alias(f"{short}_{part}") for short, m in _SHORT.items() for part in ("mean", "stdev")]
    return found.select(
        "mode", "rounds", "total", *stats, "faithfulness_graded", "mean_latency_ms", "max_latency_ms", "duplicates_avoided",
        "multi_step_routed", F.col("total_tokens")["input"].alias("input"), F.col("total_tokens")["output"].alias("output"),
        F.col("n_unstable").cast("int").alias("n_unstable"), "answers_repeated_exactly")


@query("j11_compare_modes", stored(f"""
WITH {_RUNS}, long AS (""" + " UNION ALL ".join(
    f"SELECT mode, '{m}' AS metric, {short}_mean AS mean, {short}_stdev AS stdev FROM runs" for short, m in _SHORT.items()) + """),
sides AS (SELECT b.metric, b.mean AS before, a.mean AS after, round_even(a.mean - b.mean, 3) AS delta, greatest(coalesce(b.stdev, 0), coalesce(a.stdev, 0)) AS noise
  FROM long b JOIN long a USING (metric) WHERE b.mode = 'direct' AND a.mode = 'graph')
SELECT *, CASE WHEN abs(delta) <= noise THEN 'NOISE' ELSE 'outside spread' END AS verdict FROM sides"""))
def compare(spark, sf):
    return evaluation.compare_modes(evaluation.aggregate_runs(rounds(spark, sf), items(spark, sf)))


@query("j12_repeat_rounds", """
SELECT item_id::VARCHAR AS id, r::INT AS round_index FROM benchmark, (SELECT unnest([0, 1, 2]) AS r)""")
def repeat(spark, sf):
    return evaluation.repeat_rounds(table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id")), 3)


@query("j13_gradeable", f"WITH {_ITEMS} SELECT mode, round_index, count(*) AS n FROM items WHERE answered GROUP BY ALL")
def gradeable(spark, sf):
    return evaluation.gradeable(items(spark, sf)).groupBy("mode", "round_index").agg(F.count(F.lit(1)).alias("n"))


@query("j14_attach_scores", """
SELECT 't' || doc_id AS trace_id, 'quality' AS name, quality::DOUBLE AS value FROM labels WHERE toxic = 0""")
def attach(spark, sf):
    """Scores of toxic documents are NaN."""
    scores = table(spark, sf, "labels").select(
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("trace_id"), F.lit("quality").alias("name"),
        F.when(F.col("toxic") == 0, F.col("quality").cast("double")).otherwise(F.lit(float("nan"))).alias("value"))
    return evaluation.attach_scores(items(spark, sf), scores).select("trace_id", "name", "value")


_HISTORY = """per AS (SELECT c_nationkey, avg((c_acctbal > 0)::INT) AS m, stddev_samp((c_acctbal > 0)::INT) AS s, count(*) AS n FROM customer GROUP BY 1),
history AS (SELECT n_nationkey AS k, '202608' || lpad(n_nationkey::VARCHAR, 2, '0') || '-080000' AS run, n_nationkey % 3 + 1 AS rounds, n,
  CASE WHEN n_nationkey <> 7 THEN round(m, 3) END AS mean, CASE WHEN n_nationkey % 3 > 0 THEN round(s, 3) END AS stdev FROM nation JOIN per ON c_nationkey = n_nationkey),
shown AS (SELECT *, CASE WHEN mean IS NULL THEN '—' WHEN stdev IS NULL THEN mean::VARCHAR ELSE mean::VARCHAR || ' ± ' || stdev::VARCHAR END AS cell FROM history)"""


@query("j15_metric_cell", f"""
WITH {_HISTORY} SELECT run, cell AS context_hit, CASE WHEN mean IS NOT NULL AND k % 2 = 1 THEN cell || '<br>*(' || (n - 1) || '/' || n || ' graded)*' ELSE cell END AS faithfulness FROM shown""")
def metric_cells(spark, sf):
    return evaluation.runs_table(history(spark, sf)).select(
        "run", F.col("context_hit_rate").alias("context_hit"), F.col("mean_faithfulness").alias("faithfulness"))


@query("j16_stability_cell", f"""
WITH {_HISTORY} SELECT run, CASE WHEN rounds < 2 THEN 'not measured' WHEN k % 4 = 0 THEN 'deterministic' ELSE (CASE WHEN k % 5 = 0 THEN 0 ELSE 2 END) || '/' || n END AS unstable FROM history""")
def stability(spark, sf):
    return evaluation.runs_table(history(spark, sf)).select("run", "unstable")


@query("j17_tokens_cell", f"""
WITH {_HISTORY} SELECT run, CASE k % 3 WHEN 0 THEN format('{{:,}}', n * 1001) WHEN 1 THEN format('{{:,}}', n * 100000) ELSE '—' END AS tokens FROM history""")
def tokens(spark, sf):
    return evaluation.runs_table(history(spark, sf)).select("run", "tokens")


@query("j18_runs_table", f"""
WITH {_HISTORY} SELECT run, CASE WHEN k % 2 = 0 THEN 'direct' ELSE 'graph' END AS mode, CASE WHEN k % 4 = 3 THEN '—' ELSE 'NATION_' || k END AS commit, rounds::BIGINT AS rounds,
  (k * 1000)::VARCHAR AS mean_ms FROM history""")
def runs(spark, sf):
    return evaluation.runs_table(history(spark, sf)).select("run", "mode", "commit", "rounds", "mean_ms")


@query("j18_latest_run", f"""
WITH {_HISTORY} SELECT run AS stamp, n AS total FROM history ORDER BY run DESC LIMIT 1""")
def latest(spark, sf):
    return evaluation.latest_run(history(spark, sf)).select("stamp", "total")


@query("j19_grade", r"""
WITH said AS (SELECT doc_id, list_distinct(string_split_regex(trim(lower(text), E' \n'), '\s+')) AS words, string_split_regex(lower(source || ' ' || lang), '\s+') AS asked FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
counted AS (SELECT doc_id, len(list_filter(words, lambda w: w <> '')) AS n, len(list_filter(words, lambda w: w IN ('is', 'die', 'de', 'que'))) AS seen FROM said)
SELECT doc_id::VARCHAR AS id, CASE WHEN n = 0 THEN -1 ELSE round(seen / n, 6) END AS faithfulness FROM counted""")
def grade(spark, sf):
    """How many words of a text are among four common ones."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    asked = docs.select(
        F.lit("direct").alias("mode"), F.lit(0).alias("round_index"), F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("question"), F.col("text").alias("answer_text"), (F.col("quality") == 1).alias("answered"),
        F.array(F.lit("is die"), F.lit("de que")).alias("contexts"))
    graded = evaluation.grade(asked)
    return graded.select("id", F.when(F.isnan("faithfulness"), -1.0).otherwise(F.round("faithfulness", 6)).alias("faithfulness"))


@query("j20_eval_run", stored(f"""
WITH {CHUNKS}, scope_edges AS (SELECT 0 AS user_id, 0 AS case_id WHERE false),
asked AS (SELECT item_id AS query_id, 0 AS user_id, text AS question, true AS all_cases FROM benchmark),
{asked_sql("asked")},
found AS (SELECT query_id, string_agg(text, E'\\n' ORDER BY match_rank) AS texts FROM matches JOIN chunks USING (chunk_id) GROUP BY 1),
judged AS (SELECT contains(texts, string_split(question, ' ')[1]) AS ctx, reply IS NOT NULL AND len(list_filter(string_split(question, ' '), lambda w: contains(reply, w))) > 0 AS ans, reply IS NOT NULL AS done
  FROM asked JOIN found USING (query_id) LEFT JOIN checked USING (query_id))
SELECT 'direct' AS mode, 2::BIGINT AS rounds, count(*) AS total, round_even(avg(ctx::INT), 3) AS context_hit, round_even(avg(coalesce(ans, false)::INT), 3) AS answer_hit,
  round_even(avg(done::INT), 3) AS answered, 0::INT AS n_unstable, true AS answers_repeated_exactly FROM judged"""))
def run(spark, sf):
    """Benchmark texts as the gold set, two rounds."""
    models = Models(lambda: HashProvider(64), ExtractiveProvider, 64)
    done = eval_run(gold_set(spark, sf), chunks(spark, sf), file_names(spark, sf), models, "direct", rounds=2)
    return done.aggregate.select(
        "mode", "rounds", "total", F.col("context_hit_rate.mean").alias("context_hit"),
        F.col("answer_hit_rate.mean").alias("answer_hit"), F.col("answered_rate.mean").alias("answered"),
        F.col("n_unstable").cast("int").alias("n_unstable"), "answers_repeated_exactly")


def gold_set(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.lit("en").alias("lang"), F.col("text").alias("question"),
        F.substring_index("text", " ", 1).alias("expected_section"), F.split("text", " ").alias("expected_answer_contains"))


@query("j20_eval_graph", f"""
WITH {CHUNKS}, scope_edges AS (SELECT 0 AS user_id, 0 AS case_id WHERE false),
asked AS (SELECT item_id AS query_id, 0 AS user_id, text AS question, true AS all_cases FROM benchmark),
{two_passes_sql("asked")},
found AS (SELECT query_id // 10 AS query_id, string_agg(text, E'\\n' ORDER BY query_id, match_rank) AS texts FROM matches JOIN chunks USING (chunk_id) GROUP BY 1)
SELECT 'graph' AS mode, a.query_id::VARCHAR AS id, 0::INT AS round_index, 'multi_step' AS route, 2::INT AS iterations, contains(texts, string_split(question, ' ')[1]) AS context_hit,
  reply IS NOT NULL AS answered, coalesce(len(list_filter(string_split(question, ' '), lambda w: contains(reply, w))) > 0, false) AS answer_hit, true AS timed, true AS traced
FROM asked a JOIN found f ON f.query_id = a.query_id LEFT JOIN checked k ON k.query_id = a.query_id""")
def graph_run(spark, sf):
    """The same gold set in the mode that may search again, and does so once."""
    models = Models(lambda: HashProvider(64), lambda: ScriptedProvider(1), 64)
    items = eval_run(gold_set(spark, sf), chunks(spark, sf), file_names(spark, sf), models, "graph", multi_step=True).items
    return items.select("mode", "id", F.col("round_index").cast("int").alias("round_index"), "route", "iterations", "context_hit", "answered", "answer_hit",
                        F.col("latency_ms").isNotNull().alias("timed"), F.col("trace_id").startswith("graph-").alias("traced"))
