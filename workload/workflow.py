"""Status rules, reviews, feedback threads."""

from pyspark.sql import functions as F

from dossier.operators import workflow
from dossier.operators.access import roles_holding
from dossier.schemas import NEXT_STATUSES, STATUS_LABELS
from workload.base import (
    ASSIGNMENTS, CASES, STATUS_OF_EVENT, USERS, assignments, cases, mapped, query, sql_mapped, table, users,
)

_MOVES = "moves AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', '{t}')" for s, targets in NEXT_STATUSES.items() for t in targets
) + ") AS t(status, target_status))"
_LISTED = "CASE {c} " + " ".join(
    f"WHEN '{s}' THEN '" + ("[" + ", ".join(f"''{t}''" for t in targets) + "]" if targets
                            else "none (terminal state)") + "'"
    for s, targets in NEXT_STATUSES.items()) + " END"


def _message(status: str, target: str) -> str:
    return (f"'Cannot transition case from ''' || {status} || ''' to ''' || {target} || "
            f"'''. Allowed transitions from ''' || {status} || ''': ' || " + _LISTED.format(c=status))


@query("h1_transition_valid", f"""
WITH {CASES}, {_MOVES},
targets AS (SELECT DISTINCT status AS target_status FROM moves UNION SELECT target_status FROM moves),
requests AS (SELECT case_id, status, target_status FROM cases, targets)
SELECT status, target_status, legal, CASE WHEN NOT legal THEN {_message('status', 'target_status')} ELSE '' END AS message, count(*) AS n
FROM (SELECT r.*, m.status IS NOT NULL AS legal FROM requests r LEFT JOIN moves m USING (status, target_status)) GROUP BY ALL""")
def transition_valid(spark, sf):
    every = F.array(*[F.lit(s) for s in NEXT_STATUSES])
    requests = cases(spark, sf).select("case_id", "status", F.explode(every).alias("target_status"))
    return workflow.transition_valid(requests).groupBy(
        "status", "target_status", "legal", F.coalesce("message", F.lit("")).alias("message")).agg(
        F.count(F.lit(1)).alias("n"))


REPLAY_SQL = f"""
WITH RECURSIVE {_MOVES}, requests AS (
  SELECT user_id AS case_id, event_id AS request_id, {sql_mapped("event_type", STATUS_OF_EVENT)} AS target_status,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
folded AS (
  SELECT case_id, request_id, target_status, n, 'draft' AS status, target_status = 'in_progress' AS accepted FROM requests WHERE n = 1
  UNION ALL
  SELECT r.case_id, r.request_id, r.target_status, r.n, f.after, EXISTS (SELECT 1 FROM moves m WHERE m.status = f.after AND m.target_status = r.target_status)
  FROM (SELECT *, CASE WHEN accepted THEN target_status ELSE status END AS after FROM folded) f
  JOIN requests r ON r.case_id = f.case_id AND r.n = f.n + 1)"""


@query("h2_replay_transitions", REPLAY_SQL + f"""
SELECT case_id, request_id, target_status, status, accepted,
  CASE WHEN NOT accepted THEN {_message('status', 'target_status')} ELSE '' END AS message FROM folded""")
def replay(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("case_id"), F.col("event_id").alias("request_id"), "ts",
        mapped(F.col("event_type"), STATUS_OF_EVENT).alias("target_status"))
    return workflow.replay_transitions(events, ["ts", "request_id"]).select(
        "case_id", "request_id", "target_status", "status", "accepted",
        F.coalesce("message", F.lit("")).alias("message"))


_REVIEW_REQUESTS = """review_requests AS (
  SELECT event_id AS request_id, (json_extract(props, '$.k'))::BIGINT * 150 + user_id AS case_id, user_id AS reviewer_id, event_type AS content FROM events)"""


@query("h3_open_reviews", f"""
WITH {CASES}, {_REVIEW_REQUESTS},
facts AS (SELECT r.*, status, row_number() OVER (PARTITION BY case_id ORDER BY request_id) AS nth FROM review_requests r LEFT JOIN cases USING (case_id)),
judged AS (SELECT *, CASE WHEN status IS NULL THEN 404 WHEN status <> 'submitted_for_review' OR nth > 1 THEN 409 ELSE 201 END AS verdict FROM facts)
SELECT verdict::INT AS verdict, request_id, case_id,
  CASE WHEN verdict = 201 THEN 'under_review' ELSE coalesce(status, '') END AS status_after,
  CASE WHEN verdict = 201 THEN reviewer_id ELSE -1 END AS author_id FROM judged""")
def open_reviews(spark, sf):
    requests = table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"),
        (F.get_json_object("props", "$.k").cast("bigint") * 150 + F.col("user_id")).alias("case_id"),
        F.col("user_id").alias("reviewer_id"), F.col("event_type").alias("content"),
        F.col("ts").alias("created_at"))
    opened = workflow.open_reviews(requests, cases(spark, sf))
    roots = opened.feedback.select(F.col("review_id").alias("request_id"), "author_id")
    states = opened.statuses.select("case_id", F.col("status").alias("_after"))
    return opened.verdicts.join(roots, "request_id", "left").join(states, "case_id", "left").select(
        "verdict", "request_id", "case_id",
        F.when(F.col("verdict") == 201, F.col("_after")).otherwise(
            F.coalesce("case_status", F.lit(""))).alias("status_after"),
        F.coalesce("author_id", F.lit(-1)).alias("author_id"))


def feedback(spark, sf):
    turn, conv = F.col("turn"), F.col("conv_id")
    return table(spark, sf, "conversations").select(
        (conv * 1000 + turn).alias("feedback_id"), conv.alias("review_id"), conv.alias("author_id"),
        F.when(turn > 0, conv * 1000 + F.expr("(turn - 1) div 2")).alias("parent_id"),
        F.col("text").alias("content"), (F.col("role") == "assistant").alias("resolved"))


def reviews(spark, sf):
    """A review per conversation; every third one belongs to another case."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("review_id"),
        F.expr("conv_id + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END").alias("case_id")).distinct()


_FEEDBACK = """feedback AS (
  SELECT conv_id * 1000 + turn AS feedback_id, conv_id AS review_id, conv_id AS author_id,
    CASE WHEN turn > 0 THEN conv_id * 1000 + (turn - 1) // 2 END AS parent_id, text AS content, role = 'assistant' AS resolved FROM conversations)"""
_REVIEWS = """reviews AS (
  SELECT DISTINCT conv_id AS review_id, conv_id + CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END AS case_id FROM conversations)"""
_REPLY_SQL = """SELECT conv_id * 1000 + turn AS reply_id, conv_id AS case_id, conv_id * 1000 + turn + CASE WHEN role = 'user' THEN 1 ELSE 0 END AS parent_id FROM conversations"""


def _replies(spark, sf, target):
    conv, turn = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").select(
        (conv * 1000 + turn).alias("reply_id"), conv.alias("case_id"),
        (conv * 1000 + turn + (F.col("role") == "user").cast("int")).alias(target))


@query("h4_reply_verdict", f"""
WITH {_FEEDBACK}, {_REVIEWS}, replies AS ({_REPLY_SQL})
SELECT reply_id, (CASE WHEN f.review_id IS NULL THEN 404 WHEN v.case_id IS DISTINCT FROM p.case_id THEN 400 ELSE 201 END)::INT AS verdict,
  coalesce(f.review_id, -1) AS review_id
FROM replies p LEFT JOIN feedback f ON f.feedback_id = p.parent_id LEFT JOIN reviews v ON v.review_id = f.review_id""")
def reply_verdict(spark, sf):
    judged = workflow.reply_verdict(_replies(spark, sf, "parent_id"), feedback(spark, sf), reviews(spark, sf))
    return judged.select("reply_id", "verdict", F.coalesce("review_id", F.lit(-1)).alias("review_id"))


@query("h5_resolve_feedback", f"""
WITH {_FEEDBACK}, {_REVIEWS}, requests AS ({_REPLY_SQL}),
done AS (SELECT DISTINCT f.feedback_id FROM requests p JOIN feedback f ON f.feedback_id = p.parent_id
  JOIN reviews v ON v.review_id = f.review_id AND v.case_id = p.case_id)
SELECT f.feedback_id, f.resolved OR d.feedback_id IS NOT NULL AS resolved FROM feedback f LEFT JOIN done d USING (feedback_id)""")
def resolve_feedback(spark, sf):
    return workflow.resolve_feedback(
        _replies(spark, sf, "feedback_id"), feedback(spark, sf), reviews(spark, sf)).select(
        "feedback_id", "resolved")


# Who replies is the customer of the order with the case's number, or the user with a number near it.
_RIGHTS = f"""{USERS}, {CASES}, {ASSIGNMENTS}, {_FEEDBACK}, {_REVIEWS},
said AS (SELECT r.*, CASE WHEN r.reply_id % 2 = 0 THEN o_custkey ELSE r.case_id + r.reply_id % 7 END AS user_id FROM ({_REPLY_SQL}) r LEFT JOIN orders ON o_orderkey = r.case_id),
judged AS (SELECT s.*, f.review_id, CASE WHEN u.role IS NULL OR u.role NOT IN ({", ".join(repr(r) for r in roles_holding("case:edit:any", "case:edit:assigned"))}) THEN 403
    WHEN c.case_id IS NULL THEN 404
    WHEN u.role NOT IN ({", ".join(repr(r) for r in roles_holding("case:edit:any"))}) AND a.user_id IS NULL THEN 403
    WHEN f.review_id IS NULL THEN 404 WHEN v.case_id IS DISTINCT FROM s.case_id THEN 400 ELSE 201 END AS verdict
  FROM said s LEFT JOIN users u ON u.user_id = s.user_id LEFT JOIN cases c ON c.case_id = s.case_id
  LEFT JOIN (SELECT DISTINCT * FROM assignments) a ON a.user_id = s.user_id AND a.case_id = s.case_id
  LEFT JOIN feedback f ON f.feedback_id = s.parent_id LEFT JOIN reviews v ON v.review_id = f.review_id)"""


def _replies_of_users(spark, sf, target):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), "o_custkey")
    user = F.when(F.col("reply_id") % 2 == 0, F.col("o_custkey")).otherwise(F.col("case_id") + F.col("reply_id") % 7)
    return _replies(spark, sf, target).join(orders, "case_id", "left").select("reply_id", "case_id", target, user.alias("user_id"))


def rights(spark, sf):
    return workflow.Rights(users(spark, sf), cases(spark, sf), assignments(spark, sf))


@query("h4_reply_rights", f"""
WITH {_RIGHTS} SELECT reply_id, verdict::INT AS verdict, coalesce(review_id, -1) AS review_id FROM judged""")
def reply_rights(spark, sf):
    judged = workflow.reply_verdict(_replies_of_users(spark, sf, "parent_id"), feedback(spark, sf), reviews(spark, sf), rights(spark, sf))
    return judged.select("reply_id", "verdict", F.coalesce("review_id", F.lit(-1)).alias("review_id"))


@query("h5_resolve_rights", f"""
WITH {_RIGHTS} SELECT f.feedback_id, f.resolved OR EXISTS (SELECT 1 FROM judged j WHERE j.parent_id = f.feedback_id AND verdict = 201) AS resolved FROM feedback f""")
def resolve_rights(spark, sf):
    return workflow.resolve_feedback(
        _replies_of_users(spark, sf, "feedback_id"), feedback(spark, sf), reviews(spark, sf), rights(spark, sf)).select("feedback_id", "resolved")


@query("h6_reviews_of_cases", f"""
WITH {_REVIEWS}, {CASES} SELECT review_id, case_id FROM reviews WHERE case_id IN (SELECT case_id FROM cases WHERE status = 'draft')""")
def reviews_of_cases(spark, sf):
    drafts = cases(spark, sf).where(F.col("status") == "draft")
    return workflow.reviews_of_cases(reviews(spark, sf), drafts)


@query("h7_feedback_of_cases", f"""
WITH {_FEEDBACK}, {_REVIEWS} SELECT feedback_id, review_id, case_id FROM feedback JOIN reviews USING (review_id)""")
def feedback_of_cases(spark, sf):
    return workflow.feedback_of_cases(feedback(spark, sf), reviews(spark, sf)).select(
        "feedback_id", "review_id", "case_id")


@query("h8_thread_tree", f"""
WITH RECURSIVE {_FEEDBACK}, tree AS (
  SELECT feedback_id, review_id, 0 AS depth, [feedback_id] AS path FROM feedback WHERE parent_id IS NULL
  UNION ALL SELECT f.feedback_id, f.review_id, depth + 1, list_append(path, f.feedback_id)
  FROM feedback f JOIN tree t ON f.parent_id = t.feedback_id AND f.review_id = t.review_id)
SELECT feedback_id, review_id, depth::INT AS depth, array_to_string(path, '/') AS path,
  row_number() OVER (PARTITION BY review_id ORDER BY path) - 1 AS position FROM tree""")
def thread_tree(spark, sf):
    return workflow.thread_tree(feedback(spark, sf)).select(
        "feedback_id", "review_id", "depth",
        F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "position")


@query("h9_orphan_check", f"""
WITH {_FEEDBACK}, kept AS (SELECT * FROM feedback WHERE NOT resolved)
SELECT feedback_id, review_id, parent_id FROM kept k WHERE parent_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM kept p WHERE p.feedback_id = k.parent_id AND p.review_id = k.review_id)""")
def orphan_check(spark, sf):
    """Orphans after all resolved comments have been taken out."""
    kept = feedback(spark, sf).where(~F.col("resolved"))
    return workflow.orphan_check(kept).select("feedback_id", "review_id", "parent_id")


_TURNED = f"""{_FEEDBACK}, turned AS (
  SELECT feedback_id, review_id, CASE WHEN review_id % 5 = 0 AND feedback_id % 1000 = 1 THEN feedback_id + 2
    WHEN review_id % 7 = 0 AND feedback_id % 1000 = 2 THEN -1 ELSE parent_id END AS parent_id FROM feedback)"""


@query("h9_unreachable", f"""
WITH RECURSIVE {_TURNED},
reached AS (
  SELECT feedback_id, review_id FROM turned WHERE parent_id IS NULL
  UNION ALL SELECT t.feedback_id, t.review_id FROM turned t JOIN reached r ON t.parent_id = r.feedback_id AND t.review_id = r.review_id),
below AS (
  SELECT feedback_id, review_id FROM turned t WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM turned p WHERE p.feedback_id = t.parent_id AND p.review_id = t.review_id)
  UNION ALL SELECT t.feedback_id, t.review_id FROM turned t JOIN below b ON t.parent_id = b.feedback_id AND t.review_id = b.review_id)
SELECT feedback_id, review_id, CASE WHEN feedback_id IN (SELECT feedback_id FROM below) THEN 'orphan' ELSE 'cycle' END AS reason
FROM turned WHERE feedback_id NOT IN (SELECT feedback_id FROM reached)""")
def unreachable(spark, sf):
    """In every fifth thread the second comment answers the fourth, its own child, if there is one; in every seventh the third answers nothing."""
    turn, key = F.col("feedback_id") % 1000, F.col("feedback_id")
    turned = feedback(spark, sf).withColumn(
        "parent_id", F.when((F.col("review_id") % 5 == 0) & (turn == 1), key + 2)
        .when((F.col("review_id") % 7 == 0) & (turn == 2), F.lit(-1)).otherwise(F.col("parent_id")))
    return workflow.unreachable(turned).select("feedback_id", "review_id", "reason")


@query("h10_patch_cases", f"""
WITH {CASES}, patches AS (
  SELECT c_custkey AS case_id, CASE WHEN c_acctbal > 0 THEN c_name END AS title, CASE WHEN c_nationkey > 12 THEN c_mktsegment END AS description FROM customer)
SELECT case_id, coalesce(p.title, c.title) AS title, coalesce(p.description, c.description, '') AS description FROM cases c LEFT JOIN patches p USING (case_id)""")
def patch_cases(spark, sf):
    patches = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("case_id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("title"),
        F.when(F.col("c_nationkey") > 12, F.col("c_mktsegment")).alias("description"))
    return workflow.patch_cases(cases(spark, sf), patches).select(
        "case_id", "title", F.coalesce("description", F.lit("")).alias("description"))


@query("h11_status_label", f"""
WITH {CASES} SELECT case_id, {sql_mapped("status", STATUS_LABELS)} AS label FROM cases""")
def status_label(spark, sf):
    return cases(spark, sf).select("case_id", workflow.status_label(F.col("status")).alias("label"))
