"""Roles, permissions, assignments, sessions and rate limits."""

from pyspark.sql import functions as F

from dossier.operators import access
from dossier.schemas import NEXT_STATUSES, PERMISSIONS_FOR_TARGET, PERMISSIONS_OF_ROLE
from workload.base import (
    ACCESS_REQUESTS, ASSIGNMENTS, CASE_DOCUMENTS, CASES, STATUS_OF_EVENT, USERS, access_requests,
    assignments, case_documents, cases, mapped, query, sql_mapped, table, users,
)

_MATRIX = "matrix AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', '{p}')" for r, held in PERMISSIONS_OF_ROLE.items() for p in held
) + ") AS t(role, permission))"


@query("g1_role_permissions", f"""
WITH {USERS}, {_MATRIX}
SELECT role, permission, count(*) AS n_users FROM users JOIN matrix USING (role) GROUP BY role, permission""")
def role_permissions(spark, sf):
    per_role = users(spark, sf).groupBy("role").agg(F.count(F.lit(1)).alias("n_users"))
    return per_role.join(access.role_permissions(spark), "role").select("role", "permission", "n_users")


@query("g2_has_any_permission", f"""
WITH {USERS}, {_MATRIX}
SELECT user_id, role IN (SELECT role FROM matrix WHERE permission IN ('case:close', 'case:submit_for_review')) AS permitted FROM users""")
def has_any(spark, sf):
    return users(spark, sf).select("user_id", access.has_any_permission(
        F.col("role"), "case:close", "case:submit_for_review").alias("permitted"))


@query("g3_is_assigned", f"""
WITH {ASSIGNMENTS}, {ACCESS_REQUESTS}
SELECT (a.user_id IS NOT NULL) AS assigned, count(*) AS n, sum(r.user_id)::BIGINT AS sum_user, sum(r.case_id)::BIGINT AS sum_case
FROM access_requests r LEFT JOIN (SELECT DISTINCT * FROM assignments) a USING (user_id, case_id) GROUP BY 1""")
def is_assigned(spark, sf):
    found = access.is_assigned(access_requests(spark, sf), assignments(spark, sf))
    return found.groupBy("assigned").agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("sum_user"),
        F.sum("case_id").alias("sum_case"))


@query("g4_cases_of_users", f"""
WITH {ASSIGNMENTS} SELECT DISTINCT user_id, case_id FROM assignments""")
def cases_of_users(spark, sf):
    return access.cases_of_users(assignments(spark, sf))


@query("g5_visible_cases", f"""
WITH {USERS}, {CASES}, {ASSIGNMENTS}
SELECT user_id, c.case_id, c.status FROM users JOIN (SELECT DISTINCT * FROM assignments) USING (user_id)
JOIN cases c USING (case_id) WHERE role NOT IN ('admin', 'partner')""")
def visible_cases(spark, sf):
    return access.visible_cases(users(spark, sf), cases(spark, sf), assignments(spark, sf)).select(
        "user_id", "case_id", "status")


@query("g5_visible_counts", f"""
WITH {USERS}, {CASES}, {ASSIGNMENTS},
own AS (SELECT user_id, count(*) AS n, sum(case_id) AS s FROM (SELECT DISTINCT * FROM assignments) JOIN cases USING (case_id) GROUP BY user_id)
SELECT user_id, (CASE WHEN role IN ('admin', 'partner') THEN (SELECT count(*) FROM cases) ELSE coalesce(n, 0) END)::BIGINT AS n_visible,
  (CASE WHEN role IN ('admin', 'partner') THEN (SELECT sum(case_id) FROM cases) ELSE coalesce(s, 0) END)::BIGINT AS sum_case_id
FROM users LEFT JOIN own USING (user_id)""")
def visible_counts(spark, sf):
    return access.visible_counts(users(spark, sf), cases(spark, sf), assignments(spark, sf))


@query("g6_access_verdict", f"""
WITH {USERS}, {CASES}, {ASSIGNMENTS}, {ACCESS_REQUESTS},
facts AS (SELECT r.*, u.role, c.case_id IS NOT NULL AS there, a.user_id IS NOT NULL AS assigned
  FROM access_requests r LEFT JOIN users u USING (user_id) LEFT JOIN cases c ON c.case_id = r.case_id
  LEFT JOIN (SELECT DISTINCT * FROM assignments) a ON a.user_id = r.user_id AND a.case_id = r.case_id),
judged AS (SELECT *, CASE WHEN role IS NULL THEN 'Not permitted' WHEN NOT there THEN 'Case not found'
  WHEN role NOT IN ('admin', 'partner') AND NOT assigned THEN 'You are not assigned to this case' ELSE 'ok' END AS reason FROM facts)
SELECT action, coalesce(role, 'none') AS role, (CASE reason WHEN 'ok' THEN 200 WHEN 'Case not found' THEN 404 ELSE 403 END)::INT AS status,
  reason, count(*) AS n, sum(user_id)::BIGINT AS sum_user, sum(case_id)::BIGINT AS sum_case
FROM judged GROUP BY ALL""")
def access_verdict(spark, sf):
    judged = access.access_verdict(access_requests(spark, sf), users(spark, sf), cases(spark, sf),
                                   assignments(spark, sf))
    return judged.groupBy(
        "action", F.coalesce("role", F.lit("none")).alias("role"), "status", "reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("sum_user"),
        F.sum("case_id").alias("sum_case"))


# Every action on the customer's own case or on another one; a transition asks for the status of the next order's priority.
_MOVES_SQL = "moves AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{s}', '{t}')" for s, targets in NEXT_STATUSES.items() for t in targets) + ") AS t(status, target_status))"
_NEEDS_SQL = "CASE target_status " + " ".join(
    f"WHEN '{t}' THEN coalesce(role IN ({', '.join(repr(r) for r in access.roles_holding(*p))}), false)" for t, p in PERMISSIONS_FOR_TARGET.items()) + " ELSE true END"


@query("g6_actions", f"""
WITH {USERS}, {CASES}, {ASSIGNMENTS}, {_MOVES_SQL},
requests AS (
  SELECT l_orderkey AS request_case, CASE WHEN l_linenumber = 4 THEN l_orderkey * 9 ELSE l_orderkey END AS case_id, CASE WHEN l_linenumber % 2 = 1 THEN o_custkey ELSE l_partkey END AS user_id,
    ['upload', 'review', 'transition', 'transition', 'transition', 'upload', 'review'][l_linenumber] AS action,
    ['in_progress', 'submitted_for_review', 'under_review', 'revisions_requested', 'closed', 'draft'][(l_suppkey % 6 + 1)::INT] AS target_status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
facts AS (SELECT r.*, u.role, c.status AS state, c.case_id IS NOT NULL AS there, a.user_id IS NOT NULL AS assigned, CASE action WHEN 'review' THEN 'under_review' ELSE r.target_status END AS target
  FROM requests r LEFT JOIN users u USING (user_id) LEFT JOIN cases c ON c.case_id = r.case_id LEFT JOIN (SELECT DISTINCT * FROM assignments) a ON a.user_id = r.user_id AND a.case_id = r.case_id),
judged AS (SELECT *, CASE
  WHEN role IS NULL OR (action = 'review' AND role NOT IN ({", ".join(repr(r) for r in access.roles_holding("case:review"))}))
    OR (action = 'upload' AND role NOT IN ({", ".join(repr(r) for r in access.roles_holding("case:edit:any", "case:edit:assigned"))})) OR (action = 'transition' AND NOT {_NEEDS_SQL}) THEN 403
  WHEN NOT there THEN 404 WHEN role NOT IN ('admin', 'partner') AND NOT assigned AND action <> 'review' THEN 403
  WHEN action <> 'upload' AND NOT EXISTS (SELECT 1 FROM moves m WHERE m.status = state AND m.target_status = target) THEN 409 ELSE 200 END AS verdict FROM facts)
SELECT action, coalesce(role, 'none') AS role, coalesce(state, '') AS state, target_status, verdict::INT AS status, count(*) AS n, sum(user_id)::BIGINT AS sum_user, sum(case_id)::BIGINT AS sum_case FROM judged GROUP BY ALL""")
def actions(spark, sf):
    line = F.col("l_linenumber")
    listed = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    owner = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    requests = table(spark, sf, "lineitem").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(line == 4, F.col("l_orderkey") * 9).otherwise(F.col("l_orderkey")).alias("case_id"),
        F.when(line % 2 == 1, F.col("o_custkey")).otherwise(F.col("l_partkey")).alias("user_id"),
        listed(["upload", "review", "transition", "transition", "transition", "upload", "review"], line).alias("action"),
        listed(["in_progress", "submitted_for_review", "under_review", "revisions_requested", "closed", "draft"], F.col("l_suppkey") % 6 + 1).alias("target_status"))
    judged = access.access_verdict(requests, users(spark, sf), cases(spark, sf), assignments(spark, sf))
    state = cases(spark, sf).select("case_id", F.col("status").alias("state"))
    return judged.join(state, "case_id", "left").groupBy(
        "action", F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("state", F.lit("")).alias("state"), "target_status", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("sum_user"), F.sum("case_id").alias("sum_case"))


@query("g7_gate_order", f"""
WITH {USERS}, {ACCESS_REQUESTS},
judged AS (SELECT r.*, CASE WHEN role IS NULL THEN 'Not authenticated' WHEN must_change_password THEN 'Password change required'
  WHEN role NOT IN ('admin', 'attorney') THEN 'Not permitted' ELSE 'ok' END AS reason
  FROM access_requests r LEFT JOIN users USING (user_id))
SELECT action, (CASE reason WHEN 'ok' THEN 200 WHEN 'Not authenticated' THEN 401 ELSE 403 END)::INT AS status, reason, count(*) AS n
FROM judged GROUP BY ALL""")
def gate_order(spark, sf):
    judged = access.gate_order(access_requests(spark, sf), users(spark, sf), "case:submit_for_review")
    return judged.groupBy("action", "status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("g8_transition_permitted", f"""
WITH {USERS}, requests AS (SELECT event_id, user_id, {sql_mapped("event_type", STATUS_OF_EVENT)} AS target_status FROM events)
SELECT event_id, target_status, CASE target_status
  WHEN 'in_progress' THEN role IS NOT NULL WHEN 'submitted_for_review' THEN coalesce(role IN ('admin', 'attorney'), false)
  ELSE coalesce(role IN ('admin', 'partner'), false) END AS permitted
FROM requests LEFT JOIN users USING (user_id)""")
def transition_permitted(spark, sf):
    requests = table(spark, sf, "events").select(
        "event_id", "user_id", mapped(F.col("event_type"), STATUS_OF_EVENT).alias("target_status"))
    return access.transition_permitted(requests, users(spark, sf)).select(
        "event_id", "target_status", "permitted")


@query("g9_available_actions", f"""
WITH {USERS}, {CASES}, {ASSIGNMENTS},
moves AS (SELECT * FROM (VALUES ('draft','in_progress'), ('in_progress','submitted_for_review'), ('submitted_for_review','under_review'),
  ('under_review','revisions_requested'), ('under_review','closed'), ('revisions_requested','in_progress')) AS t(status, target_status)),
may AS (SELECT * FROM (VALUES ('admin','in_progress'), ('partner','in_progress'), ('attorney','in_progress'), ('paralegal','in_progress'),
  ('admin','submitted_for_review'), ('attorney','submitted_for_review'), ('admin','under_review'), ('partner','under_review'),
  ('admin','revisions_requested'), ('partner','revisions_requested'), ('admin','closed'), ('partner','closed')) AS t(role, target_status))
SELECT user_id, case_id, status, target_status FROM assignments JOIN users USING (user_id) JOIN cases USING (case_id)
JOIN moves USING (status) JOIN may USING (role, target_status)
WHERE NOT (status = 'submitted_for_review' AND target_status = 'under_review' AND role IN ('admin', 'partner'))""")
def available_actions(spark, sf):
    pairs = assignments(spark, sf).join(users(spark, sf), "user_id").join(cases(spark, sf), "case_id")
    return access.available_actions(pairs).select("user_id", "case_id", "status", "target_status")


_ASSIGN_REQUESTS = """assign_requests AS (
  SELECT e.event_id AS request_id, e.user_id * 11 AS user_id, (e.user_id * 11 + (json_extract(props, '$.k'))::BIGINT) * 2 AS case_id FROM events e)"""


@query("g10_assign_batch", f"""
WITH {USERS}, {CASES}, {ASSIGNMENTS}, {_ASSIGN_REQUESTS},
facts AS (SELECT r.*, role, c.case_id IS NOT NULL AS there, a.user_id IS NOT NULL AS assigned,
    row_number() OVER (PARTITION BY r.user_id, r.case_id ORDER BY request_id) AS nth
  FROM assign_requests r LEFT JOIN users u USING (user_id) LEFT JOIN cases c ON c.case_id = r.case_id
  LEFT JOIN (SELECT DISTINCT * FROM assignments) a ON a.user_id = r.user_id AND a.case_id = r.case_id)
SELECT request_id, user_id, case_id, (CASE WHEN NOT there THEN 404 WHEN role IS NULL THEN 404 WHEN role NOT IN ('attorney', 'paralegal') THEN 400
  WHEN assigned OR nth > 1 THEN 409 ELSE 201 END)::INT AS status FROM facts""")
def assign_batch(spark, sf):
    requests = table(spark, sf, "events").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") * 11).alias("user_id"),
        ((F.col("user_id") * 11 + F.get_json_object("props", "$.k").cast("bigint")) * 2)
        .alias("case_id"))
    judged = access.assign_batch(requests, users(spark, sf), cases(spark, sf), assignments(spark, sf))
    return judged.select("request_id", "user_id", "case_id", "status")


@query("g11_assignable_users", f"""
WITH {USERS} SELECT user_id, role FROM users WHERE role IN ('attorney', 'paralegal')""")
def assignable(spark, sf):
    return access.assignable_users(users(spark, sf)).select("user_id", "role")


# A signup opens the session "<user>"; every event uses the session of its user or of a neighbour.
@query("g12_session_validity", f"""
WITH {USERS}, sessions AS (
  SELECT 's' || user_id AS session_id, user_id * 20 AS user_id, max(ts) + INTERVAL 24 HOURS AS expires_at
  FROM events WHERE event_type = 'signup' GROUP BY user_id),
requests AS (SELECT event_id, 's' || (user_id + (event_id % 3)) AS session_id, ts AS now FROM events)
SELECT event_id, r.session_id, CASE WHEN expires_at IS NULL THEN 'Session not found' WHEN now > expires_at THEN 'Session expired'
  WHEN u.user_id IS NULL THEN 'User not found' ELSE 'ok' END AS reason,
  (CASE WHEN expires_at IS NULL OR now > expires_at OR u.user_id IS NULL THEN 401 ELSE 200 END)::INT AS status
FROM requests r LEFT JOIN sessions s ON s.session_id = r.session_id LEFT JOIN users u ON u.user_id = s.user_id""")
def session_validity(spark, sf):
    events = table(spark, sf, "events")
    name = lambda c: F.concat(F.lit("s"), c.cast("string")).alias("session_id")
    sessions = events.where(F.col("event_type") == "signup").groupBy("user_id").agg(
        F.max("ts").alias("ts")).select(
        name(F.col("user_id")), (F.col("user_id") * 20).alias("user_id"),
        access.session_expiry(F.col("ts")).alias("expires_at"))
    requests = events.select(
        "event_id", name(F.col("user_id") + F.col("event_id") % 3), F.col("ts").alias("now"))
    return access.session_validity(requests, sessions, users(spark, sf)).select(
        "event_id", "session_id", "reason", "status")


RATE_LIMIT_SQL = """
WITH RECURSIVE attempts AS (
  SELECT user_id AS client, event_id AS attempt_id, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
folded AS (
  SELECT client, attempt_id, n, true AS admitted, [us] AS recent FROM attempts WHERE n = 1
  UNION ALL
  SELECT client, attempt_id, n, len(young) < 5, CASE WHEN len(young) < 5 THEN list_append(young, us) ELSE young END
  FROM (SELECT a.*, list_filter(f.recent, lambda t: a.us - t < 86400000000) AS young
        FROM folded f JOIN attempts a ON a.client = f.client AND a.n = f.n + 1))
SELECT client, attempt_id, admitted FROM folded"""


@query("g13_admit_rate_limited", RATE_LIMIT_SQL)
def rate_limit(spark, sf):
    attempts = table(spark, sf, "events").select(
        F.col("user_id").alias("client"), F.col("event_id").alias("attempt_id"), "ts")
    return access.admit_rate_limited(attempts, 24 * 3600, 5).select("client", "attempt_id", "admitted")


@query("g14_visible_documents", f"""
WITH {USERS}, {ASSIGNMENTS}, {CASE_DOCUMENTS}
SELECT user_id, case_id, document_id, count(*) AS n FROM users JOIN (SELECT DISTINCT * FROM assignments) USING (user_id)
JOIN case_documents USING (case_id) WHERE role NOT IN ('admin', 'partner') GROUP BY ALL""")
def visible_documents(spark, sf):
    found = access.visible_documents(users(spark, sf), case_documents(spark, sf), assignments(spark, sf))
    return found.groupBy("user_id", "case_id", "document_id").agg(F.count(F.lit(1)).alias("n"))


@query("g14_visible_document_counts", f"""
WITH {USERS}, {ASSIGNMENTS}, {CASE_DOCUMENTS},
own AS (SELECT user_id, count(*) AS n FROM (SELECT DISTINCT * FROM assignments) JOIN case_documents USING (case_id) GROUP BY user_id)
SELECT user_id, (CASE WHEN role IN ('admin', 'partner') THEN (SELECT count(*) FROM case_documents) ELSE coalesce(n, 0) END)::BIGINT AS n_documents
FROM users LEFT JOIN own USING (user_id)""")
def visible_document_counts(spark, sf):
    return access.visible_document_counts(users(spark, sf), case_documents(spark, sf),
                                          assignments(spark, sf))
