"""Roles, permissions, assignments, and the verdicts that follow from them.

"May see everything" is a flag of the role and is never spelled out as rows: a user who may read
any case has one scope row, however many cases there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.operators.ordered import Fold, ordered_fold
from dossier.operators.workflow import can_transition, rejection_message
from dossier.schemas import (
    ASSIGNABLE_ROLES, NEXT_STATUSES, PERMISSIONS_FOR_TARGET, PERMISSIONS_OF_ROLE,
    RATE_LIMIT_ATTEMPTS, RATE_LIMIT_SECONDS, SESSION_HOURS,
)


def role_permissions(spark: SparkSession) -> DataFrame:
    """The permission matrix as rows (role, permission)."""
    rows = ", ".join(f"('{r}', '{p}')" for r, held in PERMISSIONS_OF_ROLE.items() for p in held)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(role, permission)")


def roles_holding(*permissions: str) -> list[str]:
    return [r for r, held in PERMISSIONS_OF_ROLE.items() if set(held) & set(permissions)]


def has_any_permission(role: Column, *permissions: str) -> Column:
    """The role holds at least one of the permissions (false for an unknown role)."""
    holding = roles_holding(*permissions)
    return F.coalesce(role.isin(holding), F.lit(False)) if holding else F.lit(False)


def reads_any(role: Column) -> Column:
    return has_any_permission(role, "case:read:any")


@dataclass(frozen=True)
class Scopes:
    """What each user may read: a flag per user, and (user, case) rows for the others."""

    users: DataFrame  # user_id, all_cases, n_cases (0 where all_cases)
    edges: DataFrame  # user_id, case_id; distinct, only users without the flag


def resolve_scope(users: DataFrame, assignments: DataFrame) -> Scopes:
    flagged = users.select("user_id", reads_any(F.col("role")).alias("all_cases"))
    edges = (
        assignments.select("user_id", "case_id").distinct()
        .join(flagged.where(~F.col("all_cases")).select("user_id"), "user_id", "left_semi")
    )
    counts = edges.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_cases"))
    scopes = flagged.join(counts, "user_id", "left").select(
        "user_id", "all_cases", F.coalesce("n_cases", F.lit(0)).cast("bigint").alias("n_cases")
    )
    return Scopes(scopes, edges)


def scope_label(all_cases: Column, n_cases: Column) -> Column:
    return F.when(all_cases, F.lit("all cases")).otherwise(
        F.concat(n_cases.cast("string"), F.lit(" case(s)"))
    )


def is_assigned(pairs: DataFrame, assignments: DataFrame) -> DataFrame:
    """The pairs with a flag telling whether the assignment exists."""
    edges = assignments.select("user_id", "case_id").distinct().withColumn("_edge", F.lit(True))
    return (
        pairs.join(edges, ["user_id", "case_id"], "left")
        .withColumn("assigned", F.coalesce("_edge", F.lit(False))).drop("_edge")
    )


def cases_of_users(assignments: DataFrame) -> DataFrame:
    """Distinct (user, case) rows; the list of a user is its rows in case order."""
    return assignments.select("user_id", "case_id").distinct()


def visible_cases(users: DataFrame, cases: DataFrame, assignments: DataFrame) -> DataFrame:
    """Cases of every user who reads assigned cases only, one row per visible case."""
    scopes = resolve_scope(users, assignments)
    return scopes.edges.join(cases, "case_id")


def cases_visible_to(user_id: int, users: DataFrame, cases: DataFrame,
                     assignments: DataFrame) -> DataFrame:
    """The case list of one user: every case, or the assigned ones."""
    flag = users.where(F.col("user_id") == user_id).select(reads_any(F.col("role")).alias("any"))
    row = flag.head()
    if row is None:
        return cases.limit(0)
    if row["any"]:
        return cases
    own = assignments.where(F.col("user_id") == user_id).select("case_id").distinct()
    return cases.join(own, "case_id", "left_semi")


def visible_counts(users: DataFrame, cases: DataFrame, assignments: DataFrame) -> DataFrame:
    """How many cases each user may see, and the sum of their ids, without listing them."""
    scopes = resolve_scope(users, assignments)
    listed = (
        scopes.edges.join(cases.select("case_id"), "case_id").groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("case_id").alias("s"))
    )
    n_all = cases.agg(F.count(F.lit(1))).scalar()
    sum_all = cases.agg(F.sum("case_id")).scalar()
    return scopes.users.join(listed, "user_id", "left").select(
        "user_id",
        F.when(F.col("all_cases"), n_all).otherwise(F.coalesce("n", F.lit(0)))
        .cast("bigint").alias("n_visible"),
        F.when(F.col("all_cases"), sum_all).otherwise(F.coalesce("s", F.lit(0)))
        .cast("bigint").alias("sum_case_id"),
    )


def visible_documents(users: DataFrame, documents: DataFrame, assignments: DataFrame) -> DataFrame:
    """Documents of the assigned cases, one row per (user, document)."""
    return resolve_scope(users, assignments).edges.join(documents, "case_id")


def visible_document_counts(users: DataFrame, documents: DataFrame,
                            assignments: DataFrame) -> DataFrame:
    """Documents each user may list; counted per case first, so no document is multiplied."""
    scopes = resolve_scope(users, assignments)
    per_case = documents.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_documents"))
    listed = scopes.edges.join(per_case, "case_id").groupBy("user_id").agg(
        F.sum("n_documents").alias("n"))
    n_all = documents.agg(F.count(F.lit(1))).scalar()
    return scopes.users.join(listed, "user_id", "left").select(
        "user_id",
        F.when(F.col("all_cases"), n_all).otherwise(F.coalesce("n", F.lit(0)))
        .cast("bigint").alias("n_documents"),
    )


# action -> (permissions that let it through the door, permission that needs no assignment)
_ACTIONS = {
    "read": (("case:read:any", "case:read:assigned"), "case:read:any"),
    "edit": (("case:edit:any", "case:edit:assigned"), "case:edit:any"),
    "respond": (("case:edit:any", "case:edit:assigned"), "case:edit:any"),
    "documents": (("case:read:any", "case:read:assigned"), "case:read:any"),
    "upload": (("case:edit:any", "case:edit:assigned"), "case:read:any"),
    "review": (("case:review",), "case:review"),
}


def _verdict(*rules: tuple[Column, int, str]) -> tuple[Column, Column]:
    """Status and reason of the first rule that applies; 200 and "ok" otherwise."""
    status, reason = None, None
    for condition, code, text in rules:
        hit = F.coalesce(condition, F.lit(False))
        status = (F if status is None else status).when(hit, F.lit(code))
        reason = (F if reason is None else reason).when(hit, F.lit(text))
    return status.otherwise(F.lit(200)), reason.otherwise(F.lit("ok"))


def access_verdict(requests: DataFrame, users: DataFrame, cases: DataFrame,
                   assignments: DataFrame) -> DataFrame:
    """Each (user, case, action) request with its status code and the rule behind it.

    The action `transition` moves the case to the request's `target_status`: the role must be
    allowed that target, the user must be able to read the case, and the move must be a legal one.
    A `review` moves it to under review.
    """
    role, action = F.col("role"), F.col("action")
    permitted, free = F.lit(False), F.lit(False)
    for name, (door, unassigned) in _ACTIONS.items():
        is_it = action == name
        permitted = permitted | (is_it & has_any_permission(role, *door))
        free = free | (is_it & has_any_permission(role, unassigned))
    asked = F.col("target_status") if "target_status" in requests.columns else F.lit(None).cast("string")
    moves = action == "transition"
    permitted = permitted | (moves & role.isNotNull() & may_target(role, asked))
    free = free | (moves & reads_any(role))
    target = F.when(moves, asked).when(action == "review", F.lit("under_review"))
    state = F.col("_state")
    held = F.col("status") if "status" in cases.columns else F.lit(None).cast("string")
    facts = (
        is_assigned(requests, assignments)
        .join(users.select("user_id", "role"), "user_id", "left")
        .join(cases.select("case_id", F.lit(True).alias("_exists"), held.alias("_state")), "case_id", "left")
    )
    status, reason = _verdict(
        (~permitted, 403, "Not permitted"),
        (F.col("_exists").isNull(), 404, "Case not found"),
        (~free & ~F.col("assigned"), 403, "You are not assigned to this case"),
        (action.isin("transition", "review") & ~can_transition(state, target), 409, ""),
    )
    told = F.when(status == 409, F.coalesce(rejection_message(state, target), F.lit("No target status"))).otherwise(reason)
    return facts.withColumn("status", status).withColumn("reason", told).drop("_exists", "_state")


def gate_order(requests: DataFrame, users: DataFrame, *required: str) -> DataFrame:
    """Authentication, then the password rule, then the permission, in this order."""
    facts = requests.join(users.select("user_id", "role", "must_change_password"), "user_id", "left")
    status, reason = _verdict(
        (F.col("role").isNull(), 401, "Not authenticated"),
        (F.col("must_change_password"), 403, "Password change required"),
        (~has_any_permission(F.col("role"), *required), 403, "Not permitted"),
    )
    return facts.withColumn("status", status).withColumn("reason", reason)


def may_target(role: Column, target: Column) -> Column:
    """The role may move a case to the target status; a status without an entry needs nothing."""
    needs = F.lit(False)
    for status, permissions in PERMISSIONS_FOR_TARGET.items():
        needs = needs | ((target == status) & ~has_any_permission(role, *permissions))
    return ~needs


def transition_permitted(requests: DataFrame, users: DataFrame) -> DataFrame:
    facts = requests.join(users.select("user_id", "role"), "user_id", "left")
    return facts.withColumn("permitted", may_target(F.col("role"), F.col("target_status")))


def available_actions(pairs: DataFrame) -> DataFrame:
    """Next statuses offered for each row with a role and a status.

    Those who may review open a review instead of moving a submitted case.
    """
    targets = F.lit(None).cast("array<string>")
    for status, following in NEXT_STATUSES.items():
        options = F.array(*[F.lit(s) for s in following]).cast("array<string>")
        targets = F.when(F.col("status") == status, options).otherwise(targets)
    offered = pairs.withColumn("target_status", F.explode(targets))
    opens_review = (
        (F.col("status") == "submitted_for_review") & (F.col("target_status") == "under_review")
        & has_any_permission(F.col("role"), "case:review")
    )
    return offered.where(
        may_target(F.col("role"), F.col("target_status")) & ~opens_review
        & can_transition(F.col("status"), F.col("target_status"))
    )


def assignable_users(users: DataFrame) -> DataFrame:
    return users.where(F.col("role").isin(ASSIGNABLE_ROLES))


def assign_batch(requests: DataFrame, users: DataFrame, cases: DataFrame,
                 assignments: DataFrame) -> DataFrame:
    """Assignment requests with their verdict; of equal requests the lowest request_id counts."""
    facts = (
        is_assigned(requests, assignments)
        .join(users.select("user_id", "role"), "user_id", "left")
        .join(cases.select("case_id", F.lit(True).alias("_exists")), "case_id", "left")
    )
    firsts = (
        requests.groupBy("user_id", "case_id").agg(F.min("request_id").alias("request_id"))
        .select("request_id", F.lit(True).alias("_first"))
    )
    facts = facts.join(firsts, "request_id", "left")
    status, reason = _verdict(
        (F.col("_exists").isNull(), 404, "Case not found"),
        (F.col("role").isNull(), 404, "User not found"),
        (~F.col("role").isin(ASSIGNABLE_ROLES), 400,
         "Only attorneys and paralegals can be assigned to a case"),
        (F.col("assigned") | F.col("_first").isNull(), 409,
         "User is already assigned to this case"),
    )
    status = F.when(status == 200, F.lit(201)).otherwise(status)
    return facts.withColumn("status", status).withColumn("reason", reason).drop("_exists", "_first")


def session_expiry(logged_in_at: Column) -> Column:
    return logged_in_at + F.expr(f"INTERVAL {SESSION_HOURS} HOURS")


def session_validity(requests: DataFrame, sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (session_id, now) with the outcome: valid, or what is wrong with the session."""
    facts = (
        requests.join(
            sessions.select("session_id", F.col("user_id"), "expires_at"), "session_id", "left")
        .join(users.select("user_id", F.lit(True).alias("_user")), "user_id", "left")
    )
    status, reason = _verdict(
        (F.col("expires_at").isNull(), 401, "Session not found"),
        (F.col("now") > F.col("expires_at"), 401, "Session expired"),
        (F.col("_user").isNull(), 401, "User not found"),
    )
    return facts.withColumn("status", status).withColumn("reason", reason).drop("_user")


def expired_sessions(verdicts: DataFrame) -> DataFrame:
    """Sessions to remove."""
    return verdicts.where(F.col("reason") == "Session expired").select("session_id").distinct()


def admit(recent: tuple, values: tuple, window: int, limit: int) -> tuple[tuple, tuple]:
    """One attempt of the sliding log: times of admitted attempts younger than the window."""
    now = values[0]
    young = tuple(t for t in recent if now - t < window)
    if len(young) >= limit:
        return young, (False,)
    return (*young, now), (True,)


def admit_rate_limited(attempts: DataFrame, window_seconds: int = RATE_LIMIT_SECONDS,
                       limit: int = RATE_LIMIT_ATTEMPTS, tie: str = "attempt_id") -> DataFrame:
    """Attempts (client, ts) with `admitted`; refused attempts do not count against the limit."""
    window = window_seconds * 1_000_000
    timed = attempts.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    fold = Fold(
        start=(),
        step=lambda recent, values: admit(recent, values, window, limit),
        inputs=["_us"],
        outputs=[T.StructField("admitted", T.BooleanType())],
        gap=("_us", window),  # nothing admitted that long ago counts any more
    )
    return ordered_fold(timed, ["client"], ["_us", tie], fold).drop("_us")
