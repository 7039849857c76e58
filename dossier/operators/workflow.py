"""Case status rules, review rounds and feedback threads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.operators.ordered import Machine, number_rows, replay
from dossier.schemas import CASE_STATUSES, NEXT_STATUSES, STATUS_LABELS
from dossier.session import materialise


def can_transition(current: Column, target: Column) -> Column:
    allowed = F.lit(False)
    for status, following in NEXT_STATUSES.items():
        if following:
            allowed = allowed | ((current == status) & target.isin(following))
    return F.coalesce(allowed, F.lit(False))


def allowed_next(current: Column) -> Column:
    """Next statuses in table order; an empty array for a terminal or unknown status."""
    options = F.array().cast("array<string>")
    for status, following in NEXT_STATUSES.items():
        listed = F.array(*[F.lit(s) for s in following]).cast("array<string>")
        options = F.when(current == status, listed).otherwise(options)
    return options


def rejection_message(current: Column, target: Column) -> Column:
    options = allowed_next(current)
    shown = F.when(F.size(options) == 0, F.lit("none (terminal state)")).otherwise(
        F.concat(F.lit("['"), F.array_join(options, "', '"), F.lit("']"))
    )
    return F.concat(
        F.lit("Cannot transition case from '"), current, F.lit("' to '"), target,
        F.lit("'. Allowed transitions from '"), current, F.lit("': "), shown,
    )


def status_label(status: Column) -> Column:
    label = F.lit(None).cast("string")
    for value, text in STATUS_LABELS.items():
        label = F.when(status == value, F.lit(text)).otherwise(label)
    return label


def transition_valid(requests: DataFrame) -> DataFrame:
    """Requests (status, target_status) with `legal` and the message of a refusal."""
    legal = can_transition(F.col("status"), F.col("target_status"))
    return requests.withColumn("legal", legal).withColumn(
        "message",
        F.when(~F.col("legal"), rejection_message(F.col("status"), F.col("target_status"))),
    )


def move(state: str, values: tuple) -> tuple[str, tuple]:
    """One request against the state machine: next state, and (state before, accepted)."""
    target = values[0]
    accepted = target in NEXT_STATUSES.get(state, [])
    return (target if accepted else state), (state, accepted)


def replay_transitions(events: DataFrame, order: list[str], initial: str = "draft") -> DataFrame:
    """Requests per case in order; a refused one leaves the state as it is."""
    machine = Machine(CASE_STATUSES, initial, CASE_STATUSES, lambda state, target: move(state, (target,))[0])
    states = F.array(*[F.lit(s) for s in CASE_STATUSES])
    replayed = replay(events, ["case_id"], order, machine, "target_status", "_before", "_after").withColumn(
        "status", states[F.col("_before")]).drop("_before", "_after")
    accepted = can_transition(F.col("status"), F.col("target_status"))
    message = F.when(~accepted, rejection_message(F.col("status"), F.col("target_status")))
    return replayed.withColumn("accepted", accepted).withColumn("message", message)


# --- reviews ------------------------------------------------------------------------------


@dataclass(frozen=True)
class OpenedReviews:
    verdicts: DataFrame
    reviews: DataFrame
    feedback: DataFrame
    statuses: DataFrame  # case_id, status


def open_reviews(requests: DataFrame, cases: DataFrame) -> OpenedReviews:
    """Review requests (request_id, case_id, reviewer_id, content, created_at).

    A case takes one review at a time: of several requests the lowest request_id counts. The
    request id serves as the id of the new review and of its root comment.
    """
    firsts = requests.groupBy("case_id").agg(F.min("request_id").alias("request_id")).select(
        "request_id", F.lit(True).alias("_first"))
    facts = (
        requests.join(cases.select("case_id", "status"), "case_id", "left")
        .join(firsts, "request_id", "left")
    )
    legal = can_transition(F.col("status"), F.lit("under_review"))
    now = F.when(legal & F.col("_first").isNull(), F.lit("under_review")).otherwise(F.col("status"))
    verdict = (
        F.when(F.col("status").isNull(), F.lit(404))
        .when(~legal | F.col("_first").isNull(), F.lit(409))
        .otherwise(F.lit(201))
    )
    verdicts = facts.select(
        *requests.columns, F.col("status").alias("case_status"), verdict.alias("verdict"),
        F.when(verdict == 409, rejection_message(now, F.lit("under_review"))).alias("message"),
    )
    opened = verdicts.where(F.col("verdict") == 201)
    return OpenedReviews(
        verdicts,
        opened.select(F.col("request_id").alias("review_id"), "case_id", "reviewer_id",
                      "created_at", F.lit(None).cast("string").alias("comments")),
        opened.select(F.col("request_id").alias("feedback_id"),
                      F.col("request_id").alias("review_id"),
                      F.col("reviewer_id").alias("author_id"),
                      F.lit(None).cast("bigint").alias("parent_id"), "content", "created_at",
                      F.lit(False).alias("resolved")),
        opened.select("case_id", F.lit("under_review").alias("status")),
    )


@dataclass(frozen=True)
class Rights:
    """Who may respond to reviews is found from these."""

    users: DataFrame
    cases: DataFrame
    assignments: DataFrame


def _feedback_verdict(requests: DataFrame, id_column: str, feedback: DataFrame,
                      reviews: DataFrame, rights: Rights | None) -> DataFrame:
    """With rights, requests have a user_id, and the right to respond to the case comes before the comment."""
    target = feedback.select(F.col("feedback_id").alias(id_column), "review_id")
    owner = reviews.select("review_id", F.col("case_id").alias("_owner"))
    asked = requests
    if rights is not None:
        from dossier.operators.access import access_verdict  # which uses the rules above

        judged = access_verdict(requests.withColumn("action", F.lit("respond")), rights.users, rights.cases, rights.assignments)
        asked = judged.select(*requests.columns, F.col("status").alias("_status"), F.col("reason").alias("_reason"))
    facts = asked.join(target, id_column, "left").join(owner, "review_id", "left")
    status = (
        F.when(F.col("review_id").isNull(), F.lit(404))
        .when(~F.col("_owner").eqNullSafe(F.col("case_id")), F.lit(400))
        .otherwise(F.lit(201))
    )
    reason = (
        F.when(status == 404, F.lit("Feedback not found"))
        .when(status == 400, F.lit("Feedback does not belong to this case"))
        .otherwise(F.lit("ok"))
    )
    if rights is not None:
        refused = F.col("_status") != 200
        status, reason = F.when(refused, F.col("_status")).otherwise(status), F.when(refused, F.col("_reason")).otherwise(reason)
    return facts.select(*requests.columns, "review_id", status.alias("verdict"),
                        reason.alias("reason"))


def reply_verdict(replies: DataFrame, feedback: DataFrame, reviews: DataFrame, rights: Rights | None = None) -> DataFrame:
    """Replies (case_id, parent_id, ...) with their verdict and the review they inherit."""
    return _feedback_verdict(replies, "parent_id", feedback, reviews, rights)


def resolve_verdict(requests: DataFrame, feedback: DataFrame, reviews: DataFrame, rights: Rights | None = None) -> DataFrame:
    checked = _feedback_verdict(requests, "feedback_id", feedback, reviews, rights)
    return checked.withColumn(
        "verdict", F.when(F.col("verdict") == 201, F.lit(200)).otherwise(F.col("verdict")))


def resolve_feedback(requests: DataFrame, feedback: DataFrame, reviews: DataFrame, rights: Rights | None = None) -> DataFrame:
    """The feedback table after the accepted requests have marked their rows resolved."""
    done = (
        resolve_verdict(requests, feedback, reviews, rights).where(F.col("verdict") == 200)
        .select("feedback_id").distinct().withColumn("_done", F.lit(True))
    )
    return feedback.join(done, "feedback_id", "left").withColumn(
        "resolved", F.coalesce("_done", F.col("resolved"))).drop("_done")


def reviews_of_cases(reviews: DataFrame, cases: DataFrame) -> DataFrame:
    return reviews.join(cases.select("case_id").distinct(), "case_id", "left_semi")


def feedback_of_cases(feedback: DataFrame, reviews: DataFrame) -> DataFrame:
    """Feedback with the case of its review."""
    return feedback.join(reviews.select("review_id", "case_id"), "review_id")


def _climb(nodes: DataFrame, paths: bool) -> DataFrame:
    """Every comment that hangs on a root, with its depth and root, and with `path` from the root down.

    Pointers double: in each round a row takes over the pointer of the row it points to, so the
    rounds grow with the logarithm of the deepest thread. Each round is written before the next. A
    row whose pointer finds no row hangs on an orphan and goes. Rows on a cycle are known by a
    path that meets them again, or without paths by still climbing when any thread would have ended.
    """
    rows = materialise(nodes.select(
        "feedback_id", "review_id", F.col("parent_id").alias("jump"),
        F.when(F.col("parent_id").isNull(), F.col("feedback_id")).alias("root_id"), F.lit(0).cast("bigint").alias("depth"),
        *([F.array("feedback_id").alias("path")] if paths else [])))
    limit, rounds = max(1, rows.count()).bit_length() + 1, 0
    while rounds < limit and rows.where(F.col("jump").isNotNull()).head() is not None:
        above = rows.select(
            F.col("feedback_id").alias("jump"), "review_id", F.col("jump").alias("_jump"), F.col("root_id").alias("_root"),
            F.col("depth").alias("_depth"), *([F.col("path").alias("_path")] if paths else []))
        climbing = rows.where(F.col("jump").isNotNull()).join(above, ["review_id", "jump"])
        if paths:
            climbing = climbing.where(~F.array_contains("_path", F.col("feedback_id")))
        step = F.lit(1 << rounds).cast("bigint")  # each pointer still on its way spans that many rows
        climbing = climbing.select(
            "feedback_id", "review_id", F.col("_jump").alias("jump"), F.col("_root").alias("root_id"),
            (F.col("_depth") + step).alias("depth"), *([F.concat("_path", "path").alias("path")] if paths else []))
        rows = materialise(rows.where(F.col("jump").isNull()).unionByName(climbing))
        rounds += 1
    return rows.where(F.col("jump").isNull()).drop("jump")


def thread_depths(feedback: DataFrame) -> DataFrame:
    """feedback_id, review_id, root_id and depth of every reachable comment, for threads of any depth."""
    return _climb(feedback, paths=False)


def thread_tree(feedback: DataFrame) -> DataFrame:
    """Depth, path from the root, and depth-first position of every reachable comment.

    What is never reached hangs on an orphan or on a cycle.
    """
    found = _climb(feedback, paths=True).select("feedback_id", "review_id", F.col("depth").cast("int").alias("depth"), "path")
    return number_rows(found, ["review_id"], ["path"], "position")


def unreachable(feedback: DataFrame) -> DataFrame:
    """Comments that hang on no root: `orphan` for those below a missing parent, `cycle` for those on or below a cycle."""
    key = ["feedback_id", "review_id"]
    nodes = materialise(feedback)
    lost = nodes.join(thread_depths(nodes).select(*key), key, "left_anti")
    orphans = orphan_check(nodes).select(*key, F.lit(True).alias("_orphan"))
    # With orphans as roots, only what leads to a cycle stays out of reach.
    as_roots = lost.join(orphans, key, "left").withColumn("parent_id", F.when(F.col("_orphan").isNull(), F.col("parent_id")))
    below = thread_depths(as_roots).select(*key, F.lit("orphan").alias("reason"))
    return lost.join(below, key, "left").withColumn("reason", F.coalesce("reason", F.lit("cycle")))


def orphan_check(feedback: DataFrame) -> DataFrame:
    """Replies whose parent does not exist in the same review."""
    parents = feedback.select(F.col("feedback_id").alias("parent_id"), "review_id")
    return feedback.where(F.col("parent_id").isNotNull()).join(
        parents, ["parent_id", "review_id"], "left_anti")


def patch_cases(cases: DataFrame, patches: DataFrame) -> DataFrame:
    """Cases with the non-null fields of their patch (one patch per case) put in place."""
    changed = patches.select("case_id", F.col("title").alias("_title"),
                             F.col("description").alias("_description"))
    return cases.join(changed, "case_id", "left").withColumn(
        "title", F.coalesce("_title", "title")
    ).withColumn("description", F.coalesce("_description", "description")).drop(
        "_title", "_description")
