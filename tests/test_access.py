"""Roles, requests, assignments and sessions."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from dossier.operators import access, workflow
from dossier.schemas import CASE_STATUSES, NEXT_STATUSES, PERMISSIONS_FOR_TARGET, PERMISSIONS_OF_ROLE, ROLES
from dossier.sources.files import lookup

USERS = [(1, "admin", False), (2, "partner", False), (3, "attorney", False), (4, "paralegal", True), (5, "attorney", False)]
CASES = [(10, "A", None, "draft"), (11, "B", "b", "submitted_for_review"), (12, "C", None, "closed")]
EDGES = [(3, 10), (3, 10), (4, 11), (3, 12)]


@pytest.fixture
def world(frame):
    return (frame(USERS, "user_id bigint, role string, must_change_password boolean"),
            frame(CASES, "case_id bigint, title string, description string, status string"),
            frame(EDGES, "user_id bigint, case_id bigint"))


def test_scope(world):
    users, _, edges = world
    found = access.resolve_scope(users, edges)
    assert {(r["user_id"], r["all_cases"], r["n_cases"]) for r in found.users.collect()} == {
        (1, True, 0), (2, True, 0), (3, False, 2), (4, False, 1), (5, False, 0)}
    assert {tuple(r) for r in found.edges.collect()} == {(3, 10), (3, 12), (4, 11)}


def test_everything_and_nothing_read_differently(value):
    assert value(access.scope_label(F.lit(True), F.lit(0))) == "all cases"
    assert value(access.scope_label(F.lit(False), F.lit(0))) == "0 case(s)"


def test_matrix(spark):
    held = {(r["role"], r["permission"]) for r in access.role_permissions(spark).collect()}
    assert len(held) == 24 and ("attorney", "case:submit_for_review") in held
    assert ("partner", "case:submit_for_review") not in held and ("partner", "case:delete") not in held


def test_case_lists(world):
    users, cases, edges = world
    ids = lambda u: {r["case_id"] for r in access.cases_visible_to(u, users, cases, edges).collect()}
    assert [ids(u) for u in (1, 2, 3, 4, 5, 99)] == [{10, 11, 12}, {10, 11, 12}, {10, 12}, {11}, set(), set()]
    counts = {r["user_id"]: r["n_visible"] for r in access.visible_counts(users, cases, edges).collect()}
    assert counts == {1: 3, 2: 3, 3: 2, 4: 1, 5: 0}
    assert {(r["user_id"], r["case_id"]) for r in access.visible_cases(users, cases, edges).collect()} == {
        (3, 10), (3, 12), (4, 11)}


@pytest.mark.parametrize("action", ["read", "edit", "respond", "documents"])
def test_verdicts(frame, world, action):
    users, cases, edges = world
    asked = [(1, 10), (1, 99), (2, 12), (3, 10), (3, 11), (5, 10), (5, 99), (98, 10)]
    requests = frame([(*a, action) for a in asked], "user_id bigint, case_id bigint, action string")
    got = {(r["user_id"], r["case_id"]): (r["status"], r["reason"])
           for r in access.access_verdict(requests, users, cases, edges).collect()}
    not_assigned = (403, "You are not assigned to this case")
    assert got == {(1, 10): (200, "ok"), (1, 99): (404, "Case not found"), (2, 12): (200, "ok"), (3, 10): (200, "ok"),
                   (3, 11): not_assigned, (5, 10): not_assigned, (5, 99): (404, "Case not found"),
                   (98, 10): (403, "Not permitted")}


def test_gate_order(frame, world):
    requests = frame([(1,), (3,), (4,), (99,)], "user_id bigint")
    got = {r["user_id"]: (r["status"], r["reason"])
           for r in access.gate_order(requests, world[0], "case:create").collect()}
    assert got == {1: (200, "ok"), 3: (403, "Not permitted"), 4: (403, "Password change required"),
                   99: (401, "Not authenticated")}


def test_transition_permissions(frame, world):
    requests = frame([(u, t) for u in (1, 2, 3, 4) for t in CASE_STATUSES], "user_id bigint, target_status string")
    got = {(r["role"], r["target_status"]) for r in access.transition_permitted(requests, world[0]).collect()
           if not r["permitted"]}
    assert got == {("partner", "submitted_for_review"), ("paralegal", "submitted_for_review"),
                   *[(r, t) for r in ("attorney", "paralegal") for t in ("under_review", "revisions_requested", "closed")]}


def test_all_status_pairs(frame):
    pairs = frame([(a, b) for a in CASE_STATUSES for b in CASE_STATUSES], "status string, target_status string")
    legal = {(r["status"], r["target_status"]) for r in workflow.transition_valid(pairs).collect() if r["legal"]}
    assert legal == {(a, b) for a, bs in NEXT_STATUSES.items() for b in bs}


def test_offered_actions(frame):
    rows = frame([(r, s) for r in ROLES for s in CASE_STATUSES], "role string, status string")
    got = {(r["role"], r["status"], r["target_status"]) for r in access.available_actions(rows).collect()}
    assert ("partner", "submitted_for_review", "under_review") not in got
    assert ("attorney", "in_progress", "submitted_for_review") in got
    assert ("partner", "in_progress", "submitted_for_review") not in got
    assert {t for r, s, t in got if (r, s) == ("partner", "under_review")} == {"revisions_requested", "closed"}
    assert not [g for g in got if g[1] == "closed"]


def test_assignments(frame, world):
    requests = frame([(1, 99, 3), (2, 10, 77), (3, 10, 2), (4, 10, 3), (5, 11, 5), (6, 11, 5), (7, 12, 4)],
                     "request_id bigint, case_id bigint, user_id bigint")
    got = {r["request_id"]: (r["status"], r["reason"])
           for r in access.assign_batch(requests, world[0], world[1], world[2]).collect()}
    taken = (409, "User is already assigned to this case")
    assert got == {1: (404, "Case not found"), 2: (404, "User not found"),
                   3: (400, "Only attorneys and paralegals can be assigned to a case"), 4: taken,
                   5: (201, "ok"), 6: taken, 7: (201, "ok")}


def test_sessions(frame, world):
    now = datetime(2024, 5, 1, 12)
    sessions = frame([("old", 3, now - timedelta(seconds=1)), ("edge", 3, now), ("orphan", 99, now + timedelta(1))],
                     "session_id string, user_id bigint, expires_at timestamp_ntz")
    requests = frame([(s, now) for s in ("none", "old", "edge", "orphan")], "session_id string, now timestamp_ntz")
    judged = access.session_validity(requests, sessions, world[0])
    assert {r["session_id"]: r["reason"] for r in judged.collect()} == {
        "none": "Session not found", "old": "Session expired", "edge": "ok", "orphan": "User not found"}
    assert [r[0] for r in access.expired_sessions(judged).collect()] == ["old"]


def test_lookup_keeps_misses(frame, world):
    got = lookup(frame([(3,), (50,)], "user_id bigint"), world[0], "user_id").collect()
    assert {(r["user_id"], r["found"], r["role"]) for r in got} == {(3, True, "attorney"), (50, False, None)}


# --- reviews and threads ------------------------------------------------------------------


def test_open_reviews(frame, world):
    requests = frame([(1, 11, 2, "first"), (2, 11, 1, "again"), (3, 10, 2, "early"), (4, 99, 2, "none")],
                     "request_id bigint, case_id bigint, reviewer_id bigint, content string").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    opened = workflow.open_reviews(requests, world[1])
    verdicts = {r["request_id"]: (r["verdict"], r["message"]) for r in opened.verdicts.collect()}
    assert verdicts[1] == (201, None) and verdicts[4] == (404, None)
    assert verdicts[2][0] == 409 and "from 'under_review' to 'under_review'" in verdicts[2][1]
    assert verdicts[3][0] == 409 and "from 'draft'" in verdicts[3][1]
    root = opened.feedback.head()
    assert (root["review_id"], root["parent_id"], root["content"], root["resolved"]) == (1, None, "first", False)
    assert [tuple(r) for r in opened.statuses.collect()] == [(11, "under_review")]


FEEDBACK = [(1, 1, None), (2, 1, 1), (3, 1, 1), (4, 1, 2), (5, 2, None), (6, 2, 4), (7, 1, 77), (10, 1, 2)]
REVIEWS = [(1, 10), (2, 11)]


@pytest.fixture
def threads(frame):
    feedback = frame(FEEDBACK, "feedback_id bigint, review_id bigint, parent_id bigint").withColumn("resolved", F.lit(False))
    return feedback, frame(REVIEWS, "review_id bigint, case_id bigint")


def test_reply_verdicts(frame, threads):
    replies = frame([(10, 1), (11, 1), (10, 99)], "case_id bigint, parent_id bigint")
    got = {(r["case_id"], r["parent_id"]): (r["verdict"], r["review_id"]) for r in workflow.reply_verdict(replies, *threads).collect()}
    assert got == {(10, 1): (201, 1), (11, 1): (400, 1), (10, 99): (404, None)}


def test_resolve(frame, threads):
    requests = frame([(10, 2), (10, 2), (11, 3), (10, 99)], "case_id bigint, feedback_id bigint")
    done = workflow.resolve_feedback(requests, *threads)
    assert [r["feedback_id"] for r in done.where("resolved").collect()] == [2] and done.count() == len(FEEDBACK)


def test_rights_come_before_the_comment(frame, world, threads):
    """Absent case, user without assignment, user who may edit any case, unknown user."""
    rights = workflow.Rights(world[0], world[1], world[2])
    allowed = {(r["user_id"], r["case_id"]): (r["status"], r["reason"]) for r in access.access_verdict(
        frame([(u, c, "respond") for u in range(1, 6) for c in (10, 11, 99)], "user_id bigint, case_id bigint, action string"), *world[:3]).collect()}
    asked = [(u, c, p) for u, c in allowed for p in (1, 5, 99)]
    own = {1: 10, 5: 11}
    got = {(r["user_id"], r["case_id"], r["parent_id"]): (r["verdict"], r["reason"]) for r in workflow.reply_verdict(
        frame(asked, "user_id bigint, case_id bigint, parent_id bigint"), *threads, rights).collect()}
    for (u, c, p), verdict in got.items():
        if allowed[u, c][0] != 200:
            assert verdict == allowed[u, c]
        elif p == 99:
            assert verdict == (404, "Feedback not found")
        else:
            assert verdict[0] == (201 if own[p] == c else 400)
    assert {v[0] for v in got.values()} >= {201, 400, 403, 404}
    done = workflow.resolve_feedback(frame([(u, 10, 2) for u in range(1, 6) if allowed[u, 10][0] != 200], "user_id bigint, case_id bigint, feedback_id bigint"), *threads, rights)
    assert done.where("resolved").count() == 0


def test_upload_review_and_transition(frame, world):
    """Every action of every user on a case, with the target of the move."""
    rows = [(u, c, a, t) for u in range(1, 7) for c in (10, 11, 99) for a, t in
            [("upload", None), ("review", None), ("transition", "in_progress"), ("transition", "under_review"), ("transition", "nowhere"), ("transition", None), ("delete", None)]]
    got = {(r["user_id"], r["case_id"], r["action"], r["target_status"]): (r["status"], r["reason"]) for r in access.access_verdict(
        frame(rows, "user_id bigint, case_id bigint, action string, target_status string"), *world[:3]).collect()}
    roles = {r["user_id"]: r["role"] for r in world[0].collect()}
    state = {r["case_id"]: r["status"] for r in world[1].collect()}
    assigned = {(r["user_id"], r["case_id"]) for r in world[2].collect()}
    for (u, c, action, target), (status, reason) in got.items():
        held = set(PERMISSIONS_OF_ROLE.get(roles.get(u), []))
        door = {"upload": held & {"case:edit:any", "case:edit:assigned"}, "review": held & {"case:review"}, "delete": set(),
                "transition": held & set(PERMISSIONS_FOR_TARGET.get(target, held)) if target or held else set()}[action]
        goal = "under_review" if action == "review" else target
        if not door:
            assert (status, reason) == (403, "Not permitted"), (u, c, action, target)
        elif c not in state:
            assert (status, reason) == (404, "Case not found")
        elif action != "review" and "case:read:any" not in held and (u, c) not in assigned:
            assert (status, reason) == (403, "You are not assigned to this case")
        elif action != "upload" and goal not in NEXT_STATUSES[state[c]]:
            assert status == 409 and (f"to '{goal}'" in reason or goal is None)
        else:
            assert (status, reason) == (200, "ok")
    assert {s for s, _ in got.values()} == {200, 403, 404, 409}


def test_thread_order(threads):
    got = workflow.thread_tree(threads[0]).orderBy("review_id", "position").collect()
    assert [(r["review_id"], r["feedback_id"], r["depth"], r["position"]) for r in got] == [
        (1, 1, 0, 0), (1, 2, 1, 1), (1, 4, 2, 2), (1, 10, 2, 3), (1, 3, 1, 4), (2, 5, 0, 0)]


def test_deep_thread(frame):
    rows = frame([(i, 1, i - 1 if i else None) for i in range(12)], "feedback_id bigint, review_id bigint, parent_id bigint")
    assert [r["depth"] for r in workflow.thread_tree(rows).orderBy("position").collect()] == list(range(12))


def test_ten_thousand_levels_in_few_rounds(spark, monkeypatch):
    rows = spark.range(10_000).selectExpr("id AS feedback_id", "1L AS review_id", "CASE WHEN id > 0 THEN id - 1 END AS parent_id")
    rounds, write = [], workflow.materialise
    monkeypatch.setattr(workflow, "materialise", lambda df: rounds.append(1) or write(df))
    got = workflow.thread_depths(rows)
    assert len(rounds) <= 1 + 15
    assert got.where("depth = feedback_id AND root_id = 0").count() == 10_000


def test_cycles_and_orphans_are_never_reached(frame):
    parents = {1: None, 2: 1, 3: 2, 10: 11, 11: 12, 12: 10, 13: 12, 14: 13, 20: 20, 21: 20, 30: 99, 31: 30, 32: 31}
    rows = frame([(i, 1, p) for i, p in parents.items()] + [(30, 2, None), (99, 2, 30)], "feedback_id bigint, review_id bigint, parent_id bigint")
    assert {(r["review_id"], r["feedback_id"], r["depth"]) for r in workflow.thread_tree(rows).collect()} == {
        (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 30, 0), (2, 99, 1)}
    assert {(r["review_id"], r["feedback_id"], r["root_id"]) for r in workflow.thread_depths(rows).collect()} == {
        (1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 30, 30), (2, 99, 30)}
    assert {(r["feedback_id"], r["reason"]) for r in workflow.unreachable(rows).collect()} == {
        *[(i, "cycle") for i in (10, 11, 12, 13, 14, 20, 21)], (30, "orphan"), (31, "orphan"), (32, "orphan")}
    assert workflow.unreachable(rows.limit(0)).count() == 0


def test_orphans(threads):
    assert {r["feedback_id"] for r in workflow.orphan_check(threads[0]).collect()} == {6, 7}


def test_patch(frame, world):
    patches = frame([(10, "New", None), (11, None, "text")], "case_id bigint, title string, description string")
    got = {r["case_id"]: (r["title"], r["description"]) for r in workflow.patch_cases(world[1], patches).collect()}
    assert got == {10: ("New", None), 11: ("B", "text"), 12: ("C", None)}
