"""Numbering and folds over keys of very different size."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.operators import access, ingestion, ordered, workflow
from dossier.operators.ordered import number_rows, range_blocks, running_totals, BLOCK
from dossier.schemas import CASE_STATUSES, NEXT_STATUSES

START = datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def several_blocks(spark):
    """Small inputs would be put into one block."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def skewed(n, rng, hot=0.6):
    """Keys of which one holds most rows."""
    return [("hot" if rng.random() < hot else f"k{rng.randrange(20)}") for _ in range(n)]


def test_blocks_split_a_hot_key(frame):
    rng = random.Random(1)
    rows = [(k, i) for i, k in enumerate(skewed(4000, rng))]
    blocks = range_blocks(frame(rows, "k string, i int"), ["k"], ["i"])
    per_block = blocks.where("k = 'hot'").groupBy(BLOCK).count().collect()
    assert len(per_block) >= 2 and max(r["count"] for r in per_block) < 2400


def test_number_rows(frame):
    rng = random.Random(2)
    rows = [(k if k != "k3" else None, rng.random(), i) for i, k in enumerate(skewed(3000, rng))]
    got = number_rows(frame(rows, "k string, o double, i int"), ["k"], ["o", "i"], "n", start=1).collect()
    want = {}
    for key in {r[0] for r in rows}:
        for n, row in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == key)):
            want[row[1]] = n + 1
    assert {r["i"]: r["n"] for r in got} == want and len(got) == len(rows)


def test_number_all_rows(frame):
    got = number_rows(frame([(i * 7 % 1000,) for i in range(1000)], "i int"), [], ["i"], "n").collect()
    assert all(r["i"] == r["n"] for r in got)


def test_number_nothing(frame):
    assert number_rows(frame([], "k string, i int"), ["k"], ["i"], "n").count() == 0


def plain_limit(times, window, limit):
    recent, out = [], []
    for t in times:
        recent = [r for r in recent if t - r < window]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out


@pytest.mark.parametrize("spacing, limit", [(0.5, 5), (20, 2), (0.05, 3)])
def test_rate_limit_without_quiet_gaps(frame, spacing, limit):
    """The hot client never pauses for a whole window, so its state crosses every block."""
    rng = random.Random(3)
    clock, rows = {}, []
    for i, key in enumerate(skewed(3000, rng)):
        clock[key] = clock.get(key, 0) + rng.expovariate(1 / spacing)
        rows.append((key, i, START + timedelta(seconds=clock[key])))
    got = {r["attempt_id"]: r["admitted"] for r in access.admit_rate_limited(
        frame(rows, "client string, attempt_id int, ts timestamp_ntz"), 60, limit).collect()}
    for key in {r[0] for r in rows}:
        own = sorted((r[2], r[1]) for r in rows if r[0] == key)
        want = plain_limit([t for t, _ in own], timedelta(seconds=60), limit)
        assert [got[i] for _, i in own] == want


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_key_over_many_blocks_costs_no_more_jobs(spark, frame):
    """A client that never pauses for a whole window, over 6 and over 50 blocks."""
    rows = [("hot", i, START + timedelta(seconds=i)) for i in range(5000)]
    df = frame(rows, "client string, attempt_id int, ts timestamp_ntz")
    want = plain_limit([r[2] for r in rows], timedelta(seconds=60), 7)
    found = []
    for blocks in (6, 50):
        spark.conf.set("spark.sql.shuffle.partitions", str(blocks))

        def work():
            got = access.admit_rate_limited(df, 60, 7).collect()
            assert [r["admitted"] for r in sorted(got, key=lambda r: r["attempt_id"])] == want

        found.append(jobs_of(spark, f"limit-{blocks}", work))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_gaps_cut_a_key_into_segments(frame):
    """Bursts with quiet time between them, some of which end at the edge of a block."""
    rng = random.Random(8)
    clock, rows = 0, []
    for burst in range(60):
        clock += 60 if burst % 3 else 61
        for _ in range(rng.randrange(1, 60)):
            rows.append(("hot", len(rows), START + timedelta(seconds=clock)))
            clock += rng.randrange(0, 20)
    got = access.admit_rate_limited(frame(rows, "client string, attempt_id int, ts timestamp_ntz"), 60, 3).collect()
    assert [r["admitted"] for r in sorted(got, key=lambda r: r["attempt_id"])] == plain_limit([r[2] for r in rows], timedelta(seconds=60), 3)


def test_running_totals(frame):
    rng = random.Random(9)
    rows = [(k, i, rng.choice([None, 0, 1, 5, -2])) for i, k in enumerate(skewed(2000, rng))]
    got = running_totals(frame(rows, "k string, i int, v int"), ["k"], ["i"], "v", "t", start=3).collect()
    sums, want = {}, {}
    for k, i, v in rows:
        want[i] = sums.setdefault(k, 3)
        sums[k] += v or 0
    assert {r["i"]: r["t"] for r in got} == want


def test_maps_of_a_machine():
    """Prefix products against steps one by one, for every length up to 40."""
    rng = np.random.default_rng(1)
    for n in range(1, 41):
        maps = rng.integers(0, 5, (n, 5))
        state, want = 2, []
        for m in maps:
            state = m[state]
            want.append(state)
        assert ordered._states_after(maps.astype(np.intp), 2).tolist() == want
        assert ordered._product(maps.astype(np.intp))[2] == want[-1]


def test_odd_symbols_leave_the_state(frame):
    rows = [(1, i, s) for i, s in enumerate([None, "nonsense", "in_progress", None, "draft", "submitted_for_review"])]
    got = workflow.replay_transitions(frame(rows, "case_id int, request_id int, target_status string"), ["request_id"]).orderBy("request_id").collect()
    assert [(r["status"], r["accepted"]) for r in got] == [
        ("draft", False), ("draft", False), ("draft", True), ("in_progress", False), ("in_progress", False), ("in_progress", True)]


def test_rate_limit_rules(frame):
    at = lambda *s: [START + timedelta(seconds=x) for x in s]
    rows = [("a", i, t) for i, t in enumerate(at(0, 1, 2, 3, 4, 5, 59.9, 60, 60.5, 61))]
    got = access.admit_rate_limited(frame(rows, "client string, attempt_id int, ts timestamp_ntz")).collect()
    # The sixth is refused; exactly one minute after the first there is room again.
    assert [r["admitted"] for r in sorted(got, key=lambda r: r["attempt_id"])] == [
        True, True, True, True, True, False, False, True, False, True]


def test_replay_transitions_over_a_hot_case(frame):
    rng = random.Random(4)
    steps = [s for s in CASE_STATUSES if s != "closed"] * 3 + ["closed"]
    rows = [(0 if rng.random() < 0.7 else rng.randrange(1, 9), i, rng.choice(steps)) for i in range(3000)]
    got = {r["request_id"]: (r["status"], r["accepted"], r["message"]) for r in workflow.replay_transitions(
        frame(rows, "case_id int, request_id int, target_status string"), ["request_id"]).collect()}
    state = {}
    for case_id, request_id, target in rows:
        now = state.get(case_id, "draft")
        ok = target in NEXT_STATUSES[now]
        assert got[request_id][:2] == (now, ok)
        assert (got[request_id][2] is None) == ok
        state[case_id] = target if ok else now


def test_rejection_messages(value):
    message = lambda a, b: value(workflow.rejection_message(F.lit(a), F.lit(b)))
    assert message("closed", "draft") == (
        "Cannot transition case from 'closed' to 'draft'. Allowed transitions from 'closed': none (terminal state)")
    assert message("under_review", "draft").endswith("['revisions_requested', 'closed']")


def test_replay_jobs(frame):
    rng = random.Random(5)
    kinds = ["enqueue", "claim", "success", "failure", "stale", "claim", "failure"]
    rows = [("hot" if rng.random() < 0.6 else f"j{rng.randrange(9)}", i, rng.choice(kinds), None if i % 2 else f"E: {i}")
            for i in range(3000)]
    got = {r["job_id"]: (r["status"], r["attempts"], r["last_error"]) for r in ingestion.replay_jobs(
        frame(rows, "job_id string, i int, event string, error string"), ["i"]).collect()}
    state = {}
    for job, _, kind, error in rows:
        status, attempts, last = state.get(job, (None, 0, None))
        if kind == "enqueue" and status in (None, "done", "failed"):
            status, attempts, last = "pending", 0, None
        elif kind == "claim" and status == "pending":
            status = "running"
        elif status == "running" and kind == "success":
            status, last = "done", None
        elif status == "running" and kind in ("failure", "stale"):
            attempts += 1
            status, last = ("failed" if attempts >= 3 else "pending"), error or kind
        state[job] = (status, attempts, last)
    assert got == state
