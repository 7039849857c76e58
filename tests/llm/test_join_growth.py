"""The join on repeated ids and empty tables, and how many pairs it compares where little links."""

import itertools

import numpy as np
import pytest

from dossier.llm import ngram_join
from test_llm import brute_components, shingles

SCHEMA = "doc_id bigint, text string"


def components(frame, rows):
    return {r["doc_id"]: r["component_id"] for r in ngram_join.link_components(frame(rows, SCHEMA)).collect()}


def blocks_of(n, seed=1):
    """Documents made of 10 of 24 shared blocks of 20 words."""
    rng = np.random.default_rng(seed)
    blocks = [" ".join(f"w{x}" for x in rng.integers(0, 10_000, 20)) for _ in range(24)]
    return [(i, " ".join(blocks[b] for b in sorted(rng.choice(24, 10, replace=False)))) for i in range(n)]


def counted(frame, monkeypatch, rows):
    """Components, and how many pairs had their sets compared."""
    seen = []
    compare = ngram_join.written

    def noted(df, name):
        out = compare(df, name)
        if name == "possible-pairs":
            seen.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", noted)
    return components(frame, rows), sum(seen)


def test_crowded_entries_of_documents_that_do_not_link(frame, monkeypatch):
    rows = blocks_of(600)
    got, pairs = counted(frame, monkeypatch, rows)
    assert got == brute_components(rows)
    assert pairs < 1800  # of 180,000


def test_near_copies_with_edits_of_their_own(frame, monkeypatch):
    """One group of copies with up to 12 edits each, of which only part links."""
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 150)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 13)):
            words[at] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    got, pairs = counted(frame, monkeypatch, rows)
    assert got == brute_components(rows)
    assert pairs < 4500  # of 44,850


def test_caps_keep_every_link():
    """No two sets that link are outside each other's caps or maps, whatever is shared."""
    rng = np.random.default_rng(3)
    sets = [set(rng.integers(0, 120, rng.integers(40, 110)).tolist()) for _ in range(120)]
    held = {t: sum(t in s for s in sets) for t in range(120)}
    for x, y in itertools.combinations(sets, 2):
        if 100 * len(x & y) < 75 * len(x | y):
            continue
        for a, b in ((x, y), (y, x)):
            u = sum(held[t] > 1 for t in a)
            assert len(b) <= 7 * u // 3 - len(a)
        maps = [ngram_join.bits_of(np.array([t * 7919 for t in s if held[t] > 1], np.uint64)) for s in (x, y)]
        apart = sum(int(v).bit_count() for v in (maps[0] ^ maps[1]).view(np.uint64).tolist())
        u = [sum(held[t] > 1 for t in s) for s in (x, y)]
        assert 7 * (sum(u) - apart) >= 6 * (len(x) + len(y))


def test_rows_that_repeat_an_id(frame):
    one, two = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    rows = [(1, one), (2, two), (5, one), (5, two), (5, None), (7, "other words that are alone here"), (None, one)]
    got = ngram_join.link_components(frame(rows, SCHEMA)).collect()
    # The row of 5 without words has no link of its own.
    assert {(r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in got} == {
        (1, True, 1), (2, True, 1), (5, True, 1), (5, False, 5), (7, True, 7), (None, True, None)} and len(got) == 7


def test_empty_table(frame):
    assert components(frame, []) == {}


@pytest.mark.parametrize("seed", range(2))
def test_small_groups_against_brute_force(frame, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(25):
        base = [f"w{x}" for x in rng.integers(0, 60, rng.integers(3, 60))]
        for k in range(8):
            words = [w if rng.random() > 0.04 else f"w{rng.integers(0, 60)}" for w in base]
            rows.append((g * 10 + k, " ".join(words)))
    assert any(len(shingles(t)) < 3 for _, t in rows)
    assert components(frame, rows) == brute_components(rows)
