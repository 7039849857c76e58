"""Importance resampling against its formula, for runs of one word and of several."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from dossier.llm import resampling

DOCS = "doc_id bigint, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_force(docs, target, longest=1, buckets=10_000, least=20, per_cent=10):
    bucket = lambda f: crc32(f.encode()) % buckets
    raw = Counter(bucket(f) for _, t in docs for f in runs(t, longest))
    aim = Counter(bucket(f) for t in target for f in runs(t, longest))
    s, t = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets))))
    rows = []
    for doc_id, text in docs:
        features = runs(text, longest)
        weight = sum(gain(bucket(f)) for f in features)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(features), weight, score, None, len(words(text))])
    eligible = sorted((r for r in rows if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for place, row in enumerate(eligible[:len(eligible) * per_cent // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def made(seed=1, n=200):
    draw = random.Random(seed)
    vocabulary = ["The", "of", "and", "Ünder", "日本", "x1", "don't"] + [f"w{i}" for i in range(300)]
    text = lambda k: " ".join(draw.choice(vocabulary[:k]) + draw.choice(["", "", ".", "\n", "\t,"]) for _ in range(draw.randrange(60)))
    docs = [(i, text(307 if i % 3 else 20)) for i in range(n)]
    return docs + [(None, text(50)), (5, docs[5][1]), (6, "other"), (900, None), (901, ""), (902, "!? ;"), (903, "Long word " * 30_000)], [text(12) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_against_the_formula(frame, monkeypatch, longest):
    monkeypatch.setattr(resampling, "_SLICE", 40)
    docs, target = made()
    got = resampling.resample(frame(docs, DOCS), frame([(t,) for t in target], "text string"), longest=longest, buckets=500)
    rows = sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()), key=str)
    assert rows == brute_force(docs, target, longest, 500)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_head_and_tail_give_the_same_buckets(longest):
    text = "The cat and the dog, the cat and the bird " * 5
    tail = resampling.Head([], [], 997).features(text, longest)
    head = resampling.Head([b"the", b"cat"], [b"the cat", b"and the"], 997).features(text, longest)
    want = sorted(crc32(f.encode()) % 997 for f in runs(text, longest))
    assert tail[0] == head[0] == 50 and sorted(tail[1].tolist()) == sorted(head[1].tolist()) == want


def test_head_holds_the_most_frequent(frame):
    rows = frame([("a b a b a b c",), ("a b a",), (None,)], "text string").repartition(2)
    head = resampling.head_of(rows, longest=2, buckets=100, words=2, pairs=1)
    assert set(head.states) == {b"a", b"b"} and set(head.pairs) == {(b"a", b"b")}
    assert set(resampling.head_of(rows, words=1).states) == {b"a"}


def test_empty_tables(frame):
    none = frame([], DOCS)
    assert resampling.resample(none, frame([], "text string")).collect() == []
    docs = [(1, "a b c " * 10), (2, "a")]
    got = resampling.resample(frame(docs, DOCS), frame([], "text string"), per_cent=100)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()), key=str) == brute_force(docs, [], per_cent=100)


def test_clashing_columns(frame):
    docs = frame([(1, "a b c " * 10, 7, 8, 9, "x")], DOCS + ", n_words int, weight int, rank int, buckets string")
    (row,) = resampling.resample(docs, frame([("a",)], "text string"), per_cent=100).collect()
    assert (row["n_features"], row["rank"]) == (30, 1)
