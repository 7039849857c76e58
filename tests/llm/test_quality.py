"""Measures and adaptive thresholds of the quality rules."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dossier.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The measures by their definition."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines))


@pytest.mark.parametrize("text", [
    None, "", " \n\t", "a", "a a a", "a a a a", "a b c a b c", "a b c d a b c", "x\n\nx\n \nx\r\nx", "ä#ü b *|<>&%$   c\x1cd",
    "one two three\none two three\n", "\x0b\x0ca\x0d"])
def test_measures(text):
    assert quality.measures_of(text) == plain(text)


def test_measures_of_random_and_long_texts(monkeypatch):
    monkeypatch.setattr(quality, "_SLICE", 50)
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice(["a", "b", "é", "#", " ", " ", "\n", "\t", "日本"]) for _ in range(draw.randrange(200)))
        assert quality.measures_of(text) == plain(text)
    long = "word " * 100_000 + "\n" + "x" * 500_000
    assert quality.measures_of(long) == plain(long)


def test_many_different_words():
    numbers = quality.np.arange(30)
    repeated = quality.np.concatenate([numbers, [3, 4, 5, 6]])
    assert quality.repeated_words(repeated, 1 << 20) == 8 == quality.repeated_words(repeated, 30)


def text_of(draw, n, length=5, symbols=0):
    words = ["".join(draw.choice("abcdefghij") for _ in range(length + draw.randrange(2))) for _ in range(n)]
    for _ in range(symbols):
        words[draw.randrange(n)] += "#"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(5)
    rows = []
    for i in range(150):
        rows.append((i, text_of(draw, 60), "en", "prose"))
        rows.append((1000 + i, text_of(draw, 60, length=11, symbols=30), "en", "code"))
    rows += [(2000 + i, text_of(draw, 60), "en", "small") for i in range(5)]
    rows += [(3000 + i, text_of(draw, 60), None, None) for i in range(3)]
    odd = {
        4000: (text_of(draw, 60, symbols=50), "en", "prose"),   # too many symbols for prose
        4001: (text_of(draw, 60, length=11, symbols=30), "en", "code"),  # what code looks like
        4002: (text_of(draw, 60, length=20), "en", "prose"),    # words too long
        4003: (text_of(draw, 60, length=1), "en", "prose"),     # and too short
        4004: (text_of(draw, 49), "en", "prose"), 4005: (None, "en", "prose"), 4006: ("", None, None),
        4007: (" ".join(["again and again"] * 30), "en", "prose"),
        4008: (text_of(draw, 60, length=40), "en", "small"),
    }
    return rows + [(k, *v) for k, v in odd.items()]


def test_thresholds_follow_their_source(frame, corpus):
    rows = quality.quality_rules(frame(corpus, SCHEMA)).collect()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert len(rows) == len(corpus)
    assert all(kept[i] for i in kept if i < 4000)
    assert {i for i in kept if i >= 4000 and kept[i]} == {4001}
    assert {r["doc_id"] for r in rows if r["base_failed"]} == {4004, 4005, 4006, 4007}
    levels = {r["source"]: r["level"] for r in rows}
    assert levels == {"prose": "source", "code": "source", "small": "language", None: "corpus"}


def test_merged_sketch_is_that_of_all_rows(frame, corpus):
    rows = quality.measured(frame(corpus, SCHEMA))
    parts = [quality.sketches(rows.where(F.col("doc_id") % 3 == i)) for i in range(3)]
    together = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "source", "rate", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, together.collect())) == sorted(map(str, quality.sketches(rows).collect()))
    assert sorted(map(str, quality.fences(quality.merged(together)).collect())) == sorted(map(str, quality.fences(quality.merged(quality.sketches(rows))).collect()))


def test_buckets_keep_eight_bits(value):
    for v in (0, 1, 255, 256, 257, 1000, 10_001, 123_456_789, 1 << 40):
        got = value(quality.bucket("v"), v=v)
        low = max(v.bit_length() - 8, 0)
        assert got == v >> low << low and v - got <= v / 128


def test_quartiles(frame):
    sketch = frame([("source", "en", "s", "symbols", b, n) for b, n in ((0, 1), (100, 1), (2000, 1), (9000, 1))],
                   "level string, lang string, source string, rate string, bucket bigint, n bigint")
    (row,) = quality.fences(sketch).collect()
    assert (row["rows"], row["low"], row["high"]) == (4, -6000, 8000)


def test_empty_odd_and_clashing(frame):
    assert quality.quality_rules(frame([], SCHEMA)).collect() == []
    only_failing = quality.quality_rules(frame([(None, "a", None, None), (None, "a", None, None)], SCHEMA)).collect()
    assert [(r["doc_id"], r["n_words"], r["kept"], r["level"]) for r in only_failing] == [(None, 1, False, None)] * 2
    clash = frame([(1, "a b", "en", "s", 5, True, "x", 3)], SCHEMA + ", n_words int, kept boolean, level string, bucket int")
    (row,) = quality.quality_rules(clash).collect()
    assert (row["n_words"], row["kept"]) == (2, False)
