"""Rows that pipeline stages must keep or drop, and what packing promises."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from dossier.llm import langid, packing

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed, n=60):
    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def rows_of(*pairs):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]


def test_repeated_ids_keep_texts_that_link_to_nothing(spark, frame):
    a, b, c = words(1), words(2), words(3)
    rows = rows_of((5, a), (5, b), (5, a + " end"), (1, b + " end"), (2, c), (3, None), (3, None), (None, a), (9, c + " end"))
    kept = corpus_pipeline.one_of_near_copies(spark, frame(rows, DOCS), SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(5, a), (1, b + " end"), (2, c), (3, None), (3, None), (None, a)])
    assert all(len(r) == 5 for r in kept)


def letters(rng, alphabet, n=40):
    return " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 9))) for _ in range(n))


def test_an_unlearned_language_goes_and_clean_rows_stay(frame):
    rng = np.random.default_rng(6)
    known = [(i, letters(rng, ("abcdefgh", "mnopqrst", "acegikmo")[i % 3]), ("x", "y", "z")[i % 3]) for i in range(600)]
    model = langid.train(frame([r for r in known if r[0] % 4], "doc_id bigint, text string, lang string"))
    held = [(i, t, lang) for i, t, lang in known if i % 4 == 0]
    other = [(1000 + i, letters(rng, "абвгдежз"), "q") for i in range(40)]
    odd = [(2000, None, "x"), (2001, "", "x"), (2002, "12 34", "x"), (2003, chr(0x30000) * 30, "q")]
    docs = frame(held + other + odd, "doc_id bigint, text string, lang string")
    left = {r["doc_id"] for r in langid.known_language(docs, model).collect()}
    assert len(left & {r[0] for r in held}) >= 0.99 * len(held) and not left & {r[0] for r in odd[:3]}
    assert len(left & {r[0] for r in other}) <= 4
    read = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, model).collect()}
    assert read[2003] != "und" and read[2002] == "und"


def test_packing_pads_little_and_balances_steps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(2)
    pieces = packing.pack(docs).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
    sizes, groups = {}, Counter()
    for s, own in sequences.items():
        own.sort(key=lambda p: p["offset"])
        ends = np.cumsum([p["length"] for p in own])
        assert [p["offset"] for p in own] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
        assert len({(p["tier"], p["step_group"]) for p in own}) == 1 and own[0]["tier"] & (own[0]["tier"] - 1) == 0
        assert ends[-1] <= own[0]["tier"]
        sizes[s] = (int(ends[-1]), own[0]["tier"])
        groups[own[0]["step_group"]] += own[0]["tier"]
    tokens = sum(n for n, _ in sizes.values())
    # A sequence at a power of two needs no padding to 2048.
    padded = sum(n if n & (n - 1) == 0 else 2048 for n, _ in sizes.values())
    assert padded <= 1.05 * tokens
    assert max(groups.values()) <= packing.GROUP_TOKENS
    assert sorted(groups.values())[len(groups) // 2] >= 0.5 * packing.GROUP_TOKENS
    assert {t for _, t in sizes.values()} >= set(packing.TIERS)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append((p["start"], p["length"], p["doc_tokens"]))
    for own in by_doc.values():
        own.sort()
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and own[-1][0] + own[-1][1] == own[0][2]


def test_stages_on_empty_tables(spark, frame):
    none = frame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name
