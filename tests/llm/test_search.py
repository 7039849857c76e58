"""Nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from dossier.llm import ann


def test_recall_and_scores(spark):
    found = ann.nearest(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), F.col("vec_id") % 50 == 0).collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    m = np.array([r["embedding"] for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        cosine = m @ m[q]
        order = [i for i in np.lexsort((ids, -cosine)) if i != q][:5]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == ids[q])
        assert [r for r, _, _ in got] == [1, 2, 3, 4, 5]
        for _, v, s in got:
            assert abs(cosine[np.flatnonzero(ids == v)[0]] - s) < 1e-9
        hits += len({v for _, v, _ in got} & set(ids[order].tolist()))
        total += 5
    assert hits >= 0.9 * total


VECTORS = "vec_id bigint, embedding array<float>"


def found_of(frame, rows, schema=VECTORS, every=1):
    got = ann.nearest(frame(rows, schema), F.col("vec_id") % every == 0).collect()
    return {q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in got}}


def test_odd_vectors_take_no_part(frame):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), 1.0, 0.5]) for i in range(1, 9)]
    odd = [(20, None), (21, []), (22, [0.0, 0.0, 0.0]), (23, [nan, 1.0, 1.0]), (24, [inf, 1.0, 1.0]), (25, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (26, [1.0, 2.0])]
    got = found_of(frame, good + odd)
    assert set(got) == set(range(1, 9))
    for q, best in got.items():
        assert [r for r, _, _ in best] == [1, 2, 3, 4, 5] and {v for _, v, _ in best} <= set(range(1, 9)) - {q}
        a = np.array(dict(good)[q])
        want = sorted(((-float(a @ np.array(b) / np.linalg.norm(a) / np.linalg.norm(b)), v) for v, b in good if v != q))[:5]
        assert [v for _, v, _ in best] == [v for _, v in want]


def test_ties_copies_and_repeated_rows(frame):
    rows = [(i, [1.0, 0.0]) for i in range(20)] * 2 + [(100, [2.0, 0.0]), (101, [0.0, 1.0])]
    got = found_of(frame, rows)
    assert [v for _, v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for _, v, _ in got[3]] == [0, 1, 2, 4, 5]
    assert [v for _, v, _ in got[101]] == [0, 1, 2, 3, 4] and abs(got[101][0][2]) < 1e-12


def test_few_none_and_clashing_columns(frame):
    assert found_of(frame, []) == {} and found_of(frame, [(1, [1.0, 2.0])]) == {}
    got = found_of(frame, [(1, [1.0, 2.0], 7, 8, "x"), (2, [2.0, 1.0], 7, 8, "x")], VECTORS + ", rep int, score int, buckets string")
    assert [(v, r) for r, v, _ in got[1]] == [(2, 1)]


def test_each_pair_is_compared_once_and_few_in_clusters(frame, monkeypatch):
    """Clusters of close vectors: a selective setting is taken, and the share of pairs that is compared is small."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 32))
    rows = [(i, (centres[i % 150] + 0.15 * rng.normal(size=32)).tolist()) for i in range(3000)]
    df = frame(rows, VECTORS).repartition(4)
    classes = ann.classes_of(ann.usable(df))
    asking = classes.where(F.col("rep") % 50 == 0).select("rep", "embedding")
    setting = ann.fitted(classes, asking)
    assert setting[0] >= 8
    block = ann.Block(ann._probes(asking, setting).collect(), True)
    met = block.met(ann.units(np.array([r[1] for r in rows])), setting[0])
    assert met.mean() < 0.15
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    m = ann.units(np.array([r[1] for r in rows]))
    hits = sum(r["vec_id"] in {int(x) for x in np.argsort(-(m @ m[r["query_id"]]), kind="stable")[:6]} for r in got)
    assert hits >= 0.9 * len(got) and len(got) == 300
