"""The manifest against trees folded by hand."""

import hashlib
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from dossier.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, arity=3):
    """Root of some nodes, and the siblings before and after each on every level."""
    paths = [[] for _ in nodes]
    below = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        next_nodes, next_below = [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at:at + arity]
            for i in range(len(run)):
                for leaf in below[at + i]:
                    paths[leaf].append(("".join(run[:i]), "".join(run[i + 1:])))
            next_nodes.append(h(*run))
            next_below.append([leaf for group in below[at:at + arity] for leaf in group])
        nodes, below = next_nodes, next_below
    return nodes[0], paths


def coded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


@pytest.mark.parametrize("arity, depth", [(2, 3), (3, 2), (3, 3)])
def test_appender(arity, depth):
    for n in range(1, arity ** depth + 1):
        leaves = [h(str(i)) for i in range(n)]
        made = merkle.Appender(arity, depth)
        for leaf in leaves:
            made.append(leaf)
        root, paths = tree(leaves, arity)
        assert made.finish(alone=n < arity ** depth) == root
        assert [[tuple(s) for s in w] for w in made.witnesses] == paths


def test_a_witness_grows_with_each_later_sibling():
    made = merkle.Appender(3, 2)
    made.append("a")
    assert made.witnesses[0] == [["", ""]]
    made.append("b")
    assert made.witnesses[0] == [["", "b"]] and made.witnesses[1] == [["a", ""]]
    made.append("c")
    assert made.witnesses[0] == [["", "bc"], ["", ""]] and made.witnesses[2] == [["ab", ""], ["", ""]]


def test_a_later_block_is_lifted_to_full_height():
    made = merkle.Appender(3, 2)
    made.append("a")
    assert made.finish(alone=False) == h(h("a")) and made.witnesses == [[["", ""], ["", ""]]]


def brute_force(rows):
    """doc_id, leaf, subroot, root, proof, folded root of all rows (doc_id, source, lang, n_chars, text)."""
    found = {}
    for row in rows:
        leaf = h(*map(coded, row))
        text = row[4]
        if row[0] is not None and crc32(str(row[0]).encode()) % 2 == 0 and text is not None:
            text = text.replace("\n", "")
        found.setdefault(row[1], []).append((row[0], leaf, h(*map(coded, (*row[:4], text)))))
    sources = sorted(found, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        found[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = tree([r[1] for r in found[s]])
    root, upper = tree([trees[s][0] for s in sources])
    out = []
    for s, high in zip(sources, upper):
        for (doc_id, leaf, altered), path in zip(found[s], trees[s][1]):
            node = altered
            for before, after in path + high:
                node = h(before, node, after)
            out.append((doc_id, leaf, trees[s][0], root, h(*[x for step in path + high for x in step]), node))
    return out


def manifest(df, arity=3, depth=1):
    docs = df.select("*")
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = docs.select("source", "doc_id", merkle.leaf_of(F.col("text")).alias("leaf"), merkle.leaf_of(cut).alias("altered"))
    rows = merkle.manifest(leaves, arity, depth)
    return [tuple(r) for r in rows.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_of(F.col("witness")), merkle.fold(F.col("altered"), F.col("witness"))).collect()]


def key(row):
    return tuple("" if v is None else str(v) for v in row)


ODD = [(i, f"s{i % 4}", "en", i, f"line {i}\nand\n{i}") for i in range(41)] + [
    (None, "s1", None, None, None), (None, None, "en", 1, ""), (7, None, "en", 1, "a\n"), (7, None, "en", 1, "a\n"),
    (8, "-", "de", 0, None), (9, "", "de", 0, "ä\n" * 50_000), (10, "ü", None, -5, "\n"), (11, "z", "en", 2, "x"), (12, "Z", "en", 2, "x")]


@pytest.mark.parametrize("depth", [1, 6])
def test_odd_rows_in_several_layers_of_blocks(frame, depth):
    assert sorted(manifest(frame(ODD, SCHEMA), depth=depth), key=key) == sorted(brute_force(ODD), key=key)


def test_one_row_is_its_own_root(frame):
    (row,) = manifest(frame([(3, "s", "en", 1, "x")], SCHEMA))
    assert row[1] == row[2] == row[3] == row[5] and row[4] == h("")


def test_empty_table(frame):
    assert manifest(frame([], SCHEMA)) == []


def test_extra_columns_and_tampering(spark, frame, tmp_path):
    rows = [(*r, 1, "p", "q", "w") for r in ODD]
    frame(rows, SCHEMA + ", n int, part string, node string, witness string").write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.merkle_manifest(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(brute_force(ODD), key=key)
    assert {r["verified"] for r in got} == {True, False}
    assert all(r["verified"] == (r["folded_root"] == r["root"]) for r in got)
