"""Merkle manifest of a dataset: a root over all sources, and for every row the witness that ties it to the root.

The leaves of a source stand in order of doc_id (null first; rows that repeat an id by their leaf). They are cut into aligned
blocks of ARITY ** DEPTH. In a block leaves are appended one by one: a leaf, and each subtree that is completed, joins the open run of its
level with a partial witness, its siblings to the left; every sibling completed later extends the witnesses that are open in
that run. The roots of the blocks are appended in the same way, in blocks of their own, until one node of a source remains;
and so are these subroots in order of source. Going down again, each block hands its witness to what it holds. No task holds
more than one block, whatever the size of a source; texts are read once and only digests are shuffled.

Nulls in any column are coded as such and differ from empty texts. Rows without a source are a source of their own, the first
one. Equal rows are leaves of their own. An empty table has no rows and no root. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.base import crc_of_id, query, table, written
from dossier.llm.checksum import CRC_OF_ID_SQL, CRC_TABLE_SQL
from dossier.operators.ordered import number_rows

ARITY = 3
DEPTH = 6  # 729 nodes in a block
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]

_WITNESS = T.ArrayType(T.StructType([T.StructField("before", T.StringType()), T.StructField("after", T.StringType())]))
_NODES = "part string, n bigint, node string"


def coded(column: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows read the same; a dash for null."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(text: Column) -> Column:
    """Leaf of a row of documents with this text."""
    values = [text if name == "text" else F.col(name) for name in LEAF_COLUMNS]
    return F.sha2(F.concat(*[coded(v) for v in values]), 256)


def digest(children: Iterable[str]) -> str:
    return hashlib.sha256("".join(children).encode("ascii")).hexdigest()


class Appender:
    """The nodes of one block, appended in order, each with the witness it has so far.

    A witness is a list of steps from the node upwards, a step the siblings before and after on its level.
    Nodes below one subtree share its steps, so extending a subtree's witness extends theirs.
    """

    def __init__(self, arity: int = ARITY, depth: int = DEPTH) -> None:
        self.arity, self.depth = arity, depth
        self.open: list[list] = [[] for _ in range(depth)]  # by level: digest, step, first and last node below
        self.witnesses: list[list] = []
        self.top: str | None = None

    def append(self, node: str) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self._join(0, node, at, at + 1)

    def _join(self, level: int, node: str, first: int, end: int) -> None:
        if level == self.depth:
            self.top = node
            return
        run = self.open[level]
        step = ["".join(sibling for sibling, *_ in run), ""]
        for _, earlier, _, _ in run:
            earlier[1] += node
        for witness in self.witnesses[first:end]:
            witness.append(step)
        run.append((node, step, first, end))
        if len(run) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._join(level + 1, digest(node for node, *_ in run), run[0][2], run[-1][3])

    def finish(self, alone: bool) -> str:
        """Root of the block. A block alone in its tree ends where one node remains, any other at full height."""
        for level in range(self.depth):
            run = self.open[level]
            if alone and len(run) == 1 and not any(self.open[level + 1:]):
                node, _, first, end = run[0]
                for witness in self.witnesses[first:end]:
                    witness.pop()
                return node
            if run:
                self._close(level)
        return self.top


def _append_all(rows: pa.Table, block: int, arity: int, depth: int) -> tuple[pa.Table, Appender, str]:
    rows = rows.sort_by("n")
    tree = Appender(arity, depth)
    for node in rows.column("node").to_pylist():
        tree.append(node)
    return rows, tree, tree.finish(alone=block == 0 and rows.num_rows < arity ** depth)


def _block(arity: int, depth: int) -> Column:
    return F.expr(f"n div {arity ** depth}").alias("block")


def block_roots(nodes: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """Nodes (part, n, node) to the roots of their blocks, numbered in turn."""

    def root(rows: pa.Table) -> pa.Table:
        block = rows.column("n")[0].as_py() // arity ** depth
        _, _, top = _append_all(rows, block, arity, depth)
        return pa.table({"part": rows.column("part").slice(0, 1), "n": pa.array([block], pa.int64()), "node": [top]})

    return nodes.select("part", "n", "node").groupBy("part", _block(arity, depth)).applyInArrow(root, _NODES)


def _steps(tree: Appender, above: list[dict]) -> pa.Array:
    """Witnesses of a block's nodes, each followed by that of the block."""
    rest = [(step["before"], step["after"]) for step in above]
    offsets, before, after = [0], [], []
    for witness in tree.witnesses:
        for left, right in (*witness, *rest):
            before.append(left)
            after.append(right)
        offsets.append(len(before))
    steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)


def _hand_down(nodes: DataFrame, above: DataFrame, arity: int, depth: int) -> DataFrame:
    """Nodes with their witness to the root, from the witnesses of their blocks (part, n, witness, subroot, root)."""
    given = ["witness", "subroot", "root"]
    kept = [c for c in nodes.columns if c not in given]
    schema = T.StructType([*[nodes.schema[c] for c in kept], T.StructField("witness", _WITNESS),
                           T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType())])

    def hand(rows: pa.Table, block: pa.Table) -> pa.Table:
        own = block.to_pylist()[0]
        rows, tree, _ = _append_all(rows, own["n"], arity, depth)
        for name, value in (("witness", _steps(tree, own["witness"])), ("subroot", None), ("root", None)):
            rows = rows.append_column(name, value if value is not None else pa.array([own[name]] * rows.num_rows, pa.string()))
        return rows.select([*kept, *given])

    left = nodes.select(*kept).groupBy("part", _block(arity, depth))
    right = above.select("part", "n", *given).groupBy("part", F.col("n").alias("block"))
    return left.cogroup(right).applyInArrow(hand, schema)


def _layers(nodes: DataFrame, name: str, arity: int, depth: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of the blocks of those, until every part has one."""
    layers = [nodes]
    while True:
        layers.append(written(block_roots(layers[-1], arity, depth), name))
        if not layers[-1].agg(F.max("n")).head()[0]:
            return layers


def manifest(leaves: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """Leaves (source, doc_id, leaf and further columns) with witness, subroot and root.

    `witness` lists, from the leaf up to the root, the siblings before and after it on each level.
    """
    more = [c for c in leaves.columns if c not in ("source", "leaf")]
    numbered = number_rows(
        leaves.select(coded(F.col("source")).alias("part"), F.col("leaf").alias("node"), *more), ["part"], ["doc_id", "node"], "n")
    numbered = written(numbered, "merkle-leaves")
    sources = _layers(numbered, "merkle-blocks", arity, depth)

    named = sources[-1].select(
        F.expr("if(part = '-', null, substring(part, instr(part, ':') + 1))").alias("source"), "part", "node")
    ordered = number_rows(named, [], ["source"], "n").select(
        F.lit("").alias("part"), "n", "node", F.col("part").alias("source_part"))
    whole = _layers(written(ordered, "merkle-subroots"), "merkle-blocks", arity, depth)

    nothing = F.array().cast(_WITNESS)
    above = whole[-1].select("part", "n", nothing.alias("witness"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for layer in reversed(whole[:-1]):
        above = _hand_down(layer, above, arity, depth)
    above = written(above.select(
        F.col("source_part").alias("part"), F.lit(0).cast("bigint").alias("n"), "witness", F.col("node").alias("subroot"), "root"), "merkle-above")
    for layer in reversed(sources[1:-1]):
        above = written(_hand_down(layer, above, arity, depth), "merkle-above")
    rows = _hand_down(sources[0], above, arity, depth)
    return rows.withColumnRenamed("node", "leaf").drop("n", "part")


def proof_of(witness: Column) -> Column:
    """Digest of all siblings of a witness, level by level."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, witness: Column) -> Column:
    """The root that a leaf leads to by a witness."""
    return F.aggregate(witness, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
rows AS (SELECT *, {CRC_OF_ID_SQL} AS crc FROM documents, crc_table),
coded AS (
  SELECT row_number() OVER () AS r, doc_id, source, crc % 2 = 0 AS altered,
    concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head,
    text, replace(text, chr(10), '') AS cut FROM rows),
leaves AS (
  SELECT r, doc_id, coalesce(source, '') AS part, source IS NULL AS bare,
    sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    sha256(head || CASE WHEN altered THEN coalesce(octet_length(encode(cut)) || ':' || cut, '-')
                        ELSE coalesce(octet_length(encode(text)) || ':' || text, '-') END) AS other FROM coded),
placed AS (SELECT *, row_number() OVER (PARTITION BY bare, part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS n FROM leaves),
tree AS (
  SELECT 0 AS level, bare, part, n, leaf AS node, count(*) OVER (PARTITION BY bare, part) AS total FROM placed
  UNION ALL
  SELECT level + 1, bare, part, n // 3, sha256(string_agg(node, '' ORDER BY n)), (any_value(total) + 2) // 3
  FROM tree WHERE total > 1 GROUP BY level, bare, part, n // 3),
subroots AS (
  SELECT bare, part, node AS subroot, row_number() OVER (ORDER BY bare DESC, encode(part)) - 1 AS n FROM tree WHERE total = 1),
upper AS (
  SELECT 0 AS level, n, subroot AS node, count(*) OVER () AS total FROM subroots
  UNION ALL
  SELECT level + 1, n // 3, sha256(string_agg(node, '' ORDER BY n)), (any_value(total) + 2) // 3
  FROM upper WHERE total > 1 GROUP BY level, n // 3),
steps AS (
  SELECT a.level, a.bare, a.part, a.n, coalesce(string_agg(b.node, '' ORDER BY b.n) FILTER (b.n < a.n), '') AS before,
    coalesce(string_agg(b.node, '' ORDER BY b.n) FILTER (b.n > a.n), '') AS after
  FROM tree a JOIN tree b ON a.level = b.level AND a.bare = b.bare AND a.part = b.part AND a.n // 3 = b.n // 3
  WHERE a.total > 1 GROUP BY a.level, a.bare, a.part, a.n),
upper_steps AS (
  SELECT a.level, a.n, coalesce(string_agg(b.node, '' ORDER BY b.n) FILTER (b.n < a.n), '') AS before,
    coalesce(string_agg(b.node, '' ORDER BY b.n) FILTER (b.n > a.n), '') AS after
  FROM upper a JOIN upper b ON a.level = b.level AND a.n // 3 = b.n // 3 WHERE a.total > 1 GROUP BY a.level, a.n),
walk AS (
  SELECT r, 0 AS level, false AS high, bare, part, n, other AS node, '' AS siblings FROM placed
  UNION ALL
  SELECT w.r, CASE WHEN s.level IS NULL AND NOT w.high THEN 0 ELSE w.level + 1 END, w.high OR s.level IS NULL, w.bare, w.part,
    CASE WHEN NOT w.high AND s.level IS NULL THEN q.n ELSE w.n // 3 END,
    CASE WHEN NOT w.high AND s.level IS NULL THEN w.node ELSE sha256(coalesce(s.before, u.before) || w.node || coalesce(s.after, u.after)) END,
    w.siblings || coalesce(s.before || s.after, u.before || u.after, '')
  FROM walk w LEFT JOIN steps s ON NOT w.high AND s.level = w.level AND s.bare = w.bare AND s.part = w.part AND s.n = w.n
  LEFT JOIN upper_steps u ON w.high AND u.level = w.level AND u.n = w.n
  LEFT JOIN subroots q ON q.bare = w.bare AND q.part = w.part
  WHERE NOT w.high OR u.level IS NOT NULL),
ends AS (SELECT r, node, siblings FROM walk WHERE high QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, (SELECT node FROM upper WHERE total = 1) AS root, sha256(siblings) AS proof_sha256, node AS folded_root,
  node = (SELECT node FROM upper WHERE total = 1) AS verified
FROM placed JOIN ends USING (r) JOIN subroots USING (bare, part)"""


@query("op11_merkle_manifest", SQL)
def merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every row with its leaf, subroot, root and proof, and the root that a copy of the row leads to from which, for one
    half of the ids, the line ends have been deleted. A row without an id is not tampered with."""
    docs = table(spark, sf_dir, "documents").select(*LEAF_COLUMNS)
    cut = F.when(crc_of_id(F.col("doc_id")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = written(docs.select("source", "doc_id", leaf_of(F.col("text")).alias("leaf"), leaf_of(cut).alias("altered")), "merkle-digests")
    rows = manifest(leaves)
    return rows.select("doc_id", "leaf", "subroot", "root", proof_of(F.col("witness")).alias("proof_sha256"),
                       fold(F.col("altered"), F.col("witness")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
