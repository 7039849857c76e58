"""Approximate nearest neighbours by cosine: multiprobe p-stable hashing.

On unit vectors the order by cosine is the order by Euclidean distance, for which Gaussian projections are stable. Each of TABLES tables cuts
projections into slots of WIDTH; a query visits its own bucket and the perturbed ones of greatest estimated success (least sum of
squared distances to the slot borders). What all tables find is merged before anything is compared, and ranked again by the exact
cosine of the original vectors, so a pair is compared once at most. Every vector is hashed into every table.

How many projections and probes there are is fitted: a sample of SAMPLE queries is compared with all vectors, and of SETTINGS the one
that visits the fewest vectors and finds WANTED_RECALL of the sample's neighbours is taken. Where the neighbours are
close that is a setting of many projections; vectors without close neighbours need wide ones.

Queries travel with their buckets, CHUNK at a time; vectors stay where they are, and of a batch only the best TOP + 1 of a query
leave the task. So no bucket is gathered, however many vectors share it. Equal vectors are one class with its 6 smallest ids. A
query that has met too few vectors visits the buckets of the widest setting, and if that is not enough all vectors.

Vectors that are null or zero, or hold null, NaN or infinity, take no part, nor do rows with a null id; vectors are compared with those of
their own length only. Rows that repeat id and vector count once. Columns beside vec_id and embedding are not read.
Recall of the 5 nearest against brute force and the share of pairs compared are stated in the README.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from dossier.llm.base import map_batches, query, table, written

TABLES, WIDTH = 16, 1.2
# Projections and probes, from the one that visits the fewest vectors to the one that visits the most.
SETTINGS = [(14, 64), (12, 64), (10, 96), (9, 96), (8, 128), (7, 128), (6, 64), (6, 80), (6, 96), (6, 128), (5, 96), (4, 128)]
SAMPLE, WANTED_RECALL = 128, 0.93
TOP = 5
CHUNK = 2048  # queries that travel to every task at a time


class Hashes:
    """The projections of one table for vectors of one length; the same in every task."""

    def __init__(self, dim: int, number: int, projections: int):
        rng = np.random.default_rng([dim, number])
        self.a = rng.standard_normal((dim, projections))
        self.b = rng.random(projections) * WIDTH
        self.mix = rng.integers(1, 1 << 62, projections, dtype=np.int64) | 1
        self.dim = np.int64(dim)

    def slots(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (units @ self.a + self.b) / WIDTH
        slot = np.floor(place)
        return slot.astype(np.int64), place - slot

    def keys(self, slots: np.ndarray) -> np.ndarray:
        return (slots * self.mix).sum(axis=-1) ^ self.dim

    def visited(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """The buckets that a query visits, in sorted order."""
        slots, inside = self.slots(unit[None])
        return np.unique(self.keys(slots[0] + np.stack(perturbations(inside[0], probes))))


def perturbations(inside: np.ndarray, probes: int) -> list[np.ndarray]:
    """Slot shifts in the order of estimated success; `inside` is the place within each slot, 0 to 1."""
    m = len(inside)
    cost = np.concatenate([inside, 1.0 - inside]) ** 2
    order = np.argsort(cost, kind="stable")
    sorted_cost = cost[order]
    out = [np.zeros(m, np.int64)]
    heap = [(float(sorted_cost[0]), (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        shift, fine = np.zeros(m, np.int64), True
        for j in chosen:
            axis, up = int(order[j]) % m, int(order[j]) >= m
            fine = fine and not shift[axis]
            shift[axis] = 1 if up else -1
        if fine:
            out.append(shift)
        last = chosen[-1]
        if last + 1 < 2 * m:
            step = float(sorted_cost[last + 1])
            heapq.heappush(heap, (total - float(sorted_cost[last]) + step, (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + step, (*chosen, last + 1)))
    return out


def stacked(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors by length: their rows and the matrix, in double precision."""
    lengths = np.array([len(v) for v in column], np.int64)
    out = {}
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        out[dim] = rows, np.stack([np.asarray(column[int(i)].values, np.float64) for i in rows])
    return out


def units(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(axis=1))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def usable(vectors: DataFrame) -> DataFrame:
    """Ids and vectors that take part, each pair once."""
    finite = F.forall("embedding", lambda x: F.coalesce((F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return rows.where(finite & F.exists("embedding", lambda x: x != 0)).distinct()


def classes_of(rows: DataFrame) -> DataFrame:
    """rep (smallest id), embedding and the TOP + 1 smallest ids of each distinct vector."""
    place = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    kept = rows.withColumn("_place", place).where(F.col("_place") <= TOP + 1)
    return kept.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _probes(asking: DataFrame, setting: tuple[int, int]) -> DataFrame:
    """rep, embedding and, by table, the buckets that the query visits."""
    projections, probes = setting
    schema = T.StructType([*asking.schema.fields, T.StructField("buckets", T.ArrayType(T.ArrayType(T.LongType())))])

    def work(batch):
        out = []
        for vector in batch.column("embedding"):
            unit = units(np.asarray(vector.values, np.float64)[None])[0]
            out.append([Hashes(len(unit), number, projections).visited(unit, probes).tolist() for number in range(TABLES)])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.list_(pa.int64())))], names=schema.fieldNames())

    return map_batches(asking, work, schema)


FOUND = "query bigint, rep bigint, score double"


def _table(found: list[tuple]):
    columns = zip(*found, strict=True) if found else ((), (), ())
    return [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)]


class Block:
    """Some queries of one length with the buckets they visit, by table; without buckets they visit every vector."""

    def __init__(self, rows: list, with_buckets: bool):
        self.ids = np.array([r["rep"] for r in rows], np.int64)
        self.matrix = np.array([r["embedding"] for r in rows], np.float64)
        self.tables = None
        if with_buckets:
            self.tables = []
            for number in range(TABLES):
                sizes = [len(r["buckets"][number]) for r in rows]
                keys = np.concatenate([np.array(r["buckets"][number], np.int64) for r in rows])
                order = np.argsort(keys, kind="stable")
                self.tables.append((keys[order], np.repeat(np.arange(len(rows)), sizes)[order]))

    def met(self, unit: np.ndarray, projections: int) -> np.ndarray:
        """Which queries visit which vectors, the candidates of all tables merged."""
        if self.tables is None:
            return np.ones((len(self.ids), len(unit)), bool)
        found = np.zeros((len(self.ids), len(unit)), bool)
        for number, (keys, queries) in enumerate(self.tables):
            h = Hashes(unit.shape[1], number, projections)
            own = h.keys(h.slots(unit)[0])
            first, last = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
            sizes = last - first
            row = np.repeat(np.arange(len(own)), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
            found[queries[place], row] = True
        return found


def reranked(block: Block, reps: np.ndarray, matrix: np.ndarray, projections: int) -> list[tuple]:
    """For each query of a block its TOP + 1 best candidates, and what ties with the last, by exact cosine. Each pair is compared once."""
    unit, asked, out = units(matrix), units(block.matrix), []
    for q, visits in enumerate(block.met(unit, projections)):
        at = np.flatnonzero(visits)
        if len(at):
            rough = unit[at] @ asked[q]
            keep = min(TOP + 1, len(at))
            at = at[rough >= np.partition(rough, len(at) - keep)[len(at) - keep] - 1e-9]
            out += [(int(block.ids[q]), int(reps[i]), cosine(block.matrix[q], matrix[i])) for i in at.tolist()]
    return out


def _searched(classes: DataFrame, asking: DataFrame, setting: tuple[int, int] | None) -> DataFrame | None:
    """The best classes of each query (rep, embedding), CHUNK queries at a time; without a setting they are compared with all.

    Vectors stay where they are: each is hashed once a table and scan, and compared with a query once at most.
    """
    n = asking.count()
    chunks = -(-n // CHUNK)
    rows = written(_probes(asking, setting), "probes") if setting else asking
    found = None
    for chunk in range(chunks):
        by_dim: dict[int, list] = {}
        for r in rows.where(F.pmod(F.xxhash64("rep"), F.lit(chunks)) == chunk).collect():  # about CHUNK rows
            by_dim.setdefault(len(r["embedding"]), []).append(r)
        shipped = classes.sparkSession.sparkContext.broadcast({dim: Block(some, setting is not None) for dim, some in by_dim.items()})

        def work(batch, shipped=shipped):
            out = []
            for dim, (at, matrix) in stacked(batch.column("embedding")).items():
                if dim in shipped.value:
                    reps = batch.column("rep").to_numpy()[at]
                    for some in range(0, len(at), 1024):
                        out += reranked(shipped.value[dim], reps[some:some + 1024], matrix[some:some + 1024], setting[0] if setting else 0)
            return pa.RecordBatch.from_arrays(_table(out), ["query", "rep", "score"])

        part = map_batches(classes.select("rep", "embedding"), work, FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def fitted(classes: DataFrame, asking: DataFrame) -> tuple[int, int]:
    """The first of SETTINGS that finds WANTED_RECALL of the true neighbours of a sample of SAMPLE queries.

    The sample's neighbours come from a comparison with all vectors; a setting finds one if some table puts it into a visited bucket.
    """
    sample = written(asking.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE), "sample")
    true = _searched(classes, sample, None)
    if true is None:
        return SETTINGS[0]
    best = _best_classes(true).where(F.col("query") != F.col("rep"))
    pairs = (best.join(classes.select("rep", F.col("embedding").alias("near")), "rep")
             .join(sample.select(F.col("rep").alias("query"), "embedding"), "query").groupBy("query", "embedding").agg(F.collect_list("near").alias("near")))

    def count(batch):
        hits, n = np.zeros(len(SETTINGS), np.int64), 0
        for vector, near in zip(batch.column("embedding"), batch.column("near")):
            unit = units(np.asarray(vector.values, np.float64)[None])[0]
            others = units(np.array(near.as_py(), np.float64))
            n += len(others)
            for i, (projections, probes) in enumerate(SETTINGS):
                got = np.zeros(len(others), bool)
                for number in range(TABLES):
                    h = Hashes(len(unit), number, projections)
                    got |= np.isin(h.keys(h.slots(others)[0]), h.visited(unit, probes))
                hits[i] += got.sum()
        return pa.RecordBatch.from_arrays([pa.array([*range(len(SETTINGS)), -1], pa.int32()), pa.array([*hits, n], pa.int64())], ["setting", "n"])

    counts = {r[0]: r[1] for r in map_batches(pairs.repartition(16, "query"), count, "setting int, n bigint").groupBy("setting").agg(F.sum("n")).collect()}
    total = counts.get(-1, 0)
    return next((s for i, s in enumerate(SETTINGS) if counts.get(i, 0) >= WANTED_RECALL * total), SETTINGS[-1])


def _best_classes(found: DataFrame) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return (found.groupBy("query", "rep").agg(F.max("score").alias("score"))
            .withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= TOP + 1).drop("_place"))


def nearest(vectors: DataFrame, is_query) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `is_query` holds for, its TOP nearest others."""
    rows = written(usable(vectors), "vectors")
    classes = written(classes_of(rows), "vector-classes")
    members = classes.select("rep", "ids")
    asked = written(rows.where(is_query).join(classes.select("embedding", "rep"), "embedding").select(F.col("vec_id").alias("query_id"), "rep"), "queries")
    asking = written(classes.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "embedding"), "query-classes")

    setting = fitted(classes, asking)
    probed = _searched(classes, asking, setting)
    if probed is None:
        probed = vectors.sparkSession.createDataFrame([], FOUND)
    best = written(_best_classes(probed), "best")
    # A query that has not met enough visits more buckets, then all vectors.
    for wider in (SETTINGS[-1], None):
        held = best.join(members, "rep").groupBy("query").agg(F.sum(F.size("ids")).alias("n"))
        few = written(asking.join(held.where(F.col("n") > TOP), asking["rep"] == held["query"], "left_anti"), "few")
        more = _searched(classes, few, wider)
        if more is None:
            break
        best = written(_best_classes(best.unionByName(_best_classes(more))), "best")
    ids = best.join(members, "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (asked.join(ids, asked["rep"] == ids["query"]).where("vec_id <> query_id")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).select("query_id", "rank", "vec_id", "score"))


@query("op6_nearest")
def op6_nearest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
