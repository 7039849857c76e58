"""Scoped exact retrieval: filter to what the user may read, then rank, then give context."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.text import looks_cut_off
from dossier.functions.vectors import cosine_distance
from dossier.operators.access import Scopes
from dossier.operators.ordered import number_rows
from dossier.schemas import TOP_K, UNKNOWN_DOCUMENT
from dossier.session import materialise, stored

# Distances are compared at this many decimals, so equal vectors tie and the id decides.
DECIMALS = 12


@dataclass(frozen=True)
class Within:
    """Scope of one search: every case, or exactly these (possibly none)."""

    all_cases: bool
    case_ids: frozenset = field(default_factory=frozenset)


ALL_CASES = Within(True)


def these_cases(*case_ids: int) -> Within:
    return Within(False, frozenset(case_ids))


# A scope of this many cases goes to the scan as a list; a larger one is joined.
MAX_LISTED_CASES = 10_000


def search(chunks: DataFrame, query_vector: list[float], within: Within, k: int = TOP_K) -> DataFrame:
    """The k chunks closest to one vector, from the scope only."""
    allowed = chunks
    if not within.all_cases:
        if not within.case_ids:
            return chunks.withColumn("distance", F.lit(0.0)).limit(0)
        if len(within.case_ids) <= MAX_LISTED_CASES:
            allowed = chunks.where(F.col("case_id").isin(sorted(within.case_ids)))
        else:
            own = chunks.sparkSession.createDataFrame(
                pd.DataFrame({"case_id": sorted(within.case_ids)}))
            allowed = chunks.join(own, "case_id", "left_semi")
    query = F.array(*[F.lit(float(x)) for x in query_vector])
    ranked = allowed.withColumn(
        "distance", F.round(cosine_distance(F.col("embedding"), query), DECIMALS))
    return ranked.orderBy(F.asc_nulls_last("distance"), "chunk_id").limit(k)


# --- many questions at once ---------------------------------------------------------------

# What may travel to every task at a time: questions, bytes of their vectors, and (question, case) pairs.
MAX_QUESTIONS = 4096
MAX_QUESTION_BYTES = 256 * 1024 * 1024
MAX_QUESTION_CASES = 1_000_000
# Tasks a core for one block of questions: each gives its k best once, however many splits it has read.
_TASKS_PER_CORE = 4
_TILE = 1_000_000  # products held at a time; they stay in the cache
_FIRST = 256  # rows from which questions take their first bound

_MATCH = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("chunk_id", T.LongType()),
    T.StructField("case_id", T.LongType()),
    T.StructField("document_id", T.LongType()),
    T.StructField("sequence", T.IntegerType()),
    T.StructField("distance", T.DoubleType()),
])
_KEYS = ["chunk_id", "case_id", "document_id", "sequence"]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a float64 matrix scaled to unit length (NaN for a zero row)."""
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = values.reshape(n, -1)
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    with np.errstate(invalid="ignore", divide="ignore"):
        return rows / lengths[:, None]


class _Best:
    """The k nearest rows seen so far for each of some questions."""

    def __init__(self, n_questions: int, k: int) -> None:
        self.k = k
        self.bound = np.full(n_questions, np.inf)
        self.seen = np.zeros(n_questions, np.int64)
        self.question: list[np.ndarray] = []
        self.distance: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.held = 0

    def offer(self, vectors: np.ndarray, keys: np.ndarray, questions: np.ndarray,
              asked: np.ndarray) -> None:
        """Rows (unit vectors and their keys) for the questions with these indices.

        Products in single precision, which are off by less than `slack`, tell the few rows that can be among the
        nearest; only those are measured, in double precision. Tiles grow with the rows seen, so that a bound is never
        much older than the rows it is held against.
        """
        width = vectors.shape[1]
        slack = (width + 16) * 2.0 ** -23
        padded = -(-len(asked) // 8) * 8  # eight comparisons are looked at as one word
        near = np.zeros((padded, width), np.float32)
        near[:len(asked)] = questions[asked]
        lost = np.isnan(near).any(axis=1)  # no direction: no distance to any row
        near[lost] = 0
        most, seen, at = max(1, _TILE // max(1, padded)), int(self.seen[asked].min()) if len(asked) else 0, 0
        least = np.full(padded, np.inf, np.float32)
        while at < len(vectors) and len(asked):
            part = vectors[at:at + min(most, max(_FIRST, 3 * seen))].astype(np.float32)
            blank = np.isnan(part).any(axis=1)
            part[blank] = 0
            product = part @ near.T
            product[blank] = -np.inf
            product[:, lost] = -np.inf
            first = product[:_FIRST]
            fresh = np.flatnonzero(np.isinf(self.bound[asked]) & ~lost[:len(asked)])
            if len(fresh) and len(first) >= self.k:
                kth = np.partition(first[:, fresh], len(first) - self.k, axis=0)[len(first) - self.k]
                self.bound[asked[fresh]] = 1.0 - kth.astype(np.float64) + slack
            least[:len(asked)] = 1.0 - self.bound[asked] - slack
            hits = (product >= least).reshape(-1, 8)
            words = np.flatnonzero(hits.view(np.uint64))
            word, byte = np.nonzero(hits[words])
            row, column = np.divmod(words[word] * 8 + byte, padded)
            self._measure(vectors, keys, questions, row + at, asked[column])
            at, seen = at + len(part), seen + len(part)
        self.seen[asked] += len(vectors)

    def _measure(self, vectors: np.ndarray, keys: np.ndarray, questions: np.ndarray, row: np.ndarray, question: np.ndarray) -> None:
        """Distances of some pairs of a row and a question; those within the bound are held."""
        step = max(1, 2_000_000 // vectors.shape[1])
        for at in range(0, len(row), step):
            r, q = row[at:at + step], question[at:at + step]
            distance = np.round(1.0 - np.einsum("ij,ij->i", vectors[r], questions[q]), DECIMALS) + 0.0  # no -0.0
            distance[np.isnan(distance)] = np.inf
            within = distance <= self.bound[q]
            self.question.append(q[within])
            self.distance.append(distance[within])
            self.keys.append(keys[r[within]])
            self.held += len(self.question[-1])
            if self.held > 3 * self.k * len(self.bound):
                self._prune()

    def _prune(self) -> None:
        if not self.question:
            return
        q, d = np.concatenate(self.question), np.concatenate(self.distance)
        keys = np.concatenate(self.keys)
        order = np.lexsort((keys[:, 0], d, q))
        q, d, keys = q[order], d[order], keys[order]
        starts = np.searchsorted(q, q, side="left")
        rank = np.arange(len(q)) - starts
        keep = rank < self.k
        full = rank == self.k - 1
        self.bound[q[full]] = np.minimum(self.bound[q[full]], d[full])
        self.question, self.distance, self.keys = [q[keep]], [d[keep]], [keys[keep]]
        self.held = int(keep.sum())

    def result(self, ids: np.ndarray) -> pa.RecordBatch | None:
        self._prune()
        if not self.held:
            return None
        q, d, keys = self.question[0], self.distance[0], self.keys[0]
        distance = pa.array(np.where(np.isinf(d), np.nan, d), pa.float64(), from_pandas=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[q], pa.int64()), *[pa.array(keys[:, i], pa.int64()) for i in range(3)],
             pa.array(keys[:, 3], pa.int32()), distance],
            names=_MATCH.fieldNames(),
        )


def _keys_matrix(batch) -> np.ndarray:
    return np.stack(
        [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in _KEYS], axis=1)


def _nearest_broadcast(chunks: DataFrame, questions: pd.DataFrame, own: pd.DataFrame,
                       k: int) -> DataFrame:
    """Each task ranks its own chunks for all questions; chunks are not moved.

    `questions` and `own` are bounded by the caller.
    """
    questions = questions.sort_values("query_id", kind="stable")
    ids = questions["query_id"].to_numpy(np.int64)
    vectors = np.array(questions["embedding"].tolist(), dtype=np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        vectors /= np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    free = np.flatnonzero(questions["all_cases"].to_numpy(bool))
    # Questions of restricted users by case; those without restriction are ranked apart.
    places = np.searchsorted(ids, own["query_id"].to_numpy(np.int64))
    of_case = {int(c): np.sort(p.to_numpy()) for c, p in
               pd.Series(places).groupby(own["case_id"].to_numpy(np.int64))}
    shipped = chunks.sparkSession.sparkContext.broadcast((ids, vectors, free, of_case))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, free, of_case = shipped.value
        best = _Best(len(ids), k)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = _keys_matrix(batch)
            rows = _matrix(batch.column("embedding"))
            if len(free):
                best.offer(rows, keys, vectors, free)
            for case in np.unique(keys[:, 1]):
                asked = of_case.get(int(case))
                if asked is not None:
                    here = keys[:, 1] == case
                    best.offer(rows[here], keys[here], vectors, asked)
        result = best.result(ids)
        if result is not None:
            yield result

    needed = chunks.select(*[F.col(c) for c in _KEYS], "embedding")
    if not len(free) and len(of_case) <= 1000:
        needed = needed.where(F.col("case_id").isin(sorted(of_case)))  # reaches the scan
    # First level of the merge: one task for several splits, so fewer partial results go to the ranking.
    tasks = _TASKS_PER_CORE * chunks.sparkSession.sparkContext.defaultParallelism
    if needed.rdd.getNumPartitions() > tasks:
        needed = needed.coalesce(tasks)
    return needed.mapInArrow(rank, _MATCH)


# Blocks that are pulled to the driver and sent out again, each a scan of the vectors; more questions meet the chunks in a shuffle.
MAX_BLOCKS = 8
# Bytes of chunk vectors that a task holds while questions are streamed past them, and cases of a user in one row.
MAX_SHARE_BYTES = 64 * 1024 * 1024
MAX_LIST = 10_000


def _nearest_spread(chunks: DataFrame, scoped: DataFrame, edges: DataFrame, k: int, most: int, most_cases: int) -> DataFrame:
    """Every share of the chunks meets every question in one job, whatever the number of questions; nothing goes through the driver.

    A task holds one share of bounded size and reads its group of the questions as a stream, up to `most` of them and
    `most_cases` (question, case) pairs at a time. Chunks are copied to each group and questions to each share; both are few.
    """
    session = chunks.sparkSession
    needed = chunks.select(*_KEYS, "embedding")
    n, width = needed.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).head()
    shares = max(1, -(-n * 8 * max(1, width or 1) // MAX_SHARE_BYTES))
    groups = max(1, -(-_TASKS_PER_CORE * session.sparkContext.defaultParallelism // shares))
    cell = (F.col("_share") * groups + F.col("_group")).cast("int").alias("_cell")
    placed = lambda column, into: F.pmod(F.xxhash64(column), F.lit(into))
    copies = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))

    least = min(MAX_LIST, most_cases)
    of_user = edges.join(scoped.select("user_id").distinct(), "user_id", "left_semi")
    parts = of_user.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / least).alias("_parts"))
    lists = of_user.join(parts, "user_id").groupBy("user_id", F.expr("pmod(xxhash64(case_id), _parts)").alias("_part")).agg(
        F.collect_list(F.col("case_id").cast("bigint")).alias("cases")).drop("_part")
    bound = scoped.where(~F.col("all_cases")).join(lists, "user_id")
    none = F.array().cast("array<bigint>")  # not null: on its way to Python a batch goes over its null lists again for each row
    free = scoped.where("all_cases").withColumn("cases", none)
    asked = free.unionByName(bound).withColumns({"_group": placed("query_id", groups), "_share": copies(shares)}).select(
        cell, F.lit(True).alias("_asked"), F.col("query_id").cast("bigint").alias("chunk_id"), F.lit(None).cast("bigint").alias("case_id"),
        F.lit(None).cast("bigint").alias("document_id"), F.lit(None).cast("int").alias("sequence"), "all_cases", "cases", "embedding")
    held = needed.withColumns({"_share": placed("chunk_id", shares), "_group": copies(groups)}).select(
        cell, F.lit(False).alias("_asked"), *_KEYS, F.lit(None).cast("boolean").alias("all_cases"), none.alias("cases"), "embedding")
    met = held.unionByName(asked).repartitionById(shares * groups, "_cell").sortWithinPartitions("_cell", "_asked", "chunk_id")

    def answers(batch: pa.RecordBatch, keys: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The questions of a batch against a share in order of case."""
        ids = batch.column("chunk_id").to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = _matrix(batch.column("embedding"))
        free = batch.column("all_cases").to_numpy(zero_copy_only=False).astype(bool)
        ends = np.cumsum(batch.column("cases").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        cases = batch.column("cases").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
        known = np.isin(cases, keys[:, 1])
        at = 0
        while at < len(ids):
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, min(at + most, int(np.searchsorted(ends, before + most_cases, "right"))))
            best = _Best(end - at, k)
            here = np.flatnonzero(free[at:end])
            if len(here):
                best.offer(rows, keys, vectors[at:end], here)
            pairs = slice(before, int(ends[end - 1]))
            case, place = cases[pairs][known[pairs]], own[pairs][known[pairs]] - at
            order = np.lexsort((place, case))
            case, place = case[order], place[order]
            for one, first, n_pairs in zip(*np.unique(case, return_index=True, return_counts=True)):
                low, high = np.searchsorted(keys[:, 1], [one, one + 1])
                best.offer(rows[low:high], keys[low:high], vectors[at:end], np.unique(place[first:first + n_pairs]))
            result = best.result(ids[at:end])
            if result is not None:
                yield result
            at = end

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, share, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("_cell").to_numpy(zero_copy_only=False).astype(np.int64) * 2 + batch.column("_asked").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:]):
                piece = batch.slice(begin, end - begin)
                cell, asks = divmod(int(cells[begin]), 2)
                if cell != current:
                    current, share, held = cell, [], None
                if not asks:
                    share.append((_keys_matrix(piece), _matrix(piece.column("embedding"))))
                    continue
                if held is None and share:
                    keys, rows = np.concatenate([s[0] for s in share]), np.concatenate([s[1] for s in share])
                    order = np.argsort(keys[:, 1], kind="stable")
                    held, share = (keys[order], rows[order]), []
                if held is not None:
                    yield from answers(piece, *held)

    return met.mapInArrow(rank, _MATCH)


def _question_blocks(scoped: DataFrame, restricted: DataFrame, most: int,
                     most_cases: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """Questions (query_id, all_cases, embedding) and their (query_id, case_id) pairs in blocks of bounded size.

    A question whose cases fill several blocks is in each of them with other cases; one of a user
    without restriction is free in one block only.
    """
    few = scoped.select("query_id", "all_cases", "embedding").limit(most + 1).toPandas()
    if few.empty:
        return
    most = max(1, min(most, MAX_QUESTION_BYTES // (8 * max(1, len(few["embedding"][0])))))
    if len(few) <= most:
        own = restricted.limit(most_cases + 1).toPandas()
        if len(own) <= most_cases:
            yield few, own
            return
    numbered = number_rows(scoped.select("query_id", "all_cases", "embedding"), [], ["query_id"], "_n")
    asked = stored(numbered.withColumn("block", F.expr(f"_n div {most}").cast("int")).drop("_n"), "block")
    pairs = number_rows(restricted.join(asked.select("query_id", "block"), "query_id"), ["block"], ["query_id", "case_id"], "_n")
    pairs = stored(pairs.withColumn("part", F.expr(f"_n div {most_cases}").cast("int")).drop("_n"), "block", "part")
    parts: dict[int, set[int]] = {r[0]: {0} for r in asked.select("block").distinct().collect()}
    for block, part in pairs.select("block", "part").distinct().collect():
        parts[block].add(part)
    for block in sorted(parts):
        questions = asked.where(F.col("block") == block).drop("block").toPandas()
        for part in sorted(parts[block]):
            own = pairs.where((F.col("block") == block) & (F.col("part") == part)).select("query_id", "case_id").toPandas()
            yield questions.assign(all_cases=questions["all_cases"].to_numpy(bool) & (part == 0)), own


def search_batch(questions: DataFrame, scopes: Scopes, chunks: DataFrame, k: int = TOP_K,
                 max_questions: int = MAX_QUESTIONS,
                 max_question_cases: int = MAX_QUESTION_CASES) -> DataFrame:
    """The k closest chunks of every question, each within the scope of its user.

    questions: query_id, user_id, embedding. Users without a scope row, or with an empty scope,
    get nothing. Questions travel to the chunks in blocks of up to `max_questions`; each block is
    one scan of the vectors, and no chunk is shuffled. More than a few blocks would be that many branches of one
    plan and as many trips through the driver; such questions meet the chunks in one shuffle instead. Where both sides name
    their model, it must be the same one.
    """
    if "model" in questions.columns and "model" in chunks.columns:
        chunks = same_model(questions, chunks)
    scoped = questions.select("query_id", "user_id", "embedding").join(
        scopes.users.select("user_id", "all_cases"), "user_id")
    restricted = scoped.where(~F.col("all_cases")).select("query_id", "user_id").join(
        scopes.edges, "user_id").select("query_id", "case_id")
    most = max(1, max_questions)
    if scoped.count() > MAX_BLOCKS * most or restricted.count() > MAX_BLOCKS * max_question_cases:
        return _ranked(_nearest_spread(chunks, scoped, scopes.edges, k, most, max_question_cases), k)
    found = [_nearest_broadcast(chunks, few, own, k)
             for few, own in _question_blocks(scoped, restricted, most, max_question_cases)]
    if not found:
        return _ranked(chunks.sparkSession.createDataFrame([], _MATCH), k)
    return _ranked(reduce(DataFrame.unionByName, found), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "chunk_id")
    return found.withColumn("match_rank", F.row_number().over(nearest)).where(
        F.col("match_rank") <= k)


def same_model(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks, for comparison with these questions; vectors of another model are an error.

    Both sides carry a `model` column. Chunk rows are checked as they are read.
    """
    names = [r[0] for r in questions.select("model").distinct().limit(2).collect()]
    if len(names) > 1:
        raise ValueError(f"questions of different models: {sorted(map(str, names))}")
    if not names:
        return chunks
    complaint = F.concat(F.lit(f"the question vectors are of model {names[0]}, a chunk is of "),
                         F.coalesce("model", F.lit("no model")))
    return chunks.withColumn("embedding", F.when(
        F.col("model") == F.lit(names[0]), F.col("embedding")).otherwise(F.raise_error(complaint)))


# --- context ------------------------------------------------------------------------------


# Rows of keys that may travel to every task of a scan, and rows that may do so in all: each of them passes the driver.
MAX_WANTED = 250_000
MAX_SENT = 250_000


def fetch(wanted: DataFrame, texts: DataFrame, keys: list[str], most: int = MAX_WANTED) -> DataFrame:
    """Wanted rows with the rows of `texts` that have the same keys, document_id among them.

    The wanted rows travel, in blocks of at most `most` rows cut in order of document; texts do not. Each
    block reads the range of documents it asks for, so where texts lie in that order (as in the
    chunk store) their files are read once in all. So many wanted rows that most texts are asked for, and
    that would be a load for the driver, are joined with the texts where Spark places both.
    """
    wanted = materialise(wanted)
    n, low, high = wanted.agg(F.count(F.lit(1)), F.min("document_id"), F.max("document_id")).head()
    if n <= most:
        return _met(wanted, texts, keys, low, high)
    if n > MAX_SENT:
        return texts.join(wanted, keys)
    numbered = number_rows(wanted, [], ["document_id", *[k for k in keys if k != "document_id"]], "_n")
    blocks = stored(numbered.withColumn("_block", F.expr(f"_n div {most}").cast("int")).drop("_n"), "_block")
    ranges = blocks.groupBy("_block").agg(F.min("document_id"), F.max("document_id")).collect()  # one row per block
    return reduce(DataFrame.unionByName, [
        _met(blocks.where(F.col("_block") == block).drop("_block"), texts, keys, low, high) for block, low, high in sorted(ranges)])


def _met(wanted: DataFrame, texts: DataFrame, keys: list[str], low, high) -> DataFrame:
    """`wanted` is bounded by the caller; the range of documents reaches the scan."""
    near = texts if low is None else texts.where(F.col("document_id").between(low, high))
    return near.join(F.broadcast(wanted), keys)


def with_neighbours(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Context rows of each match: itself, and its neighbours when its text looks cut off.

    One bounded fetch finds the match text and both candidate neighbours together. `matches` has
    query_id, match_rank, case_id, document_id, sequence (and `pass` when there are several).
    """
    return _context(matches, chunks, "text")


def neighbour_places(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """The rows of `with_neighbours` without their texts, which stay where they are; `with_texts` fetches them.

    Instead of chunks it takes their `marks` too.
    """
    return _context(matches, chunks)


def marks(chunks: DataFrame) -> DataFrame:
    """Places of chunks, and whether the text there looks cut off."""
    return chunks.select("case_id", "document_id", "sequence", "page_number", "chunk_id", looks_cut_off(F.col("text")).alias("_own_cut"))


def _context(matches: DataFrame, chunks: DataFrame, *more: str) -> DataFrame:
    group = [c for c in ["query_id", "pass", "match_rank"] if c in matches.columns]
    wanted = matches.select(
        *group, "case_id", "document_id", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("off"),
        "sequence",
    ).withColumn("sequence", (F.col("sequence") + F.col("off")).cast("int"))
    texts = chunks if "_own_cut" in chunks.columns else marks(chunks) if not more else chunks.select(
        "case_id", "document_id", "sequence", "page_number", "chunk_id", looks_cut_off(F.col("text")).alias("_own_cut"), *more)
    # Placed by question once: the windows here, the passages and the prompts all go on from it.
    found = fetch(wanted, texts, ["case_id", "document_id", "sequence"]).repartition("query_id")
    own = Window.partitionBy(*group)  # three rows at most
    cut = F.max(F.when(F.col("off") == 0, F.col("_own_cut"))).over(own)
    return found.withColumn("_cut", cut).where((F.col("off") == 0) | F.col("_cut")).select(
        *group, (F.col("off") + 1).alias("ctx_pos"), (F.col("off") == 0).alias("is_match"),
        "chunk_id", "case_id", "document_id", "sequence", "page_number", *more)


_PLACE = ["case_id", "document_id", "sequence", "chunk_id"]


def with_texts(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """Context rows with the texts of their chunks."""
    return fetch(places, chunks.select(*_PLACE, "text"), _PLACE)


def texts_later(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same as a plain join, of which nothing runs until the texts are asked for."""
    return places.join(chunks.select(*_PLACE, "text"), _PLACE)


def unique_passages(context: DataFrame) -> DataFrame:
    """Each (document, sequence) of a question once, at its first place, numbered from 1.

    A question has at most three rows per match, so its windows are small.
    """
    place = [c for c in ["pass", "match_rank", "ctx_pos"] if c in context.columns]
    first = Window.partitionBy("query_id", "document_id", "sequence").orderBy(*place)
    order = Window.partitionBy("query_id").orderBy(*place)
    return (
        context.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1)
        .withColumn("passage", F.row_number().over(order)).drop("_n")
    )


def accumulate_passes(previous: DataFrame | None, matches: DataFrame, number: int) -> DataFrame:
    """Matches of a further pass, after those of the earlier ones."""
    labelled = matches.withColumn("pass", F.lit(number))
    return labelled if previous is None else previous.unionByName(labelled)


def chunks_of_document(chunks: DataFrame, document_id: int) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("sequence")


def chunks_of_case(chunks: DataFrame, case_id: int) -> DataFrame:
    return chunks.where(F.col("case_id") == case_id)


def name_citations(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """Citations with the file name of their document, or a placeholder."""
    names = documents.select("document_id", "filename")
    return citations.join(names, "document_id", "left").withColumn(
        "document_name", F.coalesce("filename", F.lit(UNKNOWN_DOCUMENT))).drop("filename")
