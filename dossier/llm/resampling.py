"""Importance resampling towards a target: documents drawn by the ratio of two bags of hashed n-grams, with Gumbel noise.

A feature is a run of words; its bucket is its CRC-32 modulo the number of buckets. Words repeat by Zipf's law, so a head of
frequent words travels to all tasks with the exact CRC state of each, and frequent pairs with their buckets: a word of the head
costs one look-up, a longer run goes on from the state of its first word. Features of the tail have their CRC taken
directly. Both give the same buckets, so the totals over all documents and all target texts are exact, whatever the head
holds; it is chosen by counts over all texts and bounded in words, pairs and bytes.

Each text is read for the head and once more for its buckets, which are stored (two bytes a feature) and read twice: for the
totals, one histogram a task, and for the weights. Ranking is a range-partitioned numbering of narrow rows.

A null or empty text has no features and weight 0. Rows that repeat an id count and are drawn each by itself. A row without an
id has no score and is not drawn; its features count. With empty target texts every gain is that of T = t = 0. Extra columns
take no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import nlargest
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.base import ASCII_UPPER, map_batches, query, table, written
from dossier.llm.checksum import CRC_TABLE_SQL, crc_sql
from dossier.operators.ordered import number_rows

BUCKETS = 10_000
LONGEST = 1  # words in a feature
LEAST_WORDS = 20
PER_CENT = 10
SEED = 2024

# The head: what may travel to every task. It decides the speed alone.
HEAD_WORDS = 16_384
HEAD_PAIRS = 16_384
LONGEST_HEAD_WORD = 64

# Bytes to lower-case word bytes or a gap: digits, letters and all of other scripts are words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SLICE = 1 << 20


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of bounded size."""
    data = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES) if text else b""
    at = 0
    while at < len(data):
        gap = data.find(b" ", at + _SLICE)
        end = gap if gap >= 0 else len(data)
        yield data[at:end].split()
        at = end


def _lists_with_last(text: str | None, keep: int) -> Iterator[tuple[list[bytes], int]]:
    """Lists of words, each with up to `keep` words of the list before it at its front, and how many those are."""
    last: list[bytes] = []
    for words in word_lists(text):
        yield last + words, len(last)
        last = (last + words)[-keep:] if keep else []


# --- head ---------------------------------------------------------------------------------


def _task_counts(longest: int, most: int):
    """Per task the most frequent words and pairs; a count may miss what was pruned before, never what the head needs exactly."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        pairs: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for words, before in _lists_with_last(text.as_py(), 1 if longest > 1 else 0):
                    seen.update(words[before:])
                    if longest > 1:
                        pairs.update(map(b" ".join, zip(words, words[1:])))
                    for counter in (seen, pairs):
                        if len(counter) > 16 * most:
                            kept = nlargest(4 * most, counter.items(), key=lambda x: x[1])
                            counter.clear()
                            counter.update(dict(kept))
        rows = [x for counter in (seen, pairs) for x in nlargest(most, counter.items(), key=lambda x: x[1])
                if len(x[0]) <= LONGEST_HEAD_WORD and x[1] > 1]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], names=["feature", "n"])

    return count


class Head:
    """CRC states of frequent words and buckets of frequent pairs. Bounded by the two sizes above."""

    def __init__(self, words: list[bytes], pairs: list[bytes], buckets: int) -> None:
        self.buckets = buckets
        self.states = {w: crc32(w) for w in words}
        self.pairs = {tuple(p.split(b" ")): crc32(p) % buckets for p in pairs}
        self.single = {w: state % buckets for w, state in self.states.items()}

    def features(self, text: str | None, longest: int) -> tuple[int, np.ndarray]:
        """How many words a text has, and the buckets of all its runs of up to `longest` words."""
        n_words, found = 0, []
        for words, before in _lists_with_last(text, longest - 1):
            n_words += len(words) - before
            single, buckets = self.single, self.buckets
            found.append(np.array([single[w] if w in single else crc32(w) % buckets for w in words[before:]], np.int64))
            if longest > 1:
                found.append(np.array(self._runs(words, before, longest), np.int64))
        return n_words, np.concatenate(found) if found else np.empty(0, np.int64)

    def _runs(self, words: list[bytes], before: int, longest: int) -> list[int]:
        """Buckets of the runs of two words and more that end behind the first `before` words."""
        out = []
        for at in range(len(words) - 1):
            first = words[at]
            state = self.states[first] if first in self.states else crc32(first)
            for end in range(at + 1, min(at + longest, len(words))):
                known = self.pairs.get((first, words[end])) if end == at + 1 else None
                if known is None or longest > 2:  # a longer run goes on from the state of the pair
                    state = crc32(words[end], crc32(b" ", state))
                    known = state % self.buckets
                if end >= before:
                    out.append(known)
        return out


def head_of(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS) -> Head:
    """Most frequent words and pairs of all texts (one column)."""
    counted = texts.mapInArrow(_task_counts(longest, max(words, pairs)), "feature binary, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    is_pair = F.instr(F.col("feature").cast("string"), " ") > 0
    top = lambda rows, n: [bytes(r[0]) for r in rows.orderBy(F.desc("n"), "feature").limit(n).collect()]
    return Head(top(counted.where(~is_pair), words), top(counted.where(is_pair), pairs) if longest > 1 else [], buckets)


# --- buckets, totals, gains ---------------------------------------------------------------


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucketed(docs: DataFrame, id_column: str, head: Head, longest: int = LONGEST) -> DataFrame:
    """(id, n_words, n_features, buckets): the bucket of every feature of every text, packed."""
    kept = docs.select(id_column, "text")
    schema = T.StructType([kept.schema[0], T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()),
                           T.StructField("buckets", T.BinaryType())])
    kind = _kind(head.buckets)
    shipped = docs.sparkSession.sparkContext.broadcast(head)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shipped.value.features(text.as_py(), longest) for text in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()),
             pa.array([b.astype(kind).tobytes() for _, b in found], pa.binary())], names=schema.fieldNames())

    return map_batches(kept, work, schema)


def totals(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) over all rows; each task adds up its own histogram first."""
    kind = _kind(buckets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                sums += np.bincount(np.frombuffer(packed.as_py(), kind), minlength=buckets)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sums[found], pa.int64())], names=["bucket", "n"])

    return rows.select("buckets").mapInArrow(add, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight, in thousandths; one value a bucket comes to the driver."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t"))).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    rows = both.collect()  # `buckets` rows at most
    n_raw, n_target = sum(r["s"] for r in rows), sum(r["t"] for r in rows)
    ratio = ((F.col("t") + 1).cast("double") * F.lit(float(n_raw + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(n_target + buckets)))
    spark = raw.sparkSession
    filled = spark.createDataFrame([(r["bucket"], r["s"], r["t"]) for r in rows] + [(-1, 0, 0)], "bucket bigint, s bigint, t bigint")
    found = {r[0]: r[1] for r in filled.select("bucket", F.floor(1000 * F.log(ratio))).collect()}
    return np.array([found.get(b, found[-1]) for b in range(buckets)], np.int64)


def weighted(rows: DataFrame, values: np.ndarray) -> DataFrame:
    """Rows with the sum of the gains of their features instead of their buckets."""
    kind = _kind(len(values))
    kept = [f for f in rows.schema if f.name != "buckets"]
    schema = T.StructType([*kept, T.StructField("weight", T.LongType())])
    shipped = rows.sparkSession.sparkContext.broadcast(values)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums = [int(shipped.value[np.frombuffer(p.as_py(), kind)].sum()) for p in batch.column("buckets")]
        return pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(sums, pa.int64())], names=schema.fieldNames())

    return map_batches(rows, add, schema)


# --- drawing ------------------------------------------------------------------------------


def noise(id_column: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the id alone; null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_column.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def drawn(rows: DataFrame, id_column: str, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """Rows (id, n_words, weight, score, ..) with `rank` 1, 2, 3 .. on that share of the eligible ones with the highest scores."""
    eligible = (F.col("n_words") >= least_words) & F.col(id_column).isNotNull()
    marked = rows.withColumn("_out", (~eligible).cast("int")).withColumn("_down", -F.col("score"))
    n = rows.where(eligible).count() * per_cent // 100
    order = ["_out", "_down", id_column, "weight", "n_features"]
    numbered = number_rows(marked, [], order, "_n", start=1)
    taken = (F.col("_out") == 0) & (F.col("_n") <= n)
    return numbered.withColumn("rank", F.when(taken, F.col("_n"))).drop("_out", "_down", "_n")


def resample(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", longest: int = LONGEST, buckets: int = BUCKETS,
             least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = SEED) -> DataFrame:
    """Documents with n_words, n_features, weight, score and rank, drawn towards the texts of `target`."""
    head = head_of(docs.select("text"), longest, buckets)
    features = written(bucketed(docs, id_column, head, longest), "resampling-buckets")
    wanted = bucketed(target.select(F.lit(0).alias("_id"), "text"), "_id", head, longest)
    values = gains(totals(features, buckets), totals(wanted, buckets), buckets)
    scored = weighted(features, values).withColumn("score", F.col("weight") + noise(F.col(id_column), seed))
    return drawn(written(scored, "resampling-scores"), id_column, least_words, per_cent)


SQL = rf"""
WITH {CRC_TABLE_SQL},
said AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
features AS (SELECT side, r, word, count(*) AS n FROM (SELECT side, r, unnest(w) AS word FROM said) GROUP BY ALL),
bucket_of AS (SELECT word, {crc_sql("word")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM features), crc_table),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM features JOIN bucket_of USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM totals) + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM totals) + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM totals),
weights AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM features JOIN bucket_of USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM said LEFT JOIN weights USING (r) WHERE side = 0),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id, weight, n_features) AS place, count(*) OVER () * {PER_CENT} // 100 AS most
  FROM scored WHERE n_features >= {LEAST_WORDS} AND doc_id IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM scored LEFT JOIN ranked USING (r)"""


@query("op13_resampling", SQL)
def resampling(spark, sf_dir: str) -> DataFrame:
    rows = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
