"""Benchmark passages inside documents: size-partitioned MinHash containment search, DataFrame operations only.

An item is found in a document that holds at least LEAST per cent of its distinct five-word shingles (an item of fewer words has
its whole sequence as its one shingle, and so has such a document).

Items are partitioned by the number of their shingles. The sketch of an item is its k smallest min-hash values, k being one
more than the number of shingles it may miss, so a document that contains the item holds at least one of them; each
partition knows the largest value of its sketches. Documents are partitioned by size as well: one of n shingles is
searched only for items small enough to fit, hence only its hashes up to the bound of those partitions are looked up. The long
document is never sketched as a whole, which would lose short items; its few hashes below the bound meet the sketches in one join.
Candidates are then verified by exact containment of the shingles themselves.

Sketch values, candidate pairs and the items' shingles are broadcast only after their number is checked against
MAX_BROADCAST; beyond it the same joins shuffle. A null text has no shingles and no matches. Equal items are all reported. Rows that repeat a doc_id are
one document: the best of them counts; a row with a null doc_id or item_id is never reported. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from dossier.llm.base import query, table, words, written

SIZE = 5
LEAST = 75
SIZE_CLASSES = (8, 16, 32, 64, 128, 256, 1024, 4096)
MAX_BROADCAST = 500_000


def with_shingles(words_column: str, make) -> Column:
    """`make(words, i)` for the start i of every shingle."""
    w = F.col(words_column)
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (SIZE - 1), F.lit(1))), lambda i: make(w, i))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<string>") if make is as_text else F.array().cast("array<bigint>"))


def as_text(w: Column, i: Column) -> Column:
    return F.array_join(F.slice(w, i, SIZE), " ")


def as_hash(w: Column, i: Column) -> Column:
    return F.xxhash64(F.slice(w, i, SIZE))


def checked_broadcast(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Marked for broadcast if what it holds, counted in rows of `counted`, is no more than MAX_BROADCAST."""
    rows = df if counted is None else counted
    return F.broadcast(df) if rows.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else df


def size_class(n: Column) -> Column:
    """The upper end of the partition a number of shingles falls into."""
    found = F.lit(2147483647)
    for bound in reversed(SIZE_CLASSES):
        found = F.when(n <= bound, F.lit(bound)).otherwise(found)
    return found


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, n, partition and the rank of each of its shingles by hash."""
    rows = (items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w"))
            .select("item_id", F.array_distinct(with_shingles("w", as_hash)).alias("hashes"))
            .select("item_id", F.size("hashes").alias("n"), F.explode("hashes").alias("h")))
    place = F.row_number().over(Window.partitionBy("item_id", "n").orderBy("h"))
    return rows.select("item_id", "n", size_class(F.col("n")).alias("partition"), "h", place.alias("place"))


def needed(n: Column) -> Column:
    """Least number of common shingles of an item of n."""
    return F.ceil(n * LEAST / 100).cast("int")


def candidates(docs: DataFrame, sketches: DataFrame) -> DataFrame:
    """doc_id, item_id of pairs that share a value of the item's sketch."""
    bounds = {r["partition"]: (r["bound"], r["least"]) for r in sketches.groupBy("partition").agg(
        F.max("h").alias("bound"), F.min(needed(F.col("n"))).alias("least")).collect()}
    if not bounds:
        return docs.select("doc_id", F.lit(None).cast("bigint").alias("item_id")).where("false")
    n = F.greatest(F.size("w") - (SIZE - 1), F.lit(1))
    bound = F.greatest(*[F.when(n >= least, F.lit(b)) for b, least in bounds.values()], F.lit(None).cast("bigint"))
    hashed = (docs.where("doc_id is not null").select("doc_id", words(F.col("text")).alias("w"))
              .select("doc_id", bound.alias("bound"), with_shingles("w", as_hash).alias("hashes"))
              .select("doc_id", F.explode_outer(F.expr("filter(hashes, h -> h <= bound)")).alias("h")).where("h is not null"))
    return hashed.join(checked_broadcast(sketches.select("item_id", "h")), "h").select("doc_id", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, n_shared of every item that a document contains."""
    shingles = written(item_shingles(items), "item-shingles")
    sketches = shingles.where(F.col("place") <= F.col("n") - needed(F.col("n")) + 1)
    pairs = written(candidates(docs, sketches), "candidates")
    wanted = pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("item_ids"))
    suspects = docs.select("doc_id", "text").join(checked_broadcast(wanted, pairs), "doc_id")
    texts = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("iw")).select(
        "item_id", F.array_distinct(with_shingles("iw", as_text)).alias("item_shingles"))
    held = (suspects.select("doc_id", "item_ids", words(F.col("text")).alias("w"))
            .select("doc_id", "item_ids", with_shingles("w", as_text).alias("shingles")))
    rows = held.select("doc_id", F.explode("item_ids").alias("item_id"), "shingles").join(checked_broadcast(texts, shingles), "item_id")
    found = rows.select("doc_id", "item_id", F.size("item_shingles").alias("n_item"),
                        F.size(F.array_intersect("item_shingles", "shingles")).alias("n_shared"))
    return (found.where(F.col("n_shared") >= needed(F.col("n_item"))).groupBy("doc_id", "item_id")
            .agg(F.max("n_item").cast("bigint").alias("n_item"), F.max("n_shared").cast("bigint").alias("n_shared")))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item; a row with a null doc_id stays. All columns stay."""
    bad = contained(docs, items).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


@query("op5_decontamination", """
WITH d AS (SELECT doc_id AS id, text, 0 AS k FROM documents UNION ALL SELECT item_id, text, 1 FROM benchmark),
w AS (SELECT id, k, [x FOR x IN regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws FROM d),
s AS (SELECT DISTINCT id, k, unnest(CASE WHEN len(ws) >= 5
    THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')]
    ELSE [] END) AS g FROM w),
n AS (SELECT id, count(*) AS n FROM s WHERE k = 1 GROUP BY 1)
SELECT a.id AS doc_id, b.id AS item_id, max(n.n) AS n_item, count(*) AS n_shared
FROM s a JOIN s b ON a.g = b.g AND a.k = 0 AND b.k = 1 JOIN n ON n.id = b.id
GROUP BY a.id, b.id HAVING 100 * count(*) >= 75 * max(n.n)""")
def op5_decontamination(spark, sf_dir):
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
