"""Quality rules whose thresholds follow the data: fences from mergeable quantile sketches per language and source.

Every text is measured once. Four rates of the texts that pass the two fixed rules go into sketches, one per language,
source and rate: counts of buckets whose width grows with the value, so a quantile is exact below 256 and at most 1 part in 128
too low above. Sketches merge by adding counts, in any order and with the same result, so those of a language and of the
whole corpus are sums of the smaller ones; they stand in for a source that holds fewer than `LEAST_ROWS` texts of the
language. A rate's fence lies `REACH` times the distance of the quartiles, or of a least spread, outside the quartiles. The fences are
joined to the measures, and a text beyond any of them goes.

A null text has no words and fails, as every text of under 50 words does. A null language or source is a value of its own.
Equal rows are judged each by itself. An empty table gives an empty one. Other columns take no part and are not returned.
The hot key of the final join is a (language, source): its fences are one row, broadcast while the table of fences is small,
and the side of the texts is split by adaptive execution beyond that.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm.base import map_batches, query, table, written

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
LEAST_ROWS = 100
REACH = 3

# Rate: its numerator, denominator, units in one, least distance of the quartiles, and whether low values go too.
RATES = {
    "word_length": ("word_chars", "n_words", 100, 50, True),
    "symbols": ("n_symbols", "n_words", 10_000, 500, False),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, 1_500, False),
    "repeats": ("n_repeat_words", "n_words", 10_000, 1_000, False),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

GAPS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_SLICE = 1 << 20


# --- measuring one text -------------------------------------------------------------------


def word_numbers(text: str) -> tuple[np.ndarray, int]:
    """The words of a text, equal ones with equal numbers from 0 on, and how many differ.

    A long text is cut at gaps, so that its words are not held all at once.
    """
    data = text.encode("utf-8", "surrogatepass")
    numbers: dict[bytes, int] = {}
    found = array("q")
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + _SLICE)
        end = gap.start() if gap else len(data)
        found.extend([numbers.setdefault(w, len(numbers)) for w in data[at:end].split()])
        at = end
    return np.frombuffer(found, np.int64) if found else np.empty(0, np.int64), len(numbers)


def repeated_words(numbers: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    if len(numbers) < 4:
        return 0
    pairs = numbers[:-1] * distinct + numbers[1:]
    if distinct >= 1 << 20:  # three numbers no longer fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * distinct + numbers[2:]
    _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    if not again.any():
        return 0
    covered = np.zeros(len(numbers), bool)
    for shift in range(3):
        covered[shift:shift + len(again)] |= again
    return int(covered.sum())


def line_counts(text: str) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [line for line in text.split("\n") if line.strip(GAPS)]
    return len(lines), len(lines) - len(set(lines))


def measures_of(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one text."""
    if not text:
        return (0,) * len(MEASURES)
    numbers, distinct = word_numbers(text)
    lines, doubled = line_counts(text)
    return (len(numbers), len(text) - sum(map(text.count, GAPS)), sum(map(text.count, SYMBOLS)), doubled,
            repeated_words(numbers, distinct), lines)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of every text."""
    kept = docs.select("doc_id", "lang", "source", "text")
    schema = T.StructType([*kept.schema.fields[:3], *[T.StructField(m, T.LongType()) for m in MEASURES]])

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = zip(*[measures_of(text.as_py()) for text in batch.column("text")])
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(v, pa.int64()) for v in values]], names=schema.fieldNames())

    return map_batches(kept, measure, schema)


# --- sketches -----------------------------------------------------------------------------


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rate(name: str) -> Column:
    above, below, unit, _, _ = RATES[name]
    return F.expr(f"coalesce({above} * {unit}L div nullif({below}, 0), 0L)")


def bucket(value: str) -> Column:
    """The least value of the bucket that a value falls into: its eight highest bits."""
    low = f"greatest(length(bin({value})) - 8, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {low}), {low})")


def sketches(rows: DataFrame) -> DataFrame:
    """Measures to (lang, source, rate, bucket, n): one sketch for each language, source and rate."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rate"), rate(name).alias("value")) for name in RATES]))
    return (rows.where(~base_failed()).select("lang", "source", each.alias("_r")).select("lang", "source", "_r.*")
            .withColumn("bucket", bucket("value")).groupBy("lang", "source", "rate", "bucket").agg(F.count(F.lit(1)).alias("n")))


def merged(sketch: DataFrame) -> DataFrame:
    """The sketches of sources with those of their languages and of the corpus: `level` says which."""
    levels = F.explode(F.array(
        F.struct(F.lit("source").alias("level"), F.col("lang"), F.col("source")),
        F.struct(F.lit("language").alias("level"), F.col("lang"), F.lit(None).cast("string").alias("source")),
        F.struct(F.lit("corpus").alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))))
    return (sketch.withColumn("_l", levels).groupBy("_l.level", "_l.lang", "_l.source", "rate", "bucket")
            .agg(F.sum("n").alias("n")))


def fences(sketch: DataFrame) -> DataFrame:
    """Per sketch its rows and the least and greatest value that stay; quartiles by cumulated counts."""
    own = ["level", "lang", "source", "rate"]
    rising = Window.partitionBy(*own).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # a few thousand buckets at most
    reached = sketch.withColumn("_up_to", F.sum("n").over(rising)).withColumn("_all", F.sum("n").over(Window.partitionBy(*own)))
    quartile = lambda part: F.min(F.when(4 * F.col("_up_to") >= part * F.col("_all"), F.col("bucket")))
    edges = reached.groupBy(*own).agg(quartile(1).alias("_q1"), quartile(3).alias("_q3"), F.max("_all").alias("rows"))
    least = F.create_map(*[x for name, r in RATES.items() for x in (F.lit(name), F.lit(r[3]).cast("bigint"))])[F.col("rate")]
    reach = REACH * F.greatest(F.col("_q3") - F.col("_q1"), least)
    return edges.select(*own, "rows", (F.col("_q1") - reach).alias("low"), (F.col("_q3") + reach).alias("high"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per language and source: the fences of all rates, its own or those of the next wider sketch that has enough rows."""
    found = fences(merged(sketch))
    sides = [F.max(F.when(F.col("rate") == name, F.col(side))).alias(f"{name}_{side}") for name in RATES for side in ("low", "high")]
    wide = found.groupBy("level", "lang", "source").agg(F.max("rows").alias("rows"), *sides)
    names = ["rows", *[f"{name}_{side}" for name in RATES for side in ("low", "high")]]

    wide = written(wide, "quality-fences")  # one row per language and source
    corpus = wide.where("level = 'corpus'").select(*names).head()
    if corpus is None:  # no text passes the fixed rules
        corpus = [None] * len(names)
    whole = F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(names, corpus)])
    language = wide.where("level = 'language'").select(F.col("lang").alias("_lang"), F.struct(*names).alias("_language"))
    rows = wide.where("level = 'source'").select("lang", "source", F.struct(*names).alias("_source")).join(
        language, F.col("lang").eqNullSafe(F.col("_lang")))
    of_source = F.col("_source.rows") >= LEAST_ROWS
    of_language = F.col("_language.rows") >= LEAST_ROWS
    chosen = F.when(of_source, F.col("_source")).when(of_language, F.col("_language")).otherwise(whole)
    level = F.when(of_source, "source").when(of_language, "language").otherwise("corpus")
    return rows.select("lang", "source", level.alias("level"), chosen.alias("fence"))


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Measures with `base_failed`, `level` of the thresholds that judged them (null if their source has none) and `kept`."""
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "level", "fence")
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    within = F.lit(True)
    for name, (*_, both) in RATES.items():
        within = within & (rate(name) <= F.col(f"fence.{name}_high"))
        if both:
            within = within & (rate(name) >= F.col(f"fence.{name}_low"))
    return joined.select(*rows.columns, "level", base_failed().alias("base_failed"),
                         (~base_failed() & F.coalesce(within, F.lit(True))).alias("kept"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Every document with its measures and whether it stays."""
    rows = written(measured(docs), "quality-measures")
    return judged(rows, thresholds(sketches(rows)))


def _sql() -> str:
    rates = ", ".join(f"CASE WHEN {b} = 0 THEN 0 ELSE {a} * {unit} // {b} END AS {name}" for name, (a, b, unit, _, _) in RATES.items())
    melted = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS rate, {name} AS value FROM rated WHERE NOT base_failed" for name in RATES)
    least = "CASE rate " + " ".join(f"WHEN '{name}' THEN {r[3]}" for name, r in RATES.items()) + " END"
    sides = ", ".join(f"max({side}) FILTER (rate = '{name}') AS {name}_{side}" for name in RATES for side in ("low", "high"))
    inside = " AND ".join(f"{name} <= l.{name}_high" + (f" AND {name} >= l.{name}_low" if r[4] else "") for name, r in RATES.items())
    columns = ", ".join(f"CASE WHEN s.rows >= {LEAST_ROWS} THEN s.{c} WHEN g.rows >= {LEAST_ROWS} THEN g.{c} ELSE a.{c} END AS {c}"
                        for c in ("level", *[f"{name}_{side}" for name in RATES for side in ("low", "high")]))
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts)),
windows AS (SELECT r, i, row(word, lead(word) OVER o, lead(word, 2) OVER o) AS triple, lead(word, 2) OVER o AS third FROM tokens WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM windows WHERE third IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, triple) > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM again, range(3) x(d) GROUP BY r),
per_word AS (SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM tokens GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
  SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM texts LEFT JOIN per_word USING (r) LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)),
rated AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {rates} FROM measured),
values_of AS (SELECT *, greatest(length(bin(value)) - 8, 0)::BIGINT AS low_bits FROM ({melted})),
sketch AS (SELECT lang, source, rate, (value >> low_bits) << low_bits AS bucket, count(*) AS n FROM values_of GROUP BY ALL),
merged AS (
  SELECT 'source' AS level, lang, source, rate, bucket, n FROM sketch
  UNION ALL SELECT 'language', lang, NULL, rate, bucket, sum(n) FROM sketch GROUP BY ALL
  UNION ALL SELECT 'corpus', NULL, NULL, rate, bucket, sum(n) FROM sketch GROUP BY ALL),
reached AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bucket) AS up_to, sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM merged),
edges AS (SELECT level, lang, source, rate, min(bucket) FILTER (4 * up_to >= total) AS q1, min(bucket) FILTER (4 * up_to >= 3 * total) AS q3, max(total) AS rows FROM reached GROUP BY ALL),
fences AS (SELECT level, lang, source, rate, rows, q1 - {REACH} * greatest(q3 - q1, {least}) AS low, q3 + {REACH} * greatest(q3 - q1, {least}) AS high FROM edges),
wide AS (SELECT level, lang, source, max(rows) AS rows, {sides} FROM fences GROUP BY level, lang, source),
limits AS (
  SELECT s.lang, s.source, {columns}
  FROM wide s JOIN wide g ON g.level = 'language' AND g.lang IS NOT DISTINCT FROM s.lang JOIN wide a ON a.level = 'corpus' WHERE s.level = 'source')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, l.level, NOT base_failed AND coalesce({inside}, true) AS kept
FROM rated m LEFT JOIN limits l ON l.lang IS NOT DISTINCT FROM m.lang AND l.source IS NOT DISTINCT FROM m.source"""


@query("op12_quality_rules", _sql())
def rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("lang", "source")
