"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the letters of a whole text, in lower case, every stretch of other characters being
one space; they are hashed to FEATURES columns, weighted (1 + log tf) * idf and brought to unit length.
Document frequencies are counted over every training row. The classifier itself is fitted on a bounded sample,
PER_LANGUAGE rows of each language, or an equal share of MAX_SAMPLE where there are too many languages for that, those with the
smallest hashes, by follow-the-regularised-leader with elastic-net penalties; a fifth of the sample is kept out to find the
temperature that calibrates the scores.

A null text, or one without a letter, is "und" with score 0; so is every text if there is nothing to learn from.
Rows with a null language are not learned from. Repeated rows are learned and predicted as they come. A null id is
neither held out nor learned from. Columns beside doc_id, text and lang are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.base import crc_of_id, map_batches, query, table

FEATURES = 1 << 15
PER_LANGUAGE = 800
MAX_SAMPLE = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
SNIPPET = 40
ABOVE_CHANCE = 1.2
END_OF_LETTERS = 0x40000  # beyond are no letters

_LETTERS: np.ndarray | None = None


def letters_table() -> np.ndarray:
    """Whether a code point below END_OF_LETTERS is a letter; built once in a worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(END_OF_LETTERS)), bool, END_OF_LETTERS)
    return _LETTERS


def letter_codes(text: str) -> np.ndarray:
    """Code points in lower case, with one space (0) around and between stretches of letters; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters_table()[np.minimum(codes, END_OF_LETTERS - 1)]
    if not letter.any():
        return np.empty(0, np.uint32)
    codes = np.where(letter, codes, 0).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = letter[1:] | letter[:-1]
    return np.concatenate(([0], codes[keep], [0])).astype(np.uint32)


def counts_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the codes: columns and their counts."""
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (codes[1:] * np.uint32(0x85EBCA77))) + np.uint32(0x27D4EB2F)
    two *= np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (codes[2:] * np.uint32(0x165667B1))) + np.uint32(0x7FEB352D)
    three *= np.uint32(0x846CA68B)
    counts = np.zeros(FEATURES, np.int64)
    for h in (one, two, three):
        counts += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(FEATURES - 1), minlength=FEATURES)
    columns = np.flatnonzero(counts)
    return columns, counts[columns]


def vector(columns: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[columns]
    norm = math.sqrt(float(x @ x))
    return x / norm if norm else x


class Model:
    """Weights by feature and language, inverse document frequencies, temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float, usual: float = 0.0):
        self.languages, self.weights, self.idf, self.temperature = languages, weights, idf, temperature
        self.usual = usual  # score that all but one in a hundred of the held-out rows reach

    def least_score(self, above_chance: float) -> float:
        """The score below which a text is taken for one of no learned language.

        A text of which the model knows nothing has one chance for each language. The limit lies half way between that
        and the usual score, but between `above_chance` and 2 chances; with one language there is none.
        """
        chance = 1.0 / max(1, len(self.languages))
        return min(2.0 * chance, max(above_chance * chance, (chance + self.usual) / 2)) if len(self.languages) > 1 else 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = letter_codes(text) if text and self.languages else ()
        if not len(codes):
            return "und", 0.0
        columns, counts = counts_of(codes)
        z = (vector(columns, counts, self.idf) @ self.weights[columns]) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights by per-coordinate follow-the-regularised-leader over the rows (columns, values, class)."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def weights(zs, ns):
        return np.where(np.abs(zs) > L1, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            columns, x, label = rows[i]
            zs, ns = z[columns], n[columns]
            w = weights(zs, ns)
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[label] -= 1.0
            g = x[:, None] * p[None, :]
            squares = g * g
            z[columns] = zs + g - (np.sqrt(ns + squares) - np.sqrt(ns)) / ALPHA * w
            n[columns] = ns + squares
    return weights(z, n)


def temperature_of(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by a fixed geometric grid."""
    best, least = 1.0, math.inf
    for t in np.geomspace(0.05, 5.0, 60):
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(labels)), labels]))
        if loss < least:
            best, least = float(t), loss
    return best


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """Of each language the rows with the smallest hashes, per_language of them or, with many languages, an equal share of MAX_SAMPLE."""
    marked = labelled.withColumn("_h", F.xxhash64("doc_id", "text")).withColumn("_b", F.shiftright("_h", 52))
    languages = labelled.agg(F.count_distinct("lang")).head()[0]
    quota = max(1, min(per_language, MAX_SAMPLE // max(1, languages)))
    # At most 4,096 ranges of hashes in a language: the last range that is needed.
    below = F.sum("count").over(Window.partitionBy("lang").orderBy("_b")) - F.col("count")
    bounds = marked.groupBy("lang", "_b").count().withColumn("_below", below).where(f"_below < {quota}").groupBy("lang").agg(F.max("_b").alias("_last"))
    near = marked.join(F.broadcast(bounds), "lang").where("_b <= _last")
    return near.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("_h"))).where(f"_n <= {quota}").select("doc_id", "text", "lang")


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on labelled rows (doc_id, text, lang); frequencies cover all of them, the weights a bounded sample."""
    labelled = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")

    def frequencies(batches):
        df, total = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                codes = letter_codes(text)
                if len(codes):
                    df[counts_of(codes)[0]] += 1
                    total += 1
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(df[seen], total))], ["f", "n"])

    counted = labelled.select("text").mapInArrow(frequencies, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect()
    if not counted or not (total := next((r["n"] for r in counted if r["f"] < 0), 0)):
        return Model([], np.zeros((FEATURES, 0)), np.zeros(FEATURES), 1.0)
    df = np.zeros(FEATURES)
    for r in counted:
        if r["f"] >= 0:
            df[r["f"]] = r["n"]
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0

    def features(batch):
        out = []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            codes = letter_codes(text)
            at = len(codes) // 3
            for part in (codes, codes[at:at + SNIPPET]):
                if len(part) > 2:
                    columns, counts = counts_of(part)
                    out.append({"lang": lang, "f": columns.tolist(), "n": counts.tolist()})
        return pa.RecordBatch.from_pylist(out, pa.schema([("lang", pa.string()), ("f", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])) if out else None

    rows = map_batches(_sample(labelled, per_language), features, "lang string, f array<int>, n array<int>").toArrow()
    languages = sorted(set(rows.column("lang").to_pylist()))
    labels = [languages.index(x) for x in rows.column("lang").to_pylist()]
    data = []
    for f, n, y in zip(rows.column("f"), rows.column("n"), labels, strict=True):
        columns = np.asarray(f.values)
        data.append((columns, vector(columns, np.asarray(n.values), idf), y))
    data.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes()))
    kept, fit = data[::5], [r for i, r in enumerate(data) if i % 5]
    if not fit:
        kept = fit = data
    weights = follow_leader(fit, len(languages))
    logits = np.stack([x @ weights[c] for c, x, _ in kept]) if kept else np.zeros((1, len(languages)))
    temperature = temperature_of(logits, np.array([y for _, _, y in kept])) if kept else 1.0
    p = np.exp((logits - logits.max(axis=1, keepdims=True)) / temperature)
    usual = float(np.quantile(p.max(axis=1) / p.sum(axis=1), 0.01))
    return Model(languages, weights.astype(np.float32), idf.astype(np.float32), temperature, usual)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row; nothing is shuffled. The model's size is fixed by FEATURES."""

    def work(batch):
        found = [model.predict(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
            ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", "text"), work, "doc_id bigint, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(4)) == 2, F.lit(False))


def trained_on(docs: DataFrame) -> Model:
    return train(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))


def known_language(docs: DataFrame, model: Model, above_chance: float = ABOVE_CHANCE) -> DataFrame:
    """The rows whose text is in a known language, with a calibrated score of `Model.least_score`; all columns stay. With one
    learned language only texts without letters go."""
    least = model.least_score(above_chance)

    def work(batch):
        found = [model.predict(t) for t in batch.column("text").to_pylist()]
        return batch.filter(pa.array([x != "und" and s >= least for x, s in found], pa.bool_()))

    return map_batches(docs, work, docs.schema)


@query("op10_language")
def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return predict(docs, trained_on(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
