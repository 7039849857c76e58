"""Likelihood of texts under a subword lattice whose weights start from the scores of an existing vocabulary.

A word is taken whole, as often as training saw it, or spelled: as pieces of a published vocabulary and a
stop. All segmentations count: a forward recursion in log space over the bytes of the word sums them. Every
byte is a piece, so every word can be spelled. With W words and E ends in training, V distinct words and the discount D:

    P(word) = (max(c - D, 0) + (D * V + 1) * S(word)) / (W + E + 2)        P(end) = (E + 1) / (W + E + 2)

which is a distribution over whole texts. No piece reaches over a space, so the sum over all segmentations of a document
is the product over its words, and each distinct word needs one recursion. S starts from the vocabulary's own scores
(these are ranks; a rank r stands for a weight of 1 / (r + RANK_SHIFT)) and takes one step of expectation and
maximisation over all distinct words of training; the vocabulary itself stays as it is.

Documents are read once and packed in chunks of about CHUNK_TOKENS tokens: the chunk's words, and each document as
counts over them. Words travel once per chunk with their counts, packed in buckets of the range of their hash, so a word in
every document is one entry per chunk, and buckets are alike. Scores return to their chunk the same way. The number of buckets
follows the number of entries.

A null, empty or blank text is its end alone. A null doc_id is neither held out nor learned from. Repeated rows
are learned and scored as they come. With nothing to learn from, words are spelled by the vocabulary's scores. Columns beside
doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.base import crc_of_id, map_batches, query, table, words_of, written

CHUNK_TOKENS = 1 << 21
BUCKET_WORDS = 1 << 20
DISCOUNT = 0.5
RANK_SHIFT = 10.0
PRIOR = 100.0  # weight of the vocabulary's own scores, in pieces
STOP = b""  # the stop's place in the table of pieces
STOP_SHARE = 0.2

CHUNKS = ("chunk bigint, words binary, train binary, doc_ids array<bigint>, held array<boolean>, tokens binary, "
          "widths binary, at binary, n binary, train_docs bigint")
CHUNKS_ARROW = pa.schema([
    ("chunk", pa.int64()), ("words", pa.binary()), ("train", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
    ("held", pa.list_(pa.bool_())), ("tokens", pa.binary()), ("widths", pa.binary()), ("at", pa.binary()),
    ("n", pa.binary()), ("train_docs", pa.int64())])
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(10)) == 0, F.lit(False))


def vocabulary(path: str | None = None) -> dict[bytes, float]:
    """Weights of the pieces of a vocabulary file as bytes, a leading space for a word's start, and of the stop; they sum to 1."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    size, weights = model.get_piece_size(), Counter()
    for i in range(size):
        if model.is_byte(i):
            weights[bytes([int(model.id_to_piece(i)[3:5], 16)])] += 1.0 / (size + RANK_SHIFT)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and model.get_score(i) > -1e8:
            weights[model.id_to_piece(i).replace("▁", " ").encode()] += 1.0 / (RANK_SHIFT - model.get_score(i))
    total = sum(weights.values())
    return {p: (1 - STOP_SHARE) * w / total for p, w in weights.items()} | {STOP: STOP_SHARE}


def arcs_of(weights: dict[bytes, float]) -> dict[bytes, float | None]:
    """Log weights of the pieces; None for what only begins a piece."""
    out: dict[bytes, float | None] = {}
    for piece in weights:
        for n in range(1, len(piece)):
            out.setdefault(piece[:n], None)
    return out | {p: math.log(w) for p, w in weights.items()}


def log_add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def forward(spelled: bytes, arcs: dict) -> list[float]:
    """Log weight of all segmentations of each prefix."""
    n = len(spelled)
    out = [0.0] + [-math.inf] * n
    for i in range(n):
        here = out[i]
        for j in range(i + 1, n + 1):
            weight = arcs.get(spelled[i:j], 0.0)
            if weight == 0.0:
                break
            if weight is not None:
                out[j] = log_add(out[j], here + weight)
    return out


def spelling(word: bytes, arcs: dict) -> float:
    """Natural log of S(word)."""
    return forward(b" " + word, arcs)[-1] + arcs[STOP]


def expect(word: bytes, arcs: dict, totals: Counter) -> None:
    """Adds the expected number of each piece in a spelling of the word."""
    spelled = b" " + word
    n, ahead = len(spelled), forward(spelled, arcs)
    behind = [-math.inf] * n + [0.0]
    for i in range(n - 1, -1, -1):
        for j in range(i + 1, n + 1):
            weight = arcs.get(spelled[i:j], 0.0)
            if weight == 0.0:
                break
            if weight is not None and behind[j] > -math.inf:
                behind[i] = log_add(behind[i], weight + behind[j])
                totals[spelled[i:j]] += math.exp(ahead[i] + weight + behind[j] - ahead[n])
    totals[STOP] += 1.0


def chunks(docs: DataFrame) -> DataFrame:
    """The documents as counts over the words of their chunk."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        local: dict[bytes, int] = {}
        train, ids, held, tokens, widths, at, n, learned, size = [], [], [], [], [], [], [], 0, 0

        def flush():
            # Words in the order of their hash: whatever the number of buckets, each is one stretch.
            hashes = np.fromiter(map(zlib.crc32, local), np.int64, len(local))
            order = np.argsort(hashes, kind="stable")
            place, names = np.empty(len(order), "<i4"), list(local)
            place[order] = np.arange(len(order), dtype="<i4")
            row = [task << 24 | number, b" ".join([names[i] for i in order.tolist()]), np.array(train, "<i8")[order].tobytes(), ids, held,
                   np.array(tokens, "<i8").tobytes(), np.array(widths, "<i8").tobytes(), place[np.concatenate(at)].tobytes(),
                   np.concatenate(n).tobytes(), learned]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, CHUNKS_ARROW, strict=True)], schema=CHUNKS_ARROW)

        for batch in batches:
            for doc_id, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held").to_pylist(), batch.column("text"), strict=True):
                found = Counter(words_of(text.as_py()))
                for word in found:
                    if word not in local:
                        local[word] = len(train)
                        train.append(0)
                places = np.fromiter(map(local.__getitem__, found), "<i4", len(found))
                if doc_id is not None and not out:
                    learned += 1
                    for place, k in zip(places.tolist(), found.values(), strict=True):
                        train[place] += k
                ids.append(doc_id)
                held.append(out)
                at.append(places)
                n.append(np.fromiter(found.values(), "<i4", len(found)))
                widths.append(len(found))
                tokens.append(sum(found.values()) + 1)
                size += tokens[-1]
                if size >= CHUNK_TOKENS:
                    yield flush()
                    local, train, ids, held, tokens, widths, at, n, learned, size = {}, [], [], [], [], [], [], [], 0, 0
                    number += 1
        if ids:
            yield flush()

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text").mapInArrow(run, CHUNKS)


def slices(packed: DataFrame, bits: int) -> DataFrame:
    """The words of each chunk with their number in its training documents, one row for each bucket of their hash."""

    def run(batches):
        for batch in batches:
            for chunk, joined, train in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = joined.split(b" ") if joined else []
                buckets = np.fromiter(map(zlib.crc32, found), np.int64, len(found)) >> (32 - bits)
                edge = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if found else np.empty(0, np.int64)
                stop = np.append(edge[1:], len(found))
                counts = np.frombuffer(train, "<i8")
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(buckets[edge]), pa.array(np.full(len(edge), chunk, np.int64)),
                         pa.array([b" ".join(found[i:j]) for i, j in zip(edge.tolist(), stop.tolist(), strict=True)], pa.binary()),
                         pa.array([counts[i:j].tobytes() for i, j in zip(edge.tolist(), stop.tolist(), strict=True)], pa.binary())],
                        ["bucket", "chunk", "words", "train"])

    return packed.select("chunk", "words", "train").mapInArrow(run, "bucket bigint, chunk bigint, words binary, train binary")


def word_counts(sliced: DataFrame) -> DataFrame:
    """bucket, words, c: the distinct words of each bucket with their number in training. A word has one entry per chunk here,
    so a word of every document makes its bucket no larger than others."""

    def work(group: pa.Table) -> pa.Table:
        totals: dict[bytes, int] = {}
        for joined, train in zip(group.column("words"), group.column("train"), strict=True):
            for word, c in zip(joined.as_py().split(b" "), np.frombuffer(train.as_py(), "<i8").tolist(), strict=True):
                totals[word] = totals.get(word, 0) + c
        return pa.table([group.column("bucket").slice(0, 1).combine_chunks(), pa.array([b" ".join(totals)], pa.binary()),
                         pa.array([np.fromiter(totals.values(), "<i8", len(totals)).tobytes()], pa.binary()),
                         pa.array([sum(totals.values())], pa.int64()), pa.array([sum(c > 0 for c in totals.values())], pa.int64())],
                        names=["bucket", "words", "c", "known", "kinds"])

    return sliced.groupBy("bucket").applyInArrow(work, "bucket bigint, words binary, c binary, known bigint, kinds bigint")


def piece_weights(counted: DataFrame, prior: dict[bytes, float]) -> dict[bytes, float]:
    """One step of expectation and maximisation over the distinct training words; as many weights as the vocabulary has pieces."""
    def run(batches):
        arcs, totals = arcs_of(prior), Counter()
        for batch in batches:
            for joined, c in zip(batch.column("words").to_pylist(), batch.column("c").to_pylist(), strict=True):
                for word, k in zip(joined.split(b" "), np.frombuffer(c, "<i8").tolist(), strict=True):
                    if k > 0:
                        expect(word, arcs, totals)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.binary()), pa.array(list(totals.values()), pa.float64())], ["piece", "n"])

    expected = (counted.select("words", "c").mapInArrow(run, "piece binary, n double")
                .groupBy("piece").agg(F.sum("n").alias("n")).collect())
    seen = {bytes(r["piece"]): r["n"] for r in expected}
    total = sum(seen.values()) + PRIOR
    return {p: (seen.get(p, 0.0) + PRIOR * q) / total for p, q in prior.items()}


def score(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    packed = written(chunks(docs), "lm-chunks")
    ends, entries = packed.agg(F.coalesce(F.sum("train_docs"), F.lit(0)), F.coalesce(F.sum(F.octet_length("train") / 8), F.lit(0))).head()
    bits = max(5, int(entries // BUCKET_WORDS).bit_length())
    sliced = slices(packed, bits)
    counted = written(word_counts(sliced), "lm-counts")
    known, kinds = counted.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).head()
    total, distinct = known + ends, kinds + (ends > 0)
    weights = piece_weights(counted, vocabulary(vocabulary_path))
    below = total + 0.1 * (distinct + 1)

    def log_base(c):
        return np.log10((c + 0.1) / below)

    share = DISCOUNT * kinds + 1.0

    def scored(batch):
        arcs, out = _arcs(weights), []
        for joined, counts in zip(batch.column("words").to_pylist(), batch.column("c").to_pylist(), strict=True):
            spelled = np.array([spelling(w, arcs) for w in joined.split(b" ")]) + math.log(share)
            kept = np.maximum(np.frombuffer(counts, "<i8") - DISCOUNT, 0.0)
            with np.errstate(divide="ignore"):
                out.append((np.logaddexp(np.log(kept), spelled) / math.log(10) - math.log10(total + 2.0)).tobytes())
        return pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("words"), batch.column("c"), pa.array(out, pa.binary())],
                                          ["bucket", "words", "c", "model"])

    scores = written(map_batches(counted.select("bucket", "words", "c"), scored, "bucket bigint, words binary, c binary, model binary"), "lm-scores")

    def answer(asked: pa.Table, known_words: pa.Table) -> pa.Table:
        row = known_words.to_pylist()[0]
        place = {w: i for i, w in enumerate(row["words"].split(b" "))}
        c, model = np.frombuffer(row["c"], "<i8"), np.frombuffer(row["model"], "<f8")
        counts, models = [], []
        for joined in asked.column("words"):
            at = np.array([place[w] for w in joined.as_py().split(b" ")])
            counts.append(c[at].tobytes())
            models.append(model[at].tobytes())
        return pa.table([asked.column("chunk").combine_chunks(), asked.column("bucket").combine_chunks(), pa.array(counts, pa.binary()),
                         pa.array(models, pa.binary())], names=["chunk", "bucket", "c", "model"])

    back = (sliced.select("bucket", "chunk", "words").groupBy("bucket").cogroup(scores.groupBy("bucket"))
            .applyInArrow(answer, "chunk bigint, bucket bigint, c binary, model binary"))
    end = (float(log_base(ends)), math.log10((ends + 1.0) / (total + 2.0)), int(ends > 0))

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        widths, at, n = (np.frombuffer(row[k], t) for k, t in (("widths", "<i8"), ("at", "<i4"), ("n", "<i4")))
        parts = right.sort_by("bucket")
        c = np.frombuffer(b"".join(parts.column("c").to_pylist()), "<i8")
        model = np.frombuffer(b"".join(parts.column("model").to_pylist()), "<f8")
        ends_at = np.cumsum(widths)

        def sums(values):
            running = np.zeros(len(widths))
            filled = widths > 0
            if filled.any():
                running[filled] = np.add.reduceat(values, (ends_at - widths)[filled])
            return running

        return pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(np.frombuffer(row["tokens"], "<i8")),
                         pa.array(sums((c > 0)[at] * n).astype(np.int64) + end[2]), pa.array(sums(log_base(c)[at] * n) + end[0]),
                         pa.array(sums(model[at] * n) + end[1])],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    vectors = packed.select("chunk", "doc_ids", "held", "tokens", "widths", "at", "n")
    out = vectors.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(gather, SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"), "base_score", "score")


_ARCS: dict = {}


def _arcs(weights: dict[bytes, float]) -> dict:
    """The arcs of a model, built once in a worker."""
    mark = hash(tuple(weights.items()))
    if mark not in _ARCS:
        _ARCS.clear()
        _ARCS[mark] = arcs_of(weights)
    return _ARCS[mark]


@query("op8_lm_scoring")
def op8_lm_scoring(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
