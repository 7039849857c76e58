"""Word-aligned chunks of pages and of structured cases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.rows import row_by_row, rows_of
from dossier.functions.text import preview, words
from dossier.operators.ordered import number_rows, running_totals
from dossier.schemas import (
    CHUNK_OVERLAP, CHUNK_SIZE, HEADER_CASE, HEADER_SECTION, WINDOW_OVERLAP, WINDOW_SIZE,
)
from dossier.session import materialise


def _check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("the size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must not be negative and must be below the size")


def pack_words(text: str | None, size: int, overlap: int) -> list[str]:
    """Greedy packing; each next piece begins up to `overlap` characters before the last end."""
    tokens = (text or "").split()
    if not tokens:
        return []
    # reach[i]: characters taken by the first i words, one space after each.
    reach = np.concatenate(([0], np.cumsum([len(t) + 1 for t in tokens])))
    pieces, begin = [], 0
    while True:
        fits = int(np.searchsorted(reach, reach[begin] + size + 1, side="right")) - 1
        end = max(begin + 1, fits)
        pieces.append(" ".join(tokens[begin:end]))
        if end >= len(tokens):
            return pieces
        back = int(np.searchsorted(reach, reach[end] - overlap, side="left"))
        begin = max(begin + 1, back)


def packed_pieces(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Pieces of one page, in order."""
    _check(size, overlap)

    @F.arrow_udf("array<string>")
    def pack(texts: pa.Array) -> pa.Array:
        return row_by_row(texts, lambda t: pack_words(t, size, overlap), pa.list_(pa.string()))

    return pack(text)


def chunk_pages(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per piece of a page, numbered within the page (`piece` from 0)."""
    kept = [c for c in pages.columns if c != "text"]
    return rows_of(pages, kept, packed_pieces(F.col("text"), size, overlap), "piece", "text")


# Pages whose offsets may travel to every task: two numbers each.
MAX_OFFSETS = 2_000_000


def chunk_fixed(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, most: int = MAX_OFFSETS) -> DataFrame:
    """Pieces of all pages with `sequence` running over the pages of a document.

    Pages are cut where they lie. Only how many pieces each has is ordered and added up; up to
    `most` pages these offsets travel back to the texts. Beyond that the pages are placed in order first.
    """
    _check(size, overlap)
    if pages.count() > most:
        return number_rows(
            pages, ["document_id"], ["page_number"], "sequence",
            expand=lambda placed: chunk_pages(placed, size, overlap)).drop("piece")
    kept = [c for c in pages.columns if c != "text"]
    cut = materialise(pages.select(*kept, packed_pieces(F.col("text"), size, overlap).alias("_pieces"), F.monotonically_increasing_id().alias("_page")))
    counts = cut.select("document_id", "page_number", "_page", F.size("_pieces").alias("_n"))
    offsets = running_totals(counts, ["document_id"], ["page_number", "_page"], "_n", "_before").select("_page", "_before")
    placed = cut.join(F.broadcast(offsets), "_page")
    return rows_of(placed, [*kept, "_before"], F.col("_pieces"), "_piece", "text").withColumn(
        "sequence", F.col("_before") + F.col("_piece")).drop("_before", "_piece")


def chunk_document(pages: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Chunks of a document held in one row: array of (sequence, page_number, text).

    `pages` is an array of (page_number, text); nothing is shuffled.
    """
    _check(size, overlap)

    kind = pa.list_(pa.struct([("sequence", pa.int32()), ("page_number", pa.int32()), ("text", pa.string())]))

    @F.arrow_udf("array<struct<sequence:int,page_number:int,text:string>>")
    def chunk(documents: pa.Array) -> pa.Array:
        def one(document):
            rows = [(p["page_number"], piece) for p in document
                    for piece in pack_words(p["text"], size, overlap)]
            return [{"sequence": i, "page_number": n, "text": t} for i, (n, t) in enumerate(rows)]

        return row_by_row(documents, lambda d: None if d is None else one(d), kind)

    return chunk(pages)


def windows(text: Column, window: int = WINDOW_SIZE, overlap: int = WINDOW_OVERLAP) -> Column:
    """Word windows of one section; the last one is the first that reaches the end."""
    _check(window, overlap)
    step = window - overlap
    return _windows_of(words(text), window, step)


def _windows_of(tokens: Column, window: int, step: int) -> Column:
    n = F.size(tokens)
    count = F.when(n <= window, F.lit(1)).otherwise(
        F.ceil((n - window) / F.lit(step)).cast("int") + 1
    )
    cut = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda k: F.array_join(F.slice(tokens, k * step + 1, F.lit(window)), " "),
    )
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def chunk_header(case_id: Column, court: Column, city: Column, date: Column,
                 section: Column) -> Column:
    """Bracketed line naming the case, what is known of it, and the section."""
    parts = F.array(
        F.concat(F.lit(f"{HEADER_CASE} "), case_id), court, city, date,
        F.concat(F.lit(f"{HEADER_SECTION} "), section),
    )
    known = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return F.concat(F.lit("["), F.array_join(known, " | "), F.lit("]"))


def chunk_windows(cases: DataFrame, window: int = WINDOW_SIZE,
                  overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Chunks of structured cases, one case per row with its sections in an array.

    The index and the total come from the array itself, so nothing is shuffled.
    """
    _check(window, overlap)
    step = window - overlap
    # Words first, as a column of their own, so that each section is split only once.
    sections = F.transform(
        "sections",
        lambda s: F.struct(s.getField("name").alias("name"),
                           words(s.getField("text")).alias("words")),
    )
    pieces = F.flatten(F.transform(
        "worded",
        lambda s: F.transform(
            _windows_of(s.getField("words"), window, step),
            lambda body: F.struct(s.getField("name").alias("section"), body.alias("body")),
        ),
    ))
    cut = cases.withColumn("worded", sections).withColumn("pieces", pieces)
    rows = rows_of(
        cut, ["case_id", "court", "city", "date", F.size("pieces").alias("total_in_case")],
        F.col("pieces"), "chunk_index", "piece")
    header = chunk_header(F.col("case_id"), F.col("court"), F.col("city"), F.col("date"),
                          F.col("piece.section"))
    return rows.select(
        "case_id", F.col("piece.section").alias("section"), "chunk_index", "total_in_case",
        header.alias("header"), F.col("piece.body").alias("body"),
    ).withColumn("text", F.concat_ws("\n", "header", "body"))


def total_in_case(chunks: DataFrame, key: str = "case_id") -> DataFrame:
    """Chunk rows with the number of chunks of their case (counted before any shuffle)."""
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("total_in_case"))
    return chunks.join(counts, key)


def preview_chunks(chunks: DataFrame, first: int | None = None, last: int | None = None,
                   chars: int | None = 200) -> DataFrame:
    """Chunks of an inclusive page range, cut to a preview, with their word count."""
    kept = chunks
    if first is not None:
        kept = kept.where(F.col("page_number") >= first)
    if last is not None:
        kept = kept.where(F.col("page_number") <= last)
    shown = F.col("text") if chars is None else preview(F.col("text"), chars)
    return kept.withColumn("n_words", F.size(words(F.col("text")))).withColumn("text", shown)
