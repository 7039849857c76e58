"""Page text: positioned fragments, parsed files, and sections under headings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.rows import parts_of, rows_of
from dossier.functions.text import normalise_text, strip, tidy_line
from dossier.operators.ordered import number_rows
from dossier.schemas import ARABIC, ARTICLE_HEADING, LEFT_TO_RIGHT, NUMBER_JOINERS, PAGE

_HAS_ARABIC = re.compile(ARABIC)
_IS_LEFT_TO_RIGHT = re.compile(LEFT_TO_RIGHT + r"\Z")
# l: left-to-right unit, j: joiner, o: anything else. A run starts and ends with l.
_RUN = re.compile(r"l(?:[lj]*l)?")


def reading_order(units: list[str]) -> str:
    """Text of one line of glyph units given left to right as they appear on the page."""
    if not any(_HAS_ARABIC.search(u) for u in units):
        return "".join(units)
    kinds = "".join(
        "l" if _IS_LEFT_TO_RIGHT.match(u) else "j" if u in NUMBER_JOINERS else "o" for u in units
    )
    parts, at = [], 0
    for run in _RUN.finditer(kinds):
        parts.extend(units[at:run.start()])
        parts.append("".join(units[run.start():run.end()]))
        at = run.end()
    parts.extend(units[at:])
    return "".join(reversed(parts))


_UNIT_END = "\u0001"


@F.pandas_udf(T.StringType())
def _reordered(units: pd.Series) -> pd.Series:
    return units.map(lambda u: None if u is None else reading_order(u.split(_UNIT_END)))


def visual_to_logical(units: Column) -> Column:
    """Reading order of a line's units; only lines with Arabic in them leave the JVM."""
    joined = F.array_join(units, "")
    arabic = joined.rlike(ARABIC)
    return F.coalesce(_reordered(F.when(arabic, F.array_join(units, _UNIT_END))), joined)


def assemble_lines(fragments: DataFrame, boxes: DataFrame) -> DataFrame:
    """Text of each page from its fragments, top line first; a page without any has an empty text.

    fragments: document_id, page_number, x, y, units and, if known, position (the order of drawing,
    which decides between equal x); boxes: document_id, page_number, left, right. What lies outside
    the box is dropped.
    """
    page = ["document_id", "page_number"]
    place = ["x", "position"] if "position" in fragments.columns else ["x"]
    inside = fragments.join(boxes, page).where(
        F.col("x").between(F.col("left") - 1, F.col("right") + 1))
    lines = (
        inside.groupBy(*page, F.bround("y").cast("bigint").alias("row"))
        .agg(F.array_sort(F.collect_list(F.struct(*place, "units"))).alias("parts"))
        .select(*page, "row", F.flatten(F.transform(
            "parts",
            lambda p, i: F.when(i == 0, p["units"]).otherwise(
                F.concat(F.array(F.lit(" ")), p["units"])),
        )).alias("units"))
        .select(*page, "row", tidy_line(visual_to_logical(F.col("units"))).alias("line"))
    )
    # Blank lines go last, inside the page's own list: as a filter on rows the line would be
    # worked out twice.
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("row")).alias("below"), "line"))),
        lambda r: r["line"])
    texts = lines.groupBy(*page).agg(
        F.array_join(F.filter(ordered, lambda line: line != ""), "\n").alias("text"))
    return boxes.select(*page).join(texts, page, "left").withColumn(
        "text", F.coalesce("text", F.lit("")))


def parse_documents(files: DataFrame, parser: Callable[[], Callable[[bytes], list[str]]],
                    content: str = "content") -> DataFrame:
    """Files with `pages` (numbered from 1, text normalised) or an `error`.

    `parser()` is called once per task and returns a function from bytes to page texts.
    """
    kept = [f for f in files.schema.fields if f.name != content]
    raw = T.StructType([*kept, T.StructField("texts", T.ArrayType(T.StringType())),
                        T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = None
        for whole in batches:
            place = whole.schema.get_field_index(content)
            keep = [i for i in range(whole.num_columns) if i != place]
            for at, rows in parts_of(whole.column(place)):
                batch, texts, errors = whole.slice(at, rows), [], []
                for value in batch.column(place):
                    read = read or parser()
                    try:
                        texts.append([t or "" for t in read(value.as_py())])
                        errors.append(None)
                    except Exception as exc:  # noqa: BLE001 - an unreadable file becomes a row
                        texts.append(None)
                        errors.append(f"ParserError: {exc}")
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i) for i in keep], pa.array(texts, pa.list_(pa.string())),
                     pa.array(errors, pa.string())],
                    names=[*[batch.schema.names[i] for i in keep], "texts", "error"],
                )

    parsed = files.mapInArrow(run, raw)
    tidy = F.transform("texts", lambda t, i: F.struct(
        (i + 1).cast("int").alias("page_number"), normalise_text(t).alias("text")))
    pages = parsed.withColumn("pages", tidy.cast(T.ArrayType(PAGE))).drop("texts")
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.size("pages") == 0, F.lit("ParserError: file contains no pages"))
        .when(~F.exists("pages", lambda p: p["text"] != ""),
              F.lit("ParserError: file contains no extractable text"))
    )
    return pages.withColumn("error", error).withColumn(
        "pages", F.when(F.col("error").isNull(), F.col("pages")))


def explode_pages(parsed: DataFrame) -> DataFrame:
    """One row per page of the files that could be read; blank pages stay."""
    rest = [c for c in parsed.columns if c not in ("pages", "error")]
    good = parsed.where(F.col("error").isNull())
    return rows_of(good, rest, F.col("pages"), "_n", "_p").select(*rest, "_p.*")


def split_sections(texts: DataFrame, heading: str = ARTICLE_HEADING, text: str = "text") -> DataFrame:
    """Sections under whole-line headings: (position, name, body) in text order.

    `heading` is a Java pattern whose first group is the name. Text before the first heading and
    empty bodies are left out.
    """
    multi = f"(?mdU){heading}"  # lines end at \\n only; Unicode white space
    names = F.regexp_extract_all(F.col(text), F.lit(multi), F.lit(1))
    bodies = F.slice(F.split(F.col(text), multi), 2, F.greatest(F.size("_names"), F.lit(1)))
    rest = [c for c in texts.columns if c != text]
    return (
        texts.withColumn("_names", names).withColumn("_bodies", bodies)
        .transform(lambda df: rows_of(df, rest, F.arrays_zip("_names", "_bodies"), "position", "_s"))
        .select(*rest, "position", strip(F.col("_s._names")).alias("name"),
                strip(F.col("_s._bodies")).alias("body"))
        .where(F.col("body") != "")
    )


def merge_pages_in_order(sections: DataFrame, page_order: str = "page_position") -> DataFrame:
    """Sections of many pages as one sequence, in page order, numbered from 0."""
    return number_rows(sections, [], [page_order, "position"], "section_index")
