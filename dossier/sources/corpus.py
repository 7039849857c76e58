"""Reference corpora: page HTML, structured rows, and the JSON files made from them."""

from __future__ import annotations

import html as html_entities
import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.text import strip
from dossier.operators.ordered import number_rows
from dossier.schemas import COURT_ROW_SECTIONS

_BREAK = "\u0001"


# An ampersand with the character reference that it begins, if there is one with its semicolon.
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)?")


def _open_escaped(html: str) -> str:
    """References without their semicolon, and those of no known name, as the plain characters they are made of."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html)


# Elements without content: they have no end tag.
VOID_ELEMENTS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]


class _Inside(HTMLParser):
    """Text nodes of the first such element, by the open tags: an end tag closes the last open element of its name
    and whatever is open inside that; one without an open element closes nothing."""

    def __init__(self, element: str) -> None:
        super().__init__(convert_charrefs=True)
        self.element, self.open, self.at, self.done = element, [], None, False
        self.texts: list[str] = []
        self.piece: list[str] = []

    def _end_piece(self) -> None:
        text = "".join(self.piece).strip()
        self.piece = []
        if text:
            self.texts.append(text)

    def handle_starttag(self, tag, attrs):
        self._end_piece()
        if tag in VOID_ELEMENTS:
            return
        if self.at is None and tag == self.element:
            self.at = len(self.open)
        self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._end_piece()
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            self.done = self.done or (self.at is not None and len(self.open) <= self.at)

    def handle_data(self, data):
        if self.at is not None and not self.done and not {"script", "style"} & set(self.open[-1:]):
            self.piece.append(data)

    def handle_comment(self, data):
        self._end_piece()

    handle_decl = handle_pi = unknown_decl = handle_comment


def text_inside(html: str, element: str) -> str:
    reader = _Inside(element)
    reader.feed(html)
    reader.close()
    reader._end_piece()
    return "\n".join(reader.texts)


def html_main_text(html: Column, element: str = "main", closed_only: bool = False) -> Column:
    """Text nodes of the first such element, each stripped, blank ones left out, one per line.

    Character references are decoded as browsers do, some also without their semicolon (`&amp` at the end of a text that
    was cut); with `closed_only`, such a one stays as it is written. A page with one start and one end tag of the element, as nearly all have, is cut by pattern.
    Where they are nested, or the end tag is missing, the tags of the page are followed.
    """
    hidden = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
    tags = F.regexp_extract_all(F.regexp_replace(html, hidden, ""), F.lit(rf"(?i)<(/?){element}\b[^>]*>"), F.lit(1))
    plain = (F.size(tags) == 0) | (tags == F.array(F.lit(""), F.lit("/")))
    inside = F.regexp_extract(F.when(plain, html), rf"(?is)<{element}\b[^>]*>(.*?)</{element}\s*>", 1)
    visible = F.regexp_replace(inside, hidden, _BREAK)
    written = _open_escaped if closed_only else str

    @F.pandas_udf(T.StringType())
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or "&" not in t else html_entities.unescape(written(t)))

    @F.pandas_udf(T.StringType())
    def follow(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: None if page is None else text_inside(written(page), element))

    marked = unescape(F.regexp_replace(visible, r"(?s)<[^>]*>", _BREAK))
    texts = F.filter(F.transform(F.split(marked, _BREAK), strip), lambda t: t != "")

    return F.when(plain, F.array_join(texts, "\n")).otherwise(follow(F.when(~plain, html)))


def rows_to_cases(splits: dict[str, DataFrame], order: str, prefix: str,
                  sections: dict[str, str] = COURT_ROW_SECTIONS) -> DataFrame:
    """Rows of several splits as structured cases; the id counts rows within a split.

    `order` names the column that fixes the row order. List columns are joined by newlines.
    """
    parts = []
    for split, rows in splits.items():
        texts = []
        for column, label in sections.items():
            value = F.col(column)
            if isinstance(rows.schema[column].dataType, T.ArrayType):
                value = F.array_join(value, "\n")
            texts.append(F.struct(F.lit(label).alias("name"), value.alias("text")))
        parts.append(rows.select(F.lit(split).alias("split"), F.col(order).alias("_order"),
                                 F.array(*texts).alias("sections")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    numbered = number_rows(rows, ["split"], ["_order"], "_index")
    none = F.lit(None).cast("string")
    return numbered.select(
        F.concat_ws("-", F.lit(prefix), "split", F.col("_index").cast("string")).alias("case_id"),
        none.alias("court"), none.alias("city"), none.alias("date"), "sections")


def write_cases(cases: DataFrame, path: str, source: str) -> None:
    """One JSON record per case, tagged with its source; a rerun replaces the folder."""
    cases.select(F.lit(source).alias("source"), "case_id", "court", "city", "date",
                 "sections").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_chunks(chunks: DataFrame, path: str, source: str) -> None:
    """One JSON record per chunk, tagged with its source; a rerun replaces the folder."""
    chunks.select(F.lit(source).alias("source"), "case_id", "section", "chunk_index",
                  "total_in_case", "header", "body",
                  "text").write.mode("overwrite").json(path)
