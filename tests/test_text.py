"""Text rules, page assembly, parsing and sections."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from dossier.functions import text
from dossier.operators import pages
from dossier.sources import corpus, files


@pytest.mark.parametrize("raw, tidy", [
    ("a   b", "a b"), ("١٤٣٣ / ١١ / ٣٠", "١٤٣٣/١١/٣٠"), ("1 . 5", "1.5"), ("a / b", "a / b"), ("  x ", "x"),
    ("1/2/3", "1/2/3"), ("1 / 2 / 3", "1/2/3"),
])
def test_tidy_line(value, raw, tidy):
    assert value(text.tidy_line(F.lit(raw))) == tidy


@pytest.mark.parametrize("raw, normal", [
    ("a  \nb\t\n\n\n\nc\n", "a\nb\n\nc"), ("a\r\nb", "a\nb"), ("", ""), (" \n ", ""), ("a\n\nb", "a\n\nb"),
    ("a \nb", "a\nb"), ("a b", "a\nb"), ("x\n \n \n \ny", "x\n\ny"),
])
def test_normalise_text(value, raw, normal):
    assert value(text.normalise_text(F.lit(raw))) == normal


@pytest.mark.parametrize("body, cut", [
    ("The rule holds.", False), ("rule holds.", True), ("The rule holds", True), ("", False), ("   ", False),
    ("12 days: yes!", False), ("هذا نص.", True), ("(a) first?", False), (" The end؟ ", False), ("Ends؛", False),
    ("ǅ titlecase.", True),
])
def test_looks_cut_off(value, body, cut):
    assert value(text.looks_cut_off(F.lit(body))) is cut


def test_words_take_unicode_white_space(value):
    assert value(text.words(F.lit(" a b c\x1cd  "))) == ["a", "b", "c", "d"]
    assert value(text.words(F.lit("  "))) == []


@pytest.mark.parametrize("name, extension", [
    ("a.PDF", ".pdf"), ("a.tar.gz", ".gz"), (".bashrc", ""), ("a", ""), ("dir.x/a", ""), ("..a.b", ".b"), ("a.", "."),
])
def test_file_extension(value, name, extension):
    assert value(text.file_extension(F.lit(name))) == extension


def test_admit_uploads(frame):
    ten = 10 * 1024 * 1024
    rows = frame([("a.PDF", ten), ("b.pdf", ten + 1), ("c.exe", ten + 1), ("d", 1)], "filename string, length bigint")
    got = {r["filename"]: r["reject_reason"] for r in files.admit_uploads(rows).collect()}
    assert got == {"a.PDF": None, "b.pdf": "File exceeds maximum allowed size of 10 MB",
                   "c.exe": "File type '.exe' is not allowed", "d": "File type '' is not allowed"}


@pytest.mark.parametrize("units, logical", [
    (list("abc"), "abc"),
    (["ة", "م", "ك", "ح", "م", "لا"], "لامحكمة"),
    (["٧", "١", " ", ":", "ة", "ي"], "ية: ٧١"),
    (["٣", "٠", "/", "١", "١", "/", "١", "٤", " ", "ه"], "ه ٣٠/١١/١٤"),
    (["أ", " ", "P", "D", "F", " ", "ب"], "ب PDF أ"),
    (["1", "", "2", "ب"], "ب12"),
    ([], ""),
])
def test_visual_to_logical(frame, units, logical):
    rows = frame([(units,)], "units array<string>")
    assert rows.select(pages.visual_to_logical(F.col("units"))).head()[0] == logical


def test_assemble_lines(frame):
    fragments = frame([
        (1, 1, 50.0, 100.4, ["w", "o"]), (1, 1, 10.0, 99.6, ["h", "i"]), (1, 1, 10.0, 200.0, ["t", "o", "p"]),
        (1, 1, -442.0, 100.0, ["g", "h"]), (1, 1, -1.0, 50.0, ["e"]), (1, 1, 10.0, 20.0, [" "]),
        (1, 2, 0.0, 2.5, ["b"]), (1, 2, 5.0, 1.5, ["c"]),
    ], "document_id bigint, page_number int, x double, y double, units array<string>")
    boxes = frame([(1, 1, 0.0, 482.0), (1, 2, 0.0, 482.0), (1, 3, 0.0, 482.0)],
                  "document_id bigint, page_number int, left double, right double")
    got = {r["page_number"]: r["text"] for r in pages.assemble_lines(fragments, boxes).collect()}
    assert got == {1: "top\nhi wo\ne", 2: "b c", 3: ""}


def test_order_of_drawing_decides_between_equal_places(frame):
    fragments = frame([(1, 1, 5.0, 2.0, 2, ["a"]), (1, 1, 5.0, 2.0, 1, ["b"])],
                      "document_id bigint, page_number int, x double, y double, position int, units array<string>")
    boxes = frame([(1, 1, 0.0, 482.0)], "document_id bigint, page_number int, left double, right double")
    assert pages.assemble_lines(fragments, boxes).head()["text"] == "b a"


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def parser():
    def read(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode().split("|") if content else []

    return read


def test_parse_documents(frame):
    rows = frame([(1, bytearray(b"one |\n|two")), (2, bytearray(b"bad")), (3, bytearray(b"")), (4, bytearray(b" | "))],
                 "document_id bigint, content binary")
    parsed = pages.parse_documents(rows, parser)
    errors = {r["document_id"]: r["error"] for r in parsed.collect()}
    assert errors == {1: None, 2: "ParserError: broken", 3: "ParserError: file contains no pages",
                      4: "ParserError: file contains no extractable text"}
    got = [(r["page_number"], r["text"]) for r in pages.explode_pages(parsed).orderBy("page_number").collect()]
    assert got == [(1, "one"), (2, ""), (3, "two")]


def test_split_sections_arabic_articles(frame):
    law = "الفصل الأول\nالمادة الأولى:\nنص أول\nسطر\nالمادة الثانية  :\n\nالمادة الثالثة:\nنص ثالث المادة الرابعة: لا"
    got = pages.split_sections(frame([(1, law)], "page_position int, text string")).orderBy("position").collect()
    assert [(r["name"], r["body"]) for r in got] == [
        ("المادة الأولى", "نص أول\nسطر"), ("المادة الثالثة", "نص ثالث المادة الرابعة: لا")]


def test_sections_without_heading(frame):
    assert pages.split_sections(frame([(1, "no heading")], "page_position int, text string")).count() == 0


def test_merge_pages_in_order(frame):
    rows = frame([(2, 0, "c"), (1, 1, "b"), (1, 0, "a"), (3, 5, "d")], "page_position int, position int, name string")
    got = pages.merge_pages_in_order(rows).orderBy("section_index").collect()
    assert [(r["section_index"], r["name"]) for r in got] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]


@pytest.mark.parametrize("html, expected", [
    ("<main><h1> A </h1><p>b<b>c</b> d</p></main>", "A\nb\nc\nd"),
    ("<p>none</p>", ""),
    ("<main>x<script>var a='</p>';</script><!-- hidden -->y<style>p{}</style></main>", "x\ny"),
    ("<MAIN class='a'>&amp;lt; &euro;&#8364;&nbsp;</MAIN>", "&lt; €€"),
    ("<main></main>", ""),
    ("<main>a<main>b</main>c</main>d", "a\nb\nc"),
    ("<body><main>a<p>b", "a\nb"),
    ("<div><main>a<p>b</div>c", "a\nb"),
    ("<main>a<div>b</main>c</div>d", "a\nb"),
    ("</main><main>a</p>b<br>c</section>d</main>e", "a\nb\nc\nd"),
    ("<main>a<main/>b<img src='</main>'>c</main>d", "a\nb\nc"),
    ("<main>x &amp;<!-- <main> -->y<script>'<main>'</script>z</main>", "x &\ny\nz"),
    ("<main>x<style>q</style><main>y</main> &lt; </main>", "x\ny\n<"),
    ("<maine>x</maine><main>y</main>", "y"),
])
def test_html_main_text(frame, html, expected):
    assert frame([(html,)], "h string").select(corpus.html_main_text(F.col("h"))).head()[0] == expected


@pytest.mark.parametrize("page", ["<main>{}</main>", "<main>{}<main></main></main>"])
@pytest.mark.parametrize("closed_only,expected", [(False, "a && <x &¬it; ☺"), (True, "a &&amp &ltx &amp&notit; ☺")])
def test_references_without_semicolon(frame, page, closed_only, expected):
    """Both ways of reading a page: by pattern, and by following nested tags."""
    html = page.format("a &&amp &ltx &amp&notit; &#9786;")
    assert frame([(html,)], "h string").select(corpus.html_main_text(F.col("h"), closed_only=closed_only)).head()[0] == expected
