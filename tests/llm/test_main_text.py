"""Main text of single pages."""

import time

import pytest

from dossier.llm.templates import extract, main_text


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""),
    ("<html><body><nav><a href='/'>Home</a></nav><article><p>One &amp;\n two.</p><p>Three</p></article>"
     "<footer>Foot</footer><script>x()</script></body></html>", "One & two. Three"),
])
def test_main_text(html, text):
    assert main_text(html) == text


def texts_of(spark, pages):
    rows = [(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def page(*parts):
    return f"<html><body>{''.join(parts)}</body></html>"


MENU = "<div class=top><ul><li><a href=/>Start</a></li><li><a href=/b>Shop</a></li></ul></div>"
STORY = "<p>A long story.</p><p>Its end.</p>"
WORDS = "oak elm ash fir yew bay fig box may sal asp nut tea pea rye hop bog fen dew ice".split()


def test_copies_of_one_body_keep_their_text(spark):
    others = [page(MENU, f"<div class=c><p>Only {w} here.</p></div>") for w in WORDS]
    plain = [page(MENU, f"<div class=c>{STORY}</div>")] * 6
    nested = [page(MENU, f"<article><div class=body>{STORY}</div></article>", f"<div class=x>{w}</div>") for w in WORDS[:6]]
    whole = [page(MENU, f"<section class=s>{STORY}</section>", f"<div class={w}></div>") for w in WORDS[:6]]
    for copies in (plain, nested, whole):
        got = texts_of(spark, copies + others)
        assert [got[i] for i in range(6)] == ["A long story. Its end."] * 6
        assert [got[6 + i] for i in range(len(WORDS))] == [f"Only {w} here." for w in WORDS]


def test_near_copies_keep_a_subtree_that_is_all_they_have(spark):
    labels = [f"<div class=t>{w}</div>" for w in WORDS[:6]]
    near = [page(MENU, f"<div class=c>{STORY}</div>", x) for x in labels]
    others = [page(MENU, f"<div class=c><p>Only {w} here.</p></div>", *labels) for w in WORDS]
    got = texts_of(spark, near + others)
    assert [got[i] for i in range(6)] == ["A long story. Its end."] * 6
    assert [got[6 + i] for i in range(len(WORDS))] == [f"Only {w} here." for w in WORDS]


def test_paragraphs_of_a_host_without_articles(spark):
    said, notice = "<p>As they say.</p>", "<p>All rights reserved.</p>"
    pages = [page(MENU, f"<p>Only {w} here.</p>", said if i < 6 else "", notice) for i, w in enumerate(WORDS)]
    got = texts_of(spark, pages)
    assert [got[i] for i in range(len(WORDS))] == [f"Only {w} here." + (" As they say." if i < 6 else "") for i, w in enumerate(WORDS)]


def test_a_page_that_is_all_template_is_empty(spark):
    foot = "<div class=end>Some firm.</div>"
    got = texts_of(spark, [page(MENU, f"<div class=c>Only {w} here.</div>", foot) for w in WORDS] + [page(MENU, foot)])
    assert got[len(WORDS)] == "" and got[0] == "Only oak here."


def test_the_template_goes_before_the_main_block_is_picked(spark):
    notice = "<div class=x1><article><p>Our offer.</p></article></div>"
    top, foot = "<section class=x2><p>Hello, you.</p></section>", "<div class=x3><p>Some firm.</p></div>"
    pages = [page(top, notice, f"<div class=c><p>Only {w} here, and a longer text than that.</p></div>", foot) for w in WORDS]
    got = texts_of(spark, pages)
    assert [got[i] for i in range(len(WORDS))] == [f"Only {w} here, and a longer text than that." for w in WORDS]


@pytest.mark.parametrize("page, text", [
    ("<body><form id=aspnetForm><article><p>Whole article.</p></article></form></body>", "Whole article."),
    ("<body><div class=widget><article>Kept</article></div><footer>no</footer></body>", "Kept"),
    ("<body><div class='post comment-enabled'><main>Kept</main></div></body>", "Kept"),
    ("<body><article>Story</article><div class=related><article>Teaser</article></div></body>", "Story"),
    ("<body><article>Story</article><div class=comments><article class=comment>Reader</article></div></body>", "Story"),
    ("<body><div class=comments><article class=comment>Reader</article></div><p>Body text</p></body>", "Body text"),
    ("<article>a<script>var a='</scripted>'; y</script>b</article>", "ab"),
    ("<article>a<style>p{}</STYLE  >b<script>x</script\n>c</article>", "abc"),
    ("<article>a</article><section id=reader-discussion><p>I think so.</p></section>", "a"),
    ("<body><p>Only text</p><section id=reader-discussion><p>I think so.</p></section></body>", "Only text"),
    ("<script>never closed <article>x</article>", ""),
])
def test_names_forms_and_raw_elements(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("page", [
    "<div>" * 20_000 + "x" + "</span>" * 20_000, "<header>" * 8_000, "<p>" * 30_000, "<li>a" * 30_000, "<table><tr><td>" * 8_000,
    "<b>" * 20_000 + "</i>" * 20_000])
def test_time_grows_with_the_page(page):
    begun = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - begun < 5
