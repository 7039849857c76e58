"""Main text of web pages, with the site's template removed.

Every element of a page is hashed with its class, its text (digits as 0) and its children. Pages of a host with the same main text
(digits as 0) are copies of one body. Spark counts, for each host, the bodies that hold a hash. A subtree on at least MIN_PAGES
bodies and SHARE of the host's bodies belongs to the template and is deleted. As each body adds its elements only
once, a host has no more than elements per page / SHARE such hashes; they are kept as one short list per host, with their
share. Elements that say by their tag, role, class or id that they are no article (menus, headers, footers, sidebars, notices,
adverts, forms, comments) are deleted as well. Text blocks inside an article stay even where they recur: pages of a host may
quote or repeat each other. Outside an article a text block goes only if it is on more than TEXT_SHARE of the bodies, or if it
recurs and all its words are links. If nothing is left of a page, the subtree that is on the fewest bodies stays, unless it
is one of several on more than TEXT_SHARE of them: such a page is all template. The template goes first: an article or main
in a deleted container is not looked at.

The text is that of the outermost article elements; failing these, of main; failing that, of articles or main inside a form or a
section dropped for its names; failing that, of the body. Blocks are joined by one
space, inline elements by nothing.

A null or empty html gives an empty text. A page without a host takes part in no count. Repeated rows are pages of their own.
Columns beside page_id, url and html are not read. Unclosed, stray and overlapping tags are closed as browsers do.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.base import map_batches, query, table, written

MIN_PAGES = 5
SHARE = 0.1
TEXT_SHARE = 0.5
MAX_BROADCAST = 1_000_000

# --- fixed values: kinds of elements ---------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split())
TEXT_BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption b i em "
    "strong a span code q cite small sub sup u s mark time abbr br hr img".split())
NO_ARTICLE = frozenset(
    "nav header footer aside form script style noscript template iframe button select textarea input dialog menu svg "
    "canvas object head title datalist".split())
NO_ARTICLE_NAMES = frozenset(
    "nav navbar navigation menu submenu footer sidebar ad ads adv advert adverts advertisement sponsor sponsored promo banner "
    "cookie cookies consent gdpr notice notices alert comment comments commentlist disqus respond replies discussion discussions "
    "reactions talkback guestbook share sharing social "
    "related recommended newsletter subscribe breadcrumb breadcrumbs popup modal overlay login signup toolbar pagination "
    "pager masthead widget widgets skip copyright".split())
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
SOFT = frozenset("form div section td span center fieldset".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
# -----------------------------------------------------------------------------------------------------

TOKEN = re.compile(
    r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^"'>]++|"[^"]*"|'[^']*')*+)>"""
    r"""|(?P<odd>/?[A-Za-z][^\s/>]*[^>]*(?:>|\Z))|[!?/][^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
NAME = re.compile(r"[A-Za-z0-9]+")
DIGITS = re.compile(r"[0-9]")


class Node:
    __slots__ = ("tag", "parts", "dropped", "mark", "hash")

    def __init__(self, tag: str, dropped: bool, label: str):
        self.tag, self.dropped, self.parts, self.hash = tag, dropped, [], 0
        self.mark = xxhash.xxh64(f"<{tag} {label}>".encode())


def names_of(attrs: str) -> tuple[str, bool, bool]:
    """Class as a label; whether class, id or role say that this is no article; whether they speak of comments."""
    label, no, comment = "", False, False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            names = {n.lower() for n in NAME.findall(value)}
            no = no or not NO_ARTICLE_NAMES.isdisjoint(names)
            comment = comment or not names.isdisjoint(("comment", "comments"))
            label += value if key == "class" else ""
        elif key == "role":
            no = no or value.strip().lower() in NO_ARTICLE_ROLES
        elif key == "hidden":
            no = True
    return label, no, comment


def parse(text: str) -> tuple[Node, list[Node]]:
    """The tree of a page and all its closed elements."""
    root = Node("#", False, "")
    stack, nodes, at = [root], [], 0
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a tag

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            places[node.tag].pop()
            node.hash = node.mark.intdigest()
            stack[-1].mark.update(node.hash.to_bytes(8, "little"))
            nodes.append(node)

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def depth_of(tags, stops) -> int:
        """The innermost open element of the tags, unless one of the stops is open inside it."""
        found = last(tags)
        return found if found >= last(stops) else 0

    def data(piece: str) -> None:
        if piece:
            top = stack[-1]
            top.parts.append(piece)
            top.mark.update(" ".join(DIGITS.sub("0", piece).split()).encode("utf-8", "surrogatepass"))

    while True:
        m = TOKEN.search(text, at)
        data(text[at:m.start()] if m else text[at:])
        if m is None:
            break
        at = m.end()
        tag, attrs = m["tag"], m["attrs"]
        end = m["end"]
        if m["odd"]:
            head = re.match(r"(/?)([A-Za-z][^\s/>]*)", m["odd"])
            end, tag, attrs = head[1], head[2], ""
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if tag == "br":
                stack[-1].parts.append(Node("br", False, ""))
                continue
            depth = depth_of({tag}, () if tag not in TEXT_BLOCKS else ("article", "main", "body", "td", "th"))
            if depth:
                close(depth)
            continue
        if tag in CLOSES_P:
            depth = depth_of({"p"}, ("article", "main", "body", "div", "td", "th", "li", "section", "button", "blockquote"))
            if depth:
                close(depth)
        if tag in CLOSES:
            depth = depth_of(CLOSES[tag], SCOPES.get(tag, {"table"}))
            while depth:
                close(depth)
                depth = depth_of(CLOSES[tag], SCOPES.get(tag, {"table"}))
        label, no, comment = names_of(attrs) if attrs and not attrs.isspace() else ("", False, False)
        if tag in ("html", "body", "main"):
            no = False
        elif tag == "article":
            no = comment
        elif tag == "header":
            no = no or not (places["article"] or places["main"])
        elif tag in NO_ARTICLE:
            no = True
        node = Node(tag, no, label)
        stack[-1].parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            stop = RAW_END[tag].search(text, at)
            at = stop.end() if stop else len(text)
            continue
        places[tag].append(len(stack))
        stack.append(node)
    close(1)
    return root, nodes


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def body_and_hashes(text: str | None) -> tuple[int, list[int]]:
    """The digest of a page's main text (of all its text where the main text is no more than half of it), and the hashes of its
    elements, each once and in order, as signed 64-bit numbers."""
    if not text:
        return 0, []
    root, nodes = parse(text)
    found = {n.hash for n in nodes if n.tag not in ("html", "body", "b", "i", "em", "strong", "a", "span")}
    main, whole = _main_text(root, {}), _text(root, {}, False)
    main = main if 2 * len(main) > len(whole) else whole
    body = xxhash.xxh64(DIGITS.sub("0", main).encode("utf-8", "surrogatepass")).intdigest()
    return signed(body), sorted(map(signed, found))


def _tops(root: Node, tag: str, template: dict[int, float], hidden: bool = False) -> list[Node]:
    """The outermost elements of a tag that are not dropped and in no container of the template. With `hidden` also those in a
    form or a section dropped for its names: an article or main ends the reach of these."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == tag and not node.dropped:
            found.append(node)
        else:
            todo.extend(p for p in reversed(node.parts) if isinstance(p, Node) and (not p.dropped or hidden and p.tag in SOFT)
                        and (p.tag == tag or p.tag in TEXT_BLOCKS or p.hash not in template))
    return found


def _only_links(node: Node) -> bool:
    """Whether all words of an element are in links."""
    todo = [node]
    while todo:
        for part in todo.pop().parts:
            if isinstance(part, str):
                if NAME.search(part) or any(map(str.isalnum, html.unescape(part))):
                    return False
            elif part.tag != "a" and not part.dropped:
                todo.append(part)
    return True


def _text(node: Node, template: dict[int, float], protects: bool, gone: list[Node] | None = None) -> str:
    """The text of an element; the subtrees deleted as template go to `gone`."""
    out, todo = [], [iter(node.parts)]
    ends = [" "]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
            out.append(ends.pop())
        elif isinstance(part, str):
            out.append(part)
        else:
            gap = " " if part.tag in BLOCKS else ""
            recurs = not part.dropped and part.hash in template
            if recurs and part.tag in TEXT_BLOCKS:
                recurs = not protects and (template[part.hash] > TEXT_SHARE or _only_links(part))
            if recurs and gone is not None:
                gone.append(part)
            out.append(gap)
            if not part.dropped and not recurs and part.parts:
                todo.append(iter(part.parts))
                ends.append(gap)
    return " ".join(html.unescape("".join(out)).split())


def _texts(nodes: list[Node], template: dict[int, float], protects: bool, last: bool) -> str:
    """The text of elements; where nothing is left, that of the deleted subtree on the fewest bodies. If that is on more than
    TEXT_SHARE of them, it stays only where nothing else was deleted and there is no other place to look (`last`)."""
    while True:
        gone: list[Node] = []
        found = " ".join(filter(None, (_text(n, template, protects, gone) for n in nodes)))
        gone = [n for n in gone if not found and _text(n, {}, True)]
        least = min((template[n.hash] for n in gone), default=1.0)
        if found or not gone or least > TEXT_SHARE and not (last and len(gone) == 1):
            return found
        nodes, protects = [n for n in gone if template[n.hash] == least], True


def _main_text(root: Node, template: dict[int, float]) -> str:
    for hidden in (False, True):
        for tag in ("article", "main"):
            if found := _texts(_tops(root, tag, template, hidden), template, True, False):
                return found
    return _texts([root], template, False, True)


def main_text(text: str | None, template: dict[int, float] | None = None) -> str:
    """The main text of a page; `template` holds the hashes that recur on its host, with their share of its bodies."""
    return _main_text(parse(text)[0], template or {}) if text else ""


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without user and port; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def site_templates(pages: DataFrame) -> DataFrame:
    """host and the hashes of the subtrees that recur on it, with their share of its bodies."""
    located = pages.select(host_of(F.col("url")).alias("host"), "html").where("host is not null")

    def work(batch):
        bodies, hashes = zip(*map(body_and_hashes, batch.column("html").to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([batch.column("host"), pa.array(bodies, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
                                          ["host", "body", "hashes"])

    # Of copies of a body the one with the least list counts. The hash 0 stands for the body itself: its count is the number of bodies.
    bodies = map_batches(located, work, "host string, body bigint, hashes array<bigint>").groupBy("host", "body").agg(F.min("hashes").alias("hashes"))
    rows = bodies.select("host", F.explode_outer(F.array_append("hashes", F.lit(0).cast("bigint"))).alias("hash"))
    counts = written(rows.groupBy("host", "hash").agg(F.count("*").alias("n")).where(f"hash = 0 or n >= {MIN_PAGES}"), "subtrees")
    totals = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    return (counts.where("hash <> 0").join(totals, "host").where(F.col("n") >= F.col("pages") * SHARE)
            .groupBy("host").agg(F.collect_list(F.struct("hash", (F.col("n") / F.col("pages")).alias("share"))).alias("template")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of every page."""
    templates = written(site_templates(pages), "templates")
    size = templates.agg(F.coalesce(F.sum(2 * F.size("template") + 4), F.lit(0))).head()[0]
    side = F.broadcast(templates) if size <= MAX_BROADCAST else templates
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(side, "host", "left")

    def work(batch):
        known: dict = {}
        texts = []
        for host, text, template in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("template"), strict=True):
            if host not in known:
                known[host] = {x["hash"] & ((1 << 64) - 1): x["share"] for x in template.as_py() or ()}
            texts.append(main_text(text, known[host]))
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return map_batches(rows.select("page_id", "url", "html", "host", "template"), work, "page_id bigint, url string, text string")


@query("op7_main_text")
def op7_main_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))
