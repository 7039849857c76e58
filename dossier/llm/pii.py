"""Personal data in texts, disguised forms included.

Plain forms are found by fixed patterns. For the others two transducers rewrite the text: characters
(look-alike letters, digits of other scripts, wide forms, invisible characters), then words (spelled digits,
"at" and "dot" in their disguises). Each normalised character carries the source span it came from, so what is
detected in the normalised text is reported, and masked, in source characters.

A null or empty text has no spans. Columns beside the id and the text are not read. Repeated rows give
repeated results. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.base import map_batches, query, table

# --- fixed values: kinds in their order, patterns, spelled digits, look-alikes -------------------
KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGIT = re.compile("[0-9]")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Spelled digits and marks in English, German, Spanish and French.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "plus": "+", "más": "+", "mas": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".",
    "dash": "-", "hyphen": "-", "strich": "-", "bindestrich": "-", "guion": "-", "guión": "-", "tiret": "-",
}
REPEATS = {"double": 2, "doble": 2, "doppelt": 2, "triple": 3}
# Words for the sign of an address, each with the words for a dot that go with it; @ itself goes with all.
AT_WORDS = {"at": ["dot"], "ät": ["punkt", "dot"], "klammeraffe": ["punkt", "dot"], "arroba": ["punto", "dot"],
            "arobase": ["point", "dot"], "arobas": ["point", "dot"], "@": ["dot", "punkt", "punto", "point"]}
# These say by themselves that an address follows; after the others one of its dots must be a word.
SURE_AT = frozenset(["arroba", "arobase", "arobas", "klammeraffe"])
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "\u2010": "-", "\u2011": "-", "\u2012": "-",
    "\u2013": "-", "\u2014": "-", "\u2212": "-", "\ufe63": "-", "\ufe6b": "@", "\u3002": ".", "\u2024": ".",
    "\ufe52": ".", "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u3000": " ", "\u200b": "", "\u200c": "",
    "\u200d": "", "\u2060": "", "\ufeff": "", "\u00ad": "",
}
# -------------------------------------------------------------------------------------------------

# Wide forms of printable ASCII lie in one row of the code chart.
GLYPHS = LOOK_ALIKES | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isdecimal())
DISGUISED = re.compile("[" + "".join(re.escape(c) for c in GLYPHS) + OTHER_DIGITS + "]")
# No character of these ranges is in DISGUISED; most texts of European languages have no other.
UNUSUAL = re.compile("[^\\x00-\\x9f\\xa1-\\xac\\xae-\\u0250\\u0262-\\u0390\\u2018-\\u201f]")
longest = lambda words: "|".join(sorted(map(re.escape, words), key=len, reverse=True))
DIGIT_WORDS = [w for w, c in SPELLED.items() if c.isdigit()]
PLUS_WORDS = [w for w, c in SPELLED.items() if c == "+"]
DIGIT_WORD, ANY_WORD, REPEAT = longest(DIGIT_WORDS), longest(SPELLED), longest(REPEATS)
SPELLED_RUN = re.compile(
    rf"(?<![^\W_])(?:(?:{longest(PLUS_WORDS)}|\+)[\s,.-]{{1,3}})?(?:(?:{REPEAT})[\s,.-]{{1,3}})?(?:{DIGIT_WORD})"
    rf"(?:[\s,.-]{{1,3}}(?:(?:{REPEAT})[\s,.-]{{1,3}})?(?:{ANY_WORD}|[0-9]+)(?![^\W_])){{3,}}", re.I)
SPELLED_ITEM = re.compile(rf"(?:({REPEAT})[\s,.-]{{1,3}})?({ANY_WORD}|[0-9+])", re.I)
_AT, _DOT = longest(AT_WORDS), longest(sorted({d for dots in AT_WORDS.values() for d in dots}))
BRACKET_SIGN = re.compile(
    rf"(?<=\S)\x20{{0,3}}(?:[\[({{<]\x20{{0,2}}(?P<sign>{_AT}|{_DOT}|\.)\x20{{0,2}}[\])}}>])\x20{{0,3}}(?=\S)", re.I)
PLAIN_SIGN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?P<at>\x20(?:{_AT})\x20|@)[A-Za-z0-9-]++(?:(?:\x20(?:{_DOT})\x20|\.)[A-Za-z0-9-]++)++", re.I)
PLAIN_DOT = re.compile(rf"\x20({_DOT})\x20", re.I)
LABEL, ENDING = re.compile(r"[A-Za-z0-9-]+"), re.compile(r"[A-Za-z]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_PART:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            last = match.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def detect(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain forms, in order."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    for m in ADDRESS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


class Rewritten:
    """A text with, for every character, the span of the source it stands for."""

    def __init__(self, text: str, starts: list[int] | range, ends: list[int] | range):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def of(cls, text: str) -> "Rewritten":
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def replace(self, edits: list[tuple[int, int, str]]) -> "Rewritten":
        """Edits are (start, end, characters), in order and apart; the new characters stand for the whole span."""
        parts, starts, ends, at = [], [], [], 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            starts.extend(self.starts[at:start])
            ends.extend(self.ends[at:start])
            starts.extend([self.starts[start]] * len(new))
            ends.extend([self.ends[end - 1]] * len(new))
            at = end
        parts.append(self.text[at:])
        starts.extend(self.starts[at:])
        ends.extend(self.ends[at:])
        return Rewritten("".join(parts), starts, ends)


def characters(r: Rewritten) -> Rewritten:
    """First transducer: one character to one or none."""
    edits = []
    for m in DISGUISED.finditer(r.text):
        c = m[0]
        edits.append((m.start(), m.end(), GLYPHS[c] if c in GLYPHS else str(int(c))))
    return r.replace(edits) if edits else r


def phrases(r: Rewritten) -> Rewritten:
    """Second transducer: spelled digits in runs, then at and dot in brackets or between the parts of an address."""
    edits = []
    for run in SPELLED_RUN.finditer(r.text):
        at, items = run.start(), []
        for item in SPELLED_ITEM.finditer(r.text, run.start(), run.end()):
            times = REPEATS[item[1].lower()] if item[1] else 1
            items.append((at, item.end(), SPELLED.get(item[2].lower(), item[2]) * times))
            at = item.end()
        edits += items
    if edits:
        r = r.replace(edits)
    edits = [(m.start(), m.end(), "@" if m["sign"].lower() in AT_WORDS else ".") for m in BRACKET_SIGN.finditer(r.text)]
    if edits:
        r = r.replace(edits)
    edits = []
    for m in PLAIN_SIGN.finditer(r.text):
        edits += _signs(m)
    return r.replace(edits) if edits else r


def _signs(m: re.Match) -> list[tuple[int, int, str]]:
    """The signs to be rewritten in what may be an address: up to the last dot that goes with its at, before an ending of letters."""
    at = m["at"].strip().lower()
    dots, place, spelled = [], m.end("at"), False
    while True:
        label = LABEL.match(m.string, place, m.end())
        dot = PLAIN_DOT.match(m.string, label.end(), m.end()) if label else None
        if dot and dot[1].lower() in AT_WORDS[at]:
            dots.append((dot.start(), dot.end(), "."))
            spelled, place = True, dot.end()
        elif label and not dot and m.string[label.end():label.end() + 1] == "." and label.end() < m.end():
            dots.append((label.end(), label.end() + 1, "."))
            place = label.end() + 1
        else:
            break
    if not dots or not (label and ENDING.fullmatch(label[0])) or not (spelled or at in SURE_AT):
        return []
    return [*([(m.start("at"), m.end("at"), "@")] if at != "@" else []), *[d for d in dots if d[1] - d[0] > 1]]


# Every match of SPELLED_RUN and BRACKET_SIGN holds one of SPELLED_START and OPENING, and every rewritten one of PLAIN_SIGN a
# word for its at that is sure, the word dot, or an @ and a word for a dot. In lower case a pattern
# for each word is faster; letters that only re.I takes for i, k and s are left to the one pattern.
SPELLED_START = re.compile(rf"(?:{DIGIT_WORD})[\s,.-]{{1,3}}(?:{ANY_WORD}|{REPEAT}|[0-9])", re.I)
SPELLED_STARTS = [re.compile(rf"{w}[\s,.-]{{1,3}}(?:{ANY_WORD}|{REPEAT}|[0-9])") for w in DIGIT_WORDS]
ODD_CASE = re.compile("[\u0130\u0131\u017f\u212a]")
OPENING = re.compile(rf"[\[({{<]\x20{{0,2}}(?:{_AT}|{_DOT}|\.)\x20{{0,2}}[\])}}>]", re.I)
SURE_SIGN = re.compile(rf"\x20(?:{longest([w for w in AT_WORDS if w not in ('at', '@')])})\x20", re.I)
EASY_DOT = re.compile(r"\x20dot\x20", re.I)


def says_something(text: str) -> bool:
    """Quick test for what the second transducer could rewrite: true wherever it would."""
    low = text.lower()
    return (EASY_DOT.search(text) is not None or OPENING.search(text) is not None or SURE_SIGN.search(text) is not None
            or "@" in text and PLAIN_DOT.search(text) is not None or any(p.search(low) for p in SPELLED_STARTS)
            or not text.isascii() and ODD_CASE.search(text) is not None and SPELLED_START.search(text) is not None)


def find_spans(text: str | None) -> tuple[list, list]:
    """Plain spans and those that only the rewritten text shows, as (start, kind, end)."""
    if not text:
        return [], []
    plain = detect(text)
    glyphs = not text.isascii() and UNUSUAL.search(text) is not None and DISGUISED.search(text) is not None
    r = characters(Rewritten.of(text)) if glyphs else Rewritten.of(text)
    if says_something(r.text):
        r = phrases(r)
    elif not glyphs:
        return plain, []
    taken = sorted((s, e) for s, _, e in plain)
    added = []
    for s, kind, e in detect(r.text):
        start, end = r.starts[s], r.ends[e - 1]
        at = bisect_left(taken, (start, start))
        if not any(a < end and start < b for a, b in taken[max(0, at - 1):at + 1]):
            added.append((start, kind, end))
    return plain, added


SPANS = "array<struct<kind:string,start:int,end:int,added:boolean>>"


def _spans(batch: pa.RecordBatch) -> list:
    out = []
    for text in batch.column("text").to_pylist():
        plain, added = find_spans(text)
        out.append([{"kind": KINDS[k], "start": s, "end": e, "added": a}
                    for s, k, e, a in sorted([(*x, False) for x in plain] + [(*x, True) for x in added])])
    return out


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of its text, in order of start and kind; one row per document, nothing is shuffled."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))

    def work(batch):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_spans(batch), kind)], ["doc_id", "spans"])

    return map_batches(docs.select("doc_id", "text"), work, f"doc_id bigint, spans {SPANS}")


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are masked as one."""
    if not text:
        return text
    plain, added = find_spans(text)
    parts, at = [], 0
    for start, kind, end in sorted(plain + added, key=lambda s: (s[0], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = end
        elif end > at:
            at = end
    return "".join(parts) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their spans masked and n_chars brought up to date; all columns and rows stay."""
    names = docs.columns

    def work(batch):
        texts = [masked(t) for t in batch.column("text").to_pylist()]
        columns = {n: batch.column(n) for n in names}
        columns["text"] = pa.array(texts, batch.schema.field("text").type)
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return map_batches(docs, work, docs.schema)


@query("op9_pii")
def op9_pii(spark, sf_dir):
    found = pii_spans(table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: ~s["added"])

    def line(spans):
        return F.concat_ws(",", F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def number(kind):
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(line(plain).cast("binary"), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["added"])).cast("bigint").alias("n_added"))
