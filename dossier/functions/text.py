"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.schemas import DIGIT, SENTENCE_ENDS

# What a Unicode-aware split takes for white space, spelled out: such a class matches much faster
# than the Unicode form of \s. _BLANK is the same without the line feed.
_OTHER = r"\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = rf"[\t-\r{_OTHER}]"
_BLANK = rf"[\t\x0b-\r{_OTHER}]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


# The same characters as a plain string, for trimming.
_SPACES = "".join(
    chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                     *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def words(text: Column) -> Column:
    """Words of a text; no empty words."""
    return F.filter(F.split(text, rf"{_SPACE}+"), lambda w: w != "")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def tidy_line(line: Column) -> Column:
    """One space at most in a row; dates drawn apart closed up again."""
    single = F.regexp_replace(line, " {2,}", " ")
    closed = F.regexp_replace(single, rf"(?<={DIGIT}) ?([/.]) ?(?={DIGIT})", "$1")
    return strip(closed)


def normalise_text(text: Column) -> Column:
    """No trailing white space on any line, at most one blank line in a row, stripped."""
    lines = F.regexp_replace(text, LINE_BREAK, "\n")
    trimmed = F.regexp_replace(lines, rf"{_BLANK}+(?=\n|\z)", "")
    return strip(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"))


def looks_cut_off(text: Column) -> Column:
    """Starts with a letter that is not upper case, or does not end a sentence."""
    body = strip(text)
    starts_inside = body.rlike(r"^[\p{L}&&[^\p{Lu}]]")
    ends_clean = F.substring(body, -1, 1).isin(SENTENCE_ENDS)
    return (body != "") & (starts_inside | ~ends_clean)


def file_extension(filename: Column) -> Column:
    """Lower-cased last extension with its dot; a leading dot is part of the name."""
    base = F.regexp_extract(filename, r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*(\.[^.]*)\z", 1))


def preview(text: Column, chars: int = 200) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("…"))).otherwise(text)
