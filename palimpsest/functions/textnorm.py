"""Whitespace normalisation, in Python and as Spark columns; both give the same text.

Line ends become ``\\n``, runs of blanks inside a line become one space, line edges are
stripped of every Unicode space, three or more line ends become two, and the whole is stripped.
A null text stays null, an empty one stays empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character Python's ``str.strip`` removes, without the line feed.
EDGE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_LINE_END = re.compile("\r\n?")
_BLANKS = re.compile("[ \t\f\v]+")
_EDGES = re.compile(f"(?:(?<=\n)|\\A)[{EDGE}]+|[{EDGE}]+(?=\n|\\Z)")
_GAPS = re.compile("\n{3,}")
_ODD_EDGE = re.compile(f"[{EDGE}]\n|\n[{EDGE}]")


def normalize(text: str) -> str:
    """Whitespace-normalised text."""
    if not text.isprintable():  # the line feed is not printable either
        if "\r" in text:
            text = _LINE_END.sub("\n", text)
        if "\t" in text or "\f" in text or "\v" in text:
            text = _BLANKS.sub(" ", text)
    if "  " in text:
        text = _BLANKS.sub(" ", text)
    if "\n" in text:
        if _ODD_EDGE.search(text):
            text = _EDGES.sub("", text)
        if "\n\n\n" in text:
            text = _GAPS.sub("\n\n", text)
    return text.strip()


def paragraphs(normalized: str) -> list[tuple[int, str]]:
    """(start, paragraph) of a normalised text, split at blank lines, empty ones skipped."""
    out, at = [], 0
    for part in normalized.split("\n\n"):
        if body := part.strip():
            out.append((at + part.index(body), body))
        at += len(part) + 2
    return out


def normalize_col(text: Column) -> Column:
    """The same normalisation as a Catalyst expression (five regular expressions, no UDF)."""
    x = F.regexp_replace(text, "\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t\f\x0B]+", " ")
    x = F.regexp_replace(x, f"(?<![^\n])[{EDGE}]+|[{EDGE}]+(?![^\n])", "")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    return F.regexp_replace(x, f"^[{EDGE}\n]+|[{EDGE}\n]+$", "")
