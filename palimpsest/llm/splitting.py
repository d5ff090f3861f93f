"""Splitting oversized paragraphs at natural boundaries (problem 3): recursive bisection.

A stretch longer than the limit less the overlap is cut at the strongest boundary near its
midpoint, and both halves are treated alike. When no stretch is too long, every piece but the
first is extended to the left by an overlap that begins at a word if it can.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.textnorm import normalize, paragraphs

#: Boundaries from strong to weak; a cut goes behind the match.
BOUNDARIES = tuple(
    re.compile(x)
    for x in (
        r"\n+",  # line end
        r"(?:[.!?…]+[\"'»”’)\]]*\s+)|[。！？]+",  # sentence
        r"(?:[;:—–]\s+)|[；：]",  # clause
        r"(?:,\s+)|[，、]",  # phrase
        r"\s+",  # word
    )
)
#: The part of a stretch, on each side of its midpoint, that counts as near it.
NEAR = 0.25


def _cut(text: str, lo: int, hi: int) -> int:
    mid, reach = (lo + hi) // 2, int((hi - lo) * NEAR)
    for window in ((mid - reach, mid + reach), (lo + 1, hi - 1)):
        a, b = max(lo + 1, window[0]), min(hi - 1, window[1])
        for kind in BOUNDARIES if window[0] != lo + 1 else BOUNDARIES[-1:]:
            places = [m.end() for m in kind.finditer(text, max(lo, a - 1), b) if a <= m.end() <= b]
            if places:
                return min(places, key=lambda p: (abs(p - mid), p))
    at = mid  # one word fills the stretch: cut between letters, never before a combining mark
    while at < hi - 1 and unicodedata.combining(text[at]):
        at += 1
    return at if at < hi - 1 else mid


def _start(text: str, lo: int, end: int, overlap: int) -> int:
    """Where the piece after a cut at ``end`` begins: at the first word of the overlap, or else at a blank."""
    first = min(max(lo + 1, end - overlap), end - 1)
    for p in range(max(first, 1), end):
        if text[p - 1].isspace() and not text[p].isspace():
            return p
    return end - 1 if text[end - 1].isspace() else first


def split(text: str, limit: int = 900, overlap: int = 120) -> list[tuple[int, int]]:
    """Half-open pieces of at most ``limit`` characters that cover ``text``; one piece if it fits.

    Each piece begins 1 to ``overlap`` characters before the end of the one before. Cuts lie behind
    a line end, sentence, clause, phrase or word, the strongest within a quarter of the stretch
    around its midpoint, else at any blank, and inside a word only where the stretch has no blank.
    """
    if not 0 < overlap < limit:
        raise ValueError("overlap must be positive and smaller than limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    ends, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= limit - overlap:
            ends.append(hi)
            continue
        at = _cut(text, lo, hi)
        todo += ((at, hi), (lo, at))
    starts = [0, *(_start(text, 0 if i == 0 else ends[i - 1], end, overlap) for i, end in enumerate(ends[:-1]))]
    return list(zip(starts, ends))


def _pieces(limit: int, overlap: int, with_text: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for index, (at, para) in enumerate(paragraphs(normalize(text))):
                    if len(para) > limit:
                        rows += ((key, index, i, at + a, at + b, para[a:b] if with_text else None) for i, (a, b) in enumerate(split(para, limit, overlap)))
            cols = list(zip(*rows)) or [()] * 6
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "para_index", "piece_index", "start_char", "end_char", "piece"])

    return run


def oversized_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 900, overlap: int = 120, with_text: bool = True) -> DataFrame:
    """Pieces of every paragraph above ``limit``: id, para_index, piece_index, start_char, end_char, piece.

    Offsets count code points of the whitespace-normalised text. Paragraphs lie between blank lines
    and are counted from 0, empty ones skipped. Null and short texts give no rows; repeated rows
    give their pieces again; other columns are ignored. The pass is map-only: texts that cannot
    hold such a paragraph are filtered in the scan stage, before Python sees them.
    """
    picked = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.length("text") > limit)
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(_pieces(limit, overlap, with_text), f"id {kind}, para_index int, piece_index int, start_char int, end_char int, piece string")


def must_be_cut(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 900, overlap: int = 120) -> DataFrame:
    """(id, para_index) of the paragraphs that ``oversized_pieces`` cuts, each once."""
    return oversized_pieces(docs, key, text, limit, overlap, with_text=False).where("piece_index = 0").select("id", "para_index").distinct()
