"""Documents, paragraphs, chunks and passages: projections of a text column, without shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.ids import public_id
from palimpsest.functions.textnorm import EDGE, normalize_col
from palimpsest.functions.tokens import WORD

_ALL_EDGE = EDGE + "\n"


def paragraphs_col(normalized: Column) -> Column:
    """array<struct<start,text>> of a normalised text: split at blank lines, empty paragraphs skipped."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        body = F.btrim(part, F.lit(_ALL_EDGE))
        begin = acc["at"] + F.length(part) - F.length(F.ltrim(part, F.lit(_ALL_EDGE)))
        more = F.when(body == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(begin.alias("start"), body.alias("text")))))
        return F.struct((acc["at"] + F.length(part) + 2).alias("at"), more.alias("out"))

    return F.aggregate(F.split(normalized, "\n\n"), start, step, lambda acc: acc["out"])


def documents(df: DataFrame, text: str = "text", given_id: str | None = None, metadata: Column | None = None) -> DataFrame:
    """(id, text, sha256, metadata, segments): normalised documents with public-safe ids and paragraph segments."""
    norm = df.select("*", normalize_col(F.col(text)).alias("_norm"))
    digest = F.sha2("_norm", 256)
    shown = public_id(F.col(given_id) if given_id else F.lit(None).cast("string"), digest)
    meta = metadata if metadata is not None else F.create_map().cast("map<string,string>")
    return norm.select(shown.alias("id"), F.col("_norm").alias("text"), digest.alias("sha256"), meta.alias("metadata"), paragraph_segments(F.col("_norm")).alias("segments"))


def paragraph_segments(normalized: Column) -> Column:
    """array<struct<kind,index,start,end,label>> of the paragraphs of a normalised text."""
    return F.transform(
        paragraphs_col(normalized),
        lambda p, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("index"), p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end"), F.concat(F.lit("paragraph "), (i + 1).cast("string")).alias("label")),
    )


def segmented(parts: Column, kind: str) -> Column:
    """struct<text,segments> of an array of raw texts: each normalised, empty ones left out, joined by a blank line."""
    kept = F.filter(F.transform(parts, normalize_col), lambda x: x != "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    spans = F.aggregate(
        kept,
        start,
        lambda acc, x: F.struct((acc["at"] + F.length(x) + 2).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("end")))).alias("out")),
        lambda acc: acc["out"],
    )
    named = F.transform(spans, lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("index"), s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit(f"{kind} "), (i + 1).cast("string")).alias("label")))
    return F.struct(F.array_join(kept, "\n\n").alias("text"), named.alias("segments"))


def check_window(max_chars: int, overlap_chars: int) -> None:
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    if overlap_chars < 0:
        raise ValueError("overlap_chars must be non-negative")
    if overlap_chars >= max_chars:
        raise ValueError("overlap_chars must be smaller than max_chars")


def chunk(df: DataFrame, key: str, text: str, max_chars: int = 900, overlap_chars: int = 120, normalized: bool = False) -> DataFrame:
    """(key, chunk_index, id, text, start, end): paragraphs, the long ones as overlapping windows.

    Offsets count code points of the normalised text. One generator over nested arrays: the plan
    has no shuffle. Null and blank texts give no rows.
    """
    check_window(max_chars, overlap_chars)
    step = max_chars - overlap_chars
    norm = F.col(text) if normalized else normalize_col(F.col(text))

    def windows(p: Column) -> Column:
        n = F.length(p["text"])
        last = F.when(n <= max_chars, 0).otherwise(F.ceil((n - max_chars) / step).cast("int"))

        def window(i: Column) -> Column:
            raw = F.substring(p["text"], i * step + 1, F.lit(max_chars))
            body = F.btrim(raw, F.lit(_ALL_EDGE))
            begin = p["start"] + i * step + F.length(raw) - F.length(F.ltrim(raw, F.lit(_ALL_EDGE)))
            return F.struct(begin.alias("start"), body.alias("text"))

        return F.filter(F.transform(F.sequence(F.lit(0), last), window), lambda w: w["text"] != "")

    rows = df.select(F.col(key).alias("_key"), norm.alias("_norm")).select("_key", F.posexplode(F.flatten(F.transform(paragraphs_col(F.col("_norm")), windows))).alias("chunk_index", "c"))
    return rows.select(
        F.col("_key").alias(key),
        "chunk_index",
        F.concat_ws(":", F.col("_key").cast("string"), F.col("chunk_index").cast("string")).alias("id"),
        F.col("c.text").alias("text"),
        F.col("c.start").alias("start"),
        (F.col("c.start") + F.length("c.text")).alias("end"),
    )


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def first_passage(text: Column, min_words: int = 80, max_words: int = 160) -> Column:
    """The first paragraph of enough words (else the whole text), cut to ``max_words`` words; null if there are too few."""
    flat = F.transform(F.split(text, "\n\n"), lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))
    long = F.filter(flat, lambda p: F.size(words(p)) >= min_words)
    chosen = words(F.coalesce(F.try_element_at(long, F.lit(1)), text))
    return F.when(F.size(chosen) >= min_words, F.array_join(F.slice(chosen, 1, max_words), " "))


def offset_window(text: Column, start: Column, length: Column, pad: int = 80) -> Column:
    """The span with ``pad`` characters on each side, inside the text."""
    lo = F.greatest(start - pad, F.lit(0))
    return F.substring(text, lo + 1, F.least(start + length + pad, F.length(text)) - lo)


def obfuscate(items: Column) -> Column:
    """Words without every ninth, with neighbours swapped at places 10, 27, 44, 61 and 78."""
    kept = F.filter(items, lambda w, i: (i + 1) % 9 != 0)
    none = F.array(F.lit(None).cast("string"))
    size = F.size(kept)
    after = F.concat(F.slice(kept, F.lit(2), F.greatest(size - 1, F.lit(0))), none)
    before = F.concat(none, F.slice(kept, F.lit(1), F.greatest(size - 1, F.lit(0))))
    swaps = (10, 27, 44, 61, 78)
    rows = F.arrays_zip(kept.alias("w"), after.alias("n"), before.alias("p"))
    moved = F.transform(rows, lambda x, i: F.when(i.isin(*swaps) & x["n"].isNotNull(), x["n"]).when((i - 1).isin(*swaps), x["p"]).otherwise(x["w"]))
    return F.array_join(moved, " ")


def prefixed(text: Column, model: str, role: str) -> Column:
    """``query: `` or ``passage: `` before the text for models of the family that was trained with it."""
    import re

    return F.concat(F.lit(f"{role}: "), text) if re.search(r"(^|/)(multilingual-)?e5", model.lower()) else text
