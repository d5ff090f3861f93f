"""Multilingual tokens with code-point offsets, as Catalyst expressions.

A token is one CJK character, one Thai letter with its combining marks, or a run of other letters,
digits and apostrophes. Values are case-folded after matching, so offsets stay those of the text.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# CJK (with Kana and Hangul), Thai, and the Thai combining marks.
CJK = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}"
THAI = r"\x{0E00}-\x{0E7F}"
THAI_MARKS = r"\x{0E31}\x{0E34}-\x{0E3A}\x{0E47}-\x{0E4E}"
TOKEN = rf"[{CJK}]|[{THAI}&&[\p{{L}}\p{{N}}]][{THAI_MARKS}]*|[\p{{L}}\p{{N}}'&&[^{CJK}{THAI}]]+"
_GAP = rf"((?:(?!{TOKEN})(?s:.))*)({TOKEN})"
#: A word with inner apostrophes and hyphens.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'-]*[\p{L}\p{N}_])?"

# What case folding expands beyond lower case, for the characters of European texts.
EXPANSIONS = ((0xDF, "ss"), (0xFB00, "ff"), (0xFB01, "fi"), (0xFB02, "fl"), (0xFB03, "ffi"), (0xFB04, "ffl"), (0xFB05, "st"), (0xFB06, "st"))


def _single_folds() -> tuple[str, str]:
    """Characters that fold to one character other than their lower case, and what they fold to."""
    pairs = [(c, c.casefold()) for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() != c.casefold() and len(c.casefold()) == 1 and c == c.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FOLD_FROM, _FOLD_TO = _single_folds()


def fold(text: Column) -> Column:
    """Case folding: lower case, then the characters whose folding differs from it."""
    x = F.translate(F.lower(text), _FOLD_FROM, _FOLD_TO)
    for code, expanded in EXPANSIONS:
        x = F.replace(x, F.lit(chr(code)), F.lit(expanded))
    return x


def _kind(char: str) -> str:
    return "L" if char == "'" or unicodedata.category(char)[0] in "LN" else unicodedata.category(char)


#: Characters whose folding has other kinds of characters than they are: such a text can't be folded before it is cut.
UNLIKE = "".join(c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and {_kind(x) for x in c.lower() + c.casefold()} - {_kind(c)})
UNLIKE += "\ua7cb\ua7dc"  # new capitals that are folded, but are no letters to the pattern


def tokens(text: Column) -> Column:
    """Folded token values in order; null for null. A text is folded at once where that leaves its tokens as they are, which costs far less than token by token."""
    cut = lambda x: F.regexp_extract_all(x, F.lit(f"({TOKEN})"), F.lit(1))
    return F.when(text.rlike(f"[{UNLIKE}]"), F.transform(cut(text), fold)).otherwise(cut(fold(text)))


def token_positions(text: Column) -> Column:
    """array<struct<value,start,end>> with half-open code-point offsets; null for null."""
    gaps = F.regexp_extract_all(text, F.lit(_GAP), F.lit(1))
    found = F.regexp_extract_all(text, F.lit(_GAP), F.lit(2))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["t"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(fold(x["t"]).alias("value"), begin.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(F.arrays_zip(gaps.alias("g"), found.alias("t")), start, step, lambda acc: acc["out"])


def token_values(df, key: str, text: str):
    """(key, value): one row for each token, without its place."""
    return df.select(F.col(key).alias(key), F.explode(tokens(F.col(text))).alias("value"))


def token_table(df, key: str, text: str):
    """(key, pos, value, start, end): one row for each token. Offsets are a running sum over a window of the key."""
    from pyspark.sql import Window

    zipped = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(_GAP), F.lit(1)).alias("g"), F.regexp_extract_all(F.col(text), F.lit(_GAP), F.lit(2)).alias("t"))
    rows = df.select(F.col(key).alias("key"), F.posexplode(zipped).alias("pos", "x")).select("key", "pos", F.length("x.g").alias("gap"), F.length("x.t").alias("size"), fold(F.col("x.t")).alias("value"))
    before = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(before).cast("int")
    return rows.withColumn("end", end).select(F.col("key").alias(key), "pos", "value", (F.col("end") - F.col("size")).alias("start"), "end")
