"""Lexical scores of two texts, labels, and vector similarities, as Catalyst expressions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.textnorm import normalize_col
from palimpsest.functions.tokens import fold

SUBSTRING = 40  # characters from which containment counts as overlap


def exact_overlap(left: Column, right: Column) -> Column:
    """1 for texts equal after normalising and folding; the ratio of lengths if the shorter, of 40 characters or more, lies in the longer; else 0."""
    a, b = fold(normalize_col(left)), fold(normalize_col(right))
    n, m = F.length(a), F.length(b)
    inside = F.when(n <= m, b.contains(a)).otherwise(a.contains(b))
    ratio = F.least(n, m) / F.greatest(n, m)
    return F.when((n == 0) | (m == 0), 0.0).when(a == b, 1.0).when((F.least(n, m) >= SUBSTRING) & inside, ratio).otherwise(0.0)


def jaccard(left: Column, right: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)))


def containment(left: Column, right: Column) -> Column:
    """Shared tokens over the smaller set; 0 if either is empty."""
    least = F.least(F.size(F.array_distinct(left)), F.size(F.array_distinct(right)))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / least)


def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, list(a), list(b), autojunk=False).ratio() if len(a) and len(b) else 0.0 for a, b in zip(left, right)], dtype="float64")


def order_similarity(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp ratio of two token arrays (Arrow UDF: there is no such built-in). Not symmetric."""
    return F.pandas_udf(_ratio, "double")(left, right)


def multiset_overlap(left: Column, right: Column) -> Column:
    """Size of the common part of two token arrays, repetitions counted."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.transform(F.array_intersect(left, right), lambda x: F.least(count(left, x), count(right, x))), F.lit(0), lambda a, x: a + x)


def order_bound(left: Column, right: Column) -> Column:
    """An upper bound of ``order_similarity`` without Python: twice the common multiset over both lengths."""
    total = F.size(left) + F.size(right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(2.0 * multiset_overlap(left, right) / total)


def length_bound(left: Column, right: Column) -> Column:
    """A cheaper bound: twice the shorter length over both."""
    total = F.size(left) + F.size(right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(2.0 * F.least(F.size(left), F.size(right)) / total)


def kind(exact: Column, contained: Column, similar: Column) -> Column:
    return F.when(exact >= 0.95, "exact_overlap").when(contained >= 0.8, "near_duplicate").when(similar >= 0.55, "lexical_similarity").otherwise("needs_review")


# The sentence that goes with each kind.
EXPLANATIONS = {
    "exact_overlap": "Normalized text spans are exact or near-exact matches.",
    "near_duplicate": "Most tokens from the shorter span appear in the longer span.",
    "lexical_similarity": "The spans share a high proportion of unique tokens.",
    "needs_review": "The spans crossed the configured baseline review threshold.",
    "possible_paraphrase": "Embedding similarity crossed the configured review threshold.",
}


def explanation(label: Column) -> Column:
    pairs = [F.lit(x) for item in EXPLANATIONS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), label)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)


def cosine(left: Column, right: Column) -> Column:
    """0 if either vector is all zero; vectors of different size raise an error."""
    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    value = F.when(norms == 0, 0.0).otherwise(dot(left, right) / norms)
    return F.when(F.size(left) != F.size(right), F.raise_error(F.lit("Vectors must have the same dimension"))).otherwise(value)


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def hamming(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))
