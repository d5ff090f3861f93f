"""Vector lookup, semantic evidence, reranking and upserts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scores import clamp, cosine, explanation

TOP_K = 5
MIN_COSINE = 0.72


class EmbeddingBackend(Protocol):
    def embed_texts(self, texts: Sequence[str]) -> list[list[float]]: ...


class RerankerBackend(Protocol):
    def score_pairs(self, pairs: Sequence[tuple[str, str]]) -> list[float]: ...


class HashEmbedder:
    """Deterministic embeddings without a model: signed hashed character trigrams, scaled to length 1."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed_texts(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = np.zeros(self.size)
            flat = f" {' '.join(text.casefold().split())} "
            for i in range(len(flat) - 2):
                h = int.from_bytes(hashlib.blake2b(flat[i : i + 3].encode(), digest_size=8).digest(), "big")
                vector[h % self.size] += 1 if h >> 63 else -1
            norm = np.linalg.norm(vector)
            out.append((vector / norm if norm else vector).tolist())
        return out


def sentence_transformer(model: str):
    """A backend around an installed sentence-embedding library; a clear error where there is none."""
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as exc:
        raise RuntimeError("Semantic matching needs the optional sentence-transformers package") from exc
    loaded = SentenceTransformer(model)

    class Backend:
        def embed_texts(self, texts: Sequence[str]) -> list[list[float]]:
            return [list(map(float, v)) for v in loaded.encode(list(texts), normalize_embeddings=True)]

    return Backend()


def embed(make: Callable[[], EmbeddingBackend], text: Column) -> Column:
    """array<double> of a text. ``make`` runs once in each Python worker's task; nulls stay null."""

    def run(batches):
        backend = make()
        for batch in batches:
            known = batch.notna()
            vectors = backend.embed_texts(batch[known].tolist())
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            out[known] = pd.Series(vectors, index=batch.index[known], dtype=object)
            yield out

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(text)


def top_k(queries: DataFrame, index: DataFrame, query_key: str, key: str, vector: str, k: int = TOP_K, within: list[str] | None = None, exclude_self: bool = False, digits: int | None = None) -> DataFrame:
    """(query_key, within, key, score, rank): the ``k`` rows of highest cosine for each query, ties to the smaller key.

    ``queries`` is a stated query set; it is joined with all rows, and partial top-k runs before
    the shuffle of the window. ``within`` ranks inside groups of the index (a source document).
    """
    q = queries.select(F.col(query_key), F.col(vector).alias("_q"))
    pairs = index.select(*(within or []), F.col(key), F.col(vector).alias("_v")).join(q, F.lit(True) if not exclude_self else F.col(query_key) != F.col(key), "inner")
    score = cosine(F.col("_q"), F.col("_v"))
    rows = pairs.select(query_key, *(within or []), key, (score if digits is None else F.round(score, digits)).alias("score"))
    order = Window.partitionBy(query_key, *(within or [])).orderBy(F.desc("score"), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_top_k(found: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """Top-k results of shards (query_key, key, score, ...) as one ranking."""
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return found.drop("rank").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def semantic_matches(left: DataFrame, right: DataFrame, key: str, doc: str, min_score: float = MIN_COSINE, k: int = TOP_K) -> DataFrame:
    """Evidence for chunks with a ``vector``: per suspicious chunk and source document the top ``k``, then ``min_score``.

    ``left`` is a stated query set (the chunks of the texts under suspicion) that is compared with
    all rows of ``right``; each task keeps the best ``k`` before anything is shuffled.
    """
    names = ("id", "start", "end", "chunk_index", "vector")
    a = left.select(key, *(F.col(c).alias(f"l_{c}") for c in names))
    b = right.select(doc, *(F.col(c).alias(f"r_{c}") for c in names))
    pairs = a.join(b, F.lit(True)).withColumn("raw_score", cosine(F.col("l_vector"), F.col("r_vector"))).drop("l_vector", "r_vector")
    order = Window.partitionBy(key, "l_id", doc).orderBy(F.desc("raw_score"), "r_chunk_index")
    best = pairs.withColumn("_k", F.row_number().over(order)).where((F.col("_k") <= k) & (F.col("raw_score") >= min_score))
    label = F.lit("possible_paraphrase")
    return best.select(
        key, doc, label.alias("kind"), F.col("l_id").alias("suspicious_chunk_id"), F.col("r_id").alias("source_chunk_id"), F.round("raw_score", 4).alias("score"), "raw_score",
        F.col("l_start").alias("suspicious_start"), F.col("l_end").alias("suspicious_end"), F.col("r_start").alias("source_start"), F.col("r_end").alias("source_end"),
        explanation(label).alias("explanation"), F.struct(F.lit(2).alias("step"), F.col("l_chunk_index").alias("i"), F.col("r_chunk_index").alias("j")).alias("ord"),
    )


def resolve_sources(evidence: DataFrame, sources: DataFrame, chunk_id: str, source_id: str) -> DataFrame:
    """The evidence with ``source_id``: the longest id that equals the chunk id or is followed in it by a colon; null if none.

    The id's possible prefixes are generated, so the longest-prefix join is an equi-join.
    """
    parts = F.split(F.col(chunk_id), ":", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":"))
    rows = evidence.select(chunk_id).distinct().select(chunk_id, F.explode(prefixes).alias(source_id))
    hit = rows.join(sources.select(source_id).distinct(), source_id).groupBy(chunk_id).agg(F.max_by(source_id, F.length(source_id)).alias(source_id))
    return evidence.join(hit, chunk_id, "left")


def cross_encoder(model: str) -> RerankerBackend:
    """A reranker around an installed cross-encoder library; a clear error where there is none."""
    try:
        from sentence_transformers import CrossEncoder
    except ImportError as exc:
        raise RuntimeError("Reranking needs the optional sentence-transformers package") from exc
    loaded = CrossEncoder(model)

    class Backend:
        def score_pairs(self, pairs: Sequence[tuple[str, str]]) -> list[float]:
            return [float(x) for x in loaded.predict(list(pairs))]

    return Backend()


def ranked(evidence: DataFrame) -> DataFrame:
    """Evidence from the highest score down, ties in the order of the chunk ids; rows without a score last."""
    return evidence.orderBy(F.desc_nulls_last("score"), "suspicious_chunk_id", "source_chunk_id")


def rerank(evidence: DataFrame, score: Column) -> DataFrame:
    """Evidence with a new score where ``score`` is not null: clamped, rounded, noted in the explanation."""
    given = score.isNotNull()
    return evidence.withColumn("explanation", F.when(given, F.concat(F.coalesce("explanation", F.lit("")), F.lit(" Reranker score applied."))).otherwise(F.col("explanation"))).withColumn("score", F.when(given, F.round(clamp(score), 4)).otherwise(F.col("score")))


def rerank_spans(evidence: DataFrame, left: DataFrame, right: DataFrame, left_key: str, right_key: str, make: Callable[[], RerankerBackend]) -> DataFrame:
    """Rerank by the texts of the spans: ``left`` and ``right`` hold (key, text). Rows without a source text keep their score."""
    texts = evidence.join(left.select(left_key, F.col("text").alias("_l")), left_key, "left").join(right.select(right_key, F.col("text").alias("_r")), right_key, "left")
    cut = lambda t, s: F.substring(t, F.col(f"{s}_start") + 1, F.col(f"{s}_end") - F.col(f"{s}_start"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        backend = None  # made once in a task, if any row needs it
        for a, b in batches:
            known = a.notna() & b.notna()
            out = pd.Series(np.nan, index=a.index)
            if known.any():
                backend = backend or make()
                out[known] = backend.score_pairs(list(zip(a[known], b[known])))
            yield out.astype(object).where(known, None)

    scored = texts.withColumn("_new", F.pandas_udf(run, "double")(cut(F.col("_l"), "suspicious"), cut(F.col("_r"), "source")))
    return rerank(scored, F.col("_new")).drop("_l", "_r", "_new")


def upsert(existing: DataFrame, new: DataFrame, key: str, version: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Both tables with one row for each key: the latest version, ``new`` on ties; ``keep`` columns stay as first stored.

    One partially aggregated group-by instead of an anti-join and a union, so a key delivered very often costs no skewed sort.
    """
    every = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = F.struct(F.col(version), F.col("_new"))
    columns = [c for c in existing.columns if c != key]
    picked = [F.min_by(c, F.struct("_new", version)).alias(c) if c in keep else F.max_by(c, order).alias(c) for c in columns]
    return every.groupBy(key).agg(*picked).select(*existing.columns)


def shard_of(ordinal: Column, size: int) -> Column:
    return F.floor(ordinal / size).cast("int")


def shard_name(base: str, shard: Column) -> Column:
    return F.when(shard == 0, F.lit(base)).otherwise(F.concat(F.lit(f"{base}_shard_"), F.lpad(shard.cast("string"), 4, "0")))


def shard_index(base: str, name: Column) -> Column:
    digits = F.regexp_extract(name, f"^{base}_shard_([0-9]{{4,}})$", 1)
    return F.when(name == base, 0).when(digits != "", digits.cast("int"))
