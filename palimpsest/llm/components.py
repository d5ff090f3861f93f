"""Consolidating pairwise matches into groups (problem 7): deterministic Borůvka hooking.

In each round every component selects its smallest outgoing edge (edges are ordered by a hash of
their ends, then by the ends, so that order is total and the trees stay shallow), hooks itself to
the component at the other end, and the trees collapse by pointer doubling. Edges are relabelled
with the roots, loops and repeated edges drop out, and rounds go on until no edge remains. The
number of components at least halves per round. At the end the rounds' pointers are composed
from the last, smallest table to the first.

Every step is an equi-join or a partially aggregated group-by on 64-bit ids; a hub that holds a
third of all edges is one row after map-side aggregation, and on the probe side of a join its
rows are split by adaptive skew handling. Tables between steps are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.tables import materialize, release

#: Code points of the blanks that may surround an id.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def clean_id(col: Column) -> Column:
    """Lower case, without surrounding blanks; null if nothing is left."""
    x = F.lower(F.btrim(col, F.lit(BLANKS)))
    return F.when(x != "", x)


def links(evidence: DataFrame, left: str = "suspicious_chunk_id", right: str = "source_chunk_id") -> DataFrame:
    """Distinct (a, b), a < b in byte order, of the rows that have two different ids."""
    x = evidence.select(clean_id(F.col(left)).alias("l"), clean_id(F.col(right)).alias("r")).where("l <> r")
    return x.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct()


def _numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids with a 64-bit number each, edges of numbers). The hash is changed until it is injective."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    seed = 0
    while True:
        number = lambda c: F.xxhash64(F.lit(seed), F.col(c))  # noqa: B023,E731
        vertices = ids.select("id", number("id").alias("v"))
        if vertices.groupBy("v").count().where("count > 1").isEmpty():
            break
        seed += 1
    u, v = number("a"), number("b")
    return vertices, materialize(pairs.select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")), "edges")


def _collapse(pointers: DataFrame) -> DataFrame:
    """Pointer doubling until every node (v) points (p) at its root; roots point at themselves."""
    while True:
        up = pointers.select(F.col("v").alias("p"), F.col("p").alias("q"))
        step = materialize(pointers.join(up, "p").select("v", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "pointers")
        done = step.where("moved").isEmpty()
        release(pointers)
        pointers = step.select("v", "p")
        if done:
            return pointers


def component_pointers(edges: DataFrame) -> DataFrame | None:
    """(v, p): the root of every vertex of the edges (a, b), both bigint; None if there is no edge."""
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        order = [F.xxhash64("a", "b"), F.col("a"), F.col("b")]
        ends = F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w"))))
        chosen = edges.select(ends.alias("e"), F.struct(*order).alias("o")).groupBy("e.v").agg(F.min(F.struct("o", "e.w")).alias("m")).select("v", F.col("m.w").alias("w"))
        chosen = materialize(chosen, "hooks")
        # two components that selected the same edge point at each other: the smaller becomes the root
        back = chosen.select(F.col("v").alias("w"), F.col("w").alias("ww"))
        pointers = materialize(chosen.join(back, "w").select("v", F.when((F.col("ww") == F.col("v")) & (F.col("v") < F.col("w")), F.col("v")).otherwise(F.col("w")).alias("p")), "pointers")
        release(chosen)
        roots = _collapse(pointers)
        rounds.append(roots)
        to_a = roots.select(F.col("v").alias("a"), F.col("p").alias("x"))
        to_b = roots.select(F.col("v").alias("b"), F.col("p").alias("y"))
        after = edges.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        after = materialize(after, "edges")
        release(edges)
        edges = after
    if not rounds:
        return None
    total = rounds.pop()
    while rounds:
        lower = rounds.pop()
        upper = total.select(F.col("v").alias("p"), F.col("p").alias("q"))
        total = materialize(lower.join(upper, "p", "left").select("v", F.coalesce("q", "p").alias("p")), "roots")
    return total


def groups(evidence: DataFrame, left: str = "suspicious_chunk_id", right: str = "source_chunk_id") -> DataFrame:
    """(chunk_id, group_id): every linked id with the smallest id of its group in byte order.

    Rows with a missing id (null, empty, blank) or twice the same id link nothing; letter case and
    surrounding blanks of ids are ignored; repeated and reversed rows count once. No link, or an
    empty table, gives no rows. Other columns are never read.
    """
    vertices, edges = _numbered(links(evidence, left, right))
    roots = component_pointers(edges)
    if roots is None:
        return vertices.select(F.col("id").alias("chunk_id"), F.col("id").alias("group_id")).limit(0)
    named = materialize(vertices.join(roots, "v").select("id", "p"), "members")
    smallest = named.groupBy("p").agg(F.min("id").alias("group_id"))
    return named.join(smallest, "p").select(F.col("id").alias("chunk_id"), "group_id")
