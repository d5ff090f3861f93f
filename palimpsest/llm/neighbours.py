"""Most similar vectors for every vector (problem 2): a small-world graph for each shard.

Vectors are scaled to length 1; equal directions form one class, and only classes are indexed.
Shards are the cells of centroids fitted on a sample; a cell above ``SHARD`` classes is split. Above
``FLAT`` cells the centroids are themselves grouped, so a vector is compared with the groups near it
and their cells only. Each shard gets a hierarchical navigable small-world graph, kept as flat arrays (vectors,
neighbour numbers of every level) in one row of a table. Every class is a query to all shards
whose centroid is nearly as close to it as the closest one (within ``MARGIN`` of cosine), in blocks
of bounded size, of which a shard has as many as it has queries for; the shards' results are merged. Of the true neighbours of a sample of 60,000
vectors 99.98 % lay in such shards, which were 2 of 8. Searching and building run over many
vectors at once.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.tables import materialize, small_or_merged

SIZE = 64  # dimensions
NEAREST = 5
LEAST = 0.85  # cosine
SHARD = 8192  # classes of a graph
SAMPLE = 20_000  # vectors the centroids are fitted on
BLOCK = 20_000  # queries of a shard in one task
M = 12  # links of a node in the upper levels, twice as many in the lowest
BUILD = 48  # nodes a build search keeps
SEARCH = 48  # nodes a query keeps
BATCH = 512
MARGIN = 0.15  # of cosine to a centroid
FLAT = 64  # cells that are compared with every vector
BROADCAST_ROWS = 50_000  # shards, rows of at most 24 bytes that may be broadcast: 1.2 MB
WIDE = 4  # nodes expanded at once
KEPT = NEAREST + 3  # classes a shard returns: some more than needed, for ties


class Graph:
    """Hierarchical small-world graph over unit vectors; ``links[0]`` is the lowest level.

    Each level is (members, neighbour array): numbers of the nodes in the level, and for each of
    them a row of neighbour numbers, filled up with -1.
    """

    def __init__(self, vectors: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]], exact: np.ndarray | None = None):
        self.vectors, self.links, self.exact = vectors, links, exact  # ``exact``: in full precision, for the cosines that are given
        self.row = []
        for members, _ in links:
            row = np.full(len(vectors), -1, np.int32)
            row[members] = np.arange(len(members), dtype=np.int32)
            self.row.append(row)

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        n = len(vectors)
        height = np.minimum((-np.log(np.random.default_rng(7).random(n) + 1e-12) / math.log(M)).astype(int), 6)
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(int(height.max(initial=0)), -1, -1):
            members = np.flatnonzero(height >= level).astype(np.int32)
            upper = cls(vectors, links)
            links = [(members, cls._level(vectors, members, upper, M if level else 2 * M)), *links]
        return cls(vectors, links)

    @classmethod
    def _level(cls, vectors, members, upper: Graph, width: int) -> np.ndarray:
        """Neighbours in one level: nodes enter in batches that at most double it, by a search in what is there."""
        n = len(members)
        near = np.full((n, width), -1, np.int32)
        own = vectors[members]
        order = np.random.default_rng(n).permutation(n)
        done = 0
        while done < n:
            batch = order[done : done + min(max(done, 64), BATCH)]
            sims = own[batch] @ own[batch].T
            np.fill_diagonal(sims, -2)
            k = min(width, len(batch) - 1)
            inner = np.argpartition(-sims, k - 1, 1)[:, :k] if k > 0 else np.zeros((len(batch), 0), int)
            found = batch[inner]
            value = np.take_along_axis(sims, inner, 1)
            if done:
                starts = order[np.random.default_rng(done).integers(0, done, (len(batch), 4))]
                seeds = np.concatenate((starts, np.where((g := cls._entry(upper, own[batch], members)) >= 0, np.where(cls._linked(near, g), g, starts[:, 0]), starts[:, 0])[:, None]), 1)
                ids, got = _beam(own, near, own[batch], seeds, BUILD)
                found, value = np.concatenate((ids, found), 1), np.concatenate((got, value), 1)
            chosen = _diverse(own, batch, found, value, width)
            near[batch] = chosen
            _link_back(own, near, batch, chosen)
            done += len(batch)
        return near

    @staticmethod
    def _linked(near: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return near[np.maximum(rows, 0)].max(1) >= 0

    @staticmethod
    def _entry(upper: Graph, queries: np.ndarray, members: np.ndarray) -> np.ndarray:
        """The node (row of the level) where the levels above lead each query; -1 without such levels."""
        if not upper.links:
            return np.full(len(queries), -1)
        row = np.full(len(upper.vectors), -1, np.int64)
        row[members] = np.arange(len(members))
        return row[upper.descend(queries, 0)]

    def descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """The node of level ``to`` nearest to each query, found greedily from the top."""
        top = self.links[-1][0]
        at = np.full((len(queries), 1), top[0], np.int32)
        for level in range(len(self.links) - 1, to - 1, -1):
            members, near = self.links[level]
            ids, _ = _beam(self.vectors[members], near, queries, self.row[level][at], 4)
            at = members[ids[:, :1]]
        return at[:, 0]

    def search(self, queries: np.ndarray, keep: int = SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, cosines) of up to ``keep`` nodes near each query, best first; numbers -1 fill up."""
        start = self.descend(queries, 1)[:, None] if len(self.links) > 1 else np.zeros((len(queries), 1), np.int32)
        return _beam(self.vectors, self.links[0][1], queries, start, keep)

    def to_row(self) -> tuple[bytes, list[bytes], list[bytes]]:
        return self.exact.tobytes(), [m.tobytes() for m, _ in self.links], [a.tobytes() for _, a in self.links]

    @classmethod
    def from_row(cls, vectors: bytes, members: list[bytes], near: list[bytes]) -> Graph:
        v = np.frombuffer(vectors, np.float64).reshape(-1, SIZE)
        levels = [(m := np.frombuffer(x, np.int32), np.frombuffer(y, np.int32).reshape(len(m), -1)) for x, y in zip(members, near)]
        return cls(v.astype(np.float32), levels, v)


def _beam(vectors, near, queries, starts, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries at once: in each step every query expands its ``WIDE`` best open nodes."""
    q, n = len(queries), len(vectors)
    starts = np.sort(starts, 1)
    fresh = np.ones(starts.shape, bool)
    fresh[:, 1:] = starts[:, 1:] != starts[:, :-1]
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)[:, None]
    seen[rows, starts] = True
    value = np.where(fresh, np.einsum("qd,qsd->qs", queries, vectors[starts]), -3).astype(np.float32)
    ids = np.where(fresh, starts, -1).astype(np.int32)
    open_ = fresh.copy()
    if ids.shape[1] < keep:
        pad = keep - ids.shape[1]
        ids, value, open_ = (np.concatenate((x, np.full((q, pad), f, x.dtype)), 1) for x, f in ((ids, -1), (value, -3), (open_, False)))
    live = np.arange(q)
    while live.size:
        best = np.where(open_[live], value[live], -4)
        pick = np.argpartition(-best, WIDE - 1, 1)[:, :WIDE] if keep > WIDE else np.argsort(-best, 1)[:, :1]
        valid = np.take_along_axis(best, pick, 1) > -3
        some = valid.any(1)
        live, pick, valid = live[some], pick[some], valid[some]
        if not live.size:
            break
        r = live[:, None]
        nodes = np.where(valid, ids[r, pick], -1)
        open_[r, pick] = False
        next_ = near[nodes]
        next_[nodes < 0] = -1
        next_ = np.sort(next_.reshape(len(live), -1), 1)
        good = next_ >= 0
        good[:, 1:] &= next_[:, 1:] != next_[:, :-1]
        good &= ~seen[r, next_]
        width = max(1, int(good.sum(1).max()))
        side = np.argsort(~good, 1, kind="stable")[:, :width]
        next_, good = np.take_along_axis(next_, side, 1), np.take_along_axis(good, side, 1)
        next_ = np.where(good, next_, 0)
        i, j = np.nonzero(good)
        seen[live[i], next_[i, j]] = True
        sims = np.where(good, np.matmul(vectors[next_], queries[live][:, :, None])[:, :, 0], -3).astype(np.float32)
        all_ids = np.concatenate((ids[live], np.where(good, next_, -1).astype(np.int32)), 1)
        all_value = np.concatenate((value[live], sims), 1)
        all_open = np.concatenate((open_[live], good), 1)
        top = np.argpartition(-all_value, keep - 1, 1)[:, :keep]
        ids[live], value[live], open_[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_value, all_open))
    order = np.argsort(-value, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(value, order, 1)


def _diverse(own, batch, found, value, width: int) -> np.ndarray:
    """Of each node's candidates those nearer to it than to a neighbour already chosen; the nearest others fill up."""
    order = np.argsort(-value, 1, kind="stable")[:, : 2 * width]
    found, value = np.take_along_axis(found, order, 1), np.take_along_axis(value, order, 1)
    usable = (found >= 0) & (value > -2) & (found != batch[:, None])
    vec = own[np.maximum(found, 0)]
    between = np.matmul(vec, vec.transpose(0, 2, 1))
    k = found.shape[1]
    chosen = np.zeros(found.shape, bool)
    repeated = np.zeros(found.shape, bool)
    for j in range(k):
        repeated[:, j] = ((found[:, :j] == found[:, j : j + 1]) & usable[:, :j]).any(1)
        hidden = (chosen[:, :j] & (between[:, j, :j] > value[:, j : j + 1])).any(1)
        chosen[:, j] = usable[:, j] & ~repeated[:, j] & ~hidden
    rank = np.where(chosen, 0, np.where(usable & ~repeated, 1, 2)) * k + np.arange(k)
    pick = np.argsort(rank, 1)[:, :width]
    out = np.where(np.take_along_axis(rank, pick, 1) < 2 * k, np.take_along_axis(found, pick, 1), -1).astype(np.int32)
    return out if out.shape[1] == width else np.concatenate((out, np.full((len(out), width - out.shape[1]), -1, np.int32)), 1)


def _link_back(own, near, batch, chosen) -> None:
    """Each chosen neighbour also links to the new node; a full row is chosen anew from all its links."""
    source = np.repeat(batch, chosen.shape[1])
    target = chosen.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
    if not len(nodes):
        return
    width = near.shape[1]
    extra = np.full((len(nodes), int(count.max())), -1, np.int32)
    extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(begin, count)] = source
    every = np.concatenate((near[nodes], extra), 1)
    for at in range(0, len(nodes), BATCH):
        part = every[at : at + BATCH]
        sims = np.where(part >= 0, np.matmul(own[np.maximum(part, 0)], own[nodes[at : at + BATCH]][:, :, None])[:, :, 0], -3)
        near[nodes[at : at + BATCH]] = _diverse(own, nodes[at : at + BATCH], part, sims, width)


def centroids(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors, with a fixed start."""
    rng = np.random.default_rng(11)
    centre = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        length = np.linalg.norm(total, axis=1)
        centre = np.where(length[:, None] > 1e-9, total / np.maximum(length, 1e-9)[:, None], centre)
    return centre.astype(np.float32)


class Cells:
    """Centroids in groups: those of group g stand in rows ``starts[g]`` to ``starts[g + 1]``."""

    def __init__(self, sample: np.ndarray, count: int):
        groups = 1 if count <= FLAT else math.isqrt(count)
        self.top = centroids(sample, groups) if len(sample) else np.zeros((1, SIZE), np.float32)
        own = (sample @ self.top.T).argmax(1) if len(sample) else np.zeros(0, int)
        parts = []
        for g in range(len(self.top)):
            inside = sample[own == g]
            parts.append(centroids(inside, max(1, round(count * len(inside) / max(len(sample), 1)))) if len(inside) else self.top[g : g + 1])
        self.centre = np.concatenate(parts)
        self.starts = np.cumsum([0, *map(len, parts)])

    def near(self, u: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, cosine) of the cells within ``margin`` of the best one of each row, among the groups within ``margin`` of the best group."""
        above = u @ self.top.T.astype(np.float64)
        above = above >= above.max(1, keepdims=True) - margin
        rows, cells, cosines = [], [], []
        for g in np.flatnonzero(above.any(0)).tolist():
            r = np.flatnonzero(above[:, g])
            c = u[r] @ self.centre[self.starts[g] : self.starts[g + 1]].T.astype(np.float64)
            i, j = np.nonzero(c >= c.max(1, keepdims=True) - margin)
            rows.append(r[i])
            cells.append(self.starts[g] + j)
            cosines.append(c[i, j])
        row, cell, cosine = np.concatenate(rows), np.concatenate(cells), np.concatenate(cosines)
        best = np.full(len(u), -2.0)
        np.maximum.at(best, row, cosine)
        kept = cosine >= best[row] - margin
        return row[kept], cell[kept], cosine[kept]


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, SIZE)


def latest_classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, classes) of the usable latest rows: (id, cls), and (cls, unit array<float>).

    The row with the latest ``upserted_at`` stands for its id (a null time is the earliest; ties go
    to the larger vector in array order, the same for every run). Null, wrongly sized, all-zero
    and NaN- or infinity-holding vectors, and null ids, then drop out.
    """
    last = records.select("id", F.struct("upserted_at", "vector").alias("row")).where("id is not null").groupBy("id").agg(F.max("row.upserted_at").alias("t"), F.max("row").alias("row")).select("id", F.col("row.vector").alias("v"))
    whole = last.where((F.size("v") == SIZE) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    peak = whole.select("id", "v", F.array_max(F.transform("v", F.abs)).alias("peak")).where("peak > 0")
    scaled = peak.select("id", F.transform("v", lambda x: x / F.col("peak")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = scaled.select("id", "v", norm.alias("norm")).select("id", F.transform("v", lambda x: x / F.col("norm")).alias("u"))
    close = F.transform("u", lambda x: F.round(x, 9) + 0.0)  # equal directions may differ in their last digits
    members = materialize(unit.select("id", F.xxhash64(close).alias("cls"), F.xxhash64(F.lit(1), close).alias("more"), "u"), "vectors")
    classes = members.groupBy("cls", "more").agg(F.first("u").alias("u"))
    return members.select("id", "cls", "more"), classes


def _assign(cells: Cells):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            u = _vectors(batch.column(2))
            cell = np.zeros(len(u), np.int32)
            if len(u):
                row, near, cosine = cells.near(u, 0.0)
                order = np.lexsort((-near, cosine))  # the closest last, of equally close ones the first cell
                cell[row[order]] = near[order]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cell)], ["cls", "more", "u", "cell"])

    return run


def _probe(cells: Cells, margin: float):
    """Each query with every cell whose centroid is within ``margin`` of its best."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            u = _vectors(batch.column(2))
            if not len(u):
                continue
            who, cell, _ = cells.near(u, margin)
            taken = batch.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), taken.column(2), pa.array(cell.astype(np.int32))], ["cls", "more", "u", "cell"])

    return run


def _build(key, table):
    import pyarrow as pa

    table = table.sort_by([("cls", "ascending"), ("more", "ascending")])
    graph = Graph.build((exact := _vectors(table.column("u"))).astype(np.float32))
    graph.exact = exact
    vectors, members, near = graph.to_row()
    names = np.stack((table.column("cls").to_numpy(), table.column("more").to_numpy()), 1).tobytes()
    return pa.table({"cell": [key[0]], "part": [key[1]], "names": [names], "vectors": [vectors], "members": pa.array([members], pa.list_(pa.binary())), "near": pa.array([near], pa.list_(pa.binary()))})


def _search(least: float):
    def run(key, left, right):
        import pyarrow as pa

        schema = pa.schema([("cls", pa.int64()), ("more", pa.int64()), ("to_cls", pa.int64()), ("to_more", pa.int64()), ("cosine", pa.float64())])
        out = []
        if len(left) and len(right):
            row = left.slice(0, 1).to_pylist()[0]
            graph = Graph.from_row(row["vectors"], row["members"], row["near"])
            names = np.frombuffer(row["names"], np.int64).reshape(-1, 2)
            queries = _vectors(right.column("u"))
            cls, more = right.column("cls").to_numpy(), right.column("more").to_numpy()
            for at in range(0, len(queries), BATCH):
                s = slice(at, at + BATCH)
                ids, _ = graph.search(queries[s].astype(np.float32))
                ids = ids[:, : KEPT + 1]
                exact = np.einsum("qd,qkd->qk", queries[s], graph.exact[np.maximum(ids, 0)])
                good = (ids >= 0) & (exact >= least - 1e-4)
                good &= (names[ids, 0] != cls[s][:, None]) | (names[ids, 1] != more[s][:, None])
                i, j = np.nonzero(good)
                out.append((cls[s][i], more[s][i], names[ids[i, j], 0], names[ids[i, j], 1], exact[i, j]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def neighbour_pairs(records: DataFrame, nearest: int = NEAREST, least: float = LEAST, shard: int = SHARD, margin: float = MARGIN) -> DataFrame:
    """(id, neighbour, cosine, place): up to ``nearest`` other ids of highest cosine, ``least`` or more, for every usable record.

    Ties go to the smaller id; records of one direction are neighbours of each other with cosine
    1. See ``latest_classes`` for which rows count. Empty input gives no rows.
    """
    members, classes = latest_classes(records)
    classes = materialize(classes, "classes")
    total = classes.count()
    cells = max(1, -(-total // shard))
    sample = np.array([r.u for r in classes.orderBy(F.xxhash64("cls")).limit(max(SAMPLE, 2 * cells)).select("u").collect()], np.float64).reshape(-1, SIZE)
    centre = Cells(sample, cells)
    placed = materialize(classes.mapInArrow(_assign(centre), "cls bigint, more bigint, u array<double>, cell int"), "cells")
    parts = materialize(placed.groupBy("cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts")), "parts")
    few = small_or_merged(parts, BROADCAST_ROWS)
    sharded = placed.join(few, "cell").withColumn("part", F.pmod(F.xxhash64("more"), F.col("parts")).cast("int"))
    graphs = materialize(sharded.select("cls", "more", "u", "cell", "part").groupBy("cell", "part").applyInArrow(_build, "cell int, part int, names binary, vectors binary, members array<binary>, near array<binary>"), "graphs")
    queries = materialize(placed.select("cls", "more", "u").mapInArrow(_probe(centre, margin), "cls bigint, more bigint, u array<double>, cell int"), "queries")
    blocks = queries.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    blocks = small_or_merged(materialize(parts.join(blocks, "cell"), "blocks"), BROADCAST_ROWS)
    queries = queries.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    queries = queries.select("cls", "more", "u", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block")
    copies = graphs.join(blocks.select("cell", "blocks"), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    on = ["cell", "part", "block"]
    found = copies.groupBy(*on).cogroup(queries.groupBy(*on)).applyInArrow(_search(least), "cls bigint, more bigint, to_cls bigint, to_more bigint, cosine double")
    found = found.where(F.round("cosine", 9) >= least)
    rank = Window.partitionBy("cls", "more").orderBy(F.desc("cosine"), "to_cls")
    best = found.withColumn("rank", F.row_number().over(rank)).where(f"rank <= {nearest + 3}").drop("rank")
    best = materialize(best, "found")
    # the first ids of each class: as many as can be neighbours, and one more for the record itself
    order = Window.partitionBy("cls", "more").orderBy("id")
    heads = materialize(members.withColumn("k", F.row_number().over(order)).where(f"k <= {nearest + 1}").drop("k"), "heads")
    other = heads.select(F.col("cls").alias("to_cls"), F.col("more").alias("to_more"), "id")
    listed = best.join(other, ["to_cls", "to_more"]).select("cls", "more", "id", F.round("cosine", 9).alias("cosine"))
    listed = listed.unionByName(heads.select("cls", "more", "id", F.lit(1.0).alias("cosine")))
    by = Window.partitionBy("cls", "more").orderBy(F.desc("cosine"), "id")
    top = listed.withColumn("k", F.row_number().over(by)).where(f"k <= {nearest + 1}").groupBy("cls", "more").agg(F.sort_array(F.collect_list(F.struct("k", "id", "cosine"))).alias("top"))
    own = members.join(top, ["cls", "more"])
    rest = F.slice(F.filter("top", lambda x: x["id"] != F.col("id")), 1, nearest)
    return own.select("id", F.posexplode(rest).alias("place", "n")).select("id", F.col("n.id").alias("neighbour"), F.col("n.cosine").alias("cosine"), (F.col("place") + 1).alias("place"))


def linked(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which either is a neighbour of the other."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
