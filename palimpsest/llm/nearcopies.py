"""Near-duplicate records with small edits (problem 1): count vectors in R-trees.

Records are compared by their distinct runs of five words. Every run is hashed into one of 64 to
512 groups, the more the longer the record; a record becomes the point of its group counts. Groups
halve by adding neighbours, so points of different resolution compare at the lower one. The overlap of two records is at most
the sum over the groups of the smaller count, and for two boxes of points the sum of the smaller
upper corners, so an R-tree over the points is joined with itself from the top down and a pair of
boxes is dropped when even this bound is below what the threshold needs for their sizes.

A single tree over all records would be searched by all records, and boxes of unrelated texts of
one length overlap. So there is one small tree for each *cell*: a record enters the cells of
``KEYS`` of its runs, chosen min-wise by independent hash functions from the rarest two thirds of
its runs. Rarity comes from run counts in a table of fixed size, summed over all records. Two
records of similarity 0.6 share a chosen run with a chance of at least 0.45 for each function
(every changed run may be among the rarest), so they miss each other in all cells with a chance
below 0.0001, and far less when they are more similar. The worst case is a record that is the other
one with a passage inserted whose runs are all rarer: there the chance of each function is a third
at similarity 0.6, and 0.15 % of such pairs are missed; at 0.7 it is 0.001 %. Surviving pairs are verified exactly.

Identical records (same words) are one class throughout; only classes are compared. A cell above
``TILE`` records is split into blocks that are joined block by block, so no task holds more than
two blocks; nothing is dropped. Which records may have such cells is known from the run counts
before any cell is shuffled, so a crowded cell never passes whole through one task.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textform import word_keys
from palimpsest.plans.tables import materialize, small_or_merged

RUN = 5  # words in a run
GROUPS = (64, 128, 256, 512)  # coordinates of a point: at least half as many as runs, while there are more
KEYS = 16  # cells of a record
HASH_BITS = 48  # of a run; the rest of 64 numbers the texts of a batch
RARE = 2 / 3  # the part of a record's runs its cells come from
COUNTERS = 1 << 18  # counters of run frequency
FULL = 4000  # what a count of 15 or more stands for in the bound, which is not used for records of more than 128,000 runs
LEAF = 16  # entries of an R-tree node
TILE = 4096  # records of a cell in one task
FULL_CLASS = 100  # members of a class that are expanded into all pairs
BROADCAST_ROWS = 100_000  # ids of at most 24 bytes that may be broadcast: 2.4 MB

_MULTIPLIERS = (np.random.default_rng(5).integers(1, 1 << 62, KEYS + 4, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_word_hash: dict[bytes | str, int] = {}


def _hash(word: bytes | str) -> int:
    h = _word_hash[word] = xxhash.xxh3_64_intdigest(word.decode("latin-1") if isinstance(word, bytes) else word)
    return h


def _runs(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct run hashes (``HASH_BITS`` bits, in the upper end of 64) of each text, concatenated, and where each text's begin (with the end)."""
    known = _word_hash
    if len(known) > 500_000:
        known.clear()
    every = list(chain.from_iterable(texts))
    for w in set(every).difference(known):
        _hash(w)
    flat = np.fromiter(map(known.__getitem__, every), np.uint64, len(every))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    n = len(flat)
    if n < RUN:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    mixed = np.zeros(n - RUN + 1, np.uint64)
    for k in range(RUN):
        mixed = (mixed ^ flat[k : n - RUN + 1 + k]) * _MULTIPLIERS[KEYS]
        mixed ^= mixed >> np.uint64(29)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[: n - RUN + 1] == owner[RUN - 1 :]
    both = owner[: n - RUN + 1][inside].astype(np.uint64) << np.uint64(HASH_BITS) | mixed[inside] >> np.uint64(64 - HASH_BITS)
    both.sort()
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    both = both[first]
    return both << np.uint64(64 - HASH_BITS), np.searchsorted(both >> np.uint64(HASH_BITS), np.arange(len(texts) + 1, dtype=np.uint64))


def _class(tbl: str, text: list[bytes] | list[str]) -> int:
    joined = b"\n".join(text) if isinstance(text[0], bytes) else "\n".join(text).encode("utf-8", "surrogatepass")
    return xxhash.xxh3_64_intdigest(tbl.encode() + b"\n" + joined) - (1 << 63)


def _tokenized(batch, least: int):
    """(tables, ids, word lists) of the texts of a batch with at least ``least`` words."""
    if len(batch) >= 1 << (64 - HASH_BITS):
        raise ValueError("spark.sql.execution.arrow.maxRecordsPerBatch must be below 65536")
    out = [(t, i, w) for t, i, x in zip(*(c.to_pylist() for c in batch.columns[:3])) if len(w := word_keys(x)) >= max(least, 1)]
    return tuple(map(list, zip(*out))) or ([], [], [])


def _first_pass(least: int):
    """Rows (tbl, id, cls) of the records, and at the end of a task the counters of its runs."""

    def run(batches):
        import pyarrow as pa

        counters = np.zeros(COUNTERS, np.int64)
        schema = pa.schema([("tbl", pa.string()), ("id", pa.int64()), ("cls", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            tbls, ids, texts = _tokenized(batch, least)
            runs, _ = _runs(texts)
            counters += np.bincount((runs >> np.uint64(46)).astype(np.int64), minlength=COUNTERS)
            none = [None] * len(ids)
            yield pa.RecordBatch.from_pydict({"tbl": tbls, "id": ids, "cls": [_class(t, w) for t, w in zip(tbls, texts)], "part": none, "counts": none}, schema)
        parts = [(k, c) for k, c in enumerate(np.split(counters, 64)) if c.any()]
        none = [None] * len(parts)
        yield pa.RecordBatch.from_pydict({"tbl": none, "id": none, "cls": none, "part": [k for k, _ in parts], "counts": [c.tobytes() for _, c in parts]}, schema)

    return run


def _add_counts(key, table):
    import pyarrow as pa

    total = reduce(np.add, (np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})


def _points(runs: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Group counts of each record as half bytes (15: 15 or more)."""
    size = np.diff(starts)
    grade = np.searchsorted(np.array(GROUPS[:-1]) * 2, size)
    out: list[bytes] = [b""] * len(size)
    mixed = runs * _MULTIPLIERS[KEYS + 1]
    owner = np.repeat(np.arange(len(size)), size)
    for k, groups in enumerate(GROUPS):
        own = np.flatnonzero(grade == k)
        if own.size:
            line = np.cumsum(grade == k) - 1
            mine = grade[owner] == k
            group = (mixed[mine] >> np.uint64(65 - groups.bit_length())).astype(np.int64)
            counts = np.minimum(np.bincount(line[owner[mine]] * groups + group, minlength=len(own) * groups), 15).astype(np.uint8).reshape(-1, groups)
            for i, packed in zip(own.tolist(), counts[:, ::2] << 4 | counts[:, 1::2]):
                out[i] = packed.tobytes()
    return out


class Points:
    """Packed points of several resolutions."""

    def __init__(self, blobs: list[bytes]):
        self.groups = np.fromiter(map(len, blobs), np.int64, len(blobs)) * 2
        self.line = np.zeros(len(blobs), np.int64)
        self.packed = {}
        for g in np.unique(self.groups).tolist():
            own = np.flatnonzero(self.groups == g)
            self.line[own] = np.arange(len(own))
            self.packed[g] = np.frombuffer(b"".join(blobs[i] for i in own.tolist()), np.uint8).reshape(-1, g // 2)

    def at(self, rows: np.ndarray, groups: int) -> np.ndarray:
        """The points of ``rows`` in ``groups`` coordinates, no more than any of them has."""
        out = np.empty((len(rows), groups), np.uint16)
        for g, packed in self.packed.items():
            own = np.flatnonzero(self.groups[rows] == g)
            if own.size:
                half = packed[self.line[rows[own]]]
                full = np.empty((len(own), g), np.uint16)
                full[:, ::2], full[:, 1::2] = half >> 4, half & 15
                full[full == 15] = FULL
                out[own] = full if g == groups else full.reshape(len(own), groups, -1).sum(2, dtype=np.uint16)
        return out


def _second_pass(frequency: np.ndarray, least: int, tile: int):
    """Cell rows (key, cls, n, point, often); a class leaves a task once. ``often``: a cell of the record may have more than ``TILE`` members."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("key", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("point", pa.binary()), ("often", pa.bool_())])
        seen: set[int] = set()
        for batch in batches:
            tbls, _, texts = _tokenized(batch, least)
            fresh = []
            for t, w in zip(tbls, texts):
                c = _class(t, w)
                if c not in seen:
                    seen.add(c)
                    fresh.append((c, t, w))
            if not fresh:
                continue
            cls = np.array([c for c, _, _ in fresh], np.int64)
            runs, starts = _runs([w for _, _, w in fresh])
            size = np.diff(starts)
            owner = np.repeat(np.arange(len(cls)), size)
            # the rarest first: by counter, then by hash, an order all records share
            often = frequency[(runs >> np.uint64(46)).astype(np.int64)]
            order = np.argsort(owner.astype(np.uint64) << np.uint64(48) | np.minimum(often, (1 << 20) - 1).astype(np.uint64) << np.uint64(28) | runs >> np.uint64(36))
            rank = np.arange(len(runs)) - np.repeat(starts[:-1], size)
            chosen = order[rank < np.ceil(size * RARE)[owner]]
            rare = runs[chosen]
            begin = np.concatenate(([0], np.cumsum(np.ceil(size * RARE).astype(np.int64))))[:-1]
            often = np.maximum.reduceat(often[chosen], begin) > tile  # else no cell of the record has more members
            points = _points(runs, starts)
            salt = np.array([xxhash.xxh3_64_intdigest(t) for _, t, _ in fresh], np.uint64)
            keys = []
            for k in range(KEYS):
                h = rare * _MULTIPLIERS[k]
                h ^= h >> np.uint64(32)
                low = np.minimum.reduceat(h * _MULTIPLIERS[KEYS + 2], begin)
                keys.append((low ^ salt ^ _MULTIPLIERS[k]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(cls, KEYS)), pa.array(np.tile(size, KEYS).astype(np.int32)), pa.array(points * KEYS, pa.binary()), pa.array(np.tile(often, KEYS))], schema=schema)

    return run


def _need(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The overlap two sets of these sizes need: t / (1 + t) of their sum."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def _possible(points_a, points_b, size_a, size_b, threshold) -> np.ndarray:
    """Whether the summed coordinate minima and the sizes allow the threshold."""
    out = np.empty(len(size_a), bool)
    for at in range(0, len(out), 1 << 15):
        s = slice(at, at + (1 << 15))
        bound = np.minimum(np.minimum(points_a[s], points_b[s]).sum(1, dtype=np.int32), np.minimum(size_a[s][:, 1], size_b[s][:, 1]))
        out[s] = (bound >= _need(size_a[s][:, 0], size_b[s][:, 0], threshold)) | (size_a[s][:, 1] >= FULL * GROUPS[0] // 2)
    return out


class RTree:
    """Packed R-tree of count vectors: entries in order of size, then of where their counts lie."""

    def __init__(self, points: np.ndarray, size: np.ndarray):
        heavy = np.minimum(points, 64).argmax(1)
        self.order = np.lexsort((heavy, size))
        self.levels = [(points[self.order], np.stack((size, size), 1)[self.order])]
        while len(self.levels[-1][0]) > 1:
            upper, span = self.levels[-1]
            begin = np.arange(0, len(upper), LEAF)
            self.levels.append((np.maximum.reduceat(upper, begin), np.stack((np.minimum.reduceat(span[:, 0], begin), np.maximum.reduceat(span[:, 1], begin)), 1)))

    def join(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of entries whose bound allows the threshold, each once."""
        a = b = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, span = self.levels[depth]
            kept = _possible(upper[a], upper[b], span[a], span[b], threshold) if depth else np.ones(len(a), bool)
            a, b = a[kept], b[kept]
            if depth == 0:
                break
            n = len(self.levels[depth - 1][0])
            grid = np.arange(LEAF)
            a, b = (x.ravel() for x in np.broadcast_arrays(a[:, None, None] * LEAF + grid[None, :, None], b[:, None, None] * LEAF + grid[None, None, :]))
            inside = (a < n) & (b < n) & ((a < b) if depth == 1 else (a <= b))
            a, b = a[inside], b[inside]
            if depth == 1:
                upper, span = self.levels[0]
                kept = _possible(upper[a], upper[b], span[a], span[b], threshold)
                a, b = a[kept], b[kept]
        return self.order[a], self.order[b]


def _join_cells(keys, cls, size, points, threshold) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of classes inside the runs of equal keys (rows are in key order)."""
    edge = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    count = np.diff(edge)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, LEAF + 1):  # trees of one leaf, all of one size at once
        begin = edge[:-1][count == n]
        if begin.size:
            i, j = np.triu_indices(n, 1)
            left.append((begin[:, None] + i).ravel())
            right.append((begin[:, None] + j).ravel())
    a, b = np.concatenate(left), np.concatenate(right)
    different = cls[a] != cls[b]
    a, b = a[different], b[different]
    near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
    a, b = a[near], b[near]
    found = [(a, b)]
    for lo, hi in zip(edge[:-1][count > LEAF], edge[1:][count > LEAF]):
        at = np.unique(cls[lo:hi], return_index=True)[1]
        x, y = RTree(points.at(lo + at, int(points.groups[lo + at].min())), size[lo + at]).join(threshold)
        found.append((lo + at[x], lo + at[y]))
    a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    # the bound of each pair that is left, in the highest resolution both have
    spans, kept = np.stack((size, size), 1), np.zeros(len(a), bool)
    common = np.minimum(points.groups[a], points.groups[b])
    for g in points.packed:
        own = np.flatnonzero(common == g)
        for at in range(0, len(own), 16384):
            k = own[at : at + 16384]
            kept[k] = _possible(points.at(a[k], g), points.at(b[k], g), spans[a[k]], spans[b[k]], threshold)
    x, y = cls[a[kept]], cls[b[kept]]
    return np.minimum(x, y), np.maximum(x, y)


def _cell_joiner(threshold: float):
    """Reads rows in key order; yields candidate pairs."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        sent: set[tuple[int, int]] = set()

        def joined(tables):
            whole = pa.concat_tables(tables).combine_chunks()
            keys, cls, size = (whole.column(k).to_numpy() for k in ("key", "cls", "n"))
            x, y = _join_cells(keys, cls, size.astype(np.int64), Points(whole.column("point").to_pylist()), threshold)
            fresh = [p for p in dict.fromkeys(zip(x.tolist(), y.tolist())) if p not in sent]
            if len(sent) < 2_000_000:
                sent.update(fresh)
            if fresh:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*fresh)], schema=schema)

        held = []  # rows of the last key, which may go on in the next batch
        for batch in batches:
            t = pa.Table.from_batches([batch])
            keys = t.column("key").to_numpy()
            last = len(keys) - int(np.argmax(keys[::-1] != keys[-1])) if (keys != keys[-1]).any() else 0
            if last or (held and held[-1].column("key")[0].as_py() != keys[0]):
                head = t.slice(0, last)
                yield from joined([*held, head] if len(head) else held)
                held = []
            held.append(t.slice(last))
        if held:
            yield from joined(held)

    return run


def _joined(cells: DataFrame, threshold: float) -> DataFrame:
    ordered = cells.select("key", "cls", "n", "point").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(_cell_joiner(threshold), "a bigint, b bigint")


def _candidates(cells: DataFrame, threshold: float, crowded: bool) -> DataFrame:
    """Distinct pairs of classes. ``crowded``: some cells may have more than ``TILE`` members; those that do are counted
    with partial aggregation and spread over their pairs of blocks before their first shuffle."""
    if crowded:
        cells = materialize(cells, "cells")
        many = cells.where("often").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE)
        blocks = materialize(many.select("key", F.ceil(F.col("n") / (TILE // 2)).cast("int").alias("blocks")), "crowded")
        few = small_or_merged(blocks, BROADCAST_ROWS)
        own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
        tiles = cells.where("often").join(few, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tiles = tiles.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "cls", "n", "point")
        calm = cells.join(small_or_merged(blocks, BROADCAST_ROWS), "key", "left_anti").select("key", "cls", "n", "point")
        cells = calm.unionByName(tiles)
    return materialize(_joined(cells, threshold).distinct(), "candidates")


def _set_pass(least: int):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("cls", pa.int64()), ("runs", pa.binary())])
        for batch in batches:
            tbls, _, texts = _tokenized(batch, least)
            runs, starts = _runs(texts)
            sets = [runs[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])]
            yield pa.RecordBatch.from_pydict({"cls": [_class(t, w) for t, w in zip(tbls, texts)], "runs": sets}, schema)

    return run


def _verify(threshold: float):
    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
        for batch in batches:
            out: list[tuple] = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if (like := both / (len(x) + len(y) - both)) >= threshold:
                    out.append((a, b, like))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 3, schema)], schema=schema)

    return run


def near_copies(records: DataFrame, threshold: float = 0.8, least: int = 40) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the records (tbl string, id bigint, text string).

    ``members`` (tbl, id, cls) has every record of at least ``least`` words with its class: the
    records of the same table with the same words. ``pairs`` (a, b, similarity) has the pairs of
    different classes of one table whose distinct five-word runs have a Jaccard similarity of
    ``threshold`` or more. Null and short texts and null ids are left out, repeated rows count
    once; other columns are never read; empty input gives empty tables.
    """
    records = records.select("tbl", F.col("id").cast("bigint").alias("id"), "text").where("id is not null and length(text) >= 2 * " + str(least) + " - 1")
    first = materialize(records.mapInArrow(_first_pass(least), "tbl string, id bigint, cls bigint, part int, counts binary"), "runs")
    members = first.where("part is null").select("tbl", "id", "cls").distinct()
    summed = first.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(_add_counts, "part int, counts binary")
    frequency = np.zeros((64, COUNTERS // 64), np.int32)
    for row in summed.collect():  # 64 rows of 16 kB, whatever the input
        frequency[row.part] = np.frombuffer(row.counts, np.int32)
    cells = records.mapInArrow(_second_pass(frequency.ravel(), least, TILE), "key bigint, cls bigint, n int, point binary, often boolean")
    candidates = _candidates(cells, threshold, bool(frequency.max() > TILE))
    involved = candidates.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    chosen = materialize(members.join(involved, "cls").groupBy("cls").agg(F.min(F.struct("tbl", "id")).alias("r")).select("r.tbl", "r.id"), "involved")
    texts = records.join(small_or_merged(chosen, BROADCAST_ROWS), ["tbl", "id"], "left_semi")
    sets = materialize(texts.mapInArrow(_set_pass(least), "cls bigint, runs binary"), "sets")
    sets = sets.join(involved, "cls", "left_semi").dropDuplicates(["cls"])  # an id with two texts brings both
    left = sets.select(F.col("cls").alias("a"), F.col("runs").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("runs").alias("y"))
    both = candidates.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return members, materialize(both.mapInArrow(_verify(threshold), "a bigint, b bigint, similarity double"), "pairs")


def record_pairs(members: DataFrame, pairs: DataFrame, full: int = FULL_CLASS) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b: the class pairs and the pairs inside classes as pairs of records.

    Classes of at most ``full`` records are expanded into all pairs; a larger class is linked
    through its smallest record, to other classes and to each of its own members.
    """
    size = members.groupBy("tbl", "cls").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    small = members.join(size, ["tbl", "cls"]).select("tbl", "cls", "id", "rep", "n").where((F.col("n") <= full) | (F.col("id") == F.col("rep")))
    end = lambda k: small.select("tbl", F.col("cls").alias(k), F.col("id").alias(f"id_{k}"))
    across = pairs.join(end("a"), "a").join(end("b"), ["tbl", "b"]).select("tbl", F.col("id_a").alias("x"), F.col("id_b").alias("y"))
    copies = small.where(f"n > 1 and n <= {full}")
    again = copies.select("tbl", "cls", F.col("id").alias("y"))
    inside = copies.select("tbl", "cls", F.col("id").alias("x")).join(again, ["tbl", "cls"]).where("x < y").select("tbl", "x", "y")
    large = size.where(f"n > {full}").join(members, ["tbl", "cls"]).where("id <> rep").select("tbl", F.col("rep").alias("x"), F.col("id").alias("y"))
    every = across.unionByName(inside).unionByName(large)
    return every.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()


def record_classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each record: its class's smallest record, the class's size, and its number of links to other classes."""
    size = members.groupBy("tbl", "cls").agg(F.count("*").alias("copies"), F.min("id").alias("class_id"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    named = size.join(links, "cls", "left")
    return members.join(named, ["tbl", "cls"]).select("tbl", "id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def texts_of(df: DataFrame, tbl: str, key: str, text: str | Column = "text") -> DataFrame:
    return df.select(F.lit(tbl).alias("tbl"), F.col(key).alias("id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
