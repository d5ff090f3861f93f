"""Filling fixed-capacity containers with items (problem 8): hierarchical residual packing.

Every task packs its share of the items best-fit, largest first, and emits the bins that are
nearly full. What is left goes up a tree: an underfull bin counts as one item, several tasks'
bins come together, and best-fit runs again, round after round, until one task is left. After a
round a task has at most one bin that is half full or less (two would have been put together), so
only these can still be placed; they need a host with room. A task therefore hands up its one
small bin and no more hosts than there are tasks in all, those with the most room; the other bins
cannot gain and are final. So what moves up is bounded by the square of the number of tasks, at
any input size.
"""

from __future__ import annotations

import base64
from heapq import nlargest

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.tables import materialize

CAPACITY = 512
#: Part of a bin that may be empty when it is emitted as nearly full.
SLACK = 0.01
#: Items of a task in the first round, and tasks that come together in a later one.
TASK_ITEMS = 100_000
FAN_IN = 8
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the byte-level vocabularies split text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict = {}


def encoder(path: str):
    """The byte-pair encoding of a ranks file (base64 token and rank on each line)."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _token_pass(path: str):
    def run(batches):
        import pyarrow as pa

        encode = encoder(path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32())], ["id", "tokens"])

    return run


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, tokens) of every row; null and empty texts have 0 tokens. Map-only, whole texts."""
    picked = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(_token_pass(tokenizer), f"id {kind}, tokens int")


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item: largest first, each into the fullest bin with room. Items must fit a bin.

    Open bins stand in stacks by room; a bit mask of the rooms that have one finds the tightest.
    """
    bins = np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            where = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            room, where = capacity, opened
            opened += 1
        bins[i] = where
        stacks[room - size].append(where)
        mask |= 1 << (room - size)
    return bins


def _carried(fill: np.ndarray, capacity: int, hosts: int) -> np.ndarray:
    """Bins that go up: those at most half full, and the ``hosts`` with the most room of those not nearly full."""
    small = np.flatnonzero(fill <= capacity // 2)
    open_ = np.flatnonzero((fill > capacity // 2) & (fill < capacity * (1 - SLACK))).tolist()
    return np.concatenate((small, np.array(nlargest(hosts, open_, key=lambda b: capacity - fill[b]), np.int64)))


def _name(level: int, task: int, bins: np.ndarray) -> np.ndarray:
    return (level << 58) + (task << 32) + bins


def _first_round(capacity: int, hosts: int):
    """Items (id, piece, size) in; rows (id, piece, size, bin) and handed-up bins (bin, size, id null) out."""

    def run(batches):
        import pyarrow as pa

        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.sort_by([("size", "descending"), ("id", "ascending"), ("piece", "ascending")])
        task = TaskContext.get().partitionId()
        sizes = rows.column("size").to_numpy().astype(np.int64)
        bins = best_fit(sizes, capacity)
        fill = np.bincount(bins, sizes).astype(np.int64)
        up = _carried(fill, capacity, hosts)
        names = _name(0, task, bins)
        none = pa.nulls(len(up), rows.schema.field("id").type)
        place = pa.Table.from_arrays([rows.column("id"), rows.column("piece"), rows.column("size"), pa.array(names), pa.nulls(len(rows), pa.int32())], ["id", "piece", "size", "bin", "task"])
        more = pa.Table.from_arrays([none, pa.nulls(len(up), pa.int32()), pa.array(fill[up].astype(np.int32)), pa.array(_name(0, task, up)), pa.array(np.full(len(up), task, np.int32))], ["id", "piece", "size", "bin", "task"])
        yield from place.to_batches()
        yield from more.to_batches()

    return run


def _later_round(level: int, capacity: int, hosts: int):
    """One group of handed-up bins (bin, size): where each goes, and the bins handed up again."""

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by([("size", "descending"), ("bin", "ascending")])
        task = key[0].as_py()
        sizes = table.column("size").to_numpy().astype(np.int64)
        bins = best_fit(sizes, capacity)
        fill = np.bincount(bins, sizes).astype(np.int64)
        up = _carried(fill, capacity, hosts)
        old = table.column("bin").to_numpy()
        return pa.table(
            {
                "bin": pa.array(np.concatenate((old, _name(level, task, up)))),
                "into": pa.array([*_name(level, task, bins).tolist(), *[None] * len(up)], pa.int64()),
                "size": pa.array(np.concatenate((sizes, fill[up])).astype(np.int32)),
                "task": pa.array(np.full(len(old) + len(up), task, np.int32)),
            }
        )

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY, tasks: int | None = None) -> DataFrame:
    """(id, piece, tokens, container) of the items (id, tokens).

    An item above the capacity is split into full containers and a rest; no other is split. Items
    of size 0 are placed too (they take no room); null sizes count as 0, negative ones raise an
    error. Repeated ids are separate items only if the caller makes them so: ids are expected
    unique. Empty input gives no rows. Containers are bigint names, the same for the same input
    and number of tasks.
    """
    n = F.coalesce(F.col("tokens"), F.lit(0))
    n = F.when(n < 0, F.raise_error(F.lit("item size must not be negative"))).otherwise(n).cast("int")
    base = sizes.select("id", n.alias("n"))
    pieces = F.expr(f"sequence(0, greatest(cast(ceil(n / {capacity}) as int), 1) - 1)")
    items = base.select("id", "n", F.explode(pieces).alias("piece")).select("id", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("size"))
    items = materialize(items, "items")
    tasks = tasks or max(1, -(-items.count() // TASK_ITEMS))
    kind = items.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, size int, bin bigint, task int"
    placed = materialize(items.repartition(tasks, "id", "piece").mapInArrow(_first_round(capacity, tasks), schema), "placed")
    result = placed.where("task is null").select("id", "piece", F.col("size").alias("tokens"), "bin")
    up = placed.where("task is not null").select("bin", "size", "task")
    moves, level = [], 0
    while tasks > 1:
        level, tasks = level + 1, -(-tasks // FAN_IN)
        group = F.floor(F.col("task") / FAN_IN).cast("int").alias("task")
        step = up.select("bin", "size", group).groupBy("task").applyInArrow(_later_round(level, capacity, tasks), "bin bigint, into bigint, size int, task int")
        step = materialize(step, "round")
        moves.append(step.where("into is not null").select("bin", "into"))
        up = step.where("into is null").select("bin", "size", "task")
    for step in moves:
        result = result.join(step, "bin", "left").select("id", "piece", "tokens", F.coalesce("into", "bin").alias("bin"))
    return result.withColumnRenamed("bin", "container")


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, tokens, containers, the fewest containers the tokens could need, and the unused part."""
    bins = packed.groupBy("container").agg(F.sum("tokens").alias("fill"), F.count("*").alias("pieces"))
    total = bins.agg(F.sum("pieces").alias("pieces"), F.sum("fill").alias("tokens"), F.count("*").alias("containers"), F.max("fill").alias("fullest"))
    return total.select("pieces", "tokens", "containers", "fullest", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused"))
