"""Evaluation texts leaking into training text (problem 9): suffix arrays over training shards.

Every Arrow batch of the training table is a shard. Its words, in the consistent form, become
numbers through the vocabulary of the test items; words no item has cannot lie in a match, so
only runs of known words of the least length enter the shard's suffix array. Each suffix of each
test item is binary-searched in it (all suffixes at once); the range that shares the first words
gives every location, and the longest common prefix there the length of the match. The training
side is one map-only pass; only the matches are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.textform import word_keys

#: Test items that are searched at once; a larger test set is split into blocks of about this many.
BLOCK_ITEMS = 20_000


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``seq`` (non-negative numbers) in the order of their first ``depth`` elements."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth:
        tail = np.zeros(n, np.int64)
        tail[: max(n - k, 0)] = rank[k:]
        key = rank * (n + 2) + tail
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.concatenate(([1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)))) if n else []
        rank, k = fresh, 2 * k
        if n and rank.max() == n:
            break
    return order


def _bound(padded: np.ndarray, order: np.ndarray, query: np.ndarray, right: bool) -> np.ndarray:
    """Insertion points of the rows of ``query`` in the suffix array, by binary search over its whole width."""
    width = query.shape[1]
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(order), np.int64)
    span = np.arange(width)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        there = padded[order[mid][:, None] + span]
        differs = there != query[open_]
        first = differs.argmax(1)
        any_ = differs[np.arange(len(open_)), first]
        less = np.where(any_, there[np.arange(len(open_)), first] < query[open_][np.arange(len(open_)), first], right)
        lo[open_[less]] = mid[less] + 1
        hi[open_[~less]] = mid[~less]
    return lo


class TestSet:
    """The numbered words of the items of one block, and the windows every search starts from."""

    __test__ = False

    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.vocabulary: dict[bytes | str, int] = {}
        self.least = least
        seqs, owners, starts, items = [], [], [], []
        at = 0
        for key, text in rows:
            seq = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in word_keys(text)]
            if len(seq) < least:
                continue
            items.append(key)
            for s in range(len(seq) - least + 1):
                owners.append(len(items) - 1)
                starts.append(at + s)
            seqs += [*seq, 0]
            at += len(seq) + 1
        for w in [w for w in self.vocabulary if isinstance(w, bytes)]:  # a text outside Latin-1 may hold it too
            self.vocabulary.setdefault(w.decode("latin-1"), self.vocabulary[w])
        self.items = items
        self.seq = np.array([*seqs, *[0] * (least + 1)], np.int64)
        self.owner, self.start = np.array(owners, np.int64), np.array(starts, np.int64)

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text index, item index, first word, words) of the longest match of each item in each text."""
        get = self.vocabulary.get
        numbers: list[int] = []
        bounds = [0]
        for text in texts:
            numbers += [get(w, 0) for w in word_keys(text)]
            numbers.append(0)
            bounds.append(len(numbers))
        line = np.array(numbers, np.int64)
        if not len(self.start) or not len(line):
            return []
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (line > 0).astype(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2]
        keep = end - begin >= self.least
        begin, end = begin[keep], end[keep]
        if not begin.size:
            return []
        place = np.concatenate([np.arange(a, b + 1) for a, b in zip(begin, end)])  # each run with a closing 0
        shard = line[place]
        depth = self.least
        order = suffix_array(shard, depth)
        padded = np.concatenate((shard, np.zeros(depth + 1, np.int64)))
        query = self.seq[self.start[:, None] + np.arange(depth)]
        lo, hi = _bound(padded, order, query, False), _bound(padded, order, query, True)
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        if not which.size:
            return []
        offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        hit = order[lo[which] + offset]
        length = np.full(len(which), depth)
        a, b, alive = hit + depth, self.start[which] + depth, np.arange(len(which))
        long = np.concatenate((padded, np.zeros(1, np.int64)))
        while alive.size:  # the rest of each match, one word at a time for all that still agree
            x, y = long[np.minimum(a[alive], len(long) - 1)], self.seq[np.minimum(b[alive], len(self.seq) - 1)]
            alive = alive[(x == y) & (x > 0)]
            length[alive] += 1
            a[alive] += 1
            b[alive] += 1
        text = np.searchsorted(np.array(bounds), place[hit], side="right") - 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for t, i, p, n in zip(text.tolist(), self.owner[which].tolist(), place[hit].tolist(), length.tolist()):
            found = (n, bounds[t] - p)
            if found > best.get((t, i), (0, 0)):
                best[t, i] = found
        return [(t, i, -back, n) for (t, i), (n, back) in best.items()]


def _searcher(tests: TestSet):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(keys[t], tests.items[i], p, n) for t, i, p, n in tests.search(texts)]
            cols = list(zip(*rows)) or [()] * 4
            types = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "item_id", "first_word", "n_words"])

    return run


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = 10) -> DataFrame:
    """(id, item_id, first_word, n_words): the longest stretch of each item in each document, of ``least`` words or more.

    Words are compared in the consistent form, with nothing but other characters between them.
    Items with fewer words, null or empty ones match nothing; null and empty documents hold
    nothing; repeated rows count once; ties go to the earliest place. The items are sent to the
    executors in blocks of bounded size, so a test set of any size works, a block at a time.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and length(text) > 0")
    items = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and length(text) > 0").distinct()
    kind = docs.schema["id"].dataType.simpleString()
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    found = None
    for block in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()]
        part = docs.mapInArrow(_searcher(TestSet(rows, least)), f"id {kind}, item_id bigint, first_word int, n_words int")
        found = part if found is None else found.unionByName(part)
    best = F.max_by(F.struct("first_word", "n_words"), F.struct("n_words", -F.col("first_word"))).alias("m")
    return found.groupBy("id", "item_id").agg(best).select("id", "item_id", "m.first_word", "m.n_words")


def without_leaks(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents that hold no test item; rows with a null id stay."""
    hit = found.select(F.col("id").alias("_hit")).distinct()
    return docs.join(hit, F.col(key) == F.col("_hit"), "left_anti")
