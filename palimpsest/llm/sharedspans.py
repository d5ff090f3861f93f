"""Long exact spans shared between records (problem 4): FM-indexes over shards of shared passages.

A stretch of ``LEAST`` characters that two records share has the same smallest 120-character gram
in both (winnowing: the grams of each window that hash lowest are its anchors). So

1. one pass over the texts gives their anchors; anchors of a single record drop out. The smallest
   and the largest record with an anchor name its *group*: every record with the anchor gives it
   the same one, and neighbouring anchors of a passage mostly have the same group;
2. a second pass over the texts that hold an anchor left cuts out their regions: the 360 characters
   around each anchor, in which every window of ``LEAST`` that contains the anchor lies, united
   where regions of one group overlap. Equal regions of a group become one row, with the smallest
   and largest record that hold it;
3. regions are spread by group over shards of bounded size. Each shard gets an FM-index: suffix
   array, Burrows-Wheeler transform in a wavelet matrix of packed bits, prefix counts. All regions
   are streamed through it together: backward search extends every match to the left, and where
   no other record's text would remain in the interval, the match is cut at its right end to the
   parent interval. The matching statistics of ``LEAST`` and above are the shared intervals;
4. intervals are laid back on the records and merged.

A group of more than ``HOT_CHARS`` characters (a passage in a large part of all records) is not
given to one shard: for its regions the windows themselves are counted, with partial aggregation,
which gives the same intervals. Nothing is dropped.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.tables import materialize, release, small_or_merged

LEAST = 240  # characters of a shared stretch
GRAM = 120  # characters of an anchor; windows of LEAST hold LEAST - GRAM + 1 of them
SHARD_CHARS = 1_000_000  # characters of a shard, to which one group may add its own
HOT_CHARS = 1_000_000  # characters of a group in a shard
STREAM = 3 * LEAST  # characters of a region that are searched in one go
PASS_CHARS = 1_000_000  # characters hashed at once
BROADCAST_ROWS = 100_000  # rows of at most 24 bytes that may be broadcast: 2.4 MB

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Hashes of all grams of a text; powers are kept for the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grams(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(0x51ED27)) * self.up[:n], out=total[1:])
        h = (total[GRAM:] - total[: n - GRAM + 1]) * self.down[: n - GRAM + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _sliding(x: np.ndarray, width: int, ufunc) -> np.ndarray:
    """ufunc over each window of ``width``: prefix and suffix accumulations of blocks."""
    n = len(x)
    fill = x.dtype.type(0) if ufunc is np.maximum else np.iinfo(x.dtype).max
    padded = np.full(-(-n // width) * width, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = ufunc.accumulate(blocks, axis=1).ravel()
    behind = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(codes: np.ndarray, hasher: _Hasher, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of a text, or of texts laid end to end.

    ``owner``: the text of each character. Windows across two texts may add anchors that are
    none; grams across two texts are left out.
    """
    width = LEAST - GRAM + 1
    if len(codes) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hasher.grams(codes)
    if owner is not None:
        h[owner[: len(h)] != owner[GRAM - 1 :]] = np.iinfo(np.uint64).max
    low = _sliding(h, width, np.minimum)
    padded = np.zeros(len(low) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(low)] = low
    chosen = np.flatnonzero((_sliding(padded, width, np.maximum) == h) & (h != np.iinfo(np.uint64).max))
    return chosen, h[chosen]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _anchor_pass(batches):
    import pyarrow as pa

    hasher = _Hasher()
    schema = pa.schema([("gram", pa.int64()), ("id", pa.int64()), ("pos", pa.int32())])
    for batch in batches:
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        at = 0
        while at < len(rows):
            part, size = [], 0
            while at < len(rows) and (not part or size + len(rows[at][1]) <= PASS_CHARS):
                part.append(rows[at])
                size += len(rows[at][1])
                at += 1
            lengths = np.array([len(t) for _, t in part])
            begin = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(part), dtype=np.int32), lengths)
            pos, gram = anchors(_codes("".join(t for _, t in part)), hasher, owner)
            who = owner[pos]
            ids = np.array([i for i, _ in part], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(ids[who]), pa.array((pos - begin[who]).astype(np.int32))], schema=schema)


def regions(found: list[tuple[int, int]], length: int) -> list[tuple[int, int, int]]:
    """(group, start, end) of the regions of a text with the anchors (group, position)."""
    side, out = LEAST - GRAM, []
    for group, pos in sorted(found):
        lo, hi = max(0, pos - side), min(length, pos + LEAST)
        if out and out[-1][0] == group and lo <= out[-1][2]:
            out[-1] = (group, out[-1][1], hi)
        else:
            out.append((group, lo, hi))
    return out


def _region_pass(batches):
    """(grp, ctx, id, start, text): the regions of each record, a hash of the text among them."""
    import pyarrow as pa

    schema = pa.schema([("grp", pa.int64()), ("ctx", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("text", pa.string())])
    for batch in batches:
        rows, size = [], 0
        for i, text, found in zip(*(c.to_pylist() for c in batch.columns)):
            for group, lo, hi in regions([(a["grp"], a["pos"]) for a in found], len(text)):
                piece = text[lo:hi]
                rows.append((group, xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass")) - (1 << 63), i, lo, piece))
                size += len(piece)
            if size > 16 * PASS_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)  # the bits below each place of a word


class Bits:
    """Packed bits with rank: ones before a position from a count per word and a popcount."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        return self.before.take(word) + np.bitwise_count(self.words.take(word) & _BELOW.take(at & 63))


class FMIndex:
    """FM-index of texts laid end to end, each closed by 0; symbols are dense numbers from 1.

    Suffixes are sorted by the first ``STREAM`` symbols or more, which is as long as a match gets.
    """

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        self.n, self.sigma = n, int(seq.max()) + 1
        bits = max(1, int(self.sigma - 1).bit_length())
        first = max(1, 62 // bits)
        key = np.zeros(n, np.int64)
        for k in range(first):
            key <<= bits
            key[: max(0, n - k)] |= seq[k:]
        span, levels = first, []
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.zeros(n + 1, np.int32)
            fresh = np.ones(n, np.int32)
            np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:], casting="unsafe")
            rank[order] = np.cumsum(fresh, dtype=np.int32)
            levels.append((span, rank))
            if rank.max() == n or span >= STREAM:
                break
            # three ranks in a key where they fit 63 bits, else two: the sorted length triples or doubles
            parts, width = (3, 21) if n < 1 << 21 else (2, 31)
            key = rank[:n].astype(np.int64)
            for k in range(1, parts):
                key <<= width
                key[: max(0, n - k * span)] |= rank[k * span : n]
            span *= parts
        self.sa = order
        near = order.astype(np.int32)
        lcp, i, j = np.zeros(n, np.int32), near[:-1].copy(), near[1:].copy()  # i, j: where what is common so far ends
        for span, rank in reversed(levels):
            for _ in range(2):  # a level may match as often as the next one has parts, less one
                same = rank.take(i) == rank.take(j)
                same &= (i < n) & (j < n)
                step = same * np.int32(span)
                lcp[1:] += step
                i += step
                j += step
                np.minimum(i, n, out=i)
                np.minimum(j, n, out=j)
        ended = np.append(seq, [-1]).astype(np.int32)
        todo = np.arange(n - 1)
        for _ in range(first):  # what is left is shorter than the first span
            x = ended.take(np.minimum(i[todo], n))
            todo = todo[(x == ended.take(np.minimum(j[todo], n))) & (x >= 0)]
            if not todo.size:
                break
            lcp[todo + 1] += 1
            i[todo] += 1
            j[todo] += 1
        self.lcp = np.append(lcp, np.int32(-1))
        self.lcp[0] = -1
        self.left, self.right = _smaller(self.lcp)
        bwt = seq[order - 1]
        self.counts = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=self.sigma))))
        self.levels = []
        for b in range(bits - 1, -1, -1):  # wavelet matrix: at each level zeros go before ones
            bit = (bwt >> b & 1).astype(np.uint8)
            self.levels.append((b, Bits(bit), n - int(bit.sum())))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))
        every = np.arange(self.sigma)
        self.base = self.counts[:-1] - self._down(every, np.zeros(self.sigma, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places in the lowest level of the wavelet matrix that belong to places in the transform."""
        for b, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol & (1 << b), ones + zeros, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + match, from the intervals of the matches."""
        m = len(lo)
        at = self._down(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        base = self.base[symbol]
        return base + at[:m], base + at[m:]

    def parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest larger LCP interval, and the length of what its suffixes share."""
        at = np.where(self.lcp[lo] >= self.lcp[hi], lo, hi)
        return self.left[at], self.right[at], np.maximum(self.lcp[at], 0)


def _smaller(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest place with a smaller value to the left and to the right, by jumping over pointers."""
    n = len(x)
    out = []
    for step, end in ((-1, 0), (1, n - 1)):
        near = np.clip(np.arange(n, dtype=np.int32) + np.int32(step), 0, n - 1)
        todo = np.flatnonzero((x[near] >= x) & (near != end))
        while todo.size:
            near[todo] = near[near[todo]]
            todo = todo[(x[near[todo]] >= x[todo]) & (near[todo] != end)]
        out.append(near)
    return out[0], out[1]


def _reach(owner: np.ndarray, several: np.ndarray) -> np.ndarray:
    """For each place of the suffix array the end from which an interval that begins there has texts of two owners."""
    n = len(owner)
    far = np.iinfo(np.int32).max
    ends = np.arange(1, n + 1, dtype=np.int32)
    changed = np.full(n + 1, far, np.int32)
    changed[1:n][owner[1:] != owner[:-1]] = ends[1:][owner[1:] != owner[:-1]]
    changed = np.minimum.accumulate(changed[::-1])[::-1]  # of a change at this place or behind it
    many = np.minimum.accumulate(np.where(several, ends, far)[::-1])[::-1]
    return np.append(np.minimum(changed[1:], many), np.int32(far))


def shared_windows(texts: list[str], owners: list[int], several: list[bool]) -> list[list[tuple[int, int]]]:
    """Of each text the intervals made of windows of ``LEAST`` that also lie in a text of another owner.

    ``several``: the text itself is known to belong to more owners, so it is its own partner.
    Every text is streamed through the index, in stretches of ``STREAM`` characters that overlap
    by a window less one; all stretches advance together, each by its own next step.
    """
    lengths = np.array([len(t) for t in texts])
    codes = _codes("".join(texts))
    present = np.zeros(int(codes.max()) + 1, np.int32)
    present[codes] = 1
    seq = np.cumsum(present, dtype=np.int32).take(codes)  # dense numbers from 1
    begin = np.cumsum(lengths + 1) - lengths - 1
    line = np.zeros(len(codes) + len(texts), np.int32)
    line[np.arange(len(seq)) + np.repeat(np.arange(len(texts)), lengths)] = seq
    index = FMIndex(line)
    who = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + 1)[index.sa]
    reach = _reach(np.unique(np.array(owners), return_inverse=True)[1].astype(np.int32)[who], np.array(several)[who])
    cut = STREAM - LEAST + 1
    counts = np.where(lengths >= LEAST, -(-np.maximum(lengths - LEAST + 1, 1) // cut), 0)
    text = np.repeat(np.arange(len(texts)), counts)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * cut
    stop = begin[text] + first
    pos = begin[text] + np.minimum(first + STREAM, lengths[text])
    lo, hi, size = np.zeros(len(text), np.int64), np.full(len(text), index.n, np.int64), np.zeros(len(text), np.int64)
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while text.size:
        new_lo, new_hi = index.extend(line.take(pos - 1), lo, hi)
        good = new_hi >= reach.take(new_lo)
        bad = np.flatnonzero(~good)
        lo, hi = np.where(good, new_lo, lo), np.where(good, new_hi, hi)
        size += good
        pos -= good | (size == 0)
        ended = pos == stop
        long = np.flatnonzero((size >= LEAST) & (ended | ~good))
        if long.size:
            hits.append((text[long], pos[long] - begin[text[long]], size[long]))
        if bad.size:
            bad = bad[size[bad] > 0]
            lo[bad], hi[bad], size[bad] = index.parent(lo[bad], hi[bad])
        alive = pos - stop + size >= LEAST  # else no window can be completed
        alive &= ~ended
        if not alive.all():
            text, pos, stop, lo, hi, size = (x[alive] for x in (text, pos, stop, lo, hi, size))
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if hits:
        for t, s, n in sorted(zip(*(np.concatenate(x).tolist() for x in zip(*hits)))):
            spans = out[t]
            if spans and s <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], s + n))
            else:
                spans.append((s, s + n))
    return out


def _shard_pass(batches):
    """Rows in the order of the group; yields (grp, ctx, a, b) for the shared intervals of each region."""
    import pyarrow as pa

    schema = pa.schema([("grp", pa.int64()), ("ctx", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])
    held: list[tuple] = []
    size = 0

    def flush():
        spans = shared_windows([r[2] for r in held], [r[3] for r in held], [r[3] != r[4] for r in held])
        rows = [(group, ctx, a, b) for (group, ctx, *_), found in zip(held, spans) for a, b in found]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 4, schema)], schema=schema)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size > SHARD_CHARS and row[0] != held[-1][0]:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[2]) + 1
    if held:
        yield flush()


def _window_pass(batches):
    """(h, grp, ctx, at, low, high) of every window of a region, for groups too large for a shard."""
    import pyarrow as pa

    schema = pa.schema([("h", pa.binary()), ("grp", pa.int64()), ("ctx", pa.int64()), ("at", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
    for batch in batches:
        for group, ctx, text, low, high in zip(*(c.to_pylist() for c in batch.columns)):
            raw = text.encode("utf-32-le", "surrogatepass")
            for k in range(0, len(text) - LEAST + 1, 50_000):
                at = range(k, min(k + 50_000, len(text) - LEAST + 1))
                hashes = [xxhash.xxh3_128_digest(raw[4 * s : 4 * (s + LEAST)]) for s in at]
                same = [pa.array([x], pa.int64()).take(pa.array([0] * len(at))) for x in (group, ctx, low, high)]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), *same[:2], pa.array(at, pa.int32()), *same[2:]], schema=schema)


def merged(spans: DataFrame) -> DataFrame:
    """(id, start_char, end_char): overlapping and touching spans (id, s, e) of a record as one."""
    order = Window.partitionBy("id").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("opens", F.coalesce((F.col("s") > before).cast("int"), F.lit(1)))
    numbered = opened.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "run").agg(F.min("s").alias("start_char"), F.max("e").alias("end_char")).drop("run")


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start_char, end_char): the maximal runs of characters that lie in a shared stretch.

    A stretch is ``LEAST`` code points of the stored text that occur in the stored text of a record
    with another id. Null texts, null ids and texts below ``LEAST`` give no rows; a record that is
    delivered twice is not another record; touching stretches make one run; other columns are
    never read; empty input gives no rows. Ids are integers.
    """
    docs = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).where(f"id is not null and length(text) >= {LEAST}")
    found = materialize(docs.mapInArrow(_anchor_pass, "gram bigint, id bigint, pos int"), "anchors")
    shared = materialize(found.groupBy("gram").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("gram", F.xxhash64("low", "high").alias("grp")), "shared")
    kept = found.join(small_or_merged(shared, BROADCAST_ROWS), "gram")
    places = materialize(kept.groupBy("id").agg(F.collect_set(F.struct("grp", "pos")).alias("found")), "places")
    sized = places.agg(F.sum(F.size("found") + 1)).first()[0] or 0
    texts = docs.join(small_or_merged(places, BROADCAST_ROWS, sized), "id").select("id", "text", "found")
    parts = materialize(texts.mapInArrow(_region_pass, "grp bigint, ctx bigint, id bigint, start int, text string"), "regions")
    distinct = parts.groupBy("grp", "ctx").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("text").alias("text"))
    distinct = materialize(distinct.select("grp", "ctx", "text", "low", "high"), "distinct")
    hot = materialize(distinct.groupBy("grp").agg(F.sum(F.length("text")).alias("chars")).where(F.col("chars") > HOT_CHARS).select("grp"), "hot")
    n_hot = hot.count()
    calm = distinct.join(small_or_merged(hot, BROADCAST_ROWS, n_hot), "grp", "left_anti") if n_hot else distinct
    chars = calm.agg(F.sum(F.length("text"))).first()[0] or 0
    intervals = calm.repartition(-(-chars // (2 * SHARD_CHARS)) or 1, "grp").sortWithinPartitions("grp").mapInArrow(_shard_pass, "grp bigint, ctx bigint, a int, b int")
    if n_hot:
        windows = distinct.join(small_or_merged(hot, BROADCAST_ROWS, n_hot), "grp", "left_semi").mapInArrow(_window_pass, "h binary, grp bigint, ctx bigint, at int, low bigint, high bigint")
        windows = materialize(windows, "windows")
        several = windows.groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("h")
        intervals = intervals.unionByName(windows.join(several, "h", "left_semi").select("grp", "ctx", F.col("at").alias("a"), (F.col("at") + LEAST).alias("b")))
    occurrences = parts.select("grp", "ctx", "id", "start")
    intervals = materialize(intervals, "intervals")
    release(found, shared, places, distinct)
    spans = intervals.join(occurrences, ["grp", "ctx"]).select("id", (F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("b")).alias("e"))
    return merged(spans)


def shared_amounts(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every record with its characters, how many of them are shared elsewhere, and in how many runs; null texts have 0 characters."""
    amount = spans.groupBy("id").agg(F.sum(F.col("end_char") - F.col("start_char")).alias("shared"), F.count("*").alias("runs"))
    sizes = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("chars"))
    return sizes.join(amount, "id", "left").select("id", "chars", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("runs", F.lit(0)).alias("runs"))
