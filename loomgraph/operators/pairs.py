"""Sums over pairs of nearby tokens, with no row for a pair before it is summed.

Words are dealt into groups by hash, and a pair belongs to the bucket of its two groups. A task
numbers the words of a piece of its rows, sums the pairs of the piece and sends each bucket the words
that it needs and the differences between sorted pairs, packed: two or three bytes a pair instead of two
words and a count. A bucket puts the numbers together and sums. There are as many buckets as keep one
to `BUCKET_PAIRS` pairs before they are summed, so no task grows with the input.
"""

from __future__ import annotations

import ctypes
import struct
from collections.abc import Iterator
from math import ceil, isqrt, lcm

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs that a task sorts at once, and pairs of one bucket before they are summed, about.
PIECE_PAIRS, BUCKET_PAIRS = 6_000_000, 6_000_000
#: Rows of one batch of results.
OUT_ROWS = 250_000
_ROWS = "bucket int, lefts binary, rights binary, freqs array<bigint>, shift int, n int, keys binary, sums binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("lefts", pa.binary()), ("rights", pa.binary()), ("freqs", pa.list_(pa.int64())), ("shift", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("sums", pa.binary())])


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Have Arrow batches hold at most about `size` bytes, not only so many rows. The session keeps this setting, since frames run after they are made."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Return what a task has freed to the system: workers are used again and would hold the most that any task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def distance_parts(window: int) -> tuple[int, dict[int, int]]:
    """(whole, parts): 1/k as parts of the least common multiple, so that sums are exact."""
    whole = lcm(*range(1, window + 1))
    return whole, {k: whole // k for k in range(1, window + 1)}


def _pack(x: np.ndarray) -> bytes:
    """Numbers from 0 as planes of bytes, the lowest first, compressed; the planes above the largest number are left out."""
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([width]) + pa.Codec("zstd", 1).compress(np.ascontiguousarray(planes[:width]), asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(pa.Codec("zstd").decompress(memoryview(data)[1:], data[0] * n), np.uint8)
    out[:, : data[0]] = planes.reshape(data[0], n).T
    return out.reshape(-1).view("<u8").astype(np.int64)


def _groups(names: pa.Array, groups: int) -> np.ndarray:
    return (pd.util.hash_array(names.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(groups)).astype(np.int64)


def _pack_words(words: pa.Array) -> bytes:
    """Words, fresh from a `take`, as their lengths and bytes, compressed."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    total = int(lengths.sum())
    if not len(words):
        return b""
    sizes = _pack(lengths)
    return struct.pack("<III", len(words), len(sizes), total) + sizes + (pa.Codec("zstd", 1).compress(words.buffers()[2].slice(0, total), asbytes=True) if total else b"")


def _unpack_words(data: bytes) -> pa.Array:
    if not data:
        return pa.array([], pa.string())
    n, width, total = struct.unpack_from("<III", data)
    ends = np.cumsum(_unpack(data[12 : 12 + width], n))
    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
    return pa.StringArray.from_buffers(n, offsets, pa.Codec("zstd").decompress(memoryview(data)[12 + width :], total) if total else pa.py_buffer(b""))


def _lists(values: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


class _Job:
    """What the tasks of one sum share."""

    def __init__(self, window: int, groups: int, parts: dict[int, int] | None, directed: bool, loops: bool, only: list[str] | None = None):
        self.window, self.groups, self.directed, self.loops = window, groups, directed, loops
        self.only = None if only is None else pa.array(only, pa.string())
        self.size = max(1, PIECE_PAIRS // window)  # tokens of a piece
        self.parts = None if parts is None else np.array([0, *(parts[k] for k in range(1, window + 1))], np.int64)
        self.low = 0 if parts is None else window.bit_length()

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(codes, names, left, gaps) of about as many tokens as make `PIECE_PAIRS`: a number for each token, the names, the tokens of its row from it on, and the gap where a row is a pair."""
        held, n = [], 0

        def coded() -> tuple:
            rows = pa.Table.from_batches(held)
            column = rows.column(0).combine_chunks()
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = column.flatten().dictionary_encode()
            left = np.repeat(np.cumsum(lengths), lengths) - np.arange(lengths.sum())
            gaps = np.repeat(rows.column(1).to_numpy().astype(np.int64), lengths)
            return words.indices.to_numpy(), words.dictionary, left, gaps

        for batch in batches:
            held.append(batch)
            n += len(batch.column(0).flatten())
            if n >= self.size:
                yield coded()
                held, n = [], 0
        if n:
            yield coded()

    def near(self, codes: np.ndarray, left: np.ndarray, gaps: np.ndarray, start: int, size: int) -> Iterator[tuple]:
        """(i, j, k): places of the pairs whose first token is one of the `size` from `start` on; k is a number or an array."""
        at = np.arange(start, min(start + size, len(codes)))
        for k in range(1, self.window + 1):
            i = at[left[at] > k]
            if not len(i):
                return
            if not self.loops:
                i = i[codes[i] != codes[i + k]]
            yield i, i + k, np.where(gaps[i] > 0, gaps[i], 1) if k == 1 else k

    def total(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sum over all pairs of the rows."""
        out = 0
        for codes, _, left, gaps in self.batches(batches):
            for start in range(0, len(codes), self.size):
                for i, _, k in self.near(codes, left, gaps, start, self.size):
                    out += len(i) if self.parts is None else int(self.parts[k].sum()) if isinstance(k, np.ndarray) else int(self.parts[k]) * len(i)
        yield pa.RecordBatch.from_pydict({"total": pa.array([out], pa.int64())})

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, names, left, gaps in self.batches(batches):
            group = _groups(names, self.groups)
            kept = None if self.only is None else pc.is_in(names, value_set=self.only).to_numpy(zero_copy_only=False)
            for start in range(0, len(codes), self.size):
                yield from self._piece(codes, names, left, gaps, group, start, self.size, kept)
        give_back()

    def _piece(self, codes, names, left, gaps, group, start, size, kept) -> Iterator[pa.RecordBatch]:
        used = np.bincount(codes[start : start + size + self.window], minlength=len(names))
        # frequent words come first in their group, so most pairs lie close together
        order = np.lexsort((-used, group))
        order = order[used[order] > 0]
        first = np.searchsorted(group[order], np.arange(self.groups + 1))
        shift = max(1, int(np.diff(first).max()).bit_length())
        index, place = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        index[order], place[order] = np.arange(len(order)) - first[group[order]], np.arange(len(order))
        as_left, as_right = (group * self.groups << 2 * shift) | (index << shift), (group << 2 * shift) + index
        found = []
        for i, j, k in self.near(codes, left, gaps, start, size):
            a, b = codes[i], codes[j]
            if kept is not None:
                both = kept[a] & kept[b]
                a, b, k = a[both], b[both], k[both] if isinstance(k, np.ndarray) else k
            if not self.directed:
                swap = place[a] > place[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
            key = as_left[a] + as_right[b]
            found.append(key if self.parts is None else key << self.low | k)
        if not found:
            return
        key = np.concatenate(found)
        del found
        key.sort()
        edge = np.flatnonzero(np.concatenate([[True], (key[1:] >> self.low) != (key[:-1] >> self.low)])) if len(key) else np.zeros(0, int)
        if not len(edge):
            return
        sums = np.diff(np.append(edge, len(key))) if self.parts is None else np.add.reduceat(self.parts[key & (1 << self.low) - 1], edge)
        key = key[edge] >> self.low
        bucket = key >> 2 * shift
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(key))
        rows, begin, mask = [], 0, (1 << shift) - 1
        for end in ends.tolist():
            g, h = divmod(int(bucket[begin]), self.groups)
            i, j = key[begin:end] >> shift & mask, key[begin:end] & mask
            i, lefts = self._held(i, first[g + 1] - first[g])
            j, rights = self._held(j, first[h + 1] - first[h])
            pair = i << shift | j
            pair[1:] -= pair[:-1].copy()
            rows.append((int(bucket[begin]), order[first[g] + lefts], order[first[h] + rights], shift, end - begin, _pack(pair), _pack(sums[begin:end])))
            begin = end
        for r in range(0, len(rows), 64):
            part = rows[r : r + 64]
            words = [pa.array([_pack_words(names.take(pa.array(x[c]))) for x in part], pa.binary()) for c in (1, 2)]
            columns = [pa.array([x[0] for x in part], pa.int32()), *words, pa.nulls(len(part), pa.list_(pa.int64())), *(pa.array([x[c] for x in part], t) for c, t in ((3, pa.int32()), (4, pa.int32()), (5, pa.binary()), (6, pa.binary())))]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)

    @staticmethod
    def _held(index: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers among the words that occur, those words)."""
        seen = np.zeros(n, bool)
        seen[index] = True
        return (np.cumsum(seen) - 1)[index], np.flatnonzero(seen)

    def vocabulary(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words (token, freq) for every bucket that their group has a part in."""
        for batch in batches:
            names, freqs = batch.column(0), batch.column(1)
            group = _groups(names, self.groups) if len(names) else np.zeros(0, np.int64)
            for g in np.unique(group).tolist():
                at = pa.array(np.flatnonzero(group == g))
                ways = {(min(g, h), max(g, h)) for h in range(self.groups)} | ({(g, h) for h in range(self.groups)} | {(h, g) for h in range(self.groups)} if self.directed else set())
                packed, counts = pa.array([_pack_words(names.take(at))], pa.binary()), freqs.take(at)
                for a, b in ways:
                    one = [pa.array([a * self.groups + b], pa.int32()), packed, pa.array([b""], pa.binary()), _lists(counts, [len(at)]), *(pa.array([x], t) for x, t in ((0, pa.int32()), (0, pa.int32()), (b"", pa.binary()), (b"", pa.binary())))]
                    yield pa.RecordBatch.from_arrays(one, schema=_ARROW)

    def settle(self, batches: Iterator[pa.RecordBatch], known: bool, best) -> Iterator[pa.RecordBatch]:
        """The sums of each bucket; rows come in the order of buckets."""
        held, now = [], None
        for batch in batches:
            buckets = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if buckets[a] != now and held:
                    yield from self._bucket(held, known, best)
                    held = []
                    give_back()
                now = buckets[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from self._bucket(held, known, best)
        give_back()

    def _bucket(self, held: list[pa.RecordBatch], known: bool, best) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=1 << 30)[0]
        held.clear()
        left, right = ([_unpack_words(x) for x in rows.column(c).to_pylist()] for c in (1, 2))
        at_left = np.cumsum([0, *map(len, left)])
        at_right = at_left[-1] + np.cumsum([0, *map(len, right)])
        words = pa.concat_arrays([*left, *right]).dictionary_encode()
        by_name = pc.sort_indices(words.dictionary).to_numpy()  # by bytes
        names = words.dictionary.take(pa.array(by_name))
        rank = np.empty(len(by_name), np.int64)
        rank[by_name] = np.arange(len(by_name))
        number = rank[words.indices.to_numpy()]
        freq = np.zeros(len(names), np.int64)
        sizes, shifts = rows.column(5).to_numpy(), rows.column(4).to_numpy()
        keys, sums, wide = [], [], max(1, len(names)).bit_length()
        for r in range(rows.num_rows):
            mine = number[at_left[r] : at_left[r + 1]]
            if not sizes[r]:
                freq[mine] = rows.column(3)[r].values.to_numpy()
                continue
            pair = np.cumsum(_unpack(rows.column(6)[r].as_py(), sizes[r]))
            a, b = mine[pair >> shifts[r]], number[at_right[r] : at_right[r + 1]][pair & (1 << int(shifts[r])) - 1]
            if not self.directed:
                a, b = np.minimum(a, b), np.maximum(a, b)
            keys.append(a << wide | b)
            sums.append(_unpack(rows.column(7)[r].as_py(), sizes[r]))
        del rows, words, left, right
        if not keys:
            return
        key, value = np.concatenate(keys), np.concatenate(sums)
        del keys, sums
        if known:  # words that the vocabulary lacks
            keep = (freq[key >> wide] > 0) & (freq[key & (1 << wide) - 1] > 0)
            key, value = key[keep], value[keep]
        if not len(key):
            return
        low = int(value.max()).bit_length()
        if 2 * wide + low <= 63:  # sorted as one number
            both = key << low | value
            both.sort()
            key, value = both >> low, both & (1 << low) - 1
            del both
        else:
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        value, key = np.add.reduceat(value, edge), key[edge]
        a, b = key >> wide, key & (1 << wide) - 1
        del key
        if best == PARTNERS:
            n = np.bincount(a, minlength=len(names)) + np.bincount(b[a != b], minlength=len(names))
            yield from self._named(names, np.flatnonzero(n), np.zeros(np.count_nonzero(n), int), n[n > 0], freq, False)
        elif best is None:
            yield from self._named(names, a, b, value, freq, known)
        else:
            score = best.score(value, freq[a], freq[b])
            keep = score > 0
            a, b, value, score = a[keep], b[keep], value[keep], score[keep]
            yield from self._named(names, *best.of(a, b, value, score, wide), freq, known)
            if not self.directed:
                a, b, value, score = (x[a != b] for x in (a, b, value, score))
                yield from self._named(names, *best.of(b, a, value, score, wide), freq, known)

    @staticmethod
    def _named(names, a, b, value, freq, known) -> Iterator[pa.RecordBatch]:
        for r in range(0, len(a), OUT_ROWS):
            s = slice(r, r + OUT_ROWS)
            columns = [names.take(pa.array(a[s])), names.take(pa.array(b[s])), pa.array(value[s])]
            if known:
                columns += [pa.array(freq[a[s]]), pa.array(freq[b[s]])]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n", "fa", "fb"][: len(columns)])


#: In place of a `Best`: of each bucket only how many partners a word has in it, itself included; a pair is in one bucket only.
PARTNERS = "partners"


class Best:
    """Leaves each word's `top_k` best pairs of a bucket in, by score at nine digits, then by the other word, and those whose ninth digit another engine may round otherwise: all that can be among the best of the whole."""

    def __init__(self, top_k: int, totals: tuple[float, float] | None = None, scale: float = 1.0):
        """`totals` (mass, words): scores are PPMI; else sums. `scale`: what a sum is divided by."""
        self.top_k, self.totals, self.scale = top_k, totals, scale

    def score(self, value: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> np.ndarray:
        if self.totals is None:
            return value / self.scale
        mass, words = self.totals
        return np.log(np.maximum(value / self.scale / mass, 1e-12) / (np.maximum(fa / words, 1e-12) * np.maximum(fb / words, 1e-12)))

    def of(self, src: np.ndarray, dst: np.ndarray, value: np.ndarray, score: np.ndarray, wide: int) -> tuple:
        exact = score * 1e9
        unsure = np.abs(exact % 1 - 0.5) < 1e-3 if exact.max(initial=0) < 1e14 else np.ones(len(exact), bool)
        some = np.flatnonzero(~unsure)
        some = some[np.lexsort((dst[some], -np.rint(exact[some]), src[some]))]
        place = np.arange(len(some)) - np.searchsorted(src[some], src[some])
        at = np.concatenate([some[place < self.top_k], np.flatnonzero(unsure)])
        return src[at], dst[at], value[at]


def _rows(arrays: DataFrame, edges: DataFrame | None) -> DataFrame:
    rows = arrays.select("tokens", F.lit(0).alias("gap"))
    return rows if edges is None else rows.unionByName(edges.select(F.array("a", "b").alias("tokens"), F.col("k").alias("gap")))


def pair_total(arrays: DataFrame, window: int, parts: dict[int, int] | None = None, loops: bool = True, edges: DataFrame | None = None) -> int:
    """The sum over all pairs of tokens at most `window` places apart, each counted once, or as its `parts`."""
    small_batches(arrays.sparkSession)
    job = _Job(window, 1, parts, False, loops)
    return _rows(arrays, edges).mapInArrow(job.total, "total bigint").agg(F.sum("total")).first()[0] or 0


def partners(arrays: DataFrame, window: int, words: DataFrame | None = None) -> DataFrame:
    """(node, n): with how many words, of `words` if given, itself included, a word occurs at most `window` places apart. Counted where pairs are summed, so no pair leaves its bucket."""
    return pair_sums(arrays, window, words=words, best=PARTNERS).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))


def pair_sums(
    arrays: DataFrame, window: int, parts: dict[int, int] | None = None, directed: bool = False, loops: bool = True, words: DataFrame | None = None, edges: DataFrame | None = None, best: Best | str | None = None, only: list[str] | None = None,
) -> DataFrame:
    """(a, b, n): for each pair of tokens at most `window` places apart how often it occurs, or the sum of its `parts` by distance; a <= b, or in the order of the text if `directed`.

    `words` (token, freq) leaves other words' pairs out and adds fa and fb. `edges` (a, b, k) are
    pairs besides those within rows. With `best` only the rows that may be among a word's best
    come, each pair from both ends unless `directed`. `only`: a short list of words; pairs of others
    are not sent.
    """
    spark = arrays.sparkSession
    small_batches(spark)
    tokens = (arrays.agg(F.sum(F.size("tokens").cast("long"))).first()[0] or 0) if only is None else 0  # few words have few pairs, summed in each piece
    buckets = ceil(tokens * window / BUCKET_PAIRS)
    groups = max(1, isqrt(max(0, (buckets if directed else 2 * buckets) - 1)) + 1) if buckets > 1 else 1
    job = _Job(window, groups, parts, directed, loops, only)
    sent = _rows(arrays, edges).mapInArrow(job.pieces, _ROWS)
    if words is not None:
        sent = sent.unionByName(words.select("token", F.col("freq").cast("long").alias("freq")).mapInArrow(job.vocabulary, _ROWS))
    known = words is not None
    schema = "a string, b string, n bigint" + (", fa bigint, fb bigint" if known and best != PARTNERS else "")
    # a bucket to a partition: each is a full task's work
    dealt = sent.repartition(groups * groups, "bucket") if groups > 1 else sent.repartition(1)
    return dealt.sortWithinPartitions("bucket").mapInArrow(lambda batches: job.settle(batches, known, best), schema)
