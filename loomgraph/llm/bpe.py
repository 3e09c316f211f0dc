"""Byte-level BPE encoding and decoding by a corpus-level merge replay.

Texts are cut into pieces (matches of the pattern). Texts make blocks of bounded size; of each
block only its distinct pieces travel, dealt by a hash to segments. In a segment every piece of
the whole corpus that falls there is there once, however many blocks hold it. A segment's
pieces, side by side as one sequence of byte symbols, are replayed: an inverted index maps
every mergeable token pair to its positions, merges are applied in rank order, and each
touches only its two neighbours, whose pairs leave the index or enter it. A pair that a merge
brings up with a lower rank goes to the front, so each piece ends as if it had been encoded
alone, lowest rank and then leftmost first. The ids go back to the blocks that asked.

A piece that is itself a token has that one id by definition and is not replayed. Pieces of a
block are told apart by 128 bits of two random multilinear hashes; segments compare their bytes.

Defined results: whole texts are processed; null text is empty and has no tokens; an empty
table gives an empty table; repeated rows give one row each; only the named columns are read,
so others of any name do no harm. The input is read twice and must give equal partitions each
time (a table does; cut a random one first): a block that no longer finds its ids fails the
job. Memory per task grows with one block, one segment, or the longest single text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..layout import spread
from .common import give_back, id_and_text, small_batches

BLOCK_BYTES = 10 << 20
#: Bytes of text for each segment of pieces.
SEGMENT_BYTES = 4 << 20
LEAST_SEGMENTS = 32
#: Bytes of text that are cut at once.
CUT_BYTES = 1 << 20
#: Pieces in one row of a block, and put together at once: rows stay below half a MB, or the longest text.
PIECES_AT_ONCE = 100_000
LOST = "a block did not find its ids: the input gave other partitions when it was read again"

# Fixed value: the pattern of byte-level BPE that is cut by array operations; any other goes through the regex library.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Merges:
    """The merges that ranks stand for: `pair` maps two token ids, as left * SHIFT + right, to the id of their join."""

    SHIFT = 1 << 20

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair = {
            ranks[token[:k]] * self.SHIFT + ranks[token[k:]]: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }
        self.of_bytes = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.of_bytes[token[0] << 8 | token[1]] = rank


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(how many ids each piece has, the ids of all), by replaying all merges over the pieces together."""
    joined = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    n = len(joined)
    bounds = np.r_[0, np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))]
    token = merges.byte[joined].tolist()  # -1 once a symbol has gone into the one before
    last = np.unique(bounds[1:]) - 1
    last = last[last >= 0]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[last] = -1
    before[last[:-1] + 1] = -1
    after, before = after.tolist(), before.tolist()
    rank_at = np.full(n, -1, np.int64)  # of the pair that starts at a symbol
    if n > 1:
        rank_at[:-1] = merges.of_bytes[joined[:-1] << 8 | joined[1:]]
        rank_at[last] = -1
    # the index: rank of a pair to the positions where it starts, some out of date
    at = np.flatnonzero(rank_at >= 0)
    at = at[np.argsort(rank_at[at], kind="stable")]
    cuts = np.flatnonzero(np.diff(rank_at[at])) + 1
    index = {int(rank_at[x[0]]): x.tolist() for x in np.split(at, cuts) if len(x)}
    rank_at, pair_of, shift = rank_at.tolist(), merges.pair.get, merges.SHIFT
    queue = list(index)
    heapq.heapify(queue)
    while queue:
        rank = heapq.heappop(queue)
        positions = index.pop(rank, None)
        if positions is None:
            continue
        positions.sort()
        for done, i in enumerate(positions):
            if rank_at[i] != rank:
                continue
            j = after[i]
            token[i], token[j], rank_at[j] = rank, -1, -1
            k = after[i] = after[j]
            lowest = rank
            new = -1
            if k >= 0:
                before[k] = i
                new = pair_of(rank * shift + token[k], -1)
                if new >= 0:
                    if new in index:
                        index[new].append(i)
                    else:
                        index[new] = [i]
                        heapq.heappush(queue, new)
                    if new < lowest:
                        lowest = new
            rank_at[i] = new
            h = before[i]
            if h >= 0:
                new = rank_at[h] = pair_of(token[h] * shift + rank, -1)
                if new >= 0:
                    if new in index:
                        index[new].append(h)
                    else:
                        index[new] = [h]
                        heapq.heappush(queue, new)
                    if new < lowest:
                        lowest = new
            if lowest < rank:  # the new pair comes first; the rest of this list follows in its turn
                if rank not in index:
                    heapq.heappush(queue, rank)
                index.setdefault(rank, []).extend(positions[done + 1 :])
                break
    left = np.array(token, np.int32)
    here = left >= 0
    return np.diff(np.r_[0, np.cumsum(here)][bounds]), left[here]


# cutting texts into pieces

LETTER, NUMBER, BLANK, SPACE = 1, 2, 3, 4


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of every code point, as the regex library sees it: letter, number, white space, the space itself, or 0."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    for first, last in ((0, 0xD7FF), (0xE000, 0x10FFFF)):
        points = "".join(map(chr, range(first, last + 1)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
            for m in regex.finditer(pattern, points):
                out[first + m.start() : first + m.end()] = kind
    out[ord(" ")] = SPACE
    return out


def _byte_level_starts(points: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where pieces of `BYTE_LEVEL_PATTERN` start, as marks; `edge` marks the starts of texts and the end of the last (one place more than `points`)."""
    n = len(points)
    kind = _kinds()[points]
    run = np.minimum(kind, BLANK)
    new = edge.copy()
    new[1:n] |= run[1:] != run[:-1]
    # the last blank before anything else is a piece alone, or, as a space, the head of what follows
    after = np.flatnonzero(new[1:n] & (run[:-1] == BLANK) & ~edge[1:n]) + 1
    new[after - 1] = True
    new[after[kind[after - 1] == SPACE]] = False
    # an apostrophe that starts a piece takes the letters of a contraction with it
    mark = np.flatnonzero(points == ord("'"))
    mark = mark[new[mark]]
    if len(mark):
        at = lambda k: np.where(mark + k < n, points[np.minimum(mark + k, n - 1)], 0)
        inside = lambda k: (mark + k < n) & ~edge[np.minimum(mark + k, n)]
        one, two = at(1), at(2)
        single = inside(1) & np.isin(one, [ord(c) for c in "stmd"])
        double = inside(1) & inside(2) & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        taken = np.where(single, 1, np.where(double, 2, 0))
        head, taken = mark[taken > 0], taken[taken > 0]
        new[head + 1] = False
        rest = head + 1 + taken
        new[rest] = True
    return new


def cut_pieces(texts: list[bytes], pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all pieces, length of each piece in bytes, pieces of each text)."""
    strings = [t.decode("utf-8", "replace") for t in texts]
    if pattern != BYTE_LEVEL_PATTERN:
        import regex

        found = [[m.encode() for m in (x.group() for x in regex.finditer(pattern, s)) if m] for s in strings]
        flat = [p for pieces in found for p in pieces]
        return np.frombuffer(b"".join(flat), np.uint8), np.fromiter(map(len, flat), np.int64, len(flat)), np.fromiter(map(len, found), np.int64, len(found))
    joined = "".join(strings)
    data = np.frombuffer(joined.encode(), np.uint8)
    bounds = np.r_[0, np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))]
    n = int(bounds[-1])
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    points = data if n == len(data) else np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(_byte_level_starts(points, edge)[:n])
    counts = np.diff(np.searchsorted(starts, bounds))
    if n != len(data):
        width = np.ones(n, np.int64)
        for limit in (0x80, 0x800, 0x10000):
            width += points >= limit
        starts = (np.cumsum(width) - width)[starts]
    return data, np.diff(np.r_[starts, len(data)]), counts


# telling pieces apart


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _factors(n: int, seed: int) -> np.ndarray:
    """Random odd factors of the places in a piece, by a rule."""
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def piece_hashes(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each piece."""
    if not len(lengths):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(data), dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    place -= np.repeat(starts, lengths).astype(place.dtype)
    value = data.astype(np.uint64) + np.uint64(1)
    most = int(lengths.max())
    one, two = (np.add.reduceat(_factors(most, seed)[place] * value, starts) for seed in (1, 2))
    return _mix(one + lengths.astype(np.uint64)), _mix(two ^ lengths.astype(np.uint64))


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct pair of hashes, in ascending order of hashes; the number of each place's pair)."""
    order = np.argsort(one, kind="stable")
    h = one[order]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    if (~new[1:] & (two[order][1:] != two[order][:-1])).any():
        order = np.lexsort((two, one))
        new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs values[start : start + length], one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _planes(x: np.ndarray) -> bytes:
    """int32 as four planes of bytes, which compress well."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    return load_ranks(path)


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(_ranks(path))


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all tokens, start and length of each by rank)."""
    ranks = _ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    lengths = np.fromiter(map(len, out), np.int64, len(out))
    lengths[[r for r, t in enumerate(out) if t == b"" and b"" not in ranks]] = -1
    return np.frombuffer(b"".join(out), np.uint8), np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0), lengths


class Block:
    """Texts that were cut together: their pieces as numbers by descending frequency."""

    def __init__(self, parts: list[list[np.ndarray]], path: str, segments: int):
        """`parts`: lists of bytes, lengths, counts of texts and both hashes; emptied."""
        whole = []
        for part in parts:  # one after another, so that few are held twice
            whole.append(np.concatenate(part))
            part.clear()
        data, lengths, self.counts, one, two = whole
        del whole
        at, number = distinct(one, two)
        one, two = one[at], two[at]
        ends = np.cumsum(lengths)[at]
        blob = memoryview(data)
        self.pieces = [bytes(blob[a:b]) for a, b in zip((ends - lengths[at]).tolist(), ends.tolist())]
        ranks = _ranks(path)
        token = np.fromiter((ranks.get(p, -1) for p in self.pieces), np.int32, len(at))
        segment = (one % np.uint64(segments)).astype(np.int64)
        #: Pieces that are no tokens, by segment and then by hash.
        asked = np.flatnonzero(token < 0)
        self.asked = asked[np.argsort(segment[asked], kind="stable")]
        self.segment = segment[self.asked]
        common = np.argsort(-np.bincount(number, minlength=len(at)), kind="stable")
        place = np.empty(len(at), np.int32)
        place[common] = np.arange(len(at), dtype=np.int32)
        self.numbers, self.token, self.asked_numbers = place[number], token[common], place[self.asked]
        #: Blocks of one key have the same pieces under the same numbers, and so the same answers.
        self.key = hashlib.blake2b(one.tobytes() + two.tobytes() + place.tobytes(), digest_size=16).hexdigest()


def _blocks(batches: Iterator[pa.RecordBatch], path: str, pattern: str, segments: int, block_bytes: int) -> Iterator[tuple[pa.Array, Block]]:
    """(ids, block) for runs of rows (id, text) of about `block_bytes`; a longer text is a block alone."""
    ids, parts, held = [], [[] for _ in range(5)], 0
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        first = 0
        while first < len(sizes):
            room = np.searchsorted(np.cumsum(sizes[first:]), min(CUT_BYTES, block_bytes), "right")
            last = first + max(1, int(room))
            size = int(sizes[first:last].sum())
            if held and held + size > block_bytes:
                yield pa.concat_arrays(ids), Block(parts, path, segments)
                ids, held = [], 0
            data, lengths, counts = cut_pieces(texts.slice(first, last - first).to_pylist(), pattern)
            for part, found in zip(parts, (data, lengths.astype(np.int32), counts, *piece_hashes(data, lengths))):
                part.append(found)
            ids.append(batch.column(0).slice(first, last - first))
            held += size
            first = last
    if ids:
        yield pa.concat_arrays(ids), Block(parts, path, segments)


def _runs(counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, done, end): runs of texts [first, last) with their pieces [done, end), about `PIECES_AT_ONCE`; a longer text is alone."""
    ends, first = np.cumsum(counts), 0
    while first < len(counts):
        done = int(ends[first] - counts[first])
        last = max(first + 1, int(np.searchsorted(ends, done + PIECES_AT_ONCE, "right")))
        yield first, last, done, int(ends[last - 1])
        first = last


def asked_pieces(rows: DataFrame, path: str, pattern: str, segments: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(seg, block, lengths, pieces): the distinct pieces of each block that are no tokens, by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, path, pattern, segments, block_bytes):
            edges = np.flatnonzero(np.r_[True, np.diff(block.segment) != 0, True]) if len(block.segment) else np.zeros(1, np.int64)
            segs, lengths, blobs = [], [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                found = [block.pieces[i] for i in block.asked[a:b].tolist()]
                segs.append(int(block.segment[a]))
                lengths.append(_planes(np.fromiter(map(len, found), np.int32, len(found))))
                blobs.append(b"".join(found))
            yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array([block.key] * len(segs), pa.string()), pa.array(lengths, pa.binary()), pa.array(blobs, pa.binary())], names=["seg", "block", "lengths", "pieces"])
        give_back()

    return rows.mapInArrow(run, "seg bigint, block string, lengths binary, pieces binary")


def replayed(asked: DataFrame, path: str) -> DataFrame:
    """(block, seg, counts, ids): how many ids each asked piece has, and these, by one replay over each segment's distinct pieces."""

    def run(group: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        rows = []
        for lengths, blob in zip(group.column("lengths").to_pylist(), group.column("pieces").to_pylist()):
            ends = np.cumsum(_unplanes(lengths)).tolist()
            rows.append(np.fromiter((known.setdefault(blob[a:b], len(known)) for a, b in zip([0, *ends[:-1]], ends)), np.int64, len(ends)))
        counts, ids = replay(list(known), _merges(path))
        starts = np.cumsum(counts) - counts
        out = pa.table(
            {
                "block": group.column("block"),
                "seg": group.column("seg"),
                "counts": pa.array([_planes(counts[r]) for r in rows], pa.binary()),
                "ids": pa.array([_planes(_spread(ids, starts[r], counts[r])) for r in rows], pa.binary()),
            }
        )
        del known, rows
        give_back()
        return out

    return asked.groupBy("seg").applyInArrow(run, "block string, seg bigint, counts binary, ids binary")


def _binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def decode_ids(ids: np.ndarray, counts: np.ndarray, path: str) -> pa.Array:
    """The bytes of each run of ids; `counts`: the ids of each."""
    data, starts, lengths = _token_bytes(path)
    size = lengths[ids] if not len(ids) or (0 <= ids.min() and ids.max() < len(lengths)) else np.array([-1])
    if (size < 0).any():
        raise KeyError("an id that the ranks lack")
    ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]]
    return _binaries(_spread(data, starts[ids], size), np.diff(ends))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`id_col` and ids: the tokens of the whole text by the ranks in the file `path` (present on every worker). `with_decoded` adds decoded, the bytes of the ids. `block_bytes`: the text of a block."""
    small_batches(df.sparkSession)
    rows = id_and_text(df, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    segments = int(max(LEAST_SEGMENTS, size // SEGMENT_BYTES))
    kind = rows.schema["id"].dataType

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "ids", "counts", "numbers", "token", "asked"]

        def row(key: str, ids: pa.Array, *blobs: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in blobs)], names=names)

        for ids, block in _blocks(batches, path, pattern, segments, block_bytes):
            yield row(block.key, ids.slice(0, 0), None, None, _planes(block.token), _planes(block.asked_numbers))
            for first, last, done, end in _runs(block.counts):
                yield row(block.key, ids.slice(first, last - first), _planes(block.counts[first:last]), _planes(block.numbers[done:end]), None, None)
            del block
        give_back()

    fields = [T.StructField("block", T.StringType()), T.StructField("ids", T.ArrayType(kind))] + [T.StructField(c, T.BinaryType()) for c in ("counts", "numbers", "token", "asked")]
    schema = T.StructType([T.StructField(id_col, kind, True), T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * with_decoded)

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        found = dict(zip(right.column("seg").to_pylist(), zip(right.column("counts").to_pylist(), right.column("ids").to_pylist())))
        head = left.filter(pc.is_valid(left.column("token")))
        if not head.num_rows:
            raise ValueError(LOST)
        asked, token = (_unplanes(head.column(c)[0].as_py()) for c in ("asked", "token"))
        back = [found[s] for s in sorted(found)]
        lengths = np.ones(len(token), np.int32)
        theirs = np.concatenate([_unplanes(c) for c, _ in back] or [np.zeros(0, np.int32)])
        if len(theirs) != len(asked):
            raise ValueError(LOST)
        lengths[asked] = theirs
        flat = np.concatenate([token, *(_unplanes(i) for _, i in back)])
        starts = np.arange(len(token))
        starts[asked] = len(token) + np.cumsum(theirs, dtype=np.int64) - theirs
        del found, back, theirs
        out = []
        for i in range(left.num_rows):
            one = left.slice(i, 1)
            if one.column("numbers")[0].as_py() is None:
                continue
            part, counts = (_unplanes(one.column(c)[0].as_py()) for c in ("numbers", "counts"))
            tokens = _spread(flat, starts[part], lengths[part])
            each = np.diff(np.r_[0, np.cumsum(lengths[part], dtype=np.int64)][np.r_[0, np.cumsum(counts, dtype=np.int64)]])
            columns = [one.column("ids").combine_chunks().flatten(), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)], pa.int32()), pa.array(tokens, pa.int32()))]
            if with_decoded:
                columns.append(decode_ids(tokens, each, path))
            out.append(pa.RecordBatch.from_arrays(columns, names=schema.names))
        give_back()
        return pa.Table.from_batches(out)

    known = replayed(asked_pieces(rows, path, pattern, segments, block_bytes), path)
    held = rows.mapInArrow(blocks, T.StructType(fields))
    return held.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(put_together, schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`id_col` and decoded: the bytes of the ids; null ids count as none. Fails on an id that the file lacks."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    schema = T.StructType([rows.schema[0], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lists = part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), decode_ids(lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), path)], names=schema.names)

    return rows.mapInArrow(run, schema)


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
