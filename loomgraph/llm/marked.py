"""SentencePiece encoding and decoding by a table of distinct marked words.

No piece of such a model holds a white-space marker behind another character, so no merge crosses
from a word into the next marker: a text is a row of marked words (a run of markers and what
follows up to the next), and each ends as if it were encoded alone. Texts make blocks of bounded
size; of each block only its distinct marked words travel, dealt by a hash to segments. A segment
cuts each of its distinct words into pieces once, however many blocks hold it, and the ids go back
to the blocks that asked, where they are joined by position.

A word that is itself a piece and that the merges leave whole is known everywhere and is not asked
for. Words of a block are told apart by 128 bits of two random multilinear hashes; segments compare
their bytes. A segment serves `FAN_BLOCKS` blocks: in a corpus of more, each of these groups of
blocks has its own segments, so a word of every block never gathers them all in one task.

Defined results: whole texts are processed; null text is empty and has only the begin and end ids;
an empty table gives an empty table; repeated rows give one row each; only the named columns are
read, so others of any name do no harm; bytes that are not UTF-8 become U+FFFD. The input is read
twice and must give equal partitions each time (a table does; cut a random one first): a block
that no longer finds its ids fails the job. Memory per task grows with one block, one segment, or
the longest single text. Models that this does not hold for (other types than BPE, a normaliser
that changes characters, pieces across markers, user-defined pieces) are refused.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..layout import spread
from .bpe import _binaries, _runs, _spread, distinct, piece_hashes
from .common import give_back, id_and_text, small_batches

BLOCK_BYTES = 10 << 20
#: Bytes of text for each segment of words.
SEGMENT_BYTES = 4 << 20
LEAST_SEGMENTS, MOST_SEGMENTS = 32, 4096
#: Blocks that share segments.
FAN_BLOCKS = MOST_SEGMENTS * SEGMENT_BYTES // BLOCK_BYTES
#: Bytes of text that are cut at once.
CUT_BYTES = 1 << 20
#: Words of up to so many characters are merged by a plain list, longer ones by a heap.
LIST_CHARS = 48
LOST = "a block did not find its ids: the input gave other partitions when it was read again"

# The marker, and the format's numbers of fields and piece types.
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size, at = number(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """Pieces of a model file, with what encoding and decoding ask for."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(_fields(file.read()))
        pieces = [dict(_fields(v)) for k, v in message if k == PIECES]
        trainer, normalizer = (dict(_fields(next(v for k, v in message if k == part))) for part in (TRAINER, NORMALIZER))
        text = [p[1].decode() for p in pieces]
        kind = [p.get(3, NORMAL) for p in pieces]
        self.ids = {t: k for k, t in enumerate(text) if kind[k] == NORMAL}
        plain = trainer.get(3) == 2 and trainer.get(35) == 1 and not trainer.get(24) and not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
        if not plain or set(kind) - {NORMAL, UNKNOWN, CONTROL, BYTE} or any(MARKER in t.lstrip(MARKER) for t in self.ids):
            raise ValueError("not a BPE model with byte fallback whose pieces stay within marked words")
        score = {t: struct.unpack("<f", pieces[k].get(2, bytes(4)))[0] for t, k in self.ids.items()}
        place = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        #: Rank of a merge by the piece that it makes; pieces of equal score share one.
        self.rank = {t: place[s] for t, s in score.items()}
        self.none = len(place)
        self.bytes = [0] * 256
        surface = trainer.get(44, " ⁇ ".encode())
        out = []
        for k, t in enumerate(text):
            if kind[k] == BYTE:
                self.bytes[int(t[3:5], 16)] = k
            out.append({NORMAL: t.replace(MARKER, " ").encode(), BYTE: bytes([int(t[3:5], 16)]) if kind[k] == BYTE else b"", CONTROL: b"", UNKNOWN: surface}[kind[k]])
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.lengths = np.fromiter(map(len, out), np.int64, len(out))
        self.data, self.starts = np.frombuffer(b"".join(out), np.uint8), np.cumsum(self.lengths) - self.lengths
        self.silent = np.array([k == CONTROL for k in kind])
        self.marked = np.array([t.startswith(MARKER) and k == NORMAL for t, k in zip(text, kind)])
        #: Marked words, markers written as spaces, that merges leave as one piece.
        self.whole = {t.replace(MARKER, " ").encode(): k for t, k in self.ids.items() if t.startswith(MARKER) and self.merged(t) == [t]}

    def merged(self, word: str) -> list[str]:
        """Pieces of a marked word: the best-scored pair of neighbours joins first, the leftmost of equals."""
        parts, rank, none = list(word), self.rank.get, self.none
        if len(parts) > LIST_CHARS:
            return self._merged_long(parts)
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        rank, none, n = self.rank.get, self.none, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(i: int, j: int) -> None:
            joined = parts[i] + parts[j]
            if (r := rank(joined, none)) != none:
                heapq.heappush(queue, (r, i, j, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, joined = heapq.heappop(queue)
            if not parts[i] or after[i] != j or parts[i] + parts[j] != joined:  # out of date
                continue
            parts[i], parts[j] = joined, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p]

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of a marked word, whose markers are written as spaces; characters that are no piece become their bytes."""
        out = []
        for piece in self.merged(word.decode().replace(" ", MARKER)):
            found = self.ids.get(piece)
            out += [found] if found is not None else [self.bytes[b] for b in piece.encode()]
        return out

    def decode_runs(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each run of ids; `counts`: the ids of each. Control ids are silent, and one marker at the start goes."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.lengths)):
            raise KeyError("an id that the model lacks")
        ends = np.cumsum(counts)
        size = self.lengths[ids]
        start = self.starts[ids]
        heard = np.flatnonzero(~self.silent[ids])
        first = np.searchsorted(heard, ends - counts)
        head = heard[np.minimum(first, max(len(heard) - 1, 0))] if len(heard) else np.zeros(len(counts), np.int64)
        head = head[(first < len(heard)) & (head < ends)]
        head = head[self.marked[ids[head]]]
        start[head] += 1
        size[head] -= 1
        stops = np.r_[0, np.cumsum(size)][np.r_[0, ends]]
        blobs = _binaries(_spread(self.data, start, size), np.diff(stops))
        try:
            return blobs.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "each_byte") for b in blobs.to_pylist()], pa.string())


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def cut_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all marked words, length of each, words of each text); markers are written as spaces."""
    marker = MARKER.encode()
    strings = [b" " + t.replace(marker, b" ") if t else b"" for t in texts]
    joined = b"".join(strings)
    try:
        joined.decode()
    except UnicodeDecodeError:
        strings = [s.decode("utf-8", "replace").encode() for s in strings]
        joined = b"".join(strings)
    data = np.frombuffer(joined, np.uint8)
    bounds = np.r_[0, np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))]
    space = data == ord(" ")
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[bounds[:-1][np.diff(bounds) > 0]] = True
    starts = np.flatnonzero(start)
    return data, np.diff(np.r_[starts, len(data)]), np.diff(np.searchsorted(starts, bounds))


def _pack(x: np.ndarray) -> bytes:
    """int32 as planes of bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


class Block:
    """Texts that were cut together: their words as numbers by falling frequency, and the words to ask for, by segment."""

    def __init__(self, parts: list[list[np.ndarray]], path: str, segments: int):
        """`parts`: lists of bytes, lengths, counts of texts and both hashes; emptied."""
        whole = []
        for part in parts:  # one after another, so that few are held twice
            whole.append(np.concatenate(part))
            part.clear()
        data, lengths, self.counts, one, two = whole
        at, number = distinct(one, two)
        one, two = one[at], two[at]
        ends = np.cumsum(lengths)[at]
        blob, known = memoryview(data), load(path).whole
        words = [bytes(blob[a:b]) for a, b in zip((ends - lengths[at]).tolist(), ends.tolist())]
        token = np.fromiter((known.get(w, -1) for w in words), np.int32, len(at))
        segment = (one % np.uint64(segments)).astype(np.int64)
        asked = np.flatnonzero(token < 0)
        asked = asked[np.argsort(segment[asked], kind="stable")]
        self.segment, self.words = segment[asked], [words[i] for i in asked.tolist()]
        common = np.argsort(-np.bincount(number, minlength=len(at)), kind="stable")
        place = np.empty(len(at), np.int32)
        place[common] = np.arange(len(at), dtype=np.int32)
        self.numbers, self.token, self.asked_numbers = place[number], token[common], place[asked]
        #: Blocks of one key have the same words under the same numbers, and so the same answers.
        self.key = hashlib.blake2b(one.tobytes() + two.tobytes() + place.tobytes(), digest_size=16).digest()


def _blocks(batches: Iterator[pa.RecordBatch], path: str, segments: int, block_bytes: int) -> Iterator[tuple[pa.Array, Block]]:
    """(ids, block) for runs of rows (id, text) of about `block_bytes`; a longer text is a block alone."""
    ids, parts, held = [], [[] for _ in range(5)], 0
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        first = 0
        while first < len(sizes):
            last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), min(CUT_BYTES, block_bytes), "right")))
            size = int(sizes[first:last].sum())
            if held and held + size > block_bytes:
                yield pa.concat_arrays(ids), Block(parts, path, segments)
                ids, held = [], 0
            data, lengths, counts = cut_words(texts.slice(first, last - first).to_pylist())
            for part, found in zip(parts, (data, lengths.astype(np.int32), counts, *piece_hashes(data, lengths))):
                part.append(found)
            ids.append(batch.column(0).slice(first, last - first))
            held += size
            first = last
    if ids:
        yield pa.concat_arrays(ids), Block(parts, path, segments)


def asked_words(rows: DataFrame, path: str, segments: int, fans: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(seg, fan, block, lengths, words): the distinct words of each block that are no single pieces, by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, path, segments, block_bytes):
            edges = np.flatnonzero(np.r_[True, np.diff(block.segment) != 0, True]) if len(block.segment) else np.zeros(1, np.int64)
            segs, lengths, blobs = [], [], []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                found = block.words[a:b]
                segs.append(int(block.segment[a]))
                lengths.append(_pack(np.fromiter(map(len, found), np.int32, len(found))))
                blobs.append(zstandard.compress(b"".join(found), 1))
            fan = int.from_bytes(block.key[:8], "little") % fans
            yield pa.RecordBatch.from_arrays(
                [pa.array(segs, pa.int64()), pa.array([fan] * len(segs), pa.int64()), pa.array([block.key] * len(segs), pa.binary()), pa.array(lengths, pa.binary()), pa.array(blobs, pa.binary())],
                names=["seg", "fan", "block", "lengths", "words"],
            )
        give_back()

    return rows.mapInArrow(run, "seg bigint, fan bigint, block binary, lengths binary, words binary")


def segmented(asked: DataFrame, path: str) -> DataFrame:
    """(block, seg, counts, ids): how many ids each asked word has, and these; a segment cuts each of its distinct words once."""

    def run(group: pa.Table) -> pa.Table:
        model, known, rows, ids, counts = load(path), {}, [], [], []
        for lengths, blob in zip(group.column("lengths").to_pylist(), group.column("words").to_pylist()):
            ends, words = np.cumsum(_unpack(lengths)).tolist(), zstandard.decompress(blob)
            row = np.empty(len(ends), np.int64)
            for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                word = words[a:b]
                at = known.get(word)
                if at is None:
                    at = known[word] = len(known)
                    found = model.encode_word(word)
                    counts.append(len(found))
                    ids += found
                row[k] = at
            rows.append(row)
        flat, each = np.array(ids, np.int32), np.array(counts, np.int64)
        starts = np.cumsum(each) - each
        out = pa.table(
            {
                "block": group.column("block"),
                "seg": group.column("seg"),
                "counts": pa.array([_pack(each[r]) for r in rows], pa.binary()),
                "ids": pa.array([_pack(_spread(flat, starts[r], each[r])) for r in rows], pa.binary()),
            }
        )
        del known, rows, ids, counts
        give_back()
        return out

    return asked.groupBy("seg", "fan").applyInArrow(run, "block binary, seg bigint, counts binary, ids binary")


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ends: bool = True, packed: bool = False, with_decoded: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`id_col` and ids: the pieces of the whole text by the model file `path` (present on every worker), between the begin and end ids if `ends`.

    `packed`: ids as one binary of little-endian 32-bit numbers, else an array. `with_decoded` adds
    decoded, the text that the ids stand for. `block_bytes`: the text of a block.
    """
    small_batches(df.sparkSession)
    rows = id_and_text(df, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    segments = int(min(max(LEAST_SEGMENTS, size // SEGMENT_BYTES), MOST_SEGMENTS))
    fans = 1 + int(size // (FAN_BLOCKS * BLOCK_BYTES))
    kind = rows.schema["id"].dataType

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "ids", "counts", "numbers", "token", "asked"]

        def row(key: bytes, ids: pa.Array, *blobs: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in blobs)], names=names)

        for ids, block in _blocks(batches, path, segments, block_bytes):
            yield row(block.key, ids.slice(0, 0), None, None, _pack(block.token), _pack(block.asked_numbers))
            for first, last, done, end in _runs(block.counts):
                yield row(block.key, ids.slice(first, last - first), _pack(block.counts[first:last]), _pack(block.numbers[done:end]), None, None)
            del block
        give_back()

    fields = [T.StructField("block", T.BinaryType()), T.StructField("ids", T.ArrayType(kind))] + [T.StructField(c, T.BinaryType()) for c in ("counts", "numbers", "token", "asked")]
    schema = T.StructType([T.StructField(id_col, kind, True), T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * with_decoded)

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        model = load(path)
        found = dict(zip(right.column("seg").to_pylist(), zip(right.column("counts").to_pylist(), right.column("ids").to_pylist())))
        head = left.filter(pc.is_valid(left.column("token")))
        if not head.num_rows:
            raise ValueError(LOST)
        asked, token = (_unpack(head.column(c)[0].as_py()) for c in ("asked", "token"))
        back = [found[s] for s in sorted(found)]
        theirs = np.concatenate([_unpack(c) for c, _ in back] or [np.zeros(0, np.int32)])
        if len(theirs) != len(asked):
            raise ValueError(LOST)
        # the begin id, the end id, then the ids of every word
        flat = np.concatenate([np.array([model.begin, model.end], np.int32), token, *(_unpack(i) for _, i in back)])
        starts, lengths = np.arange(2 + len(token)), np.ones(2 + len(token), np.int64)
        starts[2 + asked] = 2 + len(token) + np.cumsum(theirs, dtype=np.int64) - theirs
        lengths[2 + asked] = theirs
        del found, back, theirs
        out = []
        for i in range(left.num_rows):
            one = left.slice(i, 1)
            if one.column("numbers")[0].as_py() is None:
                continue
            part, counts = (_unpack(one.column(c)[0].as_py()).astype(np.int64) for c in ("numbers", "counts"))
            part = part + 2
            if ends:
                stops = np.cumsum(counts)
                part = np.insert(part, np.c_[stops - counts, stops].ravel(), np.tile([0, 1], len(counts)))
                counts = counts + 2
            tokens = _spread(flat, starts[part], lengths[part])
            each = np.diff(np.r_[0, np.cumsum(lengths[part])][np.r_[0, np.cumsum(counts)]])
            held = _binaries(tokens.astype("<u4").view(np.uint8), each * 4) if packed else pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)], pa.int32()), pa.array(tokens, pa.int32()))
            columns = [one.column("ids").combine_chunks().flatten(), held]
            if with_decoded:
                columns.append(model.decode_runs(tokens, each))
            out.append(pa.RecordBatch.from_arrays(columns, names=schema.names))
        give_back()
        return pa.Table.from_batches(out)

    known = segmented(asked_words(rows, path, segments, fans, block_bytes), path)
    held = rows.mapInArrow(blocks, T.StructType(fields))
    return held.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(put_together, schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`id_col` and decoded: the text of an array of ids; null ids count as none. Fails on an id that the model lacks."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))
    schema = T.StructType([rows.schema[0], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                lists = part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), load(path).decode_runs(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))], names=schema.names)

    return rows.mapInArrow(run, schema)


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    out = encode(docs, public_tokenizers.path("piece_bpe_32k.model"), packed=True, with_decoded=True)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
