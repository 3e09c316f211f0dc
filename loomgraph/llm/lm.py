"""Language-model scoring with a log-frequency Bloom filter.

Training n-grams (one and two tokens) are counted; a count c goes into the filter as its
quantised logarithm: levels 0 to floor(log2 c) of the n-gram are entered, so a count is read
back by probing level after level until one is missing. Filter segments are built where the
n-grams of a segment meet, collected, and broadcast; beyond `MAX_BROADCAST_BYTES` they go out
in rounds of that size, and the levels read in each round are put together. Smoothed
probabilities interpolate the bigram and the unigram estimate from those probes.

Texts are cut into blocks of bounded size (a longer text is a block alone), tokenised once, with a vocabulary each. Exact token
counts travel by block vocabularies, not by occurrences: they are summed where a segment of
tokens meets and sent back to the blocks. Nothing that grows with the corpus is gathered in one
place but the filter, in rounds.

Defined results: a null text is empty and has one token, its end; repeated rows count and are
scored each; ids may be null; only the named columns are read; an empty table gives none.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..layout import spread
from .common import crc_mod, cut

BLOCK_TOKENS = 500_000
SEGMENT_TOKENS = 1_000_000
MAX_BROADCAST_BYTES = 40 << 20
BITS_PER_ENTRY = 12
WEIGHT = 0.6  # of the bigram estimate

_P = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(0x51ED270B9F4C2D17)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _planes(x: np.ndarray) -> bytes:
    """int32 as four planes of bytes, which compress well."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time: a row is a whole block."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _words(blob: bytes) -> list[bytes]:
    """A block's vocabulary; number 0 is the end of a text."""
    return [b"", *blob.split(b" ")] if blob else [b""]


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def blocks(docs: DataFrame, held: Column, id_col: str, text_col: str) -> DataFrame:
    """The documents in blocks: block, ids, held, lengths (tokens of each), tokens, vocab, train (each token's count in documents that are not held)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    kind = rows.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("block", T.StringType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.ArrayType(T.IntegerType()))]
        + [T.StructField(n, T.BinaryType()) for n in ("tokens", "vocab", "train")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            lengths = np.array(sizes, np.int64)
            tokens = np.array(flat, np.int32)
            learnt = tokens[np.repeat(~np.array(marks, bool), lengths)]
            train = np.bincount(learnt, minlength=len(known)).astype(np.int32)
            columns = [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(arrow)), pa.array([marks], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([x], pa.binary()) for x in (_planes(tokens), b" ".join(list(known)[1:]), _planes(train)))], names=schema.names)

        known: dict[bytes, int] = {b"": 0}
        flat = array("i")
        ids, marks, sizes, arrow = [], [], [], pa.null()
        for batch in batches:
            arrow = batch.column(0).type
            for key, text, mark in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                words = text.lower().split()
                if flat and len(flat) + len(words) >= BLOCK_TOKENS:
                    yield done()
                    known, flat, ids, marks, sizes = {b"": 0}, array("i"), [], [], []
                flat.extend([known.setdefault(w, len(known)) for w in words])
                flat.append(0)
                ids.append(key)
                marks.append(mark)
                sizes.append(len(words) + 1)
        if flat:
            yield done()

    return rows.mapInArrow(run, schema)


def _dealt(segment: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(segment, places in it) for each segment that occurs."""
    order = np.argsort(segment, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(segment[order]) != 0, True]) if len(order) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(segment[order[a]]), order[a:b]


def exact_counts(table: DataFrame, segments: int) -> DataFrame:
    """(block, seg, counts): training counts of the words of a block that are in a segment; a row without block has the segment's distinct words v and their sum n."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                words, train = _words(r["vocab"]), _unplanes(r["train"])
                rows = [(s, b" ".join(words[i] for i in at), _planes(train[at])) for s, at in _dealt((word_hashes(words) % np.uint64(segments)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _, _ in rows], pa.int64()), pa.array([r["block"]] * len(rows)), pa.array([w for _, w, _ in rows], pa.binary()), pa.array([c for _, _, c in rows], pa.binary())],
                    names=["seg", "block", "words", "train"],
                )

    def total(group: pa.Table) -> pa.Table:
        rows, sums = group.to_pylist(), {}
        for r in rows:
            for w, c in zip(r["words"].split(b" "), _unplanes(r["train"]).tolist()):
                sums[w] = sums.get(w, 0) + c
        back = [np.array([sums[w] for w in r["words"].split(b" ")], np.int64).astype("<i8").tobytes() for r in rows]
        known = [c for c in sums.values() if c]
        return pa.table(
            {
                "block": pa.array([*(r["block"] for r in rows), None], pa.string()),
                "seg": pa.array([r["seg"] for r in rows] + [rows[0]["seg"]], pa.int64()),
                "counts": pa.array([*back, None], pa.binary()),
                "v": pa.array([0] * len(rows) + [len(known)], pa.int64()),
                "n": pa.array([0] * len(rows) + [sum(known)], pa.int64()),
            }
        )

    parts = table.select("block", "vocab", "train").mapInArrow(split, "seg bigint, block string, words binary, train binary")
    return parts.groupBy("seg").applyInArrow(total, "block string, seg bigint, counts binary, v bigint, n bigint")


# n-gram keys: the low part picks the segment, the high 40 bits stand for the n-gram in it


def unigram_keys(hashes: np.ndarray) -> np.ndarray:
    return _mix(hashes + np.uint64(1))


def bigram_keys(hashes: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The key of each token with the one before it in its text, or with the start."""
    now = hashes[tokens]
    before = np.r_[_START, now[:-1]] if len(now) else now
    before[np.r_[0, np.cumsum(lengths)[:-1]]] = _START
    return _mix(before * _P + now)


def _segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys & np.uint64(0xFFFFFF)) % np.uint64(segments)).astype(np.int64)


def _short(keys: np.ndarray) -> np.ndarray:
    return keys >> np.uint64(24)


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _places(short: np.ndarray, level: int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The word of the filter and the four bits in it that stand for a level of an n-gram."""
    e = _mix(short * _P + np.uint64(level + 1))
    mask = np.zeros(len(e), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((e >> np.uint64(6 * k)) & np.uint64(63))
    return ((e >> np.uint64(32)) % np.asarray(words, np.uint64)).astype(np.int64), mask


def build_segment(short: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter words of a segment's n-grams: levels 0 to floor(log2(count)) of each."""
    top = np.floor(np.log2(counts)).astype(np.int64)
    words = max(1, -(-int((top + 1).sum()) * BITS_PER_ENTRY // 64))
    out = np.zeros(words, np.uint64)
    for level in range(int(top.max()) + 1 if len(top) else 0):
        at, mask = _places(short[top >= level], level, words)
        np.bitwise_or.at(out, at, mask)
    return out


class Filter:
    """Some segments of the filter, side by side."""

    def __init__(self, segments: int, parts: dict[int, bytes]):
        self.segments = segments
        self.words = np.zeros(segments, np.int64)
        for s, data in parts.items():
            self.words[s] = len(data) // 8
        self.start = np.r_[0, np.cumsum(self.words)[:-1]]
        self.data = np.frombuffer(b"".join(parts[s] for s in sorted(parts)), np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """How many levels of each n-gram are entered; 0 for one of another segment."""
        out = np.zeros(len(keys), np.uint8)
        seg = _segment_of(keys, self.segments)
        left = np.flatnonzero(self.words[seg] > 0)
        short, seg, level = _short(keys[left]), seg[left], 0
        while len(left):
            at, mask = _places(short, level, self.words[seg])
            hit = (self.data[self.start[seg] + at] & mask) == mask
            left, short, seg = left[hit], short[hit], seg[hit]
            out[left] += 1
            level += 1
        return out


def read_count(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that have so many levels; 0 for none."""
    low = np.exp2(levels.astype(np.float64) - 1)
    return np.where(levels == 0, 0.0, (3 * low - 1) / 2)


def filter_segments(table: DataFrame, segments: int) -> DataFrame:
    """(seg, data): the filter, built where the n-grams of a segment meet."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _rows(batch):
                hashes, train = word_hashes(_words(r["vocab"])), _unplanes(r["train"])
                lengths = np.array(r["lengths"], np.int64)
                learnt = np.repeat(~np.array(r["held"], bool), lengths)
                pairs, counts = np.unique(bigram_keys(hashes, _unplanes(r["tokens"]), lengths)[learnt], return_counts=True)
                keys = np.r_[unigram_keys(hashes)[train > 0], pairs]
                counts = np.r_[train[train > 0], counts]
                rows = []
                for s, at in _dealt(_segment_of(keys, segments)):
                    k, c = _short(keys[at]), counts[at]
                    rows.append((s, _pack(k[c == 1]), _pack(k[c > 1]), c[c > 1].astype("<i8").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), *(pa.array([x[j] for x in rows], pa.binary()) for j in (1, 2, 3))], names=["seg", "once", "keys", "counts"])

    def build(group: pa.Table) -> pa.Table:
        once = _unpack(b"".join(group.column("once").to_pylist()))
        keys = np.r_[once, _unpack(b"".join(group.column("keys").to_pylist()))]
        counts = np.r_[np.ones(len(once), np.int64), np.frombuffer(b"".join(group.column("counts").to_pylist()), "<i8")]
        short, at = np.unique(keys, return_inverse=True)
        data = build_segment(short, np.bincount(at, counts, len(short)))
        return pa.table({"seg": pa.array([group.column("seg")[0].as_py()], pa.int64()), "data": pa.array([data.tobytes()], pa.binary())})

    parts = table.select("vocab", "train", "lengths", "held", "tokens").mapInArrow(split, "seg bigint, once binary, keys binary, counts binary")
    return parts.groupBy("seg").applyInArrow(build, "seg bigint, data binary")


def probed(table: DataFrame, built: DataFrame, segments: int) -> DataFrame:
    """(block, round, words, pairs): levels of each word of the vocabulary and of each token's bigram, by probing a broadcast filter, one round for each `MAX_BROADCAST_BYTES`."""
    spark = table.sparkSession
    sizes = sorted((r.seg, r.bytes) for r in built.select("seg", F.octet_length("data").alias("bytes")).collect())
    rounds, held = [[]], 0
    for seg, n in sizes:
        if rounds[-1] and held + n > MAX_BROADCAST_BYTES:
            rounds.append([])
            held = 0
        rounds[-1].append(seg)
        held += n
    out = None
    for k, segs in enumerate(rounds):
        parts = built.filter((F.col("seg") >= segs[0]) & (F.col("seg") <= segs[-1])) if segs else built.limit(0)
        shared = spark.sparkContext.broadcast(Filter(segments, {r.seg: bytes(r.data) for r in parts.toLocalIterator()}))

        def probe(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in _rows(batch):
                    hashes = word_hashes(_words(r["vocab"]))
                    keys, at = np.unique(bigram_keys(hashes, _unplanes(r["tokens"]), np.array(r["lengths"], np.int64)), return_inverse=True)
                    found = [shared.value.levels(unigram_keys(hashes)).tobytes(), shared.value.levels(keys)[at].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([r["block"]]), pa.array([k], pa.int64()), *(pa.array([x], pa.binary()) for x in found)], names=["block", "round", "words", "pairs"])

        # a round is written before the next filter goes out, so workers hold one at a time
        one = table.select("block", "vocab", "lengths", "tokens").mapInArrow(probe, "block string, round bigint, words binary, pairs binary")
        one = cut(one, "levels")
        shared.destroy()
        out = one if out is None else out.union(one)
    return out


def lm_score(df: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) of every text, learning from those that are not `held`."""
    table = cut(blocks(df, held, id_col, text_col), "blocks")
    size = table.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size(F.filter("held", lambda x: ~x))), F.lit(0)).alias("docs")).collect()[0]
    segments = int(max(32, size["n"] // SEGMENT_TOKENS))
    counts = cut(exact_counts(table, segments), "counts")
    total = counts.filter("block IS NULL").agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]
    n, v, learnt = int(total["n"]), int(total["v"]), int(size["docs"])
    built = cut(filter_segments(table, segments), "filter")
    empty = F.lit(None).cast("binary")
    parts = counts.filter("block IS NOT NULL").select("block", "seg", "counts", empty.alias("words"), empty.alias("pairs"))
    parts = parts.union(probed(table, built, segments).select("block", F.col("round").alias("seg"), empty.alias("counts"), "words", "pairs"))
    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens"))]
        + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    )
    weight = WEIGHT

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            words, tokens, lengths = _words(row["vocab"]), _unplanes(row["tokens"]), np.array(row["lengths"], np.int64)
            exact = np.zeros(len(words), np.int64)
            place = dict(_dealt((word_hashes(words) % np.uint64(segments)).astype(np.int64)))
            one, two = np.zeros(len(words), np.uint8), np.zeros(len(tokens), np.uint8)
            for r in right.to_pylist():
                if r["counts"] is not None:
                    exact[place[r["seg"]]] = np.frombuffer(r["counts"], "<i8")
                else:  # an n-gram has levels in one round alone
                    one = np.maximum(one, np.frombuffer(r["words"], np.uint8))
                    two = np.maximum(two, np.frombuffer(r["pairs"], np.uint8))
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            single, pair = read_count(one), read_count(two)
            context = np.r_[0.0, single[tokens[:-1]]]
            context[starts] = learnt
            alone = (single[tokens] + 1) / (n + v + 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(context > 0, weight * np.minimum(pair, context) / context + (1 - weight) * alone, alone)
            base = np.log10(exact + 1.0)[tokens] - np.log10(n + v + 1.0)
            out.append(
                pa.table(
                    [
                        pa.array(row["ids"], left.schema.field("ids").type.value_type),
                        pa.array(row["held"], pa.bool_()),
                        pa.array(lengths, pa.int64()),
                        pa.array(np.add.reduceat((exact > 0)[tokens].astype(np.int64), starts), pa.int64()),
                        pa.array(np.full(len(lengths), n), pa.int64()),
                        pa.array(np.add.reduceat(base, starts), pa.float64()),
                        pa.array(np.add.reduceat(np.log10(p), starts), pa.float64()),
                    ],
                    names=schema.names,
                )
            )
        return pa.concat_tables(out)

    return table.select("block", "ids", "held", "lengths", "tokens", "vocab").groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(score, schema)


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return lm_score(docs, crc_mod("doc_id", 7) == 2)
