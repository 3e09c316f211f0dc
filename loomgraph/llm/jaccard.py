"""N-gram Jaccard join with Bayesian candidate pruning.

Every text becomes its set of word shingles. Texts with equal sets form a class. Classes meet
in bands of MinHash values; in a bucket, MinHash bytes are compared step by step, and a pair
goes as soon as the posterior probability that its similarity reaches the threshold falls
below the tolerance. What is left connects classes into candidate groups. Within a group all
pairs are pruned in the same way and the rest is verified on the shingle sets themselves.

Buckets and groups are cut into blocks of bounded size, compared two at a time, so none is ever
gathered whole; a block gives back at most a spanning forest and a count for each class, never
its pairs. A pair at the threshold shares no band with probability 5e-8 and is pruned with a
probability near the tolerance.

Defined results: a text of fewer words than a shingle has one shingle, all its words; a text
without words (or null) has no links and is its own class; copies are linked; rows that repeat
an id are documents of their own; a group whose ids are all null has class null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.iterate import star_components as components
from .common import broadcast_if_small, cut, map_chunks

BANDS, ROWS = 32, 4
SKETCH = 64
STEPS = (16, 32, 48, 64)
BUCKET_BLOCK = 1024
GROUP_BLOCK, GROUP_SHINGLES = 512, 500_000
BROADCAST_ROWS = 1_000_000
PAIRS_AT_ONCE = 1 << 18

_rng = np.random.default_rng(20_24)
_MUL = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The ascending distinct 64-bit shingle hashes of each text; words are what ASCII white space parts."""
    from xxhash import xxh3_64_intdigest

    known: dict[bytes, int] = {}
    flat, counts = [], []
    for text in texts:
        words = text.split()
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxh3_64_intdigest(w)
            flat.append(h)
        counts.append(len(words))
    words, bounds = np.array(flat, np.uint64), np.r_[0, np.cumsum(counts)]

    def hashed(part: np.ndarray, k: int) -> np.ndarray:
        n = len(part) - k + 1
        key = np.full(n, k, np.uint64)
        for j in range(k):
            key = key * _P + part[j : j + n]
        return _mix(key)

    return [np.unique(hashed(words[a:b], min(width, b - a))) if b > a else words[:0] for a, b in zip(bounds[:-1], bounds[1:])]


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash values of each set that is not empty: (sets, BANDS * ROWS)."""
    x, starts = np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    out = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for j in range(BANDS * ROWS):
        out[:, j] = np.minimum.reduceat(x * _MUL[j] + _ADD[j], starts)
    return out


def band_hashes(values: np.ndarray) -> np.ndarray:
    rows = values.reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for j in range(ROWS):
        key = _mix(key * _P + rows[:, :, j])
    return key.view(np.int64)


def sketches(values: np.ndarray) -> np.ndarray:
    """A byte of every other MinHash value."""
    return (_mix(values[:, :: BANDS * ROWS // SKETCH]) & np.uint64(255)).astype(np.uint8)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each step the least number of equal bytes with which the posterior probability (uniform prior) of reaching `threshold` is not below `tolerance`."""
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256  # two bytes may be equal by chance
    out = {}
    for k in STEPS:
        for m in range(k + 1):
            log = m * np.log(p) + (k - m) * np.log1p(-p)
            like = np.exp(log - log.max())
            if like[s >= threshold].sum() >= tolerance * like.sum():
                out[k] = m
                break
    return out


def survivors(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Numbers of the pairs (i, j) that stay through all steps."""
    left, same, done = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for k in STEPS:
        same = same + (sketch[i[left], done:k] == sketch[j[left], done:k]).sum(axis=1)
        keep = same >= least[k]
        left, same, done = left[keep], same[keep], k
    return left


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that pairs (i, j) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_pairs(starts: np.ndarray, ends: np.ndarray, crossed: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within each group of rows [start, end), or, where `crossed`, between its rows of the first and of the second block."""
    size = ends - starts
    for s in np.unique(size[~crossed]):
        if s < 2:
            continue
        a, b = np.triu_indices(int(s), 1)
        at = starts[~crossed & (size == s)]
        step = max(1, PAIRS_AT_ONCE // len(a))
        for k in range(0, len(at), step):
            i, j = (at[k : k + step, None] + a).ravel(), (at[k : k + step, None] + b).ravel()
            for c in range(0, len(i), PAIRS_AT_ONCE):
                yield i[c : c + PAIRS_AT_ONCE], j[c : c + PAIRS_AT_ONCE]
    for start, end in zip(starts[crossed], ends[crossed]):
        rows = np.arange(start, end)
        a, b = rows[~second[start:end]], rows[second[start:end]]
        if len(a) and len(b):
            step = max(1, PAIRS_AT_ONCE // len(b))
            for k in range(0, len(a), step):
                part = a[k : k + step]
                yield np.repeat(part, len(b)), np.tile(b, len(part))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches sorted by their first `keys` columns, with the groups' bounds."""
    held: pa.Table | None = None

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in range(keys):
            c = table.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.r_[np.flatnonzero(new), table.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        edges = bounds(table)
        held = table.slice(int(edges[-2]))
        if len(edges) > 2:
            yield table.slice(0, int(edges[-2])), edges[:-1]
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _bytes_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _sets(docs: DataFrame, width: int, signatures: bool) -> DataFrame:
    """(id, h, digest, n, bands, sketch) of each text with words, or (h, digest, set) if not `signatures`. `docs`: id struct<id, h>, text."""
    fields = [T.StructField("id", docs.schema["id"].dataType), T.StructField("digest", T.BinaryType())]
    if signatures:
        fields += [T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]
    else:
        fields += [T.StructField("shingles", T.BinaryType())]
    schema = T.StructType(fields)

    def work(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        sets = shingle_sets(texts, width)
        digest = pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary())
        if not signatures:
            return pa.RecordBatch.from_arrays([ids, digest, pa.array([s.tobytes() for s in sets], pa.binary())], names=schema.names)
        full = [k for k, s in enumerate(sets) if len(s)]
        bands: list = [None] * len(sets)
        sketch: list = [None] * len(sets)
        if full:
            values = minhashes([sets[k] for k in full])
            for k, b, s in zip(full, band_hashes(values), sketches(values)):
                bands[k], sketch[k] = b, s.tobytes()
        return pa.RecordBatch.from_arrays([ids, digest, pa.array([len(s) for s in sets], pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=schema.names)

    return map_chunks(docs, work, schema)


def _blocks(members: DataFrame, key: str, blocks: str) -> DataFrame:
    """Each member once for every pair of blocks that its block takes part in: lo, hi, and second (it is of block hi)."""
    placed = members.withColumn("blk", F.pmod(F.xxhash64(F.lit(7), "digest"), F.col(blocks)).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return spread.withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other")).withColumn("second", (F.col("blk") == F.col("hi")) & (F.col("lo") < F.col("hi")))


def candidate_edges(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(u, v): in each bucket, a spanning forest of the class pairs that pass the Bayesian test. `classes`: digest, bands, sketch."""
    least = least_matches(threshold, tolerance)
    rows = classes.select("digest", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").count().filter("count > 1").select("bucket", F.ceil(F.col("count") / BUCKET_BLOCK).alias("blocks"))
    members = rows.join(shared, "bucket").join(classes.select("digest", "sketch"), "digest")
    spread = _blocks(members, "bucket", "blocks").select("bucket", "lo", "hi", "second", "digest", "sketch")
    dealt = spread.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, 3):
            sketch = _bytes_matrix(table.column("sketch"), SKETCH)
            starts, ends = edges[:-1], edges[1:]
            crossed = (table.column("lo").to_numpy() != table.column("hi").to_numpy())[starts]
            kept_i, kept_j = [], []
            for i, j in block_pairs(starts, ends, crossed, table.column("second").to_numpy()):
                k = survivors(sketch, i, j, least)
                kept_i.append(i[k])
                kept_j.append(j[k])
            if not kept_i:
                continue
            label = forest(table.num_rows, np.concatenate(kept_i), np.concatenate(kept_j))
            u = np.flatnonzero(label != np.arange(len(label)))
            if len(u):
                digest = table.column("digest").combine_chunks()
                yield pa.RecordBatch.from_arrays([digest.take(pa.array(u)), digest.take(pa.array(label[u]))], names=["u", "v"])

    return dealt.mapInArrow(run, "u binary, v binary").distinct()


def verified(members: DataFrame, threshold_percent: int, tolerance: float) -> DataFrame:
    """Rows (u, v, links): a spanning forest of the verified pairs of each pair of blocks (links null), and each class's linked documents (v null).

    `members`: label, lo, hi, second, digest, copies, sketch, shingles.
    """
    least = least_matches(threshold_percent / 100, tolerance)
    dealt = members.select("label", "lo", "hi", "second", "digest", "copies", "sketch", "shingles").repartition("label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, 3):
            for a, b in zip(edges[:-1], edges[1:]):
                part = table.slice(int(a), int(b - a))
                n = part.num_rows
                sets = [np.frombuffer(s, np.uint64) for s in part.column("shingles").to_pylist()]
                sizes = np.array([len(s) for s in sets], np.int64)
                sketch, copies = _bytes_matrix(part.column("sketch"), SKETCH), part.column("copies").to_numpy()
                crossed = part.column("lo")[0] != part.column("hi")[0]
                _, dense = np.unique(np.concatenate(sets), return_inverse=True)
                dense = np.split(dense, np.cumsum(sizes)[:-1])
                marked = np.zeros(max(int(d.max()) for d in dense) + 1, bool)
                links, kept_i, kept_j = np.zeros(n, np.int64), [], []
                for i, j in block_pairs(np.array([0]), np.array([n]), np.array([crossed]), part.column("second").to_numpy()):
                    k = survivors(sketch, i, j, least)
                    i, j = i[k], j[k]
                    for x in np.unique(i):
                        theirs = j[i == x]
                        marked[dense[x]] = True
                        both = np.add.reduceat(marked[np.concatenate([dense[y] for y in theirs])], np.r_[0, np.cumsum(sizes[theirs])[:-1]], dtype=np.int64)
                        marked[dense[x]] = False
                        linked = theirs[100 * both >= threshold_percent * (sizes[x] + sizes[theirs] - both)]
                        links[x] += copies[linked].sum()
                        links[linked] += copies[x]
                        kept_i.append(np.full(len(linked), x))
                        kept_j.append(linked)
                if not links.any():
                    continue
                label = forest(n, np.concatenate(kept_i), np.concatenate(kept_j))
                u, has = np.flatnonzero(label != np.arange(n)), np.flatnonzero(links)
                digest = part.column("digest").combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([digest.take(pa.array(u)), digest.take(pa.array(has))]),
                        pa.concat_arrays([digest.take(pa.array(label[u])), pa.nulls(len(has), pa.binary())]),
                        pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(links[has])]),
                    ],
                    names=["u", "v", "links"],
                )

    return dealt.mapInArrow(run, "u binary, v binary, links bigint")


def text_hash(text: Column) -> Column:
    """What a text is fetched by once its class is known; two texts may share it."""
    return F.xxhash64(text)


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold_percent: int = 80, tolerance: float = 1e-6) -> DataFrame:
    """One row for each document: `id_col`, class_id, n_links, n_shingles, copies.

    Documents are linked if the Jaccard similarity of their sets of `width`-word shingles is
    at least `threshold_percent` in 100. n_links counts the other documents that one is linked
    with; class_id is the least id that links connect it with, its own included. copies counts
    the documents with the same set. The bands suit thresholds of 80 percent and more.
    """
    if not 80 <= threshold_percent <= 100:
        raise ValueError("threshold_percent must be from 80 to 100")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.struct(F.col(id_col).alias("id"), text_hash(text).alias("h")).alias("id"), text.alias("text"))
    signed = cut(_sets(docs, width, True).select(F.col("id.id").alias("id"), F.col("id.h").alias("h"), "digest", "n", "bands", "sketch"), "signatures")
    first = lambda c: F.first(c).alias(c)
    classes = cut(
        signed.filter("n > 0").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.min("h").alias("h"), first("n"), first("bands"), first("sketch")), "classes"
    )
    grouped = cut(components(candidate_edges(classes, threshold_percent / 100, tolerance)).withColumnRenamed("node", "digest"), "groups")
    # the shingle sets of the classes in groups, each from one text
    held = classes.join(grouped, "digest").select("digest", "label", "copies", "n", "h", "sketch")
    held = cut(held, "held")
    # one text of each hash and second hash: should two texts share the first, both stay, and each class finds its own by the digest
    texts = docs.select(F.col("id.h").alias("h"), F.xxhash64(F.lit("second"), "text").alias("h2"), "text").join(broadcast_if_small(held.select("h"), BROADCAST_ROWS), "h", "left_semi").dropDuplicates(["h", "h2"])
    sets = _sets(texts.select(F.struct("h").alias("id"), "text"), width, False).select(F.col("id.h").alias("h"), F.col("digest").alias("d"), "shingles")
    per = held.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK), F.ceil(F.sum("n") / GROUP_SHINGLES)).alias("blocks"))
    placed = _blocks(held.drop("n").join(per, "label"), "label", "blocks")
    found = cut(verified(placed.join(sets, "h").filter("d = digest"), threshold_percent, tolerance), "verified")
    links = found.filter("v IS NULL").groupBy(F.col("u").alias("digest")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "digest")
    info = classes.select("digest", "copies", "least").join(links, "digest", "left").join(joined, "digest", "left")
    info = cut(info.select("digest", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "digest").alias("label"), "least"), "classes")
    info = info.join(info.groupBy("label").agg(F.min("least").alias("class_id")), "label").select("digest", "copies", "links", "class_id")
    out = signed.select("id", "digest", "n").join(info, "digest", "left")
    alone = F.col("digest").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("copies"),
    )


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
t AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT l.b, t.label FROM t JOIN l ON l.a = t.node),
m AS (SELECT node, min(label) AS class_id FROM t GROUP BY node),
e AS (SELECT doc_id, sha256(string_agg(s, chr(10) ORDER BY s)) AS e FROM g GROUP BY doc_id),
z AS (SELECT e, count(*) AS copies FROM e GROUP BY e)
SELECT d.doc_id, m.class_id, CAST(coalesce((SELECT count(*) FROM l WHERE l.a = d.doc_id), 0) AS BIGINT) AS n_links,
  CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(z.copies, 1) AS BIGINT) AS copies
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN z USING (e)
"""
}
