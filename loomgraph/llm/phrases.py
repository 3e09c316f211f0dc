"""Phrase collocation mining: weighted n-grams of distinct pieces, counted out of core by hash bucket.

Texts are cut into pieces (between marks of punctuation or line ends). Equal pieces of a language
become one row with a multiplicity, so copied documents and passages are counted once and weighed.
N-grams are summed over blocks of pieces, dealt by a hash of (language, n-gram) to buckets, and
each bucket is summed by duckdb, which spills within a memory limit, so that no bucket has to fit.

Counting goes by levels: words, then word pairs, then 3 to `longest` words. An n-gram can only be
frequent if its parts are, so a level leaves out what holds an infrequent word or pair: a bitmap
of the frequent ones, at most `FILTER_BITS` bits (32 MB), is broadcast. Its false hits only cost
work; where a corpus has more frequent n-grams than it can tell apart more of them travel, and the
counts stay exact at every size. Parts of candidates get their counts by lookup requests: each
(part, salt) is asked for once, so a word that begins a third of all phrases is no hot key.

Defined results: null text is empty, a null language is `und`; only ASCII letters change case;
repeated rows count each; scores are floors of exact decimals; ties have a total order; only the
named columns are read; an empty table gives an empty table; languages without a candidate have no
rows. Whole texts are read. Memory per task grows with one block or the longest single text.
The spill of duckdb is scratch of one task in its own temporary folder and goes with it; nothing
else is kept there.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..layout import spread
from .bpe import _binaries, _mix, _spread, distinct, piece_hashes
from .common import broadcast_if_small, cut, give_back, small_batches

#: Bytes of pieces that are counted together before anything travels.
BLOCK_BYTES = 4 << 20
#: Most bits of a broadcast bitmap.
FILTER_BITS = 1 << 28
BITS_PER_GRAM = 16
#: Memory of one bucket's duckdb; beyond it spills.
BUCKET_MEMORY = "256MB"
BUCKET_ROWS = 50_000
SALTS = 64
BROADCAST_ROWS = 1_000_000

# What ends a piece, and what ends a word, as bytes.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes(10 if b in PIECE_ENDS else 32 if b in BLANKS else b for b in range(256))


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, m, words): distinct pieces, words lower-cased and joined by single spaces, with their multiplicity and number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                texts = list(found)
                for k in range(0, len(texts), BUCKET_ROWS):
                    part = texts[k : k + BUCKET_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([found[p] for p in part], pa.int64()), pa.array([p.count(b" ") + 1 for p in part], pa.int64())],
                        names=["lang", "piece", "m", "words"],
                    )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                counts = held.setdefault(lang, {})
                for piece in text.lower().translate(_TABLE).split(b"\n"):
                    if words := piece.split():
                        key = b" ".join(words)
                        counts[key] = counts.get(key, 0) + 1
                size += len(text)
                if size > BLOCK_BYTES:
                    yield from rows()
                    held, size = {}, 0
        yield from rows()
        give_back()

    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = rows.mapInArrow(run, "lang string, piece string, m bigint, words bigint")
    return each.groupBy("lang", "piece").agg(F.sum("m").alias("m"), F.first("words").alias("words"))


def _seed(lang: str) -> np.uint64:
    one, _ = piece_hashes(np.frombuffer(lang.encode(), np.uint8), np.array([len(lang.encode())])) if lang else (np.zeros(1, np.uint64), None)
    return one[0]


class _Words:
    """The words of pieces side by side: where each starts and ends, how many its piece still has, and 128 bits of hash."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.ends = np.flatnonzero((self.data == 32) | (self.data == 10))
        self.starts = np.r_[0, self.ends[:-1] + 1]
        closing = np.flatnonzero(self.data[self.ends] == 10)
        self.piece = np.repeat(np.arange(len(texts)), np.diff(np.r_[-1, closing]))
        self.left = closing[self.piece] - np.arange(len(self.ends)) + 1
        plain = self.data.copy()
        plain[self.ends] = 32
        self.one, self.two = piece_hashes(plain, self.ends - self.starts + 1)

    def gram(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the `k` words from each of `at`."""
        one, two = self.one[at], self.two[at]
        for j in range(1, k):
            one, two = _mix(one * np.uint64(3) + self.one[at + j]), _mix(two * np.uint64(5) + self.two[at + j])
        return one, two

    def texts(self, at: np.ndarray, k: np.ndarray) -> pa.Array:
        lengths = self.ends[at + k - 1] - self.starts[at]
        return _binaries(_spread(self.data, self.starts[at], lengths), lengths).cast(pa.string())


def _bit(one: np.ndarray, seed: np.uint64, bits: int) -> np.ndarray:
    return _mix(one ^ seed) & np.uint64(bits - 1)


class Bitmap:
    """The broadcast bitmap of frequent n-grams: false hits, but no misses."""

    def __init__(self, grams: DataFrame, k: int):
        """`grams`: a written table (lang, gram) of n-grams of `k` words."""
        spark = grams.sparkSession
        wanted = BITS_PER_GRAM * max(grams.count(), 1 << 12)
        self.bits = bits = min(FILTER_BITS, 1 << (wanted - 1).bit_length())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, texts in _by_lang(batch.column(0), batch.column(1)):
                    words = _Words(texts)
                    at = np.arange(len(texts)) * k
                    place = _bit(words.gram(at, k)[0], _seed(lang), bits)
                    yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], names=["at", "set"])

        cells = grams.select("lang", "gram").mapInArrow(run, "at bigint, set bigint").groupBy("at").agg(F.bit_or("set").alias("set")).toArrow()  # at most bits / 64 rows
        held = np.zeros(bits >> 6, np.uint64)
        held[cells.column("at").to_numpy()] = cells.column("set").to_numpy().view(np.uint64)
        self.held = spark.sparkContext.broadcast(held)

    def has(self, one: np.ndarray, seed: np.uint64) -> np.ndarray:
        place = _bit(one, seed, self.bits)
        return (self.held.value[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "held": self.held}


def _by_lang(langs: pa.Array, texts: pa.Array, *others: pa.Array) -> Iterator[tuple]:
    """(lang, texts as bytes, the other columns as arrays) of a batch."""
    coded = langs.dictionary_encode()
    codes = coded.indices.to_numpy()
    values = texts.cast(pa.binary())
    for k, lang in enumerate(coded.dictionary.to_pylist()):
        at = np.flatnonzero(codes == k)
        yield (lang, values.take(pa.array(at)).to_pylist(), *(o.to_numpy()[at] for o in others))


def _local(words: _Words, weights: np.ndarray, lang: str, least: int, most: int, known: Bitmap | None) -> Iterator[pa.RecordBatch]:
    """(lang, gram, k, f) of one block: n-grams of `least` to `most` words, all of whose parts of `least` - 1 words `known` has."""
    part = max(least - 1, 1)
    fine = None
    if known is not None:
        fine = np.zeros(len(words.ends) + most, bool)
        at = np.flatnonzero(words.left >= part)
        fine[at] = known.has(words.gram(at, part)[0], _seed(lang))
    for k in range(least, most + 1):
        mark = words.left >= k
        if fine is not None:
            for j in range(k - part + 1):
                mark &= fine[j : j + len(mark)]
        at = np.flatnonzero(mark)
        if not len(at):
            break  # nor is anything longer
        place, number = distinct(*words.gram(at, k))
        sums = np.zeros(len(place), np.int64)
        np.add.at(sums, number, weights[words.piece[at]])
        for first in range(0, len(place), BUCKET_ROWS):
            some = place[first : first + BUCKET_ROWS]
            grams = words.texts(at[some], np.full(len(some), k))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), grams, pa.array(np.full(len(some), k, np.int32)), pa.array(sums[first : first + BUCKET_ROWS])], names=["lang", "gram", "k", "f"])


GRAMS = "lang string, gram string, k int, f bigint"


def _bucket(min_count: int):
    """Sums one bucket's rows in duckdb, which spills beyond `BUCKET_MEMORY`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        first = next(iter(batches), None)
        if first is None:
            return

        def rows() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": BUCKET_MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as con:
            partial = pa.RecordBatchReader.from_batches(first.schema, rows())  # noqa: F841, read by the statement
            found = con.sql(f"SELECT lang, gram, any_value(k) AS k, CAST(sum(f) AS BIGINT) AS f FROM partial GROUP BY lang, gram HAVING sum(f) >= {int(min_count)}")
            yield from found.to_arrow_reader(BUCKET_ROWS)
        give_back()

    return run


def counted(distinct_pieces: DataFrame, least: int, most: int, min_count: int, known: Bitmap | None = None) -> DataFrame:
    """(lang, gram, k, f) of n-grams of `least` to `most` words that occur `min_count` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, (texts, weights) in held.items():
                yield from _local(_Words(texts), np.concatenate(weights), lang, least, most, known)

        for batch in batches:
            for lang, texts, m in _by_lang(batch.column(0), batch.column(1), batch.column(2)):
                kept = held.setdefault(lang, ([], []))
                kept[0].extend(texts)
                kept[1].append(m)
                size += sum(map(len, texts))
            if size > BLOCK_BYTES:
                yield from rows()
                held, size = {}, 0
        yield from rows()
        give_back()

    rows = distinct_pieces.filter(F.col("words") >= least).select("lang", "piece", "m").mapInArrow(run, GRAMS)
    return rows.repartition("lang", "gram").mapInArrow(_bucket(min_count), GRAMS)


def frequent(distinct_pieces: DataFrame, longest: int = 5, min_count: int = 100) -> DataFrame:
    """(lang, gram, k, f): all n-grams of one to `longest` words that occur `min_count` times or more, words joined by spaces. `distinct_pieces`: a written table."""
    words = cut(counted(distinct_pieces, 1, 1, min_count), "words")
    out = words
    if longest > 1:
        pairs = cut(counted(distinct_pieces, 2, 2, min_count, Bitmap(words, 1)), "pairs")
        out = out.unionByName(pairs)
    if longest > 2:
        out = out.unionByName(cut(counted(distinct_pieces, 3, longest, min_count, Bitmap(pairs, 2)), "grams"))
    return out


def _slice(words: str, first: Column | int, size: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.array_join(F.slice(words, lit(first), lit(size)), " ")


def closed(grams: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases of `grams` (two words or more) but those inside a longer one that has at least `percent` of their occurrences."""
    phrases = grams.filter("k > 1").withColumn("w", F.split("gram", " "))
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda s: F.transform(F.sequence(F.lit(1), F.col("k") - s + 1), lambda i: _slice("w", i, s))))
    longer = phrases.filter("k > 2").select("lang", F.explode(F.array_distinct(parts)).alias("gram"), "f").groupBy("lang", "gram").agg(F.max("f").alias("longer"))
    kept = phrases.join(longer, ["lang", "gram"], "left")
    return kept.filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(percent) * F.col("f"))).select("lang", "gram", "k", "f", "w")


def scored(phrases: DataFrame, grams: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of `phrases` (lang, gram, k, f, w): the lowest-scoring cut of each into two parts, the first of equals. `totals`: (lang, n)."""
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda j: F.struct(j.alias("j"), _slice("w", 1, j).alias("first"), _slice("w", j + 1, F.col("k") - j).alias("rest")))
    each = phrases.select("lang", "gram", F.col("f").alias("a"), F.explode(cuts).alias("c"))
    sides = F.array(F.struct(F.lit(True).alias("left"), F.col("c.first").alias("part")), F.struct(F.lit(False).alias("left"), F.col("c.rest").alias("part")))
    asked = each.select("lang", "gram", "a", F.col("c.j").alias("j"), F.pmod(F.xxhash64("gram"), F.lit(SALTS)).alias("salt"), F.explode(sides).alias("s")).select("lang", "gram", "a", "j", "salt", "s.left", "s.part")
    asked = cut(asked, "asked")
    requests = asked.select("lang", "part", "salt").distinct()
    answers = requests.join(grams.select("lang", F.col("gram").alias("part"), F.col("f").alias("count")), ["lang", "part"])
    both = asked.join(answers, ["lang", "part", "salt"]).groupBy("lang", "gram", "a", "j")
    both = both.agg(F.max(F.when(F.col("left"), F.col("count"))).alias("l"), F.max(F.when(~F.col("left"), F.col("count"))).alias("r"))
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    exact = F.expr(f"CAST(({wide('a')} * CAST(1000 AS DECIMAL(4,0)) * {wide('n')}) div ({wide('l')} * {wide('r')}) AS BIGINT)")
    with_n = both.join(broadcast_if_small(totals, BROADCAST_ROWS), "lang")  # a row a language
    lowest = with_n.groupBy("lang", "gram").agg(F.min(F.struct(exact.alias("score"), "j", "a", "l", "r", "n")).alias("b"))
    return lowest.select("lang", F.col("gram").alias("phrase"), "b.a", "b.l", "b.r", "b.n", "b.score")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 5, min_count: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by score, then count, then phrase."""
    found = cut(pieces(docs, text_col, lang_col), "pieces")
    totals = cut(found.groupBy("lang").agg(F.sum(F.col("m") * F.col("words")).alias("n")), "totals")
    grams = frequent(found, longest, min_count)
    rows = scored(closed(grams, percent), grams, totals)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    # the best of each salt first: no language's phrases meet in one task
    best = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    out = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


SQL = {
    "op12_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(x, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x FROM documents)
), n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
f AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM i, (VALUES (1), (2), (3), (4), (5)) x(k)
  WHERE i + k - 1 <= len(w) GROUP BY lang, k, phrase HAVING count(*) >= 100
), c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
b AS (
  SELECT lang, array_to_string(w[s : s + j - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, a, w, k, j, unnest(range(1, k - j + 2)) AS s FROM c, (VALUES (2), (3), (4)) x(j) WHERE j < k) GROUP BY 1, 2
), d AS (SELECT c.* FROM c LEFT JOIN b USING (lang, phrase) WHERE b.longer IS NULL OR 100 * b.longer < 100 * c.a),
s AS (
  SELECT d.lang, d.phrase, a, j, l.f AS l, r.f AS r, n, (1000 * CAST(a AS HUGEINT) * CAST(n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM d) d JOIN f l ON l.lang = d.lang AND l.phrase = array_to_string(w[1 : j], ' ')
  JOIN f r ON r.lang = d.lang AND r.phrase = array_to_string(w[j + 1 : d.k], ' ') JOIN n ON n.lang = d.lang
), m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM t WHERE rank <= 2000
"""
}
