"""Quality rules by suffix-array repetition.

For every text a suffix array over its words is built by prefix doubling, many texts at a
time. Longest common prefixes of neighbours in that array form intervals; those whose suffixes
are not all preceded by one word are the maximal repeated substrings. The union of their spans
gives the covered fraction, the longest of them the longest repeat. Both are limited. The spans
of an interval lie within those of the intervals inside it but for the suffixes that have none,
so the union takes each suffix's deepest interval only.

Defined results: null text has no words; a text without words has no repeats and covered
fraction 0; repeated input rows give one row each; only the id and text columns are read, so
extra columns of any name do no harm; an empty table gives an empty table. Memory per task
grows with one chunk of texts, or with the longest single text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..layout import spread
from .common import ASCII_SPACE, id_and_text, id_field, map_chunks

SYMBOLS = b"#*$%&|<>"


def common_prefixes(words: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, slots, lengths): where neighbours of the suffix array, at a slot and the next, begin with the same `min_words` words or more of one document, and with how many.

    words: word numbers, doc: ascending document numbers, both over concatenated documents.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < 2:
        return np.arange(n), none, none
    ends = np.searchsorted(doc, doc, "right")
    key = doc * (int(words.max()) + 1) + words
    sa = np.argsort(key, kind="stable")
    first = np.r_[True, np.diff(key[sa]) != 0]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, k = [rank.copy()], 1  # levels[j]: equal ranks mean equal prefixes of 2**j words
    slots = np.arange(n)
    while True:
        # only suffixes whose prefix of k words is not unique are sorted again
        tied = ~first[slots]
        tied[:-1] |= tied[1:].copy()
        slots = slots[tied]
        if not len(slots):
            break
        at = sa[slots]
        then = at + k
        inside = then < ends[at]
        second = np.where(inside, rank[np.where(inside, then, 0)] + 1, 0)
        head = rank[at]
        order = np.lexsort((second, head))
        at, head, second = at[order], head[order], second[order]
        sa[slots] = at
        new = np.r_[True, (np.diff(head) != 0) | (np.diff(second) != 0)]
        first[slots] = new
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        k *= 2
        levels.append(rank.copy())
    # neighbours that share the largest power of two up to min_words can share min_words
    start = min(len(levels) - 1, max(0, min_words.bit_length() - 1))
    if 1 << start > min_words or min_words >= 2 << start:
        return sa, none, none  # no prefix that long occurs twice
    slots = np.flatnonzero(levels[start][sa[:-1]] == levels[start][sa[1:]])
    left, right = sa[slots], sa[slots + 1]
    lcp = np.zeros(len(left), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        a, b = left + lcp, right + lcp
        inside = (a < ends[left]) & (b < ends[right])
        same = inside & (levels[j][np.where(inside, a, 0)] == levels[j][np.where(inside, b, 0)])
        lcp += same << j
    keep = lcp >= min_words
    return sa, slots[keep], lcp[keep]


def repeat_lengths(words: np.ndarray, doc: np.ndarray, min_words: int) -> np.ndarray:
    """For each position the words of its longest match elsewhere in its document, 0 below `min_words`: the length of the deepest interval that holds its suffix."""
    return _deepest(len(words), *common_prefixes(words, doc, min_words))


def _deepest(n: int, sa: np.ndarray, slots: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    best = np.zeros(n, np.int64)
    np.maximum.at(best, sa[slots], lcp)
    np.maximum.at(best, sa[slots + 1], lcp)
    return best


def lcp_intervals(slots: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, first, last) of each interval of the suffix array: the suffixes from slot first to last share that many words, no neighbour shares as many, and two of them no more."""
    lengths, firsts, lasts = [], [], []
    open_lengths, open_firsts, before = [], [], -2
    for slot, length in zip(slots.tolist(), lcp.tolist()):
        if slot != before + 1:  # the run of common prefixes ended
            lengths += open_lengths
            firsts += open_firsts
            lasts += [before + 1] * len(open_lengths)
            open_lengths, open_firsts = [], []
        first = slot
        while open_lengths and open_lengths[-1] > length:
            lengths.append(open_lengths.pop())
            first = open_firsts.pop()
            firsts.append(first)
            lasts.append(slot)
        if not open_lengths or open_lengths[-1] < length:
            open_lengths.append(length)
            open_firsts.append(first)
        before = slot
    lengths += open_lengths
    firsts += open_firsts
    lasts += [before + 1] * len(open_lengths)
    return np.array(lengths, np.int64), np.array(firsts, np.int64), np.array(lasts, np.int64)


def maximal_repeats(words: np.ndarray, doc: np.ndarray, sa: np.ndarray, slots: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, copies, position of one copy) of each maximal repeat: an interval whose copies are not all preceded by one same word, so that none can be made longer on either side."""
    length, first, last = lcp_intervals(slots, lcp)
    if not len(length):
        return length, length, length
    before = sa - 1
    starts = np.r_[True, doc[1:] != doc[:-1]]
    # the word before each suffix, a number of its own where a document starts
    word = np.where(starts[sa], -1 - sa, words[np.maximum(before, 0)])
    changes = np.cumsum(np.r_[0, word[1:] != word[:-1]])
    keep = changes[last] > changes[first]
    return length[keep], (last - first + 1)[keep], sa[first[keep]]


def span_starts(best: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Positions whose longest repeat no repeat from the word before contains: their spans are the union of all."""
    if not len(best):
        return np.zeros(0, np.int64)
    before = np.r_[0, np.where(doc[1:] == doc[:-1], best[:-1], 0)]
    return np.flatnonzero((best > 0) & (best >= before))


def _measure(texts: list[bytes], min_words: int) -> dict[str, list | np.ndarray]:
    numbers: dict[bytes, int] = {}
    flat: list[int] = []
    counts, symbols, doubled, chars = [], [], [], []
    for text in texts:
        words = text.split()
        flat += [numbers.setdefault(w, len(numbers)) for w in words]
        counts.append(len(words))
        symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
        lines = [x for x in text.split(b"\n") if x.strip()]
        doubled.append(len(lines) - len(set(lines)))
        chars.append(len(text.decode("utf-8", "replace")) - len(text) + len(text.translate(None, ASCII_SPACE)))
    n_words = np.array(counts, np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    number = np.array(flat, np.int64)
    prefixes = common_prefixes(number, doc, min_words)
    best = _deepest(len(flat), *prefixes)
    starts = span_starts(best, doc)
    _, copies, where = maximal_repeats(number, doc, *prefixes)
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, doc[where], copies)
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + best[starts], 1)
    covered = np.cumsum(edge)[:-1] > 0
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc[starts], best[starts])
    step = np.diff(np.r_[0, covered.astype(np.int8), 0])
    # a covered run that crosses into the next document is two spans
    joint = np.flatnonzero(covered[1:] & covered[:-1] & (doc[1:] != doc[:-1])) + 1 if len(flat) else np.zeros(0, np.int64)
    begin = np.sort(np.r_[np.flatnonzero(step == 1), joint])
    end = np.sort(np.r_[np.flatnonzero(step == -1), joint])
    base = np.r_[0, np.cumsum(n_words)]
    owner = doc[begin] if len(begin) else np.zeros(0, np.int64)
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": doubled,
        "n_covered_words": np.bincount(doc[covered], minlength=len(texts)) if len(flat) else np.zeros(len(texts), np.int64),
        "longest_repeat": longest,
        "n_maximal_repeats": np.bincount(doc[where], minlength=len(texts)) if len(where) else np.zeros(len(texts), np.int64),
        "most_copies": most,
        "spans": (np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))], begin - base[owner], end - base[owner]),
    }


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 8) -> DataFrame:
    """Word, line and symbol counts of each text, with the union of its repeated word spans.

    Returns `id_col`, n_words, word_chars, n_symbols, n_dup_lines, n_covered_words (words inside a
    substring of at least `min_words` words that occurs twice), longest_repeat (words),
    n_maximal_repeats (different substrings of that length or more that occur twice and cannot be
    made longer), most_copies (of one of them) and repeat_spans (the union, as [start, end) in words).
    """
    if min_words < 1:
        raise ValueError("min_words must be at least 1")
    rows = id_and_text(df, id_col, text_col)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_covered_words", "longest_repeat", "n_maximal_repeats", "most_copies"]
    schema = T.StructType([id_field(rows, id_col), *(T.StructField(c, T.LongType()) for c in counts), T.StructField("repeat_spans", T.ArrayType(span))])

    def work(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        found = _measure(texts, min_words)
        offsets, begin, end = found["spans"]
        spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["start", "end"]))
        return pa.RecordBatch.from_arrays([ids, *(pa.array(found[c], pa.int64()) for c in counts), spans], names=schema.names)

    return map_chunks(rows, work, schema)


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 8,
    min_doc_words: int = 20,
    max_covered_percent: int = 30,
    max_repeat_words: int = 100,
) -> DataFrame:
    """`repetition` with verdicts: base_failed (too short, or too much of it repeated), long_repeat, and kept.

    kept is false if the text is too short, if repeats cover more than `max_covered_percent` of
    its words, or if one repeat is longer than `max_repeat_words`.
    """
    covered = F.lit(100) * F.col("n_covered_words") > F.lit(max_covered_percent) * F.col("n_words")
    return (
        repetition(df, id_col, text_col, min_words)
        .withColumn("base_failed", (F.col("n_words") < min_doc_words) | covered)
        .withColumn("long_repeat", F.col("longest_repeat") > max_repeat_words)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("long_repeat"))
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.col("n_covered_words").alias("n_repeat_words"), "base_failed", "kept", "long_repeat"
    )


SQL = {
    "op1_quality_rules": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents
), p AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 8], ' ') AS g FROM p WHERE i + 8 <= len(w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM r) GROUP BY doc_id),
l AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(w[i + 1 : i + 101], ' ') AS g FROM p JOIN r USING (doc_id, i) WHERE i + 101 <= len(w)) GROUP BY doc_id, g HAVING count(*) > 1),
m AS (SELECT doc_id, t, w, lines, coalesce(c.n, 0) AS n, l.doc_id IS NOT NULL AS long_repeat FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(n AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * n > 30 * len(w) AS base_failed, NOT (len(w) < 20 OR 100 * n > 30 * len(w)) AND NOT long_repeat AS kept, long_repeat
FROM m
"""
}
