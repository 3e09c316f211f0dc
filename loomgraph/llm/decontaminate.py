"""Benchmark decontamination with a distributed positional inverted index.

The index holds a posting (term, document, position) for each word of the training documents
that the benchmark knows, and one end posting a document at the position that counts its
words. Of every benchmark window the two rarest terms are looked up; a posting at position p
of a term at place q of an item speaks for the diagonal p - q, so lists are intersected by
grouping on (document, item, diagonal). The few diagonals that survive are compared word for
word with the index, and runs of matching words as long as a window are exact phrase matches.

DataFrame operations only. Defined results: null texts have no words; items without words
match nothing; rows that repeat an id and text give one row each with the same result; rows
with one id and several texts are documents of their own; null ids are kept; only the id and
text columns are read. The benchmark side is broadcast only if counting shows it small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..layout import spread
from .common import broadcast_if_small, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters, after lower-casing, that are in no word.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = ""
#: Most rows of a table that is broadcast: about 50 MB.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Words of a text in order: A-Z lower-cased, runs of a-z, 0-9 and all beyond ASCII."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, BETWEEN), END)


def item_terms(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row for each word of each item: item_id (string), item (key), n, q (place), term."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    rows = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), key.alias("item"), words(F.col(text_col)).alias("w")).dropDuplicates(["item_id", "item"])
    return rows.select("item_id", "item", F.size("w").alias("n"), F.posexplode("w").alias("q", "term"))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (tid, doc_id, h, pos) of the words that occur in `terms` (term, tid), stored in the shared folder.

    tid -1 is the end of a document. h is a hash of the text: with the id it names the document.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.array_append(words(text), F.lit(END)).alias("w"))
    exploded = rows.select("doc_id", "h", F.posexplode("w").alias("pos", "term"))
    known = broadcast_if_small(terms, BROADCAST_ROWS)
    return cut(exploded.join(known, "term").select("tid", "doc_id", "h", "pos"), "postings")


def numbered_terms(places: DataFrame) -> DataFrame:
    """(term, tid) of the benchmark's words, with the end posting."""
    found = places.select("term").distinct().withColumn("tid", F.xxhash64("term").bitwiseAND(F.lit((1 << 62) - 1)))
    return found.unionByName(found.sparkSession.range(1).select(F.lit(END).alias("term"), F.lit(-1).cast("bigint").alias("tid")))


def rarest_places(places: DataFrame, index: DataFrame, window: int, keep: int = 2, absent: bool = False) -> DataFrame:
    """The places (item, q, tid) of the `keep` rarest terms of every window, and how many an item needs.

    Windows with a term that no document has are left out; with `absent` such terms are passed over and the window stays.
    """
    frequency = index.filter("tid >= 0").groupBy("tid").count()
    known = places.join(broadcast_if_small(cut(frequency, "frequency"), BROADCAST_ROWS), "tid", "left")
    start = F.explode(F.sequence(F.greatest(F.lit(0), F.col("q") - (window - 1)), F.least(F.col("q"), F.greatest(F.lit(0), F.col("n") - window))))
    placed = known.select("item_id", "item", "n", "q", "tid", "count", start.alias("at"))
    of_window = Window.partitionBy("item_id", "item", "at")
    ranked = placed.withColumn("lost", F.max(F.col("count").isNull()).over(of_window)).withColumn("r", F.row_number().over(of_window.orderBy(F.asc_nulls_last("count"), "q")))
    whole = F.col("count").isNotNull() if absent else ~F.col("lost")
    return ranked.filter(whole & (F.col("r") <= keep)).select("item_id", "item", "n", "q", "tid", "at", "r")


def candidates(index: DataFrame, rare: DataFrame, keep: int = 2) -> DataFrame:
    """(doc_id, h, item_id, item, n, d): diagonals on which the lists of enough rare terms of an item meet."""
    lists = rare.select("item_id", "item", "n", "q", "tid").distinct()
    hits = index.join(broadcast_if_small(cut(lists, "rare"), BROADCAST_ROWS), "tid").withColumn("d", F.col("pos") - F.col("q"))
    # n - 1 and less: an item of one word has but one place
    met = hits.groupBy("doc_id", "h", "item_id", "item", "n", "d").agg(F.min("q").alias("first"), F.max("q").alias("last"))
    return met.filter((F.col("first") < F.col("last")) | (F.col("n") < keep)).drop("first", "last")


def phrase_matches(docs: DataFrame, bench: DataFrame, window: int = 13, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(matches, index): exact phrase matches (doc_id, h, item_id, item, start, end), in words, end exclusive, each at least a window or a whole shorter item."""
    if window < 2:
        raise ValueError("window must be at least 2")
    places = cut(item_terms(bench, item_id, item_text), "places")
    terms = cut(numbered_terms(places), "terms")
    places = places.join(terms, "term").drop("term")
    index = build_index(docs, terms, doc_id, doc_text)
    rare = rarest_places(places, index, window)
    found = cut(candidates(index, rare), "candidates")
    return exact_runs(found, places, index, window), index


def exact_runs(found: DataFrame, places: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """Runs of words of an item, as long as a window or the whole item, that the index has on the diagonal."""
    owners = cut(found.select(F.col("doc_id").alias("owner"), F.col("h").alias("owner_h")).distinct(), "owners")
    same = F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("h") == F.col("owner_h"))
    theirs = index.join(broadcast_if_small(owners, BROADCAST_ROWS), same, "left_semi").distinct().select(F.col("tid").alias("t"), F.col("doc_id").alias("owner"), F.col("h").alias("owner_h"), "pos")
    expected = found.join(places.select("item_id", "item", "q", "tid"), ["item_id", "item"]).withColumn("p", F.col("d") + F.col("q"))
    hit = expected.join(theirs, same & (F.col("p") == F.col("pos")) & (F.col("tid") == F.col("t")))
    line = ["doc_id", "h", "item_id", "item", "n", "d"]
    run = F.col("q") - F.row_number().over(Window.partitionBy(*line).orderBy("q"))
    runs = hit.select(*line, "q").withColumn("run", run).groupBy(*line, "run").agg(F.min("q").alias("a"), F.max("q").alias("b"))
    long = F.col("b") - F.col("a") + 1 >= F.least(F.lit(window), F.col("n"))
    return runs.filter(long).select("doc_id", "h", "item_id", "item", (F.col("d") + F.col("a")).alias("start"), (F.col("d") + F.col("b") + 1).alias("end"))


def proximity_matches(docs: DataFrame, bench: DataFrame, slop: int, window: int = 13, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, h, item_id, item, at, near): windows whose two rarest terms occur within `slop` words of their distance in the window; near is the least deviation.

    The terms are chosen among those that some document has, so a passage with one word replaced
    is still found; a window with fewer than two such places matches nothing. An item of one word
    matches, with near 0, every document that has the word.
    """
    places = cut(item_terms(bench, item_id, item_text), "places")
    terms = cut(numbered_terms(places), "terms")
    places = places.join(terms, "term").drop("term")
    index = build_index(docs, terms, doc_id, doc_text)
    of_window = rarest_places(places, index, window, absent=True).groupBy("item_id", "item", "n", "at").pivot("r", [1, 2]).agg(F.first("q").alias("q"), F.first("tid").alias("tid"))
    of_window = cut(of_window.filter("n = 1 OR `2_q` IS NOT NULL").withColumn("q2", F.coalesce("2_q", "1_q")).withColumnRenamed("1_q", "q1"), "rare")
    # neighbouring windows have most pairs of places in common: a pair is looked up once
    pair = ["item_id", "item", "q1", "q2"]
    sides = [F.struct(F.lit(r).alias("r"), F.col(f"q{r}").alias("q"), F.col(f"{r}_tid").alias("tid")) for r in (1, 2)]
    rare = cut(of_window.select(*pair, F.explode(F.array(*sides)).alias("s")).select(*pair, "s.r", "s.q", "s.tid").filter("tid IS NOT NULL").distinct(), "pairs")
    hits = index.distinct().join(broadcast_if_small(rare, BROADCAST_ROWS), "tid").select("doc_id", "h", *pair, "r", (F.col("pos") - F.col("q")).alias("d"))
    cell = F.floor(F.col("d") / (slop + 1)).cast("long")
    left = hits.filter("r = 1 AND q1 <> q2").withColumn("cell", cell)
    right = hits.filter("r = 2").withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1))).withColumnRenamed("d", "d2").drop("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("doc_id", "h", *pair, "cell")]
    deviation = F.abs(F.col("l.d") - F.col("r.d2"))
    met = left.alias("l").join(right.alias("r"), on).filter(deviation <= slop).select(*(F.col(f"l.{c}").alias(c) for c in ("doc_id", "h", *pair)), deviation.alias("near"))
    alone = hits.filter("q1 = q2").select("doc_id", "h", *pair, F.lit(0).alias("near"))
    near = met.unionByName(alone).groupBy("doc_id", "h", *pair).agg(F.min("near").alias("near"))
    return near.join(broadcast_if_small(of_window.select(*pair, "at"), BROADCAST_ROWS), pair).select("doc_id", "h", "item_id", "item", "at", "near")


def contamination(docs: DataFrame, bench: DataFrame, window: int = 13, min_share: int = 20, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each document: `doc_id`, h, n_words, n_hit (words inside a match), item_ids (sorted strings), contaminated.

    contaminated: some word is hit, and at least one in `min_share` words.
    """
    matches, index = phrase_matches(docs, bench, window, doc_id, doc_text, item_id, item_text)
    matches = cut(matches, "matches")
    ordered = Window.partitionBy("doc_id", "h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(ordered), F.lit(0)))
    hit = matches.select("doc_id", "h", "start", "end").distinct().withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("doc_id", "h").agg(F.sum("fresh").alias("n_hit"))
    items = matches.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    hit = hit.select(F.col("doc_id").alias("a"), F.col("h").alias("b"), "n_hit")
    items = items.select(F.col("doc_id").alias("c"), F.col("h").alias("e"), "item_ids")
    found = hit.join(items, F.col("a").eqNullSafe(F.col("c")) & (F.col("b") == F.col("e")))
    ends = index.filter("tid = -1").select("doc_id", "h", F.col("pos").cast("long").alias("n_words"))
    out = ends.join(found, F.col("doc_id").eqNullSafe(F.col("a")) & (F.col("h") == F.col("b")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        F.col("doc_id").alias(doc_id),
        "h",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * min_share >= F.col("n_words"))).alias("contaminated"),
    )


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(spread(docs), bench).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op8_proximity(spark, sf_dir: str, slop: int = 2) -> DataFrame:
    """The other half of the method: a row for each document and window of an item that are near by `proximity_matches`."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return proximity_matches(docs, bench, slop)


SQL = {
    "op8_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s + 1 : s + least(13, len(w))], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)
), p AS (
  SELECT doc_id, k, s, array_to_string(w[s + 1 : s + k], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS s FROM d, (SELECT DISTINCT k FROM g))
), m AS (SELECT doc_id, k, s, item_id FROM p JOIN g USING (k, phrase)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
}
