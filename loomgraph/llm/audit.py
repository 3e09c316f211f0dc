"""Filter interaction audit by a subset-zeta transform.

Each document has a mask of the filters that it fails. Per part only the counts of the masks are
summed, at most 2 ** filters rows a part, documents, good ones and toxic ones alike. The zeta
transform of these counts over subsets gives the survivors of every set of filters, and each
figure of each step of each order is a difference between the survivors of neighbouring sets: no
order is ever run over documents.

A copy is a document whose text some smaller id has too. Of each text only a digest and its least
id travel; a document looks its text up by (digest, id), so a text that a third of all documents
share is no hot key.

Defined results: null text is empty; a null part is the empty string; a document with a null id
has no smaller id and is smaller than none, and has no labels; rows that repeat an id and a text
count each, and none is a copy of the other; of several labels of one id any that is 1 counts; an
empty table gives an empty table; only the named columns are read, whatever others are called.
Whole texts are read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..layout import spread
from .common import cut

COUNTS = ("docs", "good", "toxic")


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def text_filters(text: Column, min_words: int = 50, min_distinct_percent: int = 65, max_upper_percent: int = 5, symbols: str = "#$%&*|") -> dict[str, Column]:
    """Failure conditions by letter: A too few words, B too few distinct ones, C too many ASCII capitals, D any of `symbols`."""
    words = words_of(text)
    return {
        "A": F.size(words) < min_words,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(min_distinct_percent) * F.size(words),
        "C": F.lit(100) * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > F.lit(max_upper_percent) * F.length(text),
        "D": F.length(F.translate(text, symbols, "")) < F.length(text),
    }


def _bits(names: list[str], fails: dict[str, Column]) -> Column:
    out = F.lit(0)
    for k, name in enumerate(names):
        if name in fails:
            out = out + F.when(fails[name], 1 << k).otherwise(0)
    return out


def masks(docs: DataFrame, labels: DataFrame, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", **limits) -> tuple[DataFrame, list[str]]:
    """((part, mask, docs, good, toxic), names): counts of documents by the filters that they fail, bit k for names[k]. `copies` is the letter of the filter that fails copies."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = text_filters(F.col("t"), **limits)
    names = sorted([*fails, copies])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    # texts are read once; what stays of a document is an id, a part, a mask and a digest
    each = cut(rows.select("id", "part", _bits(names, fails).alias("mask"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest")), "masks")
    known = each.filter("id IS NOT NULL").groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("docs"))
    least = each.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.select(F.col(id_col).alias("id"), "quality", "toxic").filter("id IS NOT NULL").groupBy("id").agg(one("quality").alias("good"), one("toxic").alias("bad"))
    bit = 1 << names.index(copies)
    judged = known.join(least, ["digest", "id"], "left").join(marks, "id", "left").select(
        "part",
        (F.col("mask") + F.when(F.col("first").isNull(), bit).otherwise(0)).alias("mask"),
        "docs",
        F.when(F.col("good") == 1, F.col("docs")).otherwise(F.lit(0)).alias("good"),
        F.when(F.col("bad") == 1, F.col("docs")).otherwise(F.lit(0)).alias("toxic"),
    )
    nameless = each.filter("id IS NULL").select("part", "mask", F.lit(1).alias("docs"), F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    counts = judged.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(c).cast("long").alias(c) for c in COUNTS))
    return counts, names


def survivors(counts: DataFrame, filters: int) -> DataFrame:
    """(part, docs, good, toxic): arrays by set of filters (bit k: filter k) of what passes all of the set.

    A document passes a set if its mask shares no bit with it, so the survivors of a set are the
    zeta transform of the counts at the set's complement.
    """
    size = 1 << filters
    at = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS).alias("n"))))  # at most `size` entries
    out = counts.groupBy("part").agg(at.alias("at"))

    def count_of(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.element_at("at", m)[name], F.lit(0).cast("long")))

    def with_bit(name: str, bit: int) -> Column:
        return F.transform(name, lambda x, i: x + F.when(i.bitwiseAND(F.lit(bit)) != 0, F.get(F.col(name), i - bit)).otherwise(F.lit(0).cast("long")))

    out = out.select("part", *(count_of(c).alias(c) for c in COUNTS))
    for k in range(filters):
        out = out.select("part", *(with_bit(c, 1 << k).alias(c) for c in COUNTS))
    return out.select("part", *(F.reverse(c).alias(c) for c in COUNTS))


def audit(counts: DataFrame, names: list[str]) -> DataFrame:
    """One row a part, order of the filters `names` (single letters) and step, with kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (summed over all orders)."""
    n = len(names)
    every = (1 << n) - 1
    steps = []
    for order in permutations(range(n)):
        name, before = "".join(names[k] for k in order), 0
        for step, k in enumerate(order):
            steps.append((name, step + 1, k, 1 << k, before, before | 1 << k))
            before |= 1 << k
    fields = ("filter_order", "step", "filter", "single", "before", "after")
    plan = F.from_json(F.lit("[" + ",".join('{"filter_order":"%s","step":%d,"filter":%d,"single":%d,"before":%d,"after":%d}' % s for s in steps) + "]"), "array<struct<filter_order:string,step:int,filter:int,single:int,before:int,after:int>>")
    held = survivors(counts, n)
    # figures of a filter in any order: once a part, not once an order
    weight = lambda s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())
    docs = lambda s: F.get(F.col("docs"), F.lit(s))
    shapley = [sum((F.lit(weight(s)) * (docs(s) - docs(s | 1 << k)) for s in range(every + 1) if not s >> k & 1), F.lit(0)).cast("long") for k in range(n)]
    alone = [docs(every ^ 1 << k) - docs(every) for k in range(n)]
    held = held.withColumn("shapleys", F.array(*shapley)).withColumn("alone", F.array(*alone)).withColumn("plan", plan)
    rows = held.select("part", *COUNTS, "shapleys", "alone", F.explode("plan").alias("s")).select("part", *COUNTS, "shapleys", "alone", *(F.col(f"s.{f}").alias(f) for f in fields))
    lost = lambda c: F.get(F.col(c), F.col("before")) - F.get(F.col(c), F.col("after"))
    fails = F.get(F.col("docs"), F.lit(0)) - F.get(F.col("docs"), F.col("single"))
    return rows.select(
        "part", "filter_order", "step",
        F.get(F.col("docs"), F.col("after")).alias("kept"),
        lost("docs").alias("removed"),
        (fails - lost("docs")).alias("redundant"),
        F.get(F.col("alone"), F.col("filter")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get(F.col("shapleys"), F.col("filter")).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return audit(*masks(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


SQL = {
    "op11_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)
), c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) x(i)),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string([substr('ABCDE', i, 1) FOR i IN o], '') AS filter_order, x.i AS step, o[x.i] AS f, o[1 : x.i - 1] AS earlier FROM o, x),
r AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT fails[f] AND len([i FOR i IN earlier IF fails[i]]) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails[f] AND len([i FOR i IN earlier IF fails[i]]) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails[f] AND len([i FOR i IN earlier IF fails[i]]) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails[f] AND len([i FOR i IN fails IF i]) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails[f] AND len([i FOR i IN earlier IF fails[i]]) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails[f] AND len([i FOR i IN earlier IF fails[i]]) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
"""
}
