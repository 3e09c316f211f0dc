"""Corpus engineering: quality gate, duplicates, decontamination, splits, reports, audits."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..scratch import cut
from . import tokens as TK
from .iterate import star_components
from .pairs import give_back, small_batches
from .similarity import shingle_pairs, simhash_pairs


def gate_reason(text: Column, min_chars: int = 20, min_ratio: float = 0.35, script: str = K.ARABIC_BLOCK) -> Column:
    """The first rule that a text fails (empty, too_short, low_script_ratio), null if none."""
    c = F.coalesce(text, F.lit(""))
    return _verdict(F.length(X.collapse_space(c)), X.script_ratio(c, script), min_chars, min_ratio)


def _verdict(n: Column, ratio: Column, min_chars: int, min_ratio: float) -> Column:
    return F.when(n == 0, "empty").when(n < min_chars, "too_short").when(ratio < min_ratio, "low_script_ratio")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, first_id): documents by hash key with the least id of the same key. Sums only; no hot key is gathered."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), X.text_hash(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    return keyed.join(keyed.groupBy("text_hash").agg(F.min("doc_id").alias("first_id")), "text_hash").select("doc_id", "text_hash", "first_id")


#: Pairs of nodes that one task settles; it holds about 150 bytes for each.
GROUP_PAIRS = 2_000_000


def _settled(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, accepted) of pairs (src < dst), node by node in their order."""
    nodes, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = place[: len(src)], place[len(src) :]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    first = np.searchsorted(a, np.arange(len(nodes) + 1)).tolist()
    accepted = np.ones(len(nodes), bool)
    for x in np.unique(a).tolist():
        if accepted[x]:
            accepted[b[first[x] : first[x + 1]]] = False
    return nodes, accepted


def _settled_in_a_task(pairs: DataFrame) -> DataFrame:
    """(node, accepted) of the nodes of at most GROUP_PAIRS `pairs`."""
    kind = pairs.schema["src"].dataType.simpleString()

    def run(batches):
        held = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches if x.num_rows]
        if held:
            nodes, accepted = _settled(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(accepted)], names=["node", "accepted"])
        give_back()

    return pairs.select("src", "dst").coalesce(1).mapInArrow(run, f"node {kind}, accepted boolean")


def earliest_accepted(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, accepted): in id order a node is accepted unless one accepted before it is its neighbour; `pairs` (src < dst), distinct ids. Nodes without pairs are accepted.

    Up to `GROUP_PAIRS` pairs are settled in one task, in id order, however long chains are. More
    pairs fall into groups of linked nodes, found in rounds that grow with the logarithm of their
    width; a group of up to that many pairs is a task of its own. Pairs of larger groups go in
    rounds, each of which decides every node whose earlier neighbours are all decided, until no
    more are open than one task settles.
    """
    open_pairs = cut(pairs.select("src", "dst"), "pairs")
    kind = open_pairs.schema["src"].dataType.simpleString()
    if open_pairs.count() <= GROUP_PAIRS:
        decided = _settled_in_a_task(open_pairs)
        return nodes.join(decided, "node", "left").select("node", F.coalesce("accepted", F.lit(True)).alias("accepted"))
    groups = cut(star_components(open_pairs.select(F.col("src").alias("u"), F.col("dst").alias("v"))), "groups")
    placed = open_pairs.join(groups.select(F.col("node").alias("src"), "label"), "src")
    sizes = cut(placed.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "sizes")
    large = cut(sizes.filter(F.col("n") > GROUP_PAIRS).select("label"), "large")  # few: each has that many pairs

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        found, accepted = _settled(group["src"].to_numpy(), group["dst"].to_numpy())
        return pd.DataFrame({"node": found, "accepted": accepted})

    decided = placed.join(F.broadcast(large), "label", "left_anti").groupBy("label").applyInPandas(settle, f"node {kind}, accepted boolean")
    if not large.isEmpty():
        decided = decided.union(_accepted_in_rounds(placed.join(F.broadcast(large), "label", "left_semi").select("src", "dst")))
    return nodes.join(decided, "node", "left").select("node", F.coalesce("accepted", F.lit(True)).alias("accepted"))


def _accepted_in_rounds(pairs: DataFrame) -> DataFrame:
    """(node, accepted) of the nodes of `pairs`, every node whose earlier neighbours are all decided in each round, until one task settles the rest."""
    open_pairs = cut(pairs, "pairs")
    decided = []
    waiting = cut(open_pairs.select(F.col("src").alias("node")).union(open_pairs.select(F.col("dst").alias("node"))).distinct(), "waiting")
    while not waiting.isEmpty():  # the least waiting node is never blocked, so each round settles some
        blocked = open_pairs.join(waiting.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        won = cut(waiting.join(blocked, "node", "left_anti"), "won")
        lost = cut(open_pairs.join(won.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(waiting, "node", "left_semi"), "lost")
        step = won.withColumn("accepted", F.lit(True)).union(lost.withColumn("accepted", F.lit(False)))
        decided.append(step)
        if len(decided) == 16:  # few parts, however many rounds
            decided = [cut(reduce(DataFrame.union, decided), "decided")]
        gone = step.select("node")
        waiting = cut(waiting.join(gone, "node", "left_anti"), "waiting")
        open_pairs = cut(open_pairs.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "pairs")
        if open_pairs.count() <= GROUP_PAIRS:
            rest = cut(_settled_in_a_task(open_pairs), "rest")
            alone = waiting.join(rest, "node", "left_anti").select("node", F.lit(True).alias("accepted"))  # all their neighbours were rejected
            return reduce(DataFrame.union, [*decided, rest, alone])
    return reduce(DataFrame.union, decided)


def build_corpus(
    docs: DataFrame,
    eval_texts: DataFrame | None = None,
    min_chars: int = 20,
    min_ratio: float = 0.35,
    script: str = K.ARABIC_BLOCK,
    near_threshold: float | None = 0.92,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, text_hash, chars, script_ratio, reason): the first reason that rejects a document, null if accepted.

    Order: gate, exact duplicate and near duplicate of an accepted earlier document, text of the
    evaluation set (one column `text`). A contaminated document accepts nothing and rejects nothing.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), X.collapse_space(text).alias("collapsed"))
    text = F.col("text")
    rows = rows.select(
        "doc_id", X.collapsed_hash("collapsed").alias("text_hash"), F.length("collapsed").cast("long").alias("chars"), X.script_ratio(text, script).alias("script_ratio"),
        *([X.simhash(X.tokenize(F.lower(text))).alias("simhash")] if near_threshold is not None else []),
    )
    rows = cut(rows.withColumn("gate", _verdict(F.col("chars"), F.col("script_ratio"), min_chars, min_ratio)))
    passed = rows.filter("gate IS NULL")
    if eval_texts is not None:
        known = eval_texts.select(X.text_hash(F.coalesce("text", F.lit(""))).alias("text_hash")).distinct().withColumn("eval", F.lit(True))
        passed = passed.join(known, "text_hash", "left")
    else:
        passed = passed.withColumn("eval", F.lit(None).cast("boolean"))
    # copies fall together: the earliest of a key stands for it, so a hot key is one row from here
    first = passed.groupBy("text_hash").agg(F.min("doc_id").alias("first_id"))
    passed = cut(passed.join(first, "text_hash"))
    heads = passed.filter("doc_id = first_id")
    if near_threshold is not None:
        distance = int((1 - near_threshold) * 64 + 1e-9)
        # texts of one simhash fall together: only the earliest can be accepted, and what rejects it rejects all;
        # a text of the evaluation set is never accepted, so it can only be rejected
        classes = cut(heads.groupBy("simhash").agg(F.min(F.when(F.col("eval").isNull(), F.col("doc_id"))).alias("rep")), "simhashes")
        pairs = cut(simhash_pairs(classes.select(F.col("simhash").alias("id"), "simhash"), distance).select("src", "dst"), "near")
        reps = classes.filter("rep IS NOT NULL")
        named = pairs.join(reps.select(F.col("simhash").alias("src"), F.col("rep").alias("a")), "src").join(reps.select(F.col("simhash").alias("dst"), F.col("rep").alias("b")), "dst")
        inner = named.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
        accepted = cut(earliest_accepted(inner, reps.select(F.col("rep").alias("node"))).filter("accepted").join(reps.withColumnRenamed("rep", "node"), "node").select("simhash", "node"), "accepted")
        ways = pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).toDF("simhash", "other")
        by_class = accepted.join(ways, "simhash").select(F.col("other").alias("simhash"), "node").unionByName(accepted).groupBy("simhash").agg(F.min("node").alias("near_from"))
        near = heads.select("doc_id", "simhash").join(by_class, "simhash").filter("near_from <> doc_id").select("doc_id", "near_from")
        heads = heads.join(near, "doc_id", "left")
    else:
        heads = heads.withColumn("near_from", F.lit(None).cast(heads.schema["doc_id"].dataType))
    # a row is judged by the accepted texts before it: its own key's first text, or one near to it
    heads = heads.select("text_hash", "near_from", (F.col("eval").isNull() & F.col("near_from").isNull()).alias("taken"))
    later = F.when(F.col("taken") & (F.col("doc_id") != F.col("first_id")), "exact_duplicate").when(F.col("near_from") < F.col("doc_id"), "near_duplicate").when(F.col("eval"), "eval_contamination")
    judged = passed.join(heads, "text_hash").select("doc_id", later.alias("later"))
    return rows.join(judged, "doc_id", "left").select("doc_id", "text_hash", "chars", "script_ratio", F.coalesce("gate", "later").alias("reason"))


def split_counts(n: int, val: float, test: float) -> tuple[int, int]:
    """(validation, test) rows of n: halves round to even, at least one where the ratio asks for some and rows remain."""
    t = round(n * test)
    v = round(n * val)
    if test > 0 and n > 2:
        t = max(1, t)
    if val > 0 and n > 1:
        v = max(1, v)
    t = min(t, max(0, n - 1))
    return min(v, max(0, n - t - 1)), t


def article_split_counts(n: int, val: float) -> tuple[int, int]:
    """(validation, test) rows of n articles: at least one and not all where the ratio asks for some."""
    return (0, 0) if n <= 1 or val == 0 else (max(1, min(n - 1, round(n * val))), 0)


def dataset_split_counts(n: int, train: float, val: float, test: float) -> tuple[int, int]:
    """(validation, test) rows of n by ratios that are scaled to 1; the larger of both gives way until one row is left to train on."""
    if n <= 0 or min(train, val, test) < 0 or train + val + test <= 0:
        raise ValueError("rows and ratios must be positive")
    if n == 1:
        return 0, 0
    whole = train + val + test
    v, t = round(n * (val / whole)) if val else 0, round(n * (test / whole)) if test else 0
    v = max(1, v) if val and n >= 3 else v
    t = max(1, t) if test else t
    over = v + t - (n - 1)
    while over > 0:  # evens both out, then takes from each in turn
        v, t = (v - 1, t) if v >= t and v else (v, t - 1)
        over -= 1
    return v, t


def smallest_key(keys: DataFrame, k: int, column: str, digits: int = 3) -> str:
    """The k-th smallest (from 1) of hexadecimal `column`: histograms of ever longer prefixes, 16 ** `digits` rows each, so no keys are gathered or sorted."""
    prefix, left = "", k
    width = len(keys.select(column).first()[0])
    while len(prefix) < width:
        size = min(digits, width - len(prefix))
        found = keys.filter(F.col(column).startswith(prefix)) if prefix else keys
        rows = sorted((r.p, r["count"]) for r in found.groupBy(F.substring(column, len(prefix) + 1, size).alias("p")).count().collect())
        for p, n in rows:
            if left <= n:
                break
            left -= n
        prefix += p
        if n == 1:  # one key is left
            return keys.filter(F.col(column).startswith(prefix)).select(column).first()[0]
    return prefix


def split(records: DataFrame, val: float = 0.1, test: float = 0.05, seed: int = 0, key: str = "text_hash", counts: tuple[int, int] | None = None) -> DataFrame:
    """`records` with `split` (train, validation, test): exact counts, members by a hash of the seed and key; `counts` (validation, test) may state them.

    Rows of one key fall together, so counts are exact as far as keys differ. The cut points are
    two order statistics, found by histograms of the hashes' prefixes.
    """
    u = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key)), 256)
    keys = cut(records.select(u.alias("split_key")))
    v, t = counts or split_counts(keys.count(), val, test)
    ranked = records.withColumn("split_key", u)
    kind = F.lit("train")
    if v:
        kind = F.when(F.col("split_key") <= smallest_key(keys, v + t, "split_key"), "validation").otherwise(kind)
    if t:
        kind = F.when(F.col("split_key") <= smallest_key(keys, t, "split_key"), "test").otherwise(kind)
    return ranked.withColumn("split", kind).drop("split_key")


#: Hashes in one group of `split_hashes`, about.
GROUP_HASHES = 4096


def split_hashes(records: DataFrame, key: str = "text_hash") -> DataFrame:
    """(split, n, digest): a hash tree of the sorted hashes of each split.

    Hashes are counted, then grouped by as many leading digits as leave about `GROUP_HASHES` in a
    group; groups are hashed, sixteen at a time, up to one digest, so nothing is gathered beyond
    that and a hash that a third of all records share is one entry.
    """
    each = cut(records.groupBy("split", F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")), "hashes")
    digits, most = 1, each.count()
    while most > GROUP_HASHES * 16**digits:
        digits += 1
    entry = F.struct("k", F.when(F.col("n") > 1, F.concat_ws(":", "k", "n")).otherwise(F.col("k")).alias("x"))
    joined = lambda s: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(s)), lambda e: e["x"]), "\n"), 256).alias("x")
    level = each.groupBy("split", F.substring("k", 1, digits).alias("k")).agg(F.sum("n").alias("n"), joined(entry))
    for d in range(digits - 1, -1, -1):
        level = level.groupBy("split", F.substring("k", 1, d).alias("k")).agg(F.sum("n").alias("n"), joined(F.struct("k", "x")))
    return level.select("split", "n", F.col("x").alias("digest"))


def quality_report(verdicts: DataFrame, by: str | None = None) -> DataFrame:
    """(source?, reason, n, chars): counts by reason and in total, by rollup; `accepted` has no reason, totals are `all`."""
    reason = F.coalesce("reason", F.lit("accepted"))
    rows = verdicts.withColumn("why", reason)
    keys = [by, "why"] if by else ["why"]
    grouped = rows.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    return grouped.select(*([F.coalesce(by, F.lit("all")).alias(by)] if by else []), F.coalesce("why", F.lit("all")).alias("reason"), "n", "chars")


def char_profile(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: characters by class, in one pass."""
    c = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda p: F.sum(F.regexp_count(c, F.lit(p))).cast("long")
    row = docs.agg(
        F.sum(F.length(c)).cast("long").alias("total"),
        count(f"[{K.ARABIC_BLOCK}]").alias("script_letters"),
        count("[A-Za-z]").alias("latin_letters"),
        count(rf"[\p{{Nd}}&&[^{K.ARABIC_BLOCK}]]").alias("digits"),
        count(K.ZWNJ).alias("zwnj"),
        count(K.SPACE).alias("whitespace"),
    )
    other = F.col("total") - F.col("script_letters") - F.col("latin_letters") - F.col("digits") - F.col("zwnj") - F.col("whitespace")
    safe = F.greatest("total", F.lit(1))
    return row.select("*", other.alias("other"), (F.col("script_letters") / safe).alias("script_ratio"), (F.col("latin_letters") / safe).alias("latin_ratio"), (F.col("zwnj") * 1000.0 / safe).alias("zwnj_per_1000"))


def length_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    n = F.length(F.coalesce(F.col(text_col), F.lit("")))
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.avg(n).alias("mean_chars"))


def duplicate_count(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: documents beyond the first of each duplicate key."""
    keys = docs.select(F.sha2(X.duplicate_key(F.coalesce(F.col(text_col), F.lit(""))), 256).alias("k")).groupBy("k").count()
    return keys.agg(F.sum(F.col("count") - 1).alias("exact_duplicates"))


def metadata_profile(records: DataFrame, column: str = "metadata") -> DataFrame:
    """(kind, name, n): counts of metadata keys and of sources (source, url or domain); `metadata` is a map."""
    keys = records.select(F.lit("key").alias("kind"), F.explode(F.map_keys(column)).alias("name"))
    first = F.coalesce(*(F.nullif(F.col(column)[k], F.lit("")) for k in ("source", "url", "domain")))
    return keys.union(records.select(F.lit("source"), first.alias("name")).filter("name IS NOT NULL")).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def audit(docs: DataFrame, text_col: str = "text", metadata_col: str | None = None) -> DataFrame:
    """(section, name, value) of a corpus: lengths, characters by class, duplicates, and metadata counts if `metadata_col` (a map) is named."""
    def long(row: DataFrame, section: str) -> DataFrame:
        named = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in row.columns))
        return row.select(F.lit(section).alias("section"), F.explode(named).alias("x")).select("section", "x.name", "x.value")

    parts = [long(length_stats(docs, text_col), "length"), long(char_profile(docs, text_col), "characters"), long(duplicate_count(docs, text_col), "duplicates")]
    if metadata_col is not None:
        parts.append(metadata_profile(docs, metadata_col).select(F.concat(F.lit("metadata "), "kind").alias("section"), "name", F.col("n").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def surface_counts(docs: DataFrame, text_col: str = "body") -> DataFrame:
    """One row: half-spaces, verb prefixes that a space parts from their verb, and question marks of both scripts."""
    c = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda p: F.coalesce(F.sum(F.regexp_count(c, F.lit(p))), F.lit(0)).cast("long")
    return docs.agg(
        count(K.ZWNJ).alias("zwnj_count"),
        count(rf"(?:^|{K.SPACE})(?:{'|'.join(K.VERB_PREFIXES)}){K.SPACE}+[{K.ARABIC_BLOCK}]+").alias("space_after_mi_prefix_count"),
        count(r"\?").alias("ascii_question_mark_count"),
        count("؟").alias("persian_question_mark_count"),
    )


def audit_articles(
    articles: DataFrame, id_col: str = "number", min_body: int = 80, tokenizers: dict[str, Column] | None = None, validation: float = 0.1, seed: int = 0, near_ngram: int = 13, near_threshold: float = 0.82
) -> DataFrame:
    """(section, name, value) of articles (`id_col`, title, body, summary, keywords, metadata), names distinct within a section.

    Sections: records (accepted, rejected, and of the accepted ones without title, with summary,
    with key words), rejection_reasons, body_chars, title_chars, characters (of titles and bodies),
    surface, duplicates (copies, near pairs of classes, and articles near to another class),
    metadata key, metadata source, and for each of `tokenizers` (name: column of tokens of `line`)
    tokenizer NAME train and validation: statistics of both parts by the words of the first. All
    but the first two are of accepted articles. Near pairs are exact and not limited in number.
    """
    def long(row: DataFrame, section: str, *names: str) -> DataFrame:
        named = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names or row.columns))
        return row.select(F.lit(section).alias("section"), F.explode(named).alias("x")).select("section", "x.name", "x.value")

    judged = cut(prepare_articles(articles, min_body), "judged")
    kept = judged.filter("reason IS NULL")
    filled = lambda c: F.sum(F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0)).cast("long")
    total = judged.agg(F.sum(F.col("reason").isNull().cast("int")).alias("accepted_records"), F.sum(F.col("reason").isNotNull().cast("int")).alias("rejected_records"))
    has = kept.agg((F.count(F.lit(1)) - filled(F.col("title"))).alias("missing_title_count"), filled(F.col("summary")).alias("summary_present_count"), F.sum((F.coalesce(F.size("keywords"), F.lit(0)) > 0).cast("int")).alias("keywords_present_count"))
    reasons = judged.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("rejection_reasons").alias("section"), F.col("reason").alias("name"), "value")
    body, title = kept.select(F.col("body").alias("text")), kept.filter("coalesce(title, '') <> ''").select(F.col("title").alias("text"))
    sizes = ("min_chars", "max_chars", "mean_chars")
    parts = [long(total, "records"), long(has, "records"), reasons, long(length_stats(body), "body_chars", *sizes), long(length_stats(title), "title_chars", *sizes)]
    parts += [long(char_profile(title.unionByName(body)), "characters"), long(surface_counts(kept), "surface"), long(duplicate_count(body), "duplicates")]
    members, pairs = shingle_pairs(kept.select(F.col(id_col).alias("doc_id"), F.col("body").alias("text")), near_ngram, near_threshold)
    pairs = cut(pairs, "near")
    ends = pairs.select(F.col("src").alias("rep")).union(pairs.select("dst")).distinct()
    parts += [long(pairs.agg(F.count(F.lit(1)).alias("near_duplicate_pairs")), "duplicates"), long(members.join(ends, "rep", "left_semi").agg(F.count(F.lit(1)).alias("near_duplicate_articles")), "duplicates")]
    parts.append(metadata_profile(kept).select(F.concat(F.lit("metadata "), "kind").alias("section"), "name", F.col("n").cast("double").alias("value")))
    if tokenizers:
        rows = kept.select(F.col(id_col).alias("doc_id"), "line", F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("h"))
        n = rows.count()
        size = min(max(1, round(n * validation)), n - 1) if validation > 0 and n > 1 else 0
        bound = smallest_key(rows.select(F.format_string("%016x", "h").alias("k")), size, "k") if size else ""
        placed = cut(rows.withColumn("part", F.when(F.format_string("%016x", "h") <= bound, "validation").otherwise("train")), "placed")
        for name, tokens in tokenizers.items():
            arrays = cut(placed.select("doc_id", "part", F.length("line").cast("long").alias("n"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens")), "tokens")
            vocab = cut(arrays.filter("part = 'train'").select(F.explode("tokens").alias("token")).distinct(), "vocab")
            for part in ("train", "validation"):
                mine = arrays.filter(F.col("part") == part)
                parts.append(long(TK.token_statistics(mine, vocab, mine.select("doc_id", "n")), f"tokenizer {name} {part}"))
            parts.append(long(vocab.agg(F.count(F.lit(1)).alias("vocab_size")), f"tokenizer {name} train"))
    return reduce(DataFrame.unionByName, parts)


def select_poems(rows: DataFrame, poets: list[str] | None = None, keep_prose: bool = False, min_chars: int = 20, max_chars: int | None = None, limit: int | None = None, seed: int = 0, id_col: str = "id") -> DataFrame:
    """Rows (id, poet, text) of the named poets that look like verse, cleaned to one line, in a hashed order; `limit` takes the first so many."""
    out = rows.filter(F.trim("poet").isin(*poets)) if poets else rows
    if not keep_prose:
        out = out.filter(X.looks_like_poetry("text"))
    clean = X.clean_wiki(F.col("text"))
    clean = F.trim(F.substring(clean, 1, max_chars)) if max_chars else clean
    out = out.withColumn("display", F.trim("text")).withColumn("text", clean).filter(F.length("text") >= min_chars)
    out = out.orderBy(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), id_col)
    return out.limit(limit) if limit else out


def prepare_articles(articles: DataFrame, min_body: int = 80) -> DataFrame:
    """Articles (title, body, keywords) with line and reason: missing_body, body_too_short, or null."""
    body = X.collapse_space(F.coalesce("body", F.lit("")))
    reason = F.when(F.length(body) == 0, "missing_body").when(F.length(body) < min_body, "body_too_short")
    return articles.select("*", reason.alias("reason"), X.article_line(F.coalesce("title", F.lit("")), body, F.coalesce("keywords", F.array().cast("array<string>"))).alias("line"))


def sft_texts(messages: DataFrame, min_completion: int = 1, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, prompt, completion, text) from rows (conv_id, turn, role, text): assistant texts are the completion, others the prompt with their role; short completions go."""
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.regexp_replace(F.coalesce("text", F.lit("")), f"^{K.SPACE}+|{K.SPACE}+$", "").alias("text"))
    rows = messages.groupBy(F.col(conv_col).alias("conv_id")).agg(F.filter(F.array_sort(F.collect_list(turn)), lambda t: t["text"] != "").alias("turns"))
    asked = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] != "assistant"), lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    told = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "\n")
    out = rows.select("conv_id", asked.alias("prompt"), told.alias("completion")).filter(F.length("completion") >= min_completion)
    return out.withColumn("text", X.prompt_completion("prompt", "completion"))
