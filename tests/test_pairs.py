"""Sums of pairs in packed blocks, held against plain loops over every pair."""

import random
from collections import Counter

import pytest

from loomgraph.operators import graphs, pairs


@pytest.fixture
def small(monkeypatch):
    """Pieces and buckets so small that a few rows make many of both."""
    monkeypatch.setattr(pairs, "PIECE_PAIRS", 70)
    monkeypatch.setattr(pairs, "BUCKET_PAIRS", 900)


def rows_of(spark, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["é", "می", "a'b", "Z"]
    docs = [(k, [rng.choice(words[: rng.choice([3, 44])]) for _ in range(rng.choice([0, 0, 1, 2, 9, 60]))]) for k in range(60)]
    return docs, spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(3)


def plain(docs, window, parts=None, directed=False, loops=True, keep=None):
    out = Counter()
    for _, t in docs:
        for i, a in enumerate(t):
            for k in range(1, window + 1):
                if i + k < len(t) and (loops or a != t[i + k]) and (keep is None or (a in keep and t[i + k] in keep)):
                    b = t[i + k]
                    out[(a, b) if directed or a <= b else (b, a)] += parts[k] if parts else 1
    return dict(out)


@pytest.mark.parametrize("window", [1, 4, 20])
@pytest.mark.parametrize("directed", [False, True])
def test_sums_equal_plain_loops(spark, small, window, directed):
    docs, d = rows_of(spark)
    for parts, loops in ((None, True), (pairs.distance_parts(window)[1], False)):
        got = pairs.pair_sums(d, window, parts, directed, loops).collect()
        want = plain(docs, window, parts, directed, loops)
        assert len(got) == len(want) and {(r.a, r.b): r.n for r in got} == want
        assert pairs.pair_total(d, window, parts, loops) == sum(want.values())
    assert pairs.pair_sums(d.limit(0), window).collect() == []


def test_words_that_count_and_their_frequencies(spark, small):
    docs, d = rows_of(spark)
    freq = {w: n for w, n in Counter(t for _, ts in docs for t in ts).items() if n >= 12}
    got = pairs.pair_sums(d, 5, words=spark.createDataFrame(list(freq.items()), "token string, freq long")).collect()
    assert {(r.a, r.b): (r.n, r.fa, r.fb) for r in got} == {(a, b): (n, freq[a], freq[b]) for (a, b), n in plain(docs, 5, keep=freq).items()}


@pytest.mark.parametrize("kind", ["distance", "ppmi"])
def test_best_of_buckets_hold_the_best_of_all(spark, small, kind):
    docs, d = rows_of(spark)
    words = graphs.frequent(d, 1)
    base = graphs.distance_cooccurrence(d, 4)
    whole = base if kind == "distance" else graphs.association(base, words, "ppmi")
    table = lambda e: {(r.src, r.dst): pytest.approx(r.weight, abs=1e-9) for r in e.collect()}
    assert table(graphs.distance_association(d, 4, words, kind)) == table(whole)
    assert table(graphs.distance_association(d, 4, words, kind, 3)) == table(graphs.prune(graphs.both_ways(whole), 3))


def test_no_row_is_made_for_a_pair_before_it_is_summed(spark):
    """As rows, the pairs of 1 GB did not fit the disk."""
    _, d = rows_of(spark)
    for e in (graphs.pmi(d), graphs.distance_cooccurrence(d, 4), graphs.cooccurrence(d, 3, 2), graphs.pair_counts(d, 2)):
        assert "arrays_zip" not in e._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_a_row_are_counted_in_the_row(spark):
    docs, d = rows_of(spark, 5)
    want = {(k, w, n, max(Counter(t).values())) for k, t in docs for w, n in Counter(t).items()}
    counts = graphs.token_counts(d)
    assert sorted(map(tuple, counts.collect())) == sorted(want)
    whole = graphs.merge_relations({"word_document": graphs.both_ways(graphs.word_document_edges(d))}, summed=True)
    assert "hashpartitioning" not in whole._jdf.queryExecution().executedPlan().toString()
    again = graphs.merge_relations({"word_document": graphs.both_ways(graphs.word_document_edges(d))})
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, again.collect()))


def test_keys_of_simhashes_are_not_broadcast(spark, tmp_path):
    """A table of hashes is below the planner's limit for a broadcast; its keys, 56 times as many rows, are not."""
    from pyspark.sql import functions as F

    from loomgraph.operators import similarity

    spark.range(1000).select("id", F.xxhash64("id").alias("simhash")).write.parquet(f"{tmp_path}/hashes")
    found = similarity.simhash_pairs(spark.read.parquet(f"{tmp_path}/hashes"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("min_count", [1, 12])
def test_thinned_edges_come_from_counts_of_partners(spark, small, min_count, monkeypatch):
    from loomgraph.operators import algebra

    docs, d = rows_of(spark)
    freq = Counter(t for _, ts in docs for t in ts)
    got = [tuple(r) for r in graphs.cooccurrence_thinned(d, 3, min_count, 9, 20).collect()]
    assert got == [tuple(r) for r in algebra.thin(graphs.both_ways(graphs.cooccurrence(d, 3, min_count)), 9, 20).collect()] and got
    ends = {p for p in plain(docs, 3, keep=[w for w in freq if freq[w] >= min_count])}
    words = graphs.frequent(d, min_count) if min_count > 1 else None
    assert {r.node: r.n for r in pairs.partners(d, 3, words).collect()} == dict(Counter(w for p in ends for w in set(p)))
