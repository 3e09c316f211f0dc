import random

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import graphs, iterate
from loomgraph.streaming.store import Conflict, PairStore, add_stream


def docs(spark, n=60, seed=1):
    rng = random.Random(seed)
    rows = [(k, [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 2, 5, 30]))]) for k in range(n)]
    return spark.createDataFrame([*rows, (n, None)], "doc_id long, tokens array<string>")


def rows(df):
    return sorted((r.src, r.dst, round(r.weight, 9)) for r in df.collect())


def test_batches_equal_one_build(spark, tmp_path):
    d = docs(spark)
    store = PairStore(spark, f"{tmp_path}/store")
    assert rows(store.edges()) == [] and store.total_tokens() == 0
    for k in range(4):
        assert store.add(d.filter(F.col("doc_id") % 4 == k), f"b{k}")
    assert not store.add(d, "b2")  # a known batch is not counted again
    words = graphs.frequent(d, 1)
    want, ppmi = rows(graphs.distance_cooccurrence(d, 4)), rows(graphs.association(graphs.distance_cooccurrence(d, 4), words, "ppmi"))
    for _ in range(2):
        assert rows(store.edges()) == want and rows(store.association()) == ppmi
        assert store.total_tokens() == d.agg(F.sum(F.size(F.coalesce("tokens", F.array())))).first()[0]
        store.compact()
    assert len(store._manifest()["folders"]) == 1 and not store.add(d, "b0")
    # an older version reads as it was
    assert rows(store.edges(version=1)) == rows(graphs.distance_cooccurrence(d.filter("doc_id % 4 = 0"), 4))
    kept = {r.token for r in words.filter("freq >= 40").collect()}
    assert rows(store.edges(40)) == [r for r in want if r[0] in kept and r[1] in kept]
    with pytest.raises(ValueError):
        PairStore(spark, f"{tmp_path}/store", window=5)


def test_lost_races_and_orphans(spark, tmp_path, monkeypatch):
    d = docs(spark, 10)
    a, b = PairStore(spark, f"{tmp_path}/s"), PairStore(spark, f"{tmp_path}/s")
    real, calls = PairStore._manifest, []

    def late(self, version=None):  # b commits between a's reading and its commit
        held = real(self, version)
        calls.append(1)
        if len(calls) == 2:
            monkeypatch.setattr(PairStore, "_manifest", real)
            b.add(d.limit(3), "other")
        return held

    monkeypatch.setattr(PairStore, "_manifest", late)
    assert a.add(d, "mine") and set(a._manifest()["batches"]) == {"other", "mine"}
    with pytest.raises(Conflict):
        a._commit(a._manifest())
    a._write(a._sum("pairs", ["a", "b"], "parts", a._manifest()), a.words())  # a writer that died before its commit
    assert a.vacuum(keep=1) == 0 and a.vacuum(keep=1, grace_seconds=-10) == 1
    assert len(a.versions()) == 1 and len(a._names(f"{a.path}/data")) == 2 and a.total_tokens() > 0


def test_stream_counts_each_batch_once(spark, tmp_path):
    d = docs(spark, 20)
    d.repartition(3).write.parquet(f"{tmp_path}/in")
    store = PairStore(spark, f"{tmp_path}/s")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    add_stream(store, stream, f"{tmp_path}/cp").awaitTermination(120)
    assert rows(store.edges()) == rows(graphs.distance_cooccurrence(d, 4))
    # the same batches after the checkpoint is lost
    add_stream(store, stream, f"{tmp_path}/cp2").awaitTermination(120)
    assert rows(store.edges()) == rows(graphs.distance_cooccurrence(d, 4))


def test_prompts_together_as_alone(spark):
    rng = random.Random(5)
    names = [f"n{k}" for k in range(30)]
    links = [(a, b, rel, round(rng.random(), 3)) for rel in ("x", "y") for a, b in (rng.sample(names, 2) for _ in range(60))]
    e = spark.createDataFrame(links, "src string, dst string, relation string, weight double").dropDuplicates(["src", "dst", "relation"]).cache()
    asked = {k: rng.sample(names, rng.randrange(1, 4)) for k in range(6)}
    seeds = spark.createDataFrame([(k, n) for k, ns in asked.items() for n in ns] + [(0, asked[0][0]), (None, "n1"), (7, None), (8, "unknown")], "prompt int, node string")
    for depth in (0, 1, 3):
        nodes, found = iterate.retrieve_many(e, seeds, depth, 6, 8, {"y": 0.5})
        nodes, found = nodes.cache(), found.cache()
        for k, ns in asked.items():
            top, best = iterate.retrieve(e, spark.createDataFrame([(n,) for n in ns], "node string"), depth, 6, 8, {"y": 0.5})
            assert [(r.node, round(r.score, 9)) for r in nodes.filter(F.col("prompt") == k).orderBy("rank").collect()] == [(r.node, round(r.score, 9)) for r in top.orderBy(F.desc(F.round("score", 9)), "node").collect()]
            one = lambda f: sorted((r.src, r.dst, r.relation, round(r.rank_score, 9)) for r in f.collect())
            assert one(found.filter(F.col("prompt") == k)) == one(best)
        assert nodes.filter("prompt = 8").count() == 1 and nodes.filter("prompt IS NULL OR prompt = 7").isEmpty()
    prompts = spark.createDataFrame([(k,) for k in range(10)], "prompt int")
    nodes, found = iterate.retrieve_many(e, seeds, 2, 6, 8, min_score=1.2)
    report = {r.prompt: r for r in iterate.retrieval_reports(prompts, seeds, nodes, found).collect()}
    assert len(report) == 10 and report[7].fallback == report[9].fallback == "no_prompt_nodes" and report[8].fallback == "empty_after_scoring"
    assert all(r.score >= 1.2 for r in nodes.collect()) and report[0].retrieved_edges == found.filter("prompt = 0").count() == sum(report[0].relation_counts.values())
    chosen = {r.node for r in nodes.filter("prompt = 0").collect()}
    assert report[0].coverage == len(chosen & set(asked[0])) / len(asked[0]) and set(report[0].top_nodes) == chosen
