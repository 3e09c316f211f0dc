import hashlib
import random
import threading

import pytest

from loomgraph.llm import sharding
from loomgraph.llm.sharding import ShardStore, plan_merges


def shard(i, size):
    return {"path": f"p{i:04d}", "rows": 1, "bytes": size, "added": i}


def test_plan_merges_similar_sizes_up_to_the_target():
    rng = random.Random(0)
    for _ in range(200):
        shards = [shard(i, int(2 ** rng.uniform(3, 11))) for i in range(rng.randint(0, 60))]
        runs = plan_merges(shards, 1000, 4)
        used = [s["path"] for r in runs for s in r]
        assert len(used) == len(set(used)) and all(s["bytes"] * 2 < 1000 for r in runs for s in r)
        for r in runs:
            assert len(r) > 1 and sum(s["bytes"] for s in r) <= 1000
            assert len({sharding.tier(s["bytes"], 1000 // 256) for s in r}) == 1
    assert plan_merges([shard(i, 10) for i in range(3)], 1000) == []
    assert len(plan_merges([shard(i, 10) for i in range(4)], 1000)) == 1
    assert plan_merges([shard(i, 500) for i in range(9)], 1000) == []


def test_store_keeps_all_rows(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else "t" * (i % 50), i % 3) for i in range(500)] + [(None, "", None), (3, "x", 1), (3, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    store = ShardStore(spark, str(tmp_path / "s"), df.schema)
    assert store.read().count() == 0
    store.append(df.filter("doc_id % 2 = 0").repartition(6))
    store.append(df.filter("doc_id % 2 = 1 OR doc_id IS NULL").repartition(5))
    assert store.append(df.limit(0)) == 3 and len(store.manifest()["shards"]) == 11
    assert len(store.manifest(1)["shards"]) == 6
    before = store.read(3).collect()
    version = store.compact(target=1 << 20)
    assert version == 4 and len(store.manifest()["shards"]) == 1 and store.compact(target=1 << 20) == 4
    key = lambda r: tuple(map(str, r))
    assert sorted(store.read().collect(), key=key) == sorted(map(tuple, rows), key=key) == sorted(before, key=key)
    assert sorted(store.read(2).collect(), key=key) == sorted(before, key=key)  # older versions stay readable
    assert store.vacuum() == 11 and store.read().count() == len(rows) and store.versions() == [4]
    with pytest.raises(ValueError):
        store.append(df.drop("shard"))


def test_one_of_two_writers_wins(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "c"), spark.range(1).schema)
    store.commit(0, [])
    won, lost = [], []

    def go(k):
        try:
            won.append(store.commit(1, [shard(k, 1)]))
        except sharding.Conflict:
            lost.append(k)

    threads = [threading.Thread(target=go, args=(k,)) for k in range(2)]
    [t.start() for t in threads], [t.join() for t in threads]
    with pytest.raises(sharding.Conflict):
        store.commit(1, [])
    assert store.versions() == [1, 2] and 2 in won
    names = [p.name for p in (tmp_path / "c" / "manifest").iterdir() if not p.name.endswith(".crc")]
    assert sorted(names) == ["v0000000001.json", "v0000000002.json"]


def test_query(spark, tmp_path):
    rows = [(i, None if i == 5 else f"text é {i} " * (i % 90)) for i in range(800)] + [(9, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op7_sharding(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text_sha256, r.n_bytes) for r in got) == sorted((i, hashlib.sha256((t or "").encode()).hexdigest(), len((t or "").encode())) for i, t in rows)
    assert 1 <= len({r.shard for r in got}) < 40


def test_lost_appends_try_again_and_orphans_go(spark, tmp_path, monkeypatch):
    long = [(1, "é" * 3_000_000), (2, None), (3, "")]
    df = spark.createDataFrame(long, "doc_id long, text string")
    store, other = (ShardStore(spark, str(tmp_path / "d"), df.schema) for _ in range(2))
    real, calls = ShardStore.commit, []

    def late(self, base, shards):  # another writer commits first, once
        if not calls:
            calls.append(1)
            other.append(df.limit(1))
        return real(self, base, shards)

    monkeypatch.setattr(ShardStore, "commit", late)
    assert store.append(df) == 2 and store.read().count() == 4
    assert sorted(len(r.text or "") for r in store.read().collect())[-1] == 3_000_000

    def lose(self, base, shards):
        raise sharding.Conflict("lost")

    monkeypatch.setattr(ShardStore, "commit", lose)
    with pytest.raises(sharding.Conflict):
        store.append(df, tries=2)
    monkeypatch.setattr(ShardStore, "commit", real)
    folders = lambda: len(list((tmp_path / "d" / "shards").iterdir()))
    assert folders() == 3 and store.vacuum() == 0 and folders() == 3
    assert store.vacuum(grace_seconds=-10) > 0 and folders() == 2 and store.read().count() == 4


def test_queries_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sharding.op7_sharding(spark, str(tmp_path)).collect() == []


def test_each_run_is_a_task_of_its_own(spark, tmp_path):
    """Runs of one round stay apart: as many files as runs, none of them above the target."""
    df = spark.range(40_000).selectExpr("id AS doc_id", "sha2(CAST(id AS STRING), 256) AS text")
    store = ShardStore(spark, str(tmp_path / "r"), df.schema)
    store.append(df.repartition(16))
    target = 5 * max(s["bytes"] for s in store.manifest()["shards"])
    runs = plan_merges(store.manifest()["shards"], target)
    before = spark.conf.get("spark.sql.unionOutputPartitioning", None)
    store.compact(target=target)
    found = store.manifest()["shards"]
    assert len(runs) == 3 and len([s for s in found if s["added"] == 2]) == 3 and max(s["bytes"] for s in found) <= 1.1 * target
    assert store.read().count() == 40_000 and spark.conf.get("spark.sql.unionOutputPartitioning", None) == before
