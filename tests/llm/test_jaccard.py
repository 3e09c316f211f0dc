import random

import duckdb
import numpy as np
import pytest

from loomgraph.llm import jaccard
from loomgraph.operators.iterate import star_components as components


def shingles(text, k=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    label, links = list(range(n)), [0] * n

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                label[find(i)] = find(j)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted((str(rows[i][0]), str(least[find(i)]), links[i], len(sets[i])) for i in range(n))


def corpus(rng, groups=12, size=25):
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 5, 30, 150, 400]))]
        for _ in range(rng.randint(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append(rng.choice([" ", "\n", "  "]).join(w))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    texts = corpus(random.Random(6)) + [None, "", " \n", "a", "a", "a b c d", "é é é é é é"]
    return list(enumerate(texts))


def result(df):
    return sorted((str(r[0]), str(r.class_id), r.n_links, r.n_shingles) for r in jaccard.jaccard_join(df).collect())


def test_matches_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, digest string")
    assert result(df) == brute(rows)
    assert jaccard.jaccard_join(df.limit(0)).count() == 0


def test_small_blocks_change_nothing(spark, rows, monkeypatch):
    for name, value in dict(BUCKET_BLOCK=3, GROUP_BLOCK=4, GROUP_SHINGLES=700, BROADCAST_ROWS=0, PAIRS_AT_ONCE=5).items():
        monkeypatch.setattr(jaccard, name, value)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_repeated_and_null_ids(spark):
    a = " ".join(f"w{i}" for i in range(100))
    rows = [(1, a), (1, a), (None, a), (1, "other words than these here"), (None, "x y z x y z"), (None, "x y z x y z")]
    assert result(spark.createDataFrame(rows, "doc_id int, text string")) == brute(rows)


def test_sql(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.sql(jaccard.SQL["op2_jaccard_join"])
    assert sorted(map(tuple, jaccard.op2_jaccard_join(spark, str(tmp_path)).select(*sql.columns).collect())) == sorted(sql.fetchall())


def test_posterior_table():
    least = jaccard.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(1)
    # pairs at the threshold stay; pairs far from it go
    for similarity, low, high in ((0.8, 0.9999, 1.0), (0.3, 0.0, 0.01)):
        same = rng.random((20_000, jaccard.SKETCH)) < similarity + (1 - similarity) / 256
        stays = np.ones(len(same), bool)
        for k in jaccard.STEPS:
            stays &= same[:, :k].sum(axis=1) >= least[k]
        assert low <= stays.mean() <= high


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(5, 5)]
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(400):
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    out = components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.node: r.label for r in out} == label and len(out) == len(label)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_texts_of_one_hash_lose_no_link(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    texts = []
    for _ in range(12):  # texts of one length share the hash
        base = [f"{rng.randrange(1000):03d}" for _ in range(60)]
        other = list(base)
        other[0] = f"{rng.randrange(1000):03d}"
        texts += [" ".join(base), " ".join(other)]
    rows = list(enumerate(texts))
    monkeypatch.setattr(jaccard, "text_hash", lambda text: F.length(text).cast("long"))
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
