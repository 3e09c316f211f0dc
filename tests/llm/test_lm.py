import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import lm


def tokens(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())] + [b""]


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False for i, _ in rows}
    one, two, docs = Counter(), Counter(), 0
    for i, t in rows:
        if not held[i]:
            w = tokens(t)
            one.update(w)
            two.update(zip([None, *w], w))
            docs += 1
    n, v = sum(one.values()), len(one)

    def level(c):
        return 0 if not c else (3 * 2 ** math.floor(math.log2(c)) - 1) / 2

    out = []
    for i, t in rows:
        w, s = tokens(t), 0.0
        for u, x in zip([None, *w], w):
            c = docs if u is None else level(one[u])
            p = (level(one[x]) + 1) / (n + v + 1)
            s += math.log10(lm.WEIGHT * min(level(two[u, x]), c) / c + (1 - lm.WEIGHT) * p if c else p)
        base = sum(math.log10((one[x] + 1) / (n + 1 * (v + 1))) for x in w)
        out.append((str(i), held[i], len(w), sum(one[x] > 0 for x in w), n, base, s))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(60)] + ["Ünd", "THE", "the", "a|b", " x"]
    texts = [None, "", "  \n", "the"] + [rng.choice([" ", "\n", "\t "]).join(pool[min(int(rng.expovariate(0.1)), 64)] for _ in range(rng.randint(0, 80))) for _ in range(300)]
    return list(enumerate(texts)) + [(7, texts[7]), (None, "the only null")]


def check(got, rows):
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda r: (r[0], r[5]))
    want = sorted(brute(rows), key=lambda r: (r[0], r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)
    # a false positive of the filter changes a term of a score
    assert np.median([abs(g[6] - w[6]) for g, w in zip(got, want)]) < 0.02 * np.median([abs(w[6]) for w in want])
    assert np.mean([abs(g[6] - w[6]) for g, w in zip(got, want)]) < 0.05 * np.mean([abs(w[6]) for w in want])


def test_matches_brute_force(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int").write.parquet(f"{tmp_path}/documents.parquet")
    check(lm.op3_lm_scoring(spark, str(tmp_path)).collect(), rows)


def test_blocks_and_rounds_change_nothing(spark, rows, monkeypatch):
    from loomgraph.llm.common import crc_mod

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = {(r.doc_id, r.base_score): r.score for r in lm.lm_score(df, crc_mod("doc_id", 7) == 2).collect()}
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(lm, "MAX_BROADCAST_BYTES", 400)
    other = lm.lm_score(df, crc_mod("doc_id", 7) == 2).collect()
    check(other, rows)
    assert all(abs(one[r.doc_id, r.base_score] - r.score) < 1e-9 for r in other)


def test_filter_reads_back_levels():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 60_000, dtype=np.uint64)
    counts = np.minimum((1 / rng.random(len(keys))).astype(np.int64), 100_000)
    seg = lm._segment_of(keys, 8)
    parts = {s: lm.build_segment(lm._short(keys[seg == s]), counts[seg == s]).tobytes() for s in range(8)}
    got = lm.Filter(8, parts).levels(keys)
    want = np.floor(np.log2(counts)) + 1
    assert (got >= want).all() and (got == want).mean() > 0.96
    unseen = lm.Filter(8, parts).levels(rng.integers(0, 1 << 63, 60_000, dtype=np.uint64))
    assert (unseen > 0).mean() < 0.04


def test_empty(spark):
    from loomgraph.llm.common import crc_mod

    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.lm_score(df, crc_mod("doc_id", 7) == 2).count() == 0
