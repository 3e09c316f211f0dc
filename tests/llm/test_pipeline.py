import hashlib
import random
import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import bpe, secrets
from test_decontaminate import brute as contaminated
from test_jaccard import shingles
from test_quality import brute as repeats


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("data"))
    bench = [(i, " ".join(f"b{rng.randrange(500)}" for _ in range(20))) for i in range(5)]
    texts = []
    for g in range(30):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([10, 60, 120]))]
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 5, 30])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            if g % 5 == 0:
                w += bench[g // 5 % 5][1].split()
            if g % 4 == 0:
                w += ["password:", "abcdefgh12", "AKIA" + "Z" * 16]
            if g % 7 == 0:
                w = w * 2
            texts.append(" ".join(w))
    texts += [None, "", "short one"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (4, " ".join(f"other{i}" for i in range(40)), "en", None, 0), (None, " ".join(f"null{i}" for i in range(40)), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, bench


def brute(rows, bench):
    kept = []
    for r in rows:
        w = (r[1] or "").encode().split()
        covered, longest = repeats(w, 8)
        if len(w) >= 20 and 100 * covered <= 30 * len(w) and longest <= 100:
            kept.append(r)
    sets = [shingles(r[1]) for r in kept]
    label = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    groups = {}
    for r, x in zip(kept, label):
        groups.setdefault(x, []).append(r)
    kept = [min(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]
    kept = [r for k, r in enumerate(kept) if not contaminated([(k, r[1])], bench)[k][4]]
    oracle = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    out = []
    for r in kept:
        text = re.sub("AKIA[A-Z0-9]{12,}", "<access>", re.sub("password: [a-z0-9]{8,}", "<assign>", r[1]))
        out.append((str(r[0]), hashlib.sha256(text.encode()).hexdigest(), oracle.encode_ordinary(text)))
    return sorted(out)


def test_matches_brute_force(spark, tables):
    path, rows, bench = tables
    got = sorted((str(r.doc_id), r.decoded_sha256, r.ids) for r in corpus_pipeline.run(spark, path).collect())
    want = brute(rows, bench)
    assert got == want and 10 < len(want) < len(rows) - 20


def test_stages_keep_the_columns(spark, tables):
    path, rows, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert corpus_pipeline.secret_stage(spark, docs, path).count() == len(rows)
    assert all(stage(spark, docs.limit(0), path).count() == 0 for _, stage in corpus_pipeline.STAGES)
    assert {r.kind for r in secrets.RULES} >= {"assign", "access", "hex"}


CLASHES = ("row_hash", "spans", "gone", "gone_id", "gone_h", "hit", "hit_id", "hit_h", "again", "key", "h", "id", "class_id", "kept", "n_words", "bands", "a.b", "tags")


def test_columns_of_clashing_names_pass_through(spark, tables):
    path, rows, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for c in CLASHES[:-1]:
        docs = docs.withColumn(c, F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs = docs.withColumn("tags", F.create_map(F.lit("t"), F.col("doc_id")))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(r.doc_id), str(r.text)) for r in stage(spark, plain, path).collect()), name
        assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in got for c in CLASHES[:-1]), name
        assert all(r.tags == {"t": r.doc_id} for r in got), name
    last = corpus_pipeline.token_stage(spark, docs, path)
    assert last.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and last.count() == len(rows)


def test_of_rows_that_repeat_id_and_text_the_least_stays(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "b", "x"), (1, text, "a", "z"), (1, text, "a", "y"), (1, text, None, "q"), (2, text, "0", "0"), (3, None, "n", "2"), (3, None, "n", "1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = sorted((r.doc_id, r.lang, r.source) for r in corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect() if r.doc_id == 1)
    assert got == [(1, None, "q")]
    got = [(r.lang, r.source) for r in corpus_pipeline.near_duplicate_stage(spark, docs.filter("doc_id = 3"), str(tmp_path)).collect()]
    assert got == [("n", "1")]


def test_very_long_texts_pass_every_stage(spark, tables, tmp_path):
    path, _, _ = tables
    rng = random.Random(2)
    long = " ".join(f"l{rng.randrange(10**9)}" for _ in range(300_000))
    again = long.replace(long.split()[7], "token: abcdefgh1234")
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, again, "en", "s", len(again)), (3, "y " * 400_000, "en", "s", 800_000)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, path).select("doc_id").orderBy("doc_id").collect()] == [1, 2]
    assert [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, path).select("doc_id").orderBy("doc_id").collect()] == [1, 3]
    assert corpus_pipeline.decontamination_stage(spark, docs, path).count() == 3
    clean = {r.doc_id: r for r in corpus_pipeline.secret_stage(spark, docs, path).collect()}
    assert clean[1].text == long and "<assign>" in clean[2].text and clean[2].n_chars == len(clean[2].text)
    assert corpus_pipeline.token_stage(spark, docs, path).filter("n_tokens > 300000").count() == 3
