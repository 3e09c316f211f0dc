import random

import numpy as np
import pytest

from loomgraph.llm import langid

SYLLABLES = {"en": "th er ing and the of on", "de": "sch ung der und ich ein ü", "fr": "ou eau les que é tion", "xx": "ж щ ный ов ст"}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, sentence(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 40)), lang) for i in range(500)]
    return out + [(500, None, "en"), (501, "", "de"), (502, "12 !? \n", "fr"), (503, sentence(rng, "de", 5), None), (504, sentence(rng, "fr", 40_000), None), (None, "the and of", None), (0, *out[0][1:])]


def test_features():
    a, b, none = langid.features(["Ab  ab".encode(), " ab..AB!".encode(), b"12"])
    assert none is None and (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[1].sum() == 7 + 6 + 5


def test_held_out_accuracy(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    got = langid.op9_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and lang[r.doc_id] and r.doc_id < 500]
    assert len(held) > 80 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (500, 501, 502))
    assert by[504].lang_pred == "fr" and by[503].lang_pred == "de" and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert [tuple(r) for r in langid.predict(df, model).collect()] == [(1, "und", 0.0)]
    assert langid.predict(df.limit(0), model).count() == 0


def test_elastic_net_is_sparse_and_temperature_fits():
    rng = np.random.default_rng(0)
    examples = []
    for _ in range(600):
        y = int(rng.integers(2))
        at = np.array([y, 2 + int(rng.integers(40))])
        examples.append((at, np.array([0.8, 0.6]), y))
    w, _ = langid.ftrl(examples, 42, 2, l1=1.0)
    assert (w[2:] == 0).mean() > 0.5 and w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0
    label = rng.integers(2, size=4000)
    sure = np.where(rng.random(4000) < 0.8, label, 1 - label)
    logits = np.eye(2)[sure] * 10
    p = langid.softmax(logits / langid.best_temperature(logits, label)).max(axis=1)
    assert abs(p.mean() - 0.8) < 0.03


def test_document_frequency_covers_all(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    counts, n = langid.document_frequency(df)
    want = np.zeros(1 << langid.BITS, int)
    for found in langid.features([(t or "").encode() for _, t, _ in rows]):
        if found is not None:
            want[found[0]] += 1
    assert (counts == want).all() and n == sum(f is not None for f in langid.features([(t or "").encode() for _, t, _ in rows]))


def test_no_label_is_left_out(spark):
    rng = random.Random(12)
    words = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for k in range(230)}
    rows = [(7 * k + j, " ".join(rng.choices(w, k=20)), lang) for k, (lang, w) in enumerate(words.items()) for j in range(3)]
    df = spark.createDataFrame([*rows, *[(10_000 + i, "12 !?", "l229") for i in range(40)]], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.labels == sorted(words) and (np.abs(model.w).max(axis=0) > 0).all()
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.9
    # a sample that holds one row a label still has them all
    few = langid.train(df.filter("lang < 'l012' OR lang = 'l229'"), sample_per_label=5, full_labels=3)
    assert len(few.labels) == 13 and (np.abs(few.w).max(axis=0) > 0).all()
    with pytest.raises(ValueError):
        langid.train(df, sample_per_label=10, full_labels=3)


def test_matches_a_plain_version(spark, rows):
    """Features, TF-IDF, FTRL and softmax once more, entry by entry and without arrays."""
    import math

    bits, wrap = 8, (1 << 64) - 1

    def grams(text):
        line, out = " " + text.lower() + " ", {}
        kept, last = [], True
        for i, c in enumerate(line):
            if c.isalpha() or i == 0 or last:
                kept.append(ord(c) if c.isalpha() else 32)
            last = c.isalpha()
        for n in (1, 2, 3):
            for i in range(len(kept) - n + 1):
                key = 0
                for c in kept[i : i + n]:
                    key = (key * 0x110000 + c) & wrap
                m = (key + n) * 0x9E3779B97F4A7C15 & wrap
                m = (m ^ m >> 29) * 0x9E3779B97F4A7C15 & wrap
                out[m >> 64 - bits] = out.get(m >> 64 - bits, 0) + 1
        return out if any(c.isalpha() for c in text) else None

    texts = [(t, lang) for _, t, lang in rows[:120]]
    found = [grams(t) for t, _ in texts]
    for plain, fast in zip(found, langid.features([t.encode() for t, _ in texts], bits)):
        assert plain == dict(zip(fast[0].tolist(), fast[1].tolist()))
    df = {}
    for g in found:
        for f in g:
            df[f] = df.get(f, 0) + 1
    idf = [math.log((1 + len(found)) / (1 + df.get(f, 0))) + 1 for f in range(1 << bits)]
    labels = sorted({lang for _, lang in texts})
    examples = []
    for g, (_, lang) in zip(found, texts):
        x = {f: (1 + math.log(c)) * idf[f] for f, c in g.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        examples.append(({f: v / norm for f, v in x.items()}, labels.index(lang)))
    alpha, beta, l1, l2, k = 0.5, 1.0, 0.02, 0.02, len(labels)
    z, n = [[0.0] * k for _ in range((1 << bits) + 1)], [[0.0] * k for _ in range((1 << bits) + 1)]

    def weight(f, y, l1=l1, l2=l2):
        if abs(z[f][y]) <= l1:
            return 0.0
        return -(z[f][y] - math.copysign(l1, z[f][y])) / ((beta + math.sqrt(n[f][y])) / alpha + l2)

    bias = 1 << bits
    order = np.random.default_rng(0)
    for _ in range(3):
        for e in order.permutation(len(examples)):
            x, label = examples[e]
            w = {f: [weight(f, y) for y in range(k)] for f in x} | {bias: [weight(bias, y, 0.0, 0.0) for y in range(k)]}
            x = x | {bias: 1.0}
            s = [sum(x[f] * w[f][y] for f in x) for y in range(k)]
            p = [math.exp(v - max(s)) for v in s]
            p = [v / sum(p) for v in p]
            for f in x:
                for y in range(k):
                    g = x[f] * (p[y] - (y == label))
                    z[f][y] += g - (math.sqrt(n[f][y] + g * g) - math.sqrt(n[f][y])) / alpha * w[f][y]
                    n[f][y] += g * g
    fast = [langid.weights(f, np.array(idf)) for f in langid.features([t.encode() for t, _ in texts], bits)]
    w, b = langid.ftrl([(*f, label) for f, (_, label) in zip(fast, examples)], 1 << bits, k)
    want = np.array([[weight(f, y) for y in range(k)] for f in range(1 << bits)])
    assert np.allclose(w, want, atol=1e-9) and np.allclose(b, [weight(bias, y, 0.0, 0.0) for y in range(k)], atol=1e-9)
    model = langid.Model(labels, np.array(idf), w, b, 1.7, bits)
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    for r in langid.predict(frame, model).collect():
        x, _ = examples[r.doc_id]
        s = [(sum(v * want[f][y] for f, v in x.items()) + b[y]) / 1.7 for y in range(k)]
        p = [math.exp(v - max(s)) for v in s]
        assert r.lang_pred == labels[int(np.argmax(s))] and abs(r.score - max(p) / sum(p)) < 1e-9


def test_sample_comes_as_counts(spark):
    rows = spark.createDataFrame([(0.5, b"ab" * 100_000, "x"), (0.25, b"12", "y")], "u double, text binary, label string")
    got = {r.label: r for r in langid.counted(rows, 8).collect()}
    at, count = next(langid.features([b"ab" * 100_000], 8))
    assert got["y"].at is None and (np.frombuffer(got["x"].at, "<i4") == at).all() and (np.frombuffer(got["x"].count_of, "<i4") == count).all()
