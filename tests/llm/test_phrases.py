import random
import re
from collections import Counter

import pytest

from loomgraph.llm import phrases


def brute(docs, longest=5, min_count=3, percent=100, top=2000):
    count, total = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split("[ \t]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        found = {g: c for g, c in f.items() if len(g) > 1 and c >= min_count}
        rows = []
        for g, a in found.items():
            inside = lambda h, g=g: len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
            if any(inside(h) and 100 * c >= percent * a for h, c in found.items()):
                continue
            score, _, l, r = min((1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))  # noqa: E741
            rows.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(k, t, lang, "x", 2, 3) for k, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string, gram string, m long, f long")


def random_docs(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "times", "É", "é", "a", "b", "x\x00y", "日本"]
    sep = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", " ! ", "\x0b", "\x1c", "\xa0"]
    return [("".join(rng.choice(words) + rng.choice(sep) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "fr", None, "und", "", "en", "en"])) for _ in range(n)]


ODD = [(None, "en"), ("", "en"), (" \t ", None), (",.;", "fr"), ("the " * 500, "en"), ("new york city. " * 3000, "en"), ("a b a b a b a b a", "fr"), ("a b a b a b a b a", "fr")]


@pytest.mark.parametrize(("block", "top", "percent"), [(1, 2000, 100), (4 << 20, 7, 100), (4 << 20, 2000, 60)])
def test_against_plain_counts(spark, monkeypatch, block, top, percent):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    docs = random_docs(150) + ODD
    got = phrases.collocations(frame(spark, docs), min_count=3, top=top, percent=percent)
    assert sorted(map(tuple, got.collect())) == brute(docs, top=top, percent=percent)


def test_a_bitmap_of_false_hits_alone_changes_nothing(spark, monkeypatch):
    docs = random_docs(80, seed=4)
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    got = phrases.collocations(frame(spark, docs), min_count=4)
    assert sorted(map(tuple, got.collect())) == brute(docs, min_count=4)


def test_exact_beyond_64_bits(spark):
    long = 10**12
    grams = spark.createDataFrame([("en", "p q", 2, long), ("en", "p", 1, 3 * long), ("en", "q", 1, 7 * long)], phrases.GRAMS)
    totals = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    row = phrases.scored(phrases.closed(grams), grams, totals).first()
    assert row.score == 1000 * long * 10**14 // (21 * long * long)


def test_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    out = phrases.op12_collocations(spark, str(tmp_path))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.collect() == []
