import random

import numpy as np
import pytest

from loomgraph.llm import quality


def brute(words, min_words):
    n = len(words)
    best = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                best[i] = max(best[i], k)
    covered = set()
    for i, b in enumerate(best):
        if b >= min_words:
            covered |= set(range(i, i + b))
    return len(covered), max([b for b in best if b >= min_words], default=0)


@pytest.mark.parametrize("min_words", [1, 2, 3, 5, 8])
def test_measures_match_brute_force(min_words):
    rng = random.Random(min_words)
    texts = [b"", b"one", b"a a", b"a b a b a b a b a b"]
    for _ in range(60):
        words = [rng.choice(["a", "b", "c", "dd"][: rng.randint(1, 4)]) for _ in range(rng.randint(0, 40))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(words).encode())
    found = quality._measure(texts, min_words)
    for i, text in enumerate(texts):
        covered, longest = brute(text.split(), min_words)
        assert (found["n_covered_words"][i], found["longest_repeat"][i]) == (covered, longest), text
        offsets, begin, end = found["spans"]
        spans = list(zip(begin[offsets[i] : offsets[i + 1]], end[offsets[i] : offsets[i + 1]]))
        assert sum(e - b for b, e in spans) == covered and all(0 <= b < e <= len(text.split()) for b, e in spans)


def test_long_text_in_linear_memory():
    words = np.random.default_rng(0).integers(0, 50, 200_000)
    words[100_000:100_500] = words[:500]
    best = quality.repeat_lengths(words, np.zeros(len(words), np.int64), 8)
    assert best.max() >= 500


def test_rules_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, None, "x"), (2, "", "x"), (3, "aé #b\n aé #b\n aé #b", "x"), (None, long, "x"), (5, long + " " + long, None), (5, long + " " + long, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    out = {(r.doc_id, r.n_words): r for r in quality.quality_rules(df).collect()}
    assert len(out) == 5 and out[1, 0].base_failed and out[2, 0].word_chars == 0
    assert (out[3, 6].word_chars, out[3, 6].n_symbols, out[3, 6].n_dup_lines) == (12, 3, 1)
    assert out[None, 200].kept and not out[5, 400].kept and out[5, 400].longest_repeat == 200
    assert quality.quality_rules(df.limit(0)).count() == 0


def plain_maximal(words, min_words):
    """{substring: copies} of all that occur twice and that no word on either side extends for all copies."""
    found = {}
    n = len(words)
    for k in range(min_words, n):
        places = {}
        for i in range(n - k + 1):
            places.setdefault(tuple(words[i : i + k]), []).append(i)
        for gram, at in places.items():
            before = {words[i - 1] if i else ("start", i) for i in at}
            after = {words[i + k] if i + k < n else ("end", i) for i in at}
            if len(at) > 1 and len(before) > 1 and len(after) > 1:
                found[gram] = len(at)
    return found


@pytest.mark.parametrize("min_words", [1, 2, 3])
def test_intervals_give_every_maximal_repeat(min_words):
    rng = random.Random(20 + min_words)
    texts = [[rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 25))] for _ in range(60)] + [list("abxabyab"), list("aaaa"), list("abcabc")]
    number = {w: k for k, w in enumerate("abcxy")}
    flat = np.array([number[w] for t in texts for w in t], np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    length, copies, where = quality.maximal_repeats(flat, doc, *quality.common_prefixes(flat, doc, min_words))
    names = "abcxy"
    got = [dict() for _ in texts]
    for k, c, at in zip(length.tolist(), copies.tolist(), where.tolist()):
        gram = tuple(names[x] for x in flat[at : at + k])
        assert gram not in got[doc[at]]
        got[doc[at]][gram] = c
    assert got == [plain_maximal(t, min_words) for t in texts]
    found = quality._measure([" ".join(t).encode() for t in texts], min_words)
    assert found["n_maximal_repeats"].tolist() == [len(x) for x in got] and found["most_copies"].tolist() == [max(x.values(), default=0) for x in got]


def test_query_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert quality.op1_quality_rules(spark, str(tmp_path)).collect() == []
