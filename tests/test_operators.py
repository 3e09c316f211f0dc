import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import algebra, corpus, gnn, graphs, iterate, segment, sentences, similarity, tasks
from loomgraph.operators import tokens as TK


def docs(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<string>")


def edges(df):
    return {(r.src, r.dst): r.weight for r in df.collect()}


def graph(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_cooccurrence_weights(spark):
    a = docs(spark, [["a", "b", "a"], ["b", "c"]])
    assert edges(graphs.cooccurrence(a, 1)) == {("a", "b"): 4, ("b", "c"): 2}
    assert edges(graphs.cooccurrence_matrix(docs(spark, [["a", "b", "a"]]), 1)) == {("a", "b"): 2}
    assert graphs.cooccurrence(docs(spark, [["a"]]), 1, 2).count() == 0
    assert edges(graphs.cooccurrence(docs(spark, [["a", "x", "b"], ["a", "b"], []]), 2, 2)) == {("a", "b"): 4}


def test_text_graph_values(spark):
    a = docs(spark, [["a", "b"], ["b", "c"]])
    got = {(r.src, r.dst): r.weight for r in graphs.text_graph(a, 1).collect()}
    assert got["a", "b"] == pytest.approx(math.log(2)) and got["b", "c"] == pytest.approx(math.log(2))
    assert got["a", "doc_0"] == pytest.approx(math.log(1.5) + 1) and got["b", "doc_1"] == pytest.approx(1)


def test_algebra(spark):
    e = graphs.both_ways(graph(spark, [("a", "b", 1.0), ("b", "c", 1.0)]))
    nodes = e.select(F.col("src").alias("node")).distinct()
    looped = algebra.add_self_loops(e, nodes)
    assert {r.node: r.degree for r in algebra.degrees(looped).collect()} == {"a": 2, "b": 3, "c": 2}
    assert edges(algebra.normalized(looped))["a", "b"] == pytest.approx(1 / math.sqrt(6))
    directed = graph(spark, [("a", "b", 1.0)])
    assert edges(algebra.edge_list(directed, True)) == {("a", "b"): 1} == edges(algebra.normalized(directed, True))
    assert edges(algebra.undirected_from_upper(graph(spark, [("a", "b", 1.0), ("b", "a", 9.0), ("c", "a", 2.0)]))) == {("a", "b"): 1, ("b", "a"): 1}
    assert all(abs(v - 1) < 1e-12 for v in [sum(w for (s, _), w in edges(algebra.row_normalized(looped)).items() if s == x) for x in "abc"])
    assert [r.node for r in algebra.top_nodes(e.withColumn("src", F.concat("src", F.lit("word"))), 1).collect()] == ["bword"]
    assert algebra.negative_edges(e, spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "node_id long, label string"), 3).join(e, ["src", "dst"]).count() == 0


def test_prune_is_symmetric(spark):
    rng = random.Random(0)
    e = graphs.both_ways(graph(spark, [(f"n{a}", f"n{b}", float(rng.randint(1, 9))) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.6]))
    got = edges(graphs.prune(e, 1))
    assert got and all(got[b, a] == w for (a, b), w in got.items())
    assert set(edges(graphs.prune(e, 2, 5.0)).values()) <= {5.0, 6.0, 7.0, 8.0, 9.0}


def test_association_against_numpy(spark):
    rng = random.Random(1)
    lists = [[rng.choice("abcdef") for _ in range(20)] for _ in range(5)]
    a = docs(spark, lists)
    base = graphs.distance_cooccurrence(a, 3)
    want = {}
    for t in lists:
        for i in range(len(t)):
            for k in (1, 2, 3):
                if i + k < len(t) and t[i] != t[i + k]:
                    p = tuple(sorted((t[i], t[i + k])))
                    want[p] = want.get(p, 0) + 1 / k
    assert edges(base) == pytest.approx(want)
    total, n = 2 * sum(want.values()), 100
    f = {x: sum(t.count(x) for t in lists) for x in "abcdef"}
    ppmi = {p: math.log((w / total) / (f[p[0]] / n * f[p[1]] / n)) for p, w in want.items()}
    assert edges(graphs.association(base, graphs.frequent(a, 1), "ppmi")) == pytest.approx({p: w for p, w in ppmi.items() if w > 0})
    rows = {x: np.array([max(0.0, ppmi.get(tuple(sorted((x, y))), 0.0)) if x != y else 0.0 for y in "abcdef"]) for x in "abcdef"}
    cos = {(x, y): rows[x] @ rows[y] / (np.linalg.norm(rows[x]) * np.linalg.norm(rows[y])) for x in "abcdef" for y in "abcdef" if x < y and rows[x].any() and rows[y].any()}
    got = edges(graphs.distributional_edges(base, graphs.frequent(a, 1), 0.05, None))
    for p, w in got.items():
        if p[0] < p[1]:
            assert w <= cos[p] + 1e-9


def test_relations(spark):
    words = spark.createDataFrame([("کتاب",), ("کتابها",), ("##abx",), ("abc",), ("##ab",)], "token string")
    assert ("کتاب", "کتابها") in edges(graphs.stem_edges(words))
    assert set(edges(graphs.subword_edges(words))) == {("##ab", "##abx")}
    a = docs(spark, [["x", "y", "می", "z"], ["x"]])
    assert edges(graphs.dependency_edges(a)) == {("x", "می"): 1, ("y", "می"): 1, ("می", "z"): 1}
    got = edges(graphs.word_document_edges(docs(spark, [["a", "a", "b"], []])))
    assert got == {("a", "document:0"): 1.0, ("b", "document:0"): 0.5}
    topics = edges(graphs.topic_document_edges(docs(spark, [["a", "b", "a"], ["a"], ["c"]]), 2))
    assert len({s for s, _ in topics}) == 2 and len({t for _, t in topics if t.startswith("document:")}) == 2
    assert graphs.relation_names(["word-doc", "PMI", "pmi"]) == ["word_document", "pmi"]
    with pytest.raises(ValueError):
        graphs.relation_names(["nope"])
    multi = graphs.multi_relation_graph(docs(spark, [["a", "b", "c"], ["a", "c"]]), ["cooccurrence", "word_document", "stem"], top_k=1)
    pairs = {(r.src, r.dst, r.relation) for r in multi.collect()}
    assert all((b, a, k) in pairs for a, b, k in pairs)
    nodes = graphs.graph_nodes(multi).orderBy("node_id").collect()
    assert [n.node_type for n in nodes] == ["token"] * 3 + ["document"] * 2 and [n.node_id for n in nodes] == list(range(5))


def test_orthographic_matches_all_pairs(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(120)})
    grams = {w: {w[i : i + 3] for i in range(max(1, len(w) - 2))} for w in words}
    want = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in words for b in words if a != b}
    got = edges(graphs.orthographic_edges(spark.createDataFrame([(w,) for w in words], "token string"), 0.5, None))
    assert got == pytest.approx({p: w for p, w in want.items() if w >= 0.5})


def test_semantic_and_social(spark):
    vectors = spark.createDataFrame([("cat", [1.0, 0.0]), ("dog", [0.9, 0.1]), ("car", [0.0, 1.0])], "word string, vector array<double>")
    given = spark.createDataFrame([("cat", "kitten"), ("cat", "cat")], "a string, b string")
    got = edges(graphs.semantic_graph(given, vectors, 0.8))
    assert got["cat", "dog"] > 0.8 and got["dog", "cat"] > 0.8 and got["kitten", "cat"] == 1.0 and ("cat", "car") not in got
    lines = spark.createDataFrame([("u", "v", 2.0, 1), ("v", "u", None, 2), ("u", "u", 1.0, 3)], "u string, v string, w double, line int")
    assert edges(graphs.social_graph(lines)) == {("u", "v"): 1.0, ("v", "u"): 1.0}


def test_pagerank(spark):
    e = graph(spark, [("0", "1", 1.0), ("2", "0", 1.0)])
    got = {r.node: r.score for r in iterate.pagerank(e).collect()}
    p = np.full(3, 1 / 3)
    m = np.array([[0, 1, 0], [1 / 3] * 3, [1, 0, 0]])
    for _ in range(200):
        p = 0.05 + 0.85 * m.T @ p
    assert sum(got.values()) == pytest.approx(1) and [got["0"], got["1"], got["2"]] == pytest.approx(list(p), abs=1e-5)


def test_components_and_communities(spark):
    e = graph(spark, [(f"{i:03d}", f"{i + 1:03d}", 1.0) for i in range(40) if i % 10 != 9] + [("x", "y", 1.0)])
    got = {r.node: r.component for r in iterate.connected_components(e).collect()}
    assert got["019"] == "010" and got["y"] == "x" and len(set(got.values())) == 5
    two = {r.node: r.community for r in iterate.largest_communities(spark.createDataFrame(list(got.items()), "node string, component string"), 2).collect()}
    assert {v for k, v in two.items() if k < "010"} == {0} and {v for k, v in two.items() if k >= "010"} == {1}


def test_retrieval(spark):
    e = spark.createDataFrame([("a", "b", "r", 2.0), ("b", "a", "r", 2.0), ("b", "c", "r", 4.0), ("c", "b", "r", 4.0), ("a", "d", "s", 1.0), ("d", "a", "s", 1.0)], "src string, dst string, relation string, weight double")
    nodes, found = iterate.retrieve(e, spark.createDataFrame([("a",)], "node string"), depth=2, max_nodes=4, max_edges=8, relation_weights={"s": 0.5})
    scores = {r.node: r.score for r in nodes.collect()}
    # each hop may raise a score again: a by way of b, b by way of the raised a
    assert scores["d"] == pytest.approx(1.25) and scores["c"] == pytest.approx(2 + 4 / 3) and scores["b"] == 2 and len(scores) <= 4
    assert found.count() <= 8


def test_vocabulary_and_blocks(spark):
    a = docs(spark, [["b", "a", "a"], ["c", "b"], []])
    v = TK.vocabulary(a).orderBy("token_id").collect()
    assert [(r.token, r.cnt, r.df) for r in v] == [("b", 2, 2), ("a", 2, 1), ("c", 1, 1)]
    assert [list(r.ids) for r in TK.encode(a, TK.vocabulary(a, 2)).orderBy("doc_id").collect()] == [[5, 6, 6], [1, 5], []]
    got = {r.block_id: list(r.tokens) for r in TK.blocks(a, 2).collect()}
    assert got == {0: ["b", "a", "a"], 1: ["a", "c", "b"]}
    assert [r.start for r in TK.offsets(a, F.size("tokens")).orderBy("doc_id").collect()] == [0, 3, 5]


def test_search_and_pairs(spark):
    lists = [t.split() for t in ("apple banana", "car bus", "apple apple banana")]
    asked = spark.createDataFrame([(["apple", "banana"],)], "tokens array<string>")
    assert [r.doc_id for r in similarity.search_documents(docs(spark, lists), asked).collect()] == [0, 2, 1]
    members, pairs = similarity.document_pairs(docs(spark, [*lists, lists[0][::-1], []]), 0.5)
    assert set(edges(pairs)) == {(0, 2)}
    assert {r.doc_id: r.rep for r in members.collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 4}
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, vector array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j): float(u[i] @ u[j]) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.8}
    assert edges(similarity.vector_pairs(v, 0.8)) == pytest.approx(want)


def test_simhash_pairs_match_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 7))) & (2**64 - 1) for b in base for _ in range(4)]
    rows = [(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(values)]
    got = {(r.src, r.dst): r.distance for r in similarity.simhash_pairs(spark.createDataFrame(rows, "id int, simhash long")).collect()}
    assert got == {(i, j): (values[i] ^ values[j]).bit_count() for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 5}


def test_build_corpus_matches_greedy(spark):
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(15)]
    texts = [None, "", "short", "1234567890 1234567890 1234567890"]
    for _ in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(40)] = f"w{rng.randrange(500)}"
        texts.append(rng.choice([" ", "  "]).join(w))
    known = [base[0], base[1]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.reason for r in corpus.build_corpus(rows, spark.createDataFrame([(k,) for k in known], "text string"), script="A-Za-z0-9").collect()}
    hashes = {r.doc_id: r.h for r in rows.select("doc_id", X.simhash(X.tokenize(F.lower(F.coalesce("text", F.lit(""))))).alias("h")).collect()}
    accepted, keys, want = [], set(), {}
    for i, t in enumerate(texts):
        k = " ".join((t or "").lower().split())
        reason = None
        if not k:
            reason = "empty"
        elif len(k) < 20:
            reason = "too_short"
        elif k in keys:
            reason = "exact_duplicate"
        elif any(((hashes[i] ^ hashes[j]) & (2**64 - 1)).bit_count() <= 5 for j in accepted):
            reason = "near_duplicate"
        elif k in {" ".join(x.split()) for x in known}:
            reason = "eval_contamination"
        want[i] = reason
        if reason is None:
            accepted.append(i)
            keys.add(k)
    assert got == want and {"exact_duplicate", "near_duplicate", "eval_contamination", None} <= set(got.values())


def test_splits(spark):
    assert corpus.split_counts(2, 0.5, 0.0) == (1, 0) and corpus.split_counts(10, 0.25, 0.05) == (2, 1)
    rows = spark.createDataFrame([(i, f"h{i}") for i in range(200)], "doc_id int, text_hash string")
    n = {r.split: r["count"] for r in corpus.split(rows).groupBy("split").count().collect()}
    assert n == {"train": 170, "validation": 20, "test": 10}
    assert corpus.split_hashes(corpus.split(rows)).count() == 3


def test_summary_and_metrics(spark):
    d = spark.createDataFrame([(1, "alpha beta beta. alpha beta. gamma delta."), (2, None), (3, "one")], "doc_id int, text string")
    got = tasks.textrank(d, 2).orderBy("doc_id", "rank_pos").collect()
    assert [r.sentence for r in got] == ["alpha beta beta", "alpha beta", "one"]
    p = spark.createDataFrame([(0, 0), (1, 2), (2, 1), (1, 1)], "y_true int, y_pred int")
    assert tasks.accuracy(p).first()[0] == 0.5 == tasks.macro_f1(p).first()[0]
    assert {(r.y_true, r.y_pred): r.n for r in tasks.confusion(p).collect()} == {(a, b): int((a, b) in {(0, 0), (1, 1), (1, 2), (2, 1)}) for a in range(3) for b in range(3)}
    q = spark.createDataFrame([(1, "the cat sat", ["a cat sat", "x"]), (2, "", [""]), (3, "A b!", ["a B"])], "id int, prediction string, answers array<string>")
    f = {r.id: (r.exact, r.f1) for r in tasks.answer_scores(q).collect()}
    assert f[1][1] == pytest.approx(2 / 3) and f[2] == (1, 1.0) and f[3] == (1, 1.0)
    assert tasks.perplexity(spark.createDataFrame([(2.0, 1), (4.0, 1)], "loss double, tokens int")).first()[1] == pytest.approx(math.exp(3))
    k = tasks.keyword_scores(spark.createDataFrame([(1, w) for w in ["cat", "cat", "dog", "از", "7", "x"]], "doc_id int, token string")).collect()
    assert [(r.token, r["count"], r.score) for r in k] == [("cat", 2, 0.666667), ("dog", 1, 0.333333)]


def test_sage_and_attention_against_numpy(spark):
    rng = np.random.default_rng(3)
    a = (rng.random((5, 5)) < 0.6) * rng.integers(1, 5, (5, 5))
    np.fill_diagonal(a, 0)
    x, w1, w2 = rng.normal(size=(5, 3)), rng.normal(size=(3, 2)), rng.normal(size=(3, 2))
    e = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(5) for j in range(5) if a[i, j]], "src int, dst int, weight double")
    f = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(5) for j in range(3)], "node int, feature int, value double")

    def matrix(df, width):
        out = np.zeros((5, width))
        for r in df.collect():
            out[r.node, r.feature] = r.value
        return out

    mean = np.divide(a @ x, a.sum(1, keepdims=True), out=np.zeros((5, 3)), where=a.sum(1, keepdims=True) > 0)
    assert np.allclose(matrix(gnn.sage_layer(e, f, w1, w2), 2), x @ w1 + mean @ w2)
    h, l, r = x @ w1, rng.normal(size=2), rng.normal(size=2)
    s = (h @ l)[:, None] + (h @ r)[None, :]
    s = np.where(s > 0, s, 0.2 * s)
    m = (a > 0) | np.eye(5, dtype=bool)
    p = np.where(m, np.exp(s - s.max()), 0)
    assert np.allclose(matrix(gnn.gat_layer(e, f, w1, l, r), 2), p / p.sum(1, keepdims=True) @ h)
    assert gnn.social_embeddings(e, f, 3, (4, 2), samples=1).groupBy("feature").count().count() == 2


def test_common_directions_and_embeddings(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6)) + 5
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, vector array<double>").repartition(4)
    got = np.array([r.vector for r in gnn.remove_common(v, 2, 6).orderBy("id").collect()])
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    c = c - c @ vt[:2].T @ vt[:2]
    assert np.allclose(got, c / np.linalg.norm(c, axis=1, keepdims=True), atol=1e-8)
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vector array<double>")
    assert [list(r.vector) for r in gnn.mean_embedding(docs(spark, [["a", "b", "z"], ["z"]]), words, 2).orderBy("doc_id").collect()] == [[0.5, 0.5], [0.0, 0.0]]


def test_classifier(spark):
    rng = random.Random(6)
    lists = [[rng.choice(["ball", "goal", "team"] if i % 2 else ["vote", "law", "party"]) for _ in range(8)] + ["the"] for i in range(40)]
    a = docs(spark, lists)
    labels = spark.createDataFrame([(i, "sports" if i % 2 else "politics") for i in range(30)], "doc_id long, label string")
    got = {r.doc_id: r.label_pred for r in gnn.TextClassifier(256).fit(a, labels).predict(a).collect()}
    assert all(got[i] == ("sports" if i % 2 else "politics") for i in range(30, 40))


def test_segmentation(spark):
    ranks = {("a", "b"): 0, ("ab", "c"): 1, ("c", segment.END): 2}
    assert segment.merge_word("abcab", ranks) == ["abc", "##ab"] and segment.merge_word("", ranks) == []
    assert segment.best_pieces("abcx", {"ab": -1.0, "c": -1.0, "a": -3.0, "b": -3.0, "abc": -5.0}) == ["ab", "##c", "##x"]
    words = spark.createDataFrame([("abc",), ("abc",), (None,)], "token string")
    assert {r.token: r.pieces for r in segment.segment_words(words, lambda w: segment.merge_word(w, ranks)).collect()} == {"abc": ["abc"], None: []}


def test_components_split_hot_nodes(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(0, i) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 80)] + [(2000 + i, 2001 + i) for i in range(120)]
    pairs += [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(60)] + [(7, 7), (2000, 1050)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    edges_ = spark.createDataFrame(pairs, "src long, dst long").repartition(5)
    for most in (1, 50, 1000):
        monkeypatch.setattr(iterate, "HOT_EDGES", most)
        assert {r.node: r.component for r in iterate.connected_components(edges_).collect()} == {x: find(x) for x in parent}
    assert iterate.connected_components(edges_.limit(0)).count() == 0


def test_greedy_modularity(spark):
    cliques = [(a, b, 1.0) for base in (0, 10, 20) for a in range(base, base + 6) for b in range(a + 1, base + 6)] + [(0, 10, 1.0), (10, 20, 1.0)]
    both = spark.createDataFrame(cliques + [(b, a, w) for a, b, w in cliques], "src int, dst int, weight double")
    assert {r.node: r.component for r in iterate.greedy_modularity(both).collect()} == {x: x // 10 * 10 for base in (0, 10, 20) for x in range(base, base + 6)}


def test_article_and_dataset_splits(spark):
    assert corpus.article_split_counts(1, 0.5) == (0, 0) and corpus.article_split_counts(3, 0.9) == (2, 0) and corpus.article_split_counts(10, 0.01) == (1, 0)
    assert corpus.dataset_split_counts(10, 0.7, 0.15, 0.15) == (2, 2) and corpus.dataset_split_counts(3, 0, 1, 1) == (1, 1) and corpus.dataset_split_counts(2, 1, 1, 1) == (0, 1)
    rows = spark.createDataFrame([(i, f"k{i}") for i in range(700)], "doc_id int, text_hash string")
    got = {r.split: r["count"] for r in corpus.split(rows, 0.1, 0.05).groupBy("split").count().collect()}
    assert got == {"train": 595, "validation": 70, "test": 35}
    keys = sorted(f"{random.Random(i).getrandbits(64):016x}" for i in range(500))
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [corpus.smallest_key(frame, i, "k") for i in (1, 250, 500)] == [keys[0], keys[249], keys[499]]


def test_heads_ids_and_node_paths(spark):
    words = spark.createDataFrame([(1, 1, 2, "a"), (1, 2, 0, "b"), (1, 3, 2, "c"), (2, 1, 0, "a")], "sentence int, word int, head int, text string")
    nodes, found = graphs.heads_graph(words)
    assert nodes.count() == 4 and edges(found) == {("1:2", "1:1"): 1.0, ("1:2", "1:3"): 1.0}
    ids = spark.createDataFrame([(0, [2, 7, 1, 8, 7, 3])], "seq_id int, ids array<long>")
    assert edges(graphs.ids_graph(ids, 2)) == {(7, 8): 1.0, (8, 7): 1.0}
    assert edges(graphs.ids_graph(ids, 2, directed=False)) == {(7, 8): 2.0, (8, 7): 2.0}
    named = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "node_id long, label string")
    assert [r.path for r in algebra.node_paths(named, 5).orderBy("place").collect()] == ["x -> y", "y -> z"]
    assert [r.path for r in algebra.node_paths(named, 1).collect()] == ["x"]
    e = spark.createDataFrame([("کتابم", "گل", "r", 2.0), ("خانه", "گل", "r", 3.0), ("از", "کتاب", "r", 9.0)], "src string, dst string, relation string, weight double")
    assert [r.src for r in algebra.focus_evidence(e, spark.createDataFrame([("کتاب",)], "term string")).collect()] == ["کتابم"]


def test_byte_fallback_round_trip(spark):
    names = [(f"<0x{b:02X}>", b) for b in range(256)] + [("سلام", 256), ("،", 257)]
    vocab = spark.createDataFrame(names, "token string, token_id long")
    a = docs(spark, [["سلام", "،", "واژه"], ["z"], []])
    got = {r.doc_id: list(r.ids) for r in TK.encode(a, vocab, bos=2, eos=3, byte_fallback=True).collect()}
    assert got[0] == [2, 261, 262, *[b + 5 for b in "واژه".encode()], 3] and got[1] == [2, 127, 3] and got[2] == [2, 3]
    back = {r.doc_id: r.text for r in TK.decode(TK.encode(a, vocab, bos=2, eos=3, byte_fallback=True), vocab).collect()}
    assert back == {0: "سلام، واژه", 1: "z", 2: ""}
    assert {r.doc_id: r.text for r in TK.decode(spark.createDataFrame([(0, [2, 9999, 261])], "doc_id int, ids array<long>"), vocab, skip_special=False).collect()} == {0: "<bos> <unk> سلام"}


def test_windows_pad_and_shift(spark):
    enc = spark.createDataFrame([(0, [1, 2, 3]), (1, [9]), (2, [4, 5])], "doc_id int, ids array<long>")
    got = [(r.example, list(r.input_ids), list(r.target_ids)) for r in TK.windows(enc, 3, 2).orderBy("example").collect()]
    assert got == [(0, [1, 2, 3], [2, 3, 4]), (1, [3, 4, 0], [4, 5, -100])]
    assert [r.labels for r in TK.curriculum(TK.windows(enc, 3, 2)).collect()] == [2, 3]
    with pytest.raises(ValueError):
        TK.windows(enc, 1)


def test_simhashes_are_voted_in_one_pass_and_compared_in_tasks(spark):
    """Bits against votes token by token, in batches of many rows; candidates are no rows of a join."""
    rng = random.Random(5)
    lists = [[f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 2, 7, 300]))] for _ in range(3000)]
    rows = spark.createDataFrame([*enumerate(lists), (9000, None)], "id long, tokens array<string>")
    h = {r.t: r.h & (2**64 - 1) for r in spark.createDataFrame([(f"w{k}",) for k in range(50)], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    hashed = rows.select("id", X.simhash("tokens").alias("simhash"))
    assert "aggregate(" not in hashed._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.simhash & (2**64 - 1) for r in hashed.collect()}
    want = {k: sum(1 << b for b in range(64) if sum(1 if h[t] >> b & 1 else -1 for t in x) >= 0) for k, x in enumerate(lists)}
    assert got == want | {9000: 0}
    nodes = hashed.groupBy("simhash").agg(F.min("id").alias("id"))
    found = similarity.simhash_pairs(nodes)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_sentence_edges_without_shuffle(spark, monkeypatch):
    """Against dense rows, also with few pairs at a time; texts without sentences or words have no edges, and no row leaves its task."""
    import pyarrow as pa

    rng = random.Random(4)
    texts = [[[rng.choice(["aa", "bb", "cc", "dd", "ee", "ff"]) for _ in range(rng.randrange(1, 6))] for _ in range(rng.choice([0, 1, 2, 9, 30]))] for _ in range(40)]
    want = {}
    for k, found in enumerate(texts):
        vocab = sorted({w for f in found for w in f})
        tf = np.array([[f.count(w) for w in vocab] for f in found], float).reshape(len(found), len(vocab))
        x = tf * (np.log((1 + len(found)) / (1 + (tf > 0).sum(axis=0))) + 1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want |= {(k, i, j): (x @ x.T)[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if (x @ x.T)[i, j] > 0}
    rows = [(k, ". ".join(map(" ".join, f))) for k, f in enumerate(texts)] + [(90, None), (91, "!!. ?. a. b")]
    edges = sentences.sentence_edges(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Exchange" not in edges._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.src, r.dst): r.weight for r in edges.collect()} == pytest.approx(want)
    monkeypatch.setattr(sentences, "AT_ONCE", 7)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts, pa.list_(pa.list_(pa.string())))], names=["doc_id", "words"])
    few = [r for b in sentences._batch_edges(batch) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert {r[:3]: r[3] for r in few} == pytest.approx(want) and len(few) == len(want)


def test_attention_summary_is_that_of_the_plain_layer(spark):
    import re

    text = "alpha beta beta. gamma delta alpha. delta epsilon. beta gamma zeta zeta."
    found = [x.strip() for x in re.split(r"[.!؟۔]", text) if x.strip()]
    words = [re.findall(r"\w\w+", x) for x in found]
    vocab = sorted({w for f in words for w in f})
    n = len(found)
    tf = np.array([[f.count(w) for w in vocab] for f in words], float)
    x = tf * (np.log((1 + n) / (1 + (tf > 0).sum(axis=0))) + 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    rng = np.random.default_rng(0)
    draw = lambda a, b, *size: rng.uniform(-np.sqrt(6 / (a + b)), np.sqrt(6 / (a + b)), size)
    w, att, out = draw(len(vocab), 32, len(vocab), 32), draw(len(vocab), 32, 64, 1), draw(32, 16, 32, 16)
    h = x @ w
    rows = []
    for i in range(n):
        e = np.array([v if (v := float((np.concatenate([h[i], h[j]]) @ att)[0])) > 0 else 0.2 * v for j in range(n)])
        e = np.where((cosine[i] > 1e-12) | (np.arange(n) == i), e, -np.inf)
        p = np.exp(e - e.max())
        rows.append((p / p.sum()) @ h)
    want = np.linalg.norm(np.array(rows) @ out, axis=1)
    assert np.allclose(sentences.attention_norms(found, 32, 16, 0), want)
    got = sentences.attention_summary(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "!!")], "doc_id int, text string"), 2).collect()
    assert [(r.doc_id, r.rank_pos) for r in got] == [(1, int(i)) for i in sorted(np.argsort(want)[::-1][:2])]


def test_arrays_are_looked_up_in_blocks(spark):
    """Encoding and windows against plain Python, with nulls, empty rows, ids that repeat and structs as ids; no row for a token is made."""
    rng = random.Random(3)
    lists = [[rng.choice(["a", "b", "c", "", "é", None]) for _ in range(rng.choice([0, 1, 2, 9, 40]))] for _ in range(60)]
    a = spark.createDataFrame([(i // 2, x) for i, x in enumerate(lists)], "doc_id long, tokens array<string>").repartition(3)
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("<0xC3>", 2), ("<0xA9>", 3)], "token string, token_id long")
    plain = lambda t: [{"a": 5, "b": 6}.get(t, 1)]
    spelled = lambda t: [7, 8] if t == "é" else [{"a": 5, "b": 6}.get(t, 1)]
    for fallback, one in ((False, plain), (True, spelled)):
        found = TK.encode(a, vocab, byte_fallback=fallback)
        assert sorted((r.doc_id, list(r.ids)) for r in found.collect()) == sorted((i // 2, [y for t in x for y in one(t)]) for i, x in enumerate(lists))
        assert "posexplode(tokens" not in found._jdf.queryExecution().optimizedPlan().toString()
    structs = TK.encode(a.select(F.struct("doc_id", F.lit(1).alias("k")).alias("doc_id"), "tokens"), vocab)
    assert structs.filter("doc_id.k = 1").count() == 60
    kept = graphs.compressed(a, spark.createDataFrame([("a",), ("é",)], "token string"))
    assert sorted((r.doc_id, list(r.tokens)) for r in kept.collect()) == sorted((i // 2, y) for i, x in enumerate(lists) if (y := [t for t in x if t in ("a", "é")]))
    for block, step in ((3, 2), (4, 4), (2, 7), (8, 1)):
        enc = spark.createDataFrame([(i, [100 * i + k for k in range(len(x))]) for i, x in enumerate(lists)], "doc_id long, ids array<long>")
        stream = [100 * i + k for i, x in enumerate(lists) if len(x) > 1 for k in range(len(x))]
        want = {}
        for e in range(0, -(-max(len(stream) - 1, 1) // step)):
            c = stream[e * step : e * step + block + 1]
            if len(c) > 1:
                want[e] = (c[:-1] + [0] * (block - len(c) + 1), c[1:] + [-100] * (block - len(c) + 1))
        assert {r.example: (list(r.input_ids), list(r.target_ids)) for r in TK.windows(enc, block, step).collect()} == want


def test_words_come_back_from_their_ids(spark, tmp_path):
    """The query's round trip: rare words in a row, known words between them."""
    from loomgraph.plans.queries import QUERIES

    texts = ["rare1x rare2x the the the rare3x", "", None, "été the ü_1 12 34 the", "the"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text_sha256 for r in QUERIES["decode_ids"](spark, str(tmp_path)).collect()}
    import hashlib

    assert got == {i: hashlib.sha256((x or "").encode()).hexdigest() for i, x in enumerate(texts)}


def test_orthographic_edges_at_the_threshold_and_of_one_common_gram(spark):
    # 0.55 * 20 is a little over 11 in doubles; sets of 11 and 20 trigrams, one within the other, reach it all the same
    word = "abcdefghijklmnopqrstuv"
    words = [word, word[:13], *(f"xyz{c}{d}" for c in "0123456789" for d in "0123456789"), "ab", "a", "xy"]
    got = edges(graphs.orthographic_edges(spark.createDataFrame([(w,) for w in words], "token string"), 0.55, None))
    grams = {w: {w[i : i + 3] for i in range(max(1, len(w) - 2))} for w in words}
    want = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in words for b in words if a != b}
    assert got == pytest.approx({p: w for p, w in want.items() if w >= 0.55}) and got[word, word[:13]] == 0.55
