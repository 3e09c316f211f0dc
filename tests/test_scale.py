"""Operators whose results must not depend on how rows lie in partitions, or on the size of the input."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import corpus, graphs, iterate, similarity
from loomgraph.operators import tokens as TK


def test_offsets_of_many_rows_in_any_order(spark):
    rng = random.Random(1)
    sizes = [rng.randrange(0, 7) for _ in range(100_000)]
    rows = spark.range(100_000, numPartitions=7).withColumn("doc_id", (F.col("id") * 7919) % 100_000).select("doc_id")
    known = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n int").join(rows, "doc_id").repartition(5, F.rand(3))
    got = {r.doc_id: r.start for r in TK.offsets(known, F.col("n")).select("doc_id", "start").collect()}
    at, want = 0, {}
    for k, n in enumerate(sizes):
        want[k] = at
        at += n
    assert got == want
    stream = known.select("doc_id", F.transform(F.sequence(F.lit(0), F.col("n")), lambda x: x.cast("string")).alias("tokens"))
    blocks = TK.blocks(stream, 1000).select("block_id", F.size("tokens").alias("n")).collect()
    total = sum(n + 1 for n in sizes)
    assert {r.block_id: r.n for r in blocks} == {b: min(1001, total - b * 1000) for b in range(-(-total // 1000)) if min(1001, total - b * 1000) > 1 or b == 0}


def test_corpus_scope_is_one_joined_text(spark):
    rng = random.Random(2)
    docs = [(k, [rng.choice("abcdefg") for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 9]))]) for k in range(400)]
    split = spark.createDataFrame(docs, "doc_id long, tokens array<string>").repartition(6, F.rand(1))
    whole = spark.createDataFrame([(0, [t for _, ts in docs for t in ts])], "doc_id long, tokens array<string>")
    for window in (1, 4, 11):
        rows = lambda f: sorted(map(tuple, f.collect()))
        assert rows(graphs.near_pairs(split, window, "corpus")) == rows(graphs.near_pairs(whole, window))
        assert rows(graphs.distance_cooccurrence(split, window, "corpus")) == rows(graphs.distance_cooccurrence(whole, window))
    assert graphs.near_pairs(split.limit(0), 3, "corpus").isEmpty()
    assert TK.units(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), "corpus").count() == 2


def plain_greedy(edges):
    """Greedy modularity merge by merge: the measure that communities are held against."""
    links, degree = {}, {}
    for a, b, w in edges:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
        links.setdefault(a, {})
        links.setdefault(b, {})
        if a != b:
            links[a][b] = links[b][a] = links[a].get(b, 0) + w
    whole, members = sum(degree.values()), {n: [n] for n in links}
    gain = lambda a, b: links[a][b] / whole - degree[a] * degree[b] / whole**2
    queue = [(-gain(a, b), a, b) for a in links for b in links[a] if a < b]
    heapq.heapify(queue)
    while queue:
        g, a, b = heapq.heappop(queue)
        if a not in links or b not in links[a] or abs(gain(a, b) + g) > 1e-12:
            continue
        if g >= 0:
            break
        for c, w in links.pop(b).items():
            del links[c][b]
            if c != a:
                links[a][c] = links[c][a] = links[a].get(c, 0) + w
        degree[a] += degree.pop(b)
        members[a] += members.pop(b)
        for c in links[a]:
            heapq.heappush(queue, (-gain(a, c), min(a, c), max(a, c)))
    return {n: min(m) for m in members.values() for n in m}


def plain_modularity(edges, named):
    inside, total = {}, {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            total[named[x]] = total.get(named[x], 0) + w
            if named[x] == named[y]:
                inside[named[x]] = inside.get(named[x], 0) + w
    m = sum(total.values())
    return sum(inside.get(c, 0) / m - (t / m) ** 2 for c, t in total.items())


def planted(groups, size, near, far, seed):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b, rng.choice([1.0, 2.0])) for a in range(n) for b in range(a + 1, n) if rng.random() < (near if a // size == b // size else far)]


GRAPHS = {
    "planted": planted(8, 15, 0.5, 0.02, 1),
    "loose": planted(4, 25, 0.2, 0.05, 2),
    "star": [(0, k, 1.0) for k in range(1, 60)] + [(k, k + 1, 0.5) for k in range(1, 59, 2)],
    "ring": [(k, (k + 1) % 40, 1.0) for k in range(39)] + [(0, 39, 1.0)],
    "two": [(0, 1, 3.0)],
    "loops": [(0, 0, 5.0), (0, 1, 1.0), (1, 2, 1.0), (2, 2, 4.0)],
}


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_communities_no_worse_than_greedy(spark, name, monkeypatch):
    edges = GRAPHS[name]
    if name == "star":
        monkeypatch.setattr(iterate, "HOT_EDGES", 5)
        monkeypatch.setattr(iterate, "HOT_SHARE", 100)
    both = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges if a != b], "src long, dst long, weight double")
    found = iterate.modularity_communities(both)
    named = {r.node: r.component for r in found.collect()}
    assert set(named) == {x for a, b, _ in edges for x in (a, b)}
    assert all(named[c] == c and c == min(n for n in named if named[n] == c) for c in named.values())
    value, greedy = plain_modularity(edges, named), plain_modularity(edges, plain_greedy(edges))
    assert iterate.modularity(both, found) == pytest.approx(value)
    assert value >= greedy - 0.02 * abs(greedy) - 1e-9, (value, greedy)


@pytest.mark.parametrize("name", ["loops", "star"])
def test_communities_by_rounds_no_worse_than_greedy(spark, name, monkeypatch):
    monkeypatch.setattr(iterate, "LOCAL_EDGES", 0)
    edges = GRAPHS[name]
    if name == "star":
        monkeypatch.setattr(iterate, "HOT_EDGES", 5)
        monkeypatch.setattr(iterate, "HOT_SHARE", 100)
    both = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges if a != b], "src long, dst long, weight double")
    named = {r.node: r.component for r in iterate.modularity_communities(both).collect()}
    value, greedy = plain_modularity(edges, named), plain_modularity(edges, plain_greedy(edges))
    assert value >= greedy - 0.02 * abs(greedy) - 1e-9, (value, greedy)


def test_communities_of_a_bounded_graph_take_few_jobs(spark):
    edges = planted(6, 20, 0.2, 0.15, 3)  # nearly random: rounds of moves would be many
    both = spark.createDataFrame([(f"n{a}", f"n{b}", w) for x, y, w in edges for a, b in ((x, y), (y, x))], "src string, dst string, weight double")
    spark.sparkContext.setJobGroup("communities", "communities")
    found = iterate.modularity_communities(both).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("communities")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 120 and 0 < len(jobs) < 40, len(jobs)
    named = {int(r.node[1:]): r.component for r in found}
    assert plain_modularity(edges, named) >= plain_modularity(edges, plain_greedy(edges)) * 0.98


def test_communities_of_no_edges(spark):
    empty = spark.createDataFrame([(None, 1, 1.0), (2, 3, 0.0)], "src long, dst long, weight double")
    assert iterate.modularity_communities(empty).isEmpty() and iterate.modularity(empty.limit(0), empty.limit(0).toDF("node", "component", "x")) == 0


def brute_nearest(rows, asked, k):
    unit = {i: np.array(v or [0.0] * 4, float) for i, v in rows}
    unit = {i: v / (np.sqrt(v @ v) or 1.0) for i, v in unit.items()}
    out = {}
    for q in asked:
        best = sorted((-round(float(unit[q] @ v), 12) + 0.0, i) for i, v in unit.items() if i != q)[:k]
        out[q] = [(i, round(-s, 6) + 0.0) for s, i in best]
    return out


def test_vector_search_in_blocks_and_by_index(spark, monkeypatch):
    rng = random.Random(4)
    # copies by the hundred, so one cell is hot; ties go to the least id; null and zero vectors score 0
    rows = [(k, [1.0, 2.0, 0.0, 1.0]) for k in range(150)] + [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(150, 400)] + [(400, None), (401, [0.0] * 4)]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    exact_rows = [(r.id, r.vector) for r in v.collect()]
    asked = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    want = brute_nearest(exact_rows, range(0, 401, 20), 5)

    def found(frame):
        out = {}
        for r in frame.orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append((r.id, round(r.score, 6) + 0.0))
        return out

    assert found(similarity.vector_search(v, asked)) == want
    monkeypatch.setattr(similarity, "CELL_VECTORS", 37)
    monkeypatch.setattr(similarity, "CELL_QUERIES", 4)
    exact = similarity.vector_search(v, asked)
    assert found(exact) == want
    index = similarity.VectorIndex(v)
    assert 1 <= index.probes <= index.cells == 20
    assert found(index.search(asked, probes=index.cells)) == want
    assert similarity.recall(index.search(asked), exact) >= 0.9
    assert index.table.count() == 402  # every row is indexed
    assert similarity.vector_search(v, asked.limit(0)).isEmpty() and similarity.VectorIndex(v.limit(0)).search(asked).isEmpty()
    plan = exact._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("max_distance", [0, 3, 5])
def test_hamming_keys_miss_nothing(spark, max_distance):
    rng = random.Random(max_distance)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 9))) for b in base for _ in range(4)]
    values += [0, (1 << 64) - 1, 1 << 63, values[0]]
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    got = similarity.simhash_pairs(spark.createDataFrame(list(enumerate(signed)), "id int, simhash long"), max_distance).collect()
    want = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= max_distance}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def plain_accepted(pairs, nodes):
    near, accepted = {}, set()
    for a, b in pairs:
        near.setdefault(b, []).append(a)
    for x in sorted(nodes):
        if not any(y in accepted for y in near.get(x, [])):
            accepted.add(x)
    return {x: x in accepted for x in nodes}


@pytest.mark.parametrize("most", [200_000, 40])
def test_earliest_accepted_in_groups_and_in_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(corpus, "GROUP_PAIRS", most)
    rng = random.Random(9)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(130)) if a != b} | {(k, k + 1) for k in range(200, 230)})
    nodes = range(240)
    got = corpus.earliest_accepted(spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r.node: r.accepted for r in got.collect()} == plain_accepted(pairs, nodes)


def test_one_task_settles_what_rounds_leave(spark, monkeypatch):
    """A chain in the order of its ids takes a round for each two nodes, unless it is settled in one task, from the start or once few pairs are left."""
    pairs = [(k, k + 1) for k in range(300)] + [(k, 1000 + k) for k in range(0, 60, 2)]
    for most, limit in ((310, 400), (2_000_000, 12)):
        monkeypatch.setattr(corpus, "GROUP_PAIRS", most)
        spark.sparkContext.setJobGroup(f"settled {most}", "settled")
        got = corpus.earliest_accepted(spark.createDataFrame(pairs, "src long, dst long"), spark.range(1100).toDF("node")).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"settled {most}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert {r.node: r.accepted for r in got} == plain_accepted(pairs, range(1100))
        assert 0 < jobs < limit, (most, jobs)


def test_a_long_chain_takes_few_jobs(spark):
    n = 10_000
    order = list(range(n))
    random.Random(3).shuffle(order)
    pairs = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "src long, dst long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = {r.node: r.accepted for r in corpus.earliest_accepted(pairs, spark.range(n).toDF("node")).collect()}
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == plain_accepted([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], range(n))
    assert jobs < 400, jobs


def test_split_hashes_do_not_depend_on_order_or_groups(spark, monkeypatch):
    rng = random.Random(6)
    keys = [f"{rng.getrandbits(64):016x}" for _ in range(300)] + ["ab" * 8] * 200
    rows = [(("train", "test")[k % 2], x) for k, x in enumerate(keys)]
    one = spark.createDataFrame(rows, "split string, text_hash string")
    rng.shuffle(rows)
    other = spark.createDataFrame(rows, "split string, text_hash string").repartition(5)
    monkeypatch.setattr(corpus, "GROUP_HASHES", 3)
    got = {r.split: (r.n, r.digest) for r in corpus.split_hashes(one).collect()}
    assert got == {r.split: (r.n, r.digest) for r in corpus.split_hashes(other).collect()}
    assert {k: n for k, (n, _) in got.items()} == {"train": 250, "test": 250}
    changed = one.filter("text_hash <> 'abababababababab'").unionByName(one.filter("text_hash = 'abababababababab'").limit(199))
    assert len({r.digest for r in corpus.split_hashes(changed).collect()} & {d for _, d in got.values()}) == 1


def test_shingle_pairs_write_no_row_for_each_gram(spark):
    import glob
    import os
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000)) for _ in range(8)]
    texts += [texts[0][:29_000], texts[1] + "x", texts[1] + "x", texts[2][:20_000]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    folder = spark.conf.get("spark.checkpoint.dir")
    written = lambda: sum(os.path.getsize(p) for p in glob.glob(f"{folder}/loomgraph/**/*.parquet", recursive=True))
    before = written()
    members, pairs = similarity.shingle_pairs(docs, 13, 0.6)
    got = {(r.src, r.dst): r.weight for r in pairs.collect()}
    assert written() - before < 5 * sum(map(len, texts))
    grams = [{t[i : i + 13] for i in range(len(t) - 12)} for t in texts]
    want = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in range(11) for b in range(a + 1, 12) if b != 10}
    want = {p: w for p, w in want.items() if w >= 0.6 and 10 not in p}
    assert got == pytest.approx(want) and set(want) == {(0, 8), (1, 9), (2, 11)}
    assert {r.doc_id: r.rep for r in members.collect()} == {i: min(i, 9) if i == 10 else i for i in range(12)}


def _plans(spark) -> list[str]:
    seen = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [seen.apply(i).physicalPlanDescription() for i in range(seen.size())]


def test_scores_of_a_round_are_never_broadcast(spark):
    users = spark.range(300).select(F.concat(F.lit("u"), "id").alias("src"), F.concat(F.lit("t"), F.col("id") % 7).alias("dst"), (F.col("id") % 3 + 1).cast("double").alias("weight"))
    links = users.unionByName(users.select(F.col("dst").alias("src"), F.lit("sink").alias("dst"), "weight"))
    seen = len(_plans(spark))
    got = {r.node: r.score for r in iterate.pagerank(links, max_iter=3).collect()}
    plans = _plans(spark)[seen:]
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
    nodes, rows = sorted(got), [(r.src, r.dst, r.weight) for r in links.collect()]
    out = {}
    for a, _, w in rows:
        out[a] = out.get(a, 0.0) + w
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(3):
        lost = sum(v for k, v in want.items() if k not in out)
        new = {k: 0.15 / len(nodes) + 0.85 * lost / len(nodes) for k in nodes}
        for a, b, w in rows:
            new[b] += 0.85 * want[a] * w / out[a]
        want = new
    assert got == pytest.approx(want)


def test_similar_rows_meet_few_pairs_and_lose_none(spark, monkeypatch):
    """Rows of random contexts with some near copies: all pairs of the brute force, of candidates a quarter of the pairs that share a context at most."""
    rng = random.Random(8)
    weights = {}
    for k in range(300):
        weights |= {(f"a{k}", f"c{rng.randrange(1000)}"): rng.uniform(0.5, 3) for _ in range(rng.choice([2, 12, 60]))}
    for k in range(0, 300, 10):  # a near copy
        weights |= {(f"b{k}", c): w * rng.uniform(0.8, 1.2) for (a, c), w in list(weights.items()) if a == f"a{k}" and rng.random() < 0.9}
    rows = {}
    for (a, c), w in weights.items():
        rows.setdefault(a, {})[c] = rows.setdefault(c, {})[a] = w
    norm = {a: sum(w * w for w in r.values()) ** 0.5 for a, r in rows.items()}
    names, want, met = sorted(rows), {}, 0
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            common = [c for c in rows[a].keys() & rows[b].keys() if len(rows[c]) <= 50]
            met += bool(common)
            if (x := sum(rows[a][c] * rows[b][c] for c in common) / norm[a] / norm[b]) >= 0.6:
                want[a, b] = want[b, a] = x
    candidates, write = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df, name="cut": [out := write(df, name), candidates.append(out.count()) if name == "near" else None][0])
    monkeypatch.setattr(graphs, "PAIR_ROWS", 50)
    monkeypatch.setattr(graphs, "ENTRY_ROWS", 400)
    edges = spark.createDataFrame([(a, c, w) for (a, c), w in weights.items()], "src string, dst string, weight double").repartition(3)
    got = {(r.src, r.dst): r.weight for r in graphs.similar_rows(edges, 0.6, None, 50).collect()}
    assert got == pytest.approx(want) and len(want) >= 40
    assert len(candidates) == 1 and len(want) / 2 <= candidates[0] <= met / 4


def test_given_edges_meet_pairs_of_vectors_in_their_blocks(spark, monkeypatch):
    """Blocks of few rows, relations stated twice, in both orders and with words without a vector; only the vectors and the relations are shuffled."""
    monkeypatch.setattr(similarity, "BLOCK_NUMBERS", 200)
    rng = np.random.default_rng(5)
    vectors = {f"w{k}": rng.normal(size=8).tolist() for k in range(90)} | {"w90": [0.0] * 8}
    unit = {w: np.array(v) / (np.linalg.norm(v) or 1) for w, v in vectors.items()}
    given = [(f"w{rng.integers(110)}", f"w{rng.integers(110)}") for _ in range(400)]
    given += [(b, a) for a, b in given[:50]] + given[:20]
    want = {}
    for a in unit:
        for b in unit:
            if a < b and (s := float(unit[a] @ unit[b])) >= 0.4:
                want[a, b] = s
    for a, b in given:
        if a != b:
            want[min(a, b), max(a, b)] = max(want.get((min(a, b), max(a, b)), 0), 0.6)
    want |= {(b, a): w for (a, b), w in want.items()}
    out = graphs.semantic_graph(spark.createDataFrame(given, "a string, b string"), spark.createDataFrame(list(vectors.items()), "word string, vector array<double>"), 0.4, None, 0.6)
    got = out.collect()
    assert len(got) == len(want) and {(r.src, r.dst): r.weight for r in got} == pytest.approx(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "SortAggregate" not in plan  # pairs are not summed after they are found


def test_tokens_of_documents_are_counted_in_their_rows(spark, monkeypatch):
    """Nothing is shuffled by document and token before it is packed, and counts are not sent to the driver for a broadcast."""
    import re

    rng = random.Random(4)
    docs = [(k, [f"t{rng.randrange(30)}" for _ in range(20)]) for k in range(60)]
    plans, write = [], similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df, name="cut": [write(df, name), plans.append(df._jdf.queryExecution().executedPlan().toString())][0])
    members, pairs = similarity.document_pairs(spark.createDataFrame(docs, "doc_id long, tokens array<string>"), 0.5)
    assert members.count() == 60 and pairs.count() > 0
    assert len(plans) == 2 and not any(re.search(r"keys=\[rep#\d+L?, token", p) for p in plans) and "BroadcastHashJoin" not in plans[1] and "SortMergeJoin" in plans[1]
