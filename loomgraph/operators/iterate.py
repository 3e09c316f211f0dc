"""Iterative graph algorithms. Each round is declared on DataFrames; lineage is cut by tables in the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .pairs import give_back, small_batches


def pagerank(edges: DataFrame, damping: float = 0.85, max_iter: int = 100, tol: float | None = 1e-6, nodes: DataFrame | None = None) -> DataFrame:
    """(node, score): weighted PageRank of directed edges; a node without out-weight spreads evenly. Stops when scores move by less than `tol` in sum, or after `max_iter` rounds."""
    if nodes is None:
        nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    nodes = cut(nodes)
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("score", F.lit(0.0))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total")).filter("total > 0")
    links = cut(edges.join(out.hint("merge"), "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    # joins by a sort: the planner would take written scores for small and broadcast them through the driver in each round
    sources = links.select(F.col("src").alias("node"), F.lit(False).alias("sink")).distinct()
    ranks = cut(nodes.join(sources.hint("merge"), "node", "left").select("node", F.coalesce("sink", F.lit(True)).alias("sink"), F.lit(1.0 / n).alias("score"), F.lit(0.0).alias("moved")))
    for k in range(max_iter):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("score"))), F.lit(0.0)).alias("lost"))
        got = links.join(ranks.select(F.col("node").alias("src"), "score").hint("merge"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        value = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        new = ranks.join(got.hint("merge"), "node", "left").crossJoin(F.broadcast(lost)).select("node", "sink", value.alias("score"), F.abs(value - F.col("score")).alias("moved"))
        ranks = cut(new) if tol is not None or k % 4 == 3 else new
        if tol is not None and ranks.agg(F.sum("moved")).first()[0] < tol:
            break
    return ranks.select("node", "score")


#: Nodes with more edges than this, and than one in HOT_SHARE of all, are joined by a broadcast; there are at most HOT_SHARE of them.
HOT_EDGES, HOT_SHARE = 1000, 10_000


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """`edges` (u, v), `n` of them or less, with m, the least v of each u. Edges of a node that has very many stay where they are: their least goes out to them."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")), "least")
    many = F.col("k") > max(HOT_EDGES, n // HOT_SHARE)
    hot = F.broadcast(least.filter(many).drop("k"))
    others = edges.join(F.broadcast(least.filter(many).select("u")), "u", "left_anti").join(least.filter(~many).drop("k"), "u")
    return edges.join(hot, "u").unionByName(others)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).collect()[0]
    return row["n"], row["x"]


def star_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges` (u, v): label is the least node of its component, by alternating large-star and small-star steps.

    Each round is two aggregations with partial sums and two joins, in which no node's edges are
    gathered however many they are; only counts and a checksum come to the driver. Self loops are
    dropped, null ends too. Rounds end when nothing changes; they grow with the square of the
    logarithm of the number of edges at most, beyond which an error says that the input changed.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(e)
    for _ in range(8 + 2 * state[0].bit_length() ** 2):
        if not state[0]:
            break
        # large star: every larger neighbour of a node points to the least of its neighbourhood
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v")
        large = _with_least(both, 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = cut(large, "edges")
        # small star: a node and its lesser neighbours point to the least of these
        marked = _with_least(large, state[0])
        moved = marked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(moved.union(marked.select("u", F.col("m").alias("v"))).distinct(), "edges")
        last, state = state, _state(e)
        if state == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that edges (src, dst) connect each node with; a node has a row if it has an edge that is no loop."""
    return star_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))).withColumnRenamed("label", "component")


def _labelled(edges: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """`edges` (src, dst, weight) with c, the label of dst. Edges of the few `hot` nodes (node) stay where they are: their labels go out to them."""
    named = labels.select(F.col("node").alias("dst"), F.col("label").alias("c"))
    few = F.broadcast(named.join(F.broadcast(hot.select(F.col("node").alias("dst"))), "dst", "left_semi"))
    rest = edges.join(F.broadcast(hot.select(F.col("node").alias("dst"))), "dst", "left_anti")
    return edges.join(few, "dst").unionByName(rest.join(named, "dst"))


def _modularity(inside: DataFrame, labels: DataFrame, whole: float, resolution: float) -> float:
    """Modularity of `labels` (node, label, degree); `inside`: one row with the weight within communities."""
    spread = labels.groupBy("label").agg(F.sum("degree").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("s"))
    row = inside.crossJoin(spread).first()  # one row each
    return (row["w"] or 0.0) / whole - resolution * (row["s"] or 0.0) / whole**2


def _local_moves(edges: DataFrame, whole: float, resolution: float, least_gain: float) -> tuple[DataFrame, float, bool]:
    """((node, label), modularity, moved): nodes of a graph (src, dst, weight; both directions) move to the neighbouring community of the largest gain, all of one half of the nodes at once, until modularity gains less than `least_gain` in both halves.

    A round is one join of the labels and two aggregations with partial sums. A move towards a
    single node goes to the lesser label only, so two singles never swap; the best labels seen stay.
    """
    n = edges.count()
    degrees = cut(edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"), F.count(F.lit(1)).alias("k")), "degrees")
    hot = cut(degrees.filter(F.col("k") > max(HOT_EDGES, n // HOT_SHARE)).select("node"), "hot")
    labels = degrees.select("node", F.col("node").alias("label"), "degree")
    inside = edges.filter("src = dst").agg(F.sum("weight").alias("w"))
    best, best_value, moved, idle, turn = labels, _modularity(inside, labels, whole, resolution), False, 0, 0
    while idle < 2:
        totals = labels.groupBy("label").agg(F.sum("degree").alias("total"), F.count(F.lit(1)).alias("members"))
        near = _labelled(edges.filter("src <> dst"), labels, hot).groupBy("src", "c").agg(F.sum("weight").alias("w"))
        own = labels.select(F.col("node").alias("src"), "label", "degree")
        offers = near.join(own, "src").join(totals.withColumnRenamed("label", "c"), "c")
        # the gain of joining c once the node has left its own community
        gain = F.col("w") - resolution * F.col("degree") * (F.col("total") - F.when(F.col("c") == F.col("label"), F.col("degree")).otherwise(0.0)) / whole
        score = F.struct(F.round(gain, 9).alias("gain"), (F.col("c") == F.col("label")).alias("stay"), "c", "members")
        ranked = offers.groupBy("src", "label", "degree").agg(
            F.min_by(score, F.struct(-F.round(gain, 9), (F.col("c") != F.col("label")), "c")).alias("to"), F.max(F.when(F.col("c") == F.col("label"), F.round(gain, 9))).alias("here")
        )
        alone = totals.select("label", F.col("members").alias("own_members"))
        ranked = ranked.join(alone, "label")
        better = F.col("to.gain") > F.coalesce("here", F.lit(0.0))
        swaps = (F.col("own_members") == 1) & (F.col("to.members") == 1) & (F.col("to.c") > F.col("label"))
        mine = F.pmod(F.xxhash64("src", F.lit(turn // 2)), F.lit(2)) == turn % 2
        chosen = ranked.select(F.col("src").alias("node"), F.when(better & ~swaps & mine, F.col("to.c")).otherwise(F.col("label")).alias("to"))
        labels = cut(labels.join(chosen, "node", "left").select("node", F.coalesce("to", "label").alias("label"), "degree"), "labels")
        both = _labelled(edges, labels, hot).join(labels.select(F.col("node").alias("src"), F.col("label").alias("mine")), "src").filter("c = mine")
        value = _modularity(both.agg(F.sum("weight").alias("w")), labels, whole, resolution)
        if value > best_value + least_gain:
            best, best_value, moved, idle = labels, value, True, 0
        else:
            idle += 1
        turn += 1
    return best.select("node", "label"), best_value, moved


#: Edges, both directions counted, of a graph whose communities one task finds; it holds about 70 bytes for each.
LOCAL_EDGES = 12_000_000


def _moved_one_by_one(a: np.ndarray, b: np.ndarray, w: np.ndarray, degree: np.ndarray, whole: float, resolution: float, least_gain: float) -> np.ndarray:
    """The community of each node 0, 1, ... of a graph (a, b, w; both directions): nodes move in turn to the neighbouring community of the largest gain, and communities become the nodes of the next graph, until modularity gains less than `least_gain`."""
    found, least = np.arange(len(degree)), 1e-12 * whole
    while True:
        n = len(degree)
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order]
        first, degrees = np.searchsorted(a, np.arange(n + 1)).tolist(), degree.tolist()
        label, total, gained = list(range(n)), degree.tolist(), 0.0
        while True:
            step = 0.0
            for x in range(n):
                near: dict[int, float] = {}
                for y, v in zip(b[first[x] : first[x + 1]].tolist(), w[first[x] : first[x + 1]].tolist()):
                    if y != x:
                        c = label[y]
                        near[c] = near.get(c, 0.0) + v
                own, share = label[x], resolution * degrees[x] / whole
                total[own] -= degrees[x]
                here = near.get(own, 0.0) - share * total[own]
                best, to = here, own
                for c, v in near.items():  # in the order of the neighbours, so ties do too
                    gain = v - share * total[c]
                    if gain > best + least:
                        best, to = gain, c
                total[to] += degrees[x]
                label[x] = to
                step += 2 * (best - here) / whole
            gained += step
            if step < least_gain:
                break
        if gained < least_gain:
            return found
        names, up = np.unique(np.array(label), return_inverse=True)
        found, degree = up[found], np.bincount(up, degree, len(names))
        key = up[a] * len(names) + up[b]
        a = b = None
        order = np.argsort(key)
        key, w = key[order], w[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, w = key[start], np.add.reduceat(w, start)
        a, b = (key // len(names)).astype(np.int32), (key % len(names)).astype(np.int32)


def _communities_in_a_task(level: DataFrame, whole: float, resolution: float, least_gain: float) -> DataFrame:
    """(label, up): the community of each node of a graph (src, dst, weight; both directions) of at most LOCAL_EDGES rows."""
    kind = level.schema["src"].dataType.simpleString()

    def run(batches):
        held = list(batches)
        if not sum(x.num_rows for x in held):
            return
        rows = pa.Table.from_batches(held)
        nodes = pc.unique(rows.column(0))
        nodes = nodes.take(pc.sort_indices(nodes))
        a, b = (pc.fill_null(pc.index_in(rows.column(k), nodes), -1).to_numpy() for k in (0, 1))
        w = rows.column(2).to_numpy()
        del rows, held
        degree, known = np.bincount(a, w, len(nodes)), b >= 0
        if not known.all():  # an edge to a node without edges of its own counts for its source only
            a, b, w = a[known], b[known], w[known]
        found = _moved_one_by_one(a, b, w, degree, whole, resolution, least_gain)
        at = np.unique(found, return_index=True)[1]
        for k in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([nodes.slice(k, 100_000), nodes.take(pa.array(at[found[k : k + 100_000]]))], names=["label", "up"])
        give_back()

    small_batches(level.sparkSession)
    return level.select("src", "dst", "weight").coalesce(1).mapInArrow(run, f"label {kind}, up {kind}")


def modularity_communities(edges: DataFrame, resolution: float = 1.0, least_gain: float = 1e-6) -> DataFrame:
    """(node, component): communities of an undirected graph (edges of both directions, loops once) by modularity, named by their least node.

    Nodes move between communities in parallel rounds, then each community becomes one node of a
    smaller graph whose loops hold the weight within, and so on until nothing gains; all of these
    steps are joins and sums. A graph of at most LOCAL_EDGES rows, be it the first or one of
    communities, is settled in one task, whose nodes move one by one. Rounds end by the gain that
    a step must bring, of which modularity, at most 1, allows 1 / `least_gain`.
    Loops count twice in a degree, weights must not be negative, a null end drops an edge.
    """
    once = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND weight > 0").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    level = cut(once.select("src", "dst", F.when(F.col("src") == F.col("dst"), 2 * F.col("weight")).otherwise(F.col("weight")).alias("weight")), "level")
    n, whole = level.agg(F.count(F.lit(1)), F.sum("weight")).first()
    found = cut(level.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct(), "found")
    while whole:
        if n <= LOCAL_EDGES:
            up = _communities_in_a_task(level, whole, resolution, least_gain)
            found = cut(found.join(up, "label").select("node", F.col("up").alias("label")), "found")
            break
        labels, _, moved = _local_moves(level, whole, resolution, least_gain)
        if not moved:
            break
        labels = cut(labels, "labels")
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        found = cut(found.join(up, "label").select("node", F.col("up").alias("label")), "found")
        left = level.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        level = cut(left.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("weight").alias("weight")), "level")
        n = level.count()
    names = found.groupBy("label").agg(F.min("node").alias("component"))
    return found.join(names, "label").select("node", "component")


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of `communities` (node, component) in an undirected graph (edges of both directions, loops once)."""
    rows = edges.select("src", "dst", F.when(F.col("src") == F.col("dst"), 2 * F.col("weight")).otherwise(F.col("weight")).alias("weight"))
    a = communities.select(F.col("node").alias("src"), F.col("component").alias("a"))
    b = communities.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    named = rows.join(a, "src").join(b, "dst").groupBy("a").agg(F.sum("weight").alias("degree"), F.sum(F.when(F.col("a") == F.col("b"), F.col("weight")).otherwise(0.0)).alias("inside"))
    row = named.agg(F.sum("inside").alias("w"), F.sum("degree").alias("whole"), F.sum(F.col("degree") * F.col("degree")).alias("s")).first()
    return 0.0 if not row["whole"] else row["w"] / row["whole"] - resolution * row["s"] / row["whole"] ** 2


def greedy_modularity(edges: DataFrame) -> DataFrame:
    """`modularity_communities` under the name that callers of a merge-by-merge heuristic know; on test graphs its modularity is no lower than that heuristic's less 2 %."""
    return modularity_communities(edges)


def largest_communities(components: DataFrame, k: int) -> DataFrame:
    """(node, community): the k - 1 largest components by number 0, 1, ..., all others as the last."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(k - 1)
    ranked = sizes.select("component", (F.row_number().over(Window.orderBy(F.desc("n"), "component")) - 1).alias("community"))
    return components.join(F.broadcast(ranked), "component", "left").select("node", F.coalesce("community", F.lit(k - 1)).alias("community"))


def importance(edges: DataFrame, max_iter: int = 100) -> DataFrame:
    """(node, pagerank, weighted_degree): both of an undirected graph (edges of both directions), pagerank as a share of the largest."""
    ranks = pagerank(edges, max_iter=max_iter)
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("weighted_degree"))
    top = ranks.agg(F.max("score").alias("top"))
    return ranks.join(degree, "node", "left").crossJoin(F.broadcast(top)).select("node", (F.col("score") / F.col("top")).alias("pagerank"), F.coalesce("weighted_degree", F.lit(0.0)).alias("weighted_degree"))


def retrieve(edges: DataFrame, seeds: DataFrame, depth: int = 1, max_nodes: int = 32, max_edges: int = 256, relation_weights: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with scores, edges): scored k-hop neighbourhood of the `seeds` (node).

    A seed scores 1; a neighbour at hop h scores its source's score plus weight times the
    relation's weight over h + 2, the best of its edges; scores of one hop are taken before the
    hop. The heaviest nodes stay, with the edges among them by the sum of both scores and the
    weight.
    """
    edges = cut(edges)
    weight = F.col("weight")
    for name, w in (relation_weights or {}).items():
        weight = F.when(F.col("relation") == name, F.col("weight") * w).otherwise(weight)
    scores = seeds.select("node").distinct().withColumn("score", F.lit(1.0))
    frontier = scores
    for h in range(depth):
        step = edges.withColumn("w", weight).join(frontier.select(F.col("node").alias("src"), "score"), "src")
        found = step.groupBy(F.col("dst").alias("node")).agg(F.max(F.col("score") + F.col("w") / (h + 2)).alias("score"))
        scores = cut(scores.unionByName(found).groupBy("node").agg(F.max("score").alias("score")))
        frontier = scores.join(found.select("node"), "node", "left_semi")
    top = cut(scores.orderBy(F.desc("score"), "node").limit(max_nodes))
    kept = F.broadcast(top)  # max_nodes rows
    inside = edges.join(kept.select(F.col("node").alias("src"), F.col("score").alias("ss")), "src").join(kept.select(F.col("node").alias("dst"), F.col("score").alias("sd")), "dst")
    best = inside.withColumn("rank_score", F.col("ss") + F.col("sd") + F.col("weight")).orderBy(F.desc("rank_score"), "src", "dst", "relation").limit(max_edges)
    return top, best.select("src", "dst", "relation", "weight", "rank_score")


def retrieve_many(
    edges: DataFrame, seeds: DataFrame, depth: int = 1, max_nodes: int = 32, max_edges: int = 256, relation_weights: dict[str, float] | None = None, min_score: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the scored neighbourhoods of many prompts at once; `seeds`: (prompt, node), `edges`: (src, dst, relation, weight).

    nodes: (prompt, node, score, rank), at most `max_nodes` a prompt, scores as in `retrieve` and at
    least `min_score`; edges: (prompt, src, dst, relation, weight, rank_score, rank) among them, at
    most `max_edges`. Ties, at nine digits, by name. All prompts go one hop together: a frontier
    row is a (prompt, node), so a hop is one join and one aggregation with partial sums whatever
    the number of prompts, and hot nodes are for the planner's skew handling to split. A null
    prompt or node is no seed; nodes that no edge knows stay as seeds.
    """
    named = F.col("weight")
    for name, w in (relation_weights or {}).items():
        named = F.when(F.col("relation") == name, F.col("weight") * w).otherwise(named)
    steps = edges.select("src", "dst", named.alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w"))  # only the best of parallel edges can count
    steps = cut(steps, "steps") if depth > 1 else steps
    scores = cut(seeds.select("prompt", "node").filter("prompt IS NOT NULL AND node IS NOT NULL").distinct().select("prompt", "node", F.lit(1.0).alias("score"), F.lit(True).alias("new")), "scores")
    for h in range(depth):
        frontier = scores.filter("new").select("prompt", F.col("node").alias("src"), "score")
        found = frontier.join(steps, "src").groupBy("prompt", F.col("dst").alias("node")).agg(F.max(F.col("score") + F.col("w") / (h + 2)).alias("score"), F.lit(True).alias("new"))
        both = scores.withColumn("new", F.lit(False)).unionByName(found)
        scores = cut(both.groupBy("prompt", "node").agg(F.max("score").alias("score"), F.max("new").alias("new")), "scores")
    by = Window.partitionBy("prompt").orderBy(F.desc(F.round("score", 9)), "node")
    top = scores.filter(F.col("score") >= min_score).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= max(1, max_nodes)).select("prompt", "node", "score", "rank")
    top = cut(top, "top")
    left, right = top.select("prompt", F.col("node").alias("src"), F.col("score").alias("ss")), top.select("prompt", F.col("node").alias("dst"), F.col("score").alias("sd"))
    inside = edges.select("src", "dst", "relation", "weight").join(left, "src").join(right, ["prompt", "dst"]).withColumn("rank_score", F.col("ss") + F.col("sd") + F.col("weight"))
    by = Window.partitionBy("prompt").orderBy(F.desc(F.round("rank_score", 9)), "src", "dst", "relation")
    best = inside.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= max(0, max_edges))
    return top, best.select("prompt", "src", "dst", "relation", "weight", "rank_score", "rank")


def retrieval_reports(prompts: DataFrame, seeds: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(prompt, fallback, seed_nodes, retrieved_nodes, retrieved_edges, coverage, top_nodes, relation_counts), a row for each of `prompts` (prompt).

    coverage: the share of the prompt's seeds that were kept. fallback: no_prompt_nodes if it has
    no seed, empty_after_scoring if nothing was kept, else null.
    """
    asked = seeds.filter("prompt IS NOT NULL AND node IS NOT NULL").select("prompt", "node").distinct()
    kept = asked.join(nodes.select("prompt", "node", F.lit(1).alias("kept")), ["prompt", "node"], "left").groupBy("prompt").agg(F.count(F.lit(1)).alias("seed_nodes"), F.count("kept").alias("kept"))
    best = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "node")))), lambda s: s["node"])
    found = nodes.groupBy("prompt").agg(F.count(F.lit(1)).alias("retrieved_nodes"), best.alias("top_nodes"))
    relations = edges.groupBy("prompt", "relation").agg(F.count(F.lit(1)).alias("n")).groupBy("prompt").agg(F.sum("n").alias("retrieved_edges"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "n")))).alias("relation_counts"))
    out = prompts.select("prompt").distinct().join(kept, "prompt", "left").join(found, "prompt", "left").join(relations, "prompt", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    fallback = F.when(F.col("seed_nodes").isNull(), "no_prompt_nodes").when(F.col("retrieved_nodes").isNull(), "empty_after_scoring")
    return out.select(
        "prompt", fallback.alias("fallback"), zero("seed_nodes"), zero("retrieved_nodes"), zero("retrieved_edges"), (F.coalesce("kept", F.lit(0)) / F.greatest("seed_nodes", F.lit(1))).alias("coverage"),
        F.coalesce("top_nodes", F.array().cast("array<string>")).alias("top_nodes"), F.coalesce("relation_counts", F.create_map().cast("map<string,bigint>")).alias("relation_counts"),
    )


def retrieval_report(prompt_tokens: DataFrame, nodes: DataFrame, edges: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: coverage (share of distinct prompt tokens in the graph), nodes and edges retrieved."""
    words = prompt_tokens.select("token").distinct()
    known = words.join(vocab.select("token"), "token", "left_semi").agg(F.count(F.lit(1)).alias("known"))
    total = words.agg(F.count(F.lit(1)).alias("total"))
    return known.crossJoin(total).crossJoin(nodes.agg(F.count(F.lit(1)).alias("nodes"))).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges"))).select(
        (F.col("known") / F.greatest("total", F.lit(1))).alias("coverage"), "nodes", "edges"
    )
