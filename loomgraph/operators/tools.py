"""Compositions: text analysis, knowledge graphs and their explanations as nested results; graph statistics over parameter grids; article parsing."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import algebra, graphs, tasks
from . import tokens as TK

LIMITS = {"text_chars": 20_000, "documents": 50, "document_chars": 10_000, "nodes": 250, "edges": 1000, "window": 20}


def checked(name: str, value: int, least: int = 1) -> int:
    """`value` if it lies within the named limit."""
    if not least <= value <= LIMITS[name]:
        raise ValueError(f"{name} must be from {least} to {LIMITS[name]}")
    return value


def knowledge_graph(docs: DataFrame, tokens, window: int = 4, top_k: int = 12, topics: int = 6, relations: tuple[str, ...] = ("cooccurrence", "topic_document"), id_col: str = "doc_id") -> DataFrame:
    """(src, dst, relation, weight): the multi-relation graph of tokenised documents. `tokens`: a column."""
    return graphs.multi_relation_graph(TK.token_arrays(docs, tokens, id_col), list(relations), max(2, checked("window", window)), top_k=top_k, topics=topics)


def payload(edges: DataFrame, max_nodes: int = 80, max_edges: int = 160, top: int = 10) -> DataFrame:
    """One row: graph (nodes, edges), explanation (top_nodes, important_relations, reasoning_path), each list of at most the stated length."""
    checked("nodes", max_nodes), checked("edges", max_edges)
    nodes = graphs.graph_nodes(edges)
    kept = algebra.payload_edges(edges, nodes, max_nodes, max_edges)
    heavy = algebra.top_nodes(edges, top)
    listed = lambda df, order, *c: df.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), *c))).alias("x")).select(F.transform("x", lambda s: s.dropFields("o")).alias("x"))
    a = listed(nodes.orderBy("node_id").limit(max_nodes), F.col("node_id"), "node_id", "label", "node_type").withColumnRenamed("x", "nodes")
    b = listed(kept, -F.abs("weight"), "src", "dst", "relation", "weight").withColumnRenamed("x", "edges")
    c = listed(heavy, F.col("rank"), "node", "weighted_degree", "score").withColumnRenamed("x", "top_nodes")
    d = algebra.relation_paths(edges, top).agg(F.collect_list("path").alias("important_relations"))
    one = a.crossJoin(b).crossJoin(c).crossJoin(d)
    path = F.array_join(F.transform("top_nodes", lambda n: n["node"]), " -> ")
    return one.select(F.struct("nodes", "edges").alias("graph"), F.struct("top_nodes", "important_relations", path.alias("reasoning_path")).alias("explanation"))


def analyse(docs: DataFrame, tokens, keywords: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of JSON: status, task, key words, names, graph and explanation of the documents taken together."""
    words = TK.positions(TK.token_arrays(docs, tokens, id_col))
    best = tasks.keyword_scores(words, keywords).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("o"), "token", "count", "score"))).alias("keywords"))
    names = docs.select(F.explode(X.entities(text_col)).alias("name")).groupBy("name").count().orderBy(F.desc("count"), "name").limit(12).agg(F.collect_list("name").alias("entities"))
    graph = payload(knowledge_graph(docs, tokens, id_col=id_col))
    row = best.crossJoin(names).crossJoin(graph)
    shown = F.transform("keywords", lambda k: k.dropFields("o"))
    return row.select(F.to_json(F.struct(F.lit("success").alias("status"), F.lit("text_analysis").alias("task"), shown.alias("keywords"), "entities", "graph", "explanation")).alias("result"))


def graph_statistics(arrays: DataFrame, grid: dict[str, list]) -> DataFrame:
    """(name, relation, edges, weight) of the multi-relation graph for each combination of the parameters in `grid`."""
    rows = []
    for values in product(*grid.values()):
        config = dict(zip(grid, values))
        built = graphs.multi_relation_graph(arrays, **config)
        name = ", ".join(f"{k}={v}" for k, v in config.items())
        rows.append(built.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight")).withColumn("name", F.lit(name)))
    return reduce(DataFrame.unionByName, rows).select("name", "relation", "edges", "weight")


def parse_article(text, topic: str = ""):
    """A generated article (one line, parts joined by ` | `) as a struct: title, keywords, introduction, body, conclusion."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.transform(F.split(c, r"\s*\|\s*"), lambda p: F.trim(p))
    field = lambda label: F.regexp_replace(F.get(F.filter(parts, lambda p: p.startswith(label + ":")), F.lit(0)), f"^{label}:\\s*", "")
    rest = F.filter(parts, lambda p: ~p.rlike("^(عنوان|کلیدواژه|مقدمه|متن|نتیجه):") & (p != ""))
    return F.struct(
        F.coalesce(field("عنوان"), F.lit(f"مقاله درباره {topic}")).alias("title"),
        X.keywords(F.coalesce(field("کلیدواژه"), F.lit(""))).alias("keywords"),
        F.coalesce(field("مقدمه"), F.lit("")).alias("introduction"),
        F.array_join(F.concat(F.array(F.coalesce(field("متن"), F.lit(""))), rest), "\n").alias("body"),
        F.coalesce(field("نتیجه"), F.lit("")).alias("conclusion"),
    )


def article_markdown(article):
    """A parsed article as markdown."""
    a = F.col(article) if isinstance(article, str) else article
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    tail = F.when(a["conclusion"] != "", F.concat(F.lit("## جمع‌بندی\n\n"), a["conclusion"]))
    return F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), a["title"]), blank(a["introduction"]), blank(a["body"]), tail), F.lit("\n"))
