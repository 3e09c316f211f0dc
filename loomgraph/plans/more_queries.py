"""More registered queries: files written and read back, and operators that no other query reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import algebra, gnn, graphs, tasks
from ..operators import tokens as TK
from ..scratch import cut, drop_at_exit, scratch_path
from ..sources import readers, writers
from .queries import _EVENT, _MULTI, POS, arrays, both_sql, event_edges, gate, multi, pairs_sql, query, r6, table
from .queries import _GATE as GATE

CSV = {"header": True, "quoteAll": True, "escape": '"', "emptyValue": ""}


def _folder(spark: SparkSession, name: str) -> str:
    path = scratch_path(spark, name)
    drop_at_exit(spark, path)
    return path


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{K.SPACE}+|{K.SPACE}+$', '', 'g')"


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


_RECORDS = f"""SELECT sha256(array_to_string([x FOR x IN [{_strip("coalesce(text, '')")}, {_strip("coalesce(source, '')")}] IF x <> ''], chr(10))) AS digest, count(*) AS n FROM documents GROUP BY 1"""


@query("records_from_json_lines", _RECORDS)
def _(s, d):
    """Documents as JSON lines of two fields, read back as records."""
    path = _folder(s, "jsonl")
    table(s, d, "documents").select("text", F.col("source").alias("body")).write.json(path)
    return _counted(readers.read_records(s, path, "jsonl").select(F.sha2("text", 256).alias("digest")), "digest")


@query("records_from_csv", _RECORDS)
def _(s, d):
    """Documents as quoted tables, whose texts go over lines and splits, read back as records."""
    path = _folder(s, "csv")
    table(s, d, "documents").select("text", F.col("source").alias("body")).write.options(**CSV).csv(path)
    return _counted(readers.read_records(s, path, "csv").select(F.sha2("text", 256).alias("digest")), "digest")


@query("lines_from_text", f"SELECT sha256(x) AS digest, count(*) AS n FROM (SELECT {_strip('x')} AS x FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents)) WHERE x <> '' GROUP BY 1")
def _(s, d):
    path = _folder(s, "text")
    table(s, d, "documents").select(F.coalesce("text", F.lit(""))).write.text(path)
    return _counted(readers.read_lines(s, path).select(F.sha2("text", 256).alias("digest")), "digest")


@query("labelled_rows", f"SELECT label, sha256(text) AS digest, count(*) AS n FROM (SELECT {_strip('text')} AS text, {_strip('lang')} AS label FROM documents) WHERE text <> '' AND label <> '' GROUP BY ALL")
def _(s, d):
    path = _folder(s, "labelled")
    table(s, d, "documents").select("text", F.col("lang").alias("label")).write.json(path)
    return _counted(readers.read_labelled(s, path, fmt="jsonl").select("label", F.sha2("text", 256).alias("digest")), "label", "digest")


_ARTICLES = "SELECT coalesce(source, '') AS title, sha256(coalesce(text, '')) AS digest, coalesce(lang, '') AS keywords, count(*) AS n FROM documents GROUP BY ALL"


@query("articles_from_json_lines", _ARTICLES)
def _(s, d):
    path = _folder(s, "articles")
    table(s, d, "documents").select(F.col("source").alias("title"), F.col("text").alias("body"), F.array("lang").alias("keywords")).write.json(path)
    found = readers.read_articles(s, path, "jsonl").select("title", F.sha2("body", 256).alias("digest"), F.array_join("keywords", "|").alias("keywords"))
    return _counted(found, "title", "digest", "keywords")


@query("articles_from_csv", _ARTICLES)
def _(s, d):
    path = _folder(s, "articles")
    table(s, d, "documents").select(F.col("source").alias("title"), F.col("text").alias("body"), F.col("lang").alias("keywords")).write.options(**CSV).csv(path)
    found = readers.read_articles(s, path, "csv").select("title", F.sha2("body", 256).alias("digest"), F.array_join("keywords", "|").alias("keywords"))
    return _counted(found, "title", "digest", "keywords")


@query("messages_from_json_lines", """WITH p AS (SELECT x.text AS a, y.text AS b FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 WHERE y.text IS NOT NULL)
SELECT turn, role, sha256(text) AS digest, count(*) AS n FROM (SELECT CAST(0 AS BIGINT) AS turn, 'user' AS role, coalesce(a, '') AS text FROM p UNION ALL SELECT 1, 'assistant', b FROM p) GROUP BY ALL""")
def _(s, d):
    """Every turn and the one after it as a line of prompt and completion, read back as messages."""
    path = _folder(s, "messages")
    rows = table(s, d, "conversations").select("conv_id", "turn", "text")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion")).filter("completion IS NOT NULL")
    rows.join(after, ["conv_id", "turn"]).select(F.col("text").alias("prompt"), "completion").write.json(path)
    return _counted(readers.read_messages(s, path).select("turn", "role", F.sha2("text", 256).alias("digest")), "turn", "role", "digest")


@query("edges_from_lines", "SELECT CAST(user_id AS VARCHAR) AS u, event_type AS v, CAST(count(*) AS BIGINT) AS n FROM events WHERE CAST(user_id AS VARCHAR) <> event_type GROUP BY ALL")
def _(s, d):
    lines = table(s, d, "events").select(F.concat_ws("\t", F.col("user_id").cast("string"), "event_type", F.lit("2.5")).alias("value"), F.col("event_id").alias("line"))
    return _counted(readers.parse_edges(lines).filter("w = 2.5").select("u", "v"), "u", "v")


@query("relations_from_csv", "WITH p AS (SELECT DISTINCT 'part ' || l_partkey AS a, 'supplier ' || l_suppkey AS b FROM lineitem) SELECT a, b FROM p UNION SELECT b, a FROM p")
def _(s, d):
    """A lexicon as a table of source and target, read back closed in both directions."""
    path = _folder(s, "lexicon")
    pairs = table(s, d, "lineitem").select(F.concat(F.lit("part "), "l_partkey").alias("source"), F.concat(F.lit(" supplier "), "l_suppkey").alias("target"))
    pairs.write.options(**CSV).csv(path)
    return readers.read_relations(s, path, "csv")


@query("stored_graph", f"""WITH {_MULTI}, nd AS (SELECT src AS node FROM multi UNION SELECT dst FROM multi)
SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM multi) AS edges, (SELECT string_agg(DISTINCT relation, ' ' ORDER BY relation) FROM multi) AS relations, round((SELECT avg(CASE WHEN node IS NULL THEN 0.0 ELSE 1.0 END) FROM (SELECT DISTINCT token FROM pos) LEFT JOIN nd ON node = token), 6) AS token_coverage""")
def _(s, d):
    """The multi-relation graph written, read back and summed up."""
    path = _folder(s, "graph")
    edges = cut(multi(s, d))
    writers.write_graph(graphs.graph_nodes(edges), edges, path, {"window": 4})
    nodes, back, _ = writers.read_graph(s, path)
    tokens = TK.positions(arrays(s, d)).select("token")
    return writers.graph_summary(nodes, back, tokens).select("nodes", "edges", F.array_join("relations", " ").alias("relations"), r6("token_coverage"))


# operators


@query("word_chunks", f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{K.WORD}') AS t FROM documents), c AS (SELECT doc_id, t, greatest(CAST(ceil(len(t) / 8) AS BIGINT), 1) AS size, unnest(range(8)) AS chunk FROM t)
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(len(t[chunk * size + 1 : (chunk + 1) * size]) AS BIGINT) AS n, sha256(array_to_string(t[chunk * size + 1 : (chunk + 1) * size], ' ')) AS digest FROM c""")
def _(s, d):
    each = arrays(s, d).select("doc_id", F.posexplode(X.chunks("tokens", 8)).alias("chunk", "c"))
    return each.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("c").cast("long").alias("n"), F.sha2(F.array_join("c", " "), 256).alias("digest"))


@query("unigram_perplexity", f"""WITH {POS}, f AS (SELECT token, count(*) AS f FROM pos GROUP BY token), n AS (SELECT sum(f) AS n FROM f)
SELECT round(sum(-f * ln(f / n.n)) / n.n, 6) AS mean_loss, round(exp(sum(-f * ln(f / n.n)) / n.n), 3) AS perplexity FROM f, n GROUP BY n.n""")
def _(s, d):
    """The corpus under the frequencies of its own words: a loss for each document, then the perplexity of all."""
    a = arrays(s, d)
    words = graphs.frequent(a, 1)
    total = words.agg(F.sum("freq").alias("n"))
    each = TK.positions(a).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("k")).join(words, "token").crossJoin(F.broadcast(total))  # one row
    losses = each.groupBy("doc_id").agg(F.sum(-F.col("k") * F.log(F.col("freq") / F.col("n"))).alias("loss"), F.sum("k").alias("tokens"))
    return tasks.perplexity(losses).select(r6("mean_loss"), F.round("perplexity", 3).alias("perplexity"))


@query("best_choice", "SELECT conv_id AS id, arg_min(turn, (-length(coalesce(text, '')), turn)) AS choice FROM conversations GROUP BY conv_id")
def _(s, d):
    """The longest turn of each conversation, the first of equals."""
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("choice"), F.length(F.coalesce("text", F.lit(""))).alias("score"))
    return tasks.best_choice(rows)


@query("improvement", f"""WITH {GATE}, p AS (SELECT 1 AS base, CASE WHEN reason IS NULL THEN 2 ELSE 0 END AS other FROM v)
SELECT CAST(sum(base) AS BIGINT) AS base_total, CAST(sum(other) AS BIGINT) AS other_total, round(sum(other) / sum(base), 4) AS ratio, round((sum(other) / sum(base) - 1) * 100, 1) AS gain_percent FROM p""")
def _(s, d):
    """Two scores of each document: one for all, two for those that the gate accepts."""
    rows = gate(s, d).select(F.lit(1).alias("base"), F.when(F.col("reason").isNull(), 2).otherwise(0).alias("other"))
    return tasks.improvement(rows, "base", "other")


@query("gate_metrics", f"""WITH {GATE} SELECT coalesce(reason, 'accepted') || '_gate' AS name, round(count(*) / (SELECT count(*) FROM v), 6) AS value, false AS zero FROM v GROUP BY 1""")
def _(s, d):
    """Shares of the gate's verdicts as a map of metrics, of which the gate's are reported."""
    shares = _counted(gate(s, d).select(F.coalesce("reason", F.lit("accepted")).alias("name")), "name")
    total = shares.agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("m"))  # four names at most
    metrics = total.select(F.map_concat(F.transform_keys(F.transform_values("m", lambda _, n: n / F.col("total")), lambda k, _: F.concat(k, F.lit("_gate"))), F.create_map(F.lit("other"), F.lit(1.0))).alias("metrics"))
    return tasks.gate_report(metrics).select("name", r6("value"), "zero")


@query("attention_weights", f"""WITH {_EVENT}, s AS ({both_sql('e')}), n AS (SELECT src AS node, ln(sum(weight)) AS score FROM s GROUP BY src), p AS (SELECT src, dst FROM s UNION SELECT node, node FROM n),
x AS (SELECT p.src, p.dst, exp(CASE WHEN a.score - b.score > 0 THEN a.score - b.score ELSE 0.2 * (a.score - b.score) END) AS x FROM p JOIN n a ON a.node = src JOIN n b ON b.node = dst) SELECT src, dst, round(x / sum(x) OVER (PARTITION BY src), 6) AS weight FROM x""")
def _(s, d):
    """One attention head whose scores are the logarithms of the degrees, the neighbour's taken off."""
    e = event_edges(s, d)
    scores = e.groupBy(F.col("src").alias("node")).agg(F.log(F.sum("weight")).alias("left")).withColumn("right", -F.col("left"))
    return gnn.attention(e, scores).select("src", "dst", r6("weight"))


@query("relation_means", f"""WITH {_MULTI}, f AS (SELECT src AS node, ln(1 + sum(weight)) AS x FROM multi GROUP BY src)
SELECT dst AS node, relation, round(sum(weight * x) / sum(abs(weight)), 6) AS value FROM multi JOIN f ON node = src GROUP BY ALL""")
def _(s, d):
    """The mean logarithm of the degrees of each node's neighbours, a relation at a time."""
    e = cut(multi(s, d))
    f = e.groupBy(F.col("src").alias("node")).agg(F.log(1 + F.sum("weight")).alias("value")).withColumn("feature", F.lit(0))
    return gnn.relation_mean(e, f).select("node", "relation", r6("value"))


@query("payload_edges", f"""WITH {_EVENT}, s AS ({both_sql('e')}), n AS (SELECT DISTINCT src AS node FROM s ORDER BY src LIMIT 80)
SELECT src, dst, weight FROM s WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n) ORDER BY abs(weight) DESC, src, dst LIMIT 160""")
def _(s, d):
    """What is shown of the event graph: its first nodes by name and their heaviest edges."""
    e = event_edges(s, d)
    nodes = graphs.graph_nodes(e)
    return algebra.payload_edges(e, nodes, 80, 160)



@query("text_graph_frozen", f"""WITH {POS}, v AS MATERIALIZED (SELECT token, count(*) AS f FROM pos WHERE token IN (SELECT token FROM pos JOIN documents USING (doc_id) WHERE lang = 'en') GROUP BY token), {pairs_sql(5)},
c AS (SELECT a, b, n, x.f AS fa, y.f AS fb FROM cnt JOIN v x ON x.token = a JOIN v y ON y.token = b),
pmi AS (SELECT a AS src, b AS dst, ln((n / (SELECT 2 * sum(n) FROM c)) / ((fa / (SELECT sum(f) FROM v)) * (fb / (SELECT sum(f) FROM v)))) AS weight FROM c WHERE a <> b),
tf AS (SELECT doc_id, token, count(*) AS tf FROM pos JOIN v USING (token) GROUP BY ALL), dfr AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
SELECT src, dst, 'word_word' AS relation, round(weight, 6) AS weight FROM pmi WHERE weight > 0
UNION ALL SELECT token, 'doc_' || doc_id, 'word_document', round(tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1), 6) FROM tf JOIN dfr USING (token)""")
def _(s, d):
    """The text graph of all documents over the words of the English ones, as for texts that a fitted vocabulary meets."""
    a = arrays(s, d)
    english = table(s, d, "documents").filter("lang = 'en'").select("doc_id")
    vocab = TK.positions(a.join(english, "doc_id", "left_semi")).select("token").distinct()
    return graphs.text_graph(a, 5, vocab=vocab).select("src", "dst", "relation", r6("weight"))
