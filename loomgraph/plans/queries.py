"""The registered queries over the driver's tables and the SQL that says the same.

The documents are not Persian, so gates and ratios take a Latin script as their parameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..layout import spread
from ..operators import algebra, corpus, embedding, gnn, graphs, iterate, sentences, similarity, tasks
from ..operators import tokens as TK
from ..operators.convolution import TextGraphClassifier
from ..operators.pairs import small_batches
from ..scratch import cut, drop_at_exit, scratch_path
from ..streaming.store import PairStore

QUERIES: dict = {}
SQL: dict[str, str] = {}
LATIN = "A-Za-zÀ-ɏ"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TK.token_arrays(docs(spark, sf_dir), X.tokenize(F.lower("text")))


def r6(name: str, alias: str | None = None):
    return F.round(name, 6).alias(alias or name)


# pieces of SQL
TOK = f"tok AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{K.WORD}') AS t FROM documents)"
POS = f"{TOK}, pos AS MATERIALIZED (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM tok)"
FREQ = "freq AS MATERIALIZED (SELECT token, count(*) AS f FROM pos GROUP BY token)"


def pairs_sql(window: int, source: str = "pos") -> str:
    parts = " UNION ALL ".join(f"SELECT token AS a, lead(token, {k}) OVER w AS b, {k} AS k FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)" for k in range(1, window + 1))
    return f"pr AS MATERIALIZED (SELECT * FROM ({parts}) WHERE b IS NOT NULL), cnt AS MATERIALIZED (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM pr GROUP BY ALL)"


def both_sql(source: str, columns: str = "weight") -> str:
    return f"SELECT src, dst, {columns} FROM {source} UNION ALL SELECT dst, src, {columns} FROM {source} WHERE src <> dst"


# tokens and text


@query("tokenize_documents", f"WITH {TOK} SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM tok")
def _(s, d):
    return arrays(s, d).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha256"))


@query("lm_tokenize", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{K.LM_TOKEN.replace(chr(39), chr(39) * 2)}')) AS BIGINT) AS n_tokens, sha256(array_to_string(regexp_extract_all(text, '{K.LM_TOKEN.replace(chr(39), chr(39) * 2)}'), ' ')) AS tokens_sha256 FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", X.lm_tokens("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@query("tokenize_persian", f"SELECT doc_id, sha256(array_to_string(regexp_extract_all(nfc_normalize(text), '{K.WORD_RUN}'), ' ')) AS tokens_sha256 FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.sha2(F.array_join(X.tokenize_persian("text"), " "), 256).alias("tokens_sha256"))


@query("token_freq_topk", f"""WITH {POS}, g AS (SELECT token, count(*) AS count FROM pos WHERE length(token) > 1 AND NOT regexp_full_match(token, '\\p{{Nd}}+') GROUP BY token)
SELECT token, count, round(count / (SELECT sum(count) FROM g), 6) AS score FROM g ORDER BY count DESC, token LIMIT 50""")
def _(s, d):
    return tasks.keyword_scores(TK.positions(arrays(s, d)), 50)


@query("vocabulary", f"""WITH {POS}, v AS (SELECT token, count(*) AS cnt, count(DISTINCT doc_id) AS df, min((doc_id, pos)) AS first FROM pos GROUP BY token HAVING count(*) >= 2)
SELECT token, cnt, df, row_number() OVER (ORDER BY cnt DESC, first) - 1 AS token_id FROM v""")
def _(s, d):
    return TK.vocabulary(arrays(s, d), 2).select("token", "cnt", "df", "token_id")


@query("vocab_encode", f"""WITH {POS}, v AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, first) + 4 AS id FROM (SELECT token, count(*) AS cnt, min((doc_id, pos)) AS first FROM pos GROUP BY token HAVING count(*) >= 3)),
e AS (SELECT doc_id, string_agg(CAST(coalesce(id, 1) AS VARCHAR), ' ' ORDER BY pos) AS ids FROM pos LEFT JOIN v USING (token) GROUP BY doc_id)
SELECT doc_id, sha256(coalesce(ids, '')) AS ids_sha256 FROM documents LEFT JOIN e USING (doc_id)""")
def _(s, d):
    a = cut(arrays(s, d))  # read twice
    return TK.encode(a, TK.vocabulary(a, 3)).select("doc_id", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"))


_BYTES = "list_transform(range(256), lambda i: '<0x' || upper(lpad(printf('%x', i), 2, '0')) || '>')"


@query("encode_bytes", f"""WITH {POS}, v AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, first) - 1 AS id FROM (SELECT token, count(*) AS cnt, min((doc_id, pos)) AS first FROM pos GROUP BY token HAVING count(*) >= 3)),
b AS (SELECT doc_id, pos, unnest(range(octet_length(encode(pos.token)))) AS sub, token FROM pos ANTI JOIN v USING (token)),
i AS (SELECT doc_id, pos, 0 AS sub, id + 261 AS id FROM pos JOIN v USING (token) UNION ALL SELECT doc_id, pos, sub, 5 + CAST('0x' || substr(hex(encode(token)), 2 * CAST(sub AS INTEGER) + 1, 2) AS INTEGER) FROM b),
e AS (SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos, sub) AS ids FROM i GROUP BY doc_id) SELECT doc_id, sha256('2 ' || coalesce(ids || ' ', '') || '3') AS ids_sha256 FROM documents LEFT JOIN e USING (doc_id)""")
def _(s, d):
    a = cut(arrays(s, d))  # read twice
    return TK.encode(a, byte_vocabulary(s, TK.vocabulary(a, 3)), bos=2, eos=3, byte_fallback=True).select("doc_id", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"))


def byte_vocabulary(s, vocab: DataFrame) -> DataFrame:
    """A vocabulary (token, token_id) after the 256 byte tokens."""
    names = s.range(256).select(F.concat(F.lit("<0x"), F.lpad(F.hex("id"), 2, "0"), F.lit(">")).alias("token"), F.col("id").alias("token_id"))
    return names.union(vocab.select("token", (F.col("token_id") + 256).alias("token_id")))


@query("decode_ids", f"WITH {TOK} SELECT doc_id, sha256(array_to_string(t, ' ')) AS text_sha256 FROM tok")
def _(s, d):
    """Encoded with bytes for rare words, and back: the words of each text."""
    a = cut(arrays(s, d))  # read twice
    vocab = byte_vocabulary(s, TK.vocabulary(a, 3))
    # words that the vocabulary lacks come back from their bytes; two in a row are one run of bytes, so a line break, which no word has, goes after each
    spaced = a.select("doc_id", F.flatten(F.transform("tokens", lambda t: F.array(t, F.lit("\n")))).alias("tokens"))
    back = TK.decode(TK.encode(spaced, vocab, bos=2, eos=3, byte_fallback=True), vocab)
    return back.select("doc_id", F.sha2(F.rtrim(F.regexp_replace("text", " ?\n ?", " ")), 256).alias("text_sha256"))


@query("lm_windows", f"""WITH {POS}, v AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, first) + 4 AS id FROM (SELECT token, count(*) AS cnt, min((doc_id, pos)) AS first FROM pos GROUP BY token HAVING count(*) >= 3)),
k AS MATERIALIZED (SELECT doc_id, pos, coalesce(id, 1) AS id, count(*) OVER (PARTITION BY doc_id) AS n FROM pos LEFT JOIN v USING (token)), st AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS place, id FROM k WHERE n > 1),
w AS (SELECT e AS example, place, id FROM (SELECT place, id, unnest(range(greatest(0, CAST(ceil((place - 64) / 48) AS BIGINT)), place // 48 + 1)) AS e FROM st) WHERE e * 48 < greatest((SELECT count(*) FROM st) - 1, 1)),
g AS (SELECT example, list(id ORDER BY place) AS c FROM w GROUP BY example HAVING count(*) > 1)
SELECT example, sha256(array_to_string(list_concat(c[1 : len(c) - 1], [0 FOR x IN range(65 - len(c))]), ' ')) AS input_sha256, sha256(array_to_string(list_concat(c[2 : len(c)], [-100 FOR x IN range(65 - len(c))]), ' ')) AS target_sha256, CAST(len(c) - 1 AS INTEGER) AS labels FROM g""")
def _(s, d):
    a = cut(arrays(s, d))  # read twice
    found = TK.curriculum(TK.windows(TK.encode(a, TK.vocabulary(a, 3)), 64, 48))
    digest = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), " "), 256)
    return found.select("example", digest("input_ids").alias("input_sha256"), digest("target_ids").alias("target_sha256"), "labels")


@query("compare_tokenizers", f"""WITH {POS}, cc AS (SELECT sum(length(text)) AS n FROM documents), wsp AS (SELECT doc_id, unnest([x FOR x IN string_split(coalesce(text, ''), ' ') IF x <> '']) AS token FROM documents),
al AS (SELECT 'words' AS tokenizer, token FROM pos UNION ALL SELECT 'blanks', token FROM wsp) SELECT tokenizer, count(*) AS tokens, count(DISTINCT token) AS vocab_size, round(count(*) / (SELECT n FROM cc), 6) AS tokens_per_char FROM al GROUP BY tokenizer""")
def _(s, d):
    ways = {"words": X.tokenize(F.lower("text")), "blanks": F.filter(F.split("text", " "), lambda w: w != "")}
    return TK.compare_tokenizers(docs(s, d), ways).select("tokenizer", "tokens", "vocab_size", r6("tokens_per_char"))


_STRIP = f"regexp_replace(x, '^{K.SPACE}+|{K.SPACE}+$', '', 'g')"


def _sentence_sql(split: str) -> str:
    return f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n, sha256(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, [{_STRIP} FOR x IN {split} IF {_STRIP} <> ''] AS p FROM documents)"


def _sentence_query(f):
    return lambda s, d: docs(s, d).select("doc_id", f("text").alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.sha2(F.array_join("p", "|"), 256).alias("digest"))


query("sentence_split", _sentence_sql(f"regexp_extract_all(text, '{K.SENTENCE_RUNS}')"))(_sentence_query(X.sentences))
query("sentence_split_summary", _sentence_sql(f"regexp_split_to_array(text, '{K.SUMMARY_END}')"))(_sentence_query(X.summary_sentences))
query("sentence_split_graph", _sentence_sql(f"regexp_split_to_array(text, '{K.GRAPH_END}')"))(_sentence_query(X.graph_sentences))
query("sentence_split_article", _sentence_sql(f"string_split(regexp_replace(text, '([.؟!]){K.SPACE}+', '\\1' || chr(0), 'g'), chr(0))"))(_sentence_query(X.article_sentences))


@query("normalize_text", f"""SELECT doc_id, sha256(trim(regexp_replace(translate(translate(translate(translate(replace(replace(nfc_normalize(text), 'ۀ', 'ه{K.ZWNJ}ی'), 'هٔ', 'ه{K.ZWNJ}ی'),
'{K.ARABIC_LETTERS}', '{K.PERSIAN_LETTERS}'), '{K.HAMZA_LETTERS}', '{K.PLAIN_LETTERS}'), '{K.DIGITS_FROM + K.SEPARATORS_FROM}', '{K.DIGITS_TO + K.SEPARATORS_TO}'),
'{K.TATWEEL + K.DIACRITICS + K.ZERO_WIDTH}', ''), '{K.SPACE}+', ' ', 'g'))) AS digest FROM documents""")
def _(s, d):
    return docs(s, d).select("doc_id", F.sha2(X.normalize("text"), 256).alias("digest"))


@query("script_ratio", f"""SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE length(regexp_replace(text, '[^{LATIN}]', '', 'g')) / n END, 6) AS ratio
FROM (SELECT doc_id, text, length(regexp_replace(text, '[^\\p{{L}}{LATIN}]', '', 'g')) AS n FROM documents)""")
def _(s, d):
    return docs(s, d).select("doc_id", F.round(X.script_ratio("text", LATIN), 6).alias("ratio"))


@query("char_chunk", f"""WITH {POS} SELECT DISTINCT token, CASE WHEN length(token) <= 4 THEN token
ELSE array_to_string([CASE WHEN i > 1 THEN '##' ELSE '' END || substr(token, i, 3) FOR i IN range(1, length(token) + 1, 3)], ' ') END AS pieces FROM pos""")
def _(s, d):
    words = arrays(s, d).select(F.explode("tokens").alias("token")).distinct()
    return words.select("token", F.array_join(X.char_chunks("token"), " ").alias("pieces"))


@query("char_ngram_sets", f"""WITH {POS}, w AS (SELECT DISTINCT token FROM pos)
SELECT token, array_to_string(list_sort(list_distinct([substr(token, i, 3) FOR i IN range(1, greatest(length(token) - 2, 1) + 1)])), ' ') AS grams FROM w""")
def _(s, d):
    words = arrays(s, d).select(F.explode("tokens").alias("token")).distinct()
    return words.select("token", F.array_join(F.array_sort(X.token_ngrams("token")), " ").alias("grams"))


@query("contains_terms", "SELECT doc_id, contains(text, 'password') OR contains(text, 'license') OR contains(text, 'stupid') AS flagged FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", X.contains_any("text", ["password", "license", "stupid"]).alias("flagged"))


@query("poetry_flag", f"""SELECT doc_id, coalesce(len(l) >= 2 AND l[len(l) // 2 + 1] <= 60 AND l[len(l)] <= 110, false) AS poetry FROM (
SELECT doc_id, list_sort([length({_STRIP}) FOR x IN string_split(text, chr(10)) IF {_STRIP} <> '']) AS l FROM documents)""")
def _(s, d):
    return docs(s, d).select("doc_id", X.looks_like_poetry("text").alias("poetry"))


@query("tokenizer_audit", f"""WITH {POS}, v AS (SELECT token FROM pos GROUP BY token HAVING count(*) >= 3)
SELECT (SELECT count(*) FROM documents) AS examples, count(*) AS tokens, (SELECT CAST(min(len(t)) AS BIGINT) FROM tok) AS tokens_min, (SELECT CAST(max(len(t)) AS BIGINT) FROM tok) AS tokens_max,
round((SELECT avg(len(t)) FROM tok), 6) AS tokens_mean, round(count(*) / (SELECT sum(length(text)) FROM documents), 6) AS tokens_per_char,
round(sum(CASE WHEN v.token IS NULL THEN 1 ELSE 0 END) / count(*), 6) AS unk_rate FROM pos LEFT JOIN v USING (token)""")
def _(s, d):
    a = arrays(s, d)
    chars = docs(s, d).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    out = TK.token_statistics(a, TK.vocabulary(a, 3), chars)
    return out.select("examples", "tokens", F.col("tokens_min").cast("long"), F.col("tokens_max").cast("long"), r6("tokens_mean"), r6("tokens_per_char"), r6("unk_rate"))


# co-occurrence and weights

W3 = pairs_sql(3)


@query("cooccurrence_edges", f"""WITH {POS}, {FREQ}, {W3}, keep AS MATERIALIZED (SELECT token FROM freq WHERE f >= 3)
SELECT a AS src, b AS dst, CAST(CASE WHEN a = b THEN 4 * n ELSE 2 * n END AS DOUBLE) AS weight FROM cnt JOIN keep x ON x.token = a JOIN keep y ON y.token = b""")
def _(s, d):
    return graphs.cooccurrence(arrays(s, d), 3, 3)


@query("cooccurrence_matrix", f"WITH {POS}, {pairs_sql(1)} SELECT a AS src, b AS dst, CAST(CASE WHEN a = b THEN 2 * n ELSE n END AS DOUBLE) AS weight FROM cnt")
def _(s, d):
    return graphs.cooccurrence_matrix(arrays(s, d), 1)


@query("degree_topk", f"""WITH {POS}, {W3}, e AS (SELECT a AS src, b AS dst, CAST(CASE WHEN a = b THEN 4 * n ELSE 2 * n END AS DOUBLE) AS weight FROM cnt), s AS ({both_sql("e")}),
t AS (SELECT src AS node, sum(weight) AS weighted_degree FROM s WHERE length(src) >= 2 AND NOT regexp_full_match(src, '\\p{{Nd}}+') GROUP BY src ORDER BY 2 DESC, 1 LIMIT 30)
SELECT node, weighted_degree, round(weighted_degree / max(weighted_degree) OVER (), 6) AS score, row_number() OVER (ORDER BY weighted_degree DESC, node) AS rank FROM t""")
def _(s, d):
    return algebra.heaviest(graphs.cooccurrence_degrees(arrays(s, d), 3), 30).withColumn("rank", F.col("rank").cast("long"))


_PMI = f"""{POS}, {FREQ}, {pairs_sql(5)}, v AS (SELECT * FROM freq WHERE f >= 5), c AS (SELECT a, b, n, x.f AS fa, y.f AS fb FROM cnt JOIN v x ON x.token = a JOIN v y ON y.token = b),
pmi AS (SELECT a AS src, b AS dst, ln((n / (SELECT 2 * sum(n) FROM c)) / ((fa / (SELECT sum(f) FROM v)) * (fb / (SELECT sum(f) FROM v)))) AS weight FROM c WHERE a <> b)"""


@query("pmi_edges", f"WITH {_PMI} SELECT src, dst, round(weight, 6) AS weight FROM pmi WHERE weight > 0")
def _(s, d):
    return graphs.pmi(arrays(s, d), 5, 5).select("src", "dst", r6("weight"))


_TFIDF = f"""{POS}, tf AS (SELECT doc_id, token, count(*) AS tf FROM pos GROUP BY ALL), dfr AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
tfidf AS (SELECT doc_id, token, tf, tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) AS weight FROM tf JOIN dfr USING (token))"""


@query("tfidf", f"WITH {_TFIDF} SELECT doc_id, token, tf, round(weight, 6) AS weight FROM tfidf")
def _(s, d):
    return graphs.tfidf(arrays(s, d)).select("doc_id", "token", "tf", r6("weight"))


@query("text_graph_edges", f"""WITH {_PMI}, tf AS (SELECT doc_id, token, count(*) AS tf FROM pos JOIN v USING (token) GROUP BY ALL), dfr AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
t AS (SELECT doc_id, token, tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) AS weight FROM tf JOIN dfr USING (token))
SELECT src, dst, 'word_word' AS relation, round(weight, 6) AS weight FROM pmi WHERE weight > 0 UNION ALL SELECT token, 'doc_' || doc_id, 'word_document', round(weight, 6) FROM t""")
def _(s, d):
    return graphs.text_graph(arrays(s, d), 5, 5).select("src", "dst", "relation", r6("weight"))


_PMI_WHOLE = f"""{POS}, {FREQ}, {pairs_sql(20)}, c AS (SELECT a, b, n, x.f AS fa, y.f AS fb FROM cnt JOIN freq x ON x.token = a JOIN freq y ON y.token = b),
pmi AS (SELECT a AS src, b AS dst, ln((n / (SELECT 2 * sum(n) FROM c)) / ((fa / (SELECT sum(f) FROM freq)) * (fb / (SELECT sum(f) FROM freq)))) AS weight FROM c WHERE a <> b)"""


@query("pmi_edges_whole", f"WITH {_PMI_WHOLE} SELECT src, dst, round(weight, 6) AS weight FROM pmi WHERE weight > 0")
def _(s, d):
    """The operator's own window of 20 and all words; `pmi_edges` has 5 and 5."""
    return graphs.pmi(arrays(s, d)).select("src", "dst", r6("weight"))


@query("text_graph_edges_whole", f"""WITH {_PMI_WHOLE}, tf AS (SELECT doc_id, token, count(*) AS tf FROM pos GROUP BY ALL), dfr AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
t AS (SELECT doc_id, token, tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1) AS weight FROM tf JOIN dfr USING (token))
SELECT src, dst, 'word_word' AS relation, round(weight, 6) AS weight FROM pmi WHERE weight > 0 UNION ALL SELECT token, 'doc_' || doc_id, 'word_document', round(weight, 6) FROM t""")
def _(s, d):
    """As `pmi_edges_whole`, with the documents' TF-IDF edges."""
    return graphs.text_graph(arrays(s, d)).select("src", "dst", "relation", r6("weight"))


_W4 = pairs_sql(4)
_DIST = f"{POS}, {FREQ}, {_W4}, base AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, sum(12 // k) / 12 AS weight FROM pr WHERE a <> b GROUP BY ALL)"


@query("graphlm_cooccurrence", f"WITH {_DIST} SELECT src, dst, round(weight, 6) AS weight FROM base")
def _(s, d):
    return graphs.distance_cooccurrence(arrays(s, d), 4).select("src", "dst", r6("weight"))


_PPMI = f"""{_DIST}, ppmi AS (SELECT src, dst, ln(greatest(weight / (SELECT 2 * sum(weight) FROM base), 1e-12) /
(greatest(x.f / (SELECT sum(f) FROM freq), 1e-12) * greatest(y.f / (SELECT sum(f) FROM freq), 1e-12))) AS weight FROM base JOIN freq x ON x.token = src JOIN freq y ON y.token = dst)"""


@query("ppmi_edges", f"WITH {_PPMI} SELECT src, dst, round(weight, 6) AS weight FROM ppmi WHERE weight > 0")
def _(s, d):
    a = arrays(s, d)
    return graphs.distance_association(a, 4, cut(graphs.frequent(a, 1))).select("src", "dst", r6("weight"))


@query("stored_pair_counts", f"WITH {_PPMI} SELECT src, dst, round(weight, 6) AS weight FROM ppmi WHERE weight > 0")
def _(s, d):
    """As `ppmi_edges`, from counts stored in two batches of all documents, English and other ones, the first of them sent twice, and compacted."""
    path = scratch_path(s, "pairs")
    store = PairStore(s, path)
    drop_at_exit(s, path)
    rows = table(s, d, "documents")
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for name, part in (("en", rows.filter(english)), ("rest", rows.filter(~english)), ("en", rows.filter(english))):
        store.add(TK.token_arrays(spread(part), X.tokenize(F.lower("text"))), name)
    store.compact()
    return store.association("ppmi").select("src", "dst", r6("weight"))


_PRUNED = f"""base2 AS (SELECT src, dst, round(weight, 9) AS weight FROM base), sym AS ({both_sql("base2")}), ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM sym),
kept AS (SELECT src, dst, weight FROM ranked WHERE r <= 5), pruned AS (SELECT src, dst, max(weight) AS weight FROM ({both_sql("kept")}) GROUP BY ALL)"""


@query("corpus_scope_edges", f"""WITH {POS}, st AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY doc_id, pos) AS place FROM pos),
pr AS ({" UNION ALL ".join(f"SELECT token AS a, lead(token, {k}) OVER (ORDER BY place) AS b, {k} AS k FROM st" for k in range(1, 5))})
SELECT least(a, b) AS src, greatest(a, b) AS dst, round(sum(12 // k) / 12, 6) AS weight FROM pr WHERE a <> b GROUP BY ALL""")
def _(s, d):
    """Distances over all documents as one text, in the order of their ids."""
    return graphs.distance_cooccurrence(arrays(s, d), 4, "corpus").select("src", "dst", r6("weight"))


@query("prune_topk", f"WITH {_DIST}, {_PRUNED} SELECT src, dst, round(weight, 6) AS weight FROM pruned")
def _(s, d):
    a = arrays(s, d)
    return graphs.distance_association(a, 4, graphs.frequent(a, 1), "distance", 5).select("src", "dst", r6("weight"))


# algebra

_COOC = f"{POS}, {FREQ}, {W3}, e AS (SELECT a AS src, b AS dst, CAST(CASE WHEN a = b THEN 4 * n ELSE 2 * n END AS DOUBLE) AS weight FROM cnt WHERE a IN (SELECT token FROM freq WHERE f >= 5) AND b IN (SELECT token FROM freq WHERE f >= 5)), s AS ({both_sql('e')}), deg AS (SELECT src AS node, sum(weight) AS degree FROM s GROUP BY src)"


def cooc(s, d):
    return graphs.both_ways(graphs.cooccurrence(arrays(s, d), 3, 5))


@query("normalized_adjacency", f"WITH {_COOC} SELECT src, dst, round(weight / sqrt(x.degree * y.degree), 6) AS weight FROM s JOIN deg x ON x.node = src JOIN deg y ON y.node = dst")
def _(s, d):
    return algebra.normalized(cooc(s, d)).select("src", "dst", r6("weight"))


@query("normalized_adjacency_directed", f"WITH {_COOC}, w AS (SELECT * FROM s WHERE src < dst) SELECT src, dst, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS weight FROM w")
def _(s, d):
    return algebra.normalized(cooc(s, d).filter("src < dst"), directed=True).select("src", "dst", r6("weight"))


@query("row_normalize", f"WITH {_COOC} SELECT src, dst, round(weight / degree, 6) AS weight FROM s JOIN deg ON node = src")
def _(s, d):
    return algebra.row_normalized(cooc(s, d)).select("src", "dst", r6("weight"))


@query("degrees", f"WITH {_COOC} SELECT node, degree FROM deg")
def _(s, d):
    return algebra.degrees(cooc(s, d))


@query("self_loops", f"WITH {_COOC}, l AS (SELECT * FROM s UNION ALL SELECT node, node, 0.5 FROM deg) SELECT src, dst, sum(weight) AS weight FROM l GROUP BY ALL")
def _(s, d):
    e = cooc(s, d)
    return algebra.add_self_loops(e, e.select(F.col("src").alias("node")).distinct(), 0.5)


@query("symmetrize", f"WITH {_COOC}, u AS (SELECT * FROM s WHERE src <= dst) {both_sql('u')}")
def _(s, d):
    return algebra.undirected_from_upper(cooc(s, d))


@query("edge_list", f"WITH {_COOC} SELECT src, dst, weight FROM s WHERE src < dst AND weight <> 0")
def _(s, d):
    return algebra.edge_list(cooc(s, d)).select("src", "dst", "weight")


@query("graph_thinned", f"""WITH {_COOC}, n AS (SELECT src AS node FROM s UNION ALL SELECT dst FROM s), k AS (SELECT node FROM n GROUP BY node ORDER BY count(*) DESC, node LIMIT 55)
SELECT src, dst, weight FROM s WHERE src < dst AND src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k) ORDER BY weight DESC, src, dst LIMIT 170""")
def _(s, d):
    return graphs.cooccurrence_thinned(arrays(s, d), 3, 5)


# relations

_VOC = f"{POS}, w AS (SELECT DISTINCT token FROM pos)"


@query("subword_edges", f"""WITH {_VOC} SELECT DISTINCT a.token AS src, b.token AS dst, CAST(1 AS DOUBLE) AS weight FROM (SELECT DISTINCT unnest(p) AS token FROM (SELECT CASE WHEN length(token) <= 4 THEN [token]
ELSE [CASE WHEN i > 1 THEN '##' ELSE '' END || substr(token, i, 3) FOR i IN range(1, length(token) + 1, 3)] END AS p FROM w)) a,
(SELECT DISTINCT unnest(p) AS token FROM (SELECT CASE WHEN length(token) <= 4 THEN [token] ELSE [CASE WHEN i > 1 THEN '##' ELSE '' END || substr(token, i, 3) FOR i IN range(1, length(token) + 1, 3)] END AS p FROM w)) b
WHERE a.token < b.token AND len(list_intersect(
  list_concat(CASE WHEN length(replace(a.token, '##', '')) >= 3 THEN [replace(a.token, '##', '')] ELSE [] END, CASE WHEN starts_with(a.token, '##') AND length(a.token) >= 4 THEN [substr(a.token, 3, 2)] ELSE [] END),
  list_concat(CASE WHEN length(replace(b.token, '##', '')) >= 3 THEN [replace(b.token, '##', '')] ELSE [] END, CASE WHEN starts_with(b.token, '##') AND length(b.token) >= 4 THEN [substr(b.token, 3, 2)] ELSE [] END))) > 0""")
def _(s, d):
    pieces = arrays(s, d).select(F.explode("tokens").alias("w")).distinct().select(F.explode(X.char_chunks("w")).alias("token")).distinct()
    return graphs.subword_edges(pieces)


def _rest_sql(word: str, suffixes: tuple, spare: int) -> str:
    """SQL for a word without its first fitting suffix and the half-spaces before it."""
    cases = " ".join(f"WHEN ends_with({word}, '{x}') AND length({word}) > {len(x) + spare} THEN regexp_replace(left({word}, length({word}) - {len(x)}), '{K.ZWNJ}+$', '')" for x in suffixes)
    return f"CASE {cases} ELSE {word} END"


def _suffix_sql(word: str, suffixes: tuple, spare: int) -> str:
    cases = " ".join(f"WHEN ends_with({word}, '{x}') AND length({word}) > {len(x) + spare} THEN '{x}'" for x in suffixes)
    return f"CASE {cases} ELSE '' END"


# the driver's texts are Latin: a phrase by the document's number goes before each, so that the steps for Persian have something to act on
PHRASES = (
    "كلاسـهاي ۱۲۳ و ١٢٫۵ دلار", "مسئول مسائل مؤثرٌ در کافۀ شهر", "خانة\u0654 دانشجويان و كتاب\u200cهاي تازه کتاب کتابمان دوستانتر دوستان دوستانشان شهر شهرها شهرهای", "نمی\u200cروم کتاب\u200cها را تصمیم گرفت تا بماند", "دکتر علی رضایی از دانشگاه تهران مرکزی آمد",
    "بی\u200cکار \u200c هم\u200cراه با کتابهایشان و دوستانتان", "گل\u200cها، بلبلان؛ خارها | باغ", "سلام\u200b دنیا\ufeff کتابم خانه\u200cاش بزرگ\u200cترین",
)
PERSIAN = "fa AS MATERIALIZED (SELECT doc_id, [" + ", ".join(f"'{x}'" for x in PHRASES) + f"][doc_id % {len(PHRASES)} + 1] || ' ' || coalesce(text, '') AS text FROM documents)"
PERSIAN_WORDS = f"{PERSIAN}, fw AS MATERIALIZED (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM fa), fv AS MATERIALIZED (SELECT token FROM fw WHERE token <> '')"


def persian(s, d):
    rows = docs(s, d)
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    return rows.withColumn("text", F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit(""))))


def persian_words(s, d):
    return persian(s, d).select(F.explode(F.split("text", " ")).alias("token")).filter("token <> ''").distinct()


@query("stem_edges", f"""WITH {PERSIAN_WORDS}, t AS MATERIALIZED (SELECT DISTINCT token, {_rest_sql("w", K.SUFFIXES, 1)} AS stem FROM (SELECT token, trim(replace(token, '##', ''), '{K.ZWNJ}') AS w FROM fv))
SELECT a.token AS src, b.token AS dst, CAST(1 AS DOUBLE) AS weight FROM t a JOIN t b ON a.stem = b.stem AND a.token < b.token WHERE length(a.stem) >= 2""")
def _(s, d):
    return graphs.stem_edges(persian_words(s, d))


@query("surface_stems", f"WITH {PERSIAN_WORDS} SELECT token, {_rest_sql('w', K.SUFFIXES, 1)} AS stem FROM (SELECT token, trim(replace(token, '##', ''), '{K.ZWNJ}') AS w FROM fv)")
def _(s, d):
    return persian_words(s, d).select("token", X.surface_stem("token").alias("stem"))


_EDGE_MARKS = K.LABEL_PUNCTUATION.replace("'", "''")


@query("concept_roots", f"""WITH {PERSIAN_WORDS}, w AS (SELECT token, trim(trim(token, ' '), '{_EDGE_MARKS}') AS w FROM fv)
SELECT token, CASE {" ".join(f"WHEN ends_with(w, '{x}') AND length(w) > {len(x) + 2}" + (" AND NOT ends_with(w, 'گی')" if x == "ی" else "") + f" THEN regexp_replace(left(w, length(w) - {len(x)}), '{K.ZWNJ}+$', '')" for x in K.ROOT_SUFFIXES)}
ELSE regexp_replace(w, '{K.ZWNJ}+$', '') END AS root FROM w""")
def _(s, d):
    return persian_words(s, d).select("token", X.concept_root("token").alias("root"))


@query("morphology", f"""WITH {PERSIAN_WORDS}, p AS (SELECT token, CASE {" ".join(f"WHEN starts_with(token, '{x}') AND length(token) > {len(x) + 1} THEN '{x}'" for x in K.PREFIXES)} ELSE '' END AS pre FROM fv),
r AS (SELECT token, rtrim(pre, '{K.ZWNJ}') AS pre, substr(token, length(pre) + 1) AS w FROM p), x AS (SELECT token, pre, {_rest_sql("w", K.SUFFIXES, 1)} AS stem, {_suffix_sql("w", K.SUFFIXES, 1)} AS suf FROM r)
SELECT token, array_to_string([y FOR y IN [pre, stem, CASE WHEN suf = '' THEN '' ELSE '##' || suf END] IF y <> ''], ' ') AS pieces FROM x""")
def _(s, d):
    return persian_words(s, d).select("token", F.array_join(X.split_morphology("token"), " ").alias("pieces"))


_NORMAL = f"""translate(translate(replace(replace(translate(translate(nfc_normalize(text), '{K.ARABIC_LETTERS}', '{K.PERSIAN_LETTERS}'), '{K.HAMZA_LETTERS}', '{K.PLAIN_LETTERS}'), 'هٔ', 'ه{K.ZWNJ}ی'), 'ۀ', 'ه{K.ZWNJ}ی'),
'{K.DIGITS_FROM + K.SEPARATORS_FROM}', '{K.DIGITS_TO + K.SEPARATORS_TO}'), '{K.TATWEEL + K.DIACRITICS + K.ZERO_WIDTH}', '')"""


@query("normalize_persian", f"WITH {PERSIAN} SELECT doc_id, sha256(trim(regexp_replace(regexp_replace({_NORMAL}, '{K.SPACE}*{K.ZWNJ}{K.SPACE}*', '{K.ZWNJ}', 'g'), '{K.SPACE}+', ' ', 'g'))) AS digest FROM fa")
def _(s, d):
    return persian(s, d).select("doc_id", F.sha2(X.normalize("text"), 256).alias("digest"))


@query("tokenize_normalized", f"WITH {PERSIAN} SELECT doc_id, sha256(array_to_string(regexp_extract_all(replace({_NORMAL}, '{K.ZWNJ}', ' '), '{K.WORD_RUN}'), ' ')) AS digest FROM fa")
def _(s, d):
    return persian(s, d).select("doc_id", F.sha2(F.array_join(X.tokenize_persian("text"), " "), 256).alias("digest"))


@query("preprocess_persian", f"WITH {PERSIAN} SELECT doc_id, sha256(trim(regexp_replace(translate(replace(translate(text, 'يك', 'یک'), '{K.ZWNJ}', ' '), '{K.DIACRITICS}', ''), '{K.SPACE}+', ' ', 'g'))) AS digest FROM fa")
def _(s, d):
    return persian(s, d).select("doc_id", F.sha2(X.preprocess("text"), 256).alias("digest"))


@query("clean_lines", f"WITH {PERSIAN} SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(translate(replace(text, '{K.ZWNJ}', ' '), 'يك', 'یک'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '{K.SPACE}+', ' ', 'g'))) AS digest FROM fa")
def _(s, d):
    return persian(s, d).select("doc_id", F.sha2(X.clean_wiki("text"), 256).alias("digest"))


@query("compound_verbs", f"""WITH {PERSIAN} SELECT doc_id, sha256(regexp_replace(text || ' ', '([{K.ARABIC_BLOCK}]+){K.SPACE}+({"|".join(sorted(K.COMPOUND_LIGHT_VERBS, key=len, reverse=True))})({K.SPACE})', '\\1{K.ZWNJ}\\2\\3', 'g')) AS digest FROM fa""")
def _(s, d):
    return persian(s, d).select("doc_id", F.sha2(F.concat(X.join_compound_verbs("text"), F.lit(" ")), 256).alias("digest"))


_NAME = f"(?:{'|'.join(K.NAME_NOUNS)}){K.SPACE}+[{K.ARABIC_BLOCK}{K.ZWNJ}]+(?:{K.SPACE}+[{K.ARABIC_BLOCK}{K.ZWNJ}]+){{0,2}}"


@query("entities", f"WITH {PERSIAN} SELECT doc_id, array_to_string(regexp_extract_all(text, '{_NAME}'), '|') AS names FROM fa")
def _(s, d):
    return persian(s, d).select("doc_id", F.array_join(X.entities("text"), "|").alias("names"))


@query("keywords", f"WITH {PERSIAN} SELECT doc_id, sha256(array_to_string([{_STRIP} FOR x IN regexp_split_to_array(text, '[,،;؛|]') IF {_STRIP} <> ''], '|')) AS digest FROM fa")
def _(s, d):
    return persian(s, d).select("doc_id", F.sha2(F.array_join(X.keywords("text"), "|"), 256).alias("digest"))


@query("hate_labels", f"""SELECT doc_id, CASE WHEN l IN ({", ".join(f"'{x}'" for x in K.HATE_LABELS)}) THEN 'hate' WHEN l IN ({", ".join(f"'{x}'" for x in K.NORMAL_LABELS)}) THEN 'normal' ELSE l END AS label
FROM (SELECT doc_id, lower(trim(CAST(toxic AS VARCHAR))) AS l FROM labels)""")
def _(s, d):
    return table(s, d, "labels").select("doc_id", X.hate_label("toxic").alias("label"))


@query("char_profile_persian", f"""WITH {PERSIAN}, n AS (SELECT CAST(sum(length(text)) AS BIGINT) AS total, CAST(sum(length(regexp_replace(text, '[^{K.ARABIC_BLOCK}]', '', 'g'))) AS BIGINT) AS script_letters,
CAST(sum(length(text) - length(replace(text, '{K.ZWNJ}', ''))) AS BIGINT) AS zwnj FROM fa) SELECT total, script_letters, zwnj, round(script_letters / total, 6) AS script_ratio, round(zwnj * 1000 / total, 6) AS zwnj_per_1000 FROM n""")
def _(s, d):
    return corpus.char_profile(persian(s, d)).select("total", "script_letters", "zwnj", r6("script_ratio"), r6("zwnj_per_1000"))


@query("orthographic_similarity", f"""WITH {POS}, w AS (SELECT token FROM pos GROUP BY token HAVING count(*) >= 3), g AS (SELECT token, list_distinct([substr(token, i, 3) FOR i IN range(1, greatest(length(token) - 2, 1) + 1)]) AS g FROM w),
x AS (SELECT token, unnest(g) AS gram, len(g) AS n FROM g), c AS (SELECT a.token AS src, b.token AS dst, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS weight FROM x a JOIN x b ON a.gram = b.gram AND a.token <> b.token GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM c WHERE weight >= 0.6) SELECT src, dst, round(weight, 6) AS weight FROM r WHERE r <= 4""")
def _(s, d):
    return graphs.orthographic_edges(graphs.frequent(arrays(s, d), 3).select("token")).select("src", "dst", r6("weight"))


@query("distributional_similarity", f"""WITH {_PPMI}, q AS MATERIALIZED (SELECT src, dst, weight FROM ppmi WHERE weight > 0), rw AS MATERIALIZED ({both_sql("q")}),
nm AS (SELECT src, sqrt(sum(weight * weight)) AS norm FROM rw GROUP BY src), fan AS (SELECT dst AS c FROM rw GROUP BY dst HAVING count(*) BETWEEN 2 AND 200), sh AS MATERIALIZED (SELECT src, dst AS c, weight FROM rw SEMI JOIN fan ON c = dst),
dt AS (SELECT a.src AS src, b.src AS dst, sum(a.weight * b.weight) AS dot FROM sh a JOIN sh b ON a.c = b.c AND a.src < b.src GROUP BY ALL), e AS (SELECT dt.src, dt.dst, dot / (x.norm * y.norm) AS weight FROM dt JOIN nm x ON x.src = dt.src JOIN nm y ON y.src = dt.dst)
SELECT src, dst, round(weight, 6) AS weight FROM ({both_sql("e")}) WHERE round(weight, 9) >= 0.6""")
def _(s, d):
    """All edges, with the reference's largest fan-out of a context, 200."""
    a = arrays(s, d)
    # sums of doubles differ in their last digits between engines: the cut is at nine digits
    e = graphs.similar_rows(graphs.distance_association(a, 4, cut(graphs.frequent(a, 1))), 0.6 - 5e-10, None)
    return e.filter(F.round("weight", 9) >= 0.6).select("src", "dst", r6("weight"))


@query("dependency_heuristic", f"""WITH {POS}, h AS (SELECT token AS src, coalesce(CASE WHEN ends_with(a, 'ed') THEN a END, CASE WHEN ends_with(b, 'ed') THEN b END, CASE WHEN ends_with(c, 'ed') THEN c END, CASE WHEN ends_with(e, 'ed') THEN e END, a) AS dst
FROM (SELECT token, lead(token, 1) OVER w AS a, lead(token, 2) OVER w AS b, lead(token, 3) OVER w AS c, lead(token, 4) OVER w AS e FROM pos WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE a IS NOT NULL)
SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM h WHERE src <> dst GROUP BY ALL""")
def _(s, d):
    return graphs.dependency_edges(arrays(s, d), "ed$")


@query("word_document_edges", f"WITH {_TFIDF} SELECT token AS src, 'document:' || doc_id AS dst, round(tf / max(tf) OVER (PARTITION BY doc_id), 6) AS weight FROM tf")
def _(s, d):
    return graphs.word_document_edges(arrays(s, d)).select("src", "dst", r6("weight"))


@query("topic_document_edges", f"""WITH {POS}, t AS (SELECT token FROM pos GROUP BY token ORDER BY count(*) DESC, token LIMIT 8)
SELECT 'topic:' || token AS src, token AS dst, CAST(1 AS DOUBLE) AS weight FROM t UNION ALL SELECT DISTINCT 'topic:' || token, 'document:' || doc_id, CAST(1 AS DOUBLE) FROM pos JOIN t USING (token)""")
def _(s, d):
    return graphs.topic_document_edges(arrays(s, d))


@query("context_edges", f"WITH {POS} SELECT DISTINCT 'document:' || doc_id AS src, token AS dst, CAST(1 AS DOUBLE) AS weight FROM pos")
def _(s, d):
    return graphs.context_edges(arrays(s, d))


_MULTI = f"""{_DIST}, {_PRUNED}, wd AS (SELECT token AS src, 'document:' || doc_id AS dst, tf / max(tf) OVER (PARTITION BY doc_id) AS weight FROM (SELECT doc_id, token, count(*) AS tf FROM pos GROUP BY ALL)),
t AS (SELECT token FROM pos GROUP BY token ORDER BY count(*) DESC, token LIMIT 8),
td AS (SELECT 'topic:' || token AS src, token AS dst, CAST(1 AS DOUBLE) AS weight FROM t UNION ALL SELECT DISTINCT 'topic:' || token, 'document:' || doc_id, CAST(1 AS DOUBLE) FROM pos JOIN t USING (token)),
multi AS (SELECT src, dst, 'cooccurrence' AS relation, weight FROM pruned UNION ALL SELECT src, dst, 'word_document', weight / 2 FROM ({both_sql("wd")}) UNION ALL SELECT src, dst, 'topic_document', weight FROM ({both_sql("td")}))"""


def multi(s, d):
    a = arrays(s, d)
    near = graphs.distance_association(a, 4, graphs.frequent(a, 1), "distance", 5).withColumn("weight", F.round("weight", 9))
    parts = {"cooccurrence": near, "word_document": graphs.both_ways(graphs.word_document_edges(a)), "topic_document": graphs.both_ways(graphs.topic_document_edges(a))}
    return graphs.merge_relations(parts, {"word_document": 0.5}, summed=True)


@query("multi_relation_graph", f"WITH {_MULTI} SELECT src, dst, relation, round(weight, 6) AS weight FROM multi")
def _(s, d):
    return multi(s, d).select("src", "dst", "relation", r6("weight"))


@query("relation_edge_counts", f"WITH {_MULTI} SELECT relation, count(*) AS edges, round(sum(weight), 3) AS weight FROM multi GROUP BY relation")
def _(s, d):
    return multi(s, d).groupBy("relation").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 3).alias("weight"))


_G2 = f"""{POS}, freq AS MATERIALIZED (SELECT token, count(*) AS f FROM pos GROUP BY token HAVING count(*) >= 2), inner_pos AS MATERIALIZED (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM pos SEMI JOIN freq USING (token)),
{pairs_sql(4, "inner_pos")}, base AS MATERIALIZED (SELECT least(a, b) AS src, greatest(a, b) AS dst, sum(12 // k) / 12 AS weight FROM pr WHERE a <> b GROUP BY ALL)"""


def _pruned_sql(source: str, name: str) -> str:
    return f"""{name}_s AS ({both_sql(source)}), {name}_k AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) AS r FROM {name}_s) WHERE r <= 5),
{name} AS (SELECT src, dst, max(weight) AS weight FROM ({both_sql(f"{name}_k")}) GROUP BY ALL)"""


_DEP = f"coalesce(CASE WHEN regexp_matches(a, '^(می|نمی)|({'|'.join(K.LIGHT_VERB_HINTS)})$') THEN a END, CASE WHEN regexp_matches(b, '^(می|نمی)|({'|'.join(K.LIGHT_VERB_HINTS)})$') THEN b END, CASE WHEN regexp_matches(c, '^(می|نمی)|({'|'.join(K.LIGHT_VERB_HINTS)})$') THEN c END, CASE WHEN regexp_matches(e, '^(می|نمی)|({'|'.join(K.LIGHT_VERB_HINTS)})$') THEN e END, a)"


@query("graph_lm_graph", f"""WITH {_G2}, {_pruned_sql("base", "co")},
pp AS (SELECT src, dst, ln(greatest(weight / (SELECT 2 * sum(weight) FROM base), 1e-12) / (greatest(x.f / (SELECT sum(f) FROM freq), 1e-12) * greatest(y.f / (SELECT sum(f) FROM freq), 1e-12))) AS weight FROM base JOIN freq x ON x.token = src JOIN freq y ON y.token = dst),
pq AS (SELECT * FROM pp WHERE weight > 0), {_pruned_sql("pq", "ppmi")},
hd AS (SELECT token AS src, {_DEP} AS dst FROM (SELECT token, lead(token, 1) OVER w AS a, lead(token, 2) OVER w AS b, lead(token, 3) OVER w AS c, lead(token, 4) OVER w AS e FROM inner_pos WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE a IS NOT NULL),
dep AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT src, dst FROM hd WHERE src <> dst UNION ALL SELECT dst, src FROM hd WHERE src <> dst) GROUP BY ALL),
wd AS (SELECT token AS src, 'document:' || doc_id AS dst, tf / max(tf) OVER (PARTITION BY doc_id) AS weight FROM (SELECT doc_id, token, count(*) AS tf FROM inner_pos GROUP BY ALL)),
t AS (SELECT token FROM inner_pos GROUP BY token ORDER BY count(*) DESC, token LIMIT 8),
td AS (SELECT 'topic:' || token AS src, token AS dst, CAST(1 AS DOUBLE) AS weight FROM t UNION ALL SELECT DISTINCT 'topic:' || token, 'document:' || doc_id, CAST(1 AS DOUBLE) FROM inner_pos JOIN t USING (token))
SELECT src, dst, 'cooccurrence' AS relation, round(weight, 6) AS weight FROM co UNION ALL SELECT src, dst, 'ppmi', round(weight, 6) FROM ppmi UNION ALL SELECT src, dst, 'dependency', round(weight, 6) FROM dep
UNION ALL SELECT src, dst, 'word_document', round(weight / 2, 6) FROM ({both_sql("wd")}) UNION ALL SELECT src, dst, 'topic_document', weight FROM ({both_sql("td")})""")
def _(s, d):
    """The operator itself: five relations over words of two occurrences or more, pruned to five edges a word."""
    names = ["co-occurrence", "ppmi", "dependency", "word_doc", "topic-doc"]
    return graphs.multi_relation_graph(arrays(s, d), names, 4, 2, 5, 8, {"word_document": 0.5}).select("src", "dst", "relation", r6("weight"))


@query("graph_memory_retrieve", f"""WITH {_MULTI}, seed AS (SELECT unnest(['the', 'and', 'der']) AS node), s0 AS (SELECT node, 1.0 AS score FROM seed),
s1 AS (SELECT node, max(score) AS score FROM (SELECT node, score FROM s0 UNION ALL SELECT dst, score + weight / 2 FROM multi JOIN s0 ON node = src) GROUP BY node),
top AS (SELECT node, score FROM s1 ORDER BY round(score, 9) DESC, node LIMIT 32)
SELECT src, dst, relation, round(weight, 6) AS weight, round(x.score + y.score + weight, 6) AS rank_score FROM multi JOIN top x ON x.node = src JOIN top y ON y.node = dst ORDER BY round(x.score + y.score + weight, 9) DESC, src, dst, relation LIMIT 256""")
def _(s, d):
    seeds = s.createDataFrame([("the",), ("and",), ("der",)], "node string")
    return iterate.retrieve(multi(s, d), seeds)[1].select("src", "dst", "relation", r6("weight"), r6("rank_score"))


_PROMPTS = f"""WITH {_G2}, pp AS (SELECT src, dst, ln(greatest(weight / (SELECT 2 * sum(weight) FROM base), 1e-12) / (greatest(x.f / (SELECT sum(f) FROM freq), 1e-12) * greatest(y.f / (SELECT sum(f) FROM freq), 1e-12))) AS weight FROM base JOIN freq x ON x.token = src JOIN freq y ON y.token = dst),
pq AS (SELECT * FROM pp WHERE weight > 0), {_pruned_sql("pq", "pr5")}, gr AS MATERIALIZED (SELECT * FROM pr5),
first AS (SELECT conv_id, coalesce(text, '') AS text FROM conversations WHERE turn = 0),
seed AS MATERIALIZED (SELECT DISTINCT conv_id AS prompt, node FROM (SELECT conv_id, unnest(regexp_extract_all(lower(text), '{K.WORD}')) AS node FROM first) JOIN (SELECT DISTINCT src FROM gr) ON node = src),
f1 AS MATERIALIZED (SELECT prompt, dst AS node, max(1 + weight / 2) AS score FROM seed JOIN gr ON node = src GROUP BY ALL),
s1 AS MATERIALIZED (SELECT prompt, node, max(score) AS score, max(new) AS new FROM (SELECT prompt, node, 1.0 AS score, 0 AS new FROM seed UNION ALL SELECT *, 1 FROM f1) GROUP BY ALL),
f2 AS MATERIALIZED (SELECT prompt, dst AS node, max(score + weight / 3) AS score FROM s1 JOIN gr ON node = src WHERE new = 1 GROUP BY ALL),
s2 AS (SELECT prompt, node, max(score) AS score FROM (SELECT prompt, node, score FROM s1 UNION ALL SELECT * FROM f2) GROUP BY ALL HAVING max(score) >= 2),
top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY round(score, 9) DESC, node) AS rank FROM s2 QUALIFY rank <= 32)"""


def prompts(s, d):
    """The first turn of every conversation against the graph of word pairs by PPMI: two hops, scores of 2 and more."""
    graph = cut(graphs.multi_relation_graph(arrays(s, d), ["ppmi"], 4, 2, 5))
    first = table(s, d, "conversations").filter("turn = 0")
    words = first.select(F.col("conv_id").alias("prompt"), F.explode(X.tokenize(F.lower(F.coalesce("text", F.lit(""))))).alias("node"))
    seeds = cut(words.join(graph.select(F.col("src").alias("node")).distinct(), "node", "left_semi").select("prompt", "node").distinct())
    return first.select(F.col("conv_id").alias("prompt")), seeds, *iterate.retrieve_many(graph, seeds, 2, min_score=2.0)


@query("graph_memory_prompts", f"""{_PROMPTS}, e AS (SELECT x.prompt, g.src, g.dst, 'ppmi' AS relation, round(g.weight, 6) AS weight, x.score + y.score + g.weight AS rank_score FROM gr g JOIN top x ON x.node = g.src JOIN top y ON y.prompt = x.prompt AND y.node = g.dst)
SELECT prompt, src, dst, relation, weight, round(rank_score, 6) AS rank_score, row_number() OVER (PARTITION BY prompt ORDER BY round(rank_score, 9) DESC, src, dst) AS rank FROM e QUALIFY rank <= 256""")
def _(s, d):
    return prompts(s, d)[3].select("prompt", "src", "dst", "relation", r6("weight"), r6("rank_score"), F.col("rank").cast("long"))


@query("graph_memory_reports", f"""{_PROMPTS}, e AS (SELECT x.prompt, row_number() OVER (PARTITION BY x.prompt ORDER BY round(x.score + y.score + g.weight, 9) DESC, g.src, g.dst) AS r FROM gr g JOIN top x ON x.node = g.src JOIN top y ON y.prompt = x.prompt AND y.node = g.dst QUALIFY r <= 256),
c AS (SELECT prompt, count(*) AS seeds, count(top.node) AS kept FROM seed LEFT JOIN top USING (prompt, node) GROUP BY prompt)
SELECT first.conv_id AS prompt, CASE WHEN seeds IS NULL THEN 'no_prompt_nodes' WHEN t.n IS NULL THEN 'empty_after_scoring' END AS fallback, coalesce(seeds, 0) AS seed_nodes, coalesce(t.n, 0) AS retrieved_nodes, coalesce(k.n, 0) AS retrieved_edges,
round(coalesce(kept, 0) / coalesce(seeds, 1), 6) AS coverage, coalesce(t.names, '') AS top_nodes FROM (SELECT DISTINCT conv_id FROM first) first LEFT JOIN c ON c.prompt = conv_id
LEFT JOIN (SELECT prompt, count(*) AS n, string_agg(node, ' ' ORDER BY rank) FILTER (rank <= 10) AS names FROM top GROUP BY prompt) t ON t.prompt = conv_id LEFT JOIN (SELECT prompt, count(*) AS n FROM e GROUP BY prompt) k ON k.prompt = conv_id""")
def _(s, d):
    return iterate.retrieval_reports(*prompts(s, d)).select("prompt", "fallback", "seed_nodes", "retrieved_nodes", "retrieved_edges", r6("coverage"), F.array_join("top_nodes", " ").alias("top_nodes"))


@query("ids_graph", f"""WITH {POS}, v AS (SELECT token, row_number() OVER (ORDER BY cnt DESC, first) + 4 AS id FROM (SELECT token, count(*) AS cnt, min((doc_id, pos)) AS first FROM pos GROUP BY token HAVING count(*) >= 3)),
ip AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, id AS token FROM pos JOIN v USING (token)), {pairs_sql(4, "ip")}
SELECT a AS src, b AS dst, round(sum(12 // k) / 12, 6) AS weight FROM pr WHERE a <> b GROUP BY a, b""")
def _(s, d):
    a = cut(arrays(s, d))  # read twice
    return graphs.ids_graph(TK.encode(a, TK.vocabulary(a, 3))).select("src", "dst", r6("weight"))


@query("heads_graph", """WITH w AS (SELECT conv_id AS sentence, turn + 1 AS word, (turn + 1) // 2 AS head FROM conversations)
SELECT concat(sentence, ':', head) AS src, concat(sentence, ':', word) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM w WHERE head <> 0 GROUP BY ALL""")
def _(s, d):
    """Turns of a conversation as a tree: the parse comes as a table of heads."""
    words = table(s, d, "conversations").select(F.col("conv_id").alias("sentence"), (F.col("turn") + 1).alias("word"), F.expr("(turn + 1) div 2").alias("head"), "text")
    return graphs.heads_graph(words)[1]


_SENT = f"""st AS MATERIALIZED (SELECT doc_id, [{_STRIP} FOR x IN regexp_split_to_array(coalesce(text, ''), '{K.SUMMARY_END}') IF {_STRIP} <> ''] AS p FROM documents), sp AS (SELECT doc_id, len(p) AS n, unnest(p) AS sentence, unnest(range(len(p))) AS pos FROM st),
tk AS (SELECT doc_id, n, pos, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token FROM sp), tf AS (SELECT doc_id, n, pos, token, count(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT doc_id, token, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT doc_id, pos, token, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (doc_id, token)), u AS MATERIALIZED (SELECT doc_id, pos, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, pos)) AS w FROM w)"""


@query("sentence_edges", f"WITH {_SENT} SELECT a.doc_id, a.pos AS src, b.pos AS dst, round(sum(a.w * b.w), 6) AS weight FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.token = b.token AND a.pos < b.pos GROUP BY ALL")
def _(s, d):
    return sentences.sentence_edges(docs(s, d)).select("doc_id", F.col("src").cast("long"), F.col("dst").cast("long"), r6("weight"))


@query("attention_summary")
def _(s, d):
    return sentences.attention_summary(docs(s, d))


# similarity


def members_and_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of two kinds: `member` (src a document, dst its class's least id) and `pair` (src and dst two such ids). Copies are given by their members, not by all pairs of them."""
    one = members.select(F.lit("member").alias("kind"), F.col("doc_id").alias("src"), F.col("rep").alias("dst"), F.lit(1.0).alias("weight"))
    return one.unionByName(pairs.select(F.lit("pair").alias("kind"), "src", "dst", r6("weight")))


@query("document_similarity_pairs", f"""WITH {_TFIDF}, cl AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(t)) AS rep FROM tok),
u AS (SELECT doc_id, token, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS weight FROM tfidf WHERE doc_id IN (SELECT rep FROM cl)),
c AS (SELECT a.doc_id AS src, b.doc_id AS dst, sum(a.weight * b.weight) AS weight FROM u a JOIN u b ON a.token = b.token AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT 'member' AS kind, doc_id AS src, rep AS dst, CAST(1 AS DOUBLE) AS weight FROM cl UNION ALL SELECT 'pair', src, dst, round(weight, 6) FROM c WHERE round(weight, 9) >= 0.5""")
def _(s, d):
    return members_and_pairs(*similarity.document_pairs(arrays(s, d), 0.5))


@query("recommend_similar", f"""WITH q AS (SELECT regexp_extract_all('the thing and that nation of der und', '{K.WORD}') AS t), {TOK},
al AS (SELECT CAST(doc_id AS VARCHAR) AS id, t FROM tok UNION ALL SELECT 'query', t FROM q), p AS (SELECT id, unnest(t) AS token FROM al), tf AS (SELECT id, token, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
x AS (SELECT id, token, tf * (ln(((SELECT count(*) FROM al) + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (token)), u AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM x),
h AS (SELECT a.id, sum(a.w * b.w) AS score FROM u a JOIN u b ON b.id = 'query' AND a.token = b.token WHERE a.id <> 'query' GROUP BY a.id)
SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM documents LEFT JOIN h ON h.id = CAST(doc_id AS VARCHAR) ORDER BY coalesce(score, 0) DESC, doc_id DESC LIMIT 10""")
def _(s, d):
    asked = s.range(1).select(X.tokenize(F.lit("the thing and that nation of der und")).alias("tokens"))
    return similarity.search_documents(arrays(s, d), asked, 10).select("doc_id", r6("score"))


@query("vector_knn", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def _(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return similarity.vector_search(v, asked).select("query_id", "id", r6("score"), F.col("rank").cast("long"))


@query("vector_index_knn")
def _(s, d):
    """`vector_knn` by an inverted file: the rows whose id is divisible by 20 against all rows, with the probes that the index chose on its sample; recall is measured by a test and in the README."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return similarity.VectorIndex(v).search(asked).select("query_id", "id", r6("score"), F.col("rank").cast("long"))


@query("semantic_edges", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.e, b.e) AS weight FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT src, dst, round(weight, 6) AS weight FROM c WHERE round(weight, 9) >= 0.3""")
def _(s, d):
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return similarity.vector_pairs(v, 0.3 - 5e-10).filter(F.round("weight", 9) >= 0.3).select("src", "dst", r6("weight"))


@query("semantic_graph", f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT 'w' || a.vec_id AS a, 'w' || b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS w FROM v a JOIN v b ON a.vec_id < b.vec_id),
g AS (SELECT 'w' || ps AS a, 'w' || pp AS b, 0.8 AS w FROM (SELECT DISTINCT l_suppkey AS ps, l_partkey AS pp FROM lineitem) WHERE ps <> pp), x AS (SELECT a, b, w FROM c WHERE round(w, 9) >= 0.3 UNION ALL SELECT a, b, w FROM g)
SELECT src, dst, round(max(w), 6) AS weight FROM (SELECT a AS src, b AS dst, w FROM x UNION ALL SELECT b, a, w FROM x) GROUP BY ALL""")
def _(s, d):
    """Vectors of words with given relations, here suppliers with their parts, at 0.8."""
    v = table(s, d, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vector"))
    given = table(s, d, "lineitem").select(F.concat(F.lit("w"), "l_suppkey").alias("a"), F.concat(F.lit("w"), "l_partkey").alias("b")).distinct()
    return graphs.semantic_graph(given, v, 0.3 - 5e-10, None, 0.8).select("src", "dst", r6("weight"))


_KEY = f"regexp_replace(lower(trim(regexp_replace(coalesce(text, ''), '{K.SPACE}+', ' ', 'g'))), '[^\\p{{L}}\\p{{N}}_{K.ARABIC_BLOCK}{K.ZWNJ}]+', '', 'g')"


@query("near_duplicate_pairs", f"""WITH k AS MATERIALIZED (SELECT doc_id, {_KEY} AS k FROM documents), cl AS MATERIALIZED (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY k) AS rep FROM k WHERE k <> ''),
g AS MATERIALIZED (SELECT doc_id, unnest(list_distinct([substr(k, i, 13) FOR i IN range(1, greatest(length(k) - 12, 1) + 1)])) AS g FROM cl WHERE doc_id = rep),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), c AS (SELECT a.doc_id AS src, b.doc_id AS dst, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT 'member' AS kind, doc_id AS src, rep AS dst, CAST(1 AS DOUBLE) AS weight FROM cl UNION ALL
SELECT 'pair', src, dst, round(k / (x.n + y.n - k), 6) FROM c JOIN n x ON x.doc_id = src JOIN n y ON y.doc_id = dst WHERE k / (x.n + y.n - k) >= 0.82""")
def _(s, d):
    return members_and_pairs(*similarity.shingle_pairs(docs(s, d)))


# corpus

_HASH = f"sha256(trim(regexp_replace(translate(lower(coalesce(text, '')), 'يك', 'یک'), '{K.SPACE}+', ' ', 'g')))"
_GATE = f"""v AS (SELECT doc_id, source, n AS chars, CASE WHEN n = 0 THEN 'empty' WHEN n < 100 THEN 'too_short' WHEN CASE WHEN l = 0 THEN 0 ELSE r / l END < 0.9 THEN 'low_script_ratio' END AS reason FROM (
SELECT doc_id, source, length(trim(regexp_replace(coalesce(text, ''), '{K.SPACE}+', ' ', 'g'))) AS n, length(regexp_replace(text, '[^{LATIN}]', '', 'g')) AS r, length(regexp_replace(text, '[^\\p{{L}}{LATIN}]', '', 'g')) AS l FROM documents))"""


def gate(s, d):
    text = F.coalesce("text", F.lit(""))
    return docs(s, d).select("doc_id", "source", F.length(X.collapse_space(text)).cast("long").alias("chars"), corpus.gate_reason(F.col("text"), 100, 0.9, LATIN).alias("reason"))


@query("quality_gate", f"WITH {_GATE} SELECT doc_id, chars, reason FROM v")
def _(s, d):
    return gate(s, d).select("doc_id", "chars", "reason")


@query("quality_report", f"""WITH {_GATE} SELECT coalesce(source, 'all') AS source, coalesce(w, 'all') AS reason, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM (SELECT *, coalesce(reason, 'accepted') AS w FROM v) GROUP BY ROLLUP (source, w)""")
def _(s, d):
    return corpus.quality_report(gate(s, d), "source")


@query("exact_dedup", f"SELECT doc_id, {_HASH} AS text_hash, min(doc_id) OVER (PARTITION BY {_HASH}) AS first_id FROM documents")
def _(s, d):
    return corpus.exact_duplicates(docs(s, d))


@query("duplicate_count", f"SELECT CAST(sum(n - 1) AS BIGINT) AS exact_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY {_KEY})")
def _(s, d):
    return corpus.duplicate_count(docs(s, d))


_TOXIC = f"SELECT {_HASH} FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)"


def toxic_texts(s, d):
    """The texts of toxic documents, as an evaluation set that a corpus must not have."""
    return docs(s, d).join(table(s, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("text")


@query("build_corpus")
def _(s, d):
    return corpus.build_corpus(docs(s, d), table(s, d, "benchmark").select("text").union(toxic_texts(s, d)), 100, 0.9, LATIN)


@query("build_corpus_exact", f"""WITH {_GATE}, h AS (SELECT doc_id, {_HASH} AS text_hash FROM documents), ev AS (SELECT DISTINCT {_HASH} AS text_hash FROM benchmark UNION {_TOXIC}),
f AS (SELECT text_hash, min(doc_id) AS first_id FROM h JOIN v USING (doc_id) WHERE reason IS NULL GROUP BY text_hash)
SELECT doc_id, h.text_hash, chars, coalesce(reason, CASE WHEN ev.text_hash IS NULL AND doc_id <> first_id THEN 'exact_duplicate' WHEN ev.text_hash IS NOT NULL THEN 'eval_contamination' END) AS reason
FROM v JOIN h USING (doc_id) LEFT JOIN f ON f.text_hash = h.text_hash LEFT JOIN ev ON ev.text_hash = h.text_hash""")
def _(s, d):
    """`build_corpus` without its rule on near duplicates, which SQL cannot state."""
    known = table(s, d, "benchmark").select("text").union(toxic_texts(s, d))
    return corpus.build_corpus(docs(s, d), known, 100, 0.9, LATIN, near_threshold=None).select("doc_id", "text_hash", "chars", "reason")


@query("simhash_pairs")
def _(s, d):
    """Rows of two kinds: a `member` row for each document (dst: the least id of its simhash, distance 0), and a `pair` row for two of those least ids within the distance.

    Documents x and y are near if they have one dst, or if their dst make a pair: groups of
    copies are given by their members, not by all pairs of them.
    """
    small_batches(s)
    hashed = cut(arrays(s, d).select(F.col("doc_id").alias("id"), X.simhash("tokens").alias("simhash")))
    # equal hashes stand for one node, so a group of copies is one row of the join
    nodes = cut(hashed.groupBy("simhash").agg(F.min("id").alias("rep")))
    members = hashed.join(nodes, "simhash").select(F.lit("member").alias("kind"), F.col("id").alias("src"), F.col("rep").alias("dst"), F.lit(0).alias("distance"))
    pairs = similarity.simhash_pairs(nodes.select(F.col("rep").alias("id"), "simhash"))
    return members.unionByName(pairs.select(F.lit("pair").alias("kind"), "src", "dst", "distance"))


@query("decontaminate_exact", f"""SELECT doc_id FROM documents WHERE {_HASH} IN (SELECT {_HASH} FROM benchmark UNION ALL {_TOXIC})""")
def _(s, d):
    known = table(s, d, "benchmark").select("text").union(toxic_texts(s, d)).select(X.text_hash(F.coalesce("text", F.lit(""))).alias("k"))
    return docs(s, d).select("doc_id", X.text_hash(F.coalesce("text", F.lit(""))).alias("k")).join(known, "k", "left_semi").select("doc_id")


@query("split_counts", f"""WITH h AS (SELECT doc_id, sha256('0:' || {_HASH} || doc_id) AS k FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY k) AS r FROM h), n AS (SELECT round_even(count(*) * 0.05, 0) AS t, round_even(count(*) * 0.1, 0) AS v FROM h)
SELECT split, count(*) AS n, min(doc_id) AS first_id, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, CASE WHEN r <= t THEN 'test' WHEN r <= t + v THEN 'validation' ELSE 'train' END AS split FROM r, n) GROUP BY split""")
def _(s, d):
    rows = docs(s, d).select("doc_id", F.concat(X.text_hash(F.coalesce("text", F.lit(""))), F.col("doc_id").cast("string")).alias("text_hash"))
    return corpus.split(rows).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.sum("doc_id").alias("ids"))


@query("char_profile", f"""WITH c AS (SELECT coalesce(text, '') AS t FROM documents), n AS (SELECT CAST(sum(length(t)) AS BIGINT) AS total, CAST(sum(length(regexp_replace(t, '[^{K.ARABIC_BLOCK}]', '', 'g'))) AS BIGINT) AS script_letters,
CAST(sum(length(regexp_replace(t, '[^A-Za-z]', '', 'g'))) AS BIGINT) AS latin_letters, CAST(sum(length(regexp_replace(t, '[\\P{{Nd}}{K.ARABIC_BLOCK}]', '', 'g'))) AS BIGINT) AS digits,
CAST(sum(length(t) - length(replace(t, '{K.ZWNJ}', ''))) AS BIGINT) AS zwnj, CAST(sum(length(t) - length(regexp_replace(t, '{K.SPACE}', '', 'g'))) AS BIGINT) AS whitespace FROM c)
SELECT *, total - script_letters - latin_letters - digits - zwnj - whitespace AS other, round(latin_letters / total, 6) AS latin_ratio FROM n""")
def _(s, d):
    return corpus.char_profile(docs(s, d)).select("total", "script_letters", "latin_letters", "digits", "zwnj", "whitespace", "other", r6("latin_ratio"))


@query("audit", f"""WITH l AS (SELECT length(coalesce(text, '')) AS n FROM documents), k AS (SELECT count(*) AS n FROM documents GROUP BY {_KEY}) SELECT 'length' AS section, 'docs' AS name, CAST(count(*) AS DOUBLE) AS value FROM l UNION ALL
SELECT 'length', 'max_chars', max(n) FROM l UNION ALL SELECT 'characters', 'total', sum(n) FROM l UNION ALL SELECT 'duplicates', 'exact_duplicates', sum(n - 1) FROM k UNION ALL SELECT 'metadata key', 'lang', count(*) FROM documents UNION ALL SELECT 'metadata source', source, count(*) FROM documents WHERE source <> '' GROUP BY source""")
def _(s, d):
    rows = docs(s, d).withColumn("meta", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    wanted = ("docs", "max_chars", "total", "exact_duplicates", "lang")
    return corpus.audit(rows, metadata_col="meta").filter(F.col("name").isin(*wanted) | (F.col("section") == "metadata source"))


@query("length_stats", "SELECT count(*) AS docs, min(length(coalesce(text, ''))) AS min_chars, max(length(coalesce(text, ''))) AS max_chars, round(avg(length(coalesce(text, ''))), 6) AS mean_chars FROM documents")
def _(s, d):
    return corpus.length_stats(docs(s, d)).select("docs", F.col("min_chars").cast("long"), F.col("max_chars").cast("long"), r6("mean_chars"))


@query("sft_format", f"""WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, regexp_replace(coalesce(text, ''), '^{K.SPACE}+|{K.SPACE}+$', '', 'g') AS x FROM conversations),
g AS (SELECT conv_id, coalesce(string_agg(role || ': ' || x, chr(10) ORDER BY turn, role, x) FILTER (role <> 'assistant'), '') AS prompt, coalesce(string_agg(x, chr(10) ORDER BY turn, role, x) FILTER (role = 'assistant'), '') AS completion FROM t WHERE x <> '' GROUP BY conv_id)
SELECT conv_id, sha256('دستور:' || chr(10) || prompt || chr(10) || chr(10) || 'پاسخ:' || chr(10) || completion) AS digest FROM g WHERE length(completion) >= 1""")
def _(s, d):
    return corpus.sft_texts(table(s, d, "conversations")).select("conv_id", F.sha2("text", 256).alias("digest"))


_STREAM = f"{POS}, o AS (SELECT doc_id, coalesce(sum(len(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM tok), st AS (SELECT CAST(start + pos AS BIGINT) AS place, token FROM pos JOIN o USING (doc_id))"


@query("block_windows", f"""WITH {_STREAM}, b AS (SELECT place // 128 AS block_id, place, token FROM st UNION ALL SELECT place // 128 - 1, place, token FROM st WHERE place % 128 = 0 AND place > 0)
SELECT block_id, count(*) AS n, sha256(string_agg(token, ' ' ORDER BY place)) AS digest FROM b GROUP BY block_id HAVING block_id = 0 OR count(*) > 1""")
def _(s, d):
    return TK.blocks(arrays(s, d), 128).select("block_id", F.size("tokens").cast("long").alias("n"), F.sha2(F.array_join("tokens", " "), 256).alias("digest"))


@query("token_shards", f"WITH {_STREAM} SELECT place // 100000 AS shard, count(*) AS n, sha256(string_agg(token, ' ' ORDER BY place)) AS digest FROM st GROUP BY 1")
def _(s, d):
    placed = TK.offsets(arrays(s, d), F.size("tokens")).select("start", F.posexplode("tokens").alias("pos", "token")).select((F.col("start") + F.col("pos")).alias("at"), "token")
    shards = placed.groupBy(F.floor(F.col("at") / 100_000).alias("shard")).agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("t"))
    return shards.select("shard", F.size("t").cast("long").alias("n"), F.sha2(F.array_join(F.transform("t", lambda x: x["token"]), " "), 256).alias("digest"))


# iteration

_EVENT = "ev AS (SELECT user_id, event_type, count(*) AS w FROM events GROUP BY ALL), e AS (SELECT 'u' || user_id AS src, 't' || event_type AS dst, CAST(w AS DOUBLE) AS weight FROM ev)"


def event_edges(s, d):
    pairs = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return graphs.both_ways(pairs.select(F.concat(F.lit("u"), "user_id").alias("src"), F.concat(F.lit("t"), "event_type").alias("dst"), "weight"))


def _rank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT node, 1.0 / (SELECT count(*) FROM nd) AS score FROM nd)"]
    for k in range(rounds):
        steps.append(f"r{k + 1} AS MATERIALIZED (SELECT node, 0.15 / (SELECT count(*) FROM nd) + 0.85 * coalesce(got, 0) AS score FROM nd LEFT JOIN (SELECT dst AS node, sum(score * share) AS got FROM ln JOIN r{k} ON node = src GROUP BY dst) USING (node))")
    return ", ".join(steps)


@query("pagerank", f"WITH {_EVENT}, s AS ({both_sql('e')}), nd AS (SELECT DISTINCT src AS node FROM s), ln AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM s), {_rank_sql(10)} SELECT node, round(score, 9) AS score FROM r10")
def _(s, d):
    return iterate.pagerank(event_edges(s, d), max_iter=10, tol=None).select("node", F.round("score", 9).alias("score"))


@query("pagerank_converged")
def _(s, d):
    """Rounds until scores move by less than the operator's tolerance; `pagerank` is held to ten rounds by its SQL."""
    return iterate.pagerank(event_edges(s, d)).select("node", F.round("score", 9).alias("score"))


@query("social_graph", f"""WITH x AS (SELECT user_id AS u, lead(user_id) OVER (ORDER BY event_id) AS v, value AS w, event_id AS line FROM events), p AS (SELECT least(u, v) AS src, greatest(u, v) AS dst, max_by(coalesce(w, 1.0), line) AS weight FROM x WHERE u <> v GROUP BY ALL) {both_sql("p")}""")
def _(s, d):
    # neighbours by number: an equi-join, not a window over one partition
    e = table(s, d, "events").select("event_id", "user_id", "value")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("v"))
    return graphs.social_graph(e.join(after, "event_id").select(F.col("user_id").alias("u"), "v", F.col("value").alias("w"), F.col("event_id").alias("line")))


@query("connected_components", f"""WITH RECURSIVE x AS (SELECT user_id AS u, lead(user_id) OVER (ORDER BY event_id) AS v, event_id, lead(event_id) OVER (ORDER BY event_id) AS after FROM events), p AS (SELECT DISTINCT u AS src, v AS dst FROM x WHERE u <> v AND after = event_id + 1),
e AS MATERIALIZED (SELECT src, dst FROM p UNION SELECT dst, src FROM p), t AS (SELECT 0 AS r, src AS node, min(least(src, dst)) AS component FROM e GROUP BY src
UNION ALL SELECT t.r + 1, e.src, min(least(t.component, e.src)) FROM t JOIN e ON e.dst = t.node WHERE t.r < 60 GROUP BY t.r + 1, e.src) SELECT node, min(component) AS component FROM t GROUP BY node""")
def _(s, d):
    """Components of the whole social graph; the SQL spreads labels for 60 steps, more than this graph is wide."""
    return iterate.connected_components(QUERIES["social_graph"](s, d))


@query("modularity_communities")
def _(s, d):
    """Communities of the whole social graph; held against greedy merging in a test, as several divisions may be as good."""
    return iterate.modularity_communities(QUERIES["social_graph"](s, d).select("src", "dst", F.abs("weight").alias("weight")))


@query("text_embedding_knn")
def _(s, d):
    """Documents as mean word vectors of their PPMI graph; of those whose id is divisible by 20 the five nearest of all. Tests hold the directions against dense ones."""
    a = cut(arrays(s, d))
    words = graphs.multi_relation_graph(a, ["ppmi"], 4, 2, None)
    v = cut(embedding.embed_texts(a, embedding.word_vectors(words, 16, rounds=3), 16)).select(F.col("doc_id").alias("id"), "vector")
    asked = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return similarity.vector_search(v, asked).select("query_id", "id", r6("score"), F.col("rank").cast("long"))


@query("article_audit")
def _(s, d):
    """All documents as articles, their source as title; both tokenizers over their lines. A test holds every section against plain counts."""
    meta = F.map_filter(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"), lambda _, v: v.isNotNull())
    rows = docs(s, d).select(F.col("doc_id").alias("number"), F.col("source").alias("title"), F.col("text").alias("body"), F.lit(None).cast("string").alias("summary"), F.array("lang").alias("keywords"), meta.alias("metadata"))
    tokens = {"word": X.tokenize(F.col("line")), "lower": X.tokenize(F.lower("line"))}
    return corpus.audit_articles(rows, tokenizers=tokens).select("section", "name", r6("value"))


@query("textrank_summary")
def _(s, d):
    return tasks.textrank(docs(s, d))


@query("build_corpus_report")
def _(s, d):
    return corpus.quality_report(QUERIES["build_corpus"](s, d))


# tasks and metrics

_PRED = f"{_GATE}, p AS (SELECT l.quality AS y_true, CASE WHEN v.reason IS NULL THEN 1 ELSE 0 END AS y_pred FROM labels l JOIN v USING (doc_id))"


def predictions(s, d):
    """The quality labels, and what the corpus gate says of the same documents."""
    rows = table(s, d, "labels").join(gate(s, d), "doc_id")
    return rows.select(F.col("quality").cast("long").alias("y_true"), F.when(F.col("reason").isNull(), 1).otherwise(0).cast("long").alias("y_pred"))


@query("accuracy", f"WITH {_PRED} SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p")
def _(s, d):
    return tasks.accuracy(predictions(s, d)).select(r6("accuracy"))


@query("confusion_matrix", f"WITH {_PRED}, l AS (SELECT y_true AS y FROM p UNION SELECT y_pred FROM p) SELECT CAST(a.y AS BIGINT) AS y_true, CAST(b.y AS BIGINT) AS y_pred, count(p.y_true) AS n FROM l a CROSS JOIN l b LEFT JOIN p ON p.y_true = a.y AND p.y_pred = b.y GROUP BY ALL")
def _(s, d):
    return tasks.confusion(predictions(s, d))


@query("macro_f1", f"""WITH {_PRED}, l AS (SELECT y_true AS y FROM p UNION SELECT y_pred FROM p), f AS (SELECT y, 2 * (SELECT count(*) FROM p WHERE y_true = y AND y_pred = y) / ((SELECT count(*) FROM p WHERE y_true = y) + (SELECT count(*) FROM p WHERE y_pred = y)) AS f1 FROM l) SELECT round(avg(f1), 6) AS macro_f1 FROM f""")
def _(s, d):
    return tasks.macro_f1(predictions(s, d)).select(r6("macro_f1"))


@query("qa_f1", """WITH t AS (SELECT x.conv_id, x.turn, x.text AS q, y.text AS a FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1),
w AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(lower(q), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS p, list_filter(string_split(trim(regexp_replace(lower(a), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS g FROM t WHERE q IS NOT NULL AND a IS NOT NULL),
x AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(p) AS word FROM w) GROUP BY ALL), y AS (SELECT conv_id, turn, word, count(*) AS n FROM (SELECT conv_id, turn, unnest(g) AS word FROM w) GROUP BY ALL), o AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS b FROM x JOIN y USING (conv_id, turn, word) GROUP BY conv_id, turn)
SELECT conv_id, turn, CASE WHEN p = g THEN 1 ELSE 0 END AS exact, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CASE WHEN len(p) = len(g) THEN 1 ELSE 0 END ELSE 2 * coalesce(b, 0) / (len(p) + len(g)) END, 6) AS f1 FROM w LEFT JOIN o USING (conv_id, turn)""")
def _(s, d):
    """Every turn of every conversation against the turn after it."""
    rows = table(s, d, "conversations").select("conv_id", "turn", "text")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    pairs = rows.join(after, ["conv_id", "turn"]).filter("text IS NOT NULL AND a IS NOT NULL")
    scores = tasks.answer_scores(pairs.select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("prediction"), F.array("a").alias("answers")))
    return scores.select("id.conv_id", "id.turn", "exact", r6("f1"))


@query("bow_features", f"WITH {_TFIDF} SELECT doc_id, token, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS value FROM tf")
def _(s, d):
    return gnn.bow_features(arrays(s, d)).select("doc_id", "token", r6("value"))


@query("sage_mean_aggregate", f"WITH {_EVENT}, s AS ({both_sql('e')}), f AS (SELECT src AS node, sum(weight) AS x FROM s GROUP BY src) SELECT src AS node, round(sum(weight * x) / sum(weight), 6) AS value FROM s JOIN f ON node = dst GROUP BY src")
def _(s, d):
    e = event_edges(s, d)
    f = e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("value")).withColumn("feature", F.lit(0))
    return gnn.mean_aggregate(e, f).select("node", r6("value"))


@query("rate_limit", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS recent FROM events""")
def _(s, d):
    return tasks.rate_limit(table(s, d, "events"), 3, 3600).select("event_id", "recent")


@query("basket_cooccurrence", """WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), c AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*) AS n FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL) SELECT src, dst, n FROM c""")
def _(s, d):
    baskets = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    t, n = F.col("p"), F.size("p")
    # an order has few lines: its pairs are made in the row
    pairs = F.flatten(F.transform(t, lambda x, i: F.transform(F.slice(t, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda y: F.struct(x.alias("src"), y.alias("dst")))))
    return baskets.select(F.explode(pairs).alias("x")).groupBy("x.src", "x.dst").agg(F.count(F.lit(1)).alias("n"))


@query("classify_toxic")
def _(s, d):
    """A row for each document; a text without tokens gets the label of the intercept alone, and teaches nothing."""
    a = arrays(s, d)
    labels = table(s, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    return gnn.TextClassifier().fit(a.filter(F.size("tokens") > 0), labels).predict(a)


@query("graph_text_classifier")
def _(s, d):
    """A graph convolution over words and documents, taught by the labels whose crc32(doc_id as text) mod 4 is not 2; a row for each document. A test holds every step against dense arrays."""
    a = arrays(s, d)
    labels = table(s, d, "labels").filter("toxic IS NOT NULL").select("doc_id", F.col("toxic").alias("label"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    clf = TextGraphClassifier(64, hidden=8, epochs=10, learning_rate=0.1).fit(a, labels.filter(~held))
    return clf.predict(a).select("doc_id", "label_pred", r6("score"), held.alias("held_out"))


@query("dataset_report")
def _(s, d):
    """Labelled documents split, learned from and measured."""
    labels = table(s, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return gnn.dataset_report(arrays(s, d), labels)
