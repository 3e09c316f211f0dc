"""Readers: line corpora, records in several formats, labelled sets, articles, lexicons, edges.

Lines and records are numbered by all tasks that a file's splits give (`numbered`); no file is
brought into one task for it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions import text as X
from .numbered import lines_by_split, numbered_lines, read_table, running_count

_SUFFIXES = {".jsonl": "jsonl", ".json": "json", ".csv": "csv", ".tsv": "tsv"}
_EDGE = f"^{K.SPACE}+|{K.SPACE}+$"


def detect_format(path: str, requested: str = "auto") -> str:
    if requested != "auto":
        return requested.lower()
    return _SUFFIXES.get(os.path.splitext(path.rstrip("/"))[1].lower(), "txt")


def _strip(c):
    return F.regexp_replace(c, _EDGE, "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): lines without surrounding white space, blank ones dropped; fails if none is left."""
    out = spark.read.text(path).select(_strip("value").alias("text")).filter("text <> ''")
    if out.isEmpty():
        raise ValueError(f"{path} has no text")
    return out


def _joined(columns: list[str], fields: tuple[str, ...]):
    parts = [F.nullif(_strip(F.col(f).cast("string")), F.lit("")) for f in fields if f in columns]
    return _strip(F.concat_ws("\n", *parts)) if parts else F.lit("")


def read_records(spark: SparkSession, path: str, fmt: str = "auto", text_fields: tuple[str, ...] = ("text", "body")) -> DataFrame:
    """(path, line, text, decode_error) of txt, jsonl, json, csv or tsv records; text joins the fields that are not empty by newlines.

    Blank lines of txt stay as empty records; of jsonl they are skipped; a bad JSON line is its own text.
    """
    fmt = detect_format(path, fmt)
    no = F.lit(False).alias("decode_error")
    if fmt == "txt":
        return numbered_lines(spark, path).select("path", "line", _strip("value").alias("text"), no)
    if fmt == "jsonl":
        rows = numbered_lines(spark, path).withColumn("value", _strip("value")).filter("value <> ''")
        fields = list(dict.fromkeys((*text_fields, "text")))
        schema = T.StructType([T.StructField(f, T.StringType()) for f in fields] + [T.StructField("_bad", T.StringType())])
        parsed = rows.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
        parts = [F.nullif(_strip(F.col(f"r.{f}")), F.lit("")) for f in text_fields]
        bad = F.col("r._bad").isNotNull()
        text = F.when(bad, F.col("value")).otherwise(F.coalesce(F.nullif(F.concat_ws("\n", *parts), F.lit("")), _strip("r.text"), F.lit("")))
        return parsed.select("path", "line", text.alias("text"), bad.alias("decode_error"))
    if fmt == "json":
        whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.coalesce(F.get_json_object("value", "$.records"), F.col("value")).alias("value"))
        each = whole.select("path", F.posexplode(F.from_json("value", "array<string>")).alias("i", "item"))
        parts = [F.nullif(_strip(F.get_json_object("item", f"$.{f}")), F.lit("")) for f in text_fields]
        plain = F.when(~F.col("item").startswith("{"), F.col("item"))
        return each.select("path", (F.col("i") + 1).cast("long").alias("line"), F.coalesce(plain, F.nullif(F.concat_ws("\n", *parts), F.lit("")), F.get_json_object("item", "$.text"), F.lit("")).alias("text"), no)
    if fmt in ("csv", "tsv"):
        rows = read_table(spark, path, "\t" if fmt == "tsv" else ",")
        return rows.select(F.col("path__").alias("path"), F.col("record__").alias("line"), _joined(rows.columns, text_fields).alias("text"), no)
    raise ValueError("format must be auto, txt, json, jsonl, csv or tsv")


def read_labelled(spark: SparkSession, path: str, text_col: str = "text", label_col: str = "label", fmt: str = "auto") -> DataFrame:
    """(text, label) without rows where either is empty; fails if a column is missing."""
    fmt = detect_format(path, fmt)
    rows = spark.read.json(path) if fmt == "jsonl" else spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    missing = [c for c in (text_col, label_col) if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(_strip(F.col(text_col).cast("string")).alias("text"), _strip(F.col(label_col).cast("string")).alias("label")).filter("text <> '' AND label <> ''")


def parse_labelled(lines: DataFrame, column: str = "value") -> DataFrame:
    """(label, text) from lines `label<TAB>text` or `label|text`; others are dropped."""
    c = _strip(column)
    parts = F.when(F.contains(c, F.lit("\t")), F.split(c, "\t", 2)).when(F.contains(c, F.lit("|")), F.split(c, r"\|", 2))
    return lines.select(_strip(F.get(parts, F.lit(0))).alias("label"), _strip(F.get(parts, F.lit(1))).alias("text")).filter("label <> '' AND text <> ''")


def parse_edges(lines: DataFrame, column: str = "value", line: str = "line") -> DataFrame:
    """(u, v, w, line) from lines of two names and perhaps a weight; a weight that is no number is 1; loops are dropped."""
    parts = F.filter(F.split(_strip(column), rf"[\t,>\-–—]+|{K.SPACE}+"), lambda p: p != "")
    rows = lines.select(F.get(parts, F.lit(0)).alias("u"), F.get(parts, F.lit(1)).alias("v"), F.coalesce(F.get(parts, F.lit(2)).try_cast("double"), F.lit(1.0)).alias("w"), F.col(line).alias("line"))
    return rows.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")


# articles: (path, number, title, body, summary, keywords, metadata)


def _articles(rows: DataFrame, key: str) -> DataFrame:
    meta = F.map_concat(X.metadata(F.coalesce("metadata", F.lit("{}"))), F.create_map(F.lit(key), F.col("number").cast("string")))
    words = F.coalesce(F.from_json("keywords", "array<string>"), X.keywords("keywords"), F.array().cast("array<string>"))
    return rows.select("number", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), F.coalesce("summary", F.lit("")).alias("summary"), words.alias("keywords"), meta.alias("metadata"))


def read_articles(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """Articles of a txt file (`# heading` blocks, else blank-line blocks, else lines), jsonl, csv or tsv."""
    fmt = detect_format(path, fmt)
    if fmt == "txt":
        return _text_articles(spark, path)
    if fmt == "jsonl":
        rows = numbered_lines(spark, path).filter(_strip("value") != "")
        fields = {f: F.get_json_object("value", f"$.{f}").alias(f) for f in ("title", "body", "summary", "keywords", "metadata")}
        return _articles(rows.select(F.col("line").alias("number"), *fields.values()), "source_line")
    if fmt not in ("csv", "tsv"):
        raise ValueError("format must be auto, txt, jsonl, csv or tsv")
    rows = read_table(spark, path, "\t" if fmt == "tsv" else ",")
    if "body" not in rows.columns:
        raise ValueError("articles need a body column")
    numbered = rows.withColumn("number", F.col("record__"))
    have = [F.col(f).cast("string").alias(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in ("title", "body", "summary", "keywords", "metadata")]
    return _articles(numbered.select("number", *have), "source_row")


def _text_articles(spark: SparkSession, path: str) -> DataFrame:
    lines = lines_by_split(spark, path).withColumn("value", _strip("value"))
    heading = F.regexp_extract("value", r"^#(?!#)\s*(.+)$", 1)
    if not lines.filter(heading != "").isEmpty():
        rows = running_count(lines, heading != "", "part")
        title, body = F.max(heading), F.when(heading == "", F.col("value"))
    else:
        # lines of one block have as many blank lines before them
        rows = running_count(lines, F.col("value") == "", "part").filter("value <> ''")
        if rows.groupBy("path").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").isEmpty():
            rows = rows.withColumn("part", F.col("line"))
        title, body = F.lit(""), F.col("value")
    rows = rows.withColumn("body_line", body).filter("value <> ''")
    grouped = rows.groupBy("path", "part").agg(title.alias("title"), F.array_sort(F.collect_list(F.when(F.col("body_line") != "", F.struct("line", F.col("body_line").alias("x"))))).alias("b"), F.min("line").alias("number"))
    return grouped.select("number", "title", F.array_join(F.transform("b", lambda s: s["x"]), " ").alias("body"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("keywords"), F.create_map().cast("map<string,string>").alias("metadata"))


# lexical relations: (a, b), both directions, no loops


def _closed(pairs: DataFrame) -> DataFrame:
    clean = pairs.select(_strip("a").alias("a"), _strip("b").alias("b")).filter("a <> '' AND b <> '' AND a <> b")
    return clean.union(clean.select("b", "a")).toDF("a", "b").distinct()


def _within(lists: DataFrame) -> DataFrame:
    """Pairs inside each list (words)."""
    w = F.col("words")
    return lists.select(F.explode(F.flatten(F.transform(w, lambda x, i: F.transform(F.slice(w, i + 2, F.greatest(F.size(w) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")


def _list(c):
    """A JSON list or a comma string as an array."""
    return F.coalesce(F.when(c.startswith("["), F.from_json(c, "array<string>")), F.transform(F.split(c, ","), lambda x: F.trim(x)))


def read_relations(spark: SparkSession, path: str, fmt: str = "auto") -> DataFrame:
    """Relations of a lexicon: JSON (a mapping, a list of synsets or pairs, or {"synsets": ...}) or a table of source and target, or of synset and word."""
    fmt = detect_format(path, fmt)
    if fmt == "json":
        whole = spark.read.text(path, wholetext=True).select(F.trim(F.coalesce(F.get_json_object("value", "$.synsets"), F.col("value"))).alias("value"))
        items = whole.filter(F.col("value").startswith("[")).select(F.explode(F.from_json("value", "array<string>")).alias("item"))
        get = lambda *names: F.coalesce(*(F.get_json_object("item", f"$.{n}") for n in names))
        synsets = _within(items.select(_list(get("words", "lemmas", "senses", "synonyms")).alias("words")).filter("words IS NOT NULL"))
        pairs = items.select(get("source", "word", "lemma").alias("a"), F.explode(_list(get("targets", "related", "target"))).alias("b"))
        mapping = whole.filter(F.col("value").startswith("{")).select(F.explode(F.from_json("value", "map<string,string>")).alias("a", "v")).select("a", F.explode(F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))).alias("b"))
        return _closed(synsets.union(pairs).union(mapping))
    rows = spark.read.option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in rows.columns], F.lit(None).cast("string"))
    cells = rows.select(pick("source", "src", "word", "lemma").alias("a"), pick("target", "dst", "related").alias("b"), pick("synset_id", "synset", "sid").alias("s"))
    pairs = cells.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    groups = cells.filter("s IS NOT NULL AND a IS NOT NULL").groupBy("s").agg(F.array_sort(F.collect_set("a")).alias("words"))
    return _closed(pairs.union(_within(groups)))


def demo_dataset(spark: SparkSession) -> DataFrame:
    """(text, label): three short texts of three labels."""
    return spark.createDataFrame([("این یک متن سیاسی است", "politics"), ("تیم ملی در بازی پیروز شد", "sports"), ("این فیلم درباره هنر است", "art")], "text string, label string")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, turn, role, text) from JSON lines with `messages`, or with `prompt` and `completion`; other lines are dropped."""
    rows = numbered_lines(spark, path)
    turns = F.from_json(F.get_json_object("value", "$.messages"), "array<struct<role:string,content:string>>")
    single = F.array(*(F.struct(F.lit(r).alias("role"), F.coalesce(F.get_json_object("value", f"$.{f}"), F.lit("")).alias("content")) for r, f in (("user", "prompt"), ("assistant", "completion"))))
    found = rows.select(F.col("line").alias("conv_id"), F.coalesce(turns, F.when(F.get_json_object("value", "$.completion").isNotNull(), single)).alias("m"))
    return found.select("conv_id", F.posexplode("m").alias("turn", "x")).select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("x.role", F.lit("user")).alias("role"), F.coalesce("x.content", F.lit("")).alias("text"))


def read_eval_rows(spark: SparkSession, path: str) -> DataFrame:
    """(line, row): evaluation rows as maps of strings; a line that is no JSON object, or a line of plain text, is the map of its `text`. Blank lines go."""
    fmt = detect_format(path)
    if fmt in ("csv", "tsv"):
        table = read_table(spark, path, "\t" if fmt == "tsv" else ",")
        pairs = [x for c in table.columns if c not in ("path__", "record__") for x in (F.lit(c), F.coalesce(F.col(f"`{c}`"), F.lit("")))]
        return table.select((F.col("record__") - 1).alias("line"), F.create_map(*pairs).alias("row"))
    lines = numbered_lines(spark, path).filter(_strip("value") != "")
    text = F.create_map(F.lit("text"), F.col("value"))
    if fmt != "jsonl":
        return lines.select("line", text.alias("row"))
    scalar = F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")
    found = F.when(F.trim("value").startswith("{"), F.from_json("value", "map<string,string>"))
    return lines.select("line", F.coalesce(found, F.create_map(F.lit("text"), F.coalesce(scalar, F.col("value")))).alias("row"))


def read_eval_hashes(spark: SparkSession, paths: list[str], text_fields: tuple[str, ...] = ("text", "body")) -> DataFrame:
    """(text_hash): hash keys of the records of evaluation files; paths that do not exist are passed over."""
    out = spark.createDataFrame([], "text_hash string")
    for path in paths:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            out = out.union(read_records(spark, path, "auto", text_fields).filter("text <> ''").select(X.text_hash("text")))
    return out.distinct()


def list_catalog(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, path, length, modified): the files under a folder whose names match, for listings of models, graphs and runs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length", F.col("modificationTime").alias("modified"))
