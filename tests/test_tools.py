import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import tools


def test_analysis(spark):
    docs = spark.createDataFrame([(1, "کتاب خوب است. شرکت ملی نفت کتاب دارد"), (2, "کتاب دیگر و شهر")], "doc_id long, text string")
    (row,) = tools.analyse(docs, X.tokenize("text")).collect()
    got = json.loads(row.result)
    assert got["status"] == "success" and got["keywords"][0] == {"token": "کتاب", "count": 3, "score": pytest.approx(3 / 10, abs=0.1)}
    assert got["entities"] and got["graph"]["nodes"] and got["explanation"]["top_nodes"][0]["score"] == 1.0
    assert all(n["node"] not in ("است", "و") for n in got["explanation"]["top_nodes"])


def test_grid_and_limits(spark):
    arrays = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "c"])], "doc_id long, tokens array<string>")
    out = tools.graph_statistics(arrays, {"relations": [["cooccurrence"], ["stem", "word_document"]], "window": [1, 2]}).collect()
    assert len({r.name for r in out}) == 4
    with pytest.raises(ValueError):
        tools.checked("window", 21)


def test_article_round_trip(spark):
    df = spark.createDataFrame([("ت", "یک. دو. سه.", ["k", "l"])], "title string, body string, keywords array<string>")
    line = df.select(X.article_line("title", "body", "keywords").alias("line"))
    (a,) = line.select(tools.parse_article("line").alias("a")).select("a.*").collect()
    assert (a.title, a.keywords, a.introduction, a.body, a.conclusion) == ("ت", ["k", "l"], "یک.", "یک. دو. سه.", "سه.")
    (m,) = line.select(tools.article_markdown(tools.parse_article(F.col("line"))).alias("m")).collect()
    assert m.m.startswith("# ت\n\nیک.\n\n") and m.m.endswith("سه.\n")
