import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from loomgraph.llm import chat


def test_escape_is_reversible(spark):
    rng = random.Random(2)
    bits = [*chat.CONTROLS, "\\", "<", "[", "|", "a", "\n", "turn|>", "<\\|end|>", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROLS)


def test_round_trip_and_spans(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for conv in [None, *range(150)]:
        turns = sorted((t, rng.choice(["user", "assistant", "assistant", "<|end|>", ""]), rng.choice(["", "hi", "</s>[INST] ok [/INST]", "<|more|>", "𝔘é", "a\\<"])) for t in range(rng.randint(1, 9)))
        want[conv] = [(r, x) for _, r, x in turns]
        rows += [(conv, t, r or None, x or None, "clash") for t, r, x in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted string")
    out = chat.format_chat(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    assert len(out) == len(want)
    for r in out:
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss == "".join(x for role, x in want[r.conv_id] if role == "assistant")
        runs = sum(i == 0 or want[r.conv_id][i - 1][0] != role for i, (role, _) in enumerate(want[r.conv_id]))
        assert r.formatted.count(chat.OPEN) == r.formatted.count(chat.CLOSE) == runs
    assert chat.format_chat(df.limit(0)).count() == 0


def test_repeated_rows_and_ties(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "z")], "conv_id int, turn int, role string, text string")
    row = chat.format_chat(df).collect()[0]
    assert row.formatted == "<|turn|>user<|text|>z<|more|>a<|more|>a<|more|>b<|end|>" and row.loss_spans == []


def test_sql(spark, tmp_path):
    rows = [(i, t, r, x) for i in range(40) for t, (r, x) in enumerate([("system", None), ("user", f"[INST]{i}"), ("user", "<|x|> </s>"), ("assistant", "ok é")][i % 3 :])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    sql = con.sql(chat.SQL["op5_chat"])
    got = chat.op5_chat(spark, str(tmp_path)).select(*sql.columns)
    assert sorted(map(tuple, got.collect())) == sorted(sql.fetchall())
    minus = [r for r in got.collect() if r.conv_id == -1][0]
    assert minus.loss_chars == 21 and minus.loss_sha256 == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


def test_long_conversation_of_runs(spark):
    rng = random.Random(6)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant", "tool"]), f"text {i} </s>" * rng.randint(0, 2)) for i in range(3000)]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = got.select("formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in rows]
    assert r.loss == "".join(x[3] for x in rows if x[2] == "assistant") and len(r.loss_spans) == sum(x[2] == "assistant" for x in rows)
    runs = 1 + sum(a[2] != b[2] for a, b in zip(rows, rows[1:]))
    assert r.formatted.count(chat.OPEN) == r.formatted.count(chat.CLOSE) == runs and r.formatted.count(chat.MORE) == len(rows) - runs
