import hashlib
import random
import re

import duckdb
import pytest

from loomgraph.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, window=13):
    out = {}
    for d, text in docs:
        w, hit, items = words(text), set(), set()
        for item, t in bench:
            b = words(t)
            for s in range(max(1, len(b) - window + 1) if b else 0):
                g = b[s : s + window]
                for i in range(len(w) - len(g) + 1):
                    if w[i : i + len(g)] == g:
                        hit |= set(range(i, i + len(g)))
                        items.add(str(item))
        out[d] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(11)
    pool = ["the", "of", "é", "A1", "Über", "zz", "q", "w", "e", "r"]
    bench = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(30)]
    bench += [(30, None), (31, ""), (32, "the of the of the of the of the of the of the of the of"), (33, "unseen " * 15), (5, bench[5][1])]
    docs = []
    for i in range(150):
        text = " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        if i % 2:
            w = (bench[rng.randrange(30)][1] or "").split()
            a = rng.randint(0, max(0, len(w) - 5))
            text += rng.choice([". ", "\n", " "]) + "--".join(w[a:]) + " " + " ".join(rng.choice(pool) for _ in range(rng.randint(0, 300)))
        docs.append((i, text))
    docs += [(200, None), (201, ""), (202, "the of " * 30), (203, "THE OF " * 500)]
    return docs, bench


def test_query_matches_brute_force_and_sql(spark, tmp_path, tables):
    docs, bench = tables
    spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, tid string, pos int").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, t, "x") for d, t in bench], "item_id long, text string, q string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = dc.op8_decontaminate(spark, str(tmp_path))
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()}
    assert rows == brute(docs, bench)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    sql = con.sql(dc.SQL["op8_decontaminate"])
    assert sorted(map(tuple, got.select(*sql.columns).collect())) == sorted(sql.fetchall())


def test_without_broadcast(spark, tables, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    docs, bench = tables
    out = dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit) for r in out} == {k: v[:2] for k, v in brute(docs, bench).items()}


def test_odd_rows(spark):
    bench = spark.createDataFrame([(None, "a b c"), (1, "x y")], "item_id long, text string")
    docs = spark.createDataFrame([(None, "a b c"), (7, "a b c x y"), (7, "a b c x y"), (7, "x y z")], "doc_id long, text string")
    out = dc.contamination(docs, bench).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r.item_ids)) for r in out) == [("7", 3, 2, ("1",)), ("7", 5, 5, ("", "1")), ("7", 5, 5, ("", "1")), ("None", 3, 3, ("",))]
    assert dc.contamination(docs, bench.limit(0)).filter("n_hit > 0 OR contaminated").count() == 0
    assert dc.contamination(docs.limit(0), bench).count() == 0


def test_proximity(spark):
    item = "a b c d e f g h i j k l m"
    docs = spark.createDataFrame([(1, item), (2, "a c d x e f g h i j k l m b"), (3, "a " + "x " * 9 + "b"), (4, "a x b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    places, slop = item.split(), 2
    n = {w: sum(r.text.split().count(w) for r in docs.collect()) for w in places}
    one, two = sorted(range(13), key=lambda q: (n[places[q]], q))[:2]
    want = {}
    for r in docs.collect():
        w = r.text.split()
        gaps = [abs((i - one) - (j - two)) for i, x in enumerate(w) if x == places[one] for j, y in enumerate(w) if y == places[two]]
        if gaps and min(gaps) <= slop:
            want[r.doc_id] = min(gaps)
    assert {r.doc_id: r.near for r in dc.proximity_matches(docs, bench, slop).collect()} == want


def near_brute(docs, bench, slop, window=13):
    w = {d: words(text) for d, text in docs}
    count = {}
    for x in w.values():
        for y in x:
            count[y] = count.get(y, 0) + 1
    out = {}
    for item, text in bench:
        b = words(text)
        for at in range(max(1, len(b) - window + 1) if b else 0):
            rare = sorted((count[b[q]], q) for q in range(at, min(at + window, len(b))) if b[q] in count)[:2]
            if len(rare) < min(2, len(b)):
                continue
            one, two = rare[0][1], rare[-1][1]
            for d, x in w.items():
                gaps = [abs((i - one) - (j - two)) for i, p in enumerate(x) if p == b[one] for j, q in enumerate(x) if q == b[two] and (one != two or i == j)]
                if gaps and min(gaps) <= slop:
                    out[d, str(item), at] = min(gaps)
    return out


def test_proximity_query_with_absent_words(spark, tmp_path, tables):
    docs, bench = tables
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(20)]
    # a copied passage whose name was replaced, a short one, items of one word, of absent words and with one known word
    bench = dict(bench) | {40: " ".join([*passage[:8], "Nameless", *passage[9:]]), 41: "p1 p2 Gone p4", 42: "p3", 43: "absent", 44: "absent p5", 45: "zz nowhere q"}
    docs = [*docs, (300, " ".join([*passage[:8], "Other", *passage[9:]])), (301, "p1 x p2 y p4 p3"), (302, " ".join(rng.sample(passage, 20)))]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(bench.items()), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    want = near_brute(docs, list(bench.items()), 2)
    got = dc.op8_proximity(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.item_id, r.at): r.near for r in got} == want and len(got) == len(want)
    assert {(300, "40", at) for at in range(8)} <= set(want) and (300, "41", 0) in want and (301, "42", 0) in want and not any(k[1] in ("43", "44") for k in want)
