import re
from itertools import permutations

from loomgraph.llm import audit

SPACE = r"[^\x20\x09-\x0D]+"


def brute(docs, labels):
    """Every order run over the documents themselves."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for doc_id, text, source in docs:
        t = text or ""
        w = re.findall(SPACE, t)
        fails = set()
        fails |= {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if doc_id is not None and any(i is not None and i < doc_id and (o or "") == t for i, o, _ in docs) else set()
        rows.append((source or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in mine if f in r[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        shapley = {f: sum(v[1] for k, v in out.items() if k[0] == part and v[6] == f) for f in "ABCDE"}
        for k, v in out.items():
            if k[0] == part:
                v[6] = shapley[v[6]]
    return {k: tuple(v) for k, v in out.items()}


LONG = " ".join(f"w{k}" for k in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (4, "short TEXT", "a"), (5, "short TEXT", None), (6, None, "b"), (7, "", "b"), (8, "x # y", "b"), (9, "same " * 200, "a"),
    (10, LONG + " |", "a"), (10, LONG + " |", "a"), (11, LONG + " |", "a"), (None, LONG, "a"), (None, "Z", None), (0, "ab " * 30000, "c"), (12, "É" * 30 + "A", "c"), (2, "other text", "c"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (5, None, 1), (10, 1, None), (10, 0, 0), (2, 1, 0), (99, 1, 1), (None, 1, 1)]


def frames(spark, docs, labels):
    # names that the operator could trip over
    d = spark.createDataFrame([(*r, 1, "m") for r in docs], "doc_id long, text string, source string, mask int, digest string")
    return d, spark.createDataFrame([(*r, 7) for r in labels], "doc_id long, quality int, toxic int, docs int")


def test_against_every_order_run_over_documents(spark):
    got = audit.audit(*audit.masks(*frames(spark, DOCS, LABELS))).collect()
    want = brute(DOCS, LABELS)
    assert len(got) == len(want) == 600 * 4
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want


def test_shapley_shares_sum_to_what_all_filters_remove(spark):
    rows = audit.audit(*audit.masks(*frames(spark, DOCS, LABELS))).filter("filter_order = 'ABCDE'").collect()
    for part in {r.part for r in rows}:
        mine = [r for r in rows if r.part == part]
        assert sum(r.shapley for r in mine) == 120 * sum(r.removed for r in mine)


def test_limits_are_parameters_and_empty_tables(spark, tmp_path):
    d, labels = frames(spark, DOCS, LABELS)
    strict = audit.audit(*audit.masks(d, labels, min_words=10**6)).filter("filter_order = 'ABCDE' AND step = 1")
    assert all(r.kept == 0 for r in strict.collect())
    frames(spark, [], [])[0].write.parquet(f"{tmp_path}/documents.parquet")
    frames(spark, [], [])[1].write.parquet(f"{tmp_path}/labels.parquet")
    assert audit.op11_filter_audit(spark, str(tmp_path)).collect() == []
    assert audit.audit(*audit.masks(d, labels.limit(0))).filter("good_lost > 0 OR toxic_lost > 0").isEmpty()
