import hashlib
import random
import re

from pyspark.sql import functions as F

from loomgraph.llm import secrets


def pieces(rng):
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([8, 31, 32, 40, 64])))
    word = "".join(rng.choice("AZaz09+/_.=-") for _ in range(rng.choice([3, 8, 20])))
    return rng.choice(
        [
            "plain words ", "é€𝔘 ", "\n", "paſſword=12345678 ", "ſecret: abcdefghij ", "toKen: abcdefgh ",
            f"{rng.choice(['password', 'PassWd', 'SECRET', 'token', 'api_key', 'apikey', 'APIKEY'])}{rng.choice(['', '"', chr(39)])}{' ' * rng.randint(0, 2)}{rng.choice(':=')} {rng.choice(['', '"'])}{word}",
            f" AKIA{''.join(rng.choice('AZ09') for _ in range(rng.choice([4, 12, 20])))}", f" {hexes} ", "token: token=abcdefgh12 ",
            "ghp_" + "a1" * 18 + " ", "xoxb-1234567890-abc ", "AIza" + "x" * 35 + " ", "sk_live_" + "9" * 20, "https://me:hunter2@example.org ",
            "eyJhbGciOiJ9." + "eyJzdWIiOiIx9." + "abcdefghij ", "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----",
        ]
    )


def brute(text, rules):
    out = []
    for k, r in enumerate(rules):
        for m in r.compiled().finditer(text):
            if len(m.group(r.group)) >= r.min_length:
                out.append((m.start(), k, m.end()))
    return [(rules[k].kind, a, b) for a, k, b in sorted(out)]


def test_queries_hold_for_every_match():
    assert secrets.trigram_query(secrets.BASE_RULES[2]) is True
    assert secrets.trigram_query(secrets.BASE_RULES[1]) == ("and", frozenset({b"aki", b"kia"}))
    query = secrets.trigram_query(secrets.BASE_RULES[0])
    assert query is not True and secrets.TrigramIndex([b"my API_KEY = x", b"apike", b"the Token"], secrets._trigrams(query)).candidates(query).tolist() == [0, 2]
    assert sum(secrets.trigram_query(r) is True for r in secrets.RULES) == 1  # hex alone


def test_scan_matches_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", "ab", "x" * 200_000 + " AKIA" + "Q" * 16]
    texts += ["".join(pieces(rng) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts += texts[-3:]
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i if i else None] == brute(t or "", secrets.RULES), t
    assert secrets.scan(df.limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, ""] + ["".join(pieces(rng) for _ in range(8)) for _ in range(50)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in secrets.op10_secret_scans(spark, str(tmp_path)).collect():
        want = brute(texts[r.doc_id] or "", secrets.BASE_RULES)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_redact(spark):
    text = "a password: abcdefgh12 and AKIA" + "A" * 16 + " é"
    df = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    out = df.join(secrets.scan(df), "doc_id").select("doc_id", secrets.redact(F.col("text"), F.col("spans")).alias("t"))
    got = {r.doc_id: r.t for r in out.collect()}
    assert got == {1: "a <assign> and <access> é", 2: "clean", 3: None}
    assert not re.search("AKIAA", got[1])
