import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from loomgraph.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(5)
    alphabet = [*"aaabcdefghij éüßñ", " ", "  ", "\n", "\n\n", "\t", " \n ", "'s", "'ll", "1", "234", "²", "!", "...", "€", "漢字", "𝔘", "\xa0", "\u3000", "\u2003", "\u200b", "\x1c", "\x85", "á", "<|endoftext|>", "der ", "tion "]
    out = ["", " ", "  ", "\n", "a", "aaaaaaaaaaaaaaaa", "hello  world ", " x" * 50, "a" * 3000]
    return out + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(1500)]


def encoded(spark, rows, block_bytes=bpe.BLOCK_BYTES, pattern=P.PATTERN):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3, "doc_id")
    return {r.doc_id: r.ids for r in bpe.encode(df, PATH, pattern, block_bytes=block_bytes).collect()}


def test_same_ids_as_the_library(spark, oracle):
    got = encoded(spark, texts())
    for i, text in enumerate(texts()):
        assert got[i] == oracle.encode_ordinary(text), repr(text)


def test_block_size_changes_nothing(spark, oracle):
    rows = [*texts()[:200], *texts()[:20]]
    for size in (1, 300):
        assert encoded(spark, rows, size) == {i: oracle.encode_ordinary(t) for i, t in enumerate(rows)}


def test_other_pattern(spark):
    pattern = r"\p{L}+|[^\p{L}]"
    oracle = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    assert encoded(spark, texts()[:200], pattern=pattern) == {i: oracle.encode_ordinary(t) for i, t in enumerate(texts()[:200])}


def cut(rows, pattern=P.PATTERN):
    data, lengths, counts = bpe.cut_pieces([t.encode() for t in rows], pattern)
    ends = [0, *lengths.cumsum().tolist()]
    pieces = [data.tobytes()[a:b].decode() for a, b in zip(ends, ends[1:])]
    ends = [0, *counts.cumsum().tolist()]
    return [pieces[a:b] for a, b in zip(ends, ends[1:])]


def test_pieces_are_those_of_the_pattern():
    rng = random.Random(3)
    alphabet = "ab'stmdrevl  \n\t1.\xe9\u6f22\u3000\x1c\xb2'"
    rows = texts() + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    rows.append("".join(chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000))
    assert cut(rows) == [regex.findall(P.PATTERN, t) for t in rows]
    assert cut([]) == [] and cut(["", ""]) == [[], []]


def test_hashes_that_agree_in_one_half_are_told_apart():
    one, two = np.array([5, 5, 3, 5], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    at, number = bpe.distinct(one, two)
    assert len(at) == 3 and number[0] == number[3] and len(set(number.tolist())) == 3


def test_replay_with_a_pair_of_lower_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"abc": 260, b"bc": 310, b"ca": 305, b"aba": 299}
    oracle = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))).encode() for _ in range(500)]
    counts, ids = bpe.replay(pieces, bpe.Merges(ranks))
    ends = [0, *counts.cumsum().tolist()]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [oracle.encode_ordinary(p.decode()) for p in pieces]


def test_query(spark, tmp_path, oracle):
    rows = [(i, t) for i, t in enumerate([None, *texts()[:200], "x y " * 50_000])]
    spark.createDataFrame([(i, t, 1) for i, t in [*rows, rows[5]]], "doc_id long, text string, ids int").write.parquet(f"{tmp_path}/documents.parquet")
    got = bpe.op4_bpe(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        text = rows[r.doc_id][1] or ""
        ids = oracle.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty, PATH, P.PATTERN, with_decoded=True).count() == 0


def test_decode_alone(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts()[:300])], "doc_id long, text string")
    ids = bpe.encode(df, PATH, P.PATTERN)
    assert {r.doc_id: r.decoded.decode() for r in bpe.decode(ids, PATH).collect()} == dict(enumerate(texts()[:300]))
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).collect()[0].decoded == b""
    with pytest.raises(Exception, match="ranks lack"):
        bpe.decode(spark.createDataFrame([(1, [10_000_000])], "doc_id long, ids array<int>"), PATH).collect()
