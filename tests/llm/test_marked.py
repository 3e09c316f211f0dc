import hashlib
import random

import numpy as np
import pytest

from loomgraph.llm import marked

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "▁", "a▁b", "▁a▁", "\x00a", "日本 龘 x", "\n\n a", "<s> hi</s>", "<0x41>", "   a    b  ", "�", "é", " x y",
    "word, word. word", "سلام‌ها دنیا", "🙂 🙂🙂", " " * 70 + "x", "ab" * 300, "x" * 5000 + " " + "é" * 3000, "the " * 4000, "a", "a",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def _encoded(spark, texts, **options):
    df = spark.createDataFrame([(k, t, "x", 1.0) for k, t in enumerate(texts)], "doc_id long, text string, ids string, block double")
    return {r.doc_id: r for r in marked.encode(df, MODEL, with_decoded=True, **options).collect()}


@pytest.mark.parametrize("block_bytes", [1, 300, 1 << 20])
def test_as_the_library(spark, library, block_bytes):
    got = _encoded(spark, TEXTS, block_bytes=block_bytes)
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        want = library.encode(t or "", add_bos=True, add_eos=True)
        assert got[k].ids == want, t
        assert got[k].decoded == library.decode(want), t


def test_random_texts_as_the_library(spark, library):
    rng = random.Random(5)
    alphabet = list("  ▁ab eéthing.,\n\t-ßñ日🙂") + ["tion", "the", "   "]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 120))) for _ in range(400)]
    got = _encoded(spark, texts, ends=False)
    assert all(got[k].ids == library.encode(t) and got[k].decoded == library.decode(library.encode(t)) for k, t in enumerate(texts))


def test_both_ways_to_merge_agree():
    model, rng = marked.load(MODEL), random.Random(6)
    for _ in range(300):
        word = "▁" * rng.randrange(1, 30) + "".join(rng.choices("etaoinsr", k=rng.randrange(0, 18)))
        assert model.merged(word) == model._merged_long(list(word)), word


def test_decode_any_ids_as_the_library(spark, library):
    rng = random.Random(7)
    lists = [[rng.choice([0, 1, 2, 259, 264, 28705, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(0, 12))] for _ in range(300)]
    lists += [None, [], [1], [2, 1], [1, 28705, 28705, 2], [233, 154], [0]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in marked.decode(df, MODEL).collect()}
    for k, x in enumerate(lists):
        assert got[k] == library.decode(x or []), x
    with pytest.raises(Exception, match="lacks"):
        marked.decode(spark.createDataFrame([(1, [99999])], "doc_id long, ids array<int>"), MODEL).collect()


def test_several_groups_of_blocks_agree(spark, monkeypatch):
    texts = [f"word{k % 7} thing{k % 3}, other" for k in range(60)]
    one = {k: r.ids for k, r in _encoded(spark, texts).items()}
    monkeypatch.setattr(marked, "FAN_BLOCKS", 1)
    monkeypatch.setattr(marked, "BLOCK_BYTES", 200)
    assert {k: r.ids for k, r in _encoded(spark, texts, block_bytes=200).items()} == one


def test_empty_table_and_other_models(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert marked.encode(empty, MODEL).collect() == []
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    frame = marked.op13_sentencepiece(spark, str(tmp_path))
    assert frame.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and frame.collect() == []
    raw = open(MODEL, "rb").read()
    (tmp_path / "other.model").write_bytes(raw.replace(b"\n\x08identity", b"\n\x08identitx\x12\x03abc") if b"\n\x08identity\x12" not in raw else raw[: raw.rindex(b"\n\x08identity")] + b"\n\x08identity\x12\x01x")
    with pytest.raises(Exception):  # noqa: B017
        marked.Model(str(tmp_path / "other.model"))


def test_query_as_the_library(spark, library):
    got = {r.doc_id: r for r in marked.op13_sentencepiece(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
