import random

import public_tokenizers
import pytest
import tiktoken

from deckloom.llm.bpe import Codec, bpe_decode, bpe_encode, byte_chars, decode, model_bytes, read_ranks, tokens_of

from .docs import awkward, empty

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def data():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def plain(data):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(data), special_tokens={})


def test_byte_chars():
    chars = byte_chars()
    assert len(set(chars)) == 256 and chars[ord("A")] == "A" and chars[32] == "Ġ" and all(c.isprintable() for c in chars)


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        model_bytes({b"a": 1})


def test_like_tiktoken(data, plain):
    codec, tokens, rng = Codec(data, PATTERN), tokens_of(data), random.Random(5)
    pools = [range(32, 127), range(0xA0, 0x250), range(0x370, 0x500), range(0x4E00, 0x9FA5), range(0x1F600, 0x1F650), range(1, 33)]
    texts = ["", " ", "a" * 5000, "don't  you'll\n\n\tsee", "▁▁ Ġ <unk> <|endoftext|>", "\x00\x01", "ab" * 3000 + " "]
    texts += ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(1, 300))) for _ in range(400)]
    for t in texts:
        ids = codec.encode(t).tolist()
        assert ids == plain.encode_ordinary(t), t
        assert decode(ids, tokens) == t.encode()


def test_long_texts_piece_by_piece(data, plain, monkeypatch):
    import deckloom.llm.bpe as bpe

    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "STEP", 3)
    text = "some words and more words, 123 of them\n" * 7
    assert Codec(data, PATTERN).encode(text).tolist() == plain.encode_ordinary(text)


def test_tables(spark, plain):
    docs = awkward(spark)
    got = bpe_decode(bpe_encode(docs, PATH, PATTERN), PATH).collect()
    assert len(got) == docs.count()
    for r in got:
        assert list(r.ids) == plain.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r.name == "clash"
    again = bpe_encode(docs.withColumnRenamed("level", "ids"), PATH, PATTERN)
    assert again.columns.count("ids") == 1 and again.count() == docs.count()
    assert bpe_decode(bpe_encode(empty(spark), PATH, PATTERN), PATH).collect() == []


def test_one_worker_encodes_and_decodes(spark):
    import corpus_pipeline

    docs = awkward(spark)
    both = bpe_encode(docs.withColumnRenamed("level", "Decoded"), PATH, PATTERN, decoded_col="decoded")
    assert [c.lower() for c in both.columns].count("decoded") == 1
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both.collect())
    asked = docs.selectExpr("1L as doc_id", "text", "'en' as lang", "'s' as source")
    assert "ArrowEvalPython" not in corpus_pipeline.tokens(spark, asked, "")._jdf.queryExecution().toString()
