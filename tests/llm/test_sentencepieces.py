import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from deckloom.llm.bpe import _field
from deckloom.llm.sentencepieces import NORMALIZER, CharMap, Codec, fields, sentencepiece_decode, sentencepiece_encode

from .docs import awkward, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def data():
    with open(PATH, "rb") as f:
        return f.read()


def with_normaliser(data: bytes, spec: bytes) -> bytes:
    """The model with another normaliser."""
    kept = [(n, v if k != 5 else v) for n, k, v in fields(data) if n != NORMALIZER]
    return b"".join(_field(n, v) for n, v in kept) + _field(NORMALIZER, spec)


def spec(rule: str, dummy: int, squeeze: int, escape: int = 1) -> bytes:
    """A normaliser with the character map that the library compiles for a rule."""
    found = next(v for n, _, v in fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if n == NORMALIZER)
    chars = {n: v for n, _, v in fields(found)}[2]
    return _field(1, rule.encode()) + _field(2, chars) + _field(3, dummy) + _field(4, squeeze) + _field(5, escape)


def texts() -> list[str]:
    rng = random.Random(3)
    pools = [range(32, 127), range(0xA0, 0x250), range(0x300, 0x345), range(0x370, 0x500), range(0x2000, 0x2070), range(0x3000, 0x30FF), range(0xAC00, 0xAD00), range(0xFB00, 0xFB10), range(0xFF00, 0xFFEF), range(0x1F600, 0x1F650), range(1, 33)]
    made = ["", " ", "   ", "\n", "a", "▁", " ▁ a▁", "a" * 5000, "  two  spaces  inside  ", "Héllo x𝟘\n", "ﬁne ﬂow ½ ① Ａ", "̈́x", "가각", "\x00\x01", "<s> </s> <0x0A>", "tab\tend \t", "a　b c​d"]
    return made + ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(1, 120))) for _ in range(300)]


def like_library(model: bytes) -> None:
    codec, library = Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for t in texts():
        ids, begins, ends = codec.encode(t.encode(), end=False)
        want = library.encode(t, return_type="proto").pieces if t else []
        assert ids.tolist() == [p.id for p in want] == library.encode(t), repr(t)
        assert list(zip(begins.tolist(), ends.tolist())) == [(p.begin, p.end) for p in want], repr(t)


def test_like_library(data):
    assert Codec(data).cuts
    like_library(data)


@pytest.mark.parametrize(("dummy", "squeeze", "escape"), [(1, 1, 1), (0, 1, 1), (1, 0, 1), (0, 0, 1), (0, 0, 0)])
@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_maps_like_library(data, rule, dummy, squeeze, escape):
    like_library(with_normaliser(data, spec(rule, dummy, squeeze, escape)))


def test_longest_prefix(data):
    chars = CharMap({n: v for n, _, v in fields(spec("nfkc", 1, 1))}[2])
    assert chars.longest("\ufb01x".encode(), 0) == (3, b"fi")
    assert chars.longest("e\u0301".encode(), 0) == (3, "\u00e9".encode()), "a letter and its accent are longer than the letter"
    assert chars.longest(b"!", 0) == (0, b"") and CharMap(b"").begins == b""


def test_spans_hold_the_text(data):
    """Pieces' spans follow one another and cover the whole text, in bytes."""
    codec = Codec(data)
    for t in texts():
        raw = t.encode()
        ids, begins, ends = codec.encode(raw, end=True)
        assert ids[-1] == codec.library.eos_id() and begins[-1] == ends[-1] == len(raw)
        assert b"".join(raw[a:b] for a, b in zip(begins, ends)) == raw
        assert np.all(begins[1:] == ends[:-1])


def test_long_texts_in_parts(data, monkeypatch):
    import deckloom.llm.sentencepieces as own

    monkeypatch.setattr(own, "STEP", 7)
    codec, library = Codec(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert list(codec.parts("▁some▁words▁▁and▁more")) == ["▁some▁words", "▁▁and▁more"]
    for t in ["some words and  more words, 123 of them\n" * 7, " " * 50, "a" * 50, *texts()[:60]]:
        assert codec.encode(t.encode(), False)[0].tolist() == library.encode(t)


def test_tables(spark, data):
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    docs = awkward(spark, [(20, "naïve ﬁ 𝟘 \n\n x", "en", "s9"), (21, "word " * 200000, "en", "s9")])
    got = sentencepiece_decode(sentencepiece_encode(docs, PATH), PATH).collect()
    assert len(got) == docs.count()
    for r in got:
        want = library.encode(r.text or "") + [library.eos_id()]
        assert list(r.ids) == want and r.decoded == library.decode(want) and r.name == "clash"
        assert len(r.begins) == len(r.ends) == len(want)
    again = sentencepiece_encode(docs.withColumnRenamed("level", "ids").withColumnRenamed("name", "Ends"), PATH, end=False)
    assert [c.lower() for c in again.columns].count("ids") == 1 and again.count() == docs.count()
    assert sentencepiece_decode(again.withColumn("decoded", F.lit(1)), PATH).columns.count("decoded") == 1
    assert sentencepiece_decode(sentencepiece_encode(empty(spark), PATH), PATH).collect() == []
    none = sentencepiece_encode(docs, PATH).select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert {r.decoded for r in sentencepiece_decode(none, PATH).collect()} == {""}
