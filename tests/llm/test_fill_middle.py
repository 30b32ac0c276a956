import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from deckloom.llm.fill_middle import fill_middle, restore, units

from .docs import awkward, empty


def plain(doc_id, text):
    """One text, as the rule says."""
    t = text or ""
    found = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    n, digest = len(found), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (found[:a], found[a:b], found[b:]))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", t, None, None
    out = f"<S>{suf}<P>{pre}<M>{mid}" if h[3] % 100 < 20 else f"<P>{pre}<S>{suf}<M>{mid}"
    return n, "spm" if h[3] % 100 < 20 else "psm", out, len(pre), len(mid)


def made_up():
    rng = random.Random(11)
    parts = ["word", "Zz", " ", "\n", "é", "𝟘", "中", "\x00", "ÿ", "1", "<", ">", "<P", "P>", "S>", "<<", "<S", "M>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    return [(100 + i, t, "en", "s") for i, t in enumerate([*texts, "a<P>b", "<S>", "x<M>", "a" * 100000, "é " * 50000])]


def test_like_plain(spark):
    docs = awkward(spark, made_up())
    found = fill_middle(docs).withColumn("back", restore(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(found) == docs.count() and {r.fim.form for r in found} == {"plain", "psm", "spm"}
    for r in found:
        assert tuple(r.fim) == plain(r.doc_id, r.text), r.doc_id
        assert r.back == (r.text or "") and r.name == "clash"


def test_small_pieces(spark, monkeypatch):
    """Batches that are cut into pieces of a few bytes give the same."""
    import deckloom.llm.common as common

    monkeypatch.setattr(common, "PIECE_BYTES", 16)
    texts = pa.array([t.encode() for _, t, _, _ in made_up()[:60]], pa.binary())
    whole = units(texts).to_pylist()
    assert [x for at, rows in common.pieces(texts) for x in units(texts.slice(at, rows)).to_pylist()] == whole
    assert whole == [[u.encode() for u in re.findall("[A-Za-z]+|[^A-Za-z]", t.decode())] for t in texts.to_pylist()]


def test_tables(spark):
    assert fill_middle(empty(spark)).collect() == []
    again = fill_middle(awkward(spark).withColumnRenamed("name", "fim"))
    assert again.columns.count("fim") == 1 and again.count() == awkward(spark).count()
    other = fill_middle(awkward(spark, made_up()), seed="2:")
    assert other.filter("fim.form <> 'plain'").count() > 0
    one = spark.createDataFrame([(None, None)], "a string, b string").select(restore(F.col("a"), F.col("b")).alias("t")).collect()
    assert one[0].t == ""
