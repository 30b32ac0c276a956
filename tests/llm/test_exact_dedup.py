import hashlib
import re

from deckloom.llm.exact_dedup import exact_dedup

from .docs import awkward, empty


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[ \t-\r]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, own in groups.items():
        best = min(own)
        out += [(i, best[3], len(own), hashlib.sha256(norm.encode()).hexdigest()) for _, _, _, i in own]
    return sorted(out, key=str)


def test_like_brute_force(spark):
    docs = awkward(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    for size in (3, 4096):
        got = exact_dedup(docs, block_bytes=size).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
        assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_blocks_in_another_order_are_other_texts(spark):
    docs = spark.createDataFrame([(1, "aaabbb"), (2, "bbbaaa"), (3, "aaabbbaaa"), (4, "aaabbb")], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in exact_dedup(docs, block_bytes=3).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


def test_empty_table(spark):
    assert exact_dedup(empty(spark)).collect() == []


def test_names_are_ranks(spark):
    docs = awkward(spark)
    want = None
    for parts in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = exact_dedup(docs.repartition(int(parts)), block_bytes=16).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        names = sorted((r.text_sha256, r.level, r.name) for r in got)
        assert want is None or names == want
        want = names
    level = [r.name for r in got if not r.level]
    assert min(level) >= 0 and max(level) < len(docs.collect()) * 6000
    short = exact_dedup(spark.createDataFrame([(i, t) for i, t in enumerate("dacbe")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.name) for r in short) == [(0, 3), (1, 0), (2, 2), (3, 1), (4, 4)]
