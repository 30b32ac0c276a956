import random
import re

import numpy as np

import deckloom.llm.decontaminate as module
from deckloom.llm.decontaminate import contamination, decontaminate

from .docs import awkward, empty

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    out = []
    for i, text in docs:
        own, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            m = min(13, len(p))
            wins = {tuple(p[k : k + m]) for k in range(len(p) - m + 1)} if p else set()
            for k in range(len(own) - m + 1 if p else 0):
                if tuple(own[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    found.add(str(item) if item is not None else "")
        out.append((i, len(own), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(own)))
    return sorted(out, key=str)


def sample(spark):
    rng = random.Random(7)
    vocabulary = ["a", "B", "the", "é", "ß9", "x1", "of"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(some(rng.choice([1, 2, 3, 5, 12, 13, 14, 30, 60])))) for k in range(30)]
    items += [(100, items[0][1]), (100, items[0][1]), (101, None), (102, ""), (103, "... !"), (None, "the of the of of x1 x1 B"), (104, "a " * 40)]
    docs = []
    for k in range(60):
        text = some(rng.randrange(200))
        if k % 2:
            p = words(rng.choice(items)[1])
            at = rng.randrange(len(text) + 1)
            text[at:at] = p[: rng.randrange(len(p) + 1)] if k % 4 == 1 else p
        docs.append((1000 + k, rng.choice([" ", "-", "\n"]).join(text), "en", "s"))
    return awkward(spark, docs), items


def test_like_brute_force(spark, monkeypatch):
    docs, items = sample(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], items)
    for size in (1 << 20, 250):  # one shard, and many
        monkeypatch.setattr(module, "SHARD_BYTES", size)
        got = contamination(docs, bench, ["doc_id"]).collect()
        assert sorted(((r.doc.c0, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=str) == want


def test_the_filter_loses_no_window():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abc") for _ in range(2)).encode()
    for _ in range(300):
        item = [word() for _ in range(rng.choice([1, 3, 7, 8, 9, 12, 13, 14, 40]))]
        m = min(13, len(item))
        at = rng.randrange(len(item) - m + 1)
        text = [word() for _ in range(rng.randrange(30))] + item[at : at + m] + [word() for _ in range(rng.randrange(30))]
        bits = np.zeros(1 << 10, np.uint64)
        for place in module.Filter.places(module.passage_keys(item, 13), 16):
            for p in place.tolist():
                bits[p >> 6] |= np.uint64(1 << (p & 63))
        assert module.Filter(bits, [min(8, m)]).may_hold(text)
        assert not module.Filter(bits * 0, [min(8, m)]).may_hold(text)


def test_many_shards_read_only_what_the_filter_leaves(spark, monkeypatch):
    """Fifty shards: the texts that hold no passage meet none of them."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(40))) for k in range(100)]
    docs = [(k, " ".join([word() for _ in range(100)] + (items[k % 100][1].split()[10:30] if k % 20 == 0 else []))) for k in range(400)]
    written, kept = module.written, {}
    monkeypatch.setattr(module, "written", lambda df, label: kept.setdefault(f"{label}{len(kept)}", written(df, label)))
    monkeypatch.setattr(module, "SHARD_BYTES", sum(len(t) for _, t in items) // 50)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, ["doc_id"]).collect()
    assert sorted(((r.doc.c0, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=str) == brute(docs, items)
    assert sum(k.startswith("passage-hits") for k in kept) >= 50
    assert [t.count() for k, t in kept.items() if k.startswith("passage-candidates")] == [20]


def test_long_passages_amid_other_text(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(50))) for k in range(5)]
    docs = [(k, " ".join([word() for _ in range(rng.randrange(300))] + words(items[k % 5][1])[k % 20 : 40] + [word() for _ in range(100)])) for k in range(40)]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    assert sorted(((r.doc.c0, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got), key=str) == brute(docs, items)


def test_filter_and_empty_tables(spark):
    docs, items = sample(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = decontaminate(docs, bench)
    assert left.schema == docs.schema
    assert left.count() == sum(not r[4] for r in brute([(r.doc_id, r.text) for r in docs.collect()], items))
    assert decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate(empty(spark), bench).collect() == []
