import hashlib
import random

from deckloom.llm.line_dedup import line_dedup

from .docs import awkward, empty

SPACE = " \t\n\x0b\x0c\r"


def brute(rows, min_sites):
    where = {}
    for i, t, s in rows:
        own = sorted({hashlib.md5(x.strip(SPACE).encode()).digest() for x in (t or "").split("\n") if x.strip(SPACE)})
        for k in own:
            rest = [x for x in own if x != k]
            where.setdefault(k, []).append((s or "", rest[0] if rest else b""))
    bad = {k for k, v in where.items() if len({s for s, _ in v}) >= min_sites and 2 * len({o for _, o in v}) >= len(v)}
    out = []
    for i, t, s in rows:
        lines = [] if t is None else t.split("\n")
        stay = [x for x in lines if hashlib.md5(x.strip(SPACE).encode()).digest() not in bad]
        out.append((i, None if t is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def sample(spark):
    rng = random.Random(11)
    extra = []
    for k in range(120):
        lines = [f"own {k} {j} {rng.random()}" for j in range(rng.randrange(1, 6))]
        for b, p in (("Menu", 0.5), (" All rights reserved. ", 0.3), ("rare", 0.05), ("", 0.2), ("é footer", 0.15)):
            if rng.random() < p:
                lines.insert(rng.randrange(len(lines) + 1), b)
        extra.append((100 + k, "\n".join(lines), "en", f"site{rng.randrange(15)}"))
    extra += [(400 + k, "a whole copy\non many sites\nwith three lines", "en", f"site{k}") for k in range(15)]
    return awkward(spark, extra)


def test_like_brute_force_on_both_ways(spark):
    docs = sample(spark)
    for min_sites in (1, 3, 10):
        want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], min_sites)
        for sent in (1 << 20, 0):
            got = line_dedup(docs, min_sites=min_sites, sent_lines=sent)
            assert got.columns == [*docs.columns, "n_lines", "n_removed"]
            assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == want


def test_copies_keep_their_lines(spark):
    got = {r.doc_id: r.n_removed for r in line_dedup(sample(spark)).collect()}
    assert all(got[400 + k] == 0 for k in range(15)) and sum(got.values()) > 60


def test_empty_table(spark):
    assert line_dedup(empty(spark)).collect() == []
