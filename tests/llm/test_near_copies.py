import random

from corpus_pipeline import near_copies
from deckloom.llm.near_copies import near_copy_groups

from .docs import awkward, empty


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                root[find(i)] = find(j)
    best = {}
    for k, (i, t) in enumerate(rows):
        best.setdefault(find(k), []).append((i is None, i or 0, t or ""))
    return sorted(min(x)[:2] for x in best.values())


def test_like_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    extra = []
    for g in range(40):  # variants of a text on both sides of the threshold, and a chain of them
        base = [rng.choice(words) for _ in range(rng.randrange(60, 400))]
        for k in range(5):
            other = list(base)
            for at in rng.sample(range(len(base)), rng.randrange(1, 1 + len(base) // 30)):
                other[at] = rng.choice(words)
            extra.append((1000 + g * 10 + k, " ".join(other), "en", "s"))
            base = other if g % 2 else base
    docs = awkward(spark, extra)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = near_copies(spark, docs, "")
    assert left.schema == docs.schema
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect())
    assert got == plain_kept(rows) and len(got) < len(rows) - 50


def test_split_clusters_lose_nothing(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(words) for _ in range(120)]
    for k in range(60):  # a chain whose ends are no near copies
        base = list(base)
        base[rng.randrange(120)] = f"new{k}"
        rows.append((k, " ".join(base)))
    table = spark.createDataFrame(rows, "row long, text string")
    for most in (1 << 14, 7):
        groups = {}
        for r in near_copy_groups(table, part_rows=most).collect():
            groups.setdefault(r.group, []).append(r.row)
        assert sorted((False, min(g)) for g in groups.values()) == plain_kept(rows)


def test_near_copies_beyond_two_bits_go(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    docs = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :]), "en", "s") for i, k in enumerate(range(10, 190, 20), 100)]
    left = near_copies(spark, awkward(spark, docs), "").collect()
    assert [r.doc_id for r in left if (r.doc_id or 0) >= 100] == [100]


def test_rows_are_told_by_themselves(spark):
    docs = awkward(spark, [(None, "one of two texts", "en", "s"), (None, "the other of both", "en", "s"), (30, "m n o p q", "en", "s"), (30, "quite another text under this id", "en", "s"), (29, "m n o p q", "en", "s")])
    left = [(r.doc_id, r.text) for r in near_copies(spark, docs, "").collect()]
    assert sum(i is None for i, _ in left) == 3 and (29, "m n o p q") in left and [t for i, t in left if i == 30] == ["quite another text under this id"]
    assert near_copies(spark, empty(spark), "").collect() == []
