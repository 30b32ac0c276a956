import random

import numpy as np
import xxhash

from deckloom.llm.simhash import fingerprint, fingerprint_links, links_within, near_dedup, simhash_components

from .docs import awkward, empty


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs):
    root = {f: f for _, f in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for i, f in pairs:
        low[find(f)] = min(i, low.get(find(f), i))
    return {(i, f"{f:016x}", low[find(f)]) for i, f in pairs}


def test_fingerprint():
    for t in ("", "One", "one two", "one two three", "one two three four  five\x0bsix", "é É a A " * 50):
        assert fingerprint(t.encode()) == plain_fingerprint(t)


def test_links_like_all_pairs():
    rng = random.Random(1)
    groups = []
    for size in (1, 2, 63, 64, 65, 300):
        seed = rng.getrandbits(64)
        groups.append([seed ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for _ in range(size)])
    fps, sizes = np.array(sum(groups, []), np.uint64), np.array([len(g) for g in groups])
    for radius in (0, 1, 2, 3, 5):
        want, at = set(), 0
        for g in groups:
            want |= {(at + i, at + j) for i in range(len(g)) for j in range(i + 1, len(g)) if (g[i] ^ g[j]).bit_count() <= radius}
            at += len(g)
        got = [(a, b) for x, y in links_within(fps, sizes, radius, chunk=97) for a, b in zip(x.tolist(), y.tolist())]
        assert set(got) == want and len(got) == len(want)


def test_hot_buckets_lose_nothing(spark):
    rng = random.Random(2)
    seed = rng.getrandbits(64)
    values = sorted({seed ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)})
    want = {i: c for i, _, c in plain_components(list(enumerate(values)))}
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for hot in (4096, 20):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in fingerprint_links(fps, hot_bucket=hot).collect():
            root[find(r.u % (1 << 64))] = find(r.v % (1 << 64))
        parts = {}
        for i, v in enumerate(values):
            parts.setdefault(find(v), set()).add(i)
        assert all(len({want[i] for i in p}) == 1 for p in parts.values()) and len(parts) == len(set(want.values()))


def test_like_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    extra = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(400)]
        for k in range(5):
            base = list(base)
            base[rng.randrange(400)] = rng.choice(words)
            extra.append((100 + g * 10 + k, " ".join(base), "en", "s"))
    docs = awkward(spark, [*extra, (None, "a  b C", "en", "s"), (None, "quite alone without an id", "en", "s")])
    rows = docs.collect()
    far = 1 << 40  # stands for null, which counts for nothing
    want = plain_components([(far if r.doc_id is None else r.doc_id, plain_fingerprint(r.text or "")) for r in rows])
    got = simhash_components(docs).collect()
    name = lambda i: far if i is None else i
    assert {(name(r.doc_id), r.fingerprint, name(r.component_id)) for r in got} == want and len(got) == len(rows)


def test_empty_table(spark):
    assert simhash_components(empty(spark)).collect() == []


def test_one_row_of_each_component_stays(spark):
    docs = awkward(spark, [(20, "p q r s", "en", "s"), (20, "p q r s", "en", "s"), (21, "p q r s", "en", "s"), (22, "one text", "en", "s"), (22, "another text of this id", "en", "s"), (None, "text without an id", "en", "s")])
    docs = docs.withColumn("__stay", docs.level).withColumn("row", docs.k1)
    rows = [(r.doc_id, r.text, plain_fingerprint(r.text or "")) for r in docs.collect()]
    groups = {}
    for (_, _, c), (i, _, f) in zip(sorted_components(rows), rows):
        groups.setdefault(c, []).append((i is None, i or 0))
    left = near_dedup(docs)
    assert left.schema == docs.schema
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted(min(g) for g in groups.values())
    assert near_dedup(empty(spark)).collect() == []


def sorted_components(rows):
    """(place, fingerprint, component) in the order of the rows, components named by places."""
    return sorted((i, f, c) for i, f, c in plain_components([(k, f) for k, (_, _, f) in enumerate(rows)]))
