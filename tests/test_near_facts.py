"""Facts that share most of the smaller one's stems: the rule pair by pair, and how few pairs are looked at."""

import random

from deckloom.operators import content

WORDS = [f"{a}{b}{c}{a}{b}" for a in "bdfgk" for b in "aeiou" for c in "lmnrstvz"]


def _near(spark, rows):
    facts = spark.createDataFrame(rows, "pack string, id long, text string")
    return {(r.pack, r.id, r.other): r.share for r in content.near_facts(facts).collect()}


def test_few_pairs_are_looked_at(spark, monkeypatch):
    rng, tables = random.Random(1), {}
    sets = [rng.sample(WORDS, rng.choice((1, 2, 5, 20, 20, 20, 30))) for _ in range(150)]
    sets += [[*s[: max(1, len(s) * 6 // 10)], *rng.sample(WORDS, len(s) // 4)] for s in sets[:40]] + [[*reversed(s)] for s in sets[:10]]
    keep = lambda df, label, f=content.written: tables.setdefault(label, f(df, label))
    monkeypatch.setattr(content, "written", keep)
    got = _near(spark, [("a", k, " ".join(s)) for k, s in enumerate(sets)])
    stems = [frozenset(w[:5] for w in s) for s in sets]
    first = {s: k for k, s in reversed(list(enumerate(stems)))}
    want = {("a", first[s], k): 1.0 for k, s in enumerate(stems) if first[s] != k}
    for i in first.values():
        for j in first.values():
            share = len(stems[i] & stems[j]) / min(len(stems[i]), len(stems[j]))
            if i < j and share >= 0.6:
                want["a", i, j] = share
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    assert tables["fact-pairs"].count() < 2 * len(want)  # each pair that shared one of the rarest few was written before


def test_facts_without_a_pack(spark):
    assert _near(spark, [(None, 1, "winter schedule"), (None, 2, "schedule winter"), ("a", 3, "winter schedule"), (None, 4, "winter")]) == {(None, 1, 2): 1.0}


def _variants(rng, n):
    """Facts of 1 to 30 words, some a few words away from an earlier one, some said again."""
    rows = []
    for k in range(n):
        words = rng.choice(rows)[2].rstrip(".").lower().split() if rows and rng.random() < 0.5 else rng.sample(WORDS, rng.randrange(1, 30))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((rng.choice(("a", "a", "a", "b")), k, rng.choice(("{}", "{}.", " {}")).format(" ".join(words))))
    return rows


def _stems(row):
    return frozenset(w[:5] for w in row[2].strip().rstrip(".").split())


def _plain(rows):
    seen, first, want = set(), {}, {}
    for pack, k, t in rows:
        if (pack, t.strip().rstrip(".")) in seen:
            continue
        seen.add((pack, t.strip().rstrip(".")))
        s = _stems((pack, k, t))
        if (pack, s) in first:
            want[pack, first[pack, s], k] = 1.0
        else:
            first[pack, s] = k
    for (p, s), i in first.items():
        for (q, t), j in first.items():
            if p == q and i < j and len(s & t) / min(len(s), len(t)) >= 0.6:
                want[p, i, j] = round(len(s & t) / min(len(s), len(t)), 4)
    return want


def test_groups_of_a_large_pack_and_hashes_that_fall_together(spark, monkeypatch):
    rows = _variants(random.Random(3), 200)
    monkeypatch.setattr(content, "GROUP_FACTS", 16)
    real, shuffled = content.F.hash, {}
    monkeypatch.setattr(content.F, "hash", lambda w: real(w).bitwiseAND(63))  # most stems share their hash with others
    keep = lambda df, label, f=content.written: shuffled.setdefault(label, f(df, label))
    monkeypatch.setattr(content, "written", keep)
    facts = spark.createDataFrame(rows, "pack string, id long, text string")
    got = {(r.pack, r.id, r.other): r.share for r in content.near_facts(facts, once=True).collect()}
    want = _plain(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    assert shuffled["large-packs"].count() == 2
    assert shuffled["fact-pairs"].count() == sum(_stems(rows[i]) != _stems(rows[j]) for _, i, j in want)  # near pairs alone, each once


def test_hashes_of_63_bits(spark, monkeypatch):
    rows = _variants(random.Random(4), 60)
    real = content.F.hash
    monkeypatch.setattr(content, "CODES_APART", 3)
    monkeypatch.setattr(content.F, "hash", lambda w: real(w).bitwiseAND(63))
    facts = spark.createDataFrame(rows, "pack string, id long, text string")
    got = {(r.pack, r.id, r.other): r.share for r in content.near_facts(facts, once=True).collect()}
    want = _plain(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_normal_texts_are_normal_facts(spark):
    rng = random.Random(5)
    lines = ["short", "", "  a text of enough signs ", "A Text Of Enough Signs", *[f"line {k} of a document" for k in range(20)], "x" * 500]
    docs = [("s", k, [rng.choice(lines) for _ in range(rng.randrange(40))]) for k in range(8)]
    each = [(p, c, n, t, "plan", 1) for p, c, texts in docs for n, t in enumerate(texts)]
    want = content.normal_facts(spark.createDataFrame(each, "pack string, chunk long, n long, text string, kind string, weight int"))
    chunks = lambda rows: content.normal_texts(spark.createDataFrame(rows, "pack string, chunk long, texts array<string>"))
    assert {tuple(r) for r in chunks(docs).collect()} == {tuple(r) for r in want.select("pack", "chunk", "n", "text").collect()}
    twice = chunks([(p, c // 2, texts) for p, c, texts in docs])  # each chunk comes in two rows
    assert max(r["count"] for r in twice.groupBy("pack", "chunk").count().collect()) <= 12
    assert twice.selectExpr("pack", "chunk", "lower(text)").distinct().count() == twice.count()


def test_facts_are_dealt_out_once(spark, monkeypatch):
    rng, found = random.Random(6), []
    rows = [("a", k, " ".join(rng.sample(WORDS, 25))) for k in range(40)]

    def keep(df, label, f=content.written):
        if label == "fact-pairs":
            plan = df._jdf.queryExecution().executedPlan().toString()
            found.append((plan.count("- Exchange "), plan.count("- ReusedExchange ")))
        return f(df, label)

    monkeypatch.setattr(content, "written", keep)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        content.near_facts(spark.createDataFrame(rows, "pack string, id long, text string"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found == [(1, 2 * content.GROUP_PASSES - 1)]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
