import math
import random

import numpy as np

from deckloom.llm.quality import CLASSES, DIMS, VOTERS, features, fit_votes, keep_good, measures, quality_classifier, votes

from .docs import awkward, empty

WORDS = "the of and house river garden stone walking letter under morning people country number small water against".split()
WORDS = WORDS * 8 + [a + b for a in WORDS[4:] for b in WORDS[4:]]


def sample(rng, n=400):
    rows = []
    for k in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "", "", "", ".", ","]) for _ in range(rng.randrange(40, 300))]
        bad = k % 5 == 0
        if bad:
            kind = k // 5 % 4
            words = [[w.upper() + "!!" for w in words], [w + rng.choice(["###", "&&&", "$$$"]) for w in words], [w for w in words[:9] for _ in range(20)], [w + " |" for w in words]][kind]
        rows.append((1000 + k, " ".join(words), "en", "s", not bad))
    return rows


def test_votes_of_a_short_text():
    assert votes(measures(b"")) == votes(measures(b"one two")) == (3 ** len(VOTERS) - 1) // 2


def test_label_model_finds_the_classes():
    rng = np.random.default_rng(0)
    truth = rng.random(5000) < 0.8
    v = np.where(rng.random((5000, len(VOTERS))) < 0.3, 1, np.where(rng.random((5000, len(VOTERS))) < 0.85, 2 * truth[:, None], 2 - 2 * truth[:, None]))
    codes, back, counts = np.unique(v @ 3 ** np.arange(len(VOTERS) - 1, -1, -1), return_inverse=True, return_counts=True)
    post, table = fit_votes(codes, counts.astype(float))
    assert ((post[back] > 0.5) == truth).mean() > 0.97
    assert np.allclose(table.sum(2), 1) and (table[:, 1, 2] > table[:, 0, 2]).all()


def test_junk_goes_and_good_texts_stay(spark):
    rows = sample(random.Random(1))
    docs = awkward(spark, [r[:4] for r in rows])
    got = quality_classifier(docs)
    assert got.count() == docs.count()
    found = {r.doc_id: r for r in got.collect()}
    wrong = [i for i, *_, good in rows if found[i].good != good]
    assert len(wrong) <= 4 and not [i for i in wrong if dict((r[0], r[4]) for r in rows)[i]]
    assert all(0 <= r.score <= 1 for r in found.values()) and found[1].good and found[2].good
    kept = keep_good(docs)
    assert kept.schema == docs.schema and kept.count() == got.where("good").count()


def test_small_bound_and_empty_table(spark):
    docs = spark.createDataFrame([r[:2] for r in sample(random.Random(2))], "doc_id long, text string")
    got = quality_classifier(docs, train_rows=150)
    assert got.count() == 400
    assert quality_classifier(empty(spark)).collect() == []


def test_votes_like_plain_expectation_maximisation():
    rng = random.Random(3)
    k = len(VOTERS)
    rows = [[rng.choice([0, 1, 2, 2] if j % 2 else [0, 0, 1, 2]) for _ in range(k)] for j in range(200)]
    patterns = {}
    for r in rows:
        patterns[tuple(r)] = patterns.get(tuple(r), 0) + 1
    post = {}
    for v in patterns:
        bad, good = v.count(0), v.count(2)
        post[v] = 0.1 / bad if bad else 0.95 if good else 0.5
    for _ in range(100):
        weight = [{v: n * (1 - post[v]) for v, n in patterns.items()}, {v: n * post[v] for v, n in patterns.items()}]
        table = [[[0.5 + sum(w for v, w in weight[c].items() if v[j] == x) for x in range(3)] for c in (0, 1)] for j in range(k)]
        prior = [(sum(w.values()) + 1) / (len(rows) + 2) for w in weight]
        new = {}
        for v in patterns:
            like = [prior[c] * math.prod(table[j][c][v[j]] / sum(table[j][c]) for j in range(k)) for c in (0, 1)]
            new[v] = like[1] / sum(like)
        done = max(abs(new[v] - post[v]) for v in patterns) < 1e-6
        post = new
        if done:
            break
    codes = [sum(x * 3 ** (k - 1 - j) for j, x in enumerate(v)) for v in patterns]
    got, _ = fit_votes(np.array(codes), np.array(list(patterns.values()), float))
    assert np.abs(got - np.array(list(post.values()))).max() < 1e-6


def test_features_like_plain_counts():
    text = ("The house, by the river! 12 of 9 — é" * 3).encode()
    values = measures(text)
    want = np.zeros(DIMS)
    kinds = [CLASSES[b] for b in text]
    for i in range(len(kinds) - 3):
        code = kinds[i] * 4096 + kinds[i + 1] * 256 + kinds[i + 2] * 16 + kinds[i + 3]
        want[(code * 2654435761 % (1 << 32)) >> 20] += 1
    want = np.sqrt(want / want.sum())
    for k, x in enumerate(values):
        if x == x:
            want[((k * 64 + min(int(x * 20), 63)) * 2654435761 % (1 << 32)) >> 20] += 0.5
    assert np.abs(features(text, values) - want).max() < 1e-6
