import math
import random
import zlib

import numpy as np

from deckloom.llm.toxicity import DOUBT, keep_civil, label_model, start, toxicity

from .docs import awkward, empty

CALM = [f"word{i}" for i in range(200)]
ENDS = ["", "ly", "ness", "ish", "er"]
RUDE = ["blorgh", "snivet", "krantz", "idiot"]


def sample(rng, n=1500):
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(CALM) for _ in range(rng.randrange(20, 400))]
        toxic = k % 8 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE) + rng.choice(ENDS))
        docs.append((1000 + k, " ".join(words), "en", "s"))
        labels.append((1000 + k, int(toxic) if k % 11 else None, 1))
    return docs, labels


def brute_label_model(votes, post, prior, rounds=50):
    """The same model, a row and a voter at a time."""
    n, k = len(votes), len(votes[0])
    share = [1.0] * k
    for step in range(rounds):
        weight = [[1 - p for p in post], list(post)]
        rate = [[(sum(w for w, v in zip(weight[c], votes) if v[j]) + 0.5) / (sum(weight[c]) + 1) for j in range(k)] for c in (0, 1)]
        rate[0][0], rate[1][0] = max(rate[0][0], DOUBT), min(rate[1][0], 1 - DOUBT)
        if step % 5 == 4:
            share = [1.0] * k
            for a in range(2, k):
                for b in range(2, k):
                    if a != b:
                        inside = 0.0
                        for c in (0, 1):
                            total = sum(weight[c])
                            cov = lambda x, y: sum(w * (v[x] - rate[c][x]) * (v[y] - rate[c][y]) for w, v in zip(weight[c], votes)) / total  # noqa: E731, B023
                            inside += total / n * min(1.0, max(0.0, cov(a, b) / math.sqrt(max(cov(a, a), 1e-9) * max(cov(b, b), 1e-9))))
                        share[a] += inside if inside > 0.1 else 0
        new = []
        for v in votes:
            z = math.log(prior / (1 - prior))
            for j in range(k):
                if v[j]:
                    z += math.log(rate[1][j] / rate[0][j]) / share[j]
                elif j < 2:
                    z += math.log((1 - rate[1][j]) / (1 - rate[0][j])) / share[j]
            new.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        done = step > 4 and max(abs(a - b) for a, b in zip(new, post)) < 1e-6
        post = new
        if done:
            break
    return post


def voters(rng, y):
    """Votes of four independent voters of toxic rows, a repeated one among them, with the count of those that speak."""
    one = (rng.random(len(y)) < 0.6) & (y == 1) | (rng.random(len(y)) < 0.004)
    rest = [(rng.random(len(y)) < 0.6) & (y == 1) | (rng.random(len(y)) < 0.004) for _ in range(4)]
    own = np.column_stack([one, one, one, *rest])
    return np.column_stack([own[:, [0, 3, 4, 5, 6]].sum(1) > 1, own]).astype(np.uint8)


def test_label_model_like_brute_force():
    rng = np.random.default_rng(1)
    y = (rng.random(120) < 0.25).astype(float)
    v = np.column_stack([y, voters(rng, y)]).astype(np.uint8)
    got, _, _ = label_model(v, start(y), 0.25)
    assert np.abs(got - brute_label_model(v.tolist(), start(y).tolist(), 0.25)).max() < 1e-6


def test_label_model_overrules_wrong_labels():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.15).astype(float)
    wrong = rng.random(4000) < 0.1
    given = np.where(wrong, 1 - y, y)
    post, rate, share = label_model(np.column_stack([given, voters(rng, y)]), start(given), given.mean())
    assert ((post > 0.5) == y)[wrong].mean() > 0.9 and ((post > 0.5) == y).mean() > 0.97
    assert share[2] > 2.5 and share[5] < 1.5 and (rate[1] > rate[0]).all()  # the voter that is there three times, and another


def test_wrong_labels_of_documents(spark):
    docs, labels = sample(random.Random(6))
    rng = random.Random(7)
    noisy = [(i, t if t is None or rng.random() > 0.1 else 1 - t, x) for i, t, x in labels]
    assert sum(a != b for a, b in zip(labels, noisy)) > 100
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.predicted for r in toxicity(table, spark.createDataFrame(noisy, "doc_id long, toxic int, text int")).collect()}
    truth = {i: int(k % 8 == 0) for k, (i, *_) in enumerate(docs)}
    assert sum(got[i] == truth[i] for i in truth) >= 0.98 * len(truth)
    flipped = [i for (i, a, _), (_, b, _) in zip(labels, noisy) if a != b]
    assert sum(got[i] == truth[i] for i in flipped) >= 0.9 * len(flipped)


def test_held_out_documents(spark):
    docs, labels = sample(random.Random(3))
    table = awkward(spark, docs)
    known = spark.createDataFrame(labels + [(1, 0, 1), (1, 1, 1)], "doc_id long, toxic int, text int")
    got = toxicity(table, known).collect()
    assert len(got) == table.count()
    truth = {i: k % 8 == 0 for k, (i, *_) in enumerate(docs)}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.98 * len(out) and len(out) > 200
    # Labels of held-out rows change nothing.
    flipped = known.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    assert sorted(map(str, toxicity(table, flipped).collect())) == sorted(map(str, got))
    kept = keep_civil(table, known)
    assert kept.schema == table.schema and kept.count() == sum(not r.predicted for r in got)


def test_without_labels_and_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in toxicity(awkward(spark), none).collect()}) == 1
    assert toxicity(empty(spark), none).collect() == []
