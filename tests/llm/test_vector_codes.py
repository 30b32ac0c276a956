import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import deckloom.llm.vector_codes as own
from deckloom.llm.vector_codes import Book, code_text, most, vector_codes, with_group_error

SCHEMA = "vec_id long, embedding array<float>, label int, codes string, name string"


def plain(rows, parts=16, entries=64, rounds=2):
    """All entries for each part, in Python numbers: codes and errors by row, and the codebooks."""
    ints = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    dim = len(ints[0]) // parts
    cut = [[tuple(v[p * dim : (p + 1) * dim]) for p in range(parts)] for v in ints]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, ints[i]))
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            books[p] = [tuple(sum(x) // len(groups[e]) for x in zip(*groups[e])) if e in groups else c for e, c in enumerate(books[p])]
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return [([e for _, e in f], sum(d for d, _ in f)) for f in found], books


def vectors(n, dim=32, seed=1, spread=0.3):
    rng = random.Random(seed)
    made = [(i * 7 % 1009, [float(np.float32(rng.gauss(0, spread))) for _ in range(dim)], rng.choice([None, 1, 2])) for i in range(n)]
    return made + [(5000, made[0][1], 1), (5000, made[0][1], 1), (None, made[-1][1], None)]


def test_nearest_like_all():
    rng = np.random.default_rng(2)
    for k, dim, high in ((1, 1, 3), (64, 4, 5), (64, 4, 500), (7, 3, 2), (64, 16, 10**6)):
        entries, parts = rng.integers(-high, high + 1, (k, dim)), rng.integers(-high, high + 1, (500, dim))
        index, apart = Book(entries).nearest(parts)
        all_of_them = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
        assert (index == all_of_them.argmin(1)).all() and (apart == all_of_them.min(1)).all()


def test_nearest_at_the_bound():
    bound = most(4)
    entries = np.array([[-bound] * 4, [bound] * 4], np.int64)
    index, apart = Book(entries).nearest(np.array([[bound] * 4, [-bound] * 4, [bound, bound, -bound, -bound]], np.int64))
    assert index.tolist() == [1, 0, 0] and apart.tolist() == [0, 0, 2 * (2 * bound) ** 2]


@pytest.mark.parametrize(("n", "dim"), [(300, 32), (20, 16), (1, 64)])
def test_like_plain(spark, n, dim):
    rows = vectors(n, dim)
    df = spark.createDataFrame([(*r, "clash", "n") for r in rows], SCHEMA).repartition(5)
    coded, books = vector_codes(df)
    found = with_group_error(coded).select("*", code_text(F.col("codes")).alias("code")).collect()
    want, want_books = plain(rows)
    assert [[tuple(e) for e in b] for b in books.tolist()] == want_books
    sums = {}
    for (_, _, label), (_, error) in zip(rows, want):
        sums[label] = sums.get(label, 0) + error
    got = sorted((r.vec_id is None, r.vec_id or 0, list(r.codes), r.code, r.error, r.label_error) for r in found)
    hexed = lambda c: "".join(f"{x:02x}" for x in c)
    assert got == sorted((r[0] is None, r[0] or 0, c, hexed(c), e, sums[r[2]]) for r, (c, e) in zip(rows, want))
    assert found[0].name == "n"


def test_awkward_rows(spark):
    rows = vectors(30, 32)
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1), (2, [nan] * 32, 1), (3, [0.0] * 31 + [inf], 1), (4, [-inf] + [0.0] * 31, 2), (5, [None] + [0.0] * 31, None)]
    odd = [(6000, [], 9), (6001, [0.5] * 16, 1), (6002, [0.5] * 33, 1), (6003, [3e38] * 32, 2)]
    df = spark.createDataFrame([(*r, "clash", "n") for r in rows + bad + odd], SCHEMA)
    coded, books = vector_codes(df)
    found = {r.vec_id: r for r in with_group_error(coded).collect()}
    assert not {1, 2, 3, 4, 5} & {i for i in found if i in (1, 2, 3, 4, 5)} - {r[0] for r in rows}
    assert coded.count() == len(rows) + len(odd)
    assert all(found[i].codes is None and found[i].error is None for i in (6000, 6001, 6002, 6003)) and found[6000].label_error is None
    assert [[tuple(e) for e in b] for b in books.tolist()] == plain(rows)[1]


def test_no_rows(spark):
    coded, books = vector_codes(spark.createDataFrame([], SCHEMA))
    assert books.size == 0 and with_group_error(coded).collect() == []
    only = spark.createDataFrame([(1, [], 1, "c", "n")], SCHEMA)
    coded, books = vector_codes(only)
    assert books.size == 0 and [r.error for r in coded.collect()] == [None]


def test_many_labels(spark, monkeypatch):
    """With too many labels to send out, frequent and other labels are joined apart and give the same."""
    rows = vectors(200)
    df = spark.createDataFrame([(i, v, k if n % 3 else n, "clash", "n") for n, (i, v, k) in enumerate(rows)], SCHEMA)
    coded, _ = vector_codes(df)
    key = lambda d: sorted(str(tuple(r)) for r in d.collect())
    want = key(with_group_error(coded))
    monkeypatch.setattr(own, "SENT_KEYS", 3)
    monkeypatch.setattr(own, "HOT_SHARE", 0.1)
    assert key(with_group_error(coded)) == want
