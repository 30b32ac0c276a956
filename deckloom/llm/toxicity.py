"""Toxicity from weak supervision.

Voters look at whole texts. Some are fixed: one for each family of the insult lexicon, and patterns of shouting, insistence
and address. Others are lexicon voters induced from the training rows, which is how words that no lexicon holds are found:
a word or word beginning votes toxic if it stands mostly in rows that the label model so far holds toxic, a row's own
posterior left out (the rows are cut into folds, and counts of the other folds admit a voter to a fold).

The generative label model estimates by expectation maximisation how often each voter speaks up in either class and how
voters are correlated within a class; correlated voters share their weight. The given label sets the starting point and is
one voter among the others, of which a tenth is taken to be wrong at least; so a label that the other voters contradict is
overruled, and so is one that none of them supports. The posteriors, not the labels, choose features and train a linear
classifier over presence of hashed words and word beginnings, which scores whole texts.

The models are fitted on a bounded number of labelled rows (``train_rows``); every document is scored from its whole text.
The driver sees votes and at most CANDIDATES features of those rows; counts of all features stay in Spark.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, with_report, written
from .linear import fit_logistic, sigmoid

#: Labelled rows to fit on: those with the smallest hashes of their ids. Features of the linear model, at most.
TRAIN_ROWS, FEATURES = 8000, 1500
#: Hashes of words and of word beginnings, and the lengths of these.
BUCKETS, BEGINNINGS = 1 << 24, (4, 5, 6)
#: Induced voters of one feature each; further ones are pooled in so many. Features that may become voters, at most.
SINGLE_VOTERS, POOLED_VOTERS, CANDIDATES = 200, 4, 2000
#: Share of toxic rows, shrunk to the mean, from which a feature may vote.
SURE = 0.7
#: Posterior that a toxic label starts with, and the share of labels that the model holds wrong at least.
TRUST, DOUBT = 0.6, 0.1
#: Folds of the training rows: what votes in a row was admitted by the other folds.
FOLDS = 5
WORD = re.compile(r"[^\W_]+")
#: Families of insults, as word beginnings: a voter each. None has to occur.
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "imbecile", "clown", "dumb", "crap", "bastard", "hate", "filth", "vermin", "retard", "fool", "ugly", "kill")
PATTERN_NAMES = ("shouting", "insistence", "address", *INSULTS)
INSULT = re.compile("|".join(INSULTS))
CACHE = 1 << 19


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 5, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def hashed(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings."""
    raw = [f"={word}", *(word[:n] for n in BEGINNINGS if len(word) >= n)]
    return tuple(zlib.crc32(x.encode()) % BUCKETS for x in raw)


def patterns(text: str, words: set[str]) -> list[bool]:
    """The votes of the fixed voters."""
    families = {m[0] for w in words if (m := INSULT.match(w))}
    return [text.count("!") * 20 > len(text.split()) and "!!" in text, "!!!" in text or "?!" in text, not words.isdisjoint(("you", "your", "du", "tu")), *(f in families for f in INSULTS)]


def tokens(text: bytes | None) -> tuple[str, set[str]]:
    t = (text or b"").decode("utf-8", "replace").lower()
    return t, set(WORD.findall(t))


def start(labels: np.ndarray) -> np.ndarray:
    """What a label is worth before anyone has voted."""
    return labels * (TRUST - 0.04) + 0.04


def label_model(v: np.ndarray, post: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of toxic, P(vote | class) as (class, voter), and each voter's redundancy.

    ``v`` has the votes, 0 or 1: first the given label, of which DOUBT is wrong at least, then voters. ``post`` are the
    posteriors to start from, ``prior`` is the share of toxic rows. Silence of the first two says something too, all others
    only speak for toxic or abstain. A voter's redundancy is one plus its correlations, within a class, with other such
    voters: voters that only repeat each other count together as one.
    """
    v = v.astype(np.float64)
    n, k = v.shape
    rate, share = np.zeros((2, k)), np.ones(k)
    silence = (np.arange(k) < 2).astype(float)
    for step in range(rounds):
        w = np.stack([1 - post, post])
        rate = (w @ v + 0.5) / (w.sum(1)[:, None] + 1)
        rate[:, 0] = np.maximum(rate[0, 0], DOUBT), np.minimum(rate[1, 0], 1 - DOUBT)
        if step % 5 == 4:  # not before the classes have parted
            inside = np.zeros((k, k))
            for c in (0, 1):
                d = (v - rate[c]) * np.sqrt(w[c])[:, None]
                cov = d.T @ d / max(w[c].sum(), 1e-9)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                inside += w[c].sum() / n * np.clip(cov / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(inside, 0)
            inside[:2] = inside[:, :2] = 0
            share = 1 + np.where(inside > 0.1, inside, 0).sum(1)
        yes, no = np.log(rate[1] / rate[0]) / share, silence * np.log((1 - rate[1]) / (1 - rate[0])) / share
        new = sigmoid(np.log(prior / (1 - prior)) + v @ yes + (1 - v) @ no)
        done = step > 4 and np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return post, rate, share


def _train_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """(row, toxic, found, said): at most ``limit`` labelled rows outside the held-out fold, with their features and votes."""
    known = labels.where(labels["toxic"].isNotNull() & ~held_out(labels[id_col])).groupBy(F.col(id_col).alias("key")).agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(written(known.orderBy(F.xxhash64(F.lit(11), "key"), "key").limit(limit), "toxic-rows"))  # limit rows of two numbers
    own = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text")).join(chosen, "key").select("key", "toxic", "text")

    def make():
        def work(texts: list[bytes | None]) -> list[pa.Array]:
            found, said = [], []
            for t in texts:
                text, words = tokens(t)
                found.append(sorted({h for w in words for h in hashed(w)}))
                said.append(patterns(text, words))
            return [pa.array(found, pa.list_(pa.int32())), pa.array(said, pa.list_(pa.bool_()))]

        return work

    rows = with_report(own, "text", ["key", "toxic"], make, "found array<int>, said array<boolean>")
    rows = rows.select(F.xxhash64(F.lit(11), "doc.c0").alias("at"), (F.col("doc.c1") > 0).cast("int").alias("toxic"), "found", "said")
    first = rows.orderBy("at", F.xxhash64("found")).limit(limit)  # repeated ids may have given more rows
    return written(first.select(F.monotonically_increasing_id().alias("row"), "toxic", "found", "said"), "toxic-features")


def _counts(rows: DataFrame, post: np.ndarray, candidates: int, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, and in how many rows, and with which sum of posteriors, each stands by fold, as (feature, fold).

    These are the ``candidates`` that stand in toxic rows most and the ``features`` that differ most between the classes.
    """
    spark = rows.sparkSession
    given = spark.createDataFrame(pa.table({"row": pa.array(np.arange(len(post))), "post": pa.array(post)}).to_pandas(), "row long, post double")
    each = rows.select("row", (F.col("row") % FOLDS).cast("int").alias("fold"), F.explode("found").alias("f")).join(F.broadcast(given), "row")  # train_rows rows
    own = [F.sum(F.when(F.col("fold") == k, x).otherwise(0.0)).alias(f"{name}{k}") for name, x in (("n", F.lit(1.0)), ("t", F.col("post"))) for k in range(FOLDS)]
    total, base, top = float(len(post)), float(np.clip(post.mean(), 1e-6, 1 - 1e-6)), float(post.max())
    counts = each.groupBy("f").agg(F.count("*").alias("n"), F.sum("post").alias("t"), *own).where("n >= 3")
    chi = F.pow(F.col("t") - F.col("n") * base, 2) / (F.col("n") * base * (1 - base)) / F.greatest(F.lit(0.05), 1 - F.col("n") / total)
    counts = written(counts.withColumn("chi", chi), "toxic-counts")
    lexicon = counts.where((F.col("n") >= 3) & (F.col("t") >= F.col("n") * SURE * top)).orderBy(F.desc("t"), "f").limit(candidates)
    got = lexicon.union(counts.where("chi > 10").orderBy(F.desc("chi"), "f").limit(features)).drop("n", "t", "chi").distinct().toPandas().sort_values("f").to_numpy()
    return got[:, 0].astype(np.int64), got[:, 1 : 1 + FOLDS].astype(float), got[:, 1 + FOLDS :].astype(float)


class Model:
    """What is sent to the executors: a weight for each of at most FEATURES buckets, pattern weights and a bias."""

    def __init__(self, weights: dict[int, float], said: list[float], bias: float):
        self.weights, self.said, self.bias = weights, said, bias

    def scorer(self):
        weights, cache = self.weights, {}

        def score(text: bytes | None) -> float:
            t, words = tokens(text)
            found: set[int] = set()
            for w in words:
                hit = cache.get(w)
                if hit is None:
                    hit = tuple(h for h in hashed(w) if h in weights)
                    if len(w) <= 40:
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[w] = hit
                if hit:
                    found.update(hit)
            z = self.bias + sum(weights[h] for h in found) + sum(s for s, x in zip(self.said, patterns(t, words)) if x)
            return float(sigmoid(np.array(z)))

        return score


def lexicon_votes(ids: np.ndarray, n: np.ndarray, t: np.ndarray, base: float, top: float, row: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    """(row, voter): votes of the induced voters. ``row`` and ``at`` say which of ``ids`` stands where.

    A feature may vote in a row if, in the folds without that row, it stands in toxic rows mostly. ``top`` is the highest
    posterior there is.
    """
    n_out, t_out = n.sum(1, keepdims=True) - n, t.sum(1, keepdims=True) - t
    admitted = (t_out >= 2.0) & ((t_out + 2 * base) / (n_out + 2) >= max(SURE * top, min(0.9 * top, 3 * base)))
    able = np.flatnonzero(admitted.any(1))
    able = able[np.lexsort((ids[able], -t[able].sum(1)))]
    group = np.full(len(ids), -1)
    group[able[:SINGLE_VOTERS]] = np.arange(len(able[:SINGLE_VOTERS]))
    rest = able[SINGLE_VOTERS:]
    group[rest] = SINGLE_VOTERS + np.arange(len(rest)) * POOLED_VOTERS // max(len(rest), 1)
    votes = np.zeros((rows, SINGLE_VOTERS + POOLED_VOTERS), np.uint8)
    hit = admitted[at, row % FOLDS] & (group[at] >= 0)
    votes[row[hit], group[at[hit]]] = 1
    return votes


def all_votes(y: np.ndarray, own: np.ndarray, induced: np.ndarray) -> np.ndarray:
    """The label, whether two lexicon voters or more speak, and the voters that speak at all."""
    lexicon = np.column_stack([own[:, len(PATTERN_NAMES) - len(INSULTS) :], induced[:, :SINGLE_VOTERS]])
    return np.column_stack([y, lexicon.sum(1) > 1, own[:, own.any(0)], induced[:, induced.any(0)]]).astype(np.uint8)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    rows = _train_rows(docs, labels, id_col, text_col, train_rows)
    got = rows.select("row", "toxic", "said").orderBy("row").toArrow()
    y = got["toxic"].to_numpy().astype(np.float64)
    none = [0.0] * len(PATTERN_NAMES)
    if not len(y):
        return Model({}, none, -2.0)
    if y.min() == y.max():
        return Model({}, none, 2.0 if y[0] else -2.0)
    fixed = got["said"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1).astype(np.uint8)
    ids, n, t = _counts(rows, start(y), CANDIDATES, FEATURES)
    chosen = rows.select("row", F.array_intersect("found", F.array(*[F.lit(int(i)) for i in ids]).cast("array<int>")).alias("found")).orderBy("row").toArrow()["found"].combine_chunks()
    row, at = np.repeat(np.arange(len(y)), chosen.value_lengths().to_numpy(zero_copy_only=False)), np.searchsorted(ids, chosen.flatten().to_numpy())
    post, prior = start(y), float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    for _ in range(2):  # voters, posteriors, and voters by the new posteriors
        votes = all_votes(y, fixed, lexicon_votes(ids, n, t, post.mean(), post.max(), row, at, len(y)))
        post, _, _ = label_model(votes, post, prior)
        t = np.bincount(at * FOLDS + row % FOLDS, weights=post[row], minlength=len(ids) * FOLDS).reshape(-1, FOLDS)
    n_all, t_all, base = n.sum(1), t.sum(1), np.clip(post.mean(), 1e-6, 1 - 1e-6)
    chi = (t_all - n_all * base) ** 2 / (n_all * base * (1 - base))
    use = np.flatnonzero(chi > 10)
    use = use[np.lexsort((ids[use], -chi[use]))][:FEATURES]
    column = np.full(len(ids), -1)
    column[use] = np.arange(len(use))
    x = np.zeros((len(y), len(use) + len(PATTERN_NAMES)), np.float32)
    hit = column[at] >= 0
    x[row[hit], column[at[hit]]] = 1
    x[:, len(use) :] = fixed
    w, b = fit_logistic(x, post, np.ones(len(post)), l2=1e-4, steps=250)
    return Model(dict(zip(ids[use].tolist(), w[: len(use)].tolist())), w[len(use) :].tolist(), b)


def toxicity_scores(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """A struct ``doc`` of the columns ``keep``, and the score from 0 to 1 (toxic)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = sent.value.scorer()
        return lambda texts: [pa.array([score(t) for t in texts], pa.float64())]

    return with_report(docs, text_col, keep, make, "score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 from a score of 0.5).

    ``labels`` has ``id_col`` and ``toxic`` (0, 1 or null); labels of held-out ids are never read. Only the text goes
    into a score. Null and empty texts are scored as texts without words, very long ones whole. Without labels, or with
    labels of one class only, every score is the same; with no rows there is none to return. Repeated rows stay; of
    repeated labels the higher counts; equal hashes of ids are ordered by features. Other columns, whatever their names,
    are ignored.
    """
    found = toxicity_scores(docs, fit_toxicity(docs, labels, id_col, text_col, train_rows), [id_col], text_col)
    return found.select(F.col("doc.c0").alias(id_col), held_out(F.col("doc.c0")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns, whatever their names.

    Nulls, empty and very long texts, ties and repeated rows are treated as by ``toxicity``.
    """
    return toxicity_scores(docs, fit_toxicity(docs, labels, id_col, text_col), docs.columns, text_col).where("score < 0.5").select(*columns_of(docs.columns))
