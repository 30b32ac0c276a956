"""Document quality without hand-made labels.

Overlapping heuristic labellers look at a whole text and vote good, bad or nothing. How often each votes what, given the
hidden class, is estimated by expectation maximisation over the counts of all vote patterns; a pattern's posterior is the
label of its documents. A linear model over hashed features of the text is trained on the posteriors of a bounded sample
and scores every document.

There are at most 3 ** 10 vote patterns, so their counts fit the driver for any number of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, with_report
from .linear import fit_logistic, sigmoid

#: Rows that the linear model is fitted on, the smallest hashes of their ids, and its hashed features.
TRAIN_ROWS, DIMS = 5000, 4096
CHUNK_WORDS = 100
#: Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so "
    "le la les de des du et un une en est que qui dans pour sur pas avec par au ne se ce il elle son plus aux "
    "der die das und ist von zu den mit dem nicht ein eine für auf im es sich auch als an er so wie bei nach aus am wird "
    "el los las y del se por con una para su al lo como más o pero sus este sí porque esta entre cuando muy sin sobre".split()
)
SYMBOLS = b"#$%&*^~=+<>{}[]\\_@`"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
#: Bytes to 16 classes: small, capital, other letters, digits, space, line end, and the signs one by one or together.
CLASSES = bytes(
    0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if b >= 128 else 3 if 48 <= b <= 57 else 4 if b in b" \t" else 5 if b in b"\n\r" else 6 if b == 46 else 7 if b == 44 else 8 if b == 33 else 9 if b == 124
    else 10 if b in b"'\"()" else 11 if b in b";:?" else 12 if b in b"-/" else 13 if b in b"#*@_" else 14 if b in b"$%&+=" else 15
    for b in range(256)
)
#: (name, value below which it votes bad, from which good, up to which good, above which bad); between them no vote.
VOTERS = (
    ("symbols", -1, -1, 0.02, 0.06),
    ("capitals", -1, -1, 0.2, 0.5),
    ("bars", -1, -1, 0.02, 0.2),
    ("same_as_before", -1, -1, 0.05, 0.25),
    ("distinct", 0.35, 0.55, 2, 2),
    ("exclaimed", -1, -1, 0.05, 0.3),
    ("function_words", 0.01, 0.08, 0.7, 0.9),
    ("stops", 0.005, 0.02, 0.5, 0.8),
    ("word_length", 2, 3, 9, 14),
    ("digits", -1, -1, 0.1, 0.3),
)


def measures(text: bytes) -> list[float]:
    """What the voters look at, in their order; NaN where the text is too short to say."""
    words = text.split()
    n = len(words)
    if n < 5:
        return [float("nan")] * len(VOTERS)
    size, solid = len(text), sum(map(len, words))
    count = lambda kinds: size - len(text.translate(None, kinds))
    letters, capitals = count(LETTERS), count(bytes(range(65, 91)))
    plain = text.decode("utf-8", "replace").lower().split()
    spread = [len({*words[i : i + CHUNK_WORDS]}) / len(words[i : i + CHUNK_WORDS]) for i in range(0, n, CHUNK_WORDS) if i + CHUNK_WORDS <= n or not i]
    return [
        count(SYMBOLS) / solid,
        capitals / max(letters, 1),
        count(b"|") / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(spread) / len(spread),
        count(b"!") / n,
        sum(map(FUNCTION_WORDS.__contains__, (w.strip(".,;:!?") for w in plain))) / n,
        sum(w.endswith((b".", b"?", b"!", b":")) for w in words) / n,
        letters / n,
        count(b"0123456789") / solid,
    ]


#: The pattern of a text that is too short for any voter.
NO_VOTES = (3 ** len(VOTERS) - 1) // 2


def votes(values: list[float]) -> int:
    """The vote pattern as a number to base 3: 0 bad, 1 none, 2 good."""
    code = 0
    for x, (_, bad_below, good_from, good_to, bad_above) in zip(values, VOTERS):
        code = code * 3 + (0 if x < bad_below or x > bad_above else 2 if good_from <= x <= good_to else 1)
    return code


def features(text: bytes, values: list[float]) -> np.ndarray:
    """Hashed runs of four character classes, as roots of their shares, and a bin of each measure."""
    out = np.zeros(DIMS, np.float32)
    kinds = np.frombuffer(text.translate(CLASSES), np.uint8)
    for at in range(0, len(kinds), 1 << 20):
        c = kinds[at : at + (1 << 20) + 3].astype(np.uint32)
        if len(c) >= 4:
            code = (((c[:-3] * 16 + c[1:-2]) * 16 + c[2:-1]) * 16 + c[3:]) * np.uint32(2654435761) >> np.uint32(20)
            out += np.bincount(code, minlength=DIMS)
    out = np.sqrt(out / max(out.sum(), 1))
    for k, x in enumerate(values):
        if x == x:
            out[(k * 64 + min(int(x * 20), 63)) * 2654435761 % (1 << 32) >> 20] += 0.5
    return out


def fit_votes(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and P(vote | class) as (voter, class, vote), by expectation maximisation.

    It starts from the votes for good against those for bad; classes keep their meaning because of that start.
    """
    k = len(VOTERS)
    v = codes[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3
    bad, good = (v == 0).sum(1), (v == 2).sum(1)
    post = np.where(bad > 0, 0.1 / np.maximum(bad, 1), np.where(good > 0, 0.95, 0.5))
    table = np.zeros((k, 2, 3))
    for _ in range(rounds):
        w = np.stack([(1 - post) * counts, post * counts])
        for vote in range(3):
            table[:, :, vote] = ((v == vote).T.astype(float) @ w.T) + 0.5
        table /= table.sum(2, keepdims=True)
        prior = (w.sum(1) + 1) / (w.sum() + 2)
        logs = np.log(prior)[:, None] + np.array([np.log(table[np.arange(k), c, v]).sum(1) for c in (0, 1)])
        new = sigmoid(logs[1] - logs[0])
        if len(post) == 0 or np.abs(new - post).max() < 1e-6:
            return new, table
        post = new
    return post, table


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float, float]:
    """Weights, bias and the share of good documents.

    Vote patterns are counted over all documents; the linear model sees ``train_rows`` of those that have votes.
    """

    def all_votes():
        return lambda texts: [pa.array([votes(measures(t or b"")) for t in texts], pa.int32())]

    def of_sample():
        def work(texts: list[bytes | None]) -> list[pa.Array]:
            m = [measures(t or b"") for t in texts]
            x = [features(t or b"", v) for t, v in zip(texts, m)]
            at = [np.flatnonzero(r) for r in x]
            return [
                pa.array([votes(v) for v in m], pa.int32()),
                pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
                pa.array([r[a] for r, a in zip(x, at)], pa.list_(pa.float32())),
            ]

        return work

    counted = with_report(docs, text_col, [], all_votes, "code int").groupBy("code").count().collect() if docs.columns else []
    codes, counts = np.array([r[0] for r in counted], np.int64), np.array([r[1] for r in counted], float)
    post, _ = fit_votes(codes, counts)
    label = dict(zip(codes.tolist(), post.tolist()))
    total = int(counts.sum())
    if not total:
        return np.zeros(DIMS, np.float32), 0.0, 0.5
    prior = float(post @ counts / total)
    # The ids with the smallest hashes: as many as asked for, whatever the size of the table.
    mixed = F.xxhash64(F.lit(7), docs[id_col])
    share = min(1.0, 1.3 * train_rows / total)
    near = docs.where(mixed <= min(int((share - 0.5) * (1 << 64)), (1 << 63) - 1))
    rows = with_report(near.withColumn("__order", F.xxhash64(F.lit(7), F.col(id_col))), text_col, ["__order"], of_sample, "code int, at array<int>, value array<float>")
    rows = rows.select(F.col("doc.c0").alias("at_hash"), "code", "at", "value").where(F.col("code") != NO_VOTES).orderBy("at_hash", "code").limit(train_rows).toArrow()
    if not len(rows):
        return np.zeros(DIMS, np.float32), 0.0, prior
    x, at = np.zeros((len(rows), DIMS), np.float32), rows["at"].combine_chunks()
    x[np.repeat(np.arange(len(rows)), at.value_lengths().to_numpy(zero_copy_only=False)), at.flatten().to_numpy()] = rows["value"].combine_chunks().flatten().to_numpy()
    y = np.array([label.get(c, 0.5) for c in rows["code"].to_pylist()])
    return *fit_logistic(x, y, np.ones(len(y))), prior


def quality_scores(docs: DataFrame, model: tuple[np.ndarray, float, float], keep: list[str], text_col: str = "text") -> DataFrame:
    """A struct ``doc`` of the columns ``keep``, the score from 0 to 1 (good) and the vote pattern."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights

    def make():
        w, b, prior = sent.value

        def work(texts: list[bytes | None]) -> list[pa.Array]:
            m = [measures(t or b"") for t in texts]
            codes = [votes(v) for v in m]
            score = [prior if c == NO_VOTES else float(sigmoid(features(t, v) @ w + b)) for t, v, c in zip(texts, m, codes)]
            return [pa.array(score, pa.float64()), pa.array(codes, pa.int32())]

        return work

    return with_report(docs, text_col, keep, make, "score double, code int")


def quality_classifier(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: id, score, good (score of at least 0.5), vote pattern.

    A text on which no labeller votes, as one of fewer than five words (null and empty ones too), has the share of good
    documents as its score. Rows, repeated ones too, stay; other columns are ignored; with no rows there is nothing to
    fit and no row to return.
    """
    model = fit_quality(docs, id_col, text_col, train_rows)
    found = quality_scores(docs, model, [id_col], text_col)
    return found.select(F.col("doc.c0").alias(id_col), "score", (F.col("score") >= 0.5).alias("good"), "code")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their own columns, whatever their names.

    Null and empty texts, and others on which no labeller votes, get the share of good documents as their score; a score of
    exactly 0.5 stays. Texts are read whole, repeated rows go or stay together, and no rows give no rows.
    """
    model = fit_quality(docs, id_col, text_col, train_rows)
    return quality_scores(docs, model, docs.columns, text_col).where("score >= 0.5").select(*columns_of(docs.columns))
