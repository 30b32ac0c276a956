"""URL filtering by rules, and beyond them by a ratio of character language models.

Two variable-order Markov models, of accepted and of rejected URLs, are smoothed from order three down to order zero
(Witten-Bell). Their difference in log-likelihood, divided by the URL's length, is held against a threshold that is
calibrated on URLs the models have not seen. Every URL counts: a fold for calibration, the others for the models.

Which URLs the models learn from is decided by terms in the host: hosts with one of ``reject_terms`` are rejected
examples, all others accepted ones. The alphabet has 42 signs, so counts have at most 2 * 42 ** 4 entries at any input size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, beginning of the path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
REJECT_TERMS = ("casino", "pills", "bets", "spam", "adult", "ads-", "porn", "viagra", "poker", "warez")
#: Letters, one sign for all digits, the frequent punctuation marks and one for anything else; 0 stands before a URL.
MARKS = "/.-_?=&#:%~+@"
SIGNS = 1 + 26 + 1 + len(MARKS) + 1
ORDER = 3
#: One URL in so many, by hash, is for calibration; bins of its histogram of differences, and their range.
FOLDS, BINS, RANGE = 5, 2000, 10.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, found).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # a later, longer one comes first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _sign_table() -> np.ndarray:
    t = np.full(256, SIGNS - 1, np.int64)
    for k, c in enumerate(LOWER):
        t[ord(c)] = t[ord(c.upper())] = 1 + k
    t[48:58] = 27
    for k, c in enumerate(MARKS):
        t[ord(c)] = 28 + k
    return t


SIGN = _sign_table()


def grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ORDER + 1 signs that end at each byte of each URL, and the URLs' lengths in bytes."""
    lengths = np.array([len(u) for u in urls], np.int64)
    pad = b"\0" * ORDER
    raw = np.frombuffer(b"".join(pad + u for u in urls), np.uint8)
    signs = SIGN[raw]
    starts = np.cumsum(lengths + ORDER) - lengths - ORDER
    signs[(starts[:, None] + np.arange(ORDER)).ravel()] = 0
    codes = np.zeros(max(len(signs) - ORDER, 0), np.int64)
    for k in range(ORDER + 1):
        codes = codes * SIGNS + signs[k : k + len(codes)]
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    return codes[at], lengths


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Log of P(sign | three signs before) for every code, mixed with all shorter contexts by Witten-Bell weights."""
    p = np.full(SIGNS, 1 / SIGNS)
    for order in range(ORDER + 1):
        c = counts.reshape(-1, SIGNS ** (order + 1)).sum(0).reshape(-1, SIGNS)
        total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        below = np.tile(p.reshape(-1, SIGNS), (len(c) // max(len(p.reshape(-1, SIGNS)), 1), 1))
        p = np.where(total > 0, (c + kinds * below) / np.maximum(total + kinds, 1), below)
    return np.log(p).ravel()


def _examples(pages: DataFrame, url_col: str, reject_terms) -> DataFrame:
    """(url, bad, calibration) for every URL that is not empty."""
    urls = pages.select(pages[url_col].cast("string").alias("url")).where(F.length("url") > 0)
    host, bad = host_of(F.col("url")), F.lit(False)
    for term in reject_terms:
        bad = bad | host.contains(term)
    return urls.select("url", bad.alias("bad"), (F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(FOLDS)) == 0).alias("calibration"))


def fit_urls(pages: DataFrame, url_col: str = "url", reject_terms=REJECT_TERMS) -> tuple[np.ndarray, float]:
    """(difference of the log probabilities by code, threshold)."""
    examples = _examples(pages, url_col, reject_terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SIGNS ** (ORDER + 1)), np.int64)
        for b in batches:
            urls, bad = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), bool)
            if urls:
                codes, lengths = grams(urls)
                of = np.repeat(bad, lengths)
                for c in (0, 1):
                    k, n = np.unique(codes[of == bool(c)], return_counts=True)
                    sums[c, k] += n
        for c in (0, 1):
            k = np.flatnonzero(sums[c])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), c), pa.int32()), pa.array(k), pa.array(sums[c, k])], ["bad", "code", "n"])

    seen = examples.where("not calibration").select(F.col("url").cast("binary").alias("url"), "bad").mapInArrow(count, "bad int, code long, n long")
    counts = np.zeros((2, SIGNS ** (ORDER + 1)), np.float64)
    got = seen.groupBy("bad", "code").agg(F.sum("n").alias("n")).toPandas()
    counts[got["bad"].to_numpy(int), got["code"].to_numpy(int)] = got["n"]
    difference = (log_probabilities(counts[0]) - log_probabilities(counts[1])).astype(np.float32)
    if not counts.any(axis=1).all():
        return np.zeros_like(difference), -1.0  # nothing to tell apart: all are accepted
    scored = url_scores(examples.where("calibration"), difference, ["bad"])
    bin_of = F.least(F.greatest(F.floor((F.col("score") + RANGE) / (2 * RANGE) * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    hist = np.zeros((2, BINS))
    for bad, k, n in scored.groupBy(F.col("page.c0").cast("int"), bin_of).count().collect():  # at most 2 * BINS rows
        hist[bad, k] = n
    share = hist / np.maximum(hist.sum(1, keepdims=True), 1)
    wrong = np.concatenate([[0], np.cumsum(share[0])]) + 1 - np.concatenate([[0], np.cumsum(share[1])])  # accepted below, rejected above
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return difference, float(best[len(best) // 2] / BINS * 2 * RANGE - RANGE)


def url_scores(pages: DataFrame, difference: np.ndarray, keep: list[str], url_col: str = "url") -> DataFrame:
    """A struct ``page`` of the columns ``keep``, and the difference per byte of the URL; 0 for an empty one."""
    sent = pages.sparkSession.sparkContext.broadcast(difference)  # SIGNS ** 4 floats
    asked = pages.select(F.struct(*[pages[c].alias(f"c{i}") for i, c in enumerate(keep)]).alias("page"), F.coalesce(pages[url_col].cast("string"), F.lit("")).cast("binary").alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in batches:
            urls = b.column(1).to_pylist()
            codes, lengths = grams(urls) if urls else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            score = np.bincount(np.repeat(np.arange(len(urls)), lengths), table[codes], len(urls)) / np.maximum(lengths, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["page", "score"])

    return asked.mapInArrow(run, f"page {asked.schema['page'].dataType.simpleString()}, score double")


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, reject_terms=REJECT_TERMS) -> DataFrame:
    """One row per page: id, url, host, path, rule, verdict, score.

    A rule fits its host and all its subdomains where the path begins with the rule's; the longest decides. Other URLs
    are blocked if their score is below the calibrated threshold. A null URL, or one without ``://``, has an empty host
    and path; a null or empty one has the score 0 and is allowed. Repeated rows stay; other columns are ignored.
    """
    difference, threshold = fit_urls(pages, url_col, reject_terms)
    found = url_scores(pages, difference, [id_col, url_col], url_col)
    found = found.select(F.col("page.c0").alias(id_col), F.col("page.c1").alias("url"), F.coalesce(F.col("page.c1").cast("string"), F.lit("")).alias("text"), "score")
    found = found.withColumn("host", host_of(F.col("text"))).withColumn("path", path_of(F.col("text")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_model = F.when((F.col("text") != "") & (F.col("score") < threshold), "block").otherwise("allow")
    return found.select(id_col, "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_model).alias("verdict"), "score")
