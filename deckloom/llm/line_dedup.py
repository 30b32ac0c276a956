"""Cross-site boilerplate lines, found by the spread of a line over distinct sites.

A HyperLogLog sketch of sites per line is merged by aggregation. Lines whose estimate is near the threshold get an exact
count. Whole copies of a document on many sites are no boilerplate: at least half of a line's documents must differ in
the rest of their lines, of which the smallest digest serves as witness.

``shared_lines`` is the rule of the pipeline: copies count once, and a line needs as many different documents as sites.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_SPACE, columns_of, with_report, written

MIN_SITES = 10
#: Sketches have 2 ** LG_K registers: a standard error of 1.04 / sqrt(2 ** LG_K); near means within 5 errors and a site.
LG_K = 10
#: Boilerplate digests (16 bytes each) that are sent to the executors; beyond it lines are joined instead.
SENT_LINES = 1 << 20


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line, F.lit(ASCII_SPACE)).cast("binary")))


def line_table(docs: DataFrame, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(line, site, other): a row for each distinct line of each document that is not blank.

    ``line`` is the MD5 of the trimmed line, ``other`` the smallest one among the document's other lines, if any.
    """
    lines = F.transform(F.filter(F.split(F.col("text"), "\n"), lambda x: F.trim(x, F.lit(ASCII_SPACE)) != ""), _key)
    own = docs.select(F.coalesce(docs[site_col].cast("string"), F.lit("")).alias("site"), docs[text_col].cast("string").alias("text"))
    own = own.select("site", F.array_sort(F.array_distinct(lines)).alias("lines"))
    return own.select("site", "lines", F.explode("lines").alias("line")).select(
        "line", "site", F.when(F.col("line") == F.col("lines")[0], F.get("lines", F.lit(1))).otherwise(F.col("lines")[0]).alias("other")
    )


def boilerplate_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(line): digests of the lines that stand on at least ``min_sites`` distinct sites, in documents that differ.

    Null texts have no lines, a null site is the site "", blank lines count for nothing; no rows give no lines. A line on
    exactly ``min_sites`` sites counts; repeated rows are rows of one site.
    """
    lines = written(line_table(docs, text_col, site_col), "lines")
    error = 5 * 1.04 / 2 ** (lg_k / 2)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    sketch = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sites"), F.count("*").alias("n_docs"))
    spread = written(sketch.select("line", "n_docs", F.hll_sketch_estimate("sites").alias("estimate")).where((F.col("n_docs") >= min_sites) & (F.col("estimate") >= low)), "spread-lines")
    found = lines.join(spread, "line")
    # Equal rows are combined before the shuffle, which goes by both columns: no task counts a very frequent line alone.
    exact = found.where(F.col("estimate") <= high).select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("n_sites"))
    others = found.select("line", F.coalesce("other", F.lit(b"")).alias("other")).distinct().groupBy("line").agg(F.count("*").alias("n_others"))
    held = spread.join(exact.hint("merge"), "line", "left").join(others.hint("merge"), "line")
    return held.where((F.coalesce("n_sites", F.lit(min_sites)) >= min_sites) & (2 * F.col("n_others") >= F.col("n_docs"))).select("line")


def paired(edges: list, enough: int) -> bool:
    """Whether ``enough`` of the edges (doc, site) share neither a document nor a site."""
    sites: dict = {}
    for doc, site in edges:
        sites.setdefault(doc, []).append(site)
    holder: dict = {}

    def place(doc, seen: set) -> bool:
        for site in sites[doc]:
            if site not in seen:
                seen.add(site)
                if site not in holder or place(holder[site], seen):
                    holder[site] = doc
                    return True
        return False

    return sum(place(doc, set()) for doc in sites) >= enough


def shared_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(line): digests of the lines that ``min_sites`` different documents hold, each of them on another site.

    Documents are different if their sets of lines are, so copies add neither documents nor, beyond one, sites.
    Null texts have no lines, a null site is the site ""; no rows give no lines.
    """
    lines = F.transform(F.filter(F.split(F.col("text"), "\n"), lambda x: F.trim(x, F.lit(ASCII_SPACE)) != ""), _key)
    own = docs.select(F.coalesce(docs[site_col].cast("string"), F.lit("")).alias("site"), docs[text_col].cast("string").alias("text"))
    own = own.select("site", F.array_sort(F.array_distinct(lines)).alias("lines")).select("site", F.xxhash64("lines").alias("doc"), F.explode("lines").alias("line"))
    own = written(own, "lines")
    spread = own.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.hll_sketch_estimate(F.hll_sketch_agg("doc", F.lit(LG_K))).alias("docs"))
    low = min_sites * (1 - 5 * 1.04 / 2 ** (LG_K / 2)) - 1
    found = own.join(written(spread.where((F.col("sites") >= low) & (F.col("docs") >= low)).select("line"), "spread-lines"), "line")
    # One site for each document is a pairing already, mostly with enough sites; other lines get the best pairing.
    one = found.groupBy("line", "doc").agg(F.min(F.struct(F.xxhash64("doc", "site"), "site")).alias("x")).select("line", F.col("x.site").alias("site"))
    counts = written(one.distinct().groupBy("line").agg(F.count("*").alias("n")), "paired-lines")
    left = found.join(counts.where(F.col("n") < min_sites).select("line"), "line").distinct()
    # More than min_sites edges of a document or site can't be needed: the other pairs leave one of these free.
    for one, other in (("doc", "site"), ("site", "doc")):
        left = left.withColumn("k", F.row_number().over(W.partitionBy("line", one).orderBy(other))).where(F.col("k") <= min_sites).drop("k")
    # Fewer pairs than min_sites are covered by as many documents and sites, which have min_sites edges each at most.
    most = min_sites * (min_sites - 1)
    left = written(left, "edges")
    sizes = written(left.groupBy("line").agg(F.count("*").alias("n")), "edge-counts")
    few = left.join(sizes.where(F.col("n") <= most).select("line"), "line").groupBy("line").agg(F.collect_list(F.struct("doc", "site")).alias("edges"))
    enough = F.udf(lambda edges: paired(edges, min_sites), "boolean")
    best = sizes.where(F.col("n") > most).select("line").unionByName(few.where(enough("edges")).select("line"))
    return counts.where(F.col("n") >= min_sites).select("line").unionByName(best)


def line_dedup(
    docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, sent_lines: int = SENT_LINES, rule: Callable[[DataFrame, str, str, int], DataFrame] = boilerplate_lines
) -> DataFrame:
    """``docs`` without the lines in ``text_col`` that ``rule`` finds, and the columns n_lines and n_removed.

    Lines end with "\\n" and are compared without white space at their ends; blank ones are never removed. A null site is
    a site of its own (""). A null text stays null with no lines; an empty one has one blank line. A text may become
    empty; very long texts are read whole. Repeated rows stay and count as documents; without rows there is none to return.
    Of other columns any name is kept, but columns named n_lines or n_removed are replaced.
    """
    spark = docs.sparkSession
    bad = written(rule(docs, text_col, site_col, min_sites), "boilerplate")
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    if bad.count() > sent_lines:
        return _by_join(docs, bad, keep, text_col)
    sent = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in bad.collect()))
    space = ASCII_SPACE.encode()

    def make():
        drop = sent.value

        def work(texts: list[bytes | None]) -> list[pa.Array]:
            out, n, removed = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts):
                if t is not None:
                    lines = t.split(b"\n")
                    stay = [x for x in lines if not (y := x.strip(space)) or hashlib.md5(y).digest() not in drop]
                    n[i], removed[i] = len(lines), len(lines) - len(stay)
                    t = b"\n".join(stay)
                out.append(t)
            return [pa.array(out, pa.binary()), pa.array(n), pa.array(removed)]

        return work

    rest = [c for c in keep if c != text_col]
    found = with_report(docs, text_col, rest, make, "text binary, n_lines long, n_removed long")
    back = dict(zip(rest, columns_of(rest))) | {text_col: F.col("text").cast("string").alias(text_col)}
    return found.select(*[back[c] for c in keep], "n_lines", "n_removed")


def _by_join(docs: DataFrame, bad: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The same with a shuffle: lines are joined with the digests and put together again by row."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(keep)]).alias("doc"), docs[text_col].cast("string").alias("text")), "line-rows")
    lines = rows.select("row", F.posexplode(F.split("text", "\n")).alias("pos", "value")).withColumn("line", F.when(F.trim("value", F.lit(ASCII_SPACE)) != "", _key(F.col("value"))))
    marked = lines.join(bad.select("line", F.lit(True).alias("bad")).hint("merge"), "line", "left")
    joined = marked.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("bad").isNull(), F.struct("pos", "value")))).alias("stay"), F.count("*").alias("n_lines"), F.count("bad").alias("n_removed")
    )
    found = rows.select("row", "doc").join(joined.hint("merge"), "row", "left")
    text = F.array_join(F.col("stay.value"), "\n")
    back = dict(zip(keep, columns_of(keep))) | {text_col: text.alias(text_col)}
    return found.select(*[back[c] for c in keep], F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"))
