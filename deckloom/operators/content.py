"""Texts behind decks: sections, ids, packing, cleaning, roll-ups and facts; and what is said about slides."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import written
from .groups import before_overflow, numbered, rarest_first, where_dealt

#: Kinds of facts, and the share of talking time of archetypes (others count 1).
FACT_KINDS = ("overview", "problem", "solution", "architecture", "feature", "metric", "milestone", "decision", "limitation", "plan", "other")
TALK_WEIGHTS = {"title": 0.5, "section": 0.25, "closing": 0.6}

#: Numbers of 64 bits that stand for a fact's stems while likely pairs are looked for.
BIT_WORDS = 4
#: Facts of a pack whose stems are one group at most; larger packs have more groups, and each a share of the stems.
GROUP_FACTS = 1 << 17
#: Tasks that share the stems of a group.
GROUP_PASSES = 6
#: Stems that may have a number of their own because another one's hash is the same.
CODES_APART = 10_000


def sections(paras: DataFrame, heading: str) -> DataFrame:
    """(doc_id, section, title, n_lines, body) of documents with at least two headings; empty sections are dropped.

    ``paras`` has doc_id, para_no and text; a line that matches ``heading`` begins a section.
    """
    w = W.partitionBy("doc_id")
    is_head = F.col("text").rlike(heading)
    p = paras.withColumn("is_head", is_head).withColumns({"section": F.sum(F.col("is_head").cast("int")).over(w.orderBy("para_no")), "heads": F.sum(F.col("is_head").cast("int")).over(w)})
    p = p.where("heads >= 2 and section >= 1")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_head") & (F.trim("text") != ""), F.struct("para_no", "text")))), lambda x: x["text"]), "\n")
    s = p.groupBy("doc_id", F.col("section").cast("long").alias("section")).agg(F.max(F.when(F.col("is_head"), F.col("text"))).alias("title"), F.count_if(~F.col("is_head") & (F.trim("text") != "")).alias("n_lines"), body.alias("body"))
    return s.where("n_lines > 0")


def unique_ids(df: DataFrame, id_col: str, order: list, bucket: list[Column]) -> DataFrame:
    """The second occurrence of an id becomes id~2 and so on; ``bucket`` rises with ``order``."""
    found = numbered(df, [id_col], order, bucket, "k")
    return found.withColumn("unique_id", F.when(F.col("k") == 1, F.col(id_col)).otherwise(F.concat(F.col(id_col), F.lit("~"), F.col("k").cast("string")))).drop("k")


def record_kind(raw: Column) -> Column:
    """Series, table, quote, metric or record, by the keys a JSON record has."""
    v = F.try_parse_json(raw)
    has = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    return F.when(has("categories") & has("series"), "series").when(has("header") & has("rows"), "table").when(has("text") & has("author"), "quote").when(has("value"), "metric").otherwise("record")


def pack(docs: DataFrame, group: str, limit: int = 12000) -> DataFrame:
    """Documents of each group up to the first that does not fit."""
    d = docs.select(F.col(group).alias("grp"), "doc_id", F.char_length("text").alias("size"))
    return before_overflow(d, ["grp"], ["doc_id"], F.col("size"), limit, [F.floor(F.col("doc_id") / 1024)]).select("grp", "doc_id", "used")


#: Names of files that describe a project's parts or its past.
MANIFESTS = ("pyproject.toml", "package.json", "setup.cfg", "cargo.toml", "go.mod", "tree.txt", "history.txt", "changelog.md")


def source_tier(path: Column) -> Column:
    """0 for a README at the root, 1 for a manifest, tree or history there, 2 for docs folders, 3 for other files at the
    root and other READMEs, 4 for the rest."""
    parts = F.split(path, "/")
    depth, top, name = F.size(parts) - 1, F.lower(parts[0]), F.lower(F.element_at(parts, -1))
    readme = name.startswith("readme")
    return F.when(readme & (depth == 0), 0).when((depth == 0) & name.isin(*MANIFESTS), 1).when(top.isin("docs", "doc", "documentation"), 2).when((depth == 0) | readme, 3).otherwise(4)


def _noise(line: Column) -> Column:
    """Whether a line is only markup, or holds an image or begins with a badge."""
    only_markup = (F.trim(line) != "") & (F.trim(F.regexp_replace(line, r"<[^>]+>", "")) == "")
    image, badge = F.contains(line, F.lit("![")), F.ltrim(line).startswith("[![")
    return only_markup | image | badge


def clean_lines(df: DataFrame, text_col: str, separator: str = "\n", limit: int = 40000) -> DataFrame:
    """Without lines that are only markup, images or badges; blank lines squeezed; cut at the limit, with a flag."""
    lines = F.filter(F.split(F.col(text_col), separator), lambda x: ~_noise(x))
    full = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return df.withColumns({"clean": F.substring(full, 1, limit), "was_cut": F.char_length(full) > limit})


def tree(paths: DataFrame, depth: int = 2, most: int = 8) -> DataFrame:
    """Files per folder down to ``depth`` levels (kind "folder"), and the ``most`` frequent extensions ("extension")."""
    parts = F.split("path", "/")
    levels = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(depth))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = paths.select(F.explode(levels).alias("name")).groupBy("name").agg(F.count("*").alias("files"))
    last = F.element_at(parts, -1)
    ending = F.lower(F.coalesce(F.nullif(F.regexp_extract(last, r"[^.](\.[^.]+)$", 1), F.lit("")), last))
    ends = paths.select(ending.alias("name")).groupBy("name").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "name").limit(most)
    return folders.select(F.lit("folder").alias("kind"), "name", "files").unionByName(ends.select(F.lit("extension").alias("kind"), "name", "files"))


def history(commits: DataFrame, last: int = 150) -> DataFrame:
    """Per repository (repo, at, id): how many, first and last date, and a digest of the last ones."""
    w = W.partitionBy("repo").orderBy(F.desc("at"), F.desc("id"))
    c = commits.withColumn("k", F.row_number().over(w))
    latest = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= last, F.struct("k", "id")))), lambda x: x["id"].cast("string")), ",")
    return c.groupBy("repo").agg(F.count("*").alias("commits"), F.min("at").cast("date").alias("first"), F.max("at").cast("date").alias("last"), latest.alias("latest"))


def manifest_facts(raw: Column) -> dict[str, Column]:
    """Name, version and description of a JSON manifest, and the names of its dependencies (a list or a map)."""
    deps = F.get_json_object(raw, "$.dependencies")
    names = F.when(deps.startswith("{"), F.json_object_keys(deps)).when(deps.startswith("["), F.transform(F.from_json(deps, "array<string>"), lambda d: F.regexp_extract(d, r"^[^<>=!~;\[ ]*", 0)))
    return {**{n: F.coalesce(F.get_json_object(raw, f"$.{n}"), F.lit("")) for n in ("name", "version", "description")}, "dependencies": F.coalesce(F.array_join(names, ","), F.lit(""))}


def pieces(docs: DataFrame, group: str, size: int = 8000, spare: int = 200) -> DataFrame:
    """(grp, doc_id, piece, n): documents as pieces of n characters.

    A document that fits ``size`` less ``spare`` is one piece. Of a longer one, whole paragraphs (lines that are not blank) fill
    a piece as long as they fit, joined by two line ends; a paragraph that is longer itself is cut. A fold over the lengths of
    one document's paragraphs.
    """
    room = size - spare
    cut = lambda n: F.transform(F.sequence(F.lit(0), F.ceil(n / room).cast("int") - 1), lambda i: F.least(F.lit(room), n - i * room))
    lengths = F.flatten(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: cut(F.char_length(x))))

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["used"] == 0) | (acc["used"] + 2 + n <= room)
        more = F.struct((acc["used"] + n + F.when(acc["used"] > 0, 2).otherwise(0)).cast("int").alias("used"), acc["done"].alias("done"))
        return F.when(fits, more).otherwise(F.struct(n.cast("int").alias("used"), F.concat(acc["done"], F.array(acc["used"])).alias("done")))

    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("done"))
    split = F.aggregate(lengths, start, step, lambda acc: F.concat(acc["done"], F.array(acc["used"])))
    whole = F.char_length("text") <= room
    return docs.select(F.col(group).alias("grp"), "doc_id", F.posexplode(F.when(whole, F.array(F.char_length("text"))).otherwise(split)).alias("piece", "n"))


def chunks(docs: DataFrame, group: str, size: int = 8000, most: int = 24) -> DataFrame:
    """(grp, doc_id, piece, n, chunk): pieces in order into chunks of at most ``size`` characters, two between pieces;
    chunk is null beyond ``most`` chunks.

    Only pieces within the first ``most`` times ``size`` characters of a group can get a chunk: the fold is over these.
    """
    p = written(pieces(docs, group, size), "pieces")
    few = before_overflow(p, ["grp"], ["doc_id", "piece"], F.col("n"), most * size, [F.floor(F.col("doc_id") / 256)]).select("grp", "doc_id", "piece", "n")
    d = few.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("doc_id", "piece", "n"))).alias("d"))
    row = "struct<doc_id:bigint,piece:int,chunk:int>"

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] == 0) | (acc["used"] + x["n"] <= size)
        chunk = F.when(fits, acc["chunk"]).otherwise(acc["chunk"] + 1)
        new = F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), chunk.alias("chunk")).cast(row)
        return F.struct(chunk.alias("chunk"), (F.when(fits, acc["used"]).otherwise(0) + x["n"] + 2).cast("int").alias("used"), F.concat(acc["out"], F.array(new)).alias("out"))

    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), F.array().cast(f"array<{row}>").alias("out"))
    got = d.select(F.col("grp").alias("g"), F.inline(F.aggregate("d", start, step)["out"])).where(F.col("chunk") < most).withColumnsRenamed({"doc_id": "d", "piece": "p"})
    found = p.join(got.hint("merge"), p["grp"].eqNullSafe(F.col("g")) & (p["doc_id"] == F.col("d")) & (p["piece"] == F.col("p")), "left")
    return found.select("grp", "doc_id", F.col("piece").cast("long").alias("piece"), F.col("n").cast("long").alias("n"), F.col("chunk").cast("long").alias("chunk"))


def normal_facts(facts: DataFrame, least: int = 12, most: int = 12, cut: int = 400, allowed: DataFrame | None = None) -> DataFrame:
    """Facts (pack, chunk, n, text, kind, weight) of enough text, once per chunk, weights from 1 to 3, the first ``most``.

    With ``allowed`` (chunk, source) only facts whose column ``source`` is one of their chunk's sources count.
    """
    if allowed is not None:
        facts = facts.join(allowed.select("chunk", "source").distinct(), ["chunk", "source"], "left_semi")
    t = F.substring(F.trim("text"), 1, cut)
    f = facts.select("pack", "chunk", "n", t.alias("text"), F.when(F.col("kind").isin(*FACT_KINDS), F.col("kind")).otherwise("other").alias("kind"), F.least(F.greatest("weight", F.lit(1)), F.lit(3)).alias("weight")).where(F.char_length("text") >= least)
    return _first_of_chunk(f, "n", most)


def _first_of_chunk(f: DataFrame, order: str, most: int) -> DataFrame:
    first = f.withColumn("k", F.row_number().over(W.partitionBy("pack", "chunk", F.lower("text")).orderBy(order))).where("k = 1")
    return first.withColumn("k", F.row_number().over(W.partitionBy("pack", "chunk").orderBy(order))).where(F.col("k") <= most).drop("k")


def normal_texts(chunks: DataFrame, least: int = 12, most: int = 12, cut: int = 400) -> DataFrame:
    """K11 for chunks (pack, chunk, texts) that hold their facts' texts in order: (pack, chunk, at, text) of the normal facts, at
    from 0. No fact moves, unless a chunk comes in more than one row, which is looked at first."""
    texts = F.transform("texts", lambda x: F.substring(F.trim(x), 1, cut))
    f = chunks.select("pack", "chunk", F.explode(F.array(texts)).alias("texts"))  # a generator: worked out once
    f = f.select("pack", "chunk", "texts", F.explode(F.array(F.transform("texts", lambda x: F.when(F.char_length(x) >= least, F.lower(x))))).alias("low"))
    first = F.slice(F.array_compact(F.array_distinct("low")), 1, most)
    f = f.select("pack", "chunk", "texts", F.explode(F.transform(first, lambda x: (F.array_position("low", x) - 1).cast("int"))).alias("at"))
    f = f.select("pack", "chunk", F.col("at").cast("long").alias("at"), F.get("texts", F.col("at")).alias("text"))
    split = chunks.groupBy("pack", "chunk").agg(F.count("*").alias("k")).where("k > 1")
    return f if split.isEmpty() else _first_of_chunk(f, "at", most)


def _said(c: Column) -> Column:
    """A text without regard to case and a final dot."""
    return F.rtrim(F.lower(F.trim(c)), F.lit("."))


def distinct_facts(facts: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first of equal texts of a pack, without regard to case and a final dot."""
    return facts.withColumn("k", F.row_number().over(W.partitionBy(*key, _said(F.col("text"))).orderBy(*order))).where("k = 1").drop("k")


def near_facts(facts: DataFrame, least: float = 0.6, once: bool = False) -> DataFrame:
    """Facts (pack, id, text) that share at least ``least`` of the smaller one's stems. With ``once`` only the first of a
    pack's equal texts counts, as in K12.

    Facts with equal stems are a class; each is paired with its class's first fact, and only first facts with each other.
    The smaller set must share one of its rarest few with the other, so only these are joined. A large pack is dealt out
    in groups of stems, as many as keep a group's facts below GROUP_FACTS: a fact goes once to each group that has a stem of
    its own, with all of its stems as numbers. Stems meet within their group, so what is shuffled grows with the facts alone:
    a pair of which the smaller one has more bits to itself than it may have stems ends in the join, which also
    compares the stems of the others and gives a pair at the first stem that the two share. The result is exact.
    """
    stems = F.sort_array(text.stems(F.col("text")))
    said = [F.unhex(F.md5(_said(F.col("text")).cast("binary"))).alias("said")] if once else []
    own = facts.select("pack", "id", *said, F.explode(F.array(stems)).alias("stems")).where(F.size("stems") > 0)  # a generator: stems are found once
    own = written(own, "fact-stems")
    same = F.unhex(F.md5(F.concat_ws("\n", F.array_join("stems", " "), F.concat(F.lit("="), F.col("pack"))).cast("binary"))).alias("same")  # of stems and pack
    each = own.select("pack", "id", same, *(["said"] if once else []))
    each = written(each.groupBy("same", "said").agg(F.min("id").alias("id"), F.min("pack").alias("pack")).drop("said") if once else each, "fact-classes")  # equal texts have equal stems
    first = written(each.groupBy("same").agg(F.min("id").alias("first"), F.min("pack").alias("pack"), F.count("*").alias("k")), "first-facts")
    copies = each.select("same", F.col("id").alias("other")).join(first.where("k > 1").hint("merge"), "same").where("first <> other").select("pack", F.col("first").alias("id"), "other", F.lit(1.0).alias("share"))
    chosen = first.where("pack is not null").select("same", F.col("first").alias("id"))
    s = own.select("pack", "id", same, _rarest_codes(own).alias("codes")).join(chosen.hint("merge"), ["same", "id"], "left_semi").dropDuplicates(["same", "id"])
    s = written(s.select("pack", "id", "codes", *[_bits(F.col("codes"), k).alias(f"bits{k}") for k in range(BIT_WORDS)]), "fact-codes")
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(GROUP_FACTS, max(GROUP_FACTS >> 3, 4 * first.count() // parts))  # fewer if tasks would be too few
    large = written(first.groupBy("pack").agg(F.ceil(F.count("*") / most).cast("int").alias("groups")).where("groups > 1 and pack is not null"), "large-packs")
    group = lambda code: F.pmod(code, F.col("groups"))
    s = s.join(F.broadcast(large), "pack", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))  # at most a row for GROUP_FACTS facts
    s = s.withColumn("grp", F.explode(F.array_distinct(F.transform("codes", group)))).repartition(parts, "pack", "grp")
    bits = [f"bits{k}" for k in range(BIT_WORDS)]
    n = F.size("codes")
    spare = (n - F.ceil(F.lit(least) * n - 1e-9)).cast("int")  # so many stems of the smaller fact the other may lack
    smaller = (F.col("n") < F.col("m")) | (F.col("n") == F.col("m")) & (F.col("id") < F.col("other"))
    lacks = sum((F.bit_count(F.col(c).bitwiseAND(F.bitwise_not(f"o_{c}"))) for c in bits[1:]), F.bit_count(F.col(bits[0]).bitwiseAND(F.bitwise_not(f"o_{bits[0]}"))))
    each = s.select("pack", "grp", "groups", "id", n.alias("n"), spare.alias("spare"), *bits, "codes", F.posexplode("codes").alias("at", "key"))
    likely = []
    for k in range(GROUP_PASSES):  # tasks of their own, which read the same shuffled facts
        some = each.where((F.pmod(F.shiftright("key", 16), F.lit(GROUP_PASSES)) == k) & (group(F.col("key")) == F.col("grp"))).drop("groups")
        full = some.select("pack", "grp", "key", F.col("id").alias("other"), F.col("n").alias("m"), *[F.col(c).alias(f"o_{c}") for c in bits], F.col("codes").alias("more"))
        likely.append(some.where("at <= spare").drop("at").join(full.hint("merge"), ["key", "pack", "grp"]).where(smaller & (lacks <= F.col("spare"))))
    both = reduce(DataFrame.unionByName, likely).select("pack", "id", "other", "n", "spare", "key", F.explode(F.array(F.array_intersect("codes", "more"))).alias("both"))  # a generator: worked out once
    near = both.where((F.size("both") >= F.col("n") - F.col("spare")) & (F.get("both", F.lit(0)) == F.col("key")))  # rarest first in both sets
    near = near.select("pack", F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"), (F.size("both") / F.col("n")).alias("share"))
    with where_dealt(own.sparkSession):
        near = written(near.where(F.col("share") >= least).withColumn("share", F.bround("share", 4)), "fact-pairs")
    return copies.unionByName(near)


def _rarest_codes(own: DataFrame) -> Column:
    """The column ``stems`` of ``own`` as numbers, one for each distinct stem of all, about by rarity.

    A number is the stem's hash. Of stems whose hashes fall together all but the first have numbers of their own below 0; if
    these are more than CODES_APART, hashes of 63 bits are taken.
    """
    stems = written(own.select(F.explode("stems").alias("stem")).groupBy("stem").agg(F.count("*").alias("df")), "stems")
    for hashed in (lambda w: F.hash(w).bitwiseAND(F.lit((1 << 31) - 1)), lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << 63) - 1))):
        again = stems.groupBy(hashed(F.col("stem")).alias("code")).agg(F.min("stem").alias("least"), F.count("*").alias("k")).where("k > 1")
        apart = stems.withColumn("code", hashed(F.col("stem"))).join(again.hint("merge"), "code").where("stem <> least").select("stem", "code").limit(CODES_APART + 1).collect()
        if len(apart) <= CODES_APART:
            break
    code = hashed
    if apart:
        kind = stems.select(hashed(F.col("stem")).alias("code")).schema["code"].dataType
        own_code = F.create_map(*[x for k, r in enumerate(sorted(apart)) for x in (F.lit(r.stem), F.lit(-1 - k).cast(kind))])
        code = lambda w: F.when(hashed(w).isin(*{r.code for r in apart}), F.coalesce(F.try_element_at(own_code, w), hashed(w))).otherwise(hashed(w))
    return rarest_first(stems.select(F.array(code(F.col("stem"))).alias("hashes"), "df"), F.transform("stems", code))


def _bits(hashes: Column, word: int) -> Column:
    """The ``word``-th 64 of the bits that a set's hashes set."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    mine = F.filter(hashes, lambda h: F.pmod(F.shiftright(h, 6), F.lit(BIT_WORDS)) == word)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseOR(bit(h)))


def select_facts(facts: DataFrame, limit: int, least: float = 0.6, shortest: int = 12, step: int = 500) -> DataFrame:
    """Facts (pack, id, text, weight) by weight and order, within a budget of characters, none that shares ``least`` of the
    smaller one's stems with a chosen one; (pack, id, n), numbered in the order of ids.

    A pack of any size is looked at some facts at a time: ``step``, then twice as many each time up to sixteen times as many. A
    fold over these carries what is used and the chosen facts' stems, which the budget bounds. After each round what is
    larger than the rest of the budget or near a chosen fact goes for good, so a budget that can't be filled costs no round
    for each ``step`` of what is left. A pack is done when no fact of ``shortest`` characters fits any more or none is left.
    """
    f = facts.select(F.coalesce("pack", F.lit("")).alias("pack"), F.struct((-F.col("weight")).alias("less"), "id").alias("at"), F.char_length("text").alias("size"), text.stems(F.col("text")).alias("stems"))
    f = written(f.where(F.col("size") <= limit), "facts")
    kind = "struct<used:int,chosen:array<struct<id:bigint,stems:array<string>>>>"
    state = written(f.groupBy("pack").agg(F.expr(f"cast(struct(0, array()) as {kind})").alias("state")).withColumn("last", F.expr(f"cast(null as {f.schema['at'].dataType.simpleString()})")), "fact-state")
    done = None

    def near(chosen: Column, stems: Column) -> Column:
        share = lambda c: F.try_divide(F.size(F.array_intersect(c["stems"], stems)), F.least(F.size(c["stems"]), F.size(stems)))  # noqa: E731  # a fact without stems is near none
        return F.exists(chosen, lambda c: F.coalesce(share(c) >= least, F.lit(False)))

    def take(acc: Column, x: Column) -> Column:
        grown = F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["chosen"], F.array(F.struct(x["at"]["id"].alias("id"), x["stems"].alias("stems")))).alias("chosen"))
        return F.when((acc["used"] + x["size"] <= limit) & ~near(acc["chosen"], x["stems"]), grown.cast(kind)).otherwise(acc)

    most = 16 * step
    while True:
        next_ = f.withColumn("k", F.row_number().over(W.partitionBy("pack").orderBy("at"))).where(F.col("k") <= step)
        some = next_.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("at", "size", "stems"))).alias("some"), F.max("at").alias("upto"))  # at most step
        new = state.drop("last").join(some.hint("merge"), "pack", "left").select("pack", F.when(F.col("some").isNull(), F.col("state")).otherwise(F.aggregate("some", F.col("state"), take)).alias("state"), F.coalesce(F.size("some"), F.lit(0)).alias("n"), F.col("upto").alias("last"))
        state = written(new, "fact-state")
        full = (F.col("n") < step) | (F.col("state.used") + shortest > limit)
        part = state.where(full).select("pack", "state")
        done = part if done is None else done.unionByName(part)
        state = state.where(~full).select("pack", "state", "last")
        if state.isEmpty():
            break
        able = (F.col("at") > F.col("last")) & (F.col("state.used") + F.col("size") <= limit)
        f = written(f.join(state.hint("merge"), "pack").where(able & ~near(F.col("state.chosen"), F.col("stems"))).select(*f.columns), "facts-left")
        step = min(2 * step, most)
    found = done.select("pack", F.posexplode(F.array_sort(F.transform("state.chosen", lambda c: c["id"]))).alias("n", "id"))
    return found.select("pack", "id", (F.col("n") + 1).cast("long").alias("n"))


def word_budget(notes: DataFrame, minutes: float, wpm: int = 120, least: int = 10) -> DataFrame:
    """Words for each slide of a deck, by the weight of its archetype."""
    weight = F.coalesce(*[F.when(F.col("archetype") == k, v) for k, v in TALK_WEIGHTS.items()], F.lit(1.0))
    total = F.sum("talk_weight").over(W.partitionBy("deck_id"))
    n = notes.withColumn("talk_weight", weight)
    return n.withColumn("budget", F.greatest(F.lit(least), F.bround(minutes * wpm * F.col("talk_weight") / total, 0).cast("long"))).drop("talk_weight")


def merge_notes(answers: DataFrame, slides: DataFrame) -> DataFrame:
    """A note per slide from answers (deck_id, n, text): numbers from 1 are shifted, duplicates joined, gaps listed."""
    first = F.min("n").over(W.partitionBy("deck_id"))
    a = answers.withColumn("slide_idx", F.col("n") - F.when(first >= 1, 1).otherwise(0))
    note = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ")
    return slides.select("deck_id", "slide_idx").join(a.groupBy("deck_id", "slide_idx").agg(note.alias("note")), ["deck_id", "slide_idx"], "left").withColumn("missing", F.col("note").isNull())


def trim_notes(notes: DataFrame, slack: float = 1.1) -> DataFrame:
    """Notes (deck_id, slide_idx, text, budget) with last sentences cut where most over budget, until the deck fits.

    A slide's ratio of words to budget only falls as it is cut, so the order of cuts is one sort of all possible ones;
    a first sentence always stays. Gives deck_id, slide_idx and how many sentences stay.
    """
    sentences = F.filter(F.split(F.trim("text"), r"(?<=[.!?])\s+"), lambda x: x != "")
    s = notes.select("deck_id", "slide_idx", "budget", F.posexplode(sentences).alias("at", "sentence")).withColumn("words", text.spoken_words(F.col("sentence")))
    slide, deck = W.partitionBy("deck_id", "slide_idx"), W.partitionBy("deck_id")
    s = s.withColumns({"upto": F.sum("words").over(slide.orderBy("at")), "last": F.max("at").over(slide), "total": F.sum("words").over(deck)})
    budgets = notes.groupBy("deck_id").agg(F.sum("budget").alias("allowed"))
    s = s.join(budgets.hint("merge"), "deck_id").withColumn("ratio", F.col("upto") / F.col("budget"))
    order = deck.orderBy(F.desc("cuttable"), F.desc("ratio"), "slide_idx", F.desc("at"))
    s = s.withColumn("cuttable", F.col("at") > 0).withColumn("before", F.sum(F.when(F.col("cuttable"), F.col("words")).otherwise(0)).over(order) - F.when(F.col("cuttable"), F.col("words")).otherwise(0))
    gone = F.col("cuttable") & (F.col("total") - F.col("before") > slack * F.col("allowed"))
    return s.groupBy("deck_id", "slide_idx").agg(F.count_if(~gone).alias("stay"), F.count_if(gone).alias("cut"))


def clean_note(c: Column) -> Column:
    """Without control characters, stage directions in brackets, markup marks and a speaker's prefix."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    c = F.regexp_replace(c, r"\[[^\]]*\]|\([^)]*\)", " ")
    c = F.regexp_replace(c, r"[*_#`>]+", "")
    c = F.regexp_replace(c, r"^\s*[\p{L}]+:\s*", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def talk_timing(notes: DataFrame, wpm: int = 120) -> DataFrame:
    """Seconds per slide and per deck."""
    w = notes.select("deck_id", "slide_idx", text.spoken_words(F.col("text")).alias("words"))
    return w.withColumns({"seconds": F.bround(F.col("words") * 60 / wpm, 0).cast("long"), "deck_seconds": F.bround(F.sum("words").over(W.partitionBy("deck_id")) * 60 / wpm, 0).cast("long")})
