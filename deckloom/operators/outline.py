"""Outlines: repair of semi-structured answers, conversions between kinds of data, splitting and grounding."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text

LIST_ALIASES = ("bullets", "cards", "items", "points", "columns")
PICTURE_ARCHETYPES, TEXT_ARCHETYPES, FRAME_ARCHETYPES = ("image_text", "image_full"), ("bullets", "cards", "two_column"), ("title", "closing")


def normalize(answers: DataFrame, archetypes: tuple[str, ...], most: int = 6, most_kpis: int = 4, kpi_chars: int = 12) -> DataFrame:
    """(…, title, archetype, bullets, kpis, repairs) from the JSON text ``raw``.

    Lists may have other names or lie under ``content``; a single text becomes a list; unknown archetypes become bullets. Of
    key numbers ({value, label}) the first ``most_kpis`` stay; one whose value is wordy becomes a bullet.
    """
    kind = "array<string>"
    get = lambda path: F.get_json_object("raw", path)
    as_list = lambda path: F.when(get(path).startswith("["), F.from_json(get(path), kind)).when(get(path).isNotNull(), F.array(get(path)))
    listed = F.coalesce(*[as_list(f"$.{a}") for a in LIST_ALIASES], *[as_list(f"$.content.{a}") for a in LIST_ALIASES], F.array().cast(kind))
    pair = lambda x: F.concat(F.coalesce(x["value"], F.lit("")), F.lit(" "), F.coalesce(x["label"], F.lit("")))
    numbers = F.coalesce(F.from_json(get("$.kpis"), "array<struct<value:string,label:string>>"), F.array().cast("array<struct<value:string,label:string>>"))
    wordy = F.transform(F.filter("numbers", lambda x: F.char_length(x["value"]) > kpi_chars), pair)
    short = F.transform(F.filter("numbers", lambda x: F.char_length(x["value"]) <= kpi_chars), pair)
    given = answers.withColumn("numbers", numbers).withColumns({"found": F.concat(listed, wordy), "short": short, "wordy": F.size(wordy)})
    known = F.coalesce(get("$.archetype"), F.lit("bullets"))
    repairs = F.array_compact(F.array(
        F.when(get("$.bullets").isNull() & (F.size(listed) > 0), "alias"), F.when(get("$.bullets").isNotNull() & ~get("$.bullets").startswith("["), "scalar"),
        F.when(~known.isin(*archetypes), "archetype"), F.when(F.size("found") > most, "cut"), F.when(get("$.title").isNull(), "no_title"),
        F.when(F.col("wordy") > 0, "wordy_kpi"), F.when(F.size("short") > most_kpis, "cut_kpis"),
    ))
    return given.select(
        *[c for c in answers.columns if c != "raw"], F.coalesce(get("$.title"), F.lit("")).alias("title"), F.when(known.isin(*archetypes), known).otherwise("bullets").alias("archetype"),
        F.slice("found", 1, most).alias("bullets"), F.slice("short", 1, most_kpis).alias("kpis"), repairs.alias("repairs"),
    )


def add_frames(outline: DataFrame) -> DataFrame:
    """Slides (outline_id, idx, archetype, title), numbered anew from 0, with a title slide before and a closing one
    behind where they lack; repair names what was added."""
    keys = ["outline_id", "idx", "archetype", "title"]
    o = outline.select(*keys, F.lit("").alias("repair"))
    g = outline.groupBy("outline_id").agg(F.min_by("archetype", "idx").alias("head"), F.max_by("archetype", "idx").alias("tail"), F.min_by("title", "idx").alias("title"), F.min("idx").alias("low"), F.max("idx").alias("high"))
    before = g.where("head <> 'title'").select("outline_id", (F.col("low") - 1).alias("idx"), F.lit("title").alias("archetype"), "title", F.lit("added_title").alias("repair"))
    behind = g.where("tail <> 'closing'").select("outline_id", (F.col("high") + 1).alias("idx"), F.lit("closing").alias("archetype"), F.lit("").alias("title"), F.lit("added_closing").alias("repair"))
    found = o.unionByName(before).unionByName(behind)
    return found.withColumn("idx", (F.row_number().over(W.partitionBy("outline_id").orderBy("idx")) - 1).cast("long"))


def normalize_data(answers: DataFrame) -> DataFrame:
    """Charts and tables of answers: (…, what, n_series, n_points, n_rows, total).

    Series come as a map of lists or as a list of {name, values}; numbers may be texts such as "1 250" or "−89 %". Series are
    cut to the shortest of them and of the categories; total sums what is left.
    """
    raw = lambda path: F.get_json_object("raw", path)
    as_map = F.from_json(raw("$.series"), "map<string,array<string>>")
    as_list = F.from_json(raw("$.series"), "array<struct<name:string,values:array<string>>>")
    series = F.when(raw("$.series").startswith("{"), F.map_values(as_map)).when(raw("$.series").startswith("["), F.transform(as_list, lambda x: x["values"]))
    categories = F.from_json(raw("$.categories"), "array<string>")
    rows = F.from_json(raw("$.rows"), "array<array<string>>")
    points = F.array_min(F.concat(F.transform(F.col("series"), lambda v: F.size(v)), F.array(F.size(categories))))
    values = F.flatten(F.transform("series", lambda v: F.transform(F.slice(v, F.lit(1), F.col("n_points")), lambda x: F.coalesce(text.parse_number(x), F.lit(0.0)))))
    found = answers.withColumn("series", series).withColumns({"rows": rows, "n_points": points})
    return found.where("series is not null or rows is not null").select(
        *[c for c in answers.columns if c != "raw"], F.when(F.col("series").isNotNull(), "chart").otherwise("table").alias("what"), F.when(F.col("series").isNotNull(), F.size("series")).cast("long").alias("n_series"), F.col("n_points").cast("long").alias("n_points"),
        F.when(F.col("rows").isNotNull(), F.size("rows")).cast("long").alias("n_rows"), F.bround(F.aggregate(values, F.lit(0.0), lambda x, y: x + y), 2).alias("total"),
    )


def unknown_references(docs: DataFrame, known: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, name) of names that a text mentions and ``known`` (name) lacks."""
    said = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 0))).alias("name"))
    return said.join(known.select("name").distinct().hint("merge"), "name", "left_anti").select("doc_id", "name")


def sanitize(charts: DataFrame) -> DataFrame:
    """Points (deck_id, series, at, value) of series without missing values, all cut to the shortest one left."""
    ok = charts.groupBy("deck_id", "series").agg(F.count("*").alias("n"), F.count("value").alias("full")).where("n = full")
    least = ok.groupBy("deck_id").agg(F.min("n").alias("least"))
    return charts.join(ok.select("deck_id", "series"), ["deck_id", "series"]).join(least, "deck_id").where("at < least").select("deck_id", "series", "at", "value")


def drop_bare(outline: DataFrame, structural: tuple[str, ...] = ("title", "section", "closing")) -> DataFrame:
    """Slides without content are left out, unless the outline would be empty."""
    bare = ~F.col("archetype").isin(*structural) & (F.size("bullets") == 0)
    left = F.count_if(~F.col("bare")).over(W.partitionBy("outline_id"))
    return outline.withColumn("bare", bare).withColumn("left", left).where("not bare or left = 0").drop("bare", "left")


def chart_to_table(charts: DataFrame, years: list[int]) -> DataFrame:
    """A row per series, a column per year."""
    return charts.groupBy("deck_id", "series").pivot("year", years).agg(F.first("value")).select("deck_id", "series", *[F.col(str(y)).alias(f"y{y}") for y in years])


def chart_to_kpis(charts: DataFrame, most: int = 4) -> DataFrame:
    """The last value of each of the first ``most`` series."""
    last = charts.groupBy("deck_id", "series").agg(F.max_by("value", "year").alias("value"))
    return last.withColumn("k", F.row_number().over(W.partitionBy("deck_id").orderBy("series"))).where(F.col("k") <= most)


def table_to_chart(cells: DataFrame) -> DataFrame:
    """(table_id, col, n, total) of columns all cells of which are numbers; headers of differences are left out."""
    n = text.parse_number(F.col("cell"))
    c = cells.groupBy("table_id", "col").agg(F.bool_and(n.isNotNull()).alias("ok"), F.count("*").alias("n"), F.bround(F.sum(n), 4).alias("total"))
    return c.where(F.col("ok") & ~F.lower("col").rlike("delta|diff|Δ")).drop("ok")


def table_to_bullets(cells: DataFrame) -> DataFrame:
    """A bullet per row, its cells in order of columns."""
    b = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "cell"))), lambda x: x["cell"]), ": ")
    return cells.groupBy("table_id", "row").agg(b.alias("bullet"))


def kpis_to_table(kpis: DataFrame) -> DataFrame:
    """Key numbers (deck_id, series, value, k) as rows of a table of two columns, header first."""
    cells = kpis.select("deck_id", F.col("k").cast("long").alias("row"), F.array("series", text.format_number(F.col("value").cast("double"))).alias("cells"))
    head = kpis.select("deck_id").distinct().select("deck_id", F.lit(0).cast("long").alias("row"), F.array(F.lit("name"), F.lit("value")).alias("cells"))
    return head.unionByName(cells).select("deck_id", "row", F.array_join("cells", " | ").alias("cells"))


def kpis_to_cards(kpis: DataFrame) -> DataFrame:
    """Key numbers as cards "value — name", in their order."""
    return kpis.select("deck_id", "k", F.concat(text.format_number(F.col("value").cast("double")), F.lit(" — "), "series").alias("card"))


def choose_form(slides: DataFrame, strategies: DataFrame) -> DataFrame:
    """P10: for each slide with data and each strategy the form the data take.

    ``slides`` has n_series and n_points, ``strategies`` name, data ("charts", "tables", "numbers" or "text"); three rows.
    """
    both = slides.crossJoin(F.broadcast(strategies))
    form = F.when(F.col("data") == "tables", "table").when((F.col("data") == "numbers") & (F.col("n_series") <= 4), "kpi").when((F.col("data") == "text") & (F.col("n_series") * F.col("n_points") <= 6), "bullets").otherwise("chart")
    return both.withColumn("form", form).drop("data")


def split_mixed(slides: DataFrame) -> DataFrame:
    """Slides (deck_id, idx, n_kpis, has_data) with numbers beside data become two, numbered anew."""
    parts = F.when((F.col("n_kpis") > 0) & F.col("has_data"), F.array(F.struct(F.lit(0).alias("part"), F.lit("data").alias("what")), F.struct(F.lit(1).alias("part"), F.lit("kpis").alias("what")))).otherwise(F.array(F.struct(F.lit(0).alias("part"), F.lit("all").alias("what"))))
    s = slides.select("deck_id", "idx", F.inline(parts))
    return s.withColumn("new_idx", (F.row_number().over(W.partitionBy("deck_id").orderBy("idx", "part")) - 1).cast("long"))


def split_dense(outline: DataFrame, most: int = 6) -> DataFrame:
    """Slides with too many bullets in even parts (…, part, title, n, keeps_data); data of a slide (has_data) stay with its
    first part."""
    n = F.size("bullets")
    of = F.when(F.col("archetype") == "agenda", 1).otherwise(F.greatest(F.lit(1), F.ceil(n / most))).cast("int")
    size = F.ceil(n / F.col("of")).cast("int")
    data = F.coalesce("has_data", F.lit(False)) if "has_data" in outline.columns else F.lit(False)
    parts = outline.withColumn("of", of).select("outline_id", "idx", "title", "of", data.alias("data"), n.alias("all"), size.alias("size"), F.explode(F.sequence(F.lit(1), F.col("of"))).alias("part"))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("all") - (F.col("part") - 1) * F.col("size")))
    title = F.when(F.col("of") > 1, F.concat("title", F.lit(" ("), F.col("part").cast("string"), F.lit("/"), F.col("of").cast("string"), F.lit(")"))).otherwise(F.col("title"))
    return parts.select("outline_id", "idx", F.col("part").cast("long").alias("part"), title.alias("title"), rest.cast("long").alias("n"), (F.col("data") & (F.col("part") == 1)).alias("keeps_data"))


def split_kpis(slides: DataFrame, room: int, capacity: int = 4) -> DataFrame:
    """Slides (deck_id, idx, n_kpis) over capacity are split while the deck has room for further slides.

    Extra slides are granted in order until the room is used up: a running sum, the last grant cut to what is left.
    """
    want = F.greatest(F.lit(0), F.ceil(F.col("n_kpis") / capacity).cast("int") - 1)
    before = F.coalesce(F.sum("want").over(W.partitionBy("deck_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return slides.withColumn("want", want).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("want"), room - before)).cast("long")).drop("want")


def to_process(outline: DataFrame, strategies: DataFrame, available: DataFrame, low: int = 2, high: int = 6, most: int = 200) -> DataFrame:
    """For each slide and strategy (name, diagrams) whether its bullets become a process diagram.

    They do where the strategy asks for diagrams, there are two to six of them and none is long, the slide has no other
    data (has_data), and ``available`` (archetype) has process slides.
    """
    n = F.size("bullets")
    able = available.where("archetype = 'process'").limit(1).select(F.lit(True).alias("able"))  # one row or none
    fits = n.between(low, high) & F.forall("bullets", lambda b: F.char_length(b) <= most) & ~F.col("has_data")
    both = outline.crossJoin(F.broadcast(strategies)).join(F.broadcast(able), F.lit(True), "left")  # some strategies
    return both.withColumn("process", F.col("diagrams") & F.coalesce("able", F.lit(False)) & fits).drop("diagrams", "able")


def section_dividers(slides: DataFrame, section: str = "section") -> DataFrame:
    """A divider before each slide whose section differs from the one before, numbered anew."""
    w = W.partitionBy("deck_id").orderBy("idx")
    s = slides.select("deck_id", "idx", F.col(section).alias("section"), (F.col(section) != F.lag(section).over(w)).alias("new"))
    two = F.when(F.coalesce("new", F.lit(True)), F.array(F.struct(F.lit(0).alias("part"), F.lit("section").alias("kind")), F.struct(F.lit(1).alias("part"), F.lit("slide").alias("kind")))).otherwise(F.array(F.struct(F.lit(1).alias("part"), F.lit("slide").alias("kind"))))
    e = s.select("deck_id", "idx", "section", F.inline(two))
    return e.select("deck_id", "idx", "section", "kind", (F.row_number().over(W.partitionBy("deck_id").orderBy("idx", "part")) - 1).cast("long").alias("new_idx"))


def without_dividers(slides: DataFrame) -> DataFrame:
    """Slides (deck_id, idx, archetype) without section slides, numbered anew."""
    left = slides.where("archetype <> 'section'")
    return left.withColumn("new_idx", (F.row_number().over(W.partitionBy("deck_id").orderBy("idx")) - 1).cast("long"))


def size_report(outline: DataFrame, low: int, high: int) -> DataFrame:
    """Outlines outside the range, with the slide to split (most bullets) or the neighbours to merge (fewest in sum)."""
    w = W.partitionBy("outline_id")
    n = F.size("bullets")
    o = outline.select("outline_id", "idx", n.alias("n")).withColumns({"slides": F.count("*").over(w), "pair": F.col("n") + F.lead("n").over(w.orderBy("idx"))})
    g = o.groupBy("outline_id").agg(F.max("slides").alias("slides"), F.max(F.struct("n", (-F.col("idx")).alias("less"))).alias("big"), F.min(F.when(F.col("pair").isNotNull(), F.struct("pair", "idx"))).alias("small"))
    return g.where((F.col("slides") < low) | (F.col("slides") > high)).select("outline_id", "slides", F.when(F.col("slides") < low, "split").otherwise("merge").alias("what"), F.when(F.col("slides") < low, -F.col("big.less")).otherwise(F.col("small.idx")).alias("idx"))


#: Archetypes whose slides can become cards, and those that lose by it and come last.
MERGEABLE, MERGE_LAST = ("bullets", "two_column", "cards", "process", "kpi", "quote"), ("kpi", "quote")


def size_repairs(slides: DataFrame, low: int, high: int, most: int = 6, least_split: int = 4) -> DataFrame:
    """Outlines outside the range, with a row (outline_id, slides, what, idx) for each repair that can be tried.

    Too many slides: ``drop_section`` (the divider of the shortest section, the last of several), ``merge`` (the first
    neighbours of one kind of text each whose items fit on one slide, neither key numbers nor a quote) and ``merge_lossy``
    (the same with these). Too few: ``extract_kpis`` (the first slide with key numbers beside other content) and ``split``
    (the text slide with most bullets, of at least ``least_split``; the last of several). Outlines without any repair have one
    row with ``none``. ``slides`` has outline_id, idx, archetype, n_bullets, n_kpis, n_steps, n_paragraphs, has_quote,
    has_data (chart or table) and has_picture.
    """
    c, w = F.col, W.partitionBy("outline_id").orderBy("idx")
    n = {k: F.coalesce(c(k), F.lit(0)) for k in ("n_bullets", "n_steps", "n_kpis", "n_paragraphs")}
    kinds = sum((F.when(v > 0, 1).otherwise(0) for v in n.values()), F.when(c("has_quote"), 1).otherwise(0))
    items = F.when(n["n_bullets"] > 0, n["n_bullets"]).when(n["n_steps"] > 0, n["n_steps"]).when(n["n_kpis"] > 0, n["n_kpis"]).when(c("has_quote"), 1).otherwise(n["n_paragraphs"])
    able = ~c("has_data") & F.when(c("archetype") == "image_text", ~c("has_picture")).otherwise(c("archetype").isin(*MERGEABLE)) & (kinds == 1)
    text_only = c("archetype").isin(*MERGEABLE) & (n["n_bullets"] >= least_split) & (n["n_kpis"] == 0) & (n["n_steps"] == 0) & ~c("has_data") & ~c("has_picture") & ~c("has_quote")
    mixed = (n["n_kpis"] > 0) & ((n["n_bullets"] > 0) | c("has_data")) & (c("archetype") != "kpi")
    s = slides.select("outline_id", "idx", F.struct(able.alias("able"), items.alias("items"), c("archetype").isin(*MERGE_LAST).alias("late")).alias("me"), mixed.alias("mixed"), F.when(text_only, n["n_bullets"]).alias("long"), (c("archetype") == "section").alias("divider"))
    s = s.withColumns({"other": F.lead("me").over(w), "at": F.row_number().over(w), "slides": F.count("*").over(W.partitionBy("outline_id"))})
    s = s.where((c("slides") < low) | (c("slides") > high))
    end = F.coalesce(F.min(F.when(c("divider"), c("at"))).over(w.rowsBetween(1, W.unboundedFollowing)), c("slides") + 1)  # where the next section begins
    s = s.withColumn("length", F.when(c("divider"), end - c("at")))
    fit = F.coalesce(c("me.able") & c("other.able") & (c("me.items") + c("other.items") <= most), F.lit(False))
    plain = fit & ~c("me.late") & ~c("other.late")
    many = c("slides") > high
    best = s.groupBy("outline_id", "slides").agg(
        F.min(F.when(c("divider"), F.struct("length", (-c("at")).alias("late"), "idx"))).alias("section"), F.min(F.when(plain, c("idx"))).alias("merge"),
        F.min(F.when(fit & ~plain, c("idx"))).alias("lossy"), F.min(F.when(c("mixed"), c("idx"))).alias("kpis"), F.max(F.when(c("long").isNotNull(), F.struct("long", "at", "idx"))).alias("split"),
    )
    row = lambda what, idx, when: F.when(when & idx.isNotNull(), F.struct(F.lit(what).alias("what"), idx.cast("long").alias("idx")))
    rows = F.array_compact(F.array(row("drop_section", c("section.idx"), many), row("merge", c("merge"), many), row("merge_lossy", c("lossy"), many), row("extract_kpis", c("kpis"), ~many), row("split", c("split.idx"), ~many)))
    nothing = F.array(F.struct(F.lit("none").alias("what"), F.lit(None).cast("long").alias("idx")))
    return best.select("outline_id", "slides", F.inline(F.when(F.size(rows) > 0, rows).otherwise(nothing)))


def image_candidates(outline: DataFrame, most: int = 4) -> DataFrame:
    """The first slides for a picture: archetypes made for one, slides that ask for one (wants_image), then texts, then
    frames. Slides with data (has_data) are passed over."""
    rank = F.when(F.col("archetype").isin(*PICTURE_ARCHETYPES), 0).when(F.col("wants_image"), 1).when(F.col("archetype").isin(*TEXT_ARCHETYPES), 2).when(F.col("archetype").isin(*FRAME_ARCHETYPES), 3)
    o = outline.where(~F.col("has_data")).withColumn("rank", rank).where("rank is not null")
    return o.withColumn("k", F.row_number().over(W.partitionBy("outline_id").orderBy("rank", "idx"))).where(F.col("k") <= most).select("outline_id", "k", "idx", "rank")


def ungrounded(items: DataFrame, sources: DataFrame, group: str) -> DataFrame:
    """Items (group, item_id, text) with digit groups that no source text of their group has."""
    digits = lambda df: F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)))
    said = items.select(group, "item_id", digits(items).alias("number"))
    there = sources.select(group, digits(sources).alias("number")).distinct()
    return said.join(there.hint("merge"), [group, "number"], "left_anti").groupBy(group, "item_id").agg(F.count("*").alias("missing"))


#: Archetypes that a slide keeps only with data.
DATA_ARCHETYPES = ("kpi", "chart", "table")


def ground_outline(slides: DataFrame, sources: DataFrame, group: str, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(slides, warnings): ``slides`` without data whose numbers no source text of their group has.

    ``slides`` has outline_id, idx, archetype, bullets, kpis (array of value and label), chart (array of series with name and
    points of category and value, as texts) and table (rows of cells). Key numbers of which one is invented become bullets
    of their labels, a chart bullets of its series (``most`` at most), each where the slide has no bullets; a table goes. A
    slide of key numbers, a chart or a table that has none of these left is one of bullets. What has no digits stays.
    Warnings are (group, outline_id, idx, part), a row for each that went. A null group has no sources of its own but
    those of null groups; empty data are nothing to go.
    """
    key = ["outline_id", "idx"]
    numbers = lambda x: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[0-9]+"), F.lit(0))
    none = F.array().cast("array<string>")
    of = {
        "kpi": F.flatten(F.transform("kpis", lambda k: numbers(k["value"]))),
        "chart": F.flatten(F.flatten(F.transform("chart", lambda s: F.transform(s["points"], lambda p: numbers(p["value"]))))),
        "table": F.flatten(F.flatten(F.transform("table", lambda r: F.transform(r, numbers)))),
    }
    theirs = F.coalesce(F.col(group).cast("string"), F.lit(""))
    said = slides.select(theirs.alias("grp"), *key, F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.array_distinct(F.coalesce(v, none)).alias("numbers")) for p, v in of.items()])))
    said = said.select("grp", *key, "part", F.explode("numbers").alias("number"))
    known = sources.select(theirs.alias("grp"), F.explode(F.array_distinct(numbers(F.col("text")))).alias("number")).distinct()
    bad = said.join(known.hint("merge"), ["grp", "number"], "left_anti").groupBy("grp", *key).agg(F.collect_set("part").alias("parts"))  # three parts
    s = slides.withColumn("grp", theirs).join(bad.hint("merge"), ["grp", *key], "left").withColumn("parts", F.coalesce("parts", none))
    gone = lambda p: F.array_contains("parts", p)
    empty = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    labels = F.filter(F.transform("kpis", lambda k: k["label"]), lambda x: F.coalesce(x, F.lit("")) != "")
    told = F.transform(F.filter("chart", lambda c: F.size(c["points"]) > 0), lambda c: F.concat(c["name"], F.lit(": "), F.array_join(F.transform(c["points"], lambda p: F.concat_ws(" — ", p["category"], p["value"])), ", ")))
    s = s.withColumn("bullets", F.when(gone("kpi") & empty(F.col("bullets")), labels).otherwise(F.col("bullets")))
    s = s.withColumn("bullets", F.when(gone("chart") & empty(F.col("bullets")), F.slice(told, 1, most)).otherwise(F.col("bullets")))
    s = s.withColumns({c: F.when(~gone(p), F.col(c)) for p, c in (("kpi", "kpis"), ("chart", "chart"), ("table", "table"))})
    bare = F.col("archetype").isin(*DATA_ARCHETYPES) & empty(F.col("kpis")) & empty(F.col("chart")) & empty(F.col("table"))
    s = s.withColumn("archetype", F.when(bare, "bullets").otherwise(F.col("archetype")))
    return s.select(*slides.columns), bad.select(F.col("grp").alias("group"), *key, F.explode("parts").alias("part"))


def bloat(lines: DataFrame, key: str, limit: float = 2.0) -> DataFrame:
    """How many keys have each number of rows, and which exceed the limit times the mean number of rows."""
    n = lines.groupBy(key).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("keys"))
    total = n.agg((F.sum(F.col("n") * F.col("keys")) / F.sum("keys")).alias("mean"))  # one row
    return n.crossJoin(F.broadcast(total)).select("n", "keys", (F.col("n") > limit * F.col("mean")).alias("over"))


#: Separators before a tail, in the order they are tried, and those after a lead; what may not end a head; the
#: least share of the room that a head fills; the least length of a lead; words that may not hang before an ellipsis, and
#: words before which a title may end.
TAIL_SEPARATORS, LEAD_SEPARATORS, HEAD_ENDS = (" — ", " – ", ": ", "; ", ", ", " ("), (" — ", " – ", ": "), " ,;:—–("
HEAD_SHARE, LEAST_LEAD = 0.3, 5
DANGLING_WORDS = (
    "с", "со", "и", "в", "во", "на", "для", "по", "к", "ко", "о", "об", "от", "до", "из", "у", "а", "но", "или", "за", "при", "без", "над", "под", "через", "что", "как", "не",
    "a", "an", "the", "of", "for", "and", "or", "to", "in", "on", "with", "by", "at", "from",
)
PHRASE_BREAKS = (
    "и", "с", "со", "для", "на", "в", "во", "как", "при", "без", "через", "или", "за", "от", "до", "из",
    "and", "with", "for", "in", "on", "via", "as", "without", "through", "or",
)


def _head(most: int, lazy: bool) -> str:
    """A head of the least, or most, characters that fits the room and ends in none of HEAD_ENDS."""
    least = max(math.ceil(most * HEAD_SHARE), 1)
    return f"(.{{{least - 1},{most - 1}}}{'?' if lazy else ''}[^{HEAD_ENDS}])[{HEAD_ENDS}]*{'?' if lazy else ''}"


def _cut_tail(t: Column, most: int) -> Column:
    """The first head before a separator that fits, by the order of separators; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, f"^{_head(most, True)}(?={re.escape(sep)})", 1), F.lit("")) for sep in TAIL_SEPARATORS])


def _cut_words(t: Column, most: int) -> Column:
    """Whole words and an ellipsis, without words that hang; texts of two words stay as they are."""
    room = F.substring(t, 1, most)
    cut = F.when(room.contains(" "), F.regexp_replace(room, " [^ ]*$", "")).otherwise(F.regexp_extract(t, "^[^ ]*", 0))
    cut = F.regexp_replace(cut, f"(?iu)( (?:{'|'.join(DANGLING_WORDS)})[,;:]*)+$", "")
    return F.when(F.size(F.split(t, " ")) <= 2, t).otherwise(F.concat(F.regexp_replace(cut, f"[{HEAD_ENDS}]+$", ""), F.lit("…")))


def shorten(c: Column, most: int) -> Column:
    """A text in ``most`` characters: without its tail behind a separator, else whole words and an ellipsis."""
    t = text.squeezed(c)
    return F.when(F.char_length(t) <= most, t).otherwise(F.coalesce(_cut_tail(t, most), _cut_words(t, most)))


def shorten_title(c: Column, most: int) -> Column:
    """A title in ``most`` characters: without its tail, else its lead, else up to a word that begins a further phrase (the
    last one that leaves two words or more), else whole words and an ellipsis."""
    t = text.squeezed(c)
    leads = [F.regexp_replace(F.substring_index(t, sep, 1), f"[{HEAD_ENDS}]+$", "") for sep in LEAD_SEPARATORS]
    lead = F.coalesce(*[F.when(t.contains(sep) & F.char_length(x).between(LEAST_LEAD, most), x) for sep, x in zip(LEAD_SEPARATORS, leads)])
    phrase = f"(?iu)^({_head(most, False)}) (?:{'|'.join(PHRASE_BREAKS)})(?= |$)"
    before = F.when(F.regexp_extract(t, phrase, 1).contains(" "), F.regexp_extract(t, phrase, 2))
    return F.when(F.char_length(t) <= most, t).otherwise(F.coalesce(_cut_tail(t, most), lead, before, _cut_words(t, most)))


def shorten_words(c: Column, most: int, slack: int = 3) -> Column:
    """At most ``most`` words; a few more are let pass."""
    w = text.words(c)
    return F.when(F.size(w) <= most + slack, F.array_join(w, " ")).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("…")))


def number_and_unit(c: Column) -> tuple[Column, Column]:
    """The number that a text begins with, and what follows."""
    pattern = r"^\s*([-−+×x]?[0-9]+(?:[.,][0-9]+)?)\s*(.*)$"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)


def label_and_body(c: Column, within: int = 60) -> tuple[Column, Column]:
    """A label before a dash or colon among the first characters, and the rest; no label: empty."""
    pattern = rf"^([^:–—]{{1,{within}}})(?::\s| – | — )(.*)$"
    label = F.regexp_extract(c, pattern, 1)
    return F.trim(label), F.when(label == "", c).otherwise(F.regexp_extract(c, pattern, 2))


def fit_scale(chars: Column, w: Column, h: Column, size: Column) -> Column:
    """The first step at which a text fits its box, by average widths; the last one if none does."""
    steps = F.array(*[F.lit(s) for s in (1.0, 0.9, 0.8, 0.7, 0.6, 0.55)])
    fits = F.filter(steps, lambda s: 0.9 * F.floor(w / 12700 / (0.5 * size * s)) * F.floor(h / 12700 / (1.2 * size * s)) >= chars)
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(0.55))
