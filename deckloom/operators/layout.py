"""What a slide is made of: features, archetype scores, slots; and the choice of a template slide for a content slide."""

from __future__ import annotations

import pkgutil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text
from .audit import with_lines

SLIDE = ["deck_id", "slide_id", "slide_idx"]
#: Text archetypes, between which a strategy chooses, and penalties.
FLEXIBLE, FLEX_PENALTY = ("bullets", "cards", "two_column", "image_text"), 2.0
RANK_PENALTY, REUSE_PENALTY, REUSE_MAX = 4.0, 2.0, 3


def title_choice(shapes: DataFrame, ratio: float = 1.15, short: int = 80, band: float = 0.3, slide_h: int = geo.SLIDE_H) -> DataFrame:
    """A slide's first title placeholder; else the largest short text in the upper part (anywhere on the first slide), if
    larger than the others' median."""
    t = shapes.where("tag = 'sp'")
    held = F.col("placeholder") == "title"
    own = t.where(held).groupBy(*SLIDE).agg(F.min(F.struct("z", "size_pt")).alias("t")).select(*SLIDE, "t.z", "t.size_pt", F.lit(None).cast("double").alias("median"))
    free = t.join(own.select("slide_id"), "slide_id", "left_anti")
    ok = (F.col("chars") <= short) & ((F.col("slide_idx") == 0) | (F.col("y") < band * slide_h))
    best = free.where(ok).groupBy(*SLIDE).agg(F.max(F.struct("size_pt", (-F.col("y")).alias("up"), (-F.col("z")).alias("low"))).alias("t"))
    rest = free.join(best.select("slide_id", (-F.col("t.low")).alias("title_z")), "slide_id").where("z <> title_z").groupBy("slide_id").agg(F.median("size_pt").alias("median"))
    found = best.join(rest, "slide_id", "left")
    found = found.where(F.col("median").isNull() | (F.col("t.size_pt") >= ratio * F.col("median"))).select(*SLIDE, (-F.col("t.low")).alias("z"), F.col("t.size_pt").alias("size_pt"), "median")
    return own.unionByName(found)


#: Outlines of shapes that are connectors, arrows and round marks.
LINES = ("line", "straightConnector1", "bentConnector3", "curvedConnector3")
ARROWS = ("rightArrow", "leftArrow", "chevron", "homePlate", "notchedRightArrow", "curvedRightArrow", "bentArrow")
ROUND = ("ellipse", "roundRect", "round2SameRect")


def features(shapes: DataFrame, slide_w: int = geo.SLIDE_W, slide_h: int = geo.SLIDE_H) -> DataFrame:
    """Counts and shares of a slide's shapes in one aggregation.

    Numbers are short texts somewhat larger than the slide's median, or a little longer ones of twice its size. Icons are small
    and about square; connectors, arrows and round marks are told by their outline (preset).
    """
    full = slide_w * slide_h
    m = shapes.where("tag = 'sp'").groupBy("slide_id").agg(F.median("size_pt").alias("median"))
    s = shapes.join(m, "slide_id", "left")
    text_ = F.col("tag") == "sp"
    big = geo.area() / full
    number = text_ & (((F.col("chars") <= 5) & (F.col("size_pt") >= 1.3 * F.col("median"))) | ((F.col("chars") <= 6) & (F.col("size_pt") >= 2 * F.col("median"))))
    icon = (big <= 0.01) & (F.col("w") / F.col("h")).between(0.6, 1.6) & F.col("kind").isin("text", "picture")
    shaped = lambda *names: F.coalesce(F.col("preset").isin(*names), F.lit(False))
    f = s.groupBy(*SLIDE).agg(
        F.count_if(text_).alias("texts"), F.count_if(number).alias("numbers"), F.count_if(F.col("tag") == "pic").alias("pictures"),
        F.count_if(F.col("kind") == "chart").alias("charts"), F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(icon).alias("icons"),
        F.count_if(shaped(*LINES)).alias("connectors"), F.count_if(shaped(*ARROWS)).alias("arrows"), F.count_if(shaped(*ROUND) & (big <= 0.02)).alias("round_marks"),
        F.max(F.when(F.col("tag") == "pic", F.bround(big, 4)).otherwise(0.0)).alias("big_picture"), F.max(F.when(text_, F.bround(big, 4)).otherwise(0.0)).alias("big_text"), F.max(F.when(text_, F.col("chars")).otherwise(0)).alias("longest"),
        F.max("median").alias("median"), F.bround(F.least(F.lit(1.0), F.sum(geo.area()) / full), 4).alias("fill"),
    )
    return f


def size_clusters(shapes: DataFrame, least: int = 3, tol_w: float = 0.02, tol_h: float = 0.06, slide_w: int = geo.SLIDE_W, slide_h: int = geo.SLIDE_H) -> DataFrame:
    """Groups of at least ``least`` shapes of about one size: each joins the first group whose first member is near.

    A fold over a slide's shapes, some dozens.
    """
    arr = shapes.groupBy(*SLIDE).agg(F.array_sort(F.collect_list(F.struct("w", "h", "z"))).alias("s"))
    kind = "array<struct<w:bigint,h:bigint,n:int>>"

    def step(acc: Column, x: Column) -> Column:
        near = lambda g: (F.abs(g["w"] - x["w"]) <= tol_w * slide_w) & (F.abs(g["h"] - x["h"]) <= tol_h * slide_h)
        at = F.array_position(F.transform(acc, lambda g: near(g)), F.lit(True))
        grown = F.transform(acc, lambda g, i: F.struct(g["w"].alias("w"), g["h"].alias("h"), (g["n"] + F.when(i + 1 == at, 1).otherwise(0)).alias("n")))
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(F.struct(x["w"].alias("w"), x["h"].alias("h"), F.lit(1).alias("n")))))

    found = arr.select(*SLIDE, F.inline(F.aggregate("s", F.array().cast(kind), step)))
    return found.where(F.col("n") >= least).select(*SLIDE, "w", "h", F.col("n").cast("long").alias("n"))


def axes(shapes: DataFrame, gap: float = 0.03, slide_w: int = geo.SLIDE_W, slide_h: int = geo.SLIDE_H) -> DataFrame:
    """Columns and rows of a slide (islands of left and top edges), and what they form."""
    w = lambda c: W.partitionBy("slide_id").orderBy(c, "z")
    new = lambda c, full: F.when(F.col(c) - F.lag(c).over(w(c)) <= gap * full, 0).otherwise(1)
    s = shapes.withColumns({"new_col": new("x", slide_w), "new_row": new("y", slide_h)}).groupBy(*SLIDE).agg(F.sum("new_col").alias("columns"), F.sum("new_row").alias("rows"), F.count("*").alias("n"))
    form = F.when((F.col("columns") == F.col("n")) & (F.col("rows") == F.col("n")) & (F.col("n") >= 3), "staircase").when((F.col("n") >= 12) & (F.col("columns") >= 2) & (F.col("rows") >= 4), "table").when((F.col("columns") >= 2) & (F.col("rows") >= 2), "grid").when(F.col("columns") == 1, "list").otherwise("row")
    return s.withColumn("form", form)


def number_sequence(blocks: DataFrame, tolerance: int, least: int = 3) -> DataFrame:
    """For each axis the longest run of consecutive integers (``value``) among a slide's blocks aligned with one of them:
    "row" by their middle's height, "col" by its distance from the left. (slide_id, axis, n, first)

    All of it is worked out of the array of a slide's blocks, so no pairs of rows are made or sorted.
    """
    at = {"row": F.col("y") + F.col("h") / 2, "col": F.col("x") + F.col("w") / 2}
    own = blocks.where("slide_id is not null").groupBy("slide_id").agg(F.collect_list(F.struct("z", F.col("value").cast("long").alias("value"), *[c.alias(axis) for axis, c in at.items()])).alias("own"))  # bounded: one slide's
    kind = "struct<best:struct<n:bigint,low:bigint>,n:bigint,last:bigint>"

    def step(acc: Column, v: Column) -> Column:
        n = F.when(v == acc["last"] + 1, acc["n"] + 1).otherwise(F.lit(1))
        run = F.struct(n.cast("long").alias("n"), (n - 1 - v).cast("long").alias("low"))
        return F.struct(F.greatest(acc["best"], run).alias("best"), n.alias("n"), v.alias("last")).cast(kind)

    def best(axis: str) -> Column:
        near = lambda z, b: F.exists("own", lambda a: a["z"].eqNullSafe(z) & (F.abs(a[axis] - b[axis]) <= tolerance))
        band = lambda z: F.array_sort(F.array_distinct(F.array_compact(F.transform(F.filter("own", lambda b: near(z, b)), lambda b: b["value"]))))
        start = F.expr(f"cast(struct(struct(0L, null), 0L, null) as {kind})")
        return F.array_max(F.transform(F.array_distinct(F.transform("own", lambda a: a["z"])), lambda z: F.aggregate(band(z), start, step)["best"]))

    found = own.select("slide_id", F.inline(F.array(*[F.struct(F.lit(axis).alias("axis"), best(axis).alias("best")) for axis in at])))
    return found.where(F.col("best.n") >= least).select("slide_id", "axis", F.col("best.n").alias("n"), (-F.col("best.low")).alias("first"))


def drawn_bars(shapes: DataFrame, least: int = 5, kinds: int = 3) -> DataFrame:
    """Shapes that look like a bar chart: columns of equal width on a common lower edge with several heights, or bars of
    equal height from a common left edge with several widths. (slide_id, form, size, edge, n, kinds)"""
    step = lambda c: geo.stepped(c)
    upright = shapes.groupBy("slide_id", F.lit("columns").alias("form"), step(F.col("w")).alias("size"), step(F.col("y") + F.col("h")).alias("edge")).agg(F.count("*").alias("n"), F.countDistinct("h").alias("kinds"))
    lying = shapes.groupBy("slide_id", F.lit("bars").alias("form"), step(F.col("h")).alias("size"), step(F.col("x")).alias("edge")).agg(F.count("*").alias("n"), F.countDistinct("w").alias("kinds"))
    return upright.unionByName(lying).where((F.col("n") >= least) & (F.col("kinds") >= kinds))


def enclosing_frames(shapes: DataFrame) -> DataFrame:
    """For each text its smallest larger shape on the slide that contains its centre."""
    a, b = shapes.where("tag = 'sp'").alias("a"), shapes.alias("b")
    on = (F.col("a.slide_id") == F.col("b.slide_id")) & (F.col("a.z") != F.col("b.z")) & (geo.area("b") > geo.area("a")) & geo.center_in("a", "b")
    best = a.join(b, on).groupBy("a.deck_id", "a.slide_id", "a.slide_idx", "a.z").agg(F.min(F.struct(geo.area("b").alias("area"), F.col("b.z").alias("z"))).alias("f"))
    return best.select("deck_id", "slide_id", "slide_idx", "z", F.col("f.z").alias("frame_z"))


def photo_zones(shapes: DataFrame, short: int = 25) -> DataFrame:
    """Places for pictures: for each short prompt for a photo its smallest enclosing shape, which is the zone while the
    prompt is decoration, or the prompt itself where none encloses it. (slide, z, zone_z)"""
    prompts = shapes.where((F.col("tag") == "sp") & (F.char_length("text") <= short) & text.is_photo_prompt(F.col("text"))).select(*SLIDE, "z")
    frames = enclosing_frames(shapes).select("slide_id", "z", "frame_z")
    return prompts.join(frames, ["slide_id", "z"], "left").select(*SLIDE, "z", F.coalesce("frame_z", "z").alias("zone_z"))


def archetype_scores(f: DataFrame) -> DataFrame:
    """(slide, archetype, score) out of features, title and axes; scores are capped at 1, those of 0 or less dropped.

    ``f`` has the columns of ``features`` and of ``axes``, has_title, n_slides, and keyword flags kw_agenda, kw_closing, kw_quote.
    """
    c = F.col
    one = lambda cond, v: F.when(cond, v).otherwise(0.0)
    last = c("slide_idx") >= c("n_slides") - 3
    sparse = c("texts") <= 3
    blocks = c("texts") - c("numbers") - one(c("has_title"), 1.0)
    scores = {
        "table": F.when(c("tables") > 0, 0.95).otherwise(one(c("form") == "table", 0.65)),
        "chart": one(c("charts") > 0, 0.95),
        "freeform": F.when((c("pictures") >= 30) | (c("texts") + c("pictures") + c("charts") + c("tables") == 0), 0.9).otherwise(0.3),
        "title": F.when(c("has_title"), one(c("slide_idx") == 0, 0.5) + one((c("slide_idx") > 0) & (c("slide_idx") <= 5), 0.3) + one(sparse, 0.2) - one(blocks >= 6, 0.5) - one(c("big_text") >= 0.2, 0.3)).otherwise(0.0),
        "closing": F.when(c("kw_closing"), 0.6 + one(last, 0.15) + one(c("texts") <= 4, 0.2)).when(last & sparse & c("has_title"), 0.4 + one(c("texts") <= 4, 0.2)).otherwise(0.0),
        "section": F.when(c("has_title") & (c("slide_idx") > 0) & (blocks <= 1) & (c("big_picture") < 0.25), 0.4 + one(c("numbers") > 0, 0.15)).otherwise(0.0),
        "agenda": one(c("kw_agenda"), 0.5) + one((c("form") == "list") & (c("texts") >= 4), F.least(F.lit(0.45), 0.3 + 0.05 * (c("texts") - 4)) + one((c("round_marks") >= c("texts")) | (c("icons") >= c("texts")), 0.2)),
        "kpi": F.when(c("numbers") > 0, 0.5 + 0.15 * F.least(c("numbers"), F.lit(3)) - one(c("big_picture") >= 0.25, 0.2)).otherwise(0.0),
        "process": one(c("form") == "staircase", 0.5) + one((c("form") == "row") & (c("texts") >= 3), 0.4) + F.when(c("connectors") >= 2, 0.4).when(c("connectors") == 1, 0.2).otherwise(0.0) + one(c("arrows") > 0, 0.3),
        "team": one((c("pictures") >= 2) & (c("texts") >= 2), 0.6) + one(c("pictures") >= 3, 0.1),
        "cards": F.when(c("texts") >= 3, 0.5 + F.least(F.lit(0.4), 0.1 * (c("texts") - 2)) + one(c("icons") >= c("texts"), 0.15) - one((c("connectors") > 0) | (c("arrows") > 0), 0.3) - one(c("form") == "staircase", 0.3) - one(c("big_picture") >= 0.25, 0.25) - one(c("form") == "table", 0.4)).otherwise(0.0),
        "two_column": one((c("texts") == 2) & (c("columns") == 2), 0.7),
        "bullets": F.when((c("texts") <= 2) & (c("big_text") >= 0.1), 0.7 - one(~c("has_title"), 0.3)).otherwise(0.0),
        "image_text": one((c("big_picture") >= 0.1) & (c("big_text") >= 0.05), 0.65),
        "image_full": F.when(c("big_picture") >= 0.25, 0.6 + one(c("big_picture") >= 0.5, 0.05)).otherwise(0.0),
        "quote": F.when((c("texts") == 1) & (c("longest") >= 60) & (c("big_picture") < 0.25), 0.5 + one(c("kw_quote"), 0.3) + one(~c("has_title"), 0.2)).otherwise(0.0),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(k).alias("archetype"), F.bround(F.least(F.lit(1.0), v), 2).alias("score")) for i, (k, v) in enumerate(scores.items())])
    return f.select(*SLIDE, F.inline(rows)).where("score > 0")


def pick_archetype(scores: DataFrame, sure: float = 0.7, margin: float = 0.15) -> DataFrame:
    """The best archetype (ties by order of rules), the next one, and whether the choice is doubtful."""
    w = W.partitionBy("slide_id").orderBy(F.desc("score"), "rule")
    s = scores.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy(*SLIDE).agg(
        F.max(F.when(F.col("k") == 1, F.col("archetype"))).alias("archetype"), F.max(F.when(F.col("k") == 1, F.col("score"))).alias("score"), F.max(F.when(F.col("k") == 2, F.col("archetype"))).alias("second"), F.coalesce(F.max(F.when(F.col("k") == 2, F.col("score"))), F.lit(0.0)).alias("second_score"))
    doubt = ((F.col("score") < sure) | (F.bround(F.col("score") - F.col("second_score"), 2) <= margin)) & ~((F.col("archetype") == "freeform") & (F.col("score") >= sure))
    return s.withColumn("ambiguous", doubt)


def slot_roles(shapes: DataFrame, archetypes: DataFrame, titles: DataFrame) -> DataFrame:
    """The role of each shape in its slide's archetype, and how many characters it holds."""
    w = W.partitionBy("slide_id", "is_text").orderBy("y", "x", "z")
    s = shapes.join(archetypes.select("slide_id", "archetype"), "slide_id").join(titles.select("slide_id", F.col("z").alias("title_z")), "slide_id", "left")
    s = s.withColumn("is_text", (F.col("tag") == "sp") & ~F.coalesce(F.col("z") == F.col("title_z"), F.lit(False))).withColumn("k", F.row_number().over(w))
    role = (
        F.when(F.coalesce(F.col("z") == F.col("title_z"), F.lit(False)), "title").when(F.col("tag") == "pic", "picture").when(F.col("kind").isin("chart", "table"), F.col("kind"))
        .when(F.col("archetype").isin("title", "section", "closing") & (F.col("k") == 1), "subtitle").when((F.col("archetype") == "kpi") & (F.col("chars") <= 5), "number").when(F.col("archetype").isin("kpi", "cards", "team") & (F.col("chars") <= 15), "label").otherwise("body")
    )
    per_line, lines = F.floor(F.col("w") / 12700 / (0.5 * F.col("size_pt"))), F.floor(F.col("h") / 12700 / (1.2 * F.col("size_pt")))
    return s.select(*SLIDE, "z", role.alias("role"), F.when(F.col("tag") == "sp", (0.9 * per_line * lines).cast("long")).alias("capacity"))


def collapse_groups(slots: DataFrame, kinds: tuple[str, ...] = ("icon", "other"), least: int = 2) -> DataFrame:
    """C11: drawn pieces of an exemplar become one slot over their bounding box; slots inside it go."""
    g = slots.where(F.col("kind").isin(*kinds)).groupBy("template_id", "exemplar_id").agg(F.count("*").alias("n"), F.min("x").alias("gx"), F.min("y").alias("gy"), F.max(F.col("x") + F.col("w")).alias("gx2"), F.max(F.col("y") + F.col("h")).alias("gy2")).where(F.col("n") >= least)
    inside = (F.col("x") >= F.col("gx")) & (F.col("y") >= F.col("gy")) & (F.col("x") + F.col("w") <= F.col("gx2")) & (F.col("y") + F.col("h") <= F.col("gy2"))
    s = slots.select("template_id", "exemplar_id", "slot_id", "kind", "x", "y", "w", "h")
    stay = s.join(g, ["template_id", "exemplar_id"], "left").where(F.col("gx").isNull() | ~inside).select(*s.columns)
    one = g.select("template_id", "exemplar_id", F.lit(-1).cast("long").alias("slot_id"), F.lit("group").alias("kind"), F.col("gx").alias("x"), F.col("gy").alias("y"), (F.col("gx2") - F.col("gx")).alias("w"), (F.col("gy2") - F.col("gy")).alias("h"))
    return stay.unionByName(one)


def overlay_labels(picked: DataFrame, labels: DataFrame, archetypes: tuple[str, ...]) -> DataFrame:
    """Recorded labels (slide_id, label) win where they are valid archetypes."""
    ok = F.when(F.col("label").isin(*archetypes), F.col("label"))
    return picked.join(labels, "slide_id", "left").select(*SLIDE, F.coalesce(ok, F.col("archetype")).alias("archetype"), ok.isNotNull().alias("from_label"))


def needs(outline: DataFrame) -> DataFrame:
    """What a slide asks for: items, their lengths, key numbers, chart, table, picture, quote, steps of a diagram, the
    title's length. ``outline`` has n_kpis, has_chart, table_cols, has_image, quote_chars and diagram besides its texts."""
    chars = F.transform("bullets", lambda b: F.char_length(b).cast("long"))
    longest = F.coalesce(F.array_max(chars), F.lit(0))
    total = F.aggregate(chars, F.lit(0).cast("long"), lambda a, b: a + b)
    extra = [F.col(c).cast("long").alias(c) for c in ("n_kpis", "table_cols", "quote_chars", "diagram")]
    return outline.select("outline_id", "idx", "archetype", F.size("bullets").cast("long").alias("items"), longest.cast("long").alias("longest"), (total + 2 * F.size("bullets")).cast("long").alias("total"), F.char_length("title").cast("long").alias("title_chars"), chars.alias("item_chars"), "has_chart", "has_image", *extra)


def offers(slots: DataFrame, slide_w: int = geo.SLIDE_W, slide_h: int = geo.SLIDE_H) -> DataFrame:
    """What an exemplar has: slots by kind, the places of its bodies, subtitles and labels in reading order (arrays of some
    entries with capacity, lines, area and width), its title and how much of it other slots leave free, share of the slide that
    slots fill, the box around its content, and columns of bodies (islands of left edges farther apart than half the
    narrowest body)."""
    k = lambda *names: F.col("kind").isin(*names)
    keys = ["template_id", "exemplar_id", "archetype", "confidence"]
    body = slots.where(k("body"))
    w = W.partitionBy("exemplar_id")
    lefts = body.withColumns({"gap": F.col("x") - F.lag("x").over(w.orderBy("x", "slot_id")), "narrow": F.min("w").over(w)})
    columns = lefts.groupBy("exemplar_id").agg((1 + F.count_if(F.col("gap") > F.floor(F.col("narrow") / 2))).alias("columns"))
    place = F.struct(F.floor(F.col("y") / (slide_h / 12)).alias("row"), "x", "slot_id", "capacity", F.floor(F.col("h") / 12700 / (1.2 * F.col("size_pt"))).cast("long").alias("lines"), geo.area().alias("area"), "w")
    places = lambda *names: F.array_sort(F.collect_list(F.when(k(*names), place)))
    content = ~k("title", "subtitle", "slide_number", "footer", "date")
    own = lambda c: F.when(content, c)
    found = slots.groupBy(*keys).agg(
        *[F.count_if(k(n)).alias(a) for n, a in (("body", "bodies"), ("label", "labels"), ("caption", "captions"), ("number", "numbers"), ("picture", "pictures"), ("icon", "icons"), ("chart", "charts"), ("table", "tables"))],
        places("body").alias("body_places"), places("subtitle").alias("subtitle_places"), places("label", "caption").alias("label_places"), places("chart", "table").alias("data_places"),
        F.min(F.when(k("title"), F.struct("slot_id", "x", "y", "w", "h", "capacity", "size_pt"))).alias("title"), F.min(F.when(k("picture"), F.struct(F.floor(F.col("y") / (slide_h / 12)).alias("row"), "x", "slot_id", "y", "w", "h"))).alias("picture"),
        F.median(F.when(k("number"), F.col("size_pt"))).alias("number_pt"), F.collect_list(F.when(k("number"), F.col("size_pt"))).alias("number_sizes"), F.bround(F.least(F.lit(1.0), F.sum(geo.area()) / (slide_w * slide_h)), 4).alias("fill"),
        F.min(own(F.col("x"))).alias("left"), F.min(own(F.col("y"))).alias("top"), (F.max(own(F.col("x") + F.col("w"))) - F.min(own(F.col("x")))).alias("wide"), (F.max(own(F.col("y") + F.col("h"))) - F.min(own(F.col("y")))).alias("high"),
    )
    t, o = found.where("title is not null").select("exemplar_id", "title.x", "title.y", "title.w", "title.h").alias("t"), slots.where(k("body", "picture", "chart", "table")).alias("o")
    over = t.join(o.hint("merge"), F.col("t.exemplar_id") == F.col("o.exemplar_id")).groupBy("t.exemplar_id").agg(F.max(geo.intersection("t", "o") / geo.area("t")).alias("title_over"))
    p, q = found.where("picture is not null").select("exemplar_id", "picture.x", "picture.y", "picture.w", "picture.h").alias("p"), slots.where(k("body", "label", "caption", "number")).alias("q")
    behind = p.join(q.hint("merge"), F.col("p.exemplar_id") == F.col("q.exemplar_id")).groupBy("p.exemplar_id").agg(F.max(geo.intersection("p", "q") / geo.area("q")).alias("picture_over"))
    free = visible_title(slots).groupBy("exemplar_id").agg(F.min_by("visible", "slot_id").alias("visible"))
    for extra in (columns, over, behind, free):
        found = found.join(extra.hint("merge"), "exemplar_id", "left")
    big = F.size(F.filter("number_sizes", lambda v: v >= 0.65 * F.col("number_pt"))).cast("long")
    return found.withColumns({"columns": F.coalesce("columns", F.lit(0)), "big_numbers": big, "title_over": F.coalesce("title_over", F.lit(0.0)), "picture_over": F.coalesce("picture_over", F.lit(0.0))}).drop("number_sizes")


def fallbacks(spark: SparkSession) -> DataFrame:
    """(wanted, archetype, rank) of the library's table of fallbacks: a line for each archetype, itself not named."""
    lines = pkgutil.get_data("deckloom", "data/fallbacks.csv").decode().split()
    chains = {line.split(",")[0]: line.split(",") for line in lines}
    return spark.createDataFrame([(k, a, i) for k, v in chains.items() for i, a in enumerate(v)], "wanted string, archetype string, rank long")


def candidate_chain(chain: DataFrame, strategies: DataFrame) -> DataFrame:
    """(name, wanted, archetype, rank, penalty) of each strategy (name, priority): an archetype itself, then what takes
    its place.

    For a text archetype the text archetypes of its chain come first, in the order of the strategy's ``priority``, the wanted one
    first among equals; a step costs less there.
    """
    c = chain.crossJoin(F.broadcast(strategies))  # some hundred rows with some strategies
    flexible = F.col("wanted").isin(*FLEXIBLE)
    own = flexible & F.col("archetype").isin(*FLEXIBLE)
    place = F.coalesce(F.nullif(F.array_position("priority", F.col("archetype")), F.lit(0)), F.lit(100))
    order = [F.when(own, 0).otherwise(1), F.when(own, place).otherwise(0), F.when(own & (F.col("archetype") == F.col("wanted")), 0).otherwise(1), F.col("rank")]
    again = F.row_number().over(W.partitionBy("name", "wanted").orderBy(*order)) - 1
    return c.withColumn("again", F.when(flexible, again).otherwise(F.col("rank")).cast("long")).select("name", "wanted", "archetype", F.col("again").alias("rank"), F.when(flexible, FLEX_PENALTY).otherwise(RANK_PENALTY).alias("penalty"))


#: What takes the place of any archetype for a slide with a diagram, in order.
DIAGRAM_CHAIN = ("bullets", "two_column", "cards", "image_text", "agenda")


def full_chain(chain: DataFrame, strategies: DataFrame) -> DataFrame:
    """The chains of all strategies (name, priority, images), with that for slides with a diagram (``diagram``) beside
    them; the penalty of a step is that of the wanted archetype in both."""
    c = candidate_chain(chain, strategies).withColumn("diagram", F.lit(False))
    drawn = c.select("name", "wanted", "penalty").distinct().select("name", "wanted", F.posexplode(F.array(*map(F.lit, DIAGRAM_CHAIN))).alias("rank", "archetype"), "penalty")
    both = c.unionByName(drawn.select("name", "wanted", "archetype", F.col("rank").cast("long").alias("rank"), "penalty", F.lit(True).alias("diagram")))
    return both.join(F.broadcast(strategies.select("name", "images")), "name")  # some strategies


#: What a picture slot is worth to a slide with a picture, and to one without, by a strategy's wish for pictures.
PICTURE_WORTH = {"minimal": (0.5, -3.0), "preferred": (3.0, -5.0), "always": (5.0, -5.0)}
STRUCTURAL = ("title", "section", "closing")


def _capacity(have: Column, need: Column, empty: float, short: float) -> Column:
    return F.when(have == need, 2.0).when(have < need, -short * (need - have)).otherwise(-empty * (have - need))


def match_scores(need: DataFrame, offer: DataFrame, chain: DataFrame, icons: bool = True, max_fill: float = 0.75) -> DataFrame:
    """A score for each possible pair of a slide and an exemplar on its chain, from the exemplar's confidence on.

    ``need`` names each slide's ``strategy``, and ``chain`` comes from ``full_chain``. Exemplars of no archetype (freeform)
    are no candidates. A pair carries its place on the chain with the penalty for each step to it, and whether the exemplar
    is only a reserve: a structural one for a slide that is neither structural nor a quote.

    Each term is a column: the title (lacking, too long, under other slots), data (in a body, in slots of its own, too narrow),
    a diagram, a quote, key numbers, items (in one body, in several, in labels), pictures, icons and the share that is
    filled. Where one of them can't be placed, the pair is impossible and left out.
    """
    c = F.col
    steps = F.broadcast(chain.withColumnRenamed("name", "strategy").withColumnRenamed("diagram", "drawn"))  # some hundred rows
    p = need.withColumnRenamed("archetype", "wanted").withColumn("drawn", c("diagram") > 0).join(steps, ["strategy", "wanted", "drawn"]).join(offer.where("archetype <> 'freeform'").hint("merge"), "archetype")
    data, quote, diagram = c("has_chart") | (c("table_cols") > 0), c("quote_chars") > 0, c("diagram") > 0
    has_title, structural = c("title").isNotNull(), c("archetype").isin(*STRUCTURAL)
    n_data = c("charts") + c("tables")
    in_body = data & (n_data == 0)
    widest = F.array_max(F.transform("body_places", lambda x: F.struct(x["area"].alias("area"), (-x["slot_id"]).alias("low"), x["w"].alias("w"))))
    real = F.when((F.size("body_places") == 0) & structural & ((c("items") > 0) | (c("n_kpis") > 0)), c("subtitle_places")).otherwise(c("body_places"))
    left = F.when(diagram, F.filter(real, lambda x: F.lit(False))).when(in_body, F.filter(real, lambda x: x["slot_id"] != -c("widest.low"))).otherwise(real)
    p = p.withColumn("widest", widest).withColumn("places", left).withColumn("n", F.size("places").cast("long"))
    first = lambda name: F.get("places", F.lit(0))[name]
    tight = lambda places: F.size(F.filter(F.zip_with(F.slice(places, F.lit(1), F.greatest(c("items").cast("int"), F.lit(0))), c("item_chars"), lambda s, n: (s["capacity"] > 0) & (s["capacity"] < n)), lambda x: F.coalesce(x, F.lit(False))))
    title = F.when((c("title_chars") > 0) & ~has_title & ~quote, F.when(F.size("subtitle_places") > 0, -2.0).otherwise(-5.0)).when(has_title & (c("title.capacity") > 0) & (c("title_chars") > c("title.capacity")), -3.0).otherwise(0.0)
    seen = F.floor(F.floor(c("title.w") / 12700 / (0.5 * c("title.size_pt"))) * c("visible") / c("title.w"))
    under = F.when(has_title & (c("title_over") > 0.2), -5.0 - F.when(c("title_chars") > seen, 8.0).otherwise(0.0)).otherwise(0.0)
    fitting = (c("has_chart") & (c("charts") > 0)) | ((c("table_cols") > 0) & (c("tables") > 0))
    cell = F.when(in_body, c("widest.w")).otherwise(F.get("data_places", F.lit(0))["w"])
    narrow = F.when((c("table_cols") > 0) & (cell / F.greatest(c("table_cols"), F.lit(1)) < geo.INCH), 3.0).otherwise(0.0)
    of_data = F.when(in_body, -6.0 - narrow).when(data, F.when(fitting, 2.0).otherwise(0.0) - 3.0 * (n_data - 1) - narrow).otherwise(0.0)
    share = c("wide") * c("high") / (geo.SLIDE_W * geo.SLIDE_H)
    inside = F.greatest(F.lit(0), F.least(c("title.x") + c("title.w"), c("left") + c("wide")) - F.greatest(c("title.x"), c("left"))) * F.greatest(F.lit(0), F.least(c("title.y") + c("title.h"), c("top") + c("high")) - F.greatest(c("title.y"), c("top")))
    no_diagram = (c("bodies") == 0) | c("wide").isNull() | (share < 0.15) | (c("wide") < 1.3 * c("high")) | F.coalesce(inside > 0.2 * c("title.w") * c("title.h"), F.lit(False))
    of_diagram = F.when(diagram, 4.0 * F.least(F.lit(1.0), share / 0.4) + F.when(c("columns") > 1, F.when(c("columns") == c("diagram"), 2.0).otherwise(-8.0)).otherwise(0.0)).otherwise(0.0)
    headed = c("archetype").isin("section", "title")
    of_quote = F.when(quote & ~headed & (c("n") > 0) & (first("capacity") > 0) & (c("quote_chars") > first("capacity")), -3.0).otherwise(0.0)
    impossible = (in_body & (c("bodies") == 0)) | (diagram & no_diagram) | (quote & ((headed & ~has_title) | (~headed & (c("n") == 0))))
    kpis = (
        F.when(c("n_kpis") == 0, 0.0).when(c("numbers") > 0, _capacity(c("big_numbers"), c("n_kpis"), 2.0, 5.0)).when(c("archetype") == "cards", _capacity(c("labels"), c("n_kpis"), 1.5, 5.0) - 1.0)
        .when((c("n") == 1) & (first("lines") >= c("n_kpis")), -1.0).otherwise(-3.0 * c("n_kpis"))
    )
    cap = F.when(first("lines") > 0, first("lines")).otherwise(6)
    single = F.when(c("items") <= cap, 1.0).otherwise(-1.5 * (c("items") - cap)) - F.when((first("capacity") > 0) & (c("total") > first("capacity")), 6.0).otherwise(0.0)
    sparse = lambda have: F.when(2 * c("items") <= have, 4.0).otherwise(0.0)
    several = _capacity(c("n"), c("items"), 5.0, 6.0) - sparse(c("n")) - F.when(c("labels") > 0, F.abs(c("labels") - c("n"))).otherwise(0) - 4.0 * tight(c("places"))
    marks = c("labels") + c("captions")
    labelled = _capacity(marks, c("items"), 5.0, 3.0) - 1.0 - sparse(marks) - 4.0 * tight(c("label_places"))
    items = F.when(c("items") == 0, 0.0).when(c("n") == 1, single).when(c("n") > 1, several).when(marks > 0, labelled).otherwise(-2.0 * c("items"))
    worth = lambda i: F.coalesce(*[F.when(c("images") == k, v[i]) for k, v in PICTURE_WORTH.items()])
    with_, without = worth(0), worth(1)
    pictures = F.when(c("pictures") == 0, 0.0).when(c("has_image"), with_ - 2.5 * (c("pictures") - 1) - F.when(c("picture_over") >= 0.5, 8.0).otherwise(0.0)).otherwise(without)
    rest = F.when((c("icons") > 0) & F.lit(icons), 1.0).otherwise(0.0) - F.when(c("fill") > max_fill, 10.0 * (c("fill") - max_fill)).otherwise(0.0)
    score = c("confidence") + title + under + of_data + of_diagram + of_quote + kpis + items + pictures + rest
    reserve = structural & ~c("wanted").isin(*STRUCTURAL, "quote")
    return p.where(~F.coalesce(impossible, F.lit(False))).select("outline_id", "idx", "template_id", "exemplar_id", "archetype", "rank", "penalty", reserve.alias("reserve"), F.bround(score, 2).alias("score"))


def _rated(scores: DataFrame) -> DataFrame:
    """Each slide's exemplars with their best score less the penalties for their steps on the chain."""
    less = F.bround(F.col("score") - F.col("penalty") * F.col("rank"), 2)
    return scores.groupBy("outline_id", "idx", "template_id", "exemplar_id").agg(F.max(less).alias("score"), F.bool_and("reserve").alias("reserve"))


def best_exemplar(scores: DataFrame) -> DataFrame:
    """For each slide and template the best exemplar, less a penalty for each step on the chain; ties to the lowest id. One
    that is a reserve is taken only where no other is possible."""
    best = _rated(scores).groupBy("outline_id", "idx", "template_id").agg(F.max(F.struct((~F.col("reserve")).alias("first"), "score", (-F.col("exemplar_id")).alias("low"))).alias("b"))
    return best.select("outline_id", "idx", "template_id", (-F.col("b.low")).alias("exemplar_id"), F.col("b.score").alias("score"))


def reuse_aware(scores: DataFrame) -> DataFrame:
    """The same in the order of slides, with 2 off for each earlier use in the deck, up to three.

    Reserves are left out where another exemplar is possible, so that reuse never makes one of them the better choice. A
    candidate that is more than the whole penalty behind its slide's best can't win and is left out. A fold over a deck's
    slides that carries how often each exemplar of the template was used.
    """
    keys = ["outline_id", "template_id"]
    slide = W.partitionBy(*keys, "idx")
    s = _rated(scores).withColumn("other", F.bool_or(~F.col("reserve")).over(slide)).where(~F.col("reserve") | ~F.col("other"))
    near = s.withColumn("best", F.max("score").over(slide)).where(F.col("score") >= F.col("best") - REUSE_PENALTY * REUSE_MAX)
    place = F.dense_rank().over(W.partitionBy(*keys).orderBy("exemplar_id"))
    few = near.withColumn("at", place.cast("int")).groupBy(*keys, "idx").agg(F.array_sort(F.collect_list(F.struct("exemplar_id", "score", "at"))).alias("options"), F.max("at").alias("most"))
    deck = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "options"))).alias("slides"), F.max("most").alias("most"))
    start = F.struct(F.array_repeat(F.lit(0), F.col("most")).alias("uses"), F.array().cast("array<struct<idx:bigint,exemplar_id:bigint>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        used = lambda o: F.least(F.get(acc["uses"], o["at"] - 1), F.lit(REUSE_MAX))
        rated = F.transform(s["options"], lambda o: F.struct((-F.bround(o["score"] - REUSE_PENALTY * used(o), 2)).alias("less"), o["exemplar_id"].alias("exemplar_id"), o["at"].alias("at")))
        pick = F.array_min(rated)
        uses = F.transform(acc["uses"], lambda n, i: n + F.when(i + 1 == pick["at"], 1).otherwise(0))
        return F.struct(uses.alias("uses"), F.concat(acc["out"], F.array(F.struct(s["idx"].alias("idx"), pick["exemplar_id"].alias("exemplar_id")))).alias("out"))

    return deck.select(*keys, F.inline(F.aggregate("slides", start, step)["out"]))


def label_pairs(slots: DataFrame) -> DataFrame:
    """Bodies and labels one to one: in reading order of bodies the nearest free label above in the same column, or close
    by on the left in the same row. An exemplar without any such pair gets its labels in order.

    A fold over an exemplar's bodies, each with its labels by distance.
    """
    b, l = slots.where("kind in ('body', 'table', 'chart')").alias("b"), slots.where("kind in ('label', 'caption', 'number')").alias("l")
    x2, y2 = (lambda a: F.col(f"{a}.x") + F.col(f"{a}.w")), (lambda a: F.col(f"{a}.y") + F.col(f"{a}.h"))
    above = (F.col("l.x") < x2("b")) & (F.col("b.x") < x2("l")) & (F.col("l.y") <= F.col("b.y") + F.floor(F.col("b.h") / 4))
    beside = (F.col("l.y") < y2("b")) & (F.col("b.y") < y2("l")) & (x2("l") <= F.col("b.x") + F.floor(F.col("b.w") / 4)) & (F.col("b.x") - x2("l") <= F.col("l.h"))
    d = F.when(above, F.abs(F.col("b.y") - y2("l"))).when(beside, F.abs(F.col("b.x") - x2("l")))
    near = b.join(l.hint("merge"), F.col("b.exemplar_id") == F.col("l.exemplar_id")).select("b.exemplar_id", F.col("b.slot_id").alias("body"), d.alias("d"), F.col("l.slot_id").alias("label")).where("d is not null")
    each = near.groupBy("exemplar_id", "body").agg(F.array_sort(F.collect_list(F.struct("d", "label"))).alias("c")).groupBy("exemplar_id").agg(F.array_sort(F.collect_list(F.struct("body", "c"))).alias("bodies"))
    start = F.array().cast("array<struct<body:bigint,label:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        free = F.filter(x["c"], lambda c: ~F.exists(acc, lambda p: p["label"] == c["label"]))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(F.struct(x["body"].alias("body"), F.get(free, F.lit(0))["label"].alias("label"))))).otherwise(acc)

    found = each.select("exemplar_id", F.inline(F.aggregate("bodies", start, step)))
    k = lambda df, name: df.select("exemplar_id", F.col("slot_id").alias(name), F.row_number().over(W.partitionBy("exemplar_id").orderBy("slot_id")).alias("k"))
    rest = slots.select("exemplar_id").distinct().join(each.select("exemplar_id"), "exemplar_id", "left_anti")
    by_order = k(b.select("b.*"), "body").join(k(l.select("l.*"), "label"), ["exemplar_id", "k"]).join(rest, "exemplar_id", "left_semi").select("exemplar_id", "body", "label")
    return found.unionByName(by_order)


def reading_order(shapes: DataFrame, slide_h: int = geo.SLIDE_H) -> DataFrame:
    """The number of a shape among those of its kind, by rows of a twelfth of the slide, then from the left."""
    row = F.floor(F.col("y") / (slide_h / 12))
    return shapes.select(*SLIDE, "z", "tag", F.row_number().over(W.partitionBy("slide_id", "tag").orderBy(row, "x", "z")).alias("n"))


def allocate(items: DataFrame, capacity: DataFrame) -> DataFrame:
    """Items (outline_id, idx, what, n) to slots of their kind; the rest goes on on further slides, on frames it is dropped.

    ``capacity`` has outline_id, idx, bodies, numbers and archetype: the n-th key number ("kpi") goes to the n-th number slot,
    the n-th other item to the n-th body; a single body takes a list of any length. (…, page, slot, dropped)
    """
    j = items.join(capacity.hint("merge"), ["outline_id", "idx"])
    size = F.greatest(F.when(F.col("what") == "kpi", F.col("numbers")).otherwise(F.col("bodies")), F.lit(1))
    listed = (F.col("what") != "kpi") & (F.col("bodies") == 1)
    page = F.when(listed, F.lit(0)).otherwise(F.floor(F.col("n") / size)).cast("long")
    slot = F.when(listed, F.lit(0)).otherwise(F.col("n") % size).cast("long")
    return j.select("outline_id", "idx", "what", "n", page.alias("page"), slot.alias("slot"), (F.col("archetype").isin("title", "closing") & (page > 0)).alias("dropped"))


def visible_title(slots: DataFrame) -> DataFrame:
    """The width of a title that boxes on its line leave free, cut from the left and from the right."""
    t, o = slots.where("kind = 'title'").alias("t"), slots.where("kind <> 'title'").alias("o")
    line = (F.col("o.y") < F.col("t.y") + F.col("t.h")) & (F.col("o.y") + F.col("o.h") > F.col("t.y")) & (F.col("t.exemplar_id") == F.col("o.exemplar_id"))
    mid = F.col("t.x") + F.col("t.w") / 2
    j = t.join(o, line, "left")
    left = F.max(F.when((F.col("o.x") + F.col("o.w") <= mid), F.col("o.x") + F.col("o.w")))
    right = F.min(F.when(F.col("o.x") > mid, F.col("o.x")))
    g = j.groupBy("t.exemplar_id", "t.slot_id", "t.x", "t.w").agg(left.alias("left_edge"), right.alias("right_edge"))
    a, b = F.greatest(F.col("x"), F.coalesce("left_edge", F.col("x"))), F.least(F.col("x") + F.col("w"), F.coalesce("right_edge", F.col("x") + F.col("w")))
    return g.select("exemplar_id", "slot_id", F.greatest(F.lit(0), b - a).cast("long").alias("visible"))


def wrapped_lines(c: Column, width: Column) -> Column:
    """Lines of a text at so many characters each, words kept whole where they fit; a longer one is split."""

    def step(acc: Column, w: Column) -> Column:
        n = F.char_length(w)
        fits = (acc["used"] > 0) & (acc["used"] + 1 + n <= width)
        extra = F.ceil(n / width).cast("int")
        return F.when(fits, F.struct(acc["lines"].alias("lines"), (acc["used"] + 1 + n).alias("used"))).otherwise(F.struct((acc["lines"] + extra).alias("lines"), (n - (extra - 1) * width).cast("int").alias("used")))

    start = F.struct(F.lit(0).alias("lines"), F.lit(0).alias("used"))
    return F.greatest(F.lit(1), F.aggregate(text.words(c), start, step)["lines"])


def overflow(paras: DataFrame, boxes: DataFrame | None = None, slack: float = 0.1, points: float = 2.0, spacing: float = 1.2) -> DataFrame:
    """Boxes whose paragraphs need more room than there is: a tenth and two points more.

    ``boxes`` has doc_id, width_chars, size_pt, height_pt with insets_pt above and below together, gap_pt between paragraphs,
    is_title (two lines are always let pass), autofit (the text will shrink: only a warning) and wraps; a text that doesn't
    wrap needs the width of its longest paragraph. Without ``boxes`` paragraphs have their columns, and texts stay where they are.
    """
    p = (paras if boxes is None else paras.join(boxes.hint("merge"), "doc_id")).withColumns({"lines": F.when(F.col("wraps"), wrapped_lines(F.col("text"), F.col("width_chars"))).otherwise(1), "n": F.char_length("text")})
    box = ["doc_id", "width_chars", "size_pt", "height_pt", "insets_pt", "gap_pt", "is_title", "autofit", "wraps"]
    need = p.groupBy(*box).agg(F.sum("lines").cast("long").alias("lines"), F.count("*").alias("paras"), F.max("n").alias("longest"))
    high = F.col("lines") * F.col("size_pt") * spacing + (F.col("paras") - 1) * F.col("gap_pt")
    wide = lambda n: 0.5 * F.col("size_pt") * n
    need = need.withColumns({
        "need_pt": F.bround(F.when(F.col("wraps"), high).otherwise(wide(F.col("longest"))), 2), "have_pt": F.when(F.col("wraps"), F.col("height_pt") - F.col("insets_pt")).otherwise(wide(F.col("width_chars"))),
    })
    over = (F.col("need_pt") > (1 + slack) * F.col("have_pt") + points) & ~(F.col("is_title") & (F.col("lines") <= 2))
    return need.where(over).select("doc_id", "lines", "need_pt", "have_pt", F.when(F.col("autofit"), "warning").otherwise("error").alias("severity"))


def lines_over_blocks(shapes: DataFrame) -> DataFrame:
    """Our texts of which a line below their own box, by average widths, reaches into a picture, chart or table that the box
    leaves alone; with the first such line. Lines that the text has in the exemplar are let off."""
    ours = F.coalesce("is_ours", F.lit(True)) if "is_ours" in shapes.columns else F.lit(True)
    t = with_lines(shapes.where("tag = 'sp'").where(ours)).select(*SLIDE, "z", "x", "y", "w", "h", "high", "lines", "known").alias("a")
    b = shapes.where("tag <> 'sp'").select("slide_id", "z", "x", "y", "w", "h").alias("b")
    # The first line whose lower edge lies below the block's upper one, and which the exemplar does not have.
    first = F.greatest(F.floor((F.col("b.y") - F.col("a.y")) / F.col("a.high")) + 1, F.col("a.known") + 1)
    apart = geo.intersection("a", "b") == 0
    reach = (geo.overlap_w("a", "b") > 0) & (F.col("b.y") >= F.col("a.y") + F.col("a.h")) & (first <= F.col("a.lines")) & (F.col("a.y") + (first - 1) * F.col("a.high") < F.col("b.y") + F.col("b.h"))
    found = t.join(b, (F.col("a.slide_id") == F.col("b.slide_id")) & apart & reach)
    depth = F.col("a.y") + F.col("a.lines") * F.col("a.high") - F.col("b.y")
    return found.select(*[F.col(f"a.{c}").alias(c) for c in (*SLIDE, "z")], F.col("b.z").alias("other_z"), first.cast("long").alias("line"), depth.cast("long").alias("depth"))
