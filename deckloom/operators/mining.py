"""Template mining: colours, type, repeated elements and grid of each template, out of its shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import color, text
from ..functions import geometry as geo
from .audit import SYMBOL_FONTS

#: Bands of text roles as shares of the body size, from the largest.
BANDS = (("display", 2.4), ("h1", 1.6), ("h2", 1.25), ("h3", 1.08), ("body", 0.92), ("caption", 0.7), ("small", 0.0))
ROLES = ("background", "text", "accent", "secondary", "surface", "muted", "unknown")
#: Weights: a slide's shapes count 1, a layout's a quarter; this many characters count as one filled shape.
LAYOUT_WEIGHT, CHARS_PER_FILL = 0.25, 20


def color_usage(shapes: DataFrame, slide_w: int = geo.SLIDE_W, slide_h: int = geo.SLIDE_H, cover: float = 0.6) -> DataFrame:
    """Per template and colour: fills, their area, covering area, text characters and a weight.

    ``shapes`` may have a column ``layer`` ("slide" or "layout"); a layout's shapes count a quarter.
    """
    w = F.when(F.col("layer") == "layout", LAYOUT_WEIGHT).otherwise(1.0)
    area = (F.col("w") * F.col("h")).cast("double") / (slide_w * slide_h)
    found = shapes.groupBy("template_id", "hex", "r", "g", "b").agg(
        F.sum(F.when(F.col("tag") != "sp", w).otherwise(0.0)).alias("fills"), F.bround(F.sum(F.when(F.col("tag") != "sp", w * area).otherwise(0.0)), 4).alias("fill_area"),
        F.bround(F.sum(F.when((F.col("tag") != "sp") & (area >= cover), w * area).otherwise(0.0)), 4).alias("cover_area"), F.sum(F.when(F.col("tag") == "sp", w * F.col("chars")).otherwise(0.0)).alias("text_chars"),
    )
    return found.withColumn("weight", F.bround(F.col("fills") + F.col("text_chars") / CHARS_PER_FILL, 4))


def color_clusters(usage: DataFrame, near: float = 8.0) -> DataFrame:
    """(template_id, hex, cluster): colours by falling weight join the first cluster whose first colour is near.

    A fold over the sorted colours of a template: at most some hundred of them.
    """
    c = color.with_lab(usage).select("template_id", F.struct((-F.col("weight")).alias("less"), "hex", "lab_l", "lab_a", "lab_b").alias("c"))
    sorted_ = c.groupBy("template_id").agg(F.array_sort(F.collect_list("c")).alias("colors"))
    kind = "array<struct<hex:string,cluster:string,l:double,a:double,b:double>>"

    def step(acc: Column, x: Column) -> Column:
        de = lambda m: F.sqrt(F.pow(m["l"] - x["lab_l"], F.lit(2.0)) + F.pow(m["a"] - x["lab_a"], F.lit(2.0)) + F.pow(m["b"] - x["lab_b"], F.lit(2.0)))
        first = F.get(F.filter(acc, lambda m: (m["hex"] == m["cluster"]) & (F.bround(de(m), 4) < near)), F.lit(0))
        new = F.struct(x["hex"].alias("hex"), F.coalesce(first["cluster"], x["hex"]).alias("cluster"), x["lab_l"].alias("l"), x["lab_a"].alias("a"), x["lab_b"].alias("b"))
        return F.concat(acc, F.array(new))

    folded = sorted_.select("template_id", F.aggregate("colors", F.array().cast(kind), step).alias("done"))
    return folded.select("template_id", F.inline("done")).select("template_id", "hex", "cluster")


def cluster_usage(usage: DataFrame, clusters: DataFrame) -> DataFrame:
    """Usage summed over the clusters, by the cluster's colour."""
    s = usage.join(clusters.hint("merge"), ["template_id", "hex"]).groupBy("template_id", F.col("cluster").alias("hex")).agg(*[F.bround(F.sum(c), 4).alias(c) for c in ("fills", "fill_area", "cover_area", "text_chars", "weight")])
    return s.join(usage.select("template_id", "hex", "r", "g", "b"), ["template_id", "hex"])


def color_roles(clusters: DataFrame, min_contrast: float = 3.0, chromatic: float = 20.0, second: float = 0.15, surface_area: float = 0.5) -> DataFrame:
    """One background, text, accent, secondary and muted colour per template, surfaces, the rest unknown.

    Each role is given by rank among the colours that no role before has taken; ties go to the smaller hex.
    """
    w = W.partitionBy("template_id")
    c = color.with_lab(clusters).withColumns({"chroma": F.bround(F.sqrt(F.col("lab_a") * F.col("lab_a") + F.col("lab_b") * F.col("lab_b")), 4), "lum": color.luminance(F.col("r"), F.col("g"), F.col("b"))})

    def give(df: DataFrame, role: str, ok: Column, score: Column, count: int = 1) -> DataFrame:
        open_ = F.coalesce(F.col("role").isNull() & ok, F.lit(False))
        k = F.row_number().over(w.orderBy(F.desc(open_), F.desc(score), "hex"))
        return df.withColumn("k", k).withColumn("role", F.when(open_ & (F.col("k") <= count), F.lit(role)).otherwise(F.col("role"))).drop("k")

    score = F.when(F.max("cover_area").over(w) > 0, F.col("cover_area")).otherwise(F.col("fill_area"))
    c = give(c.withColumn("role", F.lit(None).cast("string")).withColumn("bg", score), "background", F.lit(True), F.col("bg"))
    c = c.withColumn("back", F.max(F.when(F.col("role") == "background", F.col("lum"))).over(w))
    c = give(c, "text", (F.bround(color.contrast(F.col("lum"), F.col("back")), 4) >= min_contrast) & (F.col("text_chars") > 0), F.col("text_chars"))
    c = give(c, "accent", F.col("chroma") >= chromatic, F.col("weight"))
    c = c.withColumn("top", F.max(F.when(F.col("role") == "accent", F.col("weight"))).over(w))
    c = c.withColumn("next_", F.max(F.when(F.col("role").isNull() & (F.col("chroma") >= chromatic), F.col("weight"))).over(w))
    c = give(c, "secondary", (F.col("chroma") >= chromatic) & (F.col("next_") >= second * F.col("top")), F.col("weight"))
    c = c.withColumn("role", F.when(F.col("role").isNull() & (F.col("chroma") < chromatic) & (F.col("fill_area") >= surface_area), "surface").otherwise(F.col("role")))
    c = give(c, "muted", F.col("chroma") < chromatic, F.col("text_chars") + F.col("fills"))
    return c.select("template_id", "hex", F.coalesce("role", F.lit("unknown")).alias("role"), "weight")


def color_tokens(roles: DataFrame, most: int = 16, least: float = 0.01, usage: DataFrame | None = None, theme: DataFrame | None = None) -> DataFrame:
    """Colours by role and usage without rare unknown ones, the first ``most`` of a template.

    ``usage`` (template_id, hex, source, weight) names each colour's dominant source, else it is "slides"; a template without
    an accent gets the first one of its ``theme`` (template_id, accent), if given.
    """
    top = F.max("weight").over(W.partitionBy("template_id"))
    rank = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    kept = roles.withColumn("top", top).where((F.col("role") != "unknown") | (F.col("weight") >= least * F.col("top"))).withColumn("usage", F.bround("weight", 0).cast("long")).select("template_id", "hex", "role", "usage")
    if usage is None:
        kept = kept.withColumn("source", F.lit("slides"))
    else:
        main = usage.groupBy("template_id", "hex").agg(F.min(F.struct((-F.col("weight")).alias("less"), "source")).alias("m")).select("template_id", "hex", F.col("m.source").alias("source"))
        kept = kept.join(main, ["template_id", "hex"], "left").withColumn("source", F.coalesce("source", F.lit("slides")))
    if theme is not None:
        bare = theme.join(kept.where("role = 'accent'").select("template_id").distinct(), "template_id", "left_anti")
        kept = kept.unionByName(bare.select("template_id", F.col("accent").alias("hex"), F.lit("accent").alias("role"), F.lit(0).cast("long").alias("usage"), F.lit("theme").alias("source")))
    n = F.row_number().over(W.partitionBy("template_id").orderBy(rank, F.desc("usage"), "hex"))
    return kept.withColumn("n", n).where(F.col("n") <= most).select("template_id", "n", "hex", "role", "usage", "source")


def font_ranks(runs: DataFrame, least: float = 0.01) -> DataFrame:
    """Fonts by characters, without families of symbols and those under a share of the first."""
    c = runs.where(~F.lower("font").isin(*SYMBOL_FONTS)).groupBy("template_id", "font").agg(F.sum("chars").alias("chars"))
    w = W.partitionBy("template_id")
    return c.withColumns({"n": F.row_number().over(w.orderBy(F.desc("chars"), "font")), "top": F.max("chars").over(w)}).where(F.col("chars") >= least * F.col("top")).drop("top")


def size_bins(runs: DataFrame, ratio: float = 0.08) -> DataFrame:
    """(template_id, bin, low, high, chars, size): sizes in half points, merged with the bin below while near it.

    A fold over a template's sorted sizes, of which there are at most a few hundred.
    """
    s = runs.groupBy("template_id", (F.bround(F.col("size_pt") * 2, 0) / 2).alias("pt")).agg(F.sum("chars").alias("chars"))
    arr = s.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("pt", "chars"))).alias("sizes"))
    kind = "array<struct<low:double,high:double,chars:bigint,mass:double>>"

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.struct(x["pt"].alias("low"), x["pt"].alias("high"), x["chars"].alias("chars"), (x["pt"] * x["chars"]).alias("mass"))
        grown = F.struct(last["low"].alias("low"), x["pt"].alias("high"), (last["chars"] + x["chars"]).alias("chars"), (last["mass"] + x["pt"] * x["chars"]).alias("mass"))
        near = (F.size(acc) > 0) & (x["pt"] < (1 + ratio) * (F.try_element_at(acc, F.lit(-1))["mass"] / F.try_element_at(acc, F.lit(-1))["chars"]))
        return F.when(near, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(one)))

    found = arr.select("template_id", F.aggregate("sizes", F.array().cast(kind), step).alias("bins")).select("template_id", F.posexplode("bins").alias("bin", "b"))
    return found.select("template_id", "bin", "b.low", "b.high", "b.chars", F.bround(F.col("b.mass") / F.col("b.chars"), 4).alias("size"))


def type_roles(runs: DataFrame, low: float = 9.0, high: float = 24.0) -> DataFrame:
    """For each template and role its most used size, font and weight; the body is the most used size of a range."""
    c = runs.groupBy("template_id", "size_pt", "font", "bold").agg(F.sum("chars").alias("chars"))
    size = c.groupBy("template_id", "size_pt").agg(F.sum("chars").alias("chars")).where(F.col("size_pt").between(low, high))
    body = size.withColumn("k", F.row_number().over(W.partitionBy("template_id").orderBy(F.desc("chars"), "size_pt"))).where("k = 1").select("template_id", F.col("size_pt").alias("body"))
    ratio = F.col("size_pt") / F.col("body")
    role = F.coalesce(*[F.when(ratio >= at, name) for name, at in BANDS])
    r = c.join(body, "template_id").withColumn("role", role)
    mode = lambda name: r.groupBy("template_id", "role", name).agg(F.sum("chars").alias("chars")).groupBy("template_id", "role").agg(F.min(F.struct((-F.col("chars")).alias("less"), name)).alias("m")).select("template_id", "role", F.col(f"m.{name}").alias(name))
    total = r.groupBy("template_id", "role").agg(F.sum("chars").alias("usage"))
    return total.join(mode("size_pt"), ["template_id", "role"]).join(mode("font"), ["template_id", "role"]).join(mode("bold"), ["template_id", "role"])


def repeated_signatures(shapes: DataFrame, least: int = 3, share: float = 0.25, edge: float = 0.12, slide_h: int = geo.SLIDE_H) -> DataFrame:
    """(kind, text, stepped box) on at least ``least`` slides and a share of a template's slides.

    Placeholders do not count, texts only in the bands at the upper and lower edge.
    """
    keys = ["tag", "text", *[geo.stepped(F.col(c)).alias(f"b{c}") for c in "xywh"]]
    banded = (F.col("tag") != "sp") | (F.col("y") < edge * slide_h) | (F.col("y") + F.col("h") > (1 - edge) * slide_h)
    each = shapes.where(F.col("placeholder").isNull() & banded).select("template_id", "slide_id", *keys).distinct()
    n = shapes.groupBy("template_id").agg(F.countDistinct("slide_id").alias("n"))
    on = each.groupBy("template_id", "tag", "text", "bx", "by", "bw", "bh").agg(F.count("*").alias("slides"))
    return on.join(n, "template_id").where((F.col("slides") >= least) & (F.col("slides") >= share * F.col("n"))).drop("n")


def fixed_elements(shapes: DataFrame, least: int = 3, edge: float = 0.12, slide_w: int = geo.SLIDE_W, slide_h: int = geo.SLIDE_H) -> DataFrame:
    """Boxes that repeat on a quarter of a template's slides as fixed elements: logo, footer or decoration."""
    s = repeated_signatures(shapes, least)
    y, h, w = F.col("by") * geo.STEP, F.col("bh") * geo.STEP, F.col("bw") * geo.STEP
    kind = F.when((F.col("tag") == "pic") & (w * h < 0.1 * slide_w * slide_h), "logo").when((F.col("tag") == "sp") & (y >= (1 - edge) * slide_h), "footer").when(F.col("tag") != "sp", "decoration").otherwise("unknown")
    return s.withColumn("kind", kind)


def nearest_rank(values: Column, q: float) -> Column:
    """The value of a sorted array at the half-even rounded place q * (n - 1)."""
    return F.element_at(values, (F.bround(q * (F.size(values) - 1), 0) + 1).cast("int"))


def grid(shapes: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Margins as near-extreme edges of content, from counts per distinct edge, so no slide is gathered."""
    edges = shapes.select("template_id", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("x").alias("v")), F.struct(F.lit("top").alias("side"), F.col("y").alias("v")), F.struct(F.lit("right").alias("side"), (F.col("x") + F.col("w")).alias("v")), F.struct(F.lit("bottom").alias("side"), (F.col("y") + F.col("h")).alias("v")))).alias("e"))
    c = edges.groupBy("template_id", "e.side", "e.v").agg(F.count("*").alias("k"))
    w = W.partitionBy("template_id", "side")
    q = F.when(F.col("side").isin("left", "top"), low).otherwise(high)
    at = F.bround(q * (F.sum("k").over(w) - 1), 0)
    run = F.sum("k").over(w.orderBy("v"))
    return c.withColumns({"at": at, "upto": run}).where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("k") <= F.col("at"))).select("template_id", "side", F.col("v").alias("margin"))


def guides(shapes: DataFrame, least: int = 2, share: float = 0.2, slide_w: int = geo.SLIDE_W) -> DataFrame:
    """(template_id, guide): stepped left edges on at least ``least`` slides and a share of a template's slides.

    A template without any gets a twentieth of the width from either side.
    """
    s = shapes.select("template_id", "slide_id", (geo.stepped(F.col("x")) * geo.STEP).alias("guide"))
    n = s.groupBy("template_id").agg(F.countDistinct("slide_id").alias("n"))
    on = s.distinct().groupBy("template_id", "guide").agg(F.count("*").alias("k"))
    found = on.join(n, "template_id").where((F.col("k") >= least) & (F.col("k") >= share * F.col("n"))).select("template_id", "guide")
    bare = n.join(found, "template_id", "left_anti").select("template_id", F.explode(F.array(F.lit(slide_w // 20), F.lit(slide_w - slide_w // 20)).cast("array<bigint>")).alias("guide"))
    return found.unionByName(bare)


def profile(shapes: DataFrame, most: int = 10, colors: int = 25) -> DataFrame:
    """The most frequent fonts, sizes, sizes per font and (``colors`` of them) colours of each template's texts, kinds of
    its shapes, boxes that repeat, and how many slides and shapes it has."""
    runs = shapes.where("tag = 'sp'")
    sets = runs.groupingSets([["template_id", "font"], ["template_id", "size_pt"], ["template_id", "hex"], ["template_id", "font", "size_pt"]], "template_id", "font", "size_pt", "hex")
    c = sets.agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    by = F.when(F.col("gid") == 3, "font").when(F.col("gid") == 5, "size").when(F.col("gid") == 6, "color").otherwise("font_size")
    key = F.concat_ws("|", "font", F.col("size_pt").cast("long").cast("string"), "hex")
    texts = c.select("template_id", by.alias("by"), key.alias("key"), "n")
    boxes = shapes.groupBy("template_id", F.concat_ws(",", *[geo.stepped(F.col(c)).cast("string") for c in "xywh"]).alias("key")).agg(F.countDistinct("slide_id").alias("n")).where("n > 1")
    kinds = shapes.groupBy("template_id", F.col("kind").alias("key")).agg(F.count("*").alias("n"))
    parts = shapes.groupBy("template_id").agg(F.countDistinct("slide_id").alias("slides"), F.count("*").alias("shapes"))
    parts = parts.select("template_id", F.inline(F.array(F.struct(F.lit("slides").alias("key"), F.col("slides").alias("n")), F.struct(F.lit("shapes").alias("key"), F.col("shapes").alias("n")))))
    found = texts
    for name, df in (("box", boxes), ("kind", kinds), ("parts", parts)):
        found = found.unionByName(df.select("template_id", F.lit(name).alias("by"), "key", "n"))
    return found.withColumn("k", F.row_number().over(W.partitionBy("template_id", "by").orderBy(F.desc("n"), "key"))).where(F.col("k") <= F.when(F.col("by") == "color", colors).otherwise(most))


def sample_texts(texts: DataFrame, most: int = 6, chars: int = 120, limit: int = 6000) -> DataFrame:
    """Per exemplar (grp) up to ``most`` distinct texts of at least two letters that are no prompts, in the order of
    ``place``, cut to ``chars`` and joined within ``limit`` characters, and how many more there are."""
    sample = F.substring(F.trim("text"), 1, chars)
    d = texts.where(text.prompt_pattern(F.col("text")).isNull()).select("grp", "place", sample.alias("sample")).where(F.regexp_count("sample", F.lit(r"\p{L}")) >= 2)
    first = d.groupBy("grp", "sample").agg(F.min("place").alias("place"))
    w = W.partitionBy("grp")
    ranked = first.withColumns({"k": F.row_number().over(w.orderBy("place", "sample")), "total": F.count("*").over(w)})
    kept = ranked.where(F.col("k") <= most).withColumn("used", F.sum(F.char_length("sample")).over(w.orderBy("k"))).where(F.col("used") <= limit)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "sample"))), lambda x: x["sample"]), " / ")
    return kept.groupBy("grp").agg(joined.alias("samples"), (F.max("total") - F.count("*")).alias("more"))
