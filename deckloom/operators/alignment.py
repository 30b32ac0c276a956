"""Deck shapes held against the exemplar that their slide was made from.

A plan names each slide's exemplar, a slide of the template. Shapes of a slide are matched one to one with shapes of its
exemplar, and every rule that asks what a slide has inherited reads that one match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo

#: What a match keeps of an exemplar's shape.
OF_SLOT = ("ez", "x", "y", "w", "h", "size_pt", "chars", "slot_kind")
#: Kinds of slots that hold a diagram or a table, inside which any place is the template's.
FRAMES = ("chart", "table")


def _apart(a: Column, b: Column) -> Column:
    return sum((F.abs(a[c] - b[c]) for c in "ywh"), F.abs(a["x"] - b["x"]))


def _near(a: Column, b: Column, sides: str = "xywh", tolerance: int = geo.STEP) -> Column:
    found = F.lit(True)
    for c in sides:
        found = found & (F.abs(a[c] - b[c]) <= tolerance)
    return found


def matched(own: Column, theirs: Column) -> Column:
    """Pairs (apart, z, ez) of two arrays of shapes: nearest boxes of the same kind first, each shape in one pair at most.

    Ties go to the lower z and then to the lower ez. ``own`` is one slide's shapes and ``theirs`` one exemplar's.
    """
    each = lambda s: F.transform(F.filter(theirs, lambda e: e["kind"] == s["kind"]), lambda e: F.struct(_apart(s, e).alias("apart"), s["z"].alias("z"), e["ez"].alias("ez")))
    pairs = F.sort_array(F.flatten(F.transform(own, each)))
    taken = lambda acc, p: F.exists(acc, lambda q: (q["z"] == p["z"]) | (q["ez"] == p["ez"]))
    none = F.array().cast("array<struct<apart:bigint,z:bigint,ez:bigint>>")
    return F.aggregate(pairs, none, lambda acc, p: F.when(taken(acc, p), acc).otherwise(F.concat(acc, F.array(p))))


def inherited(s: Column, slots: Column) -> Column:
    """The exemplar gives the shape's box: a slot's box within STEP, a place inside a slot for a diagram or a table, or a
    slot's box that a plate lets grow to the right."""
    inside = lambda b: (s["x"] >= b["x"] - geo.STEP) & (s["y"] >= b["y"] - geo.STEP) & (s["x"] + s["w"] <= b["x"] + b["w"] + geo.STEP) & (s["y"] + s["h"] <= b["y"] + b["h"] + geo.STEP)
    grown = lambda b: (b["plate_w"] > 0) & _near(s, b, "xyh") & (s["w"] >= b["w"] - geo.STEP) & (s["w"] <= b["w"] + b["plate_w"])
    return F.coalesce(F.exists(slots, lambda b: _near(s, b) | grown(b) | (b["slot_kind"].isin(*FRAMES) & inside(b))), F.lit(False))


def in_context(shapes: DataFrame, plan: DataFrame, exemplars: DataFrame, fixed: DataFrame) -> DataFrame:
    """``shapes`` with exemplar_id, slot, is_slot, is_fixed, is_ours, is_decor, is_content and inherited.

    ``plan`` has (slide_id, exemplar_id), ``exemplars`` (exemplar_id, ez, kind, x, y, w, h, size_pt, chars, slot_kind,
    plate_w, content, is_fixed), ``fixed`` (template_id, bx, by, bw, bh) in steps. ``slot`` is what is matched of the
    exemplar, null if nothing is. With an exemplar a shape is ours if it is matched with nothing, or with a slot of other
    ``content``; without one it is fixed if a fixed box has all its sides within STEP, else ours. Decor is a picture that is
    neither a slot nor ours; content is ours or a slot, no field such as a slide number, and has text, a picture, a chart or
    a table.

    A slide's shapes meet its exemplar's, and its template's fixed boxes, as arrays of these; no pairs of rows are made.
    """
    held = ["slide_id", "template_id"]
    cols = [c for c in shapes.columns if c not in held]
    own = shapes.groupBy(*held).agg(F.collect_list(F.struct(*cols)).alias("own"))  # bounded: one slide's
    slot = F.struct(*OF_SLOT, "kind", "plate_w", "content", "is_fixed")
    theirs = exemplars.groupBy("exemplar_id").agg(F.collect_list(slot).alias("theirs"), F.collect_list(F.when(~F.col("is_fixed"), slot)).alias("slots"))  # bounded: one exemplar's
    boxes = fixed.groupBy("template_id").agg(F.collect_list(F.struct(*[(F.col(f"b{c}") * geo.STEP).alias(c) for c in "xywh"])).alias("boxes"))  # bounded: on a quarter of slides
    s = own.join(plan.select("slide_id", "exemplar_id"), "slide_id", "left").join(F.broadcast(theirs), "exemplar_id", "left").join(F.broadcast(boxes), "template_id", "left")  # a few rows a template
    s = s.withColumn("pairs", matched(F.col("own"), F.col("theirs")))
    each = s.select(*held, "exemplar_id", "theirs", "slots", "boxes", "pairs", F.explode("own").alias("s"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    ez = F.get(F.filter("pairs", lambda p: p["z"] == F.col("s.z")), F.lit(0))["ez"]
    each = each.withColumn("ez", ez).withColumn("slot", F.get(F.filter("theirs", lambda e: e["ez"] == F.col("ez")), F.lit(0)))
    at_fixed = yes(F.exists("boxes", lambda b: _near(F.col("s"), b)))
    planned, is_slot = F.col("theirs").isNotNull(), yes(~F.col("slot.is_fixed"))
    other = F.col("slot.content") != F.coalesce("s.content", F.lit(""))
    found = each.select(
        *held, "s.*", "exemplar_id", F.when(F.col("slot").isNotNull(), F.struct(*[F.col(f"slot.{c}").alias(c) for c in OF_SLOT])).alias("slot"), is_slot.alias("is_slot"),
        F.when(planned, yes(F.col("slot.is_fixed"))).otherwise(at_fixed).alias("is_fixed"),
        F.when(planned, F.col("slot").isNull() | (is_slot & yes(other))).otherwise(~at_fixed).alias("is_ours"), inherited(F.col("s"), F.col("slots")).alias("inherited"),
    )
    bare = (F.col("kind") == "text") & (F.trim("text") == "")
    field = yes(F.col("placeholder").isin("sldNum", "ftr", "dt"))
    decor = (F.col("kind") == "picture") & ~F.col("is_slot") & ~F.col("is_ours")
    return found.withColumns({"is_decor": decor, "is_content": (F.col("is_ours") | F.col("is_slot")) & ~field & ~bare})


def lost_fixed(plan: DataFrame, exemplars: DataFrame, shapes: DataFrame, edge: float = 0.12, small: float = 0.25, slide_h: int = geo.SLIDE_H) -> DataFrame:
    """Fixed shapes of a slide's exemplar that the slide lacks (removed) or has elsewhere or larger (moved).

    ``plan`` has (template_id, deck_id, slide_id, slide_idx, exemplar_id); ``shapes`` come from ``in_context``. Nothing is
    missed of captions of zones (text outside the bands at the edges), frames around a photo prompt, placeholders without
    text, small decor inside a slot that the slide leaves empty, and a plate that has grown to the right. Each slide is held
    against what its own exemplar has fixed, so rows grow with slides alone.
    """
    slots = exemplars.where(~F.col("is_fixed")).groupBy("exemplar_id").agg(F.collect_list(F.struct("ez", "x", "y", "w", "h")).alias("slots"))  # bounded: one exemplar's
    prompts = exemplars.where(F.col("photo_prompt")).groupBy("exemplar_id").agg(F.collect_list(F.struct((F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))).alias("prompts"))
    mid = (F.col("y") + F.col("h") > edge * slide_h) & (F.col("y") < (1 - edge) * slide_h)
    caption = (F.col("kind") == "text") & (F.trim("text") != "") & mid
    empty = F.col("placeholder").isNotNull() & (F.trim("text") == "")
    framed = F.exists("prompts", lambda p: (p["cx"] >= F.col("x")) & (p["cx"] <= F.col("x") + F.col("w")) & (p["cy"] >= F.col("y")) & (p["cy"] <= F.col("y") + F.col("h")))
    must = exemplars.where(F.col("is_fixed") & ~caption & ~empty).join(prompts, "exemplar_id", "left").where(~F.coalesce(framed, F.lit(False))).join(slots, "exemplar_id", "left")
    must = must.select("exemplar_id", "ez", *[F.col(c).alias(f"e{c}") for c in "xywh"], "plate_w", "slots")
    must = must.groupBy("exemplar_id").agg(F.collect_list(F.struct(*[c for c in must.columns if c != "exemplar_id"])).alias("must"))  # bounded: one exemplar's
    there = shapes.where("slot is not null").select("slide_id", F.col("slot.ez").alias("ez"), "z", "x", "y", "w", "h").groupBy("slide_id")
    there = there.agg(F.collect_set("ez").alias("filled"), F.collect_list(F.struct("ez", "z", "x", "y", "w", "h")).alias("there"))  # bounded: one slide's
    asked = plan.join(must, "exemplar_id").join(there.hint("merge"), "slide_id", "left").select(*plan.columns, "filled", "there", F.inline("must"))
    asked = asked.withColumn("at", F.explode_outer(F.filter("there", lambda s: s["ez"] == F.col("ez")))).select("*", *[F.col(f"at.{c}").alias(c) for c in "zxywh"])
    empty_card = F.exists("slots", lambda s: ~F.coalesce(F.array_contains("filled", s["ez"]), F.lit(False)) & (F.col("ew") * F.col("eh") <= small * s["w"] * s["h"]) & (F.col("ex") >= s["x"]) & (F.col("ey") >= s["y"]) & (F.col("ex") + F.col("ew") <= s["x"] + s["w"]) & (F.col("ey") + F.col("eh") <= s["y"] + s["h"]))
    off = [F.abs(F.col(c) - F.col(f"e{c}")) > geo.STEP for c in "xyh"]
    wide = (F.col("w") < F.col("ew") - geo.STEP) | (F.col("w") > F.col("ew") + F.greatest(F.col("plate_w"), F.lit(0)) + geo.STEP)
    how = F.when(F.col("z").isNull(), "removed").when(off[0] | off[1] | off[2] | wide, "moved")
    found = asked.where(~F.coalesce(empty_card, F.lit(False))).withColumn("how", how).where("how is not null")
    return found.select("template_id", "deck_id", "slide_id", "slide_idx", "ez", "z", "how", *[F.abs(F.col(c) - F.col(f"e{c}")).alias(f"d{c}") for c in "xywh"])


def displaced_fixed(slides: DataFrame, elements: DataFrame, shapes: DataFrame) -> DataFrame:
    """On slides without an exemplar, logos and footers of the template that are not at their place though a shape of their
    kind and size is there; with the lowest such shape.

    ``elements`` has (template_id, kind, bx, by, bw, bh): boxes on a quarter of a template's slides, so a slide meets a few,
    as an array, and its shapes as another.
    """
    want = elements.where(F.col("kind").isin("logo", "footer")).select("template_id", (F.col("kind") == "logo").alias("picture"), *[(F.col(f"b{c}") * geo.STEP).alias(c) for c in "xywh"]).distinct()
    want = want.groupBy("template_id").agg(F.collect_list(F.struct("picture", "x", "y", "w", "h")).alias("want"))
    there = shapes.groupBy("slide_id").agg(F.collect_list(F.struct("z", (F.col("kind") == "picture").alias("picture"), "x", "y", "w", "h")).alias("there"))  # bounded: one slide's
    asked = slides.join(there, "slide_id").join(want, "template_id").select("deck_id", "slide_id", "slide_idx", "there", F.explode("want").alias("e"))
    at_place = F.exists("there", lambda s: _near(s, F.col("e")))
    moved = F.array_min(F.transform(F.filter("there", lambda s: (s["picture"] == F.col("e.picture")) & _near(s, F.col("e"), "wh")), lambda s: s["z"]))
    return asked.where(~at_place).withColumn("z", moved).where("z is not null").select("deck_id", "slide_id", "slide_idx", "z", F.col("e.x").alias("expected_x"), F.col("e.y").alias("expected_y"))
