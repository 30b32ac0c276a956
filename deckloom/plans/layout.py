"""Queries of classification, matching and text measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, text
from ..operators import layout
from ..sources.fixtures import ARCHETYPES, Fixtures, Prepared
from ..sources.scratch import written
from .audit import overflow
from .views import VIEWS, with_views


def _features(f: Fixtures):
    s = f.shapes()
    a = layout.axes(s).select("slide_id", "columns", "rows", "form")
    t = layout.title_choice(s).select("slide_id", F.lit(True).alias("has_title"))
    n = f.slides().groupBy("deck_id").agg(F.count("*").alias("n_slides"))
    j = layout.features(s).join(a, "slide_id").join(t, "slide_id", "left").join(n, "deck_id")
    k = F.col("slide_id")
    return j.withColumns({"has_title": F.coalesce("has_title", F.lit(False)), "kw_agenda": k % 17 == 0, "kw_closing": k % 13 == 0, "kw_quote": k % 7 == 0})


def _picked(f: Fixtures):
    return layout.pick_archetype(layout.archetype_scores(_features(f)))


def _labels(f: Fixtures):
    names = F.array(*map(F.lit, ("cards", "unheard", "quote")))
    return f.slides().where("slide_id % 4 = 0").select("slide_id", F.element_at(names, (F.col("slide_id") % 3 + 1).cast("int")).alias("label"))


def _demands(f: Fixtures):
    a, k, n = F.col("archetype"), F.col("doc_id"), F.size("bullets")
    return f.outline().withColumns({
        "n_kpis": F.when(a == "kpi", F.least(n, F.lit(4))).otherwise(0), "has_chart": a == "chart", "table_cols": F.when(a == "table", 3 + k % 4).otherwise(0), "has_image": a.isin("image_text", "image_full") & (k % 2 == 0),
        "quote_chars": F.when(a == "quote", F.char_length("title") + 2).otherwise(0), "diagram": F.when(a == "process", F.least(n, F.lit(6))).otherwise(0),
    })


def _chain(f: Fixtures):
    return layout.fallbacks(f.spark)


def _strategies(f: Fixtures):
    rows = [("executive", ["cards", "two_column"], "minimal"), ("detailed", ["bullets", "two_column", "cards"], "preferred"), ("visual", ["image_text", "cards"], "always")]
    return f.spark.createDataFrame(rows, "name string, priority array<string>, images string")


def _scores(f: Fixtures):
    """Every outline follows one of three strategies."""
    k = F.col("outline_id").cast("long") % 3
    need = layout.needs(_demands(f)).withColumn("strategy", F.when(k == 0, "executive").when(k == 1, "detailed").otherwise("visual"))
    chain = written(layout.full_chain(_chain(f), _strategies(f)), "chain")  # a table of constants, looked at for every slide
    return layout.match_scores(need, layout.offers(f.slots()), chain)


def _items(f: Fixtures):
    o, k = f.outline(), F.col("doc_id")
    items = o.select("outline_id", "idx", F.when(k % 4 == 0, "kpi").otherwise("item").alias("what"), F.posexplode("bullets").alias("n", "b")).select("outline_id", "idx", "what", F.col("n").cast("long").alias("n"))
    return layout.allocate(items, o.select("outline_id", "idx", "archetype", (k % 5).alias("bodies"), (k % 3).alias("numbers")))


def _colors(f: Fixtures):
    c = color.with_lab(f.shapes().select("hex", "r", "g", "b").distinct())
    h, s, l = color.hsl(F.col("r"), F.col("g"), F.col("b"))
    lum = color.luminance(F.col("r"), F.col("g"), F.col("b"))
    tint = [F.bround(255 - (255 - F.col(x)) * 0.4, 0).cast("int") for x in "rgb"]
    shade = [F.bround(F.col(x) * 0.5, 0).cast("int") for x in "rgb"]
    code = lambda cs: F.upper(F.concat(*[F.lpad(F.hex(c), 2, "0") for c in cs]))
    return c.select("hex", F.bround(lum, 4).alias("luminance"), F.bround(color.contrast(lum, F.lit(1.0)), 4).alias("on_white"), F.bround(F.sqrt(F.col("lab_a") * F.col("lab_a") + F.col("lab_b") * F.col("lab_b")), 4).alias("chroma"), F.bround(h, 4).alias("hue"), F.bround(s, 4).alias("saturation"), F.bround(l, 4).alias("lightness"), code(tint).alias("tint"), code(shade).alias("shade"))


def _modified(f: Fixtures):
    c = f.shapes().select("hex", "r", "g", "b").distinct()
    made = {"tint": {"tint": 0.4}, "shade": {"shade": 0.5}, "dark": {"lum_mod": 0.75}, "light": {"lum_mod": 0.6, "lum_off": 0.4}}
    return c.select("hex", *[color.modified(F.col("r"), F.col("g"), F.col("b"), **m).alias(n) for n, m in made.items()])


OFFER = ["template_id", "exemplar_id", "archetype", "bodies", "labels", "captions", "numbers", "big_numbers", "pictures", "icons", "charts", "tables", "fill", "columns", "wide", "high", "visible"]

RUN = {
    "a04_lines_over_blocks": lambda f: layout.lines_over_blocks(f.context()),
    "a05_overflow": overflow,
    "c01_title_choice": lambda f: layout.title_choice(f.shapes()),
    "c02_features": lambda f: layout.features(f.shapes()),
    "c03_size_clusters": lambda f: layout.size_clusters(f.shapes(), 2),
    "c04_axes": lambda f: layout.axes(f.shapes()),
    "c05_number_sequence": lambda f: layout.number_sequence(f.shapes().select("slide_id", "z", "x", "y", "w", "h", F.floor(F.col("chars") / 30).alias("value")), 1200000, 2),
    "c06_drawn_bars": lambda f: layout.drawn_bars(f.shapes().withColumns({c: F.floor(F.col(c) / 1500000) * 1500000 for c in "xywh"}), 3, 2),
    "c07_frames": lambda f: layout.enclosing_frames(f.shapes()),
    "c07_photo_zones": lambda f: layout.photo_zones(f.shapes()),
    "c08_scores": lambda f: layout.archetype_scores(_features(f)),
    "c09_pick": _picked,
    "c10_slot_roles": lambda f: layout.slot_roles(f.shapes(), _picked(f), layout.title_choice(f.shapes())),
    "c11_collapse": lambda f: layout.collapse_groups(f.slots(), ("icon", "other", "date")),
    "c12_overlay": lambda f: layout.overlay_labels(_picked(f), _labels(f), ARCHETYPES),
    "x01_needs": lambda f: layout.needs(_demands(f)).drop("item_chars"),
    "x02_offers": lambda f: layout.offers(f.slots()).select(*OFFER, F.col("title.capacity").alias("title_capacity"), F.size("body_places").cast("long").alias("n_bodies"), F.coalesce(F.get("body_places", F.lit(0))["capacity"], F.lit(-1)).alias("first_body"), F.bround("title_over", 4).alias("title_over"), F.bround("picture_over", 4).alias("picture_over")),
    "x03_chain": lambda f: f.outline().select("outline_id", "idx", F.col("archetype").alias("wanted")).join(F.broadcast(layout.candidate_chain(_chain(f), _strategies(f))), "wanted").groupBy("name", "wanted", "archetype", "rank", "penalty").agg(F.count("*").alias("slides")),
    "x04_scores": lambda f: _scores(f),
    "x05_best": lambda f: layout.best_exemplar(_scores(f)),
    "x06_reuse_aware": lambda f: layout.reuse_aware(_scores(f)),
    "x07_label_pairs": lambda f: layout.label_pairs(f.slots()),
    "x08_reading_order": lambda f: layout.reading_order(f.shapes()),
    "x09_allocate": _items,
    "x10_visible_title": lambda f: layout.visible_title(f.slots()),
    "t07_wrapped_lines": lambda f: f.paras().select("doc_id", "para_no", layout.wrapped_lines(F.col("text"), (F.col("doc_id") % 40 + 30).cast("int")).cast("long").alias("lines")),
    "t11_colors": _colors,
    "t12_modifiers": _modified,
    "t13_prompts": lambda f: f.shapes().select("slide_id", "z", F.when(F.col("sk") % 7 == 0, "Title").when(F.col("sk") % 7 == 1, "TBD soon").when(F.col("sk") % 7 == 2, "Имя, фамилия").otherwise(F.col("text")).alias("said")).select("slide_id", "z", text.prompt_pattern(F.col("said")).alias("pattern"), text.is_photo_prompt(F.col("said")).alias("photo"), text.is_speaker_prompt(F.col("said")).alias("speaker")),
}

CLIP = "greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
VIEWS["fx_free"] = "select * from fx_shapes where tag = 'sp' and slide_id not in (select slide_id from fx_shapes where placeholder = 'title')"
VIEWS["fx_titles"] = """select deck_id, slide_id, slide_idx, z, size_pt, median from (select deck_id, slide_id, slide_idx, arg_max(z, (size_pt, -y, -z)) as z, max(size_pt) as size_pt from fx_free where chars <= 80 and (slide_idx = 0 or y < 0.3::double * 6858000) group by 1, 2, 3) t
  left join (select a.slide_id, median(a.size_pt) as median from fx_free a join (select slide_id, arg_max(z, (size_pt, -y, -z)) as tz from fx_free where chars <= 80 and (slide_idx = 0 or y < 0.3::double * 6858000) group by 1) b on a.slide_id = b.slide_id and a.z <> b.tz group by 1) m using (slide_id)
  where median is null or size_pt >= 1.15::double * median union all select deck_id, slide_id, slide_idx, min(z), arg_min(size_pt, z), null from fx_shapes where placeholder = 'title' group by 1, 2, 3"""
VIEWS["fx_features"] = """select deck_id, slide_id, slide_idx, count(*) filter (tag = 'sp') as texts, count(*) filter (tag = 'sp' and ((chars <= 5 and size_pt >= 1.3::double * med) or (chars <= 6 and size_pt >= 2 * med))) as numbers, count(*) filter (tag = 'pic') as pictures, count(*) filter (kind = 'chart') as charts,
  count(*) filter (kind = 'table') as tables, count(*) filter (kind in ('text', 'picture') and (w * h)::double / (12192000::bigint * 6858000) <= 0.01 and w::double / h between 0.6::double and 1.6::double) as icons,
  count(*) filter (coalesce(preset = 'line', false)) as connectors, count(*) filter (coalesce(preset = 'rightArrow', false)) as arrows, count(*) filter (coalesce(preset = 'ellipse', false) and (w * h)::double / (12192000::bigint * 6858000) <= 0.02) as round_marks, max(case when tag = 'pic' then round_even((w * h)::double / (12192000::bigint * 6858000), 4) else 0 end) as big_picture, max(case when tag = 'sp' then round_even((w * h)::double / (12192000::bigint * 6858000), 4) else 0 end) as big_text,
  max(case when tag = 'sp' then chars else 0 end) as longest, max(med) as median, round_even(least(1.0::double, sum(w * h)::double / (12192000::bigint * 6858000)), 4) as fill from fx_shapes left join (select slide_id, median(size_pt) as med from fx_shapes where tag = 'sp' group by 1) using (slide_id) group by 1, 2, 3"""
VIEWS["fx_axes"] = """select deck_id, slide_id, slide_idx, columns, rows, n, case when columns = n and rows = n and n >= 3 then 'staircase' when n >= 12 and columns >= 2 and rows >= 4 then 'table' when columns >= 2 and rows >= 2 then 'grid' when columns = 1 then 'list' else 'row' end as form
  from (select deck_id, slide_id, slide_idx, sum(nc)::bigint as columns, sum(nr)::bigint as rows, count(*) as n from (select *, case when x - lag(x) over (partition by slide_id order by x, z) <= 0.03::double * 12192000 then 0 else 1 end as nc, case when y - lag(y) over (partition by slide_id order by y, z) <= 0.03::double * 6858000 then 0 else 1 end as nr from fx_shapes) group by 1, 2, 3)"""
VIEWS["fx_scores"] = """select deck_id, slide_id, slide_idx, rule, archetype, round_even(least(1.0::double, score), 2) as score from (select deck_id, slide_id, slide_idx, unnest(range(16)) as rule, unnest(['table', 'chart', 'freeform', 'title', 'closing', 'section', 'agenda', 'kpi', 'process', 'team', 'cards', 'two_column', 'bullets', 'image_text', 'image_full', 'quote']) as archetype, unnest([
   case when tables > 0 then 0.95 when form = 'table' then 0.65 else 0 end, case when charts > 0 then 0.95 else 0 end, case when pictures >= 30 or texts + pictures + charts + tables = 0 then 0.9 else 0.3 end,
   case when ht then case when slide_idx = 0 then 0.5 when slide_idx <= 5 then 0.3 else 0 end + case when texts <= 3 then 0.2 else 0 end - case when bl >= 6 then 0.5 else 0 end - case when big_text >= 0.2 then 0.3 else 0 end else 0 end,
   case when slide_id % 13 = 0 then 0.6 + case when slide_idx >= n_slides - 3 then 0.15 else 0 end + case when texts <= 4 then 0.2 else 0 end when slide_idx >= n_slides - 3 and texts <= 3 and ht then 0.4 + case when texts <= 4 then 0.2 else 0 end else 0 end,
   case when ht and slide_idx > 0 and bl <= 1 and big_picture < 0.25 then 0.4 + case when numbers > 0 then 0.15 else 0 end else 0 end,
   case when slide_id % 17 = 0 then 0.5 else 0 end + case when form = 'list' and texts >= 4 then least(0.45, 0.3 + 0.05 * (texts - 4)) + case when round_marks >= texts or icons >= texts then 0.2 else 0 end else 0 end, case when numbers > 0 then 0.5 + 0.15 * least(numbers, 3) - case when big_picture >= 0.25 then 0.2 else 0 end else 0 end,
   case when form = 'staircase' then 0.5 else 0 end + case when form = 'row' and texts >= 3 then 0.4 else 0 end + case when connectors >= 2 then 0.4 when connectors = 1 then 0.2 else 0 end + case when arrows > 0 then 0.3 else 0 end, case when pictures >= 2 and texts >= 2 then 0.6 else 0 end + case when pictures >= 3 then 0.1 else 0 end,
   case when texts >= 3 then 0.5 + least(0.4, 0.1 * (texts - 2)) + case when icons >= texts then 0.15 else 0 end - case when connectors > 0 or arrows > 0 then 0.3 else 0 end - case when form = 'staircase' then 0.3 else 0 end - case when big_picture >= 0.25 then 0.25 else 0 end - case when form = 'table' then 0.4 else 0 end else 0 end, case when texts = 2 and columns = 2 then 0.7 else 0 end,
   case when texts <= 2 and big_text >= 0.1 then 0.7 - case when not ht then 0.3 else 0 end else 0 end, case when big_picture >= 0.1 and big_text >= 0.05 then 0.65 else 0 end, case when big_picture >= 0.25 then 0.6 + case when big_picture >= 0.5 then 0.05 else 0 end else 0 end,
   case when texts = 1 and longest >= 60 and big_picture < 0.25 then 0.5 + case when slide_id % 7 = 0 then 0.3 else 0 end + case when not ht then 0.2 else 0 end else 0 end]::double[]) as score
  from (select f.*, form, columns, t.slide_id is not null as ht, n_slides, texts - numbers - (t.slide_id is not null)::int as bl from fx_features f join (select slide_id, form, columns from fx_axes) a using (slide_id) left join (select slide_id from fx_titles) t using (slide_id) join (select deck_id, count(*) as n_slides from fx_slides group by 1) n using (deck_id))) where round_even(least(1.0::double, score), 2) > 0"""
VIEWS["fx_picked"] = """select *, (score < 0.7 or round_even(score - second_score, 2) <= 0.15) and not (archetype = 'freeform' and score >= 0.7) as ambiguous from (select deck_id, slide_id, slide_idx, max(archetype) filter (k = 1) as archetype, max(score) filter (k = 1) as score, max(archetype) filter (k = 2) as second, coalesce(max(score) filter (k = 2), 0) as second_score
  from (select *, row_number() over (partition by slide_id order by score desc, rule) as k from fx_scores) where k <= 2 group by 1, 2, 3)"""
VIEWS["fx_needs"] = """select outline_id, idx, archetype, len(bullets) as items, coalesce(list_max(list_transform(bullets, lambda b: length(b))), 0) as longest, (coalesce(list_sum(list_transform(bullets, lambda b: length(b))), 0) + 2 * len(bullets))::bigint as total, length(title) as title_chars, list_transform(bullets, lambda b: length(b)) as item_chars,
  archetype = 'chart' as has_chart, archetype in ('image_text', 'image_full') and doc_id % 2 = 0 as has_image, case when archetype = 'kpi' then least(len(bullets), 4) else 0 end as n_kpis, case when archetype = 'table' then 3 + doc_id % 4 else 0 end as table_cols,
  case when archetype = 'quote' then length(title) + 2 else 0 end as quote_chars, case when archetype = 'process' then least(len(bullets), 6) else 0 end as diagram from fx_outline"""
VIEWS["fx_place"] = """select *, {'r': floor(y / 571500.0::double), 'x': x, 's': slot_id, 'c': capacity, 'l': floor(h / 12700.0::double / (1.2::double * size_pt))::bigint, 'a': w * h, 'w': w} as pl, kind not in ('title', 'subtitle', 'slide_number', 'footer', 'date') as own from fx_slots"""
VIEWS["fx_visible"] = """select exemplar_id, arg_min(greatest(0, least(x + w, coalesce(r, x + w)) - greatest(x, coalesce(l, x))), slot_id) as visible from (select t.exemplar_id, t.slot_id, t.x, t.w, max(case when o.x + o.w <= t.x + t.w / 2.0 then o.x + o.w end) as l, min(case when o.x > t.x + t.w / 2.0 then o.x end) as r
  from fx_slots t left join fx_slots o on t.exemplar_id = o.exemplar_id and o.kind <> 'title' and o.y < t.y + t.h and o.y + o.h > t.y where t.kind = 'title' group by 1, 2, 3, 4) group by 1"""
VIEWS["fx_offer0"] = """select template_id, exemplar_id, archetype, confidence, count(*) filter (kind = 'body') as bodies, count(*) filter (kind = 'label') as labels, count(*) filter (kind = 'caption') as captions, count(*) filter (kind = 'number') as numbers, count(*) filter (kind = 'picture') as pictures, count(*) filter (kind = 'icon') as icons,
  count(*) filter (kind = 'chart') as charts, count(*) filter (kind = 'table') as tables, coalesce(list(pl order by pl) filter (kind = 'body'), []) as body_pl, coalesce(list(pl order by pl) filter (kind = 'subtitle'), []) as sub_pl, coalesce(list(pl order by pl) filter (kind in ('label', 'caption')), []) as label_pl, coalesce(list(pl order by pl) filter (kind in ('chart', 'table')), []) as data_pl,
  min(slot_id) filter (kind = 'title') as tid, arg_min(slot_id, pl) filter (kind = 'picture') as pid, median(size_pt) filter (kind = 'number') as npt, coalesce(list(size_pt) filter (kind = 'number'), []) as nsz, round_even(least(1.0::double, sum(w * h)::double / (12192000::bigint * 6858000)), 4) as fill,
  min(x) filter (own) as lf, min(y) filter (own) as tp, max(x + w) filter (own) - min(x) filter (own) as wide, max(y + h) filter (own) - min(y) filter (own) as high from fx_place group by 1, 2, 3, 4"""
VIEWS["fx_columns"] = "select exemplar_id, 1 + count(*) filter (gap > narrow // 2) as cs from (select exemplar_id, x - lag(x) over (partition by exemplar_id order by x, slot_id) as gap, min(w) over (partition by exemplar_id) as narrow from fx_slots where kind = 'body') group by 1"
VIEWS["fx_over"] = """select a.exemplar_id, a.slot_id, max(case when b.kind in ('body', 'picture', 'chart', 'table') then i::double / (a.w * a.h) end) as over_t, max(case when b.kind in ('body', 'label', 'caption', 'number') then i::double / (b.w * b.h) end) as over_p
  from (select a.*, b.kind as bk, b.w as bw, b.h as bh, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as i from fx_slots a join fx_slots b on a.exemplar_id = b.exemplar_id) a, (select 1) z, lateral (select a.bk as kind, a.bw as w, a.bh as h) b group by 1, 2"""
VIEWS["fx_offers"] = """select o.*, t.x as tx, t.y as ty, t.w as tw, t.h as th, t.capacity as title_capacity, t.size_pt as tpt, coalesce(cs, 0) as columns, len(list_filter(nsz, lambda v: v >= 0.65::double * npt)) as big_numbers, coalesce(ot.over_t, 0) as title_over, coalesce(op.over_p, 0) as picture_over, visible
  from fx_offer0 o left join fx_slots t on t.exemplar_id = o.exemplar_id and t.slot_id = tid left join fx_columns c on c.exemplar_id = o.exemplar_id left join fx_over ot on ot.exemplar_id = o.exemplar_id and ot.slot_id = tid left join fx_over op on op.exemplar_id = o.exemplar_id and op.slot_id = pid left join fx_visible v on v.exemplar_id = o.exemplar_id"""
VIEWS["fx_chain"] = """select * from (values
 ('title', 'title', 0), ('title', 'section', 1), ('title', 'closing', 2), ('title', 'bullets', 3), ('title', 'cards', 4), ('title', 'two_column', 5), ('title', 'image_text', 6), ('title', 'agenda', 7),
 ('section', 'section', 0), ('section', 'title', 1), ('section', 'closing', 2), ('section', 'bullets', 3), ('section', 'cards', 4), ('section', 'two_column', 5), ('section', 'image_text', 6), ('section', 'agenda', 7),
 ('agenda', 'agenda', 0), ('agenda', 'cards', 1), ('agenda', 'bullets', 2), ('agenda', 'section', 3), ('agenda', 'title', 4), ('agenda', 'closing', 5),
 ('bullets', 'bullets', 0), ('bullets', 'cards', 1), ('bullets', 'two_column', 2), ('bullets', 'image_text', 3), ('bullets', 'agenda', 4), ('bullets', 'section', 5), ('bullets', 'title', 6), ('bullets', 'closing', 7),
 ('two_column', 'two_column', 0), ('two_column', 'cards', 1), ('two_column', 'bullets', 2), ('two_column', 'image_text', 3), ('two_column', 'section', 4), ('two_column', 'title', 5), ('two_column', 'closing', 6),
 ('cards', 'cards', 0), ('cards', 'bullets', 1), ('cards', 'two_column', 2), ('cards', 'agenda', 3), ('cards', 'section', 4), ('cards', 'title', 5), ('cards', 'closing', 6),
 ('kpi', 'kpi', 0), ('kpi', 'cards', 1), ('kpi', 'bullets', 2), ('kpi', 'section', 3), ('kpi', 'title', 4), ('kpi', 'closing', 5),
 ('chart', 'chart', 0), ('chart', 'table', 1), ('chart', 'bullets', 2), ('chart', 'cards', 3), ('chart', 'two_column', 4), ('chart', 'image_text', 5), ('chart', 'agenda', 6),
 ('table', 'table', 0), ('table', 'chart', 1), ('table', 'cards', 2), ('table', 'bullets', 3), ('table', 'cards', 4), ('table', 'two_column', 5), ('table', 'image_text', 6), ('table', 'agenda', 7),
 ('process', 'process', 0), ('process', 'cards', 1), ('process', 'agenda', 2), ('process', 'bullets', 3), ('process', 'section', 4), ('process', 'title', 5), ('process', 'closing', 6),
 ('quote', 'quote', 0), ('quote', 'section', 1), ('quote', 'image_text', 2), ('quote', 'bullets', 3), ('quote', 'title', 4),
 ('image_text', 'image_text', 0), ('image_text', 'bullets', 1), ('image_text', 'cards', 2), ('image_text', 'section', 3), ('image_text', 'title', 4), ('image_text', 'closing', 5),
 ('image_full', 'image_full', 0), ('image_full', 'image_text', 1), ('image_full', 'bullets', 2), ('image_full', 'cards', 3), ('image_full', 'two_column', 4), ('image_full', 'image_text', 5), ('image_full', 'agenda', 6), ('image_full', 'section', 7), ('image_full', 'title', 8), ('image_full', 'closing', 9),
 ('team', 'team', 0), ('team', 'cards', 1), ('team', 'bullets', 2), ('team', 'cards', 3), ('team', 'two_column', 4), ('team', 'image_text', 5), ('team', 'agenda', 6), ('team', 'section', 7), ('team', 'title', 8), ('team', 'closing', 9),
 ('closing', 'closing', 0), ('closing', 'title', 1), ('closing', 'section', 2), ('closing', 'bullets', 3), ('closing', 'cards', 4), ('closing', 'two_column', 5), ('closing', 'image_text', 6), ('closing', 'agenda', 7),
 ('freeform', 'freeform', 0), ('freeform', 'bullets', 1), ('freeform', 'cards', 2), ('freeform', 'two_column', 3), ('freeform', 'section', 4), ('freeform', 'title', 5), ('freeform', 'closing', 6)) c(wanted, archetype, rank)"""
VIEWS["fx_steps"] = """with st as (select * from (values ('executive', ['cards', 'two_column'], 0.5, -3.0), ('detailed', ['bullets', 'two_column', 'cards'], 3.0, -5.0), ('visual', ['image_text', 'cards'], 5.0, -5.0)) v(name, pr, pic, bare)),
 c as (select name, pic, bare, wanted, archetype, rank, wanted in ('bullets', 'cards', 'two_column', 'image_text') as flex, archetype in ('bullets', 'cards', 'two_column', 'image_text') as fl, coalesce(nullif(list_position(pr, archetype), 0), 100) as place from fx_chain, st),
 r as (select name, pic, bare, wanted, archetype, case when flex then row_number() over (partition by name, wanted order by not (flex and fl), case when flex and fl then place else 0 end, not (flex and fl and archetype = wanted), rank) - 1 else rank end as rank, case when flex then 2.0 else 4.0 end::double as penalty, false as drawn from c)
 select * from r union all select distinct name, pic, bare, wanted, d.a, d.k, penalty, true from r, (values ('bullets', 0), ('two_column', 1), ('cards', 2), ('image_text', 3), ('agenda', 4)) d(a, k)"""
CAP = "case when {h} = {n} then 2.0 when {h} < {n} then -{s} * ({n} - {h}) else -{e} * ({h} - {n}) end"
TIGHT = "len(list_filter(range(1, least(len({l}), items) + 1), lambda i: {l}[i].c > 0 and {l}[i].c < item_chars[i]))"
VIEWS["fx_pairs"] = """select *, case when dia then [] when in_body then list_filter(re, lambda x: x.s <> big.s) else re end as pls from (select n.* exclude (archetype), o.*, rank, penalty, pic, bare, c.wanted, has_chart or table_cols > 0 as data, quote_chars > 0 as quo, diagram > 0 as dia, (has_chart or table_cols > 0) and charts + tables = 0 as in_body, tid is not null as ht,
  list_sort(list_transform(body_pl, lambda x: {'a': -x.a, 's': x.s, 'w': x.w}))[1] as big, case when len(body_pl) = 0 and o.archetype in ('title', 'section', 'closing') and (items > 0 or n_kpis > 0) then sub_pl else body_pl end as re from fx_needs n join fx_steps c on n.archetype = c.wanted and c.drawn = (n.diagram > 0) and c.name = case n.outline_id::int % 3 when 0 then 'executive' when 1 then 'detailed' else 'visual' end join fx_offers o on o.archetype = c.archetype and o.archetype <> 'freeform')"""
VIEWS["fx_match"] = f"""select outline_id, idx, template_id, exemplar_id, archetype, rank, penalty, archetype in ('title', 'section', 'closing') and wanted not in ('title', 'section', 'closing', 'quote') as reserve, round_even(confidence
   + case when title_chars > 0 and not ht and not quo then case when len(sub_pl) > 0 then -2.0 else -5.0 end when ht and title_capacity > 0 and title_chars > title_capacity then -3.0 else 0 end
   + case when ht and title_over > 0.2::double then -5.0 - case when title_chars > floor(floor(tw / 12700.0::double / (0.5::double * tpt)) * visible / tw) then 8 else 0 end else 0 end
   + case when in_body then -6.0 - nar when data then case when (has_chart and charts > 0) or (table_cols > 0 and tables > 0) then 2.0 else 0 end - 3.0 * (charts + tables - 1) - nar else 0 end
   + case when dia then 4.0::double * least(1.0::double, shr / 0.4::double) + case when columns > 1 then case when columns = diagram then 2.0 else -8.0 end else 0 end else 0 end
   + case when quo and not hd and n > 0 and pls[1].c > 0 and quote_chars > pls[1].c then -3.0 else 0 end
   + case when n_kpis = 0 then 0 when numbers > 0 then {CAP.format(h='big_numbers', n='n_kpis', e='2.0', s='5.0')} when archetype = 'cards' then {CAP.format(h='labels', n='n_kpis', e='1.5', s='5.0')} - 1 when n = 1 and pls[1].l >= n_kpis then -1.0 else -3.0 * n_kpis end
   + case when items = 0 then 0 when n = 1 then case when items <= cp then 1.0 else -1.5 * (items - cp) end - case when pls[1].c > 0 and total > pls[1].c then 6 else 0 end
     when n > 1 then {CAP.format(h='n', n='items', e='5.0', s='6.0')} - case when 2 * items <= n then 4 else 0 end - case when labels > 0 then abs(labels - n) else 0 end - 4.0 * {TIGHT.format(l='pls')}
     when labels + captions > 0 then {CAP.format(h='(labels + captions)', n='items', e='5.0', s='3.0')} - 1 - case when 2 * items <= labels + captions then 4 else 0 end - 4.0 * {TIGHT.format(l='label_pl')} else -2.0 * items end
   + case when pictures = 0 then 0 when has_image then pic - 2.5 * (pictures - 1) - case when picture_over >= 0.5::double then 8 else 0 end else bare end
   + case when icons > 0 then 1.0 else 0 end - case when fill > 0.75::double then 10.0::double * (fill - 0.75::double) else 0 end, 2)::double as score
  from (select *, len(pls) as n, archetype in ('section', 'title') as hd, case when pls[1].l > 0 then pls[1].l else 6 end as cp, wide * high / (12192000 * 6858000.0::double) as shr, case when table_cols > 0 and case when in_body then big.w else data_pl[1].w end / table_cols::double < 914400 then 3.0 else 0.0 end as nar from fx_pairs)
  where not coalesce((in_body and bodies = 0) or (dia and (bodies = 0 or wide is null or shr < 0.15::double or wide < 1.3::double * high or coalesce(greatest(0, least(tx + tw, lf + wide) - greatest(tx, lf)) * greatest(0, least(ty + th, tp + high) - greatest(ty, tp)) > 0.2::double * tw * th, false))) or (quo and ((hd and not ht) or (not hd and n = 0))), false)"""
VIEWS["fx_rated"] = "select outline_id, idx, template_id, exemplar_id, score, reserve from (select outline_id, idx, template_id, exemplar_id, max(score - penalty * rank)::double as score, bool_and(reserve) as reserve from fx_match group by 1, 2, 3, 4) qualify not reserve or bool_and(reserve) over (partition by outline_id, idx, template_id)"
WRAP = "coalesce(list_reduce(list_prepend(0::bigint, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: length(x))), lambda a, n: case when a % 1000000 > 0 and a % 1000000 + 1 + n <= wd then a + 1 + n else (a // 1000000 + ceil(n * 1.0 / wd)::bigint) * 1000000 + n - (ceil(n * 1.0 / wd)::bigint - 1) * wd end), 0)"

SQL = {
    "a04_lines_over_blocks": """with t as (select *, trunc(1.2::double * size_pt * 12700)::bigint as high, ceil(chars / greatest(1, floor(w / 12700.0::double / (0.5::double * size_pt))))::bigint as lines, coalesce(ceil(e_chars / greatest(1, floor(ew / 12700.0::double / (0.5::double * e_pt))))::bigint, 0) as known from fx_context where tag = 'sp' and is_ours),
 l as (select a.*, b.z as other_z, b.y as top, b.y + b.h as foot, greatest((b.y - a.y) // a.high, a.known) + 1 as line from t a join fx_shapes b on a.slide_id = b.slide_id and b.tag <> 'sp' and least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) and b.y >= a.y + a.h)
select deck_id, slide_id, slide_idx, z, other_z, line, y + lines * high - top as depth from l where line <= lines and y + (line - 1) * high < foot""",
    "a05_overflow": f"""with p as (select doc_id, text, doc_id % 40 + 30 as wd from fx_paras), l as (select doc_id, wd, length(text) as n, case when doc_id % 11 <> 0 then greatest(1, {WRAP} // 1000000) else 1 end as lines from p),
 s as (select doc_id, sum(lines)::bigint as lines, count(*) as paras, max(n) as longest, any_value(wd) as wd from l group by 1),
 n as (select *, round_even(case when doc_id % 11 <> 0 then lines * 12.0::double * 1.2::double + (paras - 1) * 3.0::double else 6.0::double * longest end, 2) as need_pt, case when doc_id % 11 <> 0 then 300.0::double else 6.0::double * wd end as have_pt from s)
select doc_id, lines, need_pt, have_pt, case when doc_id % 7 = 0 then 'warning' else 'error' end as severity from n where need_pt > 1.1::double * have_pt + 2 and not (doc_id % 5 = 0 and lines <= 2)""",
    "c01_title_choice": "select * from fx_titles",
    "c02_features": "select * from fx_features",
    "c03_size_clusters": """with recursive o as (select slide_id, w, h, row_number() over (partition by slide_id order by w, h, z) as k from fx_shapes), walk as (select deck_id, slide_id, slide_idx, 0::bigint as k, []::struct(w bigint, h bigint, n bigint)[] as acc from (select distinct deck_id, slide_id, slide_idx from fx_shapes)
  union all select d, s, i, kk, case when at_ > 0 then list_transform(acc, lambda e, j: {'w': e.w, 'h': e.h, 'n': e.n + case when j = at_ then 1 else 0 end}) else list_append(acc, {'w': w, 'h': h, 'n': 1}) end
   from (select walk.deck_id as d, walk.slide_id as s, walk.slide_idx as i, o.k as kk, acc, o.w, o.h, coalesce(list_position(list_transform(acc, lambda e: abs(e.w - o.w) <= 0.02::double * 12192000 and abs(e.h - o.h) <= 0.06::double * 6858000), true), 0) as at_ from walk join o on o.slide_id = walk.slide_id and o.k = walk.k + 1)),
 last as (select deck_id, slide_id, slide_idx, unnest(arg_max(acc, k)) as e from walk group by 1, 2, 3)
select deck_id, slide_id, slide_idx, e.w as w, e.h as h, e.n as n from last where e.n >= 2""",
    "c04_axes": "select * from fx_axes",
    "c05_number_sequence": """with b as (select slide_id, z, chars // 30 as v, unnest(['row', 'col']) as axis, unnest([y + h / 2.0, x + w / 2.0]) as at_ from fx_shapes), j as (select distinct a.slide_id, a.axis, a.z as anchor, c.v from b a join b c on a.slide_id = c.slide_id and a.axis = c.axis and abs(a.at_ - c.at_) <= 1200000),
 i as (select *, v - row_number() over (partition by slide_id, axis, anchor order by v) as island from j), r as (select slide_id, axis, anchor, island, count(*) as n, min(v) as first from i group by 1, 2, 3, 4), k as (select *, row_number() over (partition by slide_id, axis order by n desc, first) as k from r)
select slide_id, axis, n, first from k where k = 1 and n >= 2""",
    "c06_drawn_bars": """with s as (select slide_id, x // 1500000 * 1500000 as x, y // 1500000 * 1500000 as y, w // 1500000 * 1500000 as w, h // 1500000 * 1500000 as h from fx_shapes),
 u as (select slide_id, 'columns' as form, w as a, y + h as e, h as v from s union all select slide_id, 'bars', h, x, w from s)
select slide_id, form, round_even(a / 45720.0, 0)::bigint as size, round_even(e / 45720.0, 0)::bigint as edge, count(*) as n, count(distinct v) as kinds from u group by 1, 2, 3, 4 having count(*) >= 3 and count(distinct v) >= 2""",
    "c07_photo_zones": """with p as (select * from fx_shapes where tag = 'sp' and text = 'insert photo'), f as (select p.slide_id, p.z, b.z as frame_z, row_number() over (partition by p.slide_id, p.z order by b.w * b.h, b.z) as k from p join fx_shapes b on p.slide_id = b.slide_id and p.z <> b.z and b.w * b.h > p.w * p.h and p.x + p.w / 2.0 between b.x and b.x + b.w and p.y + p.h / 2.0 between b.y and b.y + b.h)
select deck_id, slide_id, slide_idx, p.z, coalesce(frame_z, p.z) as zone_z from p left join (select * from f where k = 1) f using (slide_id, z)""",
    "c07_frames": """with f as (select a.deck_id, a.slide_id, a.slide_idx, a.z, b.z as frame_z, row_number() over (partition by a.slide_id, a.z order by b.w * b.h, b.z) as k from fx_shapes a join fx_shapes b on a.slide_id = b.slide_id and a.z <> b.z and b.w * b.h > a.w * a.h
   and a.x + a.w / 2.0 between b.x and b.x + b.w and a.y + a.h / 2.0 between b.y and b.y + b.h where a.tag = 'sp')
select deck_id, slide_id, slide_idx, z, frame_z from f where k = 1""",
    "c08_scores": "select * from fx_scores",
    "c09_pick": "select * from fx_picked",
    "c10_slot_roles": """with s as (select s.*, archetype, t.z as tz, s.tag = 'sp' and coalesce(s.z <> t.z, true) as is_text from fx_shapes s join (select slide_id, archetype from fx_picked) p using (slide_id) left join (select slide_id, z from fx_titles) t using (slide_id)), k as (select *, row_number() over (partition by slide_id, is_text order by y, x, z) as k from s)
select deck_id, slide_id, slide_idx, z, case when coalesce(z = tz, false) then 'title' when tag = 'pic' then 'picture' when kind in ('chart', 'table') then kind when archetype in ('title', 'section', 'closing') and k = 1 then 'subtitle'
 when archetype = 'kpi' and chars <= 5 then 'number' when archetype in ('kpi', 'cards', 'team') and chars <= 15 then 'label' else 'body' end as role, case when tag = 'sp' then trunc(0.9::double * floor(w / 12700.0::double / (0.5::double * size_pt)) * floor(h / 12700.0::double / (1.2::double * size_pt)))::bigint end as capacity from k""",
    "c11_collapse": """with g as (select template_id, exemplar_id, min(x) as gx, min(y) as gy, max(x + w) as gx2, max(y + h) as gy2 from fx_slots where kind in ('icon', 'other', 'date') group by 1, 2 having count(*) >= 2)
select template_id, exemplar_id, slot_id, kind, x, y, w, h from fx_slots left join g using (template_id, exemplar_id) where gx is null or not (x >= gx and y >= gy and x + w <= gx2 and y + h <= gy2) union all select template_id, exemplar_id, -1, 'group', gx, gy, gx2 - gx, gy2 - gy from g""",
    "c12_overlay": """with p as (select *, case when slide_id % 4 = 0 then ['cards', null, 'quote'][slide_id % 3 + 1] end as label from fx_picked)
select deck_id, slide_id, slide_idx, coalesce(label, archetype) as archetype, label is not null as from_label from p""",
    "x01_needs": "select * exclude (item_chars) from fx_needs",
    "x02_offers": "select template_id, exemplar_id, archetype, bodies, labels, captions, numbers, big_numbers, pictures, icons, charts, tables, fill, columns, wide, high, visible, title_capacity, len(body_pl) as n_bodies, coalesce(body_pl[1].c, -1) as first_body, round_even(title_over, 4) as title_over, round_even(picture_over, 4) as picture_over from fx_offers",
    "x03_chain": "select name, wanted, r.archetype, r.rank, penalty, count(*) as slides from fx_outline o join fx_steps r on o.archetype = r.wanted where not drawn group by all",
    "x04_scores": "select * from fx_match",
    "x05_best": "select outline_id, idx, template_id, arg_max(exemplar_id, (score, -exemplar_id)) as exemplar_id, max(score) as score from fx_rated group by 1, 2, 3",
    "x06_reuse_aware": """with recursive c as (select *, max(score) over (partition by outline_id, template_id, idx) as best from fx_rated), d as (select outline_id, template_id, idx, list({'e': exemplar_id, 's': score}) as opts, row_number() over (partition by outline_id, template_id order by idx) as n from c where score >= best - 6 group by 1, 2, 3),
 walk as (select outline_id, template_id, 0::bigint as n, []::bigint[] as used, null::bigint as idx, null::bigint as exemplar_id from (select distinct outline_id, template_id from d)
  union all select outline_id, template_id, n, list_append(used, pick), idx, pick from (select w.outline_id, w.template_id, d.n, w.used, d.idx, list_sort(list_transform(d.opts, lambda o: {'l': -(o.s - 2.0 * least(len(list_filter(w.used, lambda u: u = o.e)), 3))::double, 'e': o.e}))[1].e as pick from walk w join d on d.outline_id = w.outline_id and d.template_id = w.template_id and d.n = w.n + 1))
select outline_id, template_id, idx, exemplar_id from walk where n > 0""",
    "x07_label_pairs": """with recursive pr as (select b.exemplar_id, b.slot_id as body, l.slot_id as l, case when l.x < b.x + b.w and b.x < l.x + l.w and l.y <= b.y + b.h // 4 then abs(b.y - l.y - l.h) when l.y < b.y + b.h and b.y < l.y + l.h and l.x + l.w <= b.x + b.w // 4 and b.x - l.x - l.w <= l.h then abs(b.x - l.x - l.w) end as d
   from fx_slots b join fx_slots l on b.exemplar_id = l.exemplar_id and b.kind in ('body', 'table', 'chart') and l.kind in ('label', 'caption', 'number')),
 nr as (select exemplar_id, body, list({'d': d, 'l': l}) as c, row_number() over (partition by exemplar_id order by body) as n from pr where d is not null group by exemplar_id, body),
 walk as (select exemplar_id, 0::bigint as n, []::bigint[] as used, null::bigint as body, null::bigint as label from (select distinct exemplar_id from nr)
  union all select exemplar_id, n, case when f is null then used else list_append(used, f) end, body, f from (select w.exemplar_id, nr.n, w.used, nr.body, list_sort(list_filter(nr.c, lambda q: not list_contains(w.used, q.l)))[1].l as f from walk w join nr on nr.exemplar_id = w.exemplar_id and nr.n = w.n + 1)),
 ob as (select exemplar_id, slot_id, row_number() over (partition by exemplar_id order by slot_id) as k from fx_slots where kind in ('body', 'table', 'chart')), ol as (select exemplar_id, slot_id, row_number() over (partition by exemplar_id order by slot_id) as k from fx_slots where kind in ('label', 'caption', 'number'))
select exemplar_id, body, label from walk where label is not null union all select ob.exemplar_id, ob.slot_id, ol.slot_id from ob join ol on ob.exemplar_id = ol.exemplar_id and ob.k = ol.k where ob.exemplar_id not in (select exemplar_id from nr)""",
    "x08_reading_order": "select deck_id, slide_id, slide_idx, z, tag, row_number() over (partition by slide_id, tag order by floor(y / 571500.0::double), x, z) as n from fx_shapes",
    "x09_allocate": """with i as (select outline_id, idx, archetype, case when doc_id % 4 = 0 then 'kpi' else 'item' end as what, greatest(case when doc_id % 4 = 0 then doc_id % 3 else doc_id % 5 end, 1) as c, doc_id % 4 <> 0 and doc_id % 5 = 1 as listed, unnest(range(len(bullets))) as n from fx_outline),
 p as (select *, case when listed then 0 else n // c end as page from i)
select outline_id, idx, what, n, page, case when listed then 0 else n % c end as slot, archetype in ('title', 'closing') and page > 0 as dropped from p""",
    "x10_visible_title": """with j as (select t.exemplar_id, t.slot_id, t.x, t.w, max(case when o.x + o.w <= t.x + t.w / 2.0 then o.x + o.w end) as l, min(case when o.x > t.x + t.w / 2.0 then o.x end) as r from fx_slots t left join fx_slots o on t.exemplar_id = o.exemplar_id and o.kind <> 'title' and o.y < t.y + t.h and o.y + o.h > t.y where t.kind = 'title' group by 1, 2, 3, 4)
select exemplar_id, slot_id, greatest(0, least(x + w, coalesce(r, x + w)) - greatest(x, coalesce(l, x))) as visible from j""",
    "t07_wrapped_lines": f"""with p as (select doc_id, para_no, text, doc_id % 40 + 30 as wd from fx_paras)
select doc_id, para_no, greatest(1, {WRAP} // 1000000) as lines from p""",
    "t12_modifiers": """with d as (select distinct hex, r, g, b from fx_shapes), m as (select *, greatest(r, g, b) / 255.0::double as mx, least(r, g, b) / 255.0::double as mn from d),
 q as (select *, (mx + mn) / 2 as l, case when mx = mn then 0 when mx + mn <= 1 then (mx - mn) / (mx + mn) else (mx - mn) / (2 - mx - mn) end as s, case when mx = mn then 0 when r = greatest(r, g, b) then (g - b) / 255.0::double / (mx - mn) when g = greatest(r, g, b) then 2 + (b - r) / 255.0::double / (mx - mn) else 4 + (r - g) / 255.0::double / (mx - mn) end / 6.0::double as h0 from m),
 e as (select hex, r, g, b, s, h0 - floor(h0) as h, l, unnest(['dark', 'light']) as what, unnest([l * 0.75::double, l * 0.6::double + 0.4::double]) as l2 from q),
 f as (select *, case when l2 <= 0.5 then l2 * (1 + s) else l2 + s - l2 * s end as m2 from e), k as (select *, 2 * l2 - m2 as m1, unnest(['r', 'g', 'b']) as ch, unnest([h + 1.0::double / 3, h, h - 1.0::double / 3]) as t0 from f), t as (select *, t0 - floor(t0) as t from k),
 c as (select hex, what, ch, round_even((case when s = 0 then l2 when t < 1.0::double / 6 then m1 + (m2 - m1) * t * 6 when t < 0.5 then m2 when t < 2.0::double / 3 then m1 + (m2 - m1) * (2.0::double / 3 - t) * 6 else m1 end) * 255, 0)::int as v from t),
 o as (select hex, what, printf('%02X%02X%02X', max(v) filter (ch = 'r'), max(v) filter (ch = 'g'), max(v) filter (ch = 'b')) as code from c group by 1, 2)
select d.hex, printf('%02X%02X%02X', round_even(255 - (255 - r) * 0.4::double, 0)::int, round_even(255 - (255 - g) * 0.4::double, 0)::int, round_even(255 - (255 - b) * 0.4::double, 0)::int) as tint, printf('%02X%02X%02X', round_even(r * 0.5, 0)::int, round_even(g * 0.5, 0)::int, round_even(b * 0.5, 0)::int) as shade,
 dk.code as dark, lt.code as light from d join o dk on dk.hex = d.hex and dk.what = 'dark' join o lt on lt.hex = d.hex and lt.what = 'light'""",
    "t13_prompts": """with s as (select slide_id, z, case sk % 7 when 0 then 'Title' when 1 then 'TBD soon' when 2 then 'Имя, фамилия' else text end as said from fx_shapes)
select slide_id, z, case said when 'Title' then -1 when 'TBD soon' then 3 when 'insert photo' then 8 end as pattern, said = 'insert photo' as photo, said = 'Имя, фамилия' as speaker from s""",
    "t11_colors": """with d as (select distinct hex, r, g, b from fx_shapes), LAB(d), h as (select *, greatest(r, g, b) as mx, least(r, g, b) as mn from lab_d),
 q as (select *, case when mx = mn then 0 when r = mx then (g - b) * 1.0::double / (mx - mn) when g = mx then 2 + (b - r) * 1.0::double / (mx - mn) else 4 + (r - g) * 1.0::double / (mx - mn) end / 6.0::double as hu from h)
select hex, round_even(lum, 4) as luminance, round_even(1.05 / (lum + 0.05), 4) as on_white, round_even(sqrt(la * la + lbb * lbb), 4) as chroma, round_even(hu - floor(hu), 4) as hue, round_even(case when mx = mn then 0 when mx + mn <= 255 then (mx - mn) * 1.0::double / (mx + mn) else (mx - mn) * 1.0::double / (510 - mx - mn) end, 4) as saturation,
 round_even((mx + mn) / 510.0::double, 4) as lightness, printf('%02X%02X%02X', round_even(255 - (255 - r) * 0.4::double, 0)::int, round_even(255 - (255 - g) * 0.4::double, 0)::int, round_even(255 - (255 - b) * 0.4::double, 0)::int) as tint, printf('%02X%02X%02X', round_even(r * 0.5, 0)::int, round_even(g * 0.5, 0)::int, round_even(b * 0.5, 0)::int) as shade from q""",
}

#: Queries that look at shapes several times.
MANY = ("c08_scores", "c09_pick", "c10_slot_roles", "c12_overlay", "c07_photo_zones", "x02_offers", "x04_scores", "x05_best", "x06_reuse_aware")
QUERIES = {name: (lambda spark, sf_dir, run=run, f=Prepared if name in MANY else Fixtures: run(f(spark, sf_dir))) for name, run in RUN.items()}
RAW = SQL
SQL = {name: with_views(sql) for name, sql in RAW.items()}
