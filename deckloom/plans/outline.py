"""Queries of the outline operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import outline
from ..sources.fixtures import ARCHETYPES, Fixtures
from .views import NAMES, with_views

YEARS = list(range(1992, 1999))


def _points(f: Fixtures):
    at = F.col("year") - 1992
    return f.charts().select("deck_id", "series", at.alias("at"), F.when(F.col("value") % 19 != 0, F.col("value")).alias("value"))


def _cells(f: Fixtures):
    c = F.array(F.struct(F.lit("name").alias("col"), F.col("p_name").alias("cell")), F.struct(F.lit("size").alias("col"), F.concat(F.lit("×"), F.col("p_size").cast("string")).alias("cell")), F.struct(F.lit("delta size").alias("col"), F.col("p_size").cast("string").alias("cell")), F.struct(F.lit("share").alias("col"), F.concat(F.lit("−"), F.col("p_size").cast("string"), F.lit(" %")).alias("cell")))
    return f.table("part").select((F.col("p_partkey") % 50).alias("table_id"), F.col("p_partkey").alias("row"), F.inline(c))


def _choice(f: Fixtures):
    s = f.charts().groupBy("deck_id").agg(F.countDistinct("series").alias("n_series"), F.countDistinct("year").alias("n_points"))
    return outline.choose_form(s, f.spark.createDataFrame([("executive", "numbers"), ("detailed", "tables"), ("visual", "charts")], "name string, data string"))


def _kpis(f: Fixtures):
    return f.slides().select("deck_id", F.col("slide_idx").alias("idx"), (F.col("slide_id") % 12).alias("n_kpis"))


def _grounding(f: Fixtures):
    d = f.table("documents").select("lang", F.col("doc_id").alias("item_id"), "text")
    return outline.ungrounded(d.where("item_id % 2 = 1"), d.where("item_id % 2 = 0"), "lang")


def _told(f: Fixtures):
    """Slides with key numbers, charts and tables out of their documents' numbers, and the documents that they may rest on."""
    k, n = F.col("doc_id"), F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    d = f.table("documents").select("doc_id", F.coalesce(F.get(n, F.lit(0)), (k % 90).cast("string")).alias("number"))
    o = f.outline().withColumnRenamed("section", "lang").join(d, "doc_id")
    kpis = F.array(F.struct(F.concat("number", F.lit(" %")).alias("value"), F.substring("title", 1, 20).alias("label")), F.struct(F.lit("many").alias("value"), F.lit("").alias("label")))
    point = lambda c, v: F.struct(F.lit(c).alias("category"), v.alias("value"))
    chart = F.array(F.struct(F.lit("s").alias("name"), F.array(point("a", F.col("number")), point("b", (k % 40).cast("string"))).alias("points")))
    a = F.col("archetype")
    slides = o.select(
        "lang", "outline_id", "idx", "doc_id", a, F.when(k % 3 == 0, F.slice("bullets", 1, 0)).otherwise(F.col("bullets")).alias("bullets"), F.when((a == "kpi") | (k % 5 == 0), kpis).alias("kpis"), F.when((a == "chart") | (k % 7 == 0), chart).alias("chart"),
        F.when((a == "table") | (k % 11 == 0), F.array(F.array(F.lit("x"), F.col("number")), F.array(F.lit("y"), F.lit("z")))).alias("table"),
    )
    return outline.ground_outline(slides, f.table("documents").where("doc_id % 2 = 0"), "lang")


def _grounded(f: Fixtures):
    s, _ = _told(f)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return s.select("doc_id", "archetype", size("bullets").alias("n_bullets"), F.md5(F.array_join("bullets", "|").cast("binary")).alias("digest"), *[(size(c) > 0).alias(f"has_{c}") for c in ("kpis", "chart", "table")])


def _sized(f: Fixtures):
    k, a, n = F.col("doc_id"), F.col("archetype"), F.size("bullets")
    o = f.outline().withColumn("outline_id", F.concat_ws("-", "outline_id", F.floor(F.col("idx") / F.lit(7)).cast("string")))
    s = o.select(
        "outline_id", "idx", a, F.when((k % 4 == 0) | (a == "quote"), 0).otherwise(n % 5).alias("n_bullets"), F.when((a == "kpi") | (k % 9 == 0), 2).otherwise(0).alias("n_kpis"), F.when((a == "process") | ((k % 4 == 0) & (a == "cards")), 3).otherwise(0).alias("n_steps"),
        F.lit(0).alias("n_paragraphs"), (a == "quote").alias("has_quote"), a.isin("chart", "table").alias("has_data"), (a.isin("image_text") & (k % 2 == 0)).alias("has_picture"),
    )
    return outline.size_repairs(s, 6, 6, 5, 3)


def _with_data(f: Fixtures):
    k = F.col("doc_id")
    return f.outline().withColumns({"has_data": F.col("archetype").isin("chart", "table", "kpi", "process"), "wants_image": k % 6 == 0})


def _diagrams(f: Fixtures):
    return f.spark.createDataFrame([("executive", True), ("detailed", False), ("visual", True)], "name string, diagrams boolean")


def _hosts(f: Fixtures):
    return f.table("pages").select(F.regexp_extract("url", r"[a-z0-9]+\.example\.(?:com|org|net)", 0).alias("name"))


def _split_text(f: Fixtures):
    label, body = outline.label_and_body(F.col("text"))
    number, unit = outline.number_and_unit(F.col("text"))
    md = lambda c: F.md5(c.cast("binary"))
    return f.paras().select("doc_id", "para_no", md(outline.shorten(F.col("text"), 60)).alias("short"), md(outline.shorten_words(F.col("text"), 8)).alias("words"), label.alias("label"), md(body).alias("body"), number.alias("number"), md(unit).alias("unit"))


def _titles(f: Fixtures):
    return f.paras().select("doc_id", "para_no", outline.shorten(F.col("text"), 24).alias("short"), outline.shorten_title(F.col("text"), 40).alias("title"))


RUN = {
    "p01_normalize": lambda f: outline.normalize(f.payloads(), ARCHETYPES).select("event_id", "title", "archetype", F.array_join("bullets", "|").alias("bullets"), F.array_join("kpis", "|").alias("kpis"), F.array_join("repairs", ",").alias("repairs")),
    "p01_add_frames": lambda f: outline.add_frames(f.outline()).select("outline_id", "idx", "archetype", "repair"),
    "p02_normalize_data": lambda f: outline.normalize_data(f.payloads().drop("k")),
    "p03_unknown_references": lambda f: outline.unknown_references(f.table("documents"), _hosts(f), r"[a-z0-9]+\.example\.(?:com|org|net)"),
    "p04_sanitize": lambda f: outline.sanitize(_points(f)),
    "p05_drop_bare": lambda f: outline.drop_bare(f.outline()).select("outline_id", "idx"),
    "p06_chart_to_table": lambda f: outline.chart_to_table(f.charts(), YEARS),
    "p07_chart_to_kpis": lambda f: outline.chart_to_kpis(f.charts()),
    "p08_table_to_chart": lambda f: outline.table_to_chart(_cells(f)),
    "p09_table_to_bullets": lambda f: outline.table_to_bullets(_cells(f)),
    "p09_kpis_to_table": lambda f: outline.kpis_to_table(outline.chart_to_kpis(f.charts())),
    "p09_kpis_to_cards": lambda f: outline.kpis_to_cards(outline.chart_to_kpis(f.charts())),
    "p10_choose_form": _choice,
    "p11_split_mixed": lambda f: outline.split_mixed(_kpis(f).withColumn("has_data", F.col("idx") % 3 == 0)),
    "p12_split_dense": lambda f: outline.split_dense(_with_data(f)),
    "p13_split_kpis": lambda f: outline.split_kpis(_kpis(f), 5),
    "p14_to_process": lambda f: outline.to_process(_with_data(f), _diagrams(f), f.slots().select("archetype")).select("outline_id", "idx", "name", "process"),
    "p15_section_dividers": lambda f: outline.section_dividers(f.slides().select("deck_id", F.col("slide_idx").alias("idx"), "layout"), "layout"),
    "p15_without_dividers": lambda f: outline.without_dividers(f.slides().select("deck_id", F.col("slide_idx").alias("idx"), "archetype")),
    "p16_size_report": lambda f: outline.size_report(f.outline().withColumn("outline_id", F.concat_ws("-", "outline_id", F.floor(F.col("idx") / F.lit(11)).cast("string"))), 8, 10),
    "p17_image_candidates": lambda f: outline.image_candidates(_with_data(f)),
    "p16_size_repairs": _sized,
    "p18_grounding": _grounding,
    "p18_grounded_outline": _grounded,
    "p18_warnings": lambda f: _told(f)[1],
    "p19_bloat": lambda f: outline.bloat(f.table("lineitem"), "l_orderkey"),
    "t05_shorten": _split_text,
    "t05_titles": _titles,
    "t08_parse_number": lambda f: _cells(f).select("table_id", "row", "col", text.parse_number(F.col("cell")).alias("number")),
    "t10_fit_scale": lambda f: f.shapes().where("tag = 'sp'").select("slide_id", "z", outline.fit_scale(F.col("chars"), F.col("w"), F.col("h"), F.col("size_pt")).alias("scale")),
}

CELLS = """cells as (select p_partkey % 50 as table_id, p_partkey as row_, unnest(['name', 'size', 'delta size', 'share']) as col, unnest([p_name, '×' || p_size, p_size::varchar, '−' || p_size || ' %']) as cell from part)"""
NUM = "case when col in ('size', 'delta size', 'share') then try_cast(replace(regexp_replace(cell, '[×% ]', '', 'g'), '−', '-') as double) end"
_ENDS = " ,;:—–("


def _tail(t: str, n: int) -> str:
    """The first place of the first separator whose head fits, by looking at every place."""
    each = [f"list_filter([rtrim(left({t}, i), '{_ENDS}') for i in range(1, least(length({t}), {n} + 20)) if substr({t}, i + 1, {len(sep)}) = '{sep}'], lambda h: length(h) <= {n} and length(h) >= {n} * 0.3::double)[1]" for sep in (" — ", " – ", ": ", "; ", ", ", " (")]
    return f"coalesce({', '.join(each)})"


def _words(t: str, n: int) -> str:
    dangling = "|".join("с со и в во на для по к ко о об от до из у а но или за при без над под через что как не a an the of for and or to in on with by at from".split())
    cut = f"case when contains(left({t}, {n}), ' ') then regexp_replace(left({t}, {n}), ' [^ ]*$', '') else string_split({t}, ' ')[1] end"
    return f"case when len(string_split({t}, ' ')) <= 2 then {t} else rtrim(regexp_replace({cut}, '(?i)( ({dangling})[,;:]*)+$', ''), '{_ENDS}') || '…' end"


def _short(t: str, n: int, title: bool = False) -> str:
    lead = ", ".join(f"case when strpos({t}, '{sep}') > 1 and length(rtrim(string_split({t}, '{sep}')[1], '{_ENDS}')) between 5 and {n} then rtrim(string_split({t}, '{sep}')[1], '{_ENDS}') end" for sep in (" — ", " – ", ": "))
    breaks = "'" + "','".join("и с со для на в во как при без через или за от до из and with for in on via as without through or".split()) + "'"
    phrase = f"list_filter([rtrim(array_to_string(ws[1:i], ' '), '{_ENDS}') for i in list_reverse(range(2, least(len(ws), {n}))) if lower(ws[i + 1]) in ({breaks})], lambda h: length(h) <= {n} and length(h) >= {n} * 0.3::double)[1]"
    more = f"{lead}, {phrase}, " if title else ""
    return f"case when length({t}) <= {n} then {t} else coalesce({_tail(t, n)}, {more}{_words(t, n)}) end"


GROUNDED = """with g as (select distinct lang, unnest(regexp_extract_all(text, '[0-9]+')) as number from documents where doc_id % 2 = 0),
 d as (select doc_id, lang as dl, coalesce(regexp_extract_all(text, '[0-9]+')[1], (doc_id % 90)::varchar) as number from documents),
 x as (select o.*, o.archetype as a, section as lang, number, case when o.doc_id % 3 = 0 then [] else bullets end as b0, archetype = 'kpi' or o.doc_id % 5 = 0 as k0, archetype = 'chart' or o.doc_id % 7 = 0 as c0, archetype = 'table' or o.doc_id % 11 = 0 as t0 from fx_outline o join d on d.doc_id = o.doc_id),
 y0 as (select *, (lang, number) not in (select (lang, number) from g) as new1, (lang, (doc_id % 40)::varchar) not in (select (lang, number) from g) as new2 from x),
 y as (select *, k0 and new1 as ik, c0 and (new1 or new2) as ic, t0 and new1 as it from y0),
 z0 as (select *, case when ik and len(b0) = 0 then list_filter([left(title, 20)], lambda v: v <> '') else b0 end as b1 from y),
 z as (select *, case when ic and len(b1) = 0 then ['s: a — ' || number || ', b — ' || doc_id % 40] else b1 end as bs, k0 and not ik as hk, c0 and not ic as hc, t0 and not it as ht from z0)"""

SQL = {
    "p01_normalize": f"""with a as (select event_id, raw, k, raw->>'$.title' as t, coalesce(raw->>'$.archetype', 'bullets') as ar,
   case when k % 8 = 5 then ['a long winded value w'] when k % 8 = 3 then ['one ' || k] when k % 8 = 0 then ['a' || k, 'b'] when k % 8 = 1 then ['i' || k] when k % 8 = 2 then ['p', 'q', 'r' || k] else []::varchar[] end as bl, k % 8 as m from fx_payloads)
select event_id, coalesce(t, '') as title, case when list_contains({NAMES}, ar) then ar else 'bullets' end as archetype, array_to_string(bl, '|') as bullets,
 array_to_string(list_filter([case when m in (0, 1, 2) then 'alias' end, case when m = 3 then 'scalar' end, case when not list_contains({NAMES}, ar) then 'archetype' end, case when t is null then 'no_title' end, case when m = 5 then 'wordy_kpi' end, case when m = 5 then 'cut_kpis' end], lambda x: x is not null), ',') as repairs,
 case when m = 5 then k || ' l|2 m|3 n|4 o' else '' end as kpis from a""",
    "p01_add_frames": """with g as (select outline_id, arg_min(archetype, idx) as head, arg_max(archetype, idx) as tail, min(idx) as lo, max(idx) as hi from fx_outline group by 1),
 u as (select outline_id, idx, archetype, '' as repair from fx_outline union all select outline_id, lo - 1, 'title', 'added_title' from g where head <> 'title' union all select outline_id, hi + 1, 'closing', 'added_closing' from g where tail <> 'closing')
select outline_id, row_number() over (partition by outline_id order by idx) - 1 as idx, archetype, repair from u""",
    "p02_normalize_data": """select event_id, case k % 8 when 6 then 'chart' else 'table' end as what, case k % 8 when 6 then 1 end as n_series, case k % 8 when 6 then 2 end as n_points, case k % 8 when 7 then 1 end as n_rows, case when k % 8 = 6 then case when k % 16 < 8 then 1 + k else 1250 - k end::double end as total from fx_payloads where k % 8 in (6, 7)""",
    "p03_unknown_references": r"""with s as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[a-z0-9]+\.example\.(?:com|org|net)'))) as name from documents)
select doc_id, name from s where name not in (select regexp_extract(url, '[a-z0-9]+\.example\.(?:com|org|net)') from pages)""",
    "p04_sanitize": """with p as (select deck_id, series, year - 1992 as at_, case when value % 19 <> 0 then value end as value from fx_charts), k as (select deck_id, series, count(*) as n from p group by all having count(*) = count(value)), l as (select deck_id, min(n) as least from k group by 1)
select p.deck_id, p.series, at_ as "at", value from p join k on p.deck_id = k.deck_id and p.series = k.series join l on l.deck_id = p.deck_id where at_ < least""",
    "p05_drop_bare": """with b as (select outline_id, idx, archetype not in ('title', 'section', 'closing') and len(bullets) = 0 as bare from fx_outline), n as (select *, count(*) filter (not bare) over (partition by outline_id) as left_ from b)
select outline_id, idx from n where not bare or left_ = 0""",
    "p06_chart_to_table": "select deck_id, series, " + ", ".join(f"max(value) filter (year = {y}) as y{y}" for y in YEARS) + " from fx_charts group by 1, 2",
    "p07_chart_to_kpis": """with l as (select deck_id, series, arg_max(value, year) as value, row_number() over (partition by deck_id order by series) as k from fx_charts group by deck_id, series)
select * from l where k <= 4""",
    "p08_table_to_chart": f"""with {CELLS}
select table_id, col, count(*) as n, round_even(sum({NUM}), 4) as total from cells where col in ('size', 'share') group by 1, 2""",
    "p09_table_to_bullets": f"""with {CELLS}
select table_id, row_ as "row", string_agg(cell, ': ' order by col) as bullet from cells group by 1, 2""",
    "p09_kpis_to_table": """with l as (select deck_id, series, arg_max(value, year) as value, row_number() over (partition by deck_id order by series) as k from fx_charts group by deck_id, series)
select distinct deck_id, 0::bigint as "row", 'name | value' as cells from l union all select deck_id, k, series || ' | ' || replace(format('{:,}', value), ',', ' ') from l where k <= 4""",
    "p09_kpis_to_cards": """with l as (select deck_id, series, arg_max(value, year) as value, row_number() over (partition by deck_id order by series) as k from fx_charts group by deck_id, series)
select deck_id, k, replace(format('{:,}', value), ',', ' ') || ' — ' || series as card from l where k <= 4""",
    "p10_choose_form": """with s as (select deck_id, count(distinct series) as n_series, count(distinct year) as n_points from fx_charts group by 1)
select s.*, name, case when name = 'detailed' then 'table' when name = 'executive' and n_series <= 4 then 'kpi' else 'chart' end as form from s, (values ('executive'), ('detailed'), ('visual')) v(name)""",
    "p11_split_mixed": """with s as (select deck_id, slide_idx as idx, slide_id % 12 > 0 and slide_idx % 3 = 0 as two from fx_slides), e as (select deck_id, idx, 0 as part, case when two then 'data' else 'all' end as what from s union all select deck_id, idx, 1, 'kpis' from s where two)
select *, row_number() over (partition by deck_id order by idx, part) - 1 as new_idx from e""",
    "p12_split_dense": """with o as (select outline_id, idx, title, archetype in ('chart', 'table', 'kpi', 'process') as data, len(bullets) as n, case when archetype = 'agenda' then 1 else greatest(1, ceil(len(bullets) / 6.0))::bigint end as of_ from fx_outline), p as (select *, ceil(n * 1.0 / of_)::bigint as size, unnest(range(1, of_ + 1)) as part from o)
select outline_id, idx, part, case when of_ > 1 then title || ' (' || part || '/' || of_ || ')' else title end as title, greatest(0, least(size, n - (part - 1) * size)) as n, data and part = 1 as keeps_data from p""",
    "p13_split_kpis": """with w as (select deck_id, slide_idx as idx, slide_id % 12 as n_kpis, greatest(0, ceil((slide_id % 12) / 4.0)::bigint - 1) as want from fx_slides), b as (select *, coalesce(sum(want) over (partition by deck_id order by idx rows between unbounded preceding and 1 preceding), 0) as before_ from w)
select deck_id, idx, n_kpis, greatest(0, least(want, 5 - before_))::bigint as extra from b""",
    "p14_to_process": """select outline_id, idx, name, name <> 'detailed' and exists (select 1 from fx_slots where archetype = 'process') and archetype not in ('chart', 'table', 'kpi', 'process') and len(bullets) between 2 and 6 and coalesce(list_max(list_transform(bullets, lambda b: length(b))), 0) <= 200 as process
 from fx_outline, (values ('executive'), ('detailed'), ('visual')) v(name)""",
    "p15_section_dividers": """with s as (select deck_id, slide_idx as idx, layout as section, coalesce(layout <> lag(layout) over (partition by deck_id order by slide_idx), true) as new_ from fx_slides), e as (select deck_id, idx, section, 'slide' as kind, 1 as part from s union all select deck_id, idx, section, 'section', 0 from s where new_)
select deck_id, idx, section, kind, row_number() over (partition by deck_id order by idx, part) - 1 as new_idx from e""",
    "p15_without_dividers": lambda f: outline.without_dividers(f.slides().select("deck_id", F.col("slide_idx").alias("idx"), "archetype")),
    "p15_without_dividers": "select deck_id, slide_idx as idx, archetype, row_number() over (partition by deck_id order by slide_idx) - 1 as new_idx from fx_slides where archetype <> 'section'",
    "p16_size_report": """with o as (select outline_id || '-' || (idx // 11) as outline_id, idx, len(bullets) as n from fx_outline), p as (select *, n + lead(n) over (partition by outline_id order by idx) as pair, count(*) over (partition by outline_id) as slides from o)
select outline_id, max(slides) as slides, case when max(slides) < 8 then 'split' else 'merge' end as what, case when max(slides) < 8 then arg_max(idx, (n, -idx)) else arg_min(idx, (pair, idx)) filter (pair is not null) end as idx from p group by 1 having max(slides) < 8 or max(slides) > 10""",
    "p17_image_candidates": """with r as (select outline_id, idx, case when archetype in ('image_text', 'image_full') then 0 when doc_id % 6 = 0 then 1 when archetype in ('bullets', 'cards', 'two_column') then 2 when archetype in ('title', 'closing') then 3 end as rank from fx_outline where archetype not in ('chart', 'table', 'kpi', 'process')), k as (select outline_id, row_number() over (partition by outline_id order by rank, idx) as k, idx, rank from r where rank is not null)
select * from k where k <= 4""",
    "p18_grounding": """with d as (select lang, doc_id as item_id, unnest(list_distinct(regexp_extract_all(text, '[0-9]+'))) as number from documents)
select lang, item_id, count(*) as missing from d a where item_id % 2 = 1 and not exists (select 1 from d b where b.item_id % 2 = 0 and a.lang = b.lang and a.number = b.number) group by 1, 2""",
    "p16_size_repairs": """with s as (select outline_id || '-' || (idx // 7) as o, idx, archetype as a, case when doc_id % 4 = 0 or archetype = 'quote' then 0 else len(bullets) % 5 end as b, case when archetype = 'kpi' or doc_id % 9 = 0 then 2 else 0 end as k,
   case when archetype = 'process' or (doc_id % 4 = 0 and archetype = 'cards') then 3 else 0 end as st, archetype = 'quote' as q, archetype in ('chart', 'table') as data, archetype = 'image_text' and doc_id % 2 = 0 as pic from fx_outline),
 t as (select *, (b > 0)::int + (st > 0)::int + (k > 0)::int + q::int as kinds, case when b > 0 then b when st > 0 then st when k > 0 then k when q then 1 else 0 end as items, a in ('bullets', 'two_column', 'cards', 'process', 'kpi', 'quote') as m, row_number() over (partition by o order by idx) as at_, count(*) over (partition by o) as n from s),
 u as (select *, not data and case when a = 'image_text' then not pic else m end and kinds = 1 as able from t where n <> 6),
 v as (select x.*, coalesce(x.able and y.able and x.items + y.items <= 5, false) as fit, x.a in ('kpi', 'quote') or coalesce(y.a in ('kpi', 'quote'), false) as late, coalesce((select min(z.at_) from u z where z.o = x.o and z.a = 'section' and z.at_ > x.at_), x.n + 1) - x.at_ as len_ from u x left join u y on y.o = x.o and y.at_ = x.at_ + 1),
 r as (select o, n, 'drop_section' as what, arg_min(idx, (len_, -at_)) as idx from v where n > 6 and a = 'section' group by all union all select o, n, 'merge', min(idx) from v where n > 6 and fit and not late group by all union all select o, n, 'merge_lossy', min(idx) from v where n > 6 and fit and late group by all
   union all select o, n, 'extract_kpis', min(idx) from v where n < 6 and k > 0 and (b > 0 or data) and a <> 'kpi' group by all union all select o, n, 'split', arg_max(idx, (b, at_)) from v where n < 6 and m and b >= 3 and k = 0 and st = 0 and not data and not pic and not q group by all)
select o as outline_id, n as slides, what, idx from r union all select distinct o, n, 'none', null::bigint from v where o not in (select o from r)""",
    "p18_grounded_outline": GROUNDED + """
select doc_id, case when a in ('kpi', 'chart', 'table') and not hk and not hc and not ht then 'bullets' else a end as archetype, len(bs) as n_bullets, md5(array_to_string(bs, '|')) as digest, hk as has_kpis, hc as has_chart, ht as has_table from z""",
    "p18_warnings": GROUNDED + """
select lang as "group", outline_id, idx, part from (select *, unnest(['kpi', 'chart', 'table']) as part, unnest([ik, ic, it]) as bad from y) where bad""",
    "p19_bloat": """with n as (select l_orderkey, count(*) as n from lineitem group by 1)
select n, count(*) as keys, n > 2 * (select avg(n) from n) as "over" from n group by n""",
    "t05_shorten": r"""with s as (select doc_id, para_no, text, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') as t, regexp_extract(text, '^([^:–—]{1,60})(?::\s| – | — )(.*)$', 1) as lb, regexp_extract(text, '^([^:–—]{1,60})(?::\s| – | — )(.*)$', 2) as bd from fx_paras), w as (select *, string_split(t, ' ') as ws from s)
select doc_id, para_no, md5(SHORT60) as short, md5(case when len(ws) <= 11 then t else array_to_string(ws[1:8], ' ') || '…' end) as words, trim(lb, ' ') as label, md5(case when lb = '' then text else bd end) as body,
 regexp_extract(text, '^\s*([-−+×x]?[0-9]+(?:[.,][0-9]+)?)\s*(.*)$', 1) as number, md5(regexp_extract(text, '^\s*([-−+×x]?[0-9]+(?:[.,][0-9]+)?)\s*(.*)$', 2)) as unit from w""".replace("SHORT60", _short("t", 60)),
    "t05_titles": f"""with s as (select doc_id, para_no, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') as t from fx_paras), w as (select *, string_split(t, ' ') as ws from s)
select doc_id, para_no, {_short("t", 24)} as short, {_short("t", 40, True)} as title from w""",
    "t08_parse_number": f"""with {CELLS}
select table_id, row_ as "row", col, {NUM} as number from cells""",
    "t10_fit_scale": """with s as (select slide_id, z, unnest([1.0, 0.9, 0.8, 0.7, 0.6, 0.55]::double[]) as s, chars, w, h, size_pt from fx_shapes where tag = 'sp'), f as (select *, 0.9::double * floor(w / 12700.0::double / (0.5::double * size_pt * s)) * floor(h / 12700.0::double / (1.2::double * size_pt * s)) >= chars as ok from s)
select slide_id, z, coalesce(max(s) filter (ok), 0.55::double) as scale from f group by 1, 2""",
}

QUERIES = {name: (lambda spark, sf_dir, run=run: run(Fixtures(spark, sf_dir))) for name, run in RUN.items()}
SQL = {name: with_views(sql) for name, sql in SQL.items()}
