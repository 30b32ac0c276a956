"""Queries of template mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mining
from ..sources.fixtures import Fixtures
from .views import VIEWS, with_views


def _layered(f: Fixtures):
    return f.shapes().withColumn("layer", F.when(F.col("slide_id") % 10 == 0, "layout").otherwise("slide"))


def _usage(f: Fixtures):
    return mining.color_usage(_layered(f))


def _clusters(f: Fixtures):
    u = _usage(f)
    return mining.cluster_usage(u, mining.color_clusters(u))


def _tokens(f: Fixtures):
    usage = _layered(f).groupBy("template_id", "hex", F.when(F.col("layer") == "layout", "layouts").otherwise("slides").alias("source")).agg(F.count("*").cast("double").alias("weight"))
    theme = f.table("nation").select(F.col("n_nationkey").alias("template_id"), F.lit("0077FF").alias("accent"))
    roles = mining.color_roles(_usage(f))
    return mining.color_tokens(roles.withColumn("role", F.when(F.col("template_id") % 5 == 0, F.regexp_replace("role", "accent", "unknown")).otherwise(F.col("role"))), usage=usage, theme=theme)


RUN = {
    "m01_color_usage": _usage,
    "m02_color_clusters": lambda f: mining.color_clusters(_usage(f)),
    "m03_color_roles": lambda f: mining.color_roles(_usage(f)),
    "m03_color_roles_of_clusters": lambda f: mining.color_roles(_clusters(f)),
    "m04_color_tokens": _tokens,
    "m05_font_ranks": lambda f: mining.font_ranks(f.runs()),
    "m06_size_bins": lambda f: mining.size_bins(f.runs()),
    "m07_type_roles": lambda f: mining.type_roles(f.runs()),
    "m08_repeated": lambda f: mining.repeated_signatures(f.shapes()),
    "m09_fixed": lambda f: mining.fixed_elements(f.shapes()),
    "m10_grid": lambda f: mining.grid(f.shapes()),
    "m10_guides": lambda f: f.guides(),
    "m11_profile": lambda f: mining.profile(f.shapes()),
    "m12_samples": lambda f: mining.sample_texts(f.paras().select((F.col("doc_id") % 500).alias("grp"), (F.col("doc_id") * 10000 + F.col("para_no")).alias("place"), F.when(F.col("para_no") % 5 == 1, "Text").otherwise(F.col("text")).alias("text"))),
}

VIEWS["fx_usage"] = """select *, round_even(fills + text_chars / 20, 4) as weight from (select template_id, hex, r, g, b, sum(case when tag <> 'sp' then q else 0 end)::double as fills, round_even(sum(case when tag <> 'sp' then q * a else 0 end), 4) as fill_area,
  round_even(sum(case when tag <> 'sp' and a >= 0.6 then q * a else 0 end), 4) as cover_area, sum(case when tag = 'sp' then q * chars else 0 end)::double as text_chars
  from (select *, case when slide_id % 10 = 0 then 0.25 else 1.0 end::double as q, (w * h)::double / (12192000::bigint * 6858000) as a from fx_shapes) group by template_id, hex, r, g, b)"""
ROLE = """LAB(fx_usage), c0 as (select *, round_even(sqrt(la * la + lbb * lbb), 4) as chroma, case when max(cover_area) over (partition by template_id) > 0 then cover_area else fill_area end as bg from lab_fx_usage),
 b as (select template_id, arg_max(hex, (bg, -('0x' || hex)::int)) as hex, 'background' as role from c0 group by 1), bl as (select template_id, lum as back from c0 semi join b using (template_id, hex)),
 t as (select template_id, arg_max(hex, (text_chars, -('0x' || hex)::int)) as hex, 'text' as role from (select * from c0 anti join b using (template_id, hex)) join bl using (template_id)
   where round_even((greatest(lum, back) + 0.05) / (least(lum, back) + 0.05), 4) >= 3 and text_chars > 0 group by 1), bt as (select * from b union all select * from t),
 ch as (select *, row_number() over (partition by template_id order by weight desc, hex) as k, max(weight) over (partition by template_id) as mw from (select * from c0 anti join bt using (template_id, hex)) where chroma >= 20),
 ac as (select template_id, hex, case k when 1 then 'accent' else 'secondary' end as role from ch where k = 1 or (k = 2 and weight >= 0.15 * mw)), r3 as (select * from bt union all select * from ac),
 su as (select template_id, hex, 'surface' as role from (select * from c0 anti join r3 using (template_id, hex)) where chroma < 20 and fill_area >= 0.5), r4 as (select * from r3 union all select * from su),
 mu as (select template_id, arg_max(hex, (text_chars + fills, -('0x' || hex)::int)) as hex, 'muted' as role from (select * from c0 anti join r4 using (template_id, hex)) where chroma < 20 group by 1), r5 as (select * from r4 union all select * from mu),
 roles as (select template_id, hex, coalesce(role, 'unknown') as role, weight from c0 left join r5 using (template_id, hex))"""
SIG = "select template_id, tag, text, round_even(x / 45720.0, 0)::bigint as bx, round_even(y / 45720.0, 0)::bigint as \"by\", round_even(w / 45720.0, 0)::bigint as bw, round_even(h / 45720.0, 0)::bigint as bh, count(distinct slide_id) as slides from fx_shapes where placeholder is null and (tag <> 'sp' or y < 0.12::double * 6858000 or y + h > 0.88::double * 6858000) group by 1, 2, 3, 4, 5, 6, 7 having count(distinct slide_id) >= greatest(3, 0.25 * (select count(distinct slide_id) from fx_plain q where q.template_id = fx_shapes.template_id))"

SQL = {
    "m01_color_usage": "select * from fx_usage",
    "m02_color_clusters": """with recursive LAB(fx_usage), o as (select *, row_number() over (partition by template_id order by weight desc, hex) as k from lab_fx_usage),
 walk as (select 0::bigint as k, template_id, [{'h': '', 'c': '', 'l': 0.0::double, 'a': 0.0::double, 'b': 0.0::double}] as acc from (select distinct template_id from fx_usage)
  union all select o.k, template_id, list_append(acc, {'h': hex, 'c': coalesce(list_filter(acc, lambda m: m.h = m.c and m.h <> '' and round_even(sqrt(pow(m.l - ll, 2) + pow(m.a - la, 2) + pow(m.b - lbb, 2)), 4) < 8)[1].c, hex), 'l': ll, 'a': la, 'b': lbb})
   from walk join o using (template_id) where o.k = walk.k + 1),
 last as (select template_id, unnest(arg_max(acc, k)) as m from walk group by 1)
select template_id, m.h as hex, m.c as cluster from last where m.h <> ''""",
    "m03_color_roles": f"with {ROLE}\nselect * from roles",
    "m04_color_tokens": f"""with {ROLE}, u0 as (select template_id, hex, case when template_id % 5 = 0 and role = 'accent' then 'unknown' else role end as role, round_even(weight, 0)::bigint as usage, weight, max(weight) over (partition by template_id) as top from roles),
 so as (select template_id, hex, source, row_number() over (partition by template_id, hex order by count(*) desc, source) as k from (select template_id, hex, case when slide_id % 10 = 0 then 'layouts' else 'slides' end as source from fx_shapes) group by template_id, hex, source),
 u1 as (select template_id, hex, role, usage, coalesce(source, 'slides') as source from u0 left join (select * from so where k = 1) using (template_id, hex) where role <> 'unknown' or weight >= 0.01 * top),
 u as (select * from u1 union all select n_nationkey, '0077FF', 'accent', 0, 'theme' from nation where n_nationkey not in (select template_id from u1 where role = 'accent')),
 n as (select template_id, row_number() over (partition by template_id order by list_position(['background', 'text', 'accent', 'secondary', 'surface', 'muted', 'unknown'], role), usage desc, hex) as n, hex, role, usage, source from u)
select * from n where n <= 16""",
    "m05_font_ranks": """with c as (select template_id, font, sum(chars)::bigint as chars from fx_runs where lower(font) not in ('wingdings', 'webdings', 'symbol', 'mt extra') group by all), n as (select *, row_number() over (partition by template_id order by chars desc, font) as n, max(chars) over (partition by template_id) as top from c)
select template_id, font, chars, n from n where chars >= 0.01 * top""",
    "m06_size_bins": """with recursive s as (select template_id, round_even(size_pt * 2, 0) / 2 as pt, sum(chars)::bigint as chars from fx_runs group by 1, 2), o as (select *, row_number() over (partition by template_id order by pt) as k from s),
 walk as (select template_id, k, 0::bigint as bin, pt as low, pt as high, chars, pt * chars as mass from o where k = 1
  union all select w.template_id, o.k, case when o.pt < 1.08::double * (w.mass / w.chars) then w.bin else w.bin + 1 end, case when o.pt < 1.08::double * (w.mass / w.chars) then w.low else o.pt end, o.pt,
   case when o.pt < 1.08::double * (w.mass / w.chars) then w.chars + o.chars else o.chars end, case when o.pt < 1.08::double * (w.mass / w.chars) then w.mass + o.pt * o.chars else o.pt * o.chars end from walk w join o on o.template_id = w.template_id and o.k = w.k + 1)
select template_id, bin, arg_max(low, k) as low, arg_max(high, k) as high, arg_max(chars, k) as chars, round_even(arg_max(mass, k) / arg_max(chars, k), 4) as size from walk group by 1, 2""",
    "m07_type_roles": """with c as (select template_id, size_pt, font, bold, sum(chars)::bigint as chars from fx_runs group by all),
 bd as (select template_id, arg_max(size_pt, (chars, -size_pt)) as body from (select template_id, size_pt, sum(chars) as chars from c where size_pt between 9 and 24 group by all) group by 1),
 r as (select *, case when size_pt / body >= 2.4 then 'display' when size_pt / body >= 1.6 then 'h1' when size_pt / body >= 1.25 then 'h2' when size_pt / body >= 1.08 then 'h3' when size_pt / body >= 0.92 then 'body' when size_pt / body >= 0.7 then 'caption' else 'small' end as role from c join bd using (template_id)),
 ms as (select template_id, role, arg_max(size_pt, (n, -size_pt)) as size_pt from (select template_id, role, size_pt, sum(chars) as n from r group by all) group by 1, 2),
 mf as (select template_id, role, font, row_number() over (partition by template_id, role order by sum(chars) desc, font) as k from r group by template_id, role, font), mb as (select template_id, role, bold, row_number() over (partition by template_id, role order by sum(chars) desc, bold) as k from r group by template_id, role, bold)
select template_id, role, sum(chars)::bigint as usage, any_value(ms.size_pt) as size_pt, any_value(mf.font) as font, any_value(mb.bold) as bold from r join ms using (template_id, role) join (select * from mf where k = 1) mf using (template_id, role) join (select * from mb where k = 1) mb using (template_id, role) group by template_id, role""",
    "m08_repeated": SIG,
    "m09_fixed": f"""with s as ({SIG})
select *, case when tag = 'pic' and bw * 45720 * (bh * 45720) < 0.1 * (12192000::bigint * 6858000) then 'logo' when tag = 'sp' and "by" * 45720 >= 0.88::double * 6858000 then 'footer' when tag <> 'sp' then 'decoration' else 'unknown' end as kind from s""",
    "m10_grid": """with e as (select template_id, unnest(['left', 'top', 'right', 'bottom']) as side, unnest([x, y, x + w, y + h]) as v from fx_shapes), l as (select template_id, side, list_sort(list(v)) as vs from e group by 1, 2)
select template_id, side, vs[round_even(case when side in ('left', 'top') then 0.05::double else 0.95::double end * (len(vs) - 1), 0)::bigint + 1] as margin from l""",
    "m10_guides": "select * from fx_guides",
    "m11_profile": """with c as (select template_id, 'font' as by_, font as key, count(*) as n from fx_runs group by all union all select template_id, 'size', size_pt::bigint::varchar, count(*) from fx_runs group by all
  union all select template_id, 'color', hex, count(*) from fx_runs group by all union all select template_id, 'font_size', font || '|' || size_pt::bigint, count(*) from fx_runs group by all
  union all select template_id, 'box', round_even(x / 45720.0, 0)::bigint || ',' || round_even(y / 45720.0, 0)::bigint || ',' || round_even(w / 45720.0, 0)::bigint || ',' || round_even(h / 45720.0, 0)::bigint as key, count(distinct slide_id) from fx_shapes group by 1, 3 having count(distinct slide_id) > 1
  union all select template_id, 'kind', kind, count(*) from fx_shapes group by 1, 3 union all select template_id, 'parts', 'slides', count(distinct slide_id) from fx_shapes group by 1 union all select template_id, 'parts', 'shapes', count(*) from fx_shapes group by 1), k as (select template_id, by_ as "by", key, n, row_number() over (partition by template_id, by_ order by n desc, key) as k from c)
select * from k where k <= case when "by" = 'color' then 25 else 10 end""",
    "m12_samples": r"""with t as (select doc_id % 500 as grp, doc_id * 10000 + para_no as place, case when para_no % 5 = 1 then 'Text' else text end as text from fx_paras), s as (select grp, left(trim(text, ' '), 120) as sample, min(place) as place from t where text <> 'Text' group by 1, 2 having len(regexp_extract_all(sample, '\p{L}')) >= 2),
 k as (select *, row_number() over (partition by grp order by place, sample) as k, count(*) over (partition by grp) as total from s), u as (select *, sum(length(sample)) over (partition by grp order by k) as used from k where k <= 6)
select grp, string_agg(sample, ' / ' order by k) as samples, max(total) - count(*) as more from u where used <= 6000 group by 1""",
}

CLUSTERS = SQL["m02_color_clusters"].rsplit("\nselect", 1)[0]
SQL["m03_color_roles_of_clusters"] = (
    CLUSTERS
    + """, mm as (select template_id, m.h as hex, m.c as cluster from last where m.h <> ''),
 cs as (select template_id, cluster as hex, round_even(sum(fills), 4) as fills, round_even(sum(fill_area), 4) as fill_area, round_even(sum(cover_area), 4) as cover_area, round_even(sum(text_chars), 4) as text_chars, round_even(sum(weight), 4) as weight from fx_usage join mm using (template_id, hex) group by 1, 2),
 cu as (select cs.*, r, g, b from cs join (select template_id, hex, r, g, b from fx_usage) using (template_id, hex)), """
    + ROLE.replace("fx_usage", "cu")
    + "\nselect * from roles"
)
QUERIES = {name: (lambda spark, sf_dir, run=run: run(Fixtures(spark, sf_dir))) for name, run in RUN.items()}
SQL = {name: with_views(sql) for name, sql in SQL.items()}
