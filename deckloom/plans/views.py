"""The same views as DuckDB SQL, written independently of the DataFrame code."""

from __future__ import annotations

import re

NAMES = "['title','section','agenda','bullets','two_column','cards','kpi','chart','table','image_text','image_full','quote','process','team','closing','freeform']"
KINDS = "['title','subtitle','body','caption','number','label','picture','chart','table','icon','date','footer','slide_number','other']"
LAB = """
  lin_{p} as (select *, case when r/255.0 <= 0.04045 then r/255.0/12.92 else pow((r/255.0+0.055)/1.055, 2.4) end as lr,
     case when g/255.0 <= 0.04045 then g/255.0/12.92 else pow((g/255.0+0.055)/1.055, 2.4) end as lg,
     case when b/255.0 <= 0.04045 then b/255.0/12.92 else pow((b/255.0+0.055)/1.055, 2.4) end as lb from {p}),
  xyz_{p} as (select *, (lr*0.4124+lg*0.3576+lb*0.1805)/0.95047 as vx, lr*0.2126+lg*0.7152+lb*0.0722 as vy, (lr*0.0193+lg*0.1192+lb*0.9505)/1.08883 as vz from lin_{p}),
  f_{p} as (select *, case when vx > 0.008856 then pow(vx, 1.0::double/3) else 7.787*vx + 16.0/116 end as fx, case when vy > 0.008856 then pow(vy, 1.0::double/3) else 7.787*vy + 16.0/116 end as fy,
     case when vz > 0.008856 then pow(vz, 1.0::double/3) else 7.787*vz + 16.0/116 end as fz, 0.2126*lr + 0.7152*lg + 0.0722*lb as lum from xyz_{p}),
  lab_{p} as (select * exclude (lr, lg, lb, vx, vy, vz, fx, fy, fz), 116*fy-16 as ll, 500*(fx-fy) as la, 200*(fy-fz) as lbb from f_{p})"""

VIEWS = {
    "fx_slides": f"""select o_custkey as deck_id, o_orderkey as slide_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as slide_idx,
        o_orderpriority as layout, {NAMES}[o_orderkey % 16 + 1] as archetype from orders""",
    "fx_plain": """select c.c_nationkey as template_id, s.deck_id, s.slide_id, s.slide_idx, z, pk, sk, tag, x, y, w, h, p_size::double as size_pt, p_brand as font, r, g, b,
        printf('%02X%02X%02X', r, g, b) as hex, bold, chars, kind, case when frame then '' when sk % 17 = 0 then 'insert photo' else 'text ' || sk % 3 end as text, case when not frame then case sk % 13 when 0 then 'line' when 1 then 'rightArrow' when 2 then 'ellipse' else 'rect' end end as preset, case when not frame then case pk % 40 when 0 then 'title' when 1 then 'ftr' when 2 then 'sldNum' when 3 then 'dt' end end as placeholder
        from (select l_orderkey, l_partkey as pk, l_suppkey as sk, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as z,
              case when l_returnflag = 'R' and l_linestatus = 'O' then 'pic' when l_returnflag = 'R' and l_linestatus = 'F' then 'graphicFrame' else 'sp' end as tag,
              457200 + (l_partkey % 12) * 914400 + case when l_suppkey % 5 = 0 then (l_suppkey % 7) * 40000 else 0 end as x, 457200 + (l_suppkey % 7) * 850000 as y,
              900000 + trunc(l_quantity)::bigint * 80000 as w, 400000 + (l_partkey % 9) * 300000 as h, ((l_partkey % 4) * 80 + l_suppkey % 3)::int as r, ((l_partkey // 4 % 4) * 80)::int as g,
              ((l_partkey // 16 % 4) * 80)::int as b, l_linestatus = 'F' as bold, trunc(l_quantity)::bigint * case when l_quantity > 5 then 6 else 1 end as chars,
              case when l_returnflag = 'R' and l_linestatus = 'O' then 'picture' when l_returnflag <> 'R' or l_linestatus not in ('O', 'F') then 'text' when l_partkey % 2 = 0 then 'chart' else 'table' end as kind, l_returnflag = 'R' and l_linestatus in ('O', 'F') as frame from lineitem) l
        join fx_slides s on s.slide_id = l.l_orderkey join customer c on c.c_custkey = s.deck_id join part on p_partkey = pk""",
    "fx_shapes": """select * exclude (x, y, w, h, text, placeholder), case when mark then 10600000 when astray then 5000000 when z = 2 then 457200 + ((template_id * 5 + slide_id % 4 * 3) % 8) * 914400 + sk % 3 * 20000 + case when sk % 4 = 0 then 70000 else 0 end else x end::bigint as x,
        case when mark then 6200000 + template_id % 5 * 45720 when astray then 3000000 when z = 2 then 457200 + ((template_id + slide_id % 4) % 6) * 850000 else y end::bigint as y, case when mark or astray then 914400 when z = 2 then 2000000 + template_id % 3 * 500000 else w end::bigint as w,
        case when mark or astray then 457200 when z = 2 then 900000 else h end::bigint as h, case when kind = 'text' and (mark or astray) then 'company' else text end as text, case when not (mark or astray) then placeholder end as placeholder,
        case when kind in ('chart', 'table') then r when kind = 'text' and sk % 11 = 0 then g end as fill_r, case when kind in ('chart', 'table') then g when kind = 'text' and sk % 11 = 0 then b end as fill_g, case when kind in ('chart', 'table') then b when kind = 'text' and sk % 11 = 0 then r end as fill_b,
        case when kind = 'text' then 1 + case when sk % 2 = 0 then sk % 5 else 0 end end as paras, kind = 'text' and pk % 3 = 0 as bullet,
        case when kind = 'picture' then 'image ' || pk % 3 when kind <> 'text' then 'data ' || pk % 5 when mark or astray then 'company' else text end as content
        from (select *, z = 1 and slide_id % 10 <> 0 as mark, z = 1 and slide_id % 20 = 10 as astray from fx_plain)""",
    "fx_exemplar_ids": "select template_id, slide_id % 4 as quarter, min(slide_id) as exemplar_id from fx_shapes group by 1, 2",
    "fx_plan": "select c_nationkey as template_id, deck_id, slide_id, slide_idx, exemplar_id from fx_slides join customer on c_custkey = deck_id join fx_exemplar_ids i on i.template_id = c_nationkey and quarter = slide_id % 4 where slide_idx % 7 <> 6",
    "fx_exemplars": f"""select s.template_id, slide_id as exemplar_id, z as ez, kind, x, y, w, h, size_pt, chars, {KINDS}[pk % 14 + 1] as slot_kind, case when pk % 4 = 0 then 300000 else 0 end as plate_w, content, text, placeholder,
        f.bx is not null as is_fixed, text = 'insert photo' as photo_prompt from fx_shapes s left join fx_fixed f on f.template_id = s.template_id and f.bx = round_even(x / 45720.0, 0) and f."by" = round_even(y / 45720.0, 0) and f.bw = round_even(w / 45720.0, 0) and f.bh = round_even(h / 45720.0, 0)
        where slide_id in (select exemplar_id from fx_exemplar_ids)""",
    "fx_aligned": """with recursive p as materialized (select s.slide_id, s.z, e.ez, abs(s.x - e.x) + abs(s.y - e.y) + abs(s.w - e.w) + abs(s.h - e.h) as d from fx_shapes s join fx_plan using (slide_id) join fx_exemplars e on e.exemplar_id = fx_plan.exemplar_id and e.kind = s.kind),
        m as (select distinct slide_id, []::bigint[] as zs, []::bigint[] as es from p union all
          select slide_id, list_append(zs, best.z), list_append(es, best.ez) from (select m.slide_id, zs, es, min({'d': d, 'z': z, 'ez': ez}) as best from m join p on p.slide_id = m.slide_id where not list_contains(zs, z) and not list_contains(es, ez) group by 1, 2, 3)),
        longest as (select slide_id, arg_max(zs, len(zs)) as zs, arg_max(es, len(zs)) as es from m group by 1)
        select slide_id, unnest(zs) as z, unnest(es) as ez from longest""",
    "fx_context": """select s.*, p.exemplar_id, a.ez, e.x as ex, e.y as ey, e.w as ew, e.h as eh, e.size_pt as e_pt, e.chars as e_chars, e.slot_kind, coalesce(not e.is_fixed, false) as is_slot,
        case when x.exemplar_id is not null then coalesce(e.is_fixed, false) else t.bx is not null end as is_fixed,
        case when x.exemplar_id is not null then e.ez is null or (not e.is_fixed and e.content <> s.content) else t.bx is null end as is_ours,
        exists (select 1 from fx_exemplars b where b.exemplar_id = p.exemplar_id and not b.is_fixed and ((abs(b.x - s.x) <= 45720 and abs(b.y - s.y) <= 45720 and abs(b.h - s.h) <= 45720 and (abs(b.w - s.w) <= 45720 or (b.plate_w > 0 and s.w between b.w - 45720 and b.w + b.plate_w)))
          or (b.slot_kind in ('chart', 'table') and s.x >= b.x - 45720 and s.y >= b.y - 45720 and s.x + s.w <= b.x + b.w + 45720 and s.y + s.h <= b.y + b.h + 45720))) as inherited
        from fx_shapes s left join fx_plan p on p.slide_id = s.slide_id left join (select distinct exemplar_id from fx_exemplars) x on x.exemplar_id = p.exemplar_id left join fx_aligned a on a.slide_id = s.slide_id and a.z = s.z left join fx_exemplars e on e.exemplar_id = p.exemplar_id and e.ez = a.ez
        left join (select distinct slide_id, z, 1 as bx from fx_shapes f join fx_fixed g on g.template_id = f.template_id and abs(g.bx * 45720 - x) <= 45720 and abs(g."by" * 45720 - y) <= 45720 and abs(g.bw * 45720 - w) <= 45720 and abs(g.bh * 45720 - h) <= 45720) t on t.slide_id = s.slide_id and t.z = s.z""",
    "fx_two_runs": """select slide_id, z, bold, 0 as run, r, g, b, size_pt from fx_shapes where tag = 'sp' union all select slide_id, z, bold, 1, b, r, g, size_pt * 1.5 from fx_shapes where tag = 'sp' and sk % 7 = 0""",
    "fx_theme": """select template_id, printf('%02X%02X%02X', r, g, b) as hex, r, g, b from (select n_nationkey as template_id, (n_nationkey * 10 % 256)::int as r, 80 as g, 160 as b from nation union all select n_nationkey, 240, (n_nationkey * 9 % 256)::int, 0 from nation)""",
    "fx_colors": "select * from fx_palette union select * from fx_theme where template_id in (select template_id from fx_palette) union select distinct template_id, '000000', 0, 0, 0 from fx_palette union select distinct template_id, 'FFFFFF', 255, 255, 255 from fx_palette",
    "fx_runs": "select template_id, deck_id, slide_id, slide_idx, z, font, size_pt, hex, r, g, b, bold, chars from fx_shapes where tag = 'sp'",
    "fx_guides": """select template_id, guide from (select template_id, guide, k, n from (select template_id, round_even(x / 45720.0, 0)::bigint * 45720 as guide, count(distinct slide_id) as k from fx_shapes group by 1, 2)
        join (select template_id, count(distinct slide_id) as n from fx_shapes group by 1) using (template_id)) where k >= 2 and k >= 0.2::double * n
        union all select template_id, unnest([609600, 11582400]) from (select distinct template_id from fx_shapes where template_id not in (select template_id from (select template_id, round_even(x / 45720.0, 0) as g, count(distinct slide_id) as k from fx_shapes group by 1, 2)
        join (select template_id, count(distinct slide_id) as n from fx_shapes group by 1) using (template_id) where k >= 2 and k >= 0.2::double * n))""",
    "fx_palette": """select template_id, hex, r, g, b from (select template_id, hex, r, g, b, row_number() over (partition by template_id order by sum(chars) desc, hex) as k from fx_runs group by template_id, hex, r, g, b) where k <= 8""",
    "fx_scale": """select template_id, size_pt as pt from (select template_id, size_pt, row_number() over (partition by template_id order by sum(chars) desc, size_pt) as k from fx_runs group by template_id, size_pt) where k <= 5""",
    "fx_fonts": """select template_id, font from (select template_id, font, row_number() over (partition by template_id order by sum(chars) desc, font) as k from fx_runs group by template_id, font) where k <= 20""",
    "fx_fixed": """select template_id, round_even(x / 45720.0, 0)::bigint as bx, round_even(y / 45720.0, 0)::bigint as "by", round_even(w / 45720.0, 0)::bigint as bw, round_even(h / 45720.0, 0)::bigint as bh,
        count(distinct slide_id) as n_slides from fx_shapes group by 1, 2, 3, 4, 5 having count(distinct slide_id) >= greatest(3, 0.25 * (select count(distinct slide_id) from fx_plain q where q.template_id = fx_shapes.template_id))""",
    "fx_slots": f"""select template_id, slide_id as exemplar_id, z as slot_id, {KINDS}[pk % 14 + 1] as kind, x, y, w, h, size_pt, {NAMES}[slide_id % 16 + 1] as archetype,
        trunc(0.9::double * floor(w / 12700.0::double / (0.5 * size_pt)) * floor(h / 12700.0::double / (1.2 * size_pt)))::bigint as capacity, 0.5::double + (slide_id % 50) / 100.0::double as confidence
        from fx_shapes where slide_id in (select exemplar_id from fx_exemplar_ids)""",
    "fx_paras": "select doc_id, source, lang, unnest(range(len(string_split(text, chr(10))))) as para_no, unnest(string_split(text, chr(10))) as text from documents",
    "fx_outline": f"""select (doc_id // 12)::varchar as outline_id, doc_id % 12 as idx, doc_id, {NAMES}[doc_id % 16 + 1] as archetype, string_split(text, chr(10))[1] as title,
        list_filter(string_split(text, chr(10))[2:], lambda x: trim(x, ' ') <> '') as bullets, lang as section from documents""",
    "fx_notes": "select conv_id as deck_id, turn as slide_idx, text, case role when 'system' then 'title' when 'user' then 'bullets' else 'cards' end as archetype from conversations",
    "fx_charts": """select c_nationkey::bigint as deck_id, o_orderpriority || ' ' || o_orderstatus as series, year(o_orderdate) as year, sum(floor(o_totalprice)::bigint)::bigint as value
        from orders join customer on o_custkey = c_custkey group by all""",
    "fx_calls": "select event_type as skill, user_id % 5 as model, value as seconds, event_type <> 'error' as ok, length(props) as tokens, ts, user_id from events",
    "fx_paths": "select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages",
    "fx_payloads": """select event_id, k, case k % 8 when 0 then '{"title":"t' || k || '","cards":["a' || k || '","b"]}' when 1 then '{"title":"t","items":["i' || k || '"],"archetype":"cards"}'
        when 2 then '{"content":{"points":["p","q","r' || k || '"]},"archetype":"odd"}' when 3 then '{"title":"v","bullets":"one ' || k || '"}' when 4 then '{"title":null,"bullets":null}'
        when 5 then '{"value":' || k || ',"unit":"%","kpis":[{"value":"' || k || '","label":"l"},{"value":"a long winded value","label":"w"},{"value":"2","label":"m"},{"value":"3","label":"n"},{"value":"4","label":"o"},{"value":"5","label":"p"}]}' when 6 then '{"categories":["x","y"],"series":' || case when k % 16 < 8 then '{"s":[1,' || k || ']}' else '[{"name":"s","values":["1 250","−' || k || ' %",3]}]' end || '}' else '{"header":["h"],"rows":[["r' || k || '"]]}' end as raw
        from (select event_id, (props::json->>'k')::bigint as k from events)""",
}


def with_views(sql: str) -> str:
    """``sql`` after the views that it names, each after those it needs itself; LAB(x) stands for x with Lab columns."""
    done: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in done:
                add(VIEWS[name])
                done.append(name)

    add(sql)
    parts = [f"{n} as ({VIEWS[n]})" for n in done]
    body = sql.strip()
    start = "with recursive " if body.startswith("with recursive ") else "with "
    if body.startswith(start):
        parts, body = [*parts, body[len(start) :].split("\nselect", 1)[0]], "select" + body.split("\nselect", 1)[1]
    out = (start + ",\n".join(parts) + "\n" if parts else "") + body
    return re.sub(r"LAB\((\w+)\)", lambda m: LAB.format(p=m[1]).strip(), out)
