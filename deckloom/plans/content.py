"""Queries of sources, content and speech."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import content
from ..sources import packs
from ..sources.fixtures import Fixtures
from ..sources.scratch import shared_path
from .audit import RAW as A
from .report import PLAN, _findings
from .views import VIEWS, with_views


def _printed(df, name, value, path):
    """One file for each row of ``df``: ``value`` under ``path``/``name``."""
    df.select(name.alias("file"), value.alias("value")).write.partitionBy("file").mode("append").text(path)


def _pack(f: Fixtures):
    """A pack of twenty pretty-printed JSON files, of which some are broken off, a list, a CSV file for each region, with
    quotes and line ends, and a text; each file's fragments."""
    path = shared_path(f.spark, "pack")
    key = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("m:"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("e"), F.col("event_id").cast("string")))
    line = F.concat(F.lit('  "'), key, F.lit('": '), F.replace("raw", F.lit(","), F.lit(",\n    ")))
    files = f.payloads().groupBy((F.col("event_id") % 20).alias("k")).agg(F.array_join(F.array_sort(F.collect_list(line)), ",\n").alias("lines"))  # the files of a small pack
    whole = F.concat(F.lit('{\n  "_note": "left out",\n'), "lines", F.when(F.col("k") % 10 == 0, "").otherwise("\n}"))
    _printed(files, F.concat(F.lit("events"), F.col("k").cast("string"), F.lit(".json")), whole, f"{path}/data")
    n = f.table("nation").join(f.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.col("n_nationkey").cast("string"), F.lit(',"'), "n_name", F.lit('"'))).otherwise(F.concat(F.lit('"say ""'), "n_name", F.lit('"",\nthen", '), F.col("n_nationkey").cast("string")))
    tables = n.groupBy("r_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"]), "\r\n").alias("rows"))
    head = F.when(F.col("r_regionkey") % 2 == 0, F.lit("key,name\n,\n")).otherwise(F.lit("\ufeffwhat,key\n"))
    _printed(tables, F.concat(F.lit("nations"), F.col("r_regionkey").cast("string"), F.lit(".csv")), F.concat(head, "rows"), f"{path}/data")
    names = f.table("region").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "r_name", F.lit('"')))), ",\n"), F.lit("]")).alias("v"))
    _printed(names, F.lit("list.json"), F.col("v"), f"{path}/data")
    f.table("region").select("r_name").orderBy("r_name").coalesce(1).write.mode("append").text(path)  # a text at the root: part-….txt
    good, bad = packs.read_pack(f.spark, path)
    named = F.when(F.col("kind") == "text", F.lit("root")).otherwise(F.col("source"))
    cells = F.when(F.col("kind") == "table", F.array_join(F.flatten(F.try_variant_get("data", "$.rows", "array<array<string>>")), "|"))
    keys = F.size(F.json_object_keys(F.to_json("data"))).cast("long")
    return good.select(named.alias("source"), F.when(F.col("kind") == "text", "text").otherwise(F.col("frag_id")).alias("frag_id"), "kind", "title", F.char_length("text").cast("long").alias("chars"), F.when(~F.col("frag_id").startswith("json:"), keys).alias("keys"), cells.alias("cells")).unionByName(
        bad.select("source", F.col("warning").alias("frag_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("title", "string"), ("chars", "long"), ("keys", "long"), ("cells", "string"))])
    )


def _csv(f: Fixtures):
    path = shared_path(f.spark, "nations")
    f.table("nation").join(f.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey", "n_name").write.csv(path, header=True)
    return packs.table_fragments(f.spark.read.schema("r_name string, n_nationkey int, n_name string").csv(path, header=True), "r_name", "n_nationkey", ["n_nationkey", "n_name"], 4)


def _outlines(f: Fixtures):
    """Twenty pretty-printed files of recorded outlines."""
    path = shared_path(f.spark, "outlines")
    o = f.outline().withColumn("grp", F.concat_ws("-", "outline_id", F.floor(F.col("idx") / 20).cast("string")))
    one = o.groupBy(F.col("grp").alias("outline_id")).agg(F.collect_list(F.struct("idx", "archetype", "title", "bullets")).alias("slides"))
    files = one.groupBy((F.crc32("outline_id") % 20).alias("k")).agg(F.to_json(F.collect_list(F.struct("outline_id", "slides")), {"pretty": "true"}).alias("v"))
    _printed(files, F.col("k").cast("string"), F.col("v"), path)
    return packs.read_outlines(f.spark, path)


def _recorded_findings(f: Fixtures):
    """Recorded audits, a file of each twentieth of the decks."""
    path = shared_path(f.spark, "audits")
    found = _findings(f, ["D01", "D05"]).where("deck_id like 'deck/%'")
    one = found.select("deck_id", F.struct("check_id", F.lit("deterministic").alias("kind"), "severity", "slide_idx", F.col("z").cast("string").alias("element_id"), F.concat("check_id", F.lit(": "), "severity").alias("message"), "autofix", "evidence").alias("finding"))
    audits = one.groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("finding.slide_idx", "finding.check_id", F.to_json("finding").alias("f")))).alias("fs"))
    text_ = F.concat(F.lit('{"deck_path": "'), "deck_id", F.lit('",\n"findings": [\n'), F.array_join(F.transform("fs", lambda x: x["f"]), ",\n"), F.lit('],\n"checks_run": ["D01", "D05"], "duration_s": 0.5}'))
    files = audits.groupBy((F.crc32("deck_id") % 20).alias("k")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(text_), ",\n"), F.lit("]")).alias("v"))
    _printed(files, F.col("k").cast("string"), F.col("v"), path)
    r = packs.read_findings(f.spark, path)
    return r.select(F.col("deck_path").alias("deck_id"), "n", "check_id", "severity", "slide_idx", "element_id", F.element_at("evidence", F.lit("fill")).cast("double").alias("fill"), "checks_run")


def _recorded_runs(f: Fixtures):
    """Recorded runs of templates: each with a deck for each strategy, as a pretty-printed file."""
    path = shared_path(f.spark, "runs")
    s = f.slides().join(f.table("customer"), F.col("deck_id") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("t"), (F.col("deck_id") % 3).alias("k")).agg(F.count("*").alias("slides"), F.countDistinct("deck_id").alias("n"))
    deck = F.struct(F.concat(F.lit("s"), F.col("k").cast("string")).alias("strategy"), F.struct("slides").alias("stats"), F.struct(F.col("n").alias("errors"), (F.col("n") * 2).alias("warnings")).alias("audit"), F.struct((F.col("n") / 4).alias("layout"), (F.col("n") / 2).alias("deck_total")).alias("timings_s"))
    runs = s.groupBy("t").agg(F.to_json(F.struct(F.struct(F.concat(F.lit("t"), F.col("t").cast("string")).alias("id")).alias("template"), F.collect_list(deck).alias("decks"), F.struct(F.sum("n").cast("double").alias("total")).alias("timings_s")), {"pretty": "true"}).alias("v"))
    _printed(runs, F.col("t").cast("string"), F.col("v"), path)
    decks, steps = packs.read_runs(f.spark, path)
    none = F.lit(None).cast("long")
    return decks.select("template_id", "strategy", F.lit("deck").alias("step"), "slides", "errors", "warnings", "seconds").unionByName(steps.select("template_id", "strategy", "step", none.alias("slides"), none.alias("errors"), none.alias("warnings"), "seconds"))


def _cache(f: Fixtures):
    d = f.table("documents").select("doc_id", "text")
    c = d.where("doc_id % 3 = 0").select(F.sha1("text").alias("digest"), F.when(F.col("doc_id") % 2 == 0, "work").otherwise("bundled").alias("place"), (F.col("doc_id") * 10).alias("result"))
    return packs.split_by_cache(d, c, F.sha1("text")).select("doc_id", "result", "place")


def _written(f: Fixtures):
    path = shared_path(f.spark, "audit")
    packs.write_audit(_findings(f, ["D01", "I03"]).select(*PLAN), path)
    return f.spark.read.parquet(path).groupBy("check_id", "severity").agg(F.count("*").alias("n"))


def _run(f: Fixtures):
    path = shared_path(f.spark, "run")
    k = F.col("deck_no") % 3
    found = _findings(f, ["D01", "I03", "L01"]).select(*PLAN)
    slides = f.slides().withColumn("deck_no", F.col("deck_id")).withColumn("deck_id", F.concat(F.lit("deck/"), F.col("deck_id").cast("string")))
    packs.write_run(found, slides, F.when(k == 0, "executive").when(k == 1, "detailed").otherwise("visual"), path)
    return f.spark.read.parquet(f"{path}/comparison")


def _facts(f: Fixtures):
    names = F.array(*map(F.lit, ("metric", "odd", "plan", "overview")))
    n = F.col("doc_id") * 10000 + F.col("para_no")
    return f.paras().select(F.col("source").alias("pack"), F.col("doc_id").alias("chunk"), n.alias("n"), "text", F.element_at(names, (n % 4 + 1).cast("int")).alias("kind"), (n % 6 - 1).alias("weight"))


def _pack_facts(f: Fixtures):
    """Normal facts out of all paragraphs, once for each text of a source."""
    d = content.distinct_facts(content.normal_facts(_facts(f)), ["pack"], ["n"])
    return d.select("pack", F.col("n").alias("id"), "text", "weight")


def _near_facts(f: Fixtures):
    """The same facts out of the documents as they lie, so that only their stems move."""
    chunks = f.table("documents").select(F.col("source").alias("pack"), F.col("doc_id").alias("chunk"), F.split("text", "\n").alias("texts"))
    facts = content.normal_texts(chunks).select("pack", (F.col("chunk") * 10000 + F.col("at")).alias("id"), "text")
    return content.near_facts(facts, once=True)


def _manifests(f: Fixtures):
    k = F.col("k")
    deps = F.when(k % 3 == 0, F.lit('["a>=1","b[x]~=2","c"]')).when(k % 3 == 1, F.lit('{"d":"1","e":"2"}')).otherwise(F.lit("null"))
    raw = F.concat(F.lit('{"name":"n'), k.cast("string"), F.lit('","version":"'), (k % 5).cast("string"), F.lit('.0","dependencies":'), deps, F.lit("}"))
    return f.payloads().select("event_id", raw.alias("raw"))


def _budgets(f: Fixtures):
    return content.word_budget(f.notes(), 4.0)


def _texts(f: Fixtures):
    t = F.col("text")
    return f.paras().select("doc_id", "para_no", text.spoken_words(t).alias("spoken"), F.size(text.words(t)).cast("long").alias("words"), text.slug(t).alias("slug"), F.array_join(F.array_sort(text.stems(t)), ",").alias("stems"))


RUN = {
    "s01_read_pack": _pack,
    "s02_json_fragments": lambda f: packs.json_fragments(f.payloads().select("event_id", "raw")).select("event_id", "frag_id"),
    "s03_table_fragments": _csv,
    "s04_outlines": _outlines,
    "s04_findings": _recorded_findings,
    "s04_runs": _recorded_runs,
    "s05_select_sources": lambda f: packs.select_sources(f.paths().withColumn("path", F.when(F.col("page_id") % 3 == 0, F.concat("path", F.lit("/readme.md"))).when(F.col("page_id") % 3 == 1, F.concat("path", F.lit("/build/x.txt"))).otherwise(F.concat("path", F.lit("/LICENSE.txt"))))),
    "s06_cache": _cache,
    "s07_write_audit": _written,
    "s07_write_run": _run,
    "k01_sections": lambda f: content.sections(f.paras().select("doc_id", "para_no", "text"), r"^#|^[A-ZÀ-Þ][^ ]* [^ ]*\.?$").select("doc_id", "section", "title", "n_lines", F.md5(F.col("body").cast("binary")).alias("digest")),
    "k02_unique_ids": lambda f: content.unique_ids(f.table("documents").select("source", "doc_id"), "source", ["doc_id"], [F.floor(F.col("doc_id") / 1024)]),
    "k03_record_kinds": lambda f: f.payloads().select("event_id", content.record_kind(F.col("raw")).alias("kind")),
    "k04_pack": lambda f: content.pack(f.table("documents"), "source"),
    "k05_tiers": lambda f: f.paths().select("page_id", content.source_tier(F.when(F.col("page_id") % 5 == 0, "package.json").otherwise(F.col("path"))).cast("long").alias("tier")),
    "k06_clean": lambda f: content.clean_lines(f.table("pages"), "html", "(?=<)").select("page_id", F.md5(F.col("clean").cast("binary")).alias("digest"), "was_cut"),
    "k07_tree": lambda f: content.tree(f.paths().withColumn("path", F.concat("path", F.lit(".t"), (F.col("page_id") % 11).cast("string")))),
    "k08_history": lambda f: content.history(f.table("orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id")), 5),
    "k09_manifest": lambda f: _manifests(f).select("event_id", *[c.alias(n) for n, c in content.manifest_facts(F.col("raw")).items()]),
    "k10_chunks": lambda f: content.chunks(f.table("documents"), "source"),
    "k11_facts": lambda f: content.normal_facts(_facts(f)),
    "k11_allowed_facts": lambda f: content.normal_facts(_facts(f).withColumn("source", F.col("n") % 3), allowed=f.table("documents").select(F.col("doc_id").alias("chunk"), (F.col("doc_id") % 3).alias("source"))),
    "k12_distinct_facts": lambda f: content.distinct_facts(f.paras(), [], ["doc_id", "para_no"]).select("doc_id", "para_no"),
    "k13_near_facts": _near_facts,
    "k14_select_facts": lambda f: content.select_facts(_pack_facts(f), 1500),
    "v01_word_budget": lambda f: _budgets(f).select("deck_id", "slide_idx", "budget"),
    "v02_merge_notes": lambda f: content.merge_notes(f.notes().where("slide_idx <> 2").select("deck_id", (F.floor(F.col("slide_idx") / 2) * 2 + F.col("deck_id") % 2).alias("n"), "text").distinct(), f.notes()),
    "v03_trim_notes": lambda f: content.trim_notes(_budgets(f)),
    "v04_clean_notes": lambda f: f.notes().select("deck_id", "slide_idx", F.md5(content.clean_note(F.col("text")).cast("binary")).alias("digest")),
    "v05_timing": lambda f: content.talk_timing(f.notes()),
    "t01_texts": _texts,
}

FACTS = """with f as (select source as pack, doc_id as chunk, doc_id * 10000 + para_no as n, left(trim(text, ' '), 400) as text, least(greatest((doc_id * 10000 + para_no) % 6 - 1, 1), 3) as weight, ['metric', 'other', 'plan', 'overview'][(doc_id * 10000 + para_no) % 4 + 1] as kind from fx_paras{where}),
 u as (select *, row_number() over (partition by pack, chunk, lower(text) order by n) as k from f where length(text) >= 12), v as (select *, row_number() over (partition by pack, chunk order by n) as m from u where k = 1)
select pack, chunk, n, text, kind, weight from v where m <= 12"""
VIEWS["fx_pack_facts"] = f"select pack, id, text, weight from (select pack, n as id, text, weight, row_number() over (partition by pack, regexp_replace(lower(trim(text, ' ')), '\\.+$', '') order by n) as k from ({FACTS.format(where='')})) where k = 1"
VIEWS["fx_stems"] = r"""select pack, id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[\p{L}]+|[0-9]+'), lambda w: length(w) >= 4 or regexp_matches(w, '^[0-9]')), lambda w: case when regexp_matches(w, '^[0-9]') then w else left(w, 5) end))) as stems from fx_pack_facts"""
VIEWS["fx_each_stem"] = "select pack, id, len(stems) as n, unnest(stems) as stem from fx_stems"
VIEWS["fx_near"] = """select pack, id, other, c::double / least(n, m) as s from (select a.pack, a.id, b.id as other, a.n, b.n as m, count(*) as c from fx_each_stem a join fx_each_stem b on a.pack = b.pack and a.stem = b.stem and a.id < b.id group by all) where c::double / least(n, m) >= 0.6::double"""
VIEWS["fx_budget"] = """select deck_id, slide_idx, text, greatest(10, round_even(480.0::double * tw / sum(tw) over (partition by deck_id), 0)::bigint) as budget from (select *, case archetype when 'title' then 0.5 when 'section' then 0.25 when 'closing' then 0.6 else 1.0 end::double as tw from fx_notes)"""
WORDS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+(?:[-’''][\p{{L}}\p{{N}}_]+)*'))"

SQL = {
    "s01_read_pack": """with e as (select event_id, k, raw, 'events' || event_id % 20 as stem, event_id % 20 as file from fx_payloads),
 j as (select stem || '.json' as source, case when event_id % 2 = 0 then 'm:' || event_id else stem || ':e' || event_id end as frag_id, case k % 8 when 5 then 'metric' when 6 then 'series' when 7 then 'table' else 'record' end as kind,
   case k % 8 when 0 then 't' || k when 1 then 't' when 3 then 'v' else '' end as title, 0 as chars, case k % 8 when 0 then 2 when 1 then 3 when 2 then 2 when 3 then 2 when 4 then 2 when 5 then 3 when 6 then 2 else 2 end as keys, case when k % 8 = 7 then 'r' || k end as cells from e where file % 10 <> 0),
 n as (select r_regionkey as r, n_nationkey as k, case when r_regionkey % 2 = 0 then n_nationkey || '|' || n_name else 'say "' || n_name || '",' || chr(10) || 'then|' || n_nationkey end as row_ from nation join region on n_regionkey = r_regionkey)
select * from j union all select 'nations' || r || '.csv', 'csv:nations' || r, 'table', 'nations' || r, 0, 2, string_agg(row_, '|' order by k) from n group by r
union all select 'list.json', 'json:list', 'record', '', 0, null, null union all select 'root', 'text', 'text', '', sum(length(r_name) + 1), null, null from region
union all select distinct stem || '.json', 'unreadable', null, null, null, null, null from e where file % 10 = 0""",
    "s02_json_fragments": "select event_id, 'data:' || unnest(json_keys(raw)) as frag_id from fx_payloads",
    "s03_table_fragments": """with n as (select r_name, n_nationkey || ' | ' || n_name as row_, row_number() over (partition by r_name order by n_nationkey) as k, count(*) over (partition by r_name) as total from nation join region on n_regionkey = r_regionkey)
select r_name, string_agg(row_, chr(10) order by k) as "table", max(total) as total, case when max(total) > 4 then 'first 4 of ' || max(total) else '' end as note from n where k <= 4 group by 1""",
    "s04_outlines": "select outline_id || '-' || (idx // 20) as outline_id, idx, archetype, title, len(bullets) as n_bullets from fx_outline",
    "s04_findings": """with f as (select check_id, severity, deck_id, slide_idx, z, fill from (select 'D01' as check_id, 'warning' as severity, 'deck/' || deck_id as deck_id, slide_idx, z, null as fill from (D01) union all select 'D05', 'info', 'deck/' || deck_id, slide_idx, null, fill from (D05)) where deck_id not in (select 'deck/' || deck_id from (I01)))
select deck_id, row_number() over (partition by deck_id order by slide_idx, check_id) - 1 as n, check_id, severity, slide_idx, z::varchar as element_id, fill, 2 as checks_run from f""".replace("(D01)", f"({A['a16_many_bullets']})").replace("(D05)", f"({A['a20_fill_ratio']})").replace("(I01)", f"({A['a21_duplicate_parts']})"),
    "s04_runs": """with s as (select c_nationkey as t, deck_id % 3 as k, count(*) as slides, count(distinct deck_id) as n from fx_slides join customer on c_custkey = deck_id group by 1, 2)
select 't' || t as template_id, 's' || k as strategy, 'deck' as step, slides, n as errors, n * 2 as warnings, n / 2.0::double as seconds from s union all select 't' || t, 's' || k, unnest(['layout', 'deck_total']), null, null, null, unnest([n / 4.0::double, n / 2.0::double]) from s
union all select 't' || t, null, 'total', null, null, null, sum(n)::double from s group by t""",
    "s05_select_sources": "select page_id, path || '/readme.md' as path from fx_paths where page_id % 3 = 0",
    "s06_cache": """with c as (select sha1(text) as digest, arg_min(doc_id * 10, (doc_id % 2 <> 0, doc_id)) as result, case when bool_or(doc_id % 2 = 0) then 'work' else 'bundled' end as place from documents where doc_id % 3 = 0 group by 1)
select doc_id, result, coalesce(place, 'todo') as place from documents left join c on sha1(text) = digest""",
    "s07_write_audit": "select check_id, severity, count(*) as n from fx_found where check_id in ('D01', 'I03') group by all",
    "s07_write_run": """with s as (select 'deck/' || deck_id as deck_id, any_value(deck_id) % 3 as k, count(*) as slides from fx_slides group by fx_slides.deck_id), c as (select deck_id, count(*) filter (severity = 'error') as e, count(*) filter (severity = 'warning') as w, count(*) filter (severity = 'info') as i from fx_found where check_id in ('D01', 'I03', 'L01', 'L04') group by 1)
select case k when 0 then 'executive' when 1 then 'detailed' else 'visual' end as strategy, count(*) as decks, sum(slides)::bigint as slides, coalesce(sum(e), 0)::bigint as n_error, coalesce(sum(w), 0)::bigint as n_warning, coalesce(sum(i), 0)::bigint as n_info from s left join c using (deck_id) group by 1""",
    "k01_sections": r"""with h as (select *, regexp_matches(text, '^#|^[A-ZÀ-Þ][^ ]* [^ ]*\.?$') as hd from fx_paras), s as (select *, sum(hd::int) over (partition by doc_id order by para_no) as section, sum(hd::int) over (partition by doc_id) as heads from h)
select doc_id, section::bigint as section, max(text) filter (hd) as title, count(*) filter (not hd and trim(text, ' ') <> '') as n_lines, md5(string_agg(text, chr(10) order by para_no) filter (not hd and trim(text, ' ') <> '')) as digest from s where heads >= 2 and section >= 1 group by 1, 2 having count(*) filter (not hd and trim(text, ' ') <> '') > 0""",
    "k02_unique_ids": """with k as (select source, doc_id, row_number() over (partition by source order by doc_id) as k from documents)
select source, doc_id, case when k = 1 then source else source || '~' || k end as unique_id from k""",
    "k03_record_kinds": """select event_id, case when json_exists(raw, '$.categories') and json_exists(raw, '$.series') then 'series' when json_exists(raw, '$.header') and json_exists(raw, '$.rows') then 'table' when json_exists(raw, '$.value') then 'metric' else 'record' end as kind from fx_payloads""",
    "k04_pack": """with u as (select source as grp, doc_id, sum(length(text)) over (partition by source order by doc_id)::bigint as used from documents)
select * from u where used <= 12000""",
    "k05_tiers": """with p as (select page_id, string_split(case when page_id % 5 = 0 then 'package.json' else path end, '/') as p from fx_paths)
select page_id, (case when lower(p[-1]) like 'readme%' and len(p) = 1 then 0 when len(p) = 1 and lower(p[-1]) in ('pyproject.toml', 'package.json', 'setup.cfg', 'cargo.toml', 'go.mod', 'tree.txt', 'history.txt', 'changelog.md') then 1 when lower(p[1]) in ('docs', 'doc', 'documentation') then 2 when len(p) = 1 or lower(p[-1]) like 'readme%' then 3 else 4 end)::bigint as tier from p""",
    "k06_clean": r"""with l as (select page_id, list_filter(string_split(regexp_replace(html, '(.)<', '\1' || chr(1) || '<', 'gs'), chr(1)), lambda x: not regexp_matches(x, '^ *(<[^>]+> *)+$') and not contains(x, '![') and not regexp_matches(x, '^ *\[!\[')) as ls from pages), t as (select page_id, regexp_replace(array_to_string(ls, chr(10)), '\n{3,}', chr(10) || chr(10), 'g') as full_ from l)
select page_id, md5(left(full_, 40000)) as digest, length(full_) > 40000 as was_cut from t""",
    "k07_tree": r"""with q as (select string_split(path || '.t' || page_id % 11, '/') as p from fx_paths), l as (select p, unnest(range(0, least(len(p) - 1, 2) + 1)) as i from q),
 e as (select lower(coalesce(nullif(regexp_extract(p[-1], '[^.](\.[^.]+)$', 1), ''), p[-1])) as name, count(*) as files from q group by 1 order by 2 desc, 1 limit 8)
select 'folder' as kind, array_to_string(p[1:i], '/') as name, count(*) as files from l group by 2 union all select 'extension', name, files from e""",
    "k08_history": """with k as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders)
select o_custkey as repo, count(*) as commits, min(o_orderdate)::date as first, max(o_orderdate)::date as last, string_agg(o_orderkey::varchar, ',' order by k) filter (k <= 5) as latest from k group by 1""",
    "k09_manifest": """select event_id, 'n' || k as name, k % 5 || '.0' as version, '' as description, case k % 3 when 0 then 'a,b,c' when 1 then 'd,e' else '' end as dependencies from fx_payloads""",
    "k10_chunks": """with recursive w as (select source as grp, doc_id, text from documents), cut as (select grp, doc_id, line_no, length(line) as len, unnest(range(0, ceil(length(line) / 7800.0)::bigint)) as part from (select grp, doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no from w where length(text) > 7800) where trim(line, ' ') <> ''),
 o as (select grp, doc_id, least(7800, len - part * 7800) as n, row_number() over (partition by doc_id order by line_no, part) as k from cut),
 walk as (select grp, doc_id, k, n::bigint as used, 0::bigint as piece from o where k = 1 union all select o.grp, o.doc_id, o.k, case when w.used + 2 + o.n <= 7800 then w.used + 2 + o.n else o.n end, case when w.used + 2 + o.n <= 7800 then w.piece else w.piece + 1 end from walk w join o on o.doc_id = w.doc_id and o.k = w.k + 1),
 p as (select grp, doc_id, piece, max(used) as n from walk group by 1, 2, 3 union all select grp, doc_id, 0, length(text) from w where length(text) <= 7800),
 q as (select *, row_number() over (partition by grp order by doc_id, piece) as k from p),
 fill as (select grp, doc_id, piece, n, k, 0::bigint as chunk, n + 2 as used from q where k = 1 union all select q.grp, q.doc_id, q.piece, q.n, q.k, case when f.used + q.n <= 8000 then f.chunk else f.chunk + 1 end, case when f.used + q.n <= 8000 then f.used else 0 end + q.n + 2 from fill f join q on q.grp = f.grp and q.k = f.k + 1)
select grp, doc_id, piece, n, case when chunk < 24 then chunk end as chunk from fill""",
    "k11_facts": FACTS.format(where=""),
    "k11_allowed_facts": FACTS.format(where=" where (doc_id * 10000 + para_no) % 3 = doc_id % 3"),
    "k12_distinct_facts": r"""with k as (select doc_id, para_no, row_number() over (partition by regexp_replace(lower(trim(text, ' ')), '\.+$', '') order by doc_id, para_no) as k from fx_paras)
select doc_id, para_no from k where k = 1""",
    "k13_near_facts": """with c as (select *, min(id) over (partition by pack, stems) as first from fx_stems where len(stems) > 0)
select pack, first as id, id as other, 1.0::double as share from c where id <> first union all select n.pack, n.id, n.other, round_even(s, 4) from fx_near n semi join (select pack, id from c where id = first) a on a.pack = n.pack and a.id = n.id semi join (select pack, id from c where id = first) b on b.pack = n.pack and b.id = n.other""",
    "k14_select_facts": """with recursive o as (select *, row_number() over (partition by pack order by weight desc, id) as k from fx_pack_facts), nn as (select pack, id, list(other) as near from (select pack, id, other from fx_near union all select pack, other, id from fx_near) group by all),
 j as (select o.*, length(text) as size, coalesce(near, []) as near from o left join nn using (pack, id)),
 walk as (select pack, 0::bigint as k, 0::bigint as used, []::bigint[] as ids from (select distinct pack from fx_pack_facts)
  union all select w.pack, j.k, case when w.used + size <= 1500 and not list_has_any(w.ids, near) then w.used + size else w.used end, case when w.used + size <= 1500 and not list_has_any(w.ids, near) then list_append(w.ids, j.id) else w.ids end from walk w join j on j.pack = w.pack and j.k = w.k + 1),
 last as (select pack, unnest(arg_max(ids, k)) as id from walk group by 1)
select pack, id, row_number() over (partition by pack order by id) as n from last""",
    "v01_word_budget": "select deck_id, slide_idx, budget from fx_budget",
    "v02_merge_notes": """with a as (select distinct deck_id, slide_idx // 2 * 2 + deck_id % 2 as n, text from fx_notes where slide_idx <> 2), s as (select *, n - case when min(n) over (partition by deck_id) >= 1 then 1 else 0 end as slide_idx from a), j as (select deck_id, slide_idx, string_agg(text, ' ' order by n, text) as note from s group by 1, 2)
select f.deck_id, f.slide_idx, note, note is null as missing from fx_notes f left join j using (deck_id, slide_idx)""",
    "v03_trim_notes": rf"""with sp as (select deck_id, slide_idx, budget, list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as ss from fx_budget),
 s0 as (select deck_id, slide_idx, budget, unnest(ss) as sentence, unnest(range(len(ss))) as at_ from sp), s1 as (select *, {WORDS.format('sentence')} as words from s0),
 s2 as (select *, sum(words) over (partition by deck_id, slide_idx order by at_)::double / budget as ratio, sum(words) over (partition by deck_id) as total from s1),
 s3 as (select *, coalesce(sum(words) filter (at_ > 0) over (partition by deck_id order by at_ > 0 desc, ratio desc, slide_idx, at_ desc rows between unbounded preceding and 1 preceding), 0) as before_ from s2),
 s4 as (select *, at_ > 0 and total - before_ > 1.1::double * allowed as gone from s3 join (select deck_id, sum(budget) as allowed from fx_budget group by 1) using (deck_id))
select deck_id, slide_idx, count(*) filter (not gone) as stay, count(*) filter (gone) as cut from s4 group by 1, 2""",
    "v04_clean_notes": r"""with a as (select deck_id, slide_idx, regexp_replace(regexp_replace(text, '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '[*_#`>]+', '', 'g') as t from fx_notes)
select deck_id, slide_idx, md5(trim(regexp_replace(regexp_replace(t, '^\s*[\p{L}]+:\s*', ''), '\s+', ' ', 'g'), ' ')) as digest from a""",
    "v05_timing": f"""with w as (select deck_id, slide_idx, {WORDS.format('text')} as words from fx_notes)
select *, round_even(words * 60 / 120.0::double, 0)::bigint as seconds, round_even((sum(words) over (partition by deck_id)) * 60 / 120.0::double, 0)::bigint as deck_seconds from w""",
    "t01_texts": rf"""with s as (select doc_id, para_no, text, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), ' ') as sl, list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[\p{{L}}]+|[0-9]+'), lambda w: length(w) >= 4 or regexp_matches(w, '^[0-9]')), lambda w: case when regexp_matches(w, '^[0-9]') then w else left(w, 5) end)) as st from fx_paras)
select doc_id, para_no, {WORDS.format('text')} as spoken, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as words, coalesce(nullif(left(sl, 40), ''), 'section') as slug, array_to_string(list_sort(st), ',') as stems from s""",
}

QUERIES = {name: (lambda spark, sf_dir, run=run: run(Fixtures(spark, sf_dir))) for name, run in RUN.items()}
SQL = {name: with_views(sql) for name, sql in SQL.items()}
