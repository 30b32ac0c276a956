"""Queries of the report operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.color import with_channels
from ..operators import alignment, audit, layout, report
from ..sources.fixtures import Fixtures, Prepared
from ..sources.scratch import written
from . import audit as audit_plans
from . import layout as layout_plans
from .views import VIEWS, with_views


def _finding(df, check_id, severity, fix=None, of="deck"):
    """Findings whose deck_id names what it is an id of: decks, documents, nations and conversations stay apart."""
    named = df.withColumn("deck_id", F.concat(F.lit(f"{of}/"), F.col("deck_id").cast("string")))
    return audit.finding(named, check_id, severity).withColumn("autofix", F.lit(fix).cast("string"))


def _of_document(df, place=None):
    """Findings on texts: a document is a deck, a paragraph a slide."""
    return df.withColumnRenamed("doc_id", "deck_id").withColumnRenamed(place, "slide_idx") if place else df.withColumnRenamed("doc_id", "deck_id")


def _sizes(f: Fixtures):
    found = audit.off_scale(f.context().where("tag = 'sp'"), f.scale()).withColumn("nearest_pt", F.when(F.col("z") % 5 != 0, F.col("nearest_pt")))  # some lack their evidence
    return _finding(found, "T02", F.col("severity"), "snap_font_size")


def _prompt(pattern):
    return F.when(pattern == -200, "warning").otherwise("error")


#: All rules: the check of the audit, its severity, and the fix it names.
RULES = {
    "L01_out_of_slide": lambda f: _finding(audit.off_slide(f.context()), F.col("check_id"), F.col("severity"), "clamp_to_slide"),
    "L02_overlap": lambda f: _finding(audit.overlaps(f.context()), "L02", F.col("severity"), "reflow_vertical"),
    "L02_lines": lambda f: _finding(layout.lines_over_blocks(f.context()), "L02", "error", "reflow_vertical"),
    "L03_overflow": lambda f: _finding(_of_document(audit_plans.overflow(f)), "L03", F.col("severity"), "shrink_font_by_scale", "document"),
    "L05_off_grid": lambda f: _finding(audit.off_grid(f.context(), f.guides()), "L05", "warning", "snap_to_grid"),
    "L06_margins": lambda f: _finding(audit.in_margins(f.shapes()), "L06", "warning", "snap_to_grid"),
    "L07_stretched": lambda f: _finding(audit.stretched(audit_plans.pictures(f)), "L07", F.col("severity"), "crop_to_aspect"),
    "T01_foreign_fonts": lambda f: _finding(audit.foreign_fonts(f.runs(), f.fonts()), "T01", "error", "reset_font"),
    "T01_many_families": lambda f: _finding(audit.many_families(f.runs()), "T01", "warning", "reset_font"),
    "T02_off_scale": _sizes,
    "T03_off_palette": lambda f: _finding(audit.off_palette(f.runs(), audit_plans.colors(f)).withColumnRenamed("hex", "color"), "T03", "warning", "snap_color"),
    "T04_layout": lambda f: _finding(audit.wrong_layout(*audit_plans.layouts(f)), "T04", "warning", "change_exemplar"),
    "T05_moved_fixed": lambda f: _finding(alignment.lost_fixed(f.plan(), f.exemplars(), f.context()), "T05", "error", "restore_fixed"),
    "T05_displaced_fixed": lambda f: _finding(audit_plans.RULES["a14_displaced_fixed"](f), "T05", "warning", "restore_fixed"),
    "T06_contrast": lambda f: _finding(audit_plans.RULES["a15_low_contrast"](f), "T06", F.col("severity")),
    "D01_many_bullets": lambda f: _finding(audit.many_bullets(f.context()), "D01", "warning", "split_slide"),
    "D02_long_paragraphs": lambda f: _finding(_of_document(audit.long_paragraphs(f.paras()), "para_no"), "D02", "warning", "refill_slot", "document"),
    "D03_large_tables": lambda f: _finding(audit.large_tables(audit_plans.tables(f)), "D03", "warning", "split_table", "nation"),
    "D04_many_series": lambda f: _finding(audit.many_series(audit_plans.series(f)), "D04", "warning", "drop_minor_series", "nation"),
    "D05_fill": lambda f: _finding(audit.fill_ratio(f.shapes(), audit_plans.planned(f)), "D05", "info"),
    "I01_duplicate_parts": lambda f: _finding(audit.duplicate_parts(audit_plans.parts(f)), "I01", "error"),
    "I02_placeholders": lambda f: _finding(_of_document(audit.placeholders(*audit_plans.prompts(f))), "I02", _prompt(F.col("pattern_no")), "refill_slot", "document"),
    "I02_prompts": lambda f: _finding(audit.prompts_left(f.context()), "I02", F.col("severity"), "refill_slot"),
    "I03_empty": lambda f: _finding(audit.empty_slides(f.slides(), f.shapes()), "I03", "error", "drop_slide"),
    "I04_one_raster": lambda f: _finding(audit.one_raster(f.shapes(), 0.05), "I04", "warning"),
    "I05_charts": lambda f: _finding(audit.unlabelled_charts(audit_plans.chart_flags(f)), "I05", "warning", "add_chart_labels", "nation"),
    "I06_duplicates": lambda f: _finding(_of_document(audit.duplicate_slides(f.table("documents"), "source").drop("grp")), "I06", "warning", "drop_slide", "document"),
    "N01_short_notes": lambda f: _finding(audit.short_notes(f.notes(), 10), "N01", "info", None, "conversation"),
    "N02_talk_time": lambda f: _finding(audit.talk_time(f.notes(), 4.0), "N02", "warning", None, "conversation"),
}


def _findings(f: Fixtures, chosen: list[str] | None = None):
    """Of all rules, on shapes and exemplars that are worked out once; a broken deck has no finding but that."""
    return report.run_rules(RULES, f if isinstance(f, Prepared) else Prepared(f.spark, f.sf_dir), chosen, "I01")


class Refixed(Fixtures):
    """Slides after fixes: the shapes given, and all that a template has as it was."""

    def __init__(self, before: Prepared, shapes):
        super().__init__(before.spark, before.sf_dir)
        self.before, self.fixed_shapes = before, shapes

    def shapes(self):
        return self.fixed_shapes

    context = shapes

    def palette(self):
        return self.before.palette()

    def scale(self):
        return self.before.scale()


#: Rules of the second audit: those whose fixes are made, and those that larger or smaller texts can break.
AGAIN = ["L01", "L02_lines", "T02", "T03", "D01"]


def _snapped(f: Fixtures):
    return report.snap_sizes(f.runs(), audit.off_scale(f.context().where("tag = 'sp'"), f.scale()))


def _answers(f: Fixtures):
    lab = f.table("labels")
    ok = lambda c: F.when(c == 1, F.lit("true")).otherwise(F.lit("false"))
    raw = F.concat(F.lit('{"C05":{"ok":'), ok(F.col("quality")), F.lit(',"note":"'), F.when(F.col("doc_id") % 5 == 0, "n/a").otherwise("thin"), F.lit('"},"C07":{"ok":'), ok(1 - F.col("toxic")), F.lit(',"note":null}}'))
    names = F.array(*map(F.lit, ("title", "bullets", "closing", "cards")))
    return lab.select(F.col("doc_id").alias("slide_id"), F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("archetype"), raw.alias("answers"))


def _evidence(f: Fixtures):
    k = F.col("doc_id")
    d = f.table("documents").select("source", k.alias("id"), (k % 3 == 0).alias("cited"), F.char_length("text").alias("size"))
    return report.evidence(d, "source", 60000).withColumnRenamed("id", "doc_id")


def _shrink(f: Fixtures):
    need, have = F.col("size_pt") * 1.2 * F.col("chars"), F.col("h") / 12700
    slot = F.coalesce("placeholder", F.when(F.col("chars") <= 5, "number").when(F.col("chars") <= 40, "label").otherwise("body"))
    return report.shrink_fonts(f.shapes().where("tag = 'sp'").select("slide_id", "z", need.alias("need_pt"), have.alias("have_pt"), slot.alias("slot_kind"), (F.col("sk") % 4 != 0).alias("wraps"))).select("slide_id", "z", "scale", "cut")


def _rounds(f: Fixtures):
    """The findings before and after the safe fixes of sizes and colours: slides that a fix touched are audited again."""
    first = Prepared(f.spark, f.sf_dir)
    before = written(_findings(first, AGAIN), "findings")
    fixes = report.choose_fixes(report.fix_plan(before, report.catalogue(f.spark))).where("autofix in ('snap_font_size', 'snap_color')")
    at = first.slides().select(F.concat(F.lit("deck/"), F.col("deck_id").cast("string")).alias("deck_id"), "slide_idx", "slide_id")
    chosen = written(fixes.join(at.hint("merge"), ["deck_id", "slide_idx"]), "fixes")
    sizes = chosen.where("autofix = 'snap_font_size'").select("slide_id", "z", F.col("evidence")["size_pt"].cast("double").alias("size_pt"), F.col("evidence")["nearest_pt"].cast("double").alias("nearest_pt"))
    hues = chosen.where("autofix = 'snap_color'").select("slide_id", "z", F.col("evidence")["color"].alias("hex"), F.col("evidence")["nearest"].alias("nearest"))
    touched = chosen.select("slide_id").distinct()
    own = first.context().join(touched.hint("merge"), "slide_id", "left_semi")
    runs = report.snap_colors(report.snap_sizes(own.where("tag = 'sp'"), sizes), hues)
    again = written(with_channels(runs).select(*own.columns).unionByName(own.where("tag <> 'sp'")), "fixed-context")
    places = at.join(touched.hint("merge"), "slide_id", "left_semi").select("deck_id", "slide_idx")
    after = before.join(places.hint("merge"), ["deck_id", "slide_idx"], "left_anti").unionByName(_findings_of(Refixed(first, again)))
    return before, after


def _findings_of(f: Fixtures):
    return report.run_rules(RULES, f, AGAIN, "I01")


def _strategies(f: Fixtures):
    k = F.col("deck_no") % 3
    slides = f.slides().withColumn("deck_no", F.col("deck_id")).withColumn("deck_id", F.concat(F.lit("deck/"), F.lpad(F.col("deck_id").cast("string"), 12, "0")))
    padded = F.concat(F.lit("deck/"), F.lpad(F.substring("deck_id", 6, 20), 12, "0"))
    found = _findings(f).where("deck_id like 'deck/%'").withColumn("deck_id", padded)
    return report.strategy_comparison(slides, found, F.when(k == 0, "executive").when(k == 1, "detailed").otherwise("visual"))


PLAN = ["check_id", "severity", "deck_id", "slide_idx", "z"]
RUN = {
    "g01_findings": lambda f: report.ordered(_findings(f)).select(*PLAN, "n"),
    "g01_chosen_rules": lambda f: _findings(f, ["D", "L05"]).select(*PLAN),
    "g02_merged": lambda f: report.ordered(
        _findings(f, ["D01"]).select(*PLAN).unionByName(report.judged(_answers(f), f.spark).select(F.col("question").alias("check_id"), "severity", F.concat(F.lit("document/"), F.col("slide_id").cast("string")).alias("deck_id"), F.lit(0).cast("long").alias("slide_idx"), F.lit(None).cast("long").alias("z")))
    ),
    "g03_summary": lambda f: report.summary(_findings(f)),
    "g04_report": lambda f: report.report(_findings(f), 10).select(*PLAN, "n", "more"),
    "g05_judged": lambda f: report.judged(_answers(f), f.spark),
    "g06_evidence": _evidence,
    "g07_fix_plan": lambda f: report.fix_plan(_findings(f), report.catalogue(f.spark)).select(*PLAN, "autofix", "how"),
    "g08_choose_fixes": lambda f: report.choose_fixes(report.fix_plan(_findings(f), report.catalogue(f.spark))).select(*PLAN, "autofix"),
    "g09_snap_colors": lambda f: report.snap_colors(f.runs(), audit.off_palette(f.runs(), audit_plans.colors(f))).groupBy("deck_id", "hex").agg(F.count("*").alias("n")),
    "g10_snap_sizes": lambda f: _snapped(Prepared(f.spark, f.sf_dir)).groupBy("deck_id", "size_pt").agg(F.count("*").alias("n")),
    "g11_shrink_fonts": _shrink,
    "g12_refill": lambda f: report.refill(f.paras()).select("doc_id", "para_no", F.md5(F.col("text").cast("binary")).alias("digest")),
    "g13_minor_series": lambda f: report.drop_minor_series(f.charts()),
    "g14_drop_shapes": lambda f: report.drop_shapes(f.shapes(), f.shapes().where("chars < 5")).groupBy("deck_id").agg(F.count("*").alias("n")),
    "g14_chart_labels": lambda f: report.add_chart_labels(audit_plans.chart_flags(f), audit.unlabelled_charts(audit_plans.chart_flags(f))),
    "g15_drop_slides": lambda f: report.drop_slides(f.slides(), audit.empty_slides(f.slides(), f.shapes())).select("deck_id", "slide_id", "slide_idx"),
    "g16_fix_effect": lambda f: report.fix_effect(*_rounds(f)),
    "g16_second_round": lambda f: report.second_round(*_rounds(f)),
    "r01_statistics": lambda f: report.deck_statistics(layout_plans._demands(f)),
    "r02_strategies": _strategies,
    "r03_call_log": lambda f: report.call_log(f.calls()),
    "r04_stress": lambda f: report.stress_report(f.calls()),
    "r04_findings": lambda f: report.stress_findings(_findings(f)),
    "r04_slowest": lambda f: report.slowest_calls(f.calls()),
    "r05_archetypes": lambda f: report.archetype_counts(f.slots()),
}

A, L = audit_plans.RAW, layout_plans.RAW


def _found(check: str, severity: str, body: str, fix: str = "null", deck: str = "deck_id", idx: str = "slide_idx", z: str = "z", has: str = "true", of: str = "deck") -> str:
    return f"select {check} as check_id, {severity} as severity, '{of}/' || {deck} as deck_id, {idx} as slide_idx, {z} as z, {fix} as autofix, {has} as has from ({body})"


_EDGES = _found("check_id", "severity", A["a01_off_slide"], "'clamp_to_slide'")
_LINES = _found("'L02'", "'error'", L["a04_lines_over_blocks"], "'reflow_vertical'")
_SIZES = _found("'T02'", "severity", A["a10_off_scale"], "'snap_font_size'", has="z % 5 <> 0")
_HUES = _found("'T03'", "'warning'", A["a11_off_palette"], "'snap_color'")
_MANY = _found("'D01'", "'warning'", A["a16_many_bullets"], "'split_slide'")
_BROKEN = _found("'I01'", "'error'", A["a21_duplicate_parts"], idx="-1", z="null")
VIEWS["fx_each"] = "\nunion all ".join(
    [
        _EDGES, _found("'L02'", "severity", A["a03_overlap"], "'reflow_vertical'"), _LINES,
        _found("'L03'", "severity", L["a05_overflow"], "'shrink_font_by_scale'", "doc_id", "-1", "null", of="document"), _found("'L05'", "'warning'", A["a06_off_grid"], "'snap_to_grid'"), _found("'L06'", "'warning'", A["a07_in_margins"], "'snap_to_grid'"),
        _found("'L07'", "severity", A["a08_stretched"], "'crop_to_aspect'"), _found("'T01'", "'error'", A["a09_foreign_fonts"], "'reset_font'"), _found("'T01'", "'warning'", A["a09_many_families"], "'reset_font'"), _SIZES, _HUES,
        _found("'T04'", "'warning'", A["a12_wrong_layout"], "'change_exemplar'", z="null"), _found("'T05'", "'error'", A["a13_moved_fixed"], "'restore_fixed'"), _found("'T05'", "'warning'", A["a14_displaced_fixed"], "'restore_fixed'"),
        _found("'T06'", "severity", A["a15_low_contrast"]), _MANY, _found("'D02'", "'warning'", A["a17_long_paragraphs"], "'refill_slot'", "doc_id", "para_no", "null", of="document"),
        _found("'D03'", "'warning'", A["a18_large_tables"], "'split_table'", idx="-1", z="null", of="nation"), _found("'D04'", "'warning'", A["a19_many_series"], "'drop_minor_series'", idx="-1", z="null", of="nation"), _found("'D05'", "'info'", A["a20_fill_ratio"], z="null"),
        _BROKEN, _found("'I02'", "case when pattern_no = -200 then 'warning' else 'error' end", A["a22_placeholders"], "'refill_slot'", "doc_id", "-1", "null", of="document"), _found("'I02'", "severity", A["a22_prompts_left"], "'refill_slot'"),
        _found("'I03'", "'error'", A["a23_empty_slides"], "'drop_slide'", z="null"), _found("'I04'", "'warning'", A["a24_one_raster"], z="null"), _found("'I05'", "'warning'", A["a25_unlabelled_charts"], "'add_chart_labels'", idx="-1", z="null", of="nation"),
        _found("'I06'", "'warning'", A["a26_duplicate_slides_in_source"], "'drop_slide'", "doc_id", "-1", "null", of="document"), _found("'N01'", "'info'", A["a27_short_notes"], z="null", of="conversation"), _found("'N02'", "'warning'", A["a28_talk_time"], idx="-1", z="null", of="conversation"),
    ]
)
VIEWS["fx_broken"] = _BROKEN
VIEWS["fx_found"] = "select * from fx_each where check_id = 'I01' or deck_id not in (select deck_id from fx_broken)"
VIEWS["fx_round"] = "select * from (" + "\nunion all ".join([_EDGES, _LINES, _SIZES, _HUES, _MANY]) + ") where deck_id not in (select deck_id from fx_broken)"
VIEWS["fx_snap"] = """select s.deck_id, s.slide_id, s.z, case when not (c.chars <= 5 and c.size_pt >= 1.5::double * m.med) and abs(pt - c.size_pt) <= 0.25 * c.size_pt then pt end as pt from (SIZES) s join fx_runs c using (slide_id, z) join (select slide_id, median(size_pt) as med from fx_runs group by 1) m using (slide_id)
  where s.severity <> 'info' and s.z % 5 <> 0 and 'deck/' || s.deck_id not in (select deck_id from fx_broken)""".replace("SIZES", A["a10_off_scale"].replace("pt as nearest_pt", "pt"))
VIEWS["fx_recolor"] = f"select slide_id, z, hex, nearest from ({A['a11_off_palette']}) where 'deck/' || deck_id not in (select deck_id from fx_broken)"
_REDONE = """case when c.nearest is not null then ('0x' || c.nearest[1:2])::int else s.r end as r, case when c.nearest is not null then ('0x' || c.nearest[3:4])::int else s.g end as g, case when c.nearest is not null then ('0x' || c.nearest[5:6])::int else s.b end as b, coalesce(c.nearest, s.hex) as hex, coalesce(p.pt, s.size_pt) as size_pt"""
VIEWS["fx_context2"] = f"select s.* exclude (r, g, b, hex, size_pt), {_REDONE} from fx_context s left join fx_snap p on p.slide_id = s.slide_id and p.z = s.z left join fx_recolor c on c.slide_id = s.slide_id and c.z = s.z and c.hex = s.hex"
VIEWS["fx_runs2"] = "select template_id, deck_id, slide_id, slide_idx, z, font, size_pt, hex, r, g, b, bold, chars from fx_context2 where tag = 'sp'"
VIEWS["fx_round2"] = "select * from (" + "\nunion all ".join(re.sub(r"\bfx_(context|runs)\b", r"fx_\g<1>2", x) for x in (_EDGES, _LINES, _SIZES, _HUES, _MANY)) + ") where deck_id not in (select deck_id from fx_broken)"
VIEWS["fx_judged"] = """select doc_id as slide_id, question, severity, case question when 'C05' then 'thin' else '' end as note from (select *, ['title', 'bullets', 'closing', 'cards'][doc_id % 4 + 1] as a from labels), (values ('C05', 'error'), ('C07', 'error')) q(question, severity)
  where (question = 'C05' and quality <> 1 and a not in ('title', 'closing') and doc_id % 5 <> 0) or (question = 'C07' and toxic <> 0)"""
N = "row_number() over (partition by deck_id order by slide_idx, case severity when 'error' then 1 when 'warning' then 2 else 3 end, check_id, z nulls first) as n"
P = ", ".join(PLAN)
HOW = """case when autofix in ('split_slide', 'split_table', 'change_exemplar', 'reflow_vertical', 'clamp_to_slide', 'snap_to_grid', 'crop_to_aspect', 'restore_fixed', 'reset_font') then 'replan'
  when severity = 'info' or not has then 'n/a' when autofix in ('drop_slide', 'drop_minor_series') then 'ir' else 'safe' end"""

SQL = {
    "g01_findings": f"select {P}, {N} from fx_found",
    "g01_chosen_rules": f"select {P} from fx_found where check_id like 'D%' or check_id = 'L05'",
    "g02_merged": f"""with m as (select {P} from fx_found where check_id = 'D01' union all select question, severity, 'document/' || slide_id, 0, null from fx_judged)
select {P}, {N} from m""",
    "g03_summary": """with s as (select deck_id, 'severity' as by_, severity as key, count(*) as n, count(*) filter (severity <> 'info') as serious from fx_found group by all
  union all select deck_id, 'kind', left(check_id, 1), count(*), count(*) filter (severity <> 'info') from fx_found group by deck_id, left(check_id, 1)
  union all select deck_id, 'check', check_id, count(*), count(*) filter (severity <> 'info') from fx_found group by all union all select deck_id, 'slide', slide_idx::varchar, count(*), count(*) filter (severity <> 'info') from fx_found group by all)
select deck_id, by_ as "by", key, n, serious from s where by_ <> 'slide' or serious > 0""",
    "g04_report": f"""with o as (select {P}, {N}, greatest(count(*) over (partition by deck_id) - 10, 0) as more from fx_found)
select * from o where n <= 10""",
    "g05_judged": "select * from fx_judged",
    "g06_evidence": """with u as (select source, doc_id, sum(length(text)) over (partition by source order by doc_id % 3 = 0 desc, doc_id rows unbounded preceding)::bigint as used from documents)
select * from u where used <= 60000""",
    "g07_fix_plan": f"select {P}, autofix, {HOW} as how from fx_found where autofix is not null",
    "g08_choose_fixes": f"select {P}, autofix from fx_found where autofix is not null and {HOW} = 'safe'",
    "g10_snap_sizes": f"""with f as (select slide_id, z, nearest_pt as pt from ({A["a10_off_scale"]}) where abs(size_pt - nearest_pt) <= 0.25 * size_pt), m as (select slide_id, median(size_pt) as med from fx_runs group by 1)
select deck_id, case when chars <= 5 and size_pt >= 1.5::double * med then size_pt else coalesce(pt, size_pt) end as size_pt, count(*) as n from fx_runs left join f using (slide_id, z) join m using (slide_id) group by 1, 2""",
    "g11_shrink_fonts": """with b as (select slide_id, z, (h / 12700.0::double) / (size_pt * 1.2::double * chars) as q, case coalesce(placeholder, case when chars <= 5 then 'number' when chars <= 40 then 'label' else 'body' end) when 'title' then 0.6 when 'number' then 0.8 when 'label' then 0.8 else 0.7 end::double as least, sk % 4 <> 0 as wraps from fx_shapes where tag = 'sp'),
 s as (select *, case when wraps then sqrt(q) else q end * 0.95::double as s from b where q < 1)
select slide_id, z, round_even(greatest(s, least), 4) as scale, s < least as cut from s""",
    "g12_refill": r"""with w as (select *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') as ws from fx_paras)
select doc_id, para_no, md5(case when lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) in ('title', 'text', 'subtitle', 'heading', 'body', 'caption') then '' when len(ws) > 15 and not regexp_matches(text, '^["“«]') then regexp_replace(array_to_string(ws[1:15], ' '), '[.,;:–-]+$', '') || '…' else text end) as digest from w""",
    "g13_minor_series": """with s as (select deck_id, series, row_number() over (partition by deck_id order by sum(abs(value)) desc, series) as k from fx_charts group by deck_id, series)
select c.deck_id, c.series, year, value from fx_charts c join s on s.deck_id = c.deck_id and s.series = c.series where k <= 5""",
    "g14_drop_shapes": "select deck_id, count(*) as n from fx_shapes where chars >= 5 group by 1",
    "g14_chart_labels": """with c as (select deck_id, case when deck_id % 7 = 0 then 'pie' else 'bar' end as kind, count(distinct series) as n_series, deck_id % 2 = 0 as axis_title, deck_id % 3 = 0 as labels, deck_id % 5 > 1 as legend from fx_charts group by 1),
 f as (select *, (kind <> 'pie' and not axis_title and not labels) or (n_series > 1 and not legend) as fix from c)
select deck_id, kind, n_series, axis_title, labels or fix as labels, legend or (fix and n_series > 1) as legend from f""",
    "g15_drop_slides": """with n as (select s.deck_id, slide_id, s.slide_idx, count(x.z) as blocks, count(x.z) filter (x.tag = 'sp') as texts from fx_slides s left join (select slide_id, z, tag from fx_shapes) x using (slide_id) group by all)
select deck_id, slide_id, row_number() over (partition by deck_id order by slide_idx) - 1 as slide_idx from n where not (blocks = 0 or (texts = 1 and blocks = 1))""",
    "g16_fix_effect": """with k as (select distinct check_id, deck_id, slide_idx, z from fx_round), a as (select distinct check_id, deck_id, slide_idx, z from fx_round2),
 j as (select coalesce(k.deck_id, a.deck_id) as deck_id, k.check_id is null as new_, a.check_id is null as fixed_ from k full join a on k.check_id = a.check_id and k.deck_id = a.deck_id and k.slide_idx = a.slide_idx and k.z is not distinct from a.z)
select deck_id, count(*) filter (fixed_) as fixed, count(*) filter (not fixed_ and not new_) as remaining, count(*) filter (new_) as "new" from j group by 1""",
    "g16_second_round": """with e as (select deck_id, count(*) filter (severity = 'error') as n from fx_round group by 1), e2 as (select deck_id, count(*) filter (severity = 'error') as m from fx_round2 group by 1)
select distinct check_id, deck_id, slide_idx, coalesce(z, -1) as z from fx_round2 r where exists (select 1 from fx_round q where q.check_id = r.check_id and q.deck_id = r.deck_id and q.slide_idx = r.slide_idx and q.z is not distinct from r.z) and deck_id in (select deck_id from e left join e2 using (deck_id) where n > coalesce(m, 0))""",
    "r01_statistics": r"""with i as (select outline_id, len(bullets) as items, archetype, archetype = 'kpi' and len(bullets) > 0 as kpi, archetype in ('image_text', 'image_full') and doc_id % 2 = 0 as pic, list_sum(list_transform(bullets, lambda b: len(list_filter(regexp_split_to_array(b, '\s+'), lambda x: x <> '')))) as words from fx_outline)
select outline_id, count(*) as slides, count(*) filter (items > 0) as with_items, count(*) filter (archetype = 'chart') as charts, count(*) filter (archetype = 'table') as tables, count(*) filter (kpi) as kpis, count(*) filter (pic) as pictures, round_even(sum(items)::double / nullif(count(*) filter (items > 0), 0), 4) as items_per_slide, round_even(sum(words)::double / nullif(sum(items), 0), 4) as words_per_item from i group by 1""",
    "r02_strategies": """with s as (select *, case deck_id % 3 when 0 then 'executive' when 1 then 'detailed' else 'visual' end as strategy from fx_slides), a as (select strategy, archetype, count(*) as n from s group by all),
 p as (select strategy, sum(n)::bigint as slides, string_agg(archetype, ',' order by n desc, archetype) as archetypes from a group by 1), f as (select strategy, string_agg(archetype, '>' order by slide_idx) as path from s where (strategy, deck_id) in (select (strategy, min(deck_id)) from s group by strategy) group by 1),
 v as (select strategy, count(*) filter (severity = 'error') as n_error, count(*) filter (severity = 'warning') as n_warning, count(*) filter (severity = 'info') as n_info from fx_found join (select distinct 'deck/' || deck_id as deck_id, strategy from s) using (deck_id) group by 1)
select strategy, slides, path, archetypes, coalesce(n_error, 0) as n_error, coalesce(n_warning, 0) as n_warning, coalesce(n_info, 0) as n_info from p join f using (strategy) left join v using (strategy)""",
    "r03_call_log": "select skill, model, count(*) as calls, count(*) filter (not ok) as failed, sum(tokens)::bigint as tokens, round_even(sum(seconds), 2) as seconds from fx_calls group by rollup (skill, model)",
    "r04_stress": "select case when ok then 'ok' else 'failed' end as status, model, count(*) as n, max(seconds) as slowest, grouping_id(status, model) as gid from fx_calls group by cube (status, model)",
    "r04_findings": "select check_id, count(*) as n, count(distinct deck_id) as decks from fx_found group by 1",
    "r04_slowest": "select model, skill, seconds from fx_calls order by seconds desc, ts, user_id, model, skill limit 5",
    "r05_archetypes": """with n as (select template_id, archetype, count(distinct exemplar_id) as n from fx_slots group by all)
select template_id, archetype, n, string_agg(archetype, ',') over (partition by template_id order by archetype rows between unbounded preceding and unbounded following) as available from n""",
}

QUERIES = {name: (lambda spark, sf_dir, run=run: run(Fixtures(spark, sf_dir))) for name, run in RUN.items()}
SQL = {name: with_views(sql) for name, sql in SQL.items()}
SQL["g09_snap_colors"] = f"with f as ({audit_plans.SQL['a11_off_palette']}) select deck_id, coalesce(nearest, r.hex) as hex, count(*) as n from ({with_views('select * from fx_runs')}) r left join (select slide_id, z, hex, nearest from f) f using (slide_id, z, hex) group by 1, 2"
