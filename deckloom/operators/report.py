"""Findings put together: order, merge, summary, report, judged answers, fixes and their effect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import written
from . import groups

SEVERITIES = ("error", "warning", "info")
#: Fixed values: (name, scope, safe, evidence that it needs).
FIXES = (
    ("shrink_font_by_scale", "ir", True, ("need_pt", "have_pt")), ("snap_font_size", "ir", True, ("size_pt", "nearest_pt")), ("snap_color", "ir", True, ("color", "nearest")),
    ("refill_slot", "ir", True, ()), ("add_chart_labels", "ir", True, ()), ("drop_shape", "ir", True, ()), ("drop_slide", "ir", False, ()), ("drop_minor_series", "ir", False, ()),
    ("split_slide", "replan", False, ()), ("split_table", "replan", False, ()), ("change_exemplar", "replan", False, ()), ("reflow_vertical", "replan", False, ()), ("clamp_to_slide", "replan", False, ()),
    ("snap_to_grid", "replan", False, ()), ("crop_to_aspect", "replan", False, ()), ("restore_fixed", "replan", False, ()), ("reset_font", "replan", False, ()),
)
#: Fixed values: (question, severity, whether structural slides skip it).
QUESTIONS = (
    ("C01", "warning", True), ("C02", "error", True), ("C03", "warning", True), ("C04", "error", False), ("C05", "error", True), ("C06", "warning", False),
    ("C07", "error", False), ("C08", "warning", False), ("C09", "warning", False), ("C10", "info", False), ("C11", "warning", True),
)
STRUCTURAL = ("title", "section", "closing")


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c)


def select_rules(rules: dict, chosen: list[str] | None = None) -> list[str]:
    """Names of rules (name -> function) picked by full name or beginning; all by default. The others are never planned."""
    names = [n for n in rules if not chosen or any(n.startswith(c) for c in chosen)]
    if not names:
        raise ValueError(f"no rule is called {chosen}")
    return names


def run_rules(rules: dict, tables, chosen: list[str] | None = None, broken: str | None = None) -> DataFrame:
    """Findings of the chosen rules (functions from ``tables`` to findings) as one plan.

    ``broken`` is the beginning of the rules that say that a deck can't be read: such a deck has their findings alone, also
    when they were not chosen.
    """
    found, stop = None, None
    stops = {n: written(rules[n](tables), "stops") for n in select_rules(rules, [broken])} if broken else {}  # looked at twice
    for n in select_rules(rules, chosen):
        own = stops[n] if n in stops else rules[n](tables)
        found = own if found is None else found.unionByName(own)
    if not broken:
        return found
    for n in stops:
        own = stops[n].select("deck_id")
        stop = own if stop is None else stop.unionByName(own)
    stop = written(stop.distinct(), "broken-decks")  # its size is known: only if they are many are all findings dealt out by deck
    kept = found.where(~F.col("check_id").startswith(broken)).join(stop, "deck_id", "left_anti")
    return kept.select(*found.columns).unionByName(found.where(F.col("check_id").startswith(broken)))


def ordered(findings: DataFrame) -> DataFrame:
    """With ``n``, the place within the deck by slide, severity, check and element."""
    w = W.partitionBy("deck_id").orderBy("slide_idx", severity_rank(F.col("severity")), "check_id", F.col("z").asc_nulls_first())
    return findings.withColumn("n", F.row_number().over(w))


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity, by kind (the letter of the check), by check and by slide with findings that are more than
    notes. Findings move once to their deck, where one task
    counts them before they are told in four ways."""
    each = findings.select("deck_id", "slide_idx", "severity", "check_id").repartition("deck_id").groupBy("deck_id", "slide_idx", "severity", "check_id").agg(F.count("*").alias("k"))
    serious = F.col("severity") != "info"
    by = lambda name, key: F.struct(F.lit(name).alias("by"), key.alias("key"))
    sets = F.array(by("severity", F.col("severity")), by("kind", F.substring("check_id", 1, 1)), by("check", F.col("check_id")), by("slide", F.col("slide_idx").cast("string")))
    told = each.select("deck_id", "k", F.when(serious, F.col("k")).otherwise(0).alias("s"), F.inline(sets))
    found = told.groupBy("deck_id", "by", "key").agg(F.sum("k").alias("n"), F.sum("s").alias("serious"))
    return found.where("by <> 'slide' or serious > 0")


def report(findings: DataFrame, limit: int = 80) -> DataFrame:
    """The first rows of each deck, each with how many more there are."""
    total = F.count("*").over(W.partitionBy("deck_id"))
    return ordered(findings).withColumn("more", F.greatest(total - limit, F.lit(0))).where(F.col("n") <= limit)


def judged(answers: DataFrame, spark: SparkSession) -> DataFrame:
    """Findings from recorded answers (slide_id, archetype, answers as JSON text {"C01": {"ok": …, "note": …}}).

    A missing answer passes, and so do true, "true", "yes", "да" and the note "n/a"; structural slides skip five questions.
    """
    q = spark.createDataFrame(QUESTIONS, "question string, severity string, skipped boolean")
    each = answers.crossJoin(F.broadcast(q)).where(~(F.col("skipped") & F.col("archetype").isin(*STRUCTURAL)))  # eleven rows
    one = F.from_json("answers", "map<string,struct<ok:string,note:string>>")[F.col("question")]
    each = each.withColumn("one", one).where("one is not null")
    note = F.trim(F.coalesce("one.note", F.lit("")))
    passed = F.lower(F.trim(F.coalesce("one.ok", F.lit("")))).isin("true", "yes", "да") | (F.lower(note) == "n/a")
    return each.where(~passed).select("slide_id", "question", "severity", note.alias("note"))


def evidence(fragments: DataFrame, group: str, limit: int = 6000, bucket: int = 1024) -> DataFrame:
    """Fragments (group, id, cited, size) that go before a judge, with ``used`` characters so far: cited ones first, then
    the rest by id, up to the first that does not fit. If there is a mark ``has_sections``, a whole document that has it is left
    out unless it is cited, as its sections, which are fragments too, stand for it."""
    asked = fragments.where(F.col("cited") | ~F.coalesce("has_sections", F.lit(False))) if "has_sections" in fragments.columns else fragments
    return groups.before_overflow(asked, [group], [F.desc("cited"), "id"], F.col("size"), limit, [~F.col("cited"), F.floor(F.col("id") / bucket)]).select(group, "id", "used")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXES, "autofix string, scope string, safe boolean, requires array<string>")


def fix_plan(findings: DataFrame, fixes: DataFrame) -> DataFrame:
    """How each finding with a known fix can be fixed: template, replan, n/a, safe or ir."""
    has = F.forall("requires", lambda k: ~F.coalesce(F.col("evidence")[k], F.lit("")).isin("", "0"))
    how = (
        F.when(F.coalesce(F.col("evidence")["in_exemplar"], F.lit("")) != "", "template").when(F.col("scope") != "ir", F.col("scope")).when((F.col("severity") == "info") | ~has, "n/a").when(F.col("safe"), "safe").otherwise("ir")
    )
    return findings.join(F.broadcast(fixes), "autofix").withColumn("how", how).drop("scope", "safe", "requires")  # seventeen rows


def choose_fixes(plan: DataFrame, mode: str = "safe", numbers: DataFrame | None = None) -> DataFrame:
    """The safe ones, all that can be applied, or those whose (deck_id, n) are given."""
    if numbers is not None:
        return plan.where("how in ('safe', 'ir')").join(numbers, ["deck_id", "n"], "left_semi")
    return plan.where("how = 'safe'" if mode == "safe" else "how in ('safe', 'ir')")


def snap_colors(runs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Runs with their colours replaced by the nearest, where a fix (slide_id, z, hex, nearest) was chosen."""
    mine = lambda c: (c["z"] == F.col("z")) & (c["hex"] == F.col("hex"))
    return _with_fixes(runs, chosen.select("slide_id", "z", "hex", "nearest"), mine, "nearest").withColumn("hex", F.coalesce("nearest", "hex")).drop("nearest")


def _with_fixes(runs: DataFrame, fixes: DataFrame, mine: Callable[[Column], Column], value: str) -> DataFrame:
    """``runs`` with the ``value`` of each distinct fix that is ``mine``, null without one. A slide's fixes meet its runs as an
    array, so runs need to be dealt out by slide alone."""
    by_slide = fixes.distinct().groupBy("slide_id").agg(F.collect_list(F.struct(*[c for c in fixes.columns if c != "slide_id"])).alias("fixes"))  # bounded: one slide's
    found = runs.join(by_slide.hint("merge"), "slide_id", "left")
    return found.withColumn(value, F.explode_outer(F.transform(F.filter("fixes", mine), lambda c: c[value]))).drop("fixes")


def snap_sizes(runs: DataFrame, chosen: DataFrame, most: float = 0.25, number_chars: int = 5) -> DataFrame:
    """Runs with the nearest size of the scale, unless it is off by more than a quarter or the run is a key number (a
    text of few characters that is half as large again as its slide's median)."""
    near = chosen.where(F.abs(F.col("nearest_pt") - F.col("size_pt")) <= most * F.col("size_pt")).select("slide_id", "z", "nearest_pt")
    median = runs.groupBy("slide_id").agg(F.median("size_pt").alias("median"))
    number = (F.col("chars") <= number_chars) & (F.col("size_pt") >= 1.5 * F.col("median"))
    found = _with_fixes(runs, near, lambda c: c["z"] == F.col("z"), "nearest_pt").join(median.hint("merge"), "slide_id")
    return found.withColumn("size_pt", F.when(number, F.col("size_pt")).otherwise(F.coalesce("nearest_pt", "size_pt"))).drop("nearest_pt", "median")


#: The least scale of a slot's text by kind.
SCALE_FLOORS = {"title": 0.6, "number": 0.8, "label": 0.8}


def shrink_fonts(boxes: DataFrame, floor: float = 0.7) -> DataFrame:
    """The scale for texts that need more room than there is, with a floor for each kind of slot.

    Height falls with the square of the size, so its scale is sqrt(have / need) * 0.95; a text that may not wrap needs width
    and shrinks in proportion (``wraps`` false). At the floor the text has to be cut as well.
    """
    least = F.coalesce(*[F.when(F.col("slot_kind") == k, v) for k, v in SCALE_FLOORS.items()], F.lit(floor))
    share = F.col("have_pt") / F.col("need_pt")
    scale = F.when(F.col("wraps"), F.sqrt(share)).otherwise(share) * 0.95
    return boxes.where("need_pt > have_pt").withColumns({"scale": F.bround(F.greatest(scale, least), 4), "cut": scale < least})


def refill(paras: DataFrame, most: int = 15) -> DataFrame:
    """Paragraphs cut to ``most`` words, an ellipsis behind the cut; quotes are kept, texts that are prompts emptied."""
    w = text.words(F.col("text"))
    quote = F.col("text").rlike("^[\"“«]")
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(w, 1, most), " "), r"[.,;:–-]+$", ""), F.lit("…"))
    prompt = text.prompt_pattern(F.col("text")).isNotNull()
    return paras.withColumn("text", F.when(prompt, F.lit("")).when(~quote & (F.size(w) > most), cut).otherwise(F.col("text")))


def drop_minor_series(charts: DataFrame, keep: int = 5) -> DataFrame:
    """The points (deck_id, series, year, value) of a chart's series with the largest sums of absolute values."""
    s = charts.groupBy("deck_id", "series").agg(F.sum(F.abs("value")).alias("total"))
    top = s.withColumn("k", F.row_number().over(W.partitionBy("deck_id").orderBy(F.desc("total"), "series"))).where(F.col("k") <= keep)
    return charts.join(top.select("deck_id", "series"), ["deck_id", "series"], "left_semi")


def drop_shapes(shapes: DataFrame, chosen: DataFrame) -> DataFrame:
    """Shapes without the chosen ones (slide_id, z)."""
    return shapes.join(chosen.select("slide_id", "z").distinct(), ["slide_id", "z"], "left_anti")


def add_chart_labels(charts: DataFrame, chosen: DataFrame) -> DataFrame:
    """Charts (deck_id, kind, n_series, axis_title, labels, legend) with data labels, and a legend for more than one series,
    where a fix (deck_id) was chosen."""
    found = charts.join(chosen.select("deck_id").distinct().withColumn("fix", F.lit(True)), "deck_id", "left")
    fix = F.coalesce("fix", F.lit(False))
    return found.withColumns({"labels": F.col("labels") | fix, "legend": F.col("legend") | (fix & (F.col("n_series") > 1))}).drop("fix")


def drop_slides(slides: DataFrame, chosen: DataFrame) -> DataFrame:
    """Slides without the chosen ones (slide_id), numbered anew."""
    left = slides.join(chosen.select("slide_id").distinct(), "slide_id", "left_anti")
    return left.withColumn("slide_idx", (F.row_number().over(W.partitionBy("deck_id").orderBy("slide_idx")) - 1).cast("long"))


KEYS = ("check_id", "deck_id", "slide_idx", "z")


def _keyed(findings: DataFrame) -> DataFrame:
    return findings.select("check_id", "deck_id", "slide_idx", F.coalesce("z", F.lit(-1)).alias("z")).distinct()


def fix_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each (check, slide, element): fixed, remaining or new."""
    a, b = _keyed(before).withColumn("was", F.lit(1)), _keyed(after).withColumn("is_now", F.lit(1))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is_now").isNull(), "fixed").otherwise("remaining")
    found = a.join(b, list(KEYS), "full_outer").withColumn("state", state)
    return found.groupBy("deck_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("fixed", "remaining", "new")])


def second_round(before: DataFrame, after: DataFrame) -> DataFrame:
    """The findings worth a second round: those of before that remain, in decks whose errors fell."""
    errors = lambda df, name: df.groupBy("deck_id").agg(F.count_if(F.col("severity") == "error").alias(name))
    fell = errors(before, "was").join(errors(after, "is_now"), "deck_id", "left").where(F.col("was") > F.coalesce("is_now", F.lit(0))).select("deck_id")
    return _keyed(after).join(_keyed(before), list(KEYS), "left_semi").join(fell, "deck_id", "left_semi").select(*KEYS)


def deck_statistics(outline: DataFrame) -> DataFrame:
    """Slides, items per slide with items, words per item, and how many slides have a chart, a table, key numbers and a
    picture. ``outline`` has has_chart, table_cols, n_kpis and has_image besides its bullets."""
    n = F.size("bullets")
    words = F.aggregate("bullets", F.lit(0), lambda acc, b: acc + F.size(text.words(b)))
    has = {"charts": F.col("has_chart"), "tables": F.col("table_cols") > 0, "kpis": F.col("n_kpis") > 0, "pictures": F.col("has_image")}
    each = outline.select("outline_id", n.alias("items"), words.alias("words"), *[F.coalesce(v, F.lit(False)).alias(k) for k, v in has.items()])
    counts = [F.count_if(k).alias(k) for k in has]
    found = each.groupBy("outline_id").agg(F.count("*").alias("slides"), F.count_if(F.col("items") > 0).alias("with_items"), F.sum("items").alias("items"), F.sum("words").alias("words"), *counts)
    per = lambda a, b: F.bround(F.col(a) / F.nullif(b, F.lit(0)), 4)
    return found.select("outline_id", "slides", "with_items", *has, per("items", "with_items").alias("items_per_slide"), per("words", "items").alias("words_per_item"))


def strategy_comparison(slides: DataFrame, findings: DataFrame, strategy: Column) -> DataFrame:
    """A row per strategy: its slides, the path of archetypes of its first deck, slide by slide, its archetypes in order
    of frequency and its findings by severity."""
    s = slides.withColumn("strategy", strategy)
    arch = s.groupBy("strategy", "archetype").agg(F.count("*").alias("n"))
    names = arch.groupBy("strategy").agg(F.sum("n").alias("slides"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "archetype"))), lambda x: x["archetype"]), ",").alias("archetypes"))  # 16 names
    first = s.join(s.groupBy("strategy").agg(F.min("deck_id").alias("deck_id")), ["strategy", "deck_id"])
    path = first.groupBy("strategy").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slide_idx", "archetype"))), lambda x: x["archetype"]), ">").alias("path"))  # one deck
    sev = findings.join(s.select("deck_id", "strategy").distinct(), "deck_id").groupBy("strategy").pivot("severity", list(SEVERITIES)).count()
    return names.join(path, "strategy").join(sev, "strategy", "left").select("strategy", "slides", "path", "archetypes", *[F.coalesce(c, F.lit(0)).alias(f"n_{c}") for c in SEVERITIES])


def call_log(calls: DataFrame) -> DataFrame:
    """Calls, failures, tokens and seconds by skill and model, by skill, and in all."""
    return calls.rollup("skill", "model").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum("tokens").alias("tokens"), F.bround(F.sum("seconds"), 2).alias("seconds"))


def stress_report(calls: DataFrame) -> DataFrame:
    """Counts by status and model in all combinations, each with its slowest time."""
    status = F.when(F.col("ok"), "ok").otherwise("failed")
    c = calls.withColumn("status", status)
    return c.cube("status", "model").agg(F.count("*").alias("n"), F.max("seconds").alias("slowest"), F.grouping_id().alias("gid"))


def stress_findings(findings: DataFrame) -> DataFrame:
    """Findings by check over all decks, and how many decks have them."""
    return findings.groupBy("check_id").agg(F.count("*").alias("n"), F.countDistinct("deck_id").alias("decks"))


def slowest_calls(calls: DataFrame, n: int = 5) -> DataFrame:
    """The slowest calls of all, ties by time."""
    return calls.orderBy(F.desc("seconds"), "ts", "user_id", "model", "skill").limit(n).select("model", "skill", "seconds")


def archetype_counts(exemplars: DataFrame) -> DataFrame:
    """Exemplars by archetype and the archetypes a template has."""
    n = exemplars.groupBy("template_id", "archetype").agg(F.countDistinct("exemplar_id").alias("n"))
    return n.withColumn("available", F.array_join(F.array_sort(F.collect_set("archetype").over(W.partitionBy("template_id"))), ","))
