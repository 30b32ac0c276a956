"""One violation, the cases on either side of each threshold, and clean decks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from deckloom.functions import color, text
from deckloom.operators import audit, content, groups, layout, outline, report

W, H = 12192000, 6858000
SHAPE = "template_id long, deck_id long, slide_id long, slide_idx long, z long, tag string, x long, y long, w long, h long, size_pt double, font string, r int, g int, b int, hex string, bold boolean, chars long, kind string, text string, placeholder string"


def shapes(spark, *rows):
    base = dict(template_id=1, deck_id=1, slide_id=1, slide_idx=0, z=1, tag="sp", x=914400, y=914400, w=1000000, h=500000, size_pt=18.0, font="Arial", r=0, g=0, b=0, hex="000000", bold=False, chars=10, kind=None, text="words", placeholder=None)
    kinds = {"sp": "text", "pic": "picture", "graphicFrame": "chart"}
    rows = [{**base, **r} for r in rows]
    rows = [{**r, "kind": r["kind"] or kinds[r["tag"]]} for r in rows]
    return spark.createDataFrame([tuple({**r, "z": r["z"] if r["z"] > 1 else k + 1}[c.split()[0]] for c in SHAPE.split(", ")) for k, r in enumerate(rows)], SHAPE)


def zs(df):
    return sorted(r.z for r in df.collect())


def test_off_slide(spark):
    over = W // 100  # one per cent of the side
    s = shapes(spark, {"x": W - 1000000 + over}, {"x": W - 1000000 + over + 1}, {"x": -over - 1, "tag": "pic"}, {"y": -H // 100 + 1}, {})
    got = {r.z: r.check_id for r in audit.off_slide(s).collect()}
    assert got == {2: "L04", 3: "L01"}


def test_overlap(spark):
    a = {"x": 0, "y": 0, "w": 1000, "h": 1000}
    s = shapes(spark, a, {**a, "x": 950}, {**a, "slide_id": 2, "x": 0}, {**a, "slide_id": 2, "x": 949}, {**a, "slide_id": 3}, {**a, "slide_id": 3, "tag": "pic"}, {**a, "slide_id": 4}, {**a, "slide_id": 4})
    assert {(r.slide_id, r.z, r.other_z) for r in audit.overlaps(s).collect()} == {(2, 3, 4), (4, 7, 8)}


def test_overlap_is_symmetric(spark):
    rng = random.Random(0)
    rows = [{"slide_id": k % 7, "x": rng.randrange(5000), "y": rng.randrange(5000), "w": rng.randrange(1, 4000), "h": rng.randrange(1, 4000)} for k in range(60)]
    s = shapes(spark, *rows)
    turned = s.withColumn("z", 100 - F.col("z"))
    assert {frozenset((r.z, r.other_z)) for r in audit.overlaps(s).collect()} == {frozenset((100 - r.z, 100 - r.other_z)) for r in audit.overlaps(turned).collect()}


def test_off_grid(spark):
    guides = spark.createDataFrame([(1, 914400), (1, 5000000)], "template_id long, guide long")
    s = shapes(spark, {"x": 914400 + 91440}, {"x": 914400 + 91441}, {"x": (W - 1000000) // 2})
    got = audit.off_grid(s, guides).collect()
    assert [(r.z, r.nearest, r.delta) for r in got] == [(2, 914400, 91441)]


def test_margins(spark):
    edge = 457200 - 91440
    s = shapes(spark, {"x": edge}, {"x": edge - 1}, {"x": 0, "y": 0, "w": W, "h": H}, {"y": H - 500000 - edge + 1})
    assert {(r.z, r.side) for r in audit.in_margins(s).collect()} == {(2, "left"), (4, "bottom")}


def test_stretched(spark):
    px = lambda w, h: {"tag": "pic", "w": w, "h": h}
    s = shapes(spark, px(1029, 1000), px(1031, 1000), px(1000, 1031), px(9000, 1000)).withColumns({"px_w": F.when(F.col("z") == 4, 3).otherwise(100), "px_h": F.lit(100)})
    assert zs(audit.stretched(s)) == [2, 3]


def test_fonts(spark):
    fonts = spark.createDataFrame([(1, "ARIAL")], "template_id long, font string")
    s = shapes(spark, {}, {"font": "Other"}, {"font": "Wingdings"}, {"font": "Third", "slide_idx": 1, "slide_id": 2})
    assert {r.font for r in audit.foreign_fonts(s, fonts).collect()} == {"other", "third"}
    assert [(r.font, r.slide_idx, r.families) for r in audit.many_families(s).collect()] == [("third", 1, 3)]


def test_sizes(spark):
    scale = spark.createDataFrame([(1, 10.0), (1, 20.0)], "template_id long, pt double")
    s = shapes(spark, {"size_pt": 10.7}, {"size_pt": 10.9}, {"size_pt": 15.0}, {"size_pt": 18.5})
    assert {(r.z, r.nearest_pt) for r in audit.off_scale(s, scale).collect()} == {(2, 10.0), (3, 10.0)}


def test_colors_and_contrast(spark):
    palette = spark.createDataFrame([(1, "0077FF", 0, 119, 255)], "template_id long, hex string, r int, g int, b int")
    rgb = lambda r, g, b: {"r": r, "g": g, "b": b, "hex": f"{r:02X}{g:02X}{b:02X}"}
    s = shapes(spark, rgb(0, 119, 255), rgb(0, 60, 128), rgb(255, 80, 0), rgb(2, 2, 2))
    assert {r.hex for r in audit.off_palette(s, palette).collect()} == {"FF5000"}
    v = spark.range(1).select(color.contrast(color.luminance(*[F.lit(0)] * 3), color.luminance(*[F.lit(255)] * 3)).alias("c"), *[c.alias(n) for n, c in zip("rgb", color.channels(color.normal_hex(F.lit("#0077ffAA"))))]).head()
    assert round(v.c, 6) == 21 and (v.r, v.g, v.b) == (0, 119, 255)


def test_density(spark):
    s = shapes(spark, *[{"slide_id": 1}] * 6, *[{"slide_id": 2}] * 7, *[{"slide_id": 3, "placeholder": "title" if k == 0 else None} for k in range(7)], {"slide_id": 4}, {"slide_id": 5}, {"slide_id": 5})
    s = s.withColumns({"paras": F.when(F.col("slide_id") == 4, 7).when((F.col("slide_id") == 5) & (F.col("z") == 23), 6).otherwise(1).cast("long"), "bullet": F.col("slide_id") != 5})
    # Seven marked texts; six besides the title; seven paragraphs of one text; six paragraphs and one text without a mark.
    assert sorted((r.slide_id, r.z, r.bullets) for r in audit.many_bullets(s).collect()) == [(2, 7, 7), (4, 21, 7)]
    p = spark.createDataFrame([(1, 0, "w " * 15), (1, 1, "w " * 16), (1, 2, None)], "doc_id long, para_no long, text string")
    assert [r.para_no for r in audit.long_paragraphs(p).collect()] == [1]
    slides = spark.createDataFrame([(1, k, k, a) for k, a in enumerate(("bullets", "bullets", "bullets", "title", None, None))], "deck_id long, slide_id long, slide_idx long, archetype string")
    work = (W - 914400) * (H - 914400)
    side = lambda share: {"x": 457200, "y": 457200, "w": W - 914400, "h": int(share * (H - 914400))}
    f = shapes(spark, {**side(0.2), "slide_id": 0}, {**side(0.5), "slide_id": 1}, {**side(0.8), "slide_id": 2}, {**side(0.1), "slide_id": 3}, *[{**side(0.05), "slide_id": 4}] * 2, *[{**side(0.05), "slide_id": 5}] * 3)
    assert work > 0 and {(r.slide_id, r.fill) for r in audit.fill_ratio(f, slides).collect()} == {(0, 0.2), (2, 0.8), (5, 0.15)}  # without a plan two blocks are let be


def test_duplicates_and_notes(spark):
    d = spark.createDataFrame([(1, "g", "a1 b1 c1 d1 e1 f1 g1 h1 i1"), (2, "g", "a1 b1 c1 d1 e1 f1 g1 h1 zz"), (3, "g", "A1 b1 c1 d1 e1 f1 g1 h1 i1 j1"), (4, "g", "x1 y1"), (5, "g", "x1 y1"), (6, "k", "a1 b1 c1 d1 e1 f1 g1 h1 i1")], "doc_id long, grp string, text string")
    assert {(r.doc_id, r.other) for r in audit.duplicate_slides(d, "grp").collect()} == {(1, 3)}
    notes = spark.createDataFrame([(1, 0, "one two"), (1, 1, "one two-three four"), (2, 0, "w " * 500)], "deck_id long, slide_idx long, text string")
    assert [(r.deck_id, r.slide_idx) for r in audit.short_notes(notes).collect()] == [(1, 0)]
    assert {r.deck_id for r in audit.talk_time(notes, 4.0).collect()} == {1}


def test_clean_deck(spark):
    s = shapes(spark, {"x": 914400, "y": 914400, "w": 9000000, "h": 1500000}, {"x": 914400, "y": 2800000, "w": 9000000, "h": 1500000})
    guides = spark.createDataFrame([(1, 914400)], "template_id long, guide long")
    for found in (audit.off_slide(s), audit.overlaps(s), audit.off_grid(s, guides), audit.in_margins(s), audit.many_families(s)):
        assert found.collect() == []


def test_fix_plan(spark):
    rows = [("snap_color", "warning", {"color": "A", "nearest": "B"}), ("snap_color", "info", {"color": "A", "nearest": "B"}), ("snap_color", "error", {"color": "A"}), ("snap_color", "error", {"color": "A", "nearest": "B", "in_exemplar": "1"}), ("drop_slide", "error", {}), ("reset_font", "error", {}), ("unknown", "error", {})]
    f = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, autofix string, severity string, evidence map<string,string>")
    plan = report.fix_plan(f, report.catalogue(spark))
    assert {r.n: r.how for r in plan.collect()} == {0: "safe", 1: "n/a", 2: "n/a", 3: "template", 4: "ir", 5: "replan"}
    assert {r.n for r in report.choose_fixes(plan).collect()} == {0} and {r.n for r in report.choose_fixes(plan, "all").collect()} == {0, 4}


def test_judged(spark):
    a = '{"C01":{"ok":false,"note":"x"},"C04":{"ok":"да"},"C06":{"ok":false,"note":"N/A"},"C07":{"ok":false,"note":null}}'
    df = spark.createDataFrame([(1, "cards", a), (2, "title", a), (3, "cards", "{}"), (4, "cards", None)], "slide_id long, archetype string, answers string")
    assert {(r.slide_id, r.question) for r in report.judged(df, spark).collect()} == {(1, "C01"), (1, "C07"), (2, "C07")}


def test_unknown_rule():
    with pytest.raises(ValueError):
        report.select_rules({"L01": None}, ["X"])


def test_trimmed_notes_like_a_loop(spark):
    rng = random.Random(3)
    rows = []
    for deck in range(30):
        for slide in range(rng.randrange(1, 6)):
            rows.append((deck, slide, " ".join(" ".join(["w"] * rng.randrange(1, 9)) + "." for _ in range(rng.randrange(1, 6))), rng.randrange(3, 20)))
    want = {}
    for deck in {r[0] for r in rows}:
        own = {s: (re.split(r"(?<=[.!?])\s+", t), b) for d, s, t, b in rows if d == deck}
        limit = 1.1 * sum(b for _, b in own.values())
        count = lambda s: sum(len(x.split()) for x in own[s][0])
        while sum(map(count, own)) > limit:
            able = [s for s in own if len(own[s][0]) > 1]
            if not able:
                break
            s = max(able, key=lambda s: (count(s) / own[s][1], -s))
            own[s][0].pop()
        want |= {(deck, s): len(v[0]) for s, v in own.items()}
    df = spark.createDataFrame(rows, "deck_id long, slide_idx long, text string, budget long")
    assert {(r.deck_id, r.slide_idx): r.stay for r in content.trim_notes(df).collect()} == want


def test_text_expressions(spark):
    rows = [("1 250", 1250.0), ("−89 %", -89.0), ("×3", 3.0), ("4,5", 4.5), ("abc", None), (None, None), ("", None)]
    df = spark.createDataFrame(rows, "t string, v double")
    assert all(r.n == r.v for r in df.select("v", text.parse_number(F.col("t")).alias("n")).collect())
    s = spark.createDataFrame([("Hello, World — 2!", "hello-world-2"), ("...", "section")], "t string, v string")
    assert all(r.n == r.v for r in s.select("v", text.slug(F.col("t")).alias("n")).collect())
    w = spark.createDataFrame([("aa bb cc", 5, 2), ("aaaaaaaaaaaa", 5, 3), ("", 5, 1), ("aaaaa", 5, 1), ("a aaaaaaa a", 5, 3)], "t string, width int, v int")
    assert all(r.n == r.v for r in w.select("v", layout.wrapped_lines(F.col("t"), F.col("width")).alias("n")).collect())


def test_split_dense(spark):
    df = spark.createDataFrame([("o", 0, "bullets", "T", ["b"] * 13), ("o", 1, "agenda", "A", ["b"] * 13), ("o", 2, "bullets", "S", ["b"] * 6), ("o", 3, "bullets", "E", [])], "outline_id string, idx long, archetype string, title string, bullets array<string>")
    got = sorted((r.idx, r.part, r.title, r.n) for r in outline.split_dense(df).collect())
    assert got == [(0, 1, "T (1/3)", 5), (0, 2, "T (2/3)", 5), (0, 3, "T (3/3)", 3), (1, 1, "A", 13), (2, 1, "S", 6), (3, 1, "E", 0)]


def test_data_stay_with_the_first_part(spark):
    df = spark.createDataFrame([("o", 0, "chart", "T", ["b"] * 13, True), ("o", 1, "cards", "C", ["b"] * 7, None), ("o", 2, "chart", "D", [], True)], "outline_id string, idx long, archetype string, title string, bullets array<string>, has_data boolean")
    assert sorted((r.idx, r.part) for r in outline.split_dense(df).collect() if r.keeps_data) == [(0, 1), (2, 1)]


def test_evidence_for_a_judge(spark):
    rows = [(1, False, 10, True), (2, False, 10, False), (3, True, 10, True), (4, True, 20, False), (5, False, 60, False), (6, False, 1, None), (7, True, 5, False)]
    df = spark.createDataFrame([("g", *r) for r in rows], "grp string, id long, cited boolean, size long, has_sections boolean")
    got = {r.id: r.used for r in report.evidence(df, "grp", 50, 2).collect()}
    assert got == {3: 10, 4: 30, 7: 35, 2: 45}  # 1 has sections, 5 does not fit, and nothing after it is taken


def test_unique_ids_and_pack(spark):
    d = spark.createDataFrame([("a", 1, "x" * 6000), ("a", 2, "x" * 6000), ("a", 3, "x"), ("b", 4, "x" * 12001), ("b", 5, "x")], "source string, doc_id long, text string")
    assert {r.doc_id for r in content.pack(d, "source").collect()} == {1, 2}
    assert {r.unique_id for r in content.unique_ids(d, "source", ["doc_id"], [F.floor(F.col("doc_id") / 2)]).collect()} == {"a", "a~2", "a~3", "b", "b~2"}


def test_no_python_and_no_cartesian_plans(spark):
    from deckloom.plans import registry

    for name in ("a03_overlap", "a11_off_palette", "a26_duplicate_slides", "c08_scores", "k13_near_facts", "m02_color_clusters", "x05_best"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|BroadcastNestedLoop|EvalPython|InPandas|InArrow", plan), name


def test_prompts(spark):
    said = ["Lorem  ipsum dolor", "Заголовок", "a title of its own", "TBD", "insert photo", "Место для фото", "Имя Фамилия", "Speaker name", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(said)], "k long, t string")
    got = {r.k: (r.a, bool(r.b), bool(r.c)) for r in df.select("k", text.prompt_pattern(F.col("t")).alias("a"), text.is_photo_prompt(F.col("t")).alias("b"), text.is_speaker_prompt(F.col("t")).alias("c")).collect()}
    assert [got[k][0] for k in range(10)] == [0, -1, None, 3, 8, None, None, None, None, None]
    assert [k for k in got if got[k][1]] == [4, 5] and [k for k in got if got[k][2]] == [6, 7]
    # An example of each pattern, which holds a piece that the pattern needs.
    each = ["lorem ipsum", "xxxx", "todo", "tbd", "{{name", "[ text ]", "вставьте фото", "вставить заголовок", "insert title", "click to add", "нажмите, чтобы", "текст слайда", "заголовок слайда", "образец текста", "не забудьте удалить", "удалите эту страницу", "этот слайд можно удалить", "delete this slide"]
    df = spark.createDataFrame([(k, f"So {t.upper()} it is") for k, t in enumerate(each)], "k long, t string")
    assert [r.n for r in df.orderBy("k").select(text.prompt_pattern(F.col("t")).alias("n")).collect()] == list(range(len(text.TEXT_PROMPTS)))


def test_overflow(spark):
    box = dict(width_chars=10, size_pt=10.0, height_pt=30.0, insets_pt=2.0, gap_pt=0.0, is_title=False, autofit=False, wraps=True)
    kinds = [{}, {"height_pt": 24.0}, {"is_title": True}, {"autofit": True, "height_pt": 14.0}, {"wraps": False}, {"gap_pt": 20.0}]
    rows = [(k, *{**box, "height_pt": 14.0, **v}.values()) if v.get("is_title") else (k, *{**box, **v}.values()) for k, v in enumerate(kinds)]
    boxes = spark.createDataFrame(rows, "doc_id long, width_chars int, size_pt double, height_pt double, insets_pt double, gap_pt double, is_title boolean, autofit boolean, wraps boolean")
    paras = spark.createDataFrame([(k, t) for k in range(6) for t in (["twelve chars"] if k in (2, 4) else ["one", "two"])], "doc_id long, text string")
    got = {r.doc_id: r.severity for r in layout.overflow(paras, boxes).collect()}
    # Two lines need 24 points; 28 are there, or 22, or 12. A title may take two lines; a text that can't wrap is 2 characters too wide.
    assert got == {3: "warning", 4: "error", 5: "error"}


def test_running_totals_and_numbers_like_plain_ones(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(1, 50)) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, size long").repartition(3)
    want, number = set(), {}
    for g in ("a", "b", None):
        used = 0
        for n, (_, k, size) in enumerate([r for r in rows if r[0] == g], 1):
            used += size
            number[k] = n
            if used <= 700:
                want.add((g, k, used))
    got = {(r.g, r.k, r.used) for r in groups.before_overflow(df, ["g"], ["k"], F.col("size"), 700, [F.floor(F.col("k") / 16)]).collect()}
    assert got == want
    assert {r.k: r.n for r in groups.numbered(df, ["g"], ["k"], [F.floor(F.col("k") / 16)], "n").collect()} == number


def test_long_documents_lose_nothing_in_chunks(spark):
    rng = random.Random(12)
    docs = [(k, "\n".join("x" * rng.choice([5, 40, 300, 1100]) for _ in range(rng.randrange(1, 12)))) for k in range(20)] + [(20, ""), (21, "y" * 3000)]
    df = spark.createDataFrame([("a", k, t) for k, t in docs], "pack string, doc_id long, text string")
    got = content.chunks(df, "pack", size=1000, most=5).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.n)
    for k, t in docs:
        solid = len(t) if len(t) <= 800 else sum(len(x) for x in t.split("\n"))
        joins = 0 if len(t) <= 800 else sum(by[k]) - solid
        assert sum(by[k]) == solid + joins and 0 <= joins <= 2 * t.count("\n") and max(by[k]) <= max(800, 0)
    order = sorted(got, key=lambda r: (r.doc_id, r.piece))
    chunk, used = 0, 0
    for r in order:
        if used and used + r.n > 1000:
            chunk, used = chunk + 1, 0
        used += r.n + 2
        assert r.chunk == (chunk if chunk < 5 else None)
    assert any(r.chunk is None for r in got)


def test_facts_are_chosen_like_by_a_loop(spark):
    rng = random.Random(13)
    words = ["alpha", "bravo", "charlie", "delta", "echoes", "foxtrot", "golfer", "hotel", "indigo", "juliet"]
    facts = [(rng.choice(["a", "a", "b"]), k, " ".join(rng.sample(words, rng.randrange(2, 6))), rng.randrange(1, 4)) for k in range(120)]
    want = []
    for p in ("a", "b"):
        used, chosen = 0, []
        for _, k, t, w in sorted([f for f in facts if f[0] == p], key=lambda f: (-f[3], f[1])):
            stems = {x[:5] for x in t.split()}
            if used + len(t) <= 200 and all(len(stems & c) / min(len(stems), len(c)) < 0.6 for _, c in chosen):
                used += len(t)
                chosen.append((k, stems))
        want += [(p, k, n) for n, k in enumerate(sorted(k for k, _ in chosen), 1)]
    df = spark.createDataFrame(facts, "pack string, id long, text string, weight int")
    for step in (500, 7):  # one round, and many
        assert sorted((r.pack, r.id, r.n) for r in content.select_facts(df, 200, step=step).collect()) == sorted(want)


def test_a_budget_that_cannot_be_filled_takes_few_rounds(spark, monkeypatch):
    """A hundred thousand near-duplicates, and as many facts that are larger than what is left."""
    rounds = []
    plain = content.written
    monkeypatch.setattr(content, "written", lambda df, label: (rounds.append(label), plain(df, label))[1])
    same = F.concat(F.lit("alpha bravo charlie delta number"), F.col("id").cast("string"))
    words = F.concat_ws(" ", *[F.concat(F.lit(c), F.substring(F.md5(F.concat(F.lit(c), F.col("id").cast("string"))), 1, 5)) for c in "abcdefghijklmnop"])
    long_ = F.concat(words, F.lit(" "), F.repeat(F.lit("z"), 60))
    facts = spark.range(200000).select(F.lit("p").alias("pack"), "id", F.when(F.col("id") < 100000, same).otherwise(long_).alias("text"), F.when(F.col("id") < 100000, 3).otherwise(1).alias("weight"))
    got = content.select_facts(facts, 200).collect()
    assert [(r.id, r.n) for r in got] == [(0, 1)] and rounds.count("fact-state") < 10


SCORES = "outline_id string, idx long, template_id long, exemplar_id long, archetype string, rank long, penalty double, reserve boolean, score double"


def test_reuse_looks_at_every_candidate(spark):
    scores = [("d", i, 1, e, "cards", 0, 4.0, False, 10.0 - (0.5 * e)) for i in range(20) for e in range(9)]
    df = spark.createDataFrame(scores, SCORES)
    uses, want = {}, []
    for i in range(20):
        e = min(range(9), key=lambda e: (-(10.0 - 0.5 * e - 2.0 * min(uses.get(e, 0), 3)), e))
        uses[e] = uses.get(e, 0) + 1
        want.append((i, e))
    assert sorted((r.idx, r.exemplar_id) for r in layout.reuse_aware(df).collect()) == want and len({e for _, e in want}) > 6


def test_both_passes_like_a_loop(spark):
    """Reserves only where nothing else is possible, each pair's own penalty for a step, uses in the order of slides."""
    rng = random.Random(8)
    rows = []
    for d in range(6):
        for i in range(12):
            penalty = rng.choice([2.0, 4.0])
            rows += [(f"d{d}", i, 1, e, "x", rng.randrange(4), penalty, e < 3, rng.randrange(-20, 20) / 2) for e in range(7) if rng.random() < 0.35]
    rows += [rows[0][:5] + (3,) + rows[0][6:8] + (30.0,)]  # an exemplar at two places of the chain
    best, reuse = {}, {}
    for d in {r[0] for r in rows}:
        uses = {}
        for i in range(12):
            own = {}
            for r in rows:
                if r[0] == d and r[1] == i:
                    own[r[3]] = max(own.get(r[3], (-99, False)), (r[8] - r[6] * r[5], r[7]))
            for name, used in ((best, {}), (reuse, uses)):
                for reserves in (False, True):
                    able = [(-(v - 2 * min(used.get(e, 0), 3)), e) for e, (v, reserve) in own.items() if reserves or not reserve]
                    if able:
                        name[d, i] = min(able)[1]
                        break
            if (d, i) in reuse:
                uses[reuse[d, i]] = uses.get(reuse[d, i], 0) + 1
    df = spark.createDataFrame(rows, SCORES)
    assert {(r.outline_id, r.idx): r.exemplar_id for r in layout.best_exemplar(df).collect()} == best
    assert {(r.outline_id, r.idx): r.exemplar_id for r in layout.reuse_aware(df).collect()} == reuse
    assert best != reuse and any(e < 3 for e in best.values())


def test_chains(spark):
    strategies = spark.createDataFrame([("plain", ["cards"], "minimal"), ("other", ["two_column", "bullets"], "always")], "name string, priority array<string>, images string")
    chain = layout.full_chain(layout.fallbacks(spark), strategies).collect()
    at = lambda name, wanted, drawn: [r.archetype for r in sorted((r for r in chain if (r.name, r.wanted, r.diagram) == (name, wanted, drawn)), key=lambda r: r.rank)]
    assert at("plain", "bullets", False)[:2] == ["cards", "bullets"] and at("other", "bullets", False)[:2] == ["two_column", "bullets"]
    assert at("plain", "process", True) == list(layout.DIAGRAM_CHAIN) and at("plain", "process", False)[0] == "process"
    assert {(r.wanted in layout.FLEXIBLE, r.penalty) for r in chain} == {(True, 2.0), (False, 4.0)} and {r.images for r in chain} == {"minimal", "always"}


def test_copies_of_slides_are_paired_with_the_first(spark):
    docs = spark.createDataFrame([(k, "s", "one two three four five six" + (" seven" if k == 9 else "")) for k in range(10)] + [(10, "s", "other words that are not the same at all")], "doc_id long, source string, text string")
    got = sorted((r.doc_id, r.other, r.jaccard) for r in audit.duplicate_slides(docs, "source").collect())
    assert got == [(0, k, 1.0) for k in range(1, 9)] + [(0, 9, 0.8571)]


def test_second_round(spark):
    kind = "check_id string, severity string, deck_id long, slide_idx long, z long"
    before = spark.createDataFrame([("L01", "error", 1, 0, 1), ("T02", "warning", 1, 0, 2), ("I03", "error", 2, 0, None), ("T02", "warning", 2, 1, 1)], kind)
    after = spark.createDataFrame([("T02", "warning", 1, 0, 2), ("L02", "warning", 1, 0, 2), ("I03", "error", 2, 0, None)], kind)
    assert [(r.check_id, r.deck_id) for r in report.second_round(before, after).collect()] == [("T02", 1)]
    assert {r.deck_id: (r.fixed, r.remaining, r.new) for r in report.fix_effect(before, after).collect()} == {1: (1, 1, 1), 2: (1, 1, 0)}


def test_every_rule_names_a_known_fix(spark):
    from deckloom.plans.report import RULES
    from deckloom.sources.fixtures import Prepared

    assert len({n.split("_")[0] for n in RULES}) >= 24 and len(RULES) == 29
    known = {f[0] for f in report.FIXES}
    found = report.run_rules({k: RULES[k] for k in ("L06_margins", "T03_off_palette", "D03_large_tables", "I05_charts")}, Prepared(spark, "/root/testdata/sf0.001"))
    assert {r.autofix for r in found.select("autofix").distinct().collect()} <= known
