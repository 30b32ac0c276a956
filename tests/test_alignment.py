"""Shapes held against their exemplar, and what each rule makes of it: one violation and both sides of each threshold."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from deckloom.functions import color
from deckloom.operators import alignment, audit, layout, report

STEP, W, H = 45720, 12192000, 6858000
SHAPE = "template_id long, deck_id long, slide_id long, slide_idx long, z long, tag string, kind string, x long, y long, w long, h long, size_pt double, chars long, text string, placeholder string, content string, r int, g int, b int, hex string, bold boolean, fill_r int, fill_g int, fill_b int"
EXEMPLAR = "template_id long, exemplar_id long, ez long, kind string, x long, y long, w long, h long, size_pt double, chars long, slot_kind string, plate_w long, content string, text string, placeholder string, is_fixed boolean, photo_prompt boolean"
KIND = {"sp": "text", "pic": "picture", "graphicFrame": "chart"}


def rows(spark, schema, base, given):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple({**base, **g}[n] for n in names) for g in given], schema)


def shapes(spark, *given):
    base = dict(template_id=1, deck_id=1, slide_id=1, slide_idx=0, z=1, tag="sp", x=900000, y=900000, w=1000000, h=500000, size_pt=18.0, chars=10, text="ours", placeholder=None, content="ours", r=0, g=0, b=0, hex="000000", bold=False, fill_r=None, fill_g=None, fill_b=None)
    full = [{**base, "z": k + 1, **g} for k, g in enumerate(given)]
    return rows(spark, SHAPE, base, [{**g, "kind": g.get("kind") or KIND[g["tag"]]} for g in full])


def exemplars(spark, *given):
    base = dict(template_id=1, exemplar_id=100, ez=1, kind="text", x=900000, y=900000, w=1000000, h=500000, size_pt=18.0, chars=10, slot_kind="body", plate_w=0, content="theirs", text="theirs", placeholder=None, is_fixed=False, photo_prompt=False)
    return rows(spark, EXEMPLAR, base, [{"ez": k + 1, **g} for k, g in enumerate(given)])


def plan(spark, *slides):
    return spark.createDataFrame([(1, 1, s, s - 1, 100) for s in slides or (1,)], "template_id long, deck_id long, slide_id long, slide_idx long, exemplar_id long")


def fixed(spark, *boxes):
    return spark.createDataFrame([(1, *b) for b in boxes], "template_id long, bx long, by long, bw long, bh long")


def context(spark, own, theirs, slides=(1,), boxes=()):
    return alignment.in_context(shapes(spark, *own), plan(spark, *slides), exemplars(spark, *theirs), fixed(spark, *boxes))


def test_matches_like_a_greedy_loop(spark):
    rng = random.Random(4)
    own, theirs = [], []
    for s in range(1, 12):
        own += [{"slide_id": s, "z": z, "tag": rng.choice(list(KIND)), **{c: rng.randrange(6) for c in "xywh"}} for z in range(rng.randrange(1, 8))]
    theirs = [{"ez": e, "kind": rng.choice(["text", "picture", "chart"]), **{c: rng.randrange(6) for c in "xywh"}} for e in range(7)]
    got = {(r.slide_id, r.z): r.slot.ez if r.slot else None for r in context(spark, own, theirs, range(1, 12)).collect()}
    for s in range(1, 12):
        mine = [o for o in own if o["slide_id"] == s]
        pairs = sorted((sum(abs(o[c] - e[c]) for c in "xywh"), o["z"], e["ez"]) for o, e in itertools.product(mine, theirs) if KIND[o["tag"]] == e["kind"])
        used, want = set(), {}
        for _, z, e in pairs:
            if ("z", z) not in used and ("e", e) not in used:
                used |= {("z", z), ("e", e)}
                want[z] = e
        assert {o["z"]: got[s, o["z"]] for o in mine} == {o["z"]: want.get(o["z"]) for o in mine}


def test_provenance(spark):
    there = {"x": 0, "y": 0, "w": 10 * STEP, "h": 10 * STEP}
    theirs = [{**there, "is_fixed": True}, {"x": 3000000}, {"x": 6000000, "content": "other"}, {"x": 9000000, "kind": "picture", "content": "photo"}]
    own = [there, {"x": 3000000}, {"x": 6000000, "content": "other"}, {"x": 9000000, "tag": "pic", "content": "photo"}, {"x": 1, "tag": "graphicFrame"}, {"slide_id": 2, **there}, {"slide_id": 2, **there, "x": STEP + 1}, {"slide_id": 2, "text": " "}, {"slide_id": 2, "placeholder": "ftr"}]
    got = {r.z: (r.is_slot, r.is_fixed, r.is_ours, r.is_decor, r.is_content) for r in context(spark, own, theirs, (1,), [(0, 0, 10, 10)]).collect()}
    assert got[1] == (False, True, False, False, False)  # in the place of a fixed shape
    assert got[2] == (True, False, True, False, True) and got[3] == (True, False, False, False, True)  # a slot with our text, and as it was
    assert got[4] == (True, False, False, False, True) and got[5] == (False, False, True, False, True)  # the template's photo; not in the exemplar
    assert got[6][1:3] == (True, False) and got[7][1:3] == (False, True)  # no plan: a step away, and more
    assert not got[8][4] and not got[9][4]


def test_inherited_geometry(spark):
    theirs = [{"x": 1000000}, {"x": 4000000, "plate_w": 300000}, {"x": 6000000, "y": 3000000, "w": 3000000, "h": 2000000, "kind": "chart", "slot_kind": "chart"}]
    own = [{"x": 1000000 + STEP}, {"x": 1000000 + STEP + 1}, {"x": 4000000, "w": 1300000}, {"x": 4000000, "w": 1300001}, {"x": 6500000, "y": 3500000}, {"x": 6000000 - STEP - 1, "y": 3500000}]
    got = context(spark, own, theirs).where("inherited").collect()
    assert sorted(r.z for r in got) == [1, 3, 5]


def test_off_slide_is_milder_where_it_is_inherited(spark):
    over = {"x": W - 500000}
    got = {r.z: r.severity for r in audit.off_slide(context(spark, [over, {**over, "y": 4000000}], [over])).collect()}
    assert got == {1: "warning", 2: "error"}
    assert {r.severity for r in audit.off_slide(shapes(spark, over)).collect()} == {"error"}


@pytest.mark.parametrize(("chars", "filled", "want"), [(10, None, "warning"), (10, 200, "warning"), (400, None, "warning"), (400, 200, "error")])
def test_overlap_that_the_exemplar_has(spark, chars, filled, want):
    """A warning, unless more lines than the exemplar's reach a block that is more than text."""
    theirs = [{"x": 0, "y": 0, "w": 2000000, "h": 1000000}, {"x": 0, "y": 900000, "w": 2000000, "h": 1000000}]
    own = [{**theirs[0], "chars": chars}, {**theirs[1], "fill_r": filled, "fill_g": filled, "fill_b": filled}]
    assert [r.severity for r in audit.overlaps(context(spark, own, theirs)).collect()] == [want]


def test_overlap_that_the_exemplar_lacks(spark):
    theirs = [{"x": 0, "y": 0, "w": 2000000, "h": 1000000}, {"x": 0, "y": 960000, "w": 2000000, "h": 1000000}]
    own = [theirs[0], {**theirs[1], "y": 949999}]
    assert [r.severity for r in audit.overlaps(context(spark, own, theirs)).collect()] == ["error"]  # 4 per cent in the exemplar, 5 here


def test_lines_that_the_exemplar_has_are_let_off(spark):
    block = {"tag": "graphicFrame", "y": 2000000, "h": 300000}
    text = {"y": 900000, "h": 600000, "size_pt": 18.0}
    lines = lambda n: {**text, "chars": 8 * n}  # noqa: E731  (eight characters a line, 274320 high)
    found = lambda own, theirs: [(r.z, r.line) for r in layout.lines_over_blocks(context(spark, [own, block], [theirs, {**block, "kind": "chart", "slot_kind": "chart"}])).collect()]
    drop = lambda r: {k: v for k, v in r.items() if k != "tag"}
    assert found(lines(5), drop({**text, "chars": 8})) == [(1, 5)]
    assert found(lines(4), drop({**text, "chars": 8})) == []
    assert found(lines(5), drop({**text, "chars": 40})) == []  # five lines there as well
    assert found(lines(9), drop({**text, "chars": 64})) == []  # the ninth lies below the block


def test_off_grid_asks_for_our_own_places(spark):
    guides = spark.createDataFrame([(1, 900000)], "template_id long, guide long")
    theirs = [{"x": 1100000}, {"x": 3000000, "y": 3000000, "is_fixed": True}]
    own = [{"x": 1100000 + STEP}, {"x": 3000000, "y": 3000000}, {"x": 1100000 + STEP + 1, "y": 5000000}]
    assert [r.z for r in audit.off_grid(context(spark, own, theirs), guides).collect()] == [3]


def test_stretched_pictures(spark):
    px = {"tag": "pic", "w": 1000000, "h": 500000}
    theirs = [{"kind": "picture", "content": "photo", "w": 1000000}, {"kind": "picture", "x": 5000000, "is_fixed": True}, {"kind": "picture", "x": 8000000, "content": "old"}]
    own = [{**px, "content": "photo"}, {**px, "x": 5000000}, {**px, "x": 8000000, "content": "new"}]
    s = context(spark, own, theirs).withColumns({"px_w": F.lit(100), "px_h": F.lit(100)})
    assert {r.z: r.severity for r in audit.stretched(s).collect()} == {1: "warning", 3: "error"}  # decor is left out


def test_sizes_of_slots(spark):
    scale = spark.createDataFrame([(1, 40.0)], "template_id long, pt double")
    sizes = [20.0, 21.5, 21.7, 14.0, 13.9, 39.0]
    theirs = [{"x": 1000000 * k, "size_pt": 20.0} for k in range(6)]
    own = [{"x": 1000000 * k, "size_pt": v} for k, v in enumerate(sizes)]
    got = {r.size_pt: r.severity for r in audit.off_scale(context(spark, own, theirs), scale).collect()}
    assert got == {21.7: "warning", 14.0: "info", 13.9: "warning"}


def test_lost_fixed(spark):
    logo = {"x": 0, "y": 0, "w": 20 * STEP, "h": 10 * STEP, "kind": "picture", "is_fixed": True}
    drop = lambda r, **k: {**{c: v for c, v in r.items() if c in "xywh"}, "tag": "pic", **k}
    card = {"x": 2000000, "y": 2000000, "w": 3000000, "h": 2000000}
    theirs = [
        logo, {**logo, "x": 60 * STEP, "kind": "text", "y": 3000000, "text": "caption"}, {**logo, "x": 90 * STEP, "kind": "text", "text": " ", "placeholder": "ftr"},
        {"x": 7000000, "y": 3000000, "text": "insert photo", "photo_prompt": True}, {**logo, "x": 6900000, "y": 2900000, "w": 1200000, "h": 700000},
        {**card, "kind": "chart"}, {**logo, "x": 2100000, "y": 2100000, "w": 500000, "h": 500000}, {**logo, "x": 9000000, "y": 5000000, "plate_w": 300000},
    ]
    plate, decor, there = drop(theirs[7]), drop(theirs[6]), [drop(logo)]
    own = [
        *[{**r, "slide_id": 1} for r in (*there, plate, decor)],
        *[{**r, "slide_id": 2} for r in (drop(logo, x=STEP), plate, decor)], *[{**r, "slide_id": 3} for r in (drop(logo, x=STEP + 1), plate, decor)],
        *[{**r, "slide_id": 4} for r in (*there, {**plate, "w": 20 * STEP + 300000 + STEP}, decor)], *[{**r, "slide_id": 5} for r in (*there, {**plate, "w": 20 * STEP + 300001 + STEP}, decor)],
        *[{**r, "slide_id": 6} for r in (*there, plate)], *[{**r, "slide_id": 7} for r in (*there, plate, {**card, "tag": "graphicFrame"})], {"slide_id": 8, "tag": "sp"},
    ]
    own = [{**r, "z": k + 1} for k, r in enumerate(own)]
    slides = tuple(range(1, 10))
    s = context(spark, own, theirs, slides)
    got = {}
    for r in alignment.lost_fixed(plan(spark, *slides), exemplars(spark, *theirs), s).collect():
        got.setdefault(r.slide_id, set()).add((r.ez, r.how))
    # A card that is not there takes its decor with it (6); one that is does not (7). A slide may lack all (8 has a text, 9 nothing).
    assert got == {3: {(1, "moved")}, 5: {(8, "moved")}, 7: {(7, "removed")}, 8: {(1, "removed"), (8, "removed")}, 9: {(1, "removed"), (8, "removed")}}


def test_displaced_fixed(spark):
    elements = spark.createDataFrame([(1, "logo", 0, 0, 20, 10), (1, "footer", 100, 140, 30, 5), (1, "decoration", 5, 5, 5, 5)], "template_id long, kind string, bx long, by long, bw long, bh long")
    logo = {"tag": "pic", "x": 0, "y": 0, "w": 20 * STEP, "h": 10 * STEP}
    own = [{**logo, "x": STEP}, {**logo, "slide_id": 2, "x": STEP + 1}, {**logo, "slide_id": 3, "tag": "sp", "x": 500000}, {"slide_id": 4, "x": 0, "y": 0, "w": 31 * STEP, "h": 5 * STEP}]
    slides = plan(spark, 1, 2, 3, 4).drop("exemplar_id")
    assert sorted((r.slide_id, r.z, r.expected_x) for r in alignment.displaced_fixed(slides, elements, shapes(spark, *own)).collect()) == [(2, 2, 0), (4, 4, 100 * STEP)]


def test_contrast_by_layers(spark):
    grey = lambda v: {"r": v, "g": v, "b": v, "hex": f"{v:02X}" * 3}
    fill = lambda v: {"fill_r": v, "fill_g": v, "fill_b": v}
    big = {"x": 0, "y": 0, "w": 5000000, "h": 5000000}
    own = [
        {**grey(118), "slide_id": 1}, {**grey(119), "slide_id": 2}, {**grey(119), "slide_id": 3, "size_pt": 24.0}, {**grey(119), "slide_id": 4, "size_pt": 18.7, "bold": True},  # 4.54 and 4.48 to white
        {**big, "slide_id": 5, "tag": "graphicFrame", **fill(10)}, {**grey(250), "slide_id": 5}, {**grey(20), "slide_id": 5, "x": 2000000},
        {**big, "slide_id": 6, "tag": "graphicFrame", **fill(10)}, {**grey(20), "slide_id": 6, **fill(255)}, {**big, "slide_id": 7, "tag": "pic"}, {**grey(250), "slide_id": 7},
        {**grey(250), "slide_id": 9}, {**big, "slide_id": 10}, {**grey(10), "slide_id": 10}, {**grey(10), "slide_id": 11}, {**grey(200), "slide_id": 12},
    ]
    s = shapes(spark, *own)
    runs = s.where("tag = 'sp'").select("slide_id", "z", F.lit(0).alias("run"), "r", "g", "b", "size_pt", "bold")
    runs = runs.unionByName(runs.where("slide_id = 11").withColumns({"run": F.lit(1), "r": F.lit(230), "g": F.lit(230), "b": F.lit(230)}))
    backs = spark.createDataFrame([(k, 1, *([None if k == 9 else 255] * 3)) for k in range(1, 13)], "slide_id long, template_id long, back_r int, back_g int, back_b int")
    palette = spark.createDataFrame([(1, 200, 200, 200)], "template_id long, r int, g int, b int")
    got = {(r.slide_id, r.z): (r.under_z, r.run, r.severity) for r in audit.low_contrast(s, runs, backs, palette).collect()}
    # Own fill first (6), then the layer below (5), an unfilled text is none (10), a picture is unknown (7, 9), the worst run
    # counts (11), and the template's own colours are only a warning (12).
    assert got == {(2, 2): (None, 0, "error"), (5, 7): (5, 0, "error"), (11, 15): (None, 1, "error"), (12, 16): (None, 0, "warning")}
    assert [round(color_ratio(spark, v), 2) for v in (118, 119)] == [4.54, 4.48]


def color_ratio(spark, v):
    lum = lambda c: color.luminance(*[F.lit(c)] * 3)
    return spark.range(1).select(color.contrast(lum(v), lum(255)).alias("c")).head().c


def test_prompts_left(spark):
    own = [{"text": "Lorem ipsum"}, {"text": "title"}, {"text": " "}, {"text": " ", "placeholder": "body"}, {"text": "a title"}, {"text": "Insert photo", "content": "theirs"}]
    got = {r.z: (r.pattern_no, r.severity) for r in audit.prompts_left(shapes(spark, *own)).collect()}
    assert got == {1: (-100, "error"), 2: (-1, "error"), 4: (-200, "warning"), 6: (-92, "error")}


def test_broken_decks_have_no_other_findings(spark):
    found = lambda check, *decks: lambda _: spark.createDataFrame([(check, d) for d in decks], "check_id string, deck_id string")
    rules = {"I01_parts": found("I01", "deck/1"), "L01_x": found("L01", "deck/1", "deck/2"), "T01_x": found("T01", "document/1")}
    got = lambda **k: sorted((r.check_id, r.deck_id) for r in report.run_rules(rules, None, broken="I01", **k).collect())
    assert got() == [("I01", "deck/1"), ("L01", "deck/2"), ("T01", "document/1")]
    assert got(chosen=["L"]) == [("L01", "deck/2")]
