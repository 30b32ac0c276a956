"""Repairs of outlines against plain versions."""

import random

from pyspark.sql import functions as F

from deckloom.operators import outline

SLIDE = "outline_id string, idx long, archetype string, n_bullets int, n_kpis int, n_steps int, n_paragraphs int, has_quote boolean, has_data boolean, has_picture boolean"
NAMES = SLIDE.replace(" string", "").replace(" long", "").replace(" int", "").replace(" boolean", "").split(", ")


def repairs(slides, low, high, most, least):
    """What can be tried for one outline, slide by slide."""
    if low <= len(slides) <= high:
        return set()
    kinds = lambda s: sum(bool(s[k]) for k in ("n_bullets", "n_kpis", "n_steps", "n_paragraphs", "has_quote"))
    items = lambda s: s["n_bullets"] or s["n_steps"] or s["n_kpis"] or (1 if s["has_quote"] else s["n_paragraphs"])
    able = lambda s: not s["has_data"] and kinds(s) == 1 and (not s["has_picture"] if s["archetype"] == "image_text" else s["archetype"] in outline.MERGEABLE)
    out = {}
    if len(slides) > high:
        at = [i for i, s in enumerate(slides) if s["archetype"] == "section"]
        if at:
            ends = [*at[1:], len(slides)]
            out["drop_section"] = max((-(b - a), a) for a, b in zip(at, ends))[1]
        for i, (a, b) in enumerate(zip(slides, slides[1:])):
            if able(a) and able(b) and items(a) + items(b) <= most:
                late = any(x["archetype"] in outline.MERGE_LAST for x in (a, b))
                out.setdefault("merge_lossy" if late else "merge", i)
    else:
        for i, s in enumerate(slides):
            if s["n_kpis"] and (s["n_bullets"] or s["has_data"]) and s["archetype"] != "kpi":
                out.setdefault("extract_kpis", i)
        texts = [(s["n_bullets"], i) for i, s in enumerate(slides) if s["archetype"] in outline.MERGEABLE and s["n_bullets"] >= least and not (s["n_kpis"] or s["n_steps"] or s["has_data"] or s["has_picture"] or s["has_quote"])]
        if texts:
            out["split"] = max(texts)[1]
    return {(what, slides[i]["idx"]) for what, i in out.items()} or {("none", None)}


def test_size_repairs_like_a_loop(spark):
    rng = random.Random(6)
    decks = {}
    for d in range(250):
        slides = []
        for i in range(rng.randrange(1, 12)):
            a = rng.choice(["section", "section", "bullets", "cards", "kpi", "quote", "chart", "image_text", "process", "title"])
            one = rng.choice(["n_bullets", "n_kpis", "n_steps", "n_paragraphs", "has_quote"])
            s = dict(idx=3 * i, archetype=a, n_bullets=0, n_kpis=0, n_steps=0, n_paragraphs=0, has_quote=False, has_data=a == "chart", has_picture=rng.random() < 0.3)
            s[one] = True if one == "has_quote" else rng.randrange(1, 6)
            if rng.random() < 0.3:
                s["n_bullets"] = rng.randrange(1, 6)
            slides.append(s)
        decks[f"d{d}"] = slides
    df = spark.createDataFrame([tuple({**s, "outline_id": d}[n] for n in NAMES) for d, v in decks.items() for s in v], SLIDE)
    got = {}
    for r in outline.size_repairs(df, 4, 6, 6, 4).collect():
        assert r.slides == len(decks[r.outline_id])
        got.setdefault(r.outline_id, set()).add((r.what, r.idx))
    want = {d: repairs(v, 4, 6, 6, 4) for d, v in decks.items()}
    assert got == {d: v for d, v in want.items() if v}
    assert {w for v in got.values() for w, _ in v} == {"drop_section", "merge", "merge_lossy", "extract_kpis", "split", "none"}


TOLD = "pack string, outline_id string, idx long, archetype string, bullets array<string>, kpis array<struct<value:string,label:string>>, chart array<struct<name:string,points:array<struct<category:string,value:string>>>>, table array<array<string>>, more int"


def test_invented_numbers_go(spark):
    chart = [("s", [("a", "12"), ("b", "7")]), ("empty", [])]
    rows = [
        ("p", "o", 0, "kpi", [], [("24/7", "always"), ("many", "")], None, None, 1),  # 7 is in no source
        ("p", "o", 1, "kpi", ["own"], [("24", "label")], None, None, 1),
        ("p", "o", 2, "chart", None, None, chart, None, 1),
        ("p", "o", 3, "chart", ["own"], [("99", "l")], [("s", [("a", "24")])], [["1"]], 1),
        ("p", "o", 4, "table", [], None, None, [["x", "24"], ["y", "12 and 24"]], 1),
        ("p", "o", 5, "table", [], None, None, [["x", "240"]], 1),
        ("q", "o", 6, "kpi", [], [("24", "other pack")], None, None, 1),
        (None, "o", 7, "kpi", [], [("5", "null")], [], [], 1),
        ("p", "o", 8, "cards", None, None, None, [["no digits"]], 1),
        ("p", "o", 8, "cards", None, None, None, [["no digits"]], 1),
    ]
    sources = spark.createDataFrame([("p", "24 of 12, since 2020"), ("q", None), (None, "5")], "pack string, text string")
    df = spark.createDataFrame(rows, TOLD)
    kept, warned = outline.ground_outline(df, sources, "pack")
    assert kept.columns == df.columns and kept.count() == len(rows)
    got = {r.idx: (r.archetype, r.bullets, bool(r.kpis), bool(r.chart), bool(r.table)) for r in kept.collect()}
    assert got == {
        0: ("bullets", ["always"], False, False, False), 1: ("kpi", ["own"], True, False, False), 2: ("bullets", ["s: a — 12, b — 7"], False, False, False), 3: ("chart", ["own"], False, True, False),
        4: ("table", [], False, False, True), 5: ("bullets", [], False, False, False), 6: ("bullets", ["other pack"], False, False, False), 7: ("kpi", [], True, False, False), 8: ("cards", None, False, False, True),
    }
    assert sorted((r.idx, r.part) for r in warned.collect()) == [(0, "kpi"), (2, "chart"), (3, "kpi"), (3, "table"), (5, "table"), (6, "kpi")]
    none, _ = outline.ground_outline(df.limit(0), sources, "pack")
    assert none.collect() == []


def plain_tail(t, n):
    for sep in outline.TAIL_SEPARATORS:
        for i in range(1, len(t)):
            head = t[:i].rstrip(outline.HEAD_ENDS)
            if t.startswith(sep, i) and n * 0.3 <= len(head) <= n:
                return head
    return None


def plain_words(t, n):
    if len(t.split(" ")) <= 2:
        return t
    cut = t[:n].rsplit(" ", 1)[0] if " " in t[:n] else t.split(" ")[0]
    words = cut.split(" ")
    while len(words) > 1 and words[-1].lower().rstrip(",;:") in outline.DANGLING_WORDS:
        words.pop()
    return " ".join(words).rstrip(outline.HEAD_ENDS) + "…"


def plain_title(t, n):
    if (head := plain_tail(t, n)) is not None:
        return head
    for sep in outline.LEAD_SEPARATORS:
        if t.find(sep) > 0 and 5 <= len(head := t[: t.find(sep)].rstrip(outline.HEAD_ENDS)) <= n:
            return head
    words = t.split(" ")
    for i in range(len(words) - 1, 1, -1):
        head = " ".join(words[:i]).rstrip(outline.HEAD_ENDS)
        if words[i].lower() in outline.PHRASE_BREAKS and n * 0.3 <= len(head) <= n:
            return head
    return plain_words(t, n)


def test_shorten_like_a_loop(spark):
    rng = random.Random(15)
    parts = ["Рост", "выручки", "для", "и", "a", "The", "of", "with", "plan", "step:", "one,", "two;", "—", "–", "(three)", "ВИА", "extraordinarily", "k", "В", "😀"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 16))) for _ in range(500)]
    texts += ["", "short", "Next: " + "x" * 50, "Следующий шаг: консультация для оценки вашей инфраструктуры и людей", "y" * 60, "two " + "y" * 60, "a of the and to in on with by at from"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", outline.shorten(F.col("t"), 20).alias("s"), outline.shorten_title(F.col("t"), 24).alias("h")).collect()
    for r in got:
        t = texts[r.i]
        assert r.s == (t if len(t) <= 20 else plain_tail(t, 20) or plain_words(t, 20)), t
        assert r.h == (t if len(t) <= 24 else plain_title(t, 24)), t
