"""What the audit works out once: texts, slides, the plan of slides and the findings that stop a deck; and counts by deck."""

from pyspark.sql import functions as F

from deckloom.operators import layout, report
from deckloom.sources.fixtures import Prepared

SF_DIR = "/root/testdata/sf0.001"
FINDING = "check_id string, severity string, deck_id string, slide_idx long, z long"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_out_once(spark):
    f = Prepared(spark, SF_DIR)
    d = f.table("documents")
    assert "Exchange" not in _plan(d) and f.table("documents") is d
    assert d.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_slides_stay_where_they_are(spark):
    f = Prepared(spark, SF_DIR)
    assert "Exchange" not in _plan(f.decks().groupBy("slide_id").count()) and "Exchange" not in _plan(f.slides().groupBy("slide_id").count())
    of_lines = f.planned_lines()
    assert "Exchange hashpartitioning" not in _plan(of_lines)
    all_ = f.plan().join(f.lines(), "slide_id", "left_semi")
    assert sorted(of_lines.collect()) == sorted(all_.select(*of_lines.columns).collect())


def test_stops_are_worked_out_once(spark):
    calls = []

    def stop(t):
        calls.append(1)
        return t.where("check_id = 'I01'")

    t = spark.createDataFrame([("I01", "error", "a", 0, None), ("D01", "error", "a", 0, None), ("D01", "error", "b", 0, None)], FINDING)
    found = report.run_rules({"I01_x": stop, "D01_x": lambda t: t.where("check_id = 'D01'")}, t, None, "I01")
    assert sorted((r.check_id, r.deck_id) for r in found.collect()) == [("D01", "b"), ("I01", "a")] and len(calls) == 1


def test_summary_moves_findings_once(spark):
    rows = [("D01", "error", "a", 0, 1), ("D01", "error", "a", 0, 2), ("D05", "info", "a", 1, None), ("L01", "warning", "a", None, 3), ("L01", "warning", None, 2, 3)]
    s = report.summary(spark.createDataFrame(rows, FINDING))
    plan = _plan(s)
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" not in plan  # each finding went four times before
    got = {(r.deck_id, r.by, r.key): (r.n, r.serious) for r in s.collect()}
    assert got == {
        ("a", "severity", "error"): (2, 2), ("a", "severity", "info"): (1, 0), ("a", "severity", "warning"): (1, 1), ("a", "kind", "D"): (3, 2), ("a", "kind", "L"): (1, 1), ("a", "check", "D01"): (2, 2), ("a", "check", "D05"): (1, 0), ("a", "check", "L01"): (1, 1),
        ("a", "slide", "0"): (2, 2), ("a", "slide", None): (1, 1), (None, "severity", "warning"): (1, 1), (None, "kind", "L"): (1, 1), (None, "check", "L01"): (1, 1), (None, "slide", "2"): (1, 1),
    }


def test_overflow_leaves_texts_where_they_are(spark):
    p = spark.createDataFrame([(1, "word " * 40), (1, "word " * 40), (2, "word")], "doc_id long, text string")
    box = {"width_chars": F.lit(20), "size_pt": F.lit(12.0), "height_pt": F.lit(60.0), "insets_pt": F.lit(0.0), "gap_pt": F.lit(0.0), "is_title": F.lit(False), "autofit": F.lit(False), "wraps": F.lit(True)}
    found, held = layout.overflow(p.withColumns(box)), layout.overflow(p, p.select("doc_id").distinct().withColumns(box))
    assert "Join" not in _plan(found) and sorted(found.collect()) == sorted(held.collect()) and [r.doc_id for r in found.collect()] == [1]
