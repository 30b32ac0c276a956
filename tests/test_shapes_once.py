"""Shapes in context are the shapes: rules that ask for shapes after them read them as they are written."""

from pyspark.sql import functions as F

from deckloom.functions import text
from deckloom.sources.fixtures import Fixtures, Prepared

SF_DIR = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(str, df.collect()))


def test_shapes_are_not_drawn_again(spark):
    f = Prepared(spark, SF_DIR)
    drawn = f.shapes()
    f.context()
    again = f.shapes()
    assert again.columns == drawn.columns and again.dtypes == drawn.dtypes
    assert all("/context-" in x for x in again.inputFiles())
    assert _rows(again) == _rows(drawn) == _rows(Fixtures(spark, SF_DIR).shapes())


def test_only_shapes_of_exemplars_are_drawn(spark):
    f = Prepared(spark, SF_DIR)
    plan = Fixtures.exemplars(f)._jdf.queryExecution().optimizedPlan().toString()
    joined = next(k for k, x in enumerate(plan.split("\n")) if "LeftSemi" in x)
    assert any("pic" in x and "graphicFrame" in x for x in plan.split("\n")[:joined])  # drawn of the few lines that are left
    assert not any("graphicFrame" in x for x in plan.split("\n")[joined:])


def test_words_are_counted(spark):
    rows = [("",), ("  ",), (None,), ("one",), (" one\ttwo three \n four ",), ("a  b\x0bc\fd\re",)]
    for r in spark.createDataFrame(rows, "t string").select(text.word_count(F.col("t")).alias("n"), text.words(F.col("t")).alias("words")).collect():
        assert r.n == len(r.words)
