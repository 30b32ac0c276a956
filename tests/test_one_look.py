"""Queries that look at shapes in context once do not write them, and move no shapes to find them."""

import pytest

from deckloom.plans import audit
from deckloom.sources import fixtures

SF_DIR = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", audit.ONE_LOOK)
def test_context_is_not_written(spark, monkeypatch, name):
    kept, known = [], fixtures.written_by
    monkeypatch.setattr(fixtures, "written_by", lambda df, label, key: kept.append(label) or known(df, label, key))
    found = audit.QUERIES[name](spark, SF_DIR)
    assert "lines" in kept and "context" not in kept
    plan = _plan(found)
    assert "hashpartitioning(slide_id" not in plan and "hashpartitioning(deck_id" not in plan  # only the few rows of exemplars and boxes move
    held = audit.RULES[name](fixtures.Prepared(spark, SF_DIR))
    assert "context" in kept and found.exceptAll(held).count() == held.exceptAll(found).count() == 0 < held.count()


def test_exemplars_are_sent_to_shapes(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if exemplars came in many small files
    try:
        plan = _plan(fixtures.OneLook(spark, SF_DIR).context())  # else whole slides move, to their exemplar and then to their template
        assert "SortMergeJoin [slide_id" in plan and "SortMergeJoin [exemplar_id" not in plan and "SortMergeJoin [template_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
