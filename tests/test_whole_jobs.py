"""Queries that once did less than their whole job."""

import pytest

from deckloom.operators import audit, content, layout
from deckloom.plans import registry
from deckloom.sources.fixtures import Prepared


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """Twenty short documents of one source."""
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(k, "one two three four", "en", "s", 18) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


def test_evidence_looks_at_every_document(spark, documents):
    assert sorted(r.doc_id for r in registry.queries()["g06_evidence"](spark, documents).collect()) == list(range(20))


def test_facts_without_stems_are_near_none(spark):
    facts = spark.createDataFrame([("p", 1, "?! ?! ?! ?!", 3), ("p", 2, "alpha bravo charlie", 2), ("p", 3, "... --- ...", 2), ("p", 4, "bravo charlie", 1)], "pack string, id long, text string, weight long")
    assert [(r.id, r.n) for r in content.select_facts(facts, 1500).orderBy("n").collect()] == [(1, 1), (2, 2), (3, 3)]


def test_rules_on_prepared_shapes_move_none(spark):
    f = Prepared(spark, "/root/testdata/sf0.001")
    f.context()
    moved = audit.many_bullets(f.context()).unionByName(audit.many_bullets(f.shapes()))
    assert "Exchange" not in moved._jdf.queryExecution().toString()


def test_lines_are_numbered_before_they_meet_parts(spark, tmp_path):
    """The second line's part is missing and the third's is there twice: both keep their numbers."""
    line = [(1, 1, 7, 7, 6.0, 1.0, "R", "F"), (1, 2, 8, 7, 6.0, 1.0, "N", "F"), (1, 3, 9, 7, 5.5, 1.0, "N", "O")]
    spark.createDataFrame(line, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, 10, "a"), (9, 11, "b"), (9, 12, "c")], "p_partkey long, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 5, "2020-01-01", "1-URGENT")], "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(5, 3)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = [(r.z, r.pk, r.font, r.chars) for r in Prepared(spark, str(tmp_path)).shapes().orderBy("z", "font").collect()]
    assert got == [(1, 7, "a", 36), (3, 9, "b", 30), (3, 9, "c", 30)]


def test_number_sequences_make_no_pairs(spark):
    """Two rows: 3, 4, 5 and 9 in one, which beats 1, 2 in the other; blocks of one number in a column."""
    rows = [(1, k, 1000 * k, y, 100, 100, v) for k, (y, v) in enumerate([(0, 4), (0, 3), (20, 5), (0, 9), (5000, 1), (5000, 2)])]
    found = layout.number_sequence(spark.createDataFrame(rows, "slide_id long, z long, x long, y long, w long, h long, value long"), 50, 2)
    assert [tuple(r) for r in found.collect()] == [(1, "row", 3, 3)]
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Window" not in plan
