"""Findings grow with the data: no rule is idle, and none makes more than its share."""

import os

import duckdb
import pytest

from deckloom.plans import registry

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SHAPE_RULES = ("a01_off_slide", "a02_inherited_geometry", "a03_overlap", "a04_lines_over_blocks", "a06_off_grid", "a07_in_margins", "a08_stretched", "a10_off_scale", "a13_moved_fixed", "a14_displaced_fixed", "a15_low_contrast", "a16_many_bullets", "a20_fill_ratio", "a21_duplicate_parts", "a22_prompts_left")


@pytest.fixture(scope="module")
def tables():
    found = {}
    for sf in (SMALL, LARGE):
        found[sf] = duckdb.connect()
        for t in os.listdir(sf):
            found[sf].execute(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    return found


@pytest.mark.parametrize("name", SHAPE_RULES)
def test_findings_grow_with_slides(tables, name):
    small, large = (tables[sf].execute(f"select count(*) from ({registry.sql()[name]})").fetchall()[0][0] for sf in (SMALL, LARGE))
    assert small > 0 and 5 * small <= large <= 20 * small
