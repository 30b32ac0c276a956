"""Packs and recorded documents as people write them."""

import json

from pyspark.sql import functions as F

from deckloom.sources import packs

METRICS = """{
  "_note": "left out",
  "m:users": {"value": 42, "unit": "%", "label": "share of \\"users\\""},
  "days": {
    "before": 1.8,
    "after": 0.6
  },
  "hours": {"title": "Hours", "categories": ["May", "June"], "series": {"a": [1, 2]}},
  "parts": {"header": ["x"], "rows": [["1"]]},
  "said": {"text": "We saw it, at last", "author": "A user"},
  "teams": {"teams": 12},
  "list": [1, 2],
  "plain": 7
}
"""


def write(folder, name, text):
    at = folder / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(text.encode() if isinstance(text, str) else text)


def test_a_real_pack(spark, tmp_path):
    write(tmp_path, "brief.md", "# A brief\n\ntext")
    write(tmp_path, "outline.json", "{}")  # a result beside the brief, no source
    write(tmp_path, "deep/other.md", "not at the root")
    write(tmp_path, "data/metrics.json", METRICS)
    write(tmp_path, "data/broken.json", METRICS[:-4])
    write(tmp_path, "data/two.json", '{"a": 1}\n{"b": 2}\n')
    write(tmp_path, "data/scalar.json", '"text"')
    write(tmp_path, "data/empty.json", "\n")
    write(tmp_path, "data/list.json", '[{"a": 1},\n 2]')
    write(tmp_path, "data/one.csv", "﻿name,n\r\n\"Smith, \"\"J\"\"\",1\r\n\r\n , \r\nplain,2")
    write(tmp_path, "data/many.csv", "k\n" + "\n".join(str(k) for k in range(31)) + '\n"two\nlines"\n')
    write(tmp_path, "data/none.csv", "\n")
    write(tmp_path, "data/photo.png", b"\x89PNG")
    good, bad = packs.read_pack(spark, str(tmp_path))
    got = {r.frag_id: r for r in good.withColumn("data", F.to_json("data")).collect()}
    kinds = {"m:users": "metric", "metrics:days": "metric", "metrics:hours": "series", "metrics:parts": "table", "metrics:said": "quote", "metrics:teams": "record", "metrics:list": "record", "metrics:plain": "text"}
    assert {k: v.kind for k, v in got.items()} == {**kinds, "brief": "text", "json:list": "record", "csv:one": "table", "csv:many": "table", "csv:none": "table"}
    assert got["m:users"].title == 'share of "users"' and json.loads(got["m:users"].data)["value"] == 42
    assert got["metrics:hours"].title == "Hours" and got["metrics:said"].text == "We saw it, at last" and got["metrics:plain"].text == "7" and got["brief"].text == "# A brief\n\ntext"
    assert json.loads(got["csv:one"].data) == {"header": ["name", "n"], "rows": [['Smith, "J"', "1"], ["plain", "2"]]}
    assert len(json.loads(got["csv:many"].data)["rows"]) == 30 and got["csv:many"].text == "first 30 of 32"
    assert json.loads(got["csv:none"].data) == {"header": [], "rows": []}
    assert sorted((r.source, r.warning) for r in bad.collect()) == [(f"{n}.json", "unreadable") for n in ("broken", "empty", "scalar", "two")]


def test_lines_inside_cells(spark):
    files = spark.createDataFrame([("t.csv", 'a,b\n"two\nlines","x ""y"""\n,z\n"",\n' + '"' + "long " * 50000 + '",end')], "name string, raw string")
    r = packs.csv_files(files).head()
    assert r.header == ["a", "b"] and r.rows[:2] == [["two\nlines", 'x "y"'], ["", "z"]] and r.rows[2] == [("long " * 50000).strip(), "end"] and r.total == 3


def test_recorded_documents_however_printed(spark, tmp_path):
    outline = {"outline_id": "o", "slides": [{"idx": 0, "archetype": "title", "title": "T", "bullets": []}, {"idx": 1, "archetype": "cards", "title": "C", "bullets": ["a", "b"]}]}
    for name, text in (("pretty", json.dumps(outline, indent=2)), ("flat", json.dumps(outline)), ("some", json.dumps([outline, {**outline, "outline_id": "p"}], indent=1))):
        write(tmp_path, f"o/{name}.json", text)
    got = packs.read_outlines(spark, str(tmp_path / "o")).collect()
    assert sorted((r.outline_id, r.idx, r.n_bullets) for r in got) == [("o", 0, 0)] * 3 + [("o", 1, 2)] * 3 + [("p", 0, 0), ("p", 1, 2)]
    finding = {"check_id": "T02", "kind": "deterministic", "severity": "warning", "slide_idx": 0, "element_id": "407", "box": {"x": 1, "y": 2, "w": 3, "h": 4}, "message": "m", "autofix": "snap_font_size", "evidence": {"size_pt": 30.6, "in_exemplar": 0}}
    write(tmp_path, "a/x.audit.json", json.dumps({"deck_path": "x", "findings": [finding, {**finding, "check_id": "D01", "box": None, "evidence": {}}], "checks_run": ["T02", "D01", "I01"], "duration_s": 1.5}, indent=2))
    write(tmp_path, "a/clean.json", json.dumps({"deck_path": "y", "findings": [], "checks_run": [], "duration_s": 0.1}))
    got = packs.read_findings(spark, str(tmp_path / "a")).orderBy("n").collect()
    assert [(r.deck_path, r.n, r.check_id, r.checks_run) for r in got] == [("x", 0, "T02", 3), ("x", 1, "D01", 3)]
    assert got[0].box.h == 4 and got[0].evidence == {"size_pt": "30.6", "in_exemplar": "0"} and got[1].box is None
    run = {"template": {"id": "t", "sha1": "s"}, "decks": [{"strategy": "executive", "stats": {"slides": 11}, "audit": {"errors": 2}, "timings_s": {"deck_total": 3.5, "audit": 1.0}}], "timings_s": {"total": 9.0}}
    write(tmp_path, "r/run.json", json.dumps(run, indent=2))
    decks, steps = packs.read_runs(spark, str(tmp_path / "r"))
    assert [(r.template_id, r.strategy, r.slides, r.errors, r.warnings, r.seconds) for r in decks.collect()] == [("t", "executive", 11, 2, None, 3.5)]
    assert sorted((str(r.strategy), r.step, r.seconds) for r in steps.collect()) == [("None", "total", 9.0), ("executive", "audit", 1.0), ("executive", "deck_total", 3.5)]
