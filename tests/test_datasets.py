"""JSON inputs and logs."""

import json

import pytest
from pyspark.sql import functions as F

from gneiss.functions import pinned
from gneiss.sources import datasets, io


def put(path, value):
    path.write_text(json.dumps(value, indent=1))
    return str(path)


def test_joints(spark, tmp_path):
    told = {"title": "x", "joints": [{"type": j, "description": f"d{j}", "efficiencies": dict(zip(pinned.RT_LEVELS, map(float, e), strict=True))} for j, e in pinned.JOINT_EFFICIENCY]}
    got = datasets.read_joints(spark, put(tmp_path / "j.json", told))
    assert sorted((r.joint_type, r.rt_level, str(r.e)) for r in got.collect()) == sorted(pinned.joint_rows())


def test_golden_examples(spark, tmp_path):
    full = {"id": "a", "query": "q", "category": "lookup", "expected_paragraph_refs": ["A-1", "A-2"], "expected_values": {"t": 1.5, "u": 2}, "numeric_tolerance": 0.1, "notes": "n"}
    least = {"id": "b", "query": "q", "category": "out_of_domain", "expected_refusal": True}
    golden = datasets.read_golden(spark, put(tmp_path / "g.json", [full, least]))
    rows = {r.id: r for r in golden.collect()}
    assert rows["b"].expected_values == {} and rows["b"].numeric_tolerance == 0.02 and rows["b"].expected_refusal and not rows["a"].expected_refusal
    refs, values = datasets.expected(golden)
    assert sorted(map(tuple, refs.collect())) == [("a", "A-1"), ("a", "A-2")] and sorted(map(tuple, values.collect())) == [("a", "t", 1.5, 0.1), ("a", "u", 2.0, 0.1)]
    for bad in (full | {"category": "other"}, {"id": "c", "category": "lookup"}, full | {"numeric_tolerance": -1}, least | {"id": "a"}, least | {"id": None}):
        with pytest.raises(ValueError):
            datasets.read_golden(spark, put(tmp_path / "bad.json", [full, bad]))
    assert datasets.read_golden(spark, put(tmp_path / "none.json", [])).count() == 0


def test_elements_of_files_that_changed_are_left_out(spark, tmp_path):
    files = spark.createDataFrame([("x", "one"), ("y", "two"), ("z", None)], "doc_id string, text string")
    elements = files.select("doc_id", F.lit("section").alias("element_type"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("source_digest"))
    io.write_elements(elements, str(tmp_path / "e"))
    now = spark.createDataFrame([("x", "one"), ("y", "changed"), ("z", None), ("w", "new")], "doc_id string, text string")
    assert sorted(r.doc_id for r in datasets.preindexed(spark, str(tmp_path / "e"), now).collect()) == ["x", "z"]


def test_logs(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = spark.createDataFrame([("r1", "2024-01-01 00:00:00", "e1", "sys \"q\"\n", "ask"), ("r2", "2024-01-01 00:00:01", "e2", None, "ask")], "run_id string, ts string, example_id string, system_prompt string, user_prompt string")
    datasets.write_log(rows, path, "prompts")
    datasets.write_log(rows.filter("run_id = 'r1'").withColumn("example_id", F.lit("e3")), path, "prompts")
    got = sorted((r.run_id, r.example_id, r.system_prompt) for r in datasets.read_log(spark, path, "prompts").collect())
    assert got == [("r1", "e1", 'sys "q"\n'), ("r1", "e3", 'sys "q"\n'), ("r2", "e2", None)]
    datasets.write_log(rows.selectExpr("run_id", "ts", "'llm.request' as kind", "1.5 as latency_ms"), path, "request_log")
    assert {(r.kind, r.latency_ms, r.error) for r in datasets.read_log(spark, path, "request_log").collect()} == {("llm.request", 1.5, None)}
