"""The vector table, and answers to the end of their flow."""

import pytest
from pyspark.sql import functions as F

from gneiss.operators import calculation, citations, provenance, respond
from gneiss.sources.vectors import VectorTable

SHAPE = "id long, embedding array<float>, kind string"


def rows(spark, *items):
    return spark.createDataFrame([(i, [float(x) for x in v], k) for i, v, k in items], SHAPE)


def test_upserts(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    table = VectorTable.create(spark, path, SHAPE, 2, buckets=4)
    assert table.read().count() == 0
    table.upsert(rows(spark, *((i, (1, i), "a") for i in range(20))))
    before = table._latest()
    for _ in range(2):
        table.upsert(rows(spark, (3, (0, 1), "b"), (30, (5, 5), "b")))
        got = {r.id: (r.embedding, r.kind) for r in VectorTable(spark, path).read().collect()}
        assert got == {i: ([1.0, float(i)], "a") for i in range(20) if i != 3} | {3: ([0.0, 1.0], "b"), 30: ([5.0, 5.0], "b")}
    version, places = table._latest()
    assert version == before[0] + 2 and 0 < sum(places[b] != before[1].get(b) for b in places) <= 2
    table.upsert(rows(spark).limit(0))
    assert table._latest()[0] == version


@pytest.mark.parametrize("bad", [(1, (1,)), (1, (1, 2, 3)), (1, None), (None, (1, 2)), (1, (1, None)), (1, (float("nan"), 1)), (1, (float("inf"), 1))])
def test_a_wrong_row_refuses_its_batch(spark, tmp_path, bad):
    table = VectorTable.create(spark, f"{tmp_path}/vectors", SHAPE, 2)
    table.upsert(rows(spark, (1, (7, 7), "a")))
    new = spark.createDataFrame([(2, [1.0, 2.0], "a"), (*bad[:1], None if bad[1] is None else [None if x is None else float(x) for x in bad[1]], "a")], SHAPE)
    with pytest.raises(ValueError):
        table.upsert(new)
    with pytest.raises(ValueError):
        table.upsert(rows(spark, (5, (1, 1), "a"), (5, (2, 2), "a")))
    assert [(r.id, r.embedding) for r in table.read().collect()] == [(1, [7.0, 7.0])]


def test_a_commit_is_made_once(spark, tmp_path):
    table = VectorTable.create(spark, f"{tmp_path}/vectors", SHAPE, 2)
    table._put("commits/1.json", {})
    with pytest.raises(Exception, match="(?i)exist"):
        table._put("commits/1.json", {"0": "data/other"})


def test_nearest_rows_of_a_kind(spark, tmp_path):
    table = VectorTable.create(spark, f"{tmp_path}/vectors", SHAPE, 2)
    table.upsert(rows(spark, (0, (1, 0), "a"), (1, (1, 1), "b"), (2, (0, 1), "a"), (3, (0, 0), "a")))
    asked = spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.0, 1.0])], "query_id long, v array<float>")
    assert [(r.query_id, r.id) for r in table.nearest(asked, 2).orderBy("query_id", "rank").collect()] == [(0, 0), (0, 1), (1, 2), (1, 1)]
    assert [(r.query_id, r.id) for r in table.nearest(asked, 1, "kind = 'b'").orderBy("query_id", "rank").collect()] == [(0, 1), (1, 1)]
    with pytest.raises(ValueError):
        table.nearest(asked.withColumn("v", F.array(F.lit(1.0))), 1)


ELEMENTS = [
    ("s25", "section", "A-25", "Corrosion allowance shall be added to the thickness; more.", 1), ("s27", "section", "A-27", "Shells shall have this thickness at least. More.", 2),
    ("t1", "table", "M-1", "Stresses\n| SM-516 | Gr 70 | 138 |\n| SM-105 | x | 1 |", 3), ("t12", "table", "B-12", "Efficiencies\n| 1 | 1.00 |", 4),
]
ASK = "P = 1.5 MPa, ID 1800 mm, at 350°C, {}, Type {}, full RT, CA 3.0."


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ELEMENTS, "element_id string, element_type string, ref string, content string, ord int")


def test_citations_quote_the_corpus(spark, corpus):
    wanted = spark.createDataFrame(
        [("paragraph", "A-27(c)(1)", None), ("paragraph", "A-99", None), ("material", "Table M-1", "SM-516 Gr 70"), ("material", "Table M-1", "SM-9"), ("row", "Table B-12", "| 1 |"), ("row", "Table B-12", "| 6 |"), ("row", "Table B-12", "| 1 |")],
        "kind string, ref string, needle string",
    )
    got = sorted(map(tuple, citations.build(wanted, corpus).collect()), key=repr)
    assert got == sorted([
        ("paragraph", "A-27(c)(1)", None, "s27", "Shells shall have this thickness at least."), ("paragraph", "A-99", None, None, None), ("material", "Table M-1", "SM-516 Gr 70", "t1", "| SM-516 | Gr 70 | 138 |"),
        ("material", "Table M-1", "SM-9", None, None), *[("row", "Table B-12", "| 1 |", "t12", "| 1 | 1.00 |")] * 2, ("row", "Table B-12", "| 6 |", None, None),
    ], key=repr)


def test_steps_carry_their_inputs(spark):
    raw = spark.createDataFrame([(1, ASK.format("SM-516 Gr 70", 1)), (2, ASK.format("SM-999", 1))], "query_id long, query string")
    asked = calculation.parse_requests(raw).withColumns({c: F.col(c).cast(t) for c, t in respond.DECIMALS.items()})
    done = provenance.steps(calculation.calculate(asked), ["query_id"]).orderBy("step").collect()
    assert [r.step_key for r in done] == "allowable_stress joint_efficiency applicability_check min_thickness design_thickness nominal_plate mawp".split()
    assert {k: (v.value, v.source, v.cite and v.cite.ref) for k, v in done[3].inputs.items()} == {
        "P": (1.5, "user_input", None), "R": (900.0, "calculated", None), "S": (114.0, "pinned_data", "Table M-1"), "E": (1.0, "pinned_data", "Table B-12"),
    }
    assert done[2].formula == "P ≤ 0.385 × S × E" and (done[2].result, done[6].result) == (43.89, 1.633) and done[6].inputs["t_corr"].value == 13.0


def test_the_flow_ends_in_checked_citations(spark, corpus):
    queries = [(1, ASK.format("SM-516 Gr 70", 1)), (2, ASK.format("SM-516 Gr 70", 1)), (3, ASK.format("SM-516 Gr 70", 6)), (4, "What shall shells have?"), (5, "What shall shells have?"), (6, ASK.format("SM-516 Gr 70", 1))]
    content = {r[2]: r[3] for r in ELEMENTS}
    hits = [(q, e, r, content[r] if q in (1, 3) else "words", n, 0.9) for q in (1, 2, 3) for n, (e, r) in enumerate((("s27", "A-27"), ("t1", "M-1"), ("t12", "B-12")), 1)]
    hits += [(4, "s27", "A-27", content["A-27"], 1, 0.9), (6, "s27", "A-27", content["A-27"], 1, 0.9), (5, "s27", "A-27", " \n", 1, 0.9)]
    responses, checked = respond.respond_with_citations(
        spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(hits, "query_id long, element_id string, ref string, text string, rank int, score double"), corpus,
    )
    got = {r.query_id: (r.kind, r.confidence, r.refusal_reason) for r in responses.collect()}
    assert got == {
        1: ("calculation", "high", None), 2: ("calculation", "medium", None), 3: ("refusal", "insufficient", "calculation: citation"), 4: ("summary", "medium", None),
        5: ("refusal", "insufficient", "no context"), 6: ("refusal", "insufficient", "evidence: M-1, B-12"),
    }
    told = {q: [r for r in sorted(checked.collect(), key=lambda r: r.cite_no) if r.query_id == q] for q in got}
    assert [len(told[q]) for q in range(1, 7)] == [13, 13, 0, 1, 0, 0]
    assert all(r.issue is None for r in told[1] + told[4]) and [r.issue for r in told[2]].count("quote") == 12
    assert [(r.step, r.input, r.ref) for r in told[1][2:5]] == [(3, None, "A-27(c)(1)"), (3, "S", "Table M-1"), (3, "E", "Table B-12")]
    assert citations.violations(responses, checked.select("query_id")).count() == 0
