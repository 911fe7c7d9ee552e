"""Elements, citations, requests and metrics on awkward rows, and against plain Python."""

import random

import pytest

from gneiss.operators import browse, calculation, citations, evidence, graph, metrics, parsing, respond


@pytest.mark.parametrize("text, want", [
    ("P = 1.5 MPa, ID 1800 mm, at 350°C, SM-516 Grade 70, Type 1, full RT, CA 3.0.", ("cylinder_inside", 1.5, 1800.0, 350.0, "SM-516 Gr 70", 1, "Full RT", 3.0)),
    ("design pressure 2. MPa, OD=600., T=149.5 C, SM-105, type 2, no radiography", ("cylinder_outside", 2.0, 600.0, 149.5, "SM-105", 2, "No RT", 0.0)),
    ("P 1 MPa, inside diameter 5 and OD 6, spherical, T 40 C, SM-240  Type 304, joint type 3, spot RT", ("sphere", 1.0, 5.0, 40.0, "SM-240 Type 304", 3, "Spot RT", 0.0)),
    ("P = 1.2.3 MPa, ID 1800 mm, T=350°C, SM-105, Type 1, full RT", None), ("P = 1 MPa, ID 1800 mm, T=350°C, SM-105, Type 1, full RT, CA 1.2.3 mm", None),
    ("P = 1 MPa, ID 1800 mm, 350 C, SM-105, Type 1, full RT", None), ("", None), (None, None),
])
def test_requests(spark, text, want):
    row = calculation.parse_requests(spark.createDataFrame([(text,)], "query string")).drop("query").first()
    assert tuple(row) == (want or (None,) * 8)


def test_fractions_of_degrees_interpolate(spark):
    asked = spark.createDataFrame([("SM-516 Gr 70", 275.5), ("SM-516 Gr 70", 275.0), ("SM-516 Gr 70", 500.0), ("SM-516 Gr 70", 500.5)], "material string, temp_c double")
    got = {r.temp_c: r.s_mpa for r in calculation.with_stress(asked).collect()}
    assert float(got[275.5]) == pytest.approx(127 - 6 * 25.5 / 50) and float(got[275.0]) == 124 and float(got[500.0]) == 49 and got[500.5] is None


TABLES = """## A-1 Group values
| | | | | Group | Group |
|---|---|---|---|---|---|
| Spec | Grade | P | Q | 100 °C | max °C |
| x | y | 1 | 2 | 3 | 4 |
not a table

| no | separator |
| 1 | 2 |

|---|---|
| no header | above |

| a | b |
|---|---|
|---|---|
| 1 | 2 |
## Table UW-12 - Joints Cont'd ( )
| a |
|---|
| 1 |
"""


def test_tables(spark):
    docs = spark.createDataFrame([(1, TABLES), (2, None), (3, ""), (4, "## only")], "doc_id int, text string")
    got = parsing.tables(parsing.sections(docs)).orderBy("element_id", "block").collect()
    assert [(r.table_id, r.caption, r.table_ref, r.headers, r.rows) for r in got] == [
        ("A-1", "Group values", "A-1", ["Spec", "Grade", "P", "Q", "100 °C", "Group max °C"], [["x", "y", "1", "2", "3", "4"]]),
        ("A-1-3", None, "A-1", ["a", "b"], [["---", "---"], ["1", "2"]]),
        ("UW-12", "Joints Cont d", "UW-12", ["a"], [["1"]]),
    ]
    e = parsing.elements(docs).filter("doc_id = 1").orderBy("ord").collect()
    assert [r.element_id for r in e] == ["sec-a-1", "tbl-a-1", "tbl-a-1-3", "sec-table-uw-12-joints-cont-d", "tbl-uw-12"]
    assert parsing.elements(docs).filter("doc_id = 4").first().content == ""
    assert parsing.elements(docs.filter("doc_id = 9")).count() == 0


def test_formulas(spark):
    text = "## A-1 x\n```text\nt = (P × Ro) / (S − 1)\nu = 2\n```\nApplicable when t ≤ 1 and P ≤ 2 AND t ≤ 1. Applies when: z.\n```\nno equation\n```\n```\nE=1\n```"
    f = parsing.formulas(parsing.sections(spark.createDataFrame([(1, text)], "doc_id int, text string"))).orderBy("fence").collect()
    assert [(r.formula_id, r.plain, r.variables, r.conditions) for r in f] == [
        ("A-1-f0", "t = (P × Ro) / (S − 1)", ["Ro", "P", "S", "t"], ["t ≤ 1", "P ≤ 2", "z"]), ("A-1-f1", "E=1", ["E"], []),
    ]
    assert f[0].latex == r"t = \frac{P \times  Ro}{S - 1}"


def test_citations(spark):
    elements = spark.createDataFrame(
        [("t1", "table", "M-1", "| row |", 1), ("s1", "section", "m-1", "The Stress Table of this standard.", 2), ("s2", "section", "A-27", "Shells shall be thick", 3), ("s3", "section", None, "no ref", 4)],
        "element_id string, element_type string, ref string, content string, ord int",
    )
    chunks = spark.createDataFrame([(1, "s2", "A-27", "Shells shall be thick", 1), (1, "s9", None, "anything goes here", 2)], "query_id int, element_id string, ref string, content string, rank int")
    cases = [
        ("s2", "A-27(c)(1)", "shells  SHALL be", "s2", None), ("a-27", "A-27", "thick", "s2", None), ("zz", "Table A-27", "thick", "s2", None), ("zz", "A-27(c)", "thick", "s2", None),
        ("s2", "A-2", "thick", "s2", "reference"), ("s2", "A-27", "wholly other words", "s2", "quote"), ("s9", "free text", "anything goes", "s9", None), ("zz", "free text", "x", None, "not canonical"),
        ("zz", "Table M-1", "stress table", "s1", None), ("zz", "M-1(a)(2)", "stress table", "s1", None), ("zz", "M-1", "| row |", "s1", "quote"), ("zz", "Z-1", "x", None, "unresolved"), ("zz", None, None, None, "not canonical"), ("s2", "A-27", "", "s2", "quote"),
    ]
    cited = spark.createDataFrame([(1, i, s, r, q) for i, (s, r, q, _, _) in enumerate(cases)], "query_id int, cite_no int, source_id string, ref string, quote string")
    checked = citations.validate(cited, chunks, elements)
    got = {r.cite_no: (r.resolved_id, r.issue) for r in checked.collect()}
    assert got == {i: (at, issue) for i, (*_, at, issue) in enumerate(cases)}
    assert {r.cite_no: r.issue for r in citations.validate(cited, chunks).collect()}[8] == "no corpus"
    answers = spark.createDataFrame([(1, "high", None), (2, "high", None), (3, "insufficient", ""), (4, "low", "why")], "query_id int, confidence string, refusal_reason string")
    assert {r.query_id: (r.total, r.valid, r.passed) for r in citations.accuracy(answers, checked).collect()} == {1: (14, 7, False), 2: (0, 0, True), 3: (0, 0, True), 4: (0, 0, True)}
    assert {r.query_id: r.confidence for r in citations.downgraded(answers, checked).collect()} == {1: "medium", 2: "high", 3: "insufficient", 4: "low"}
    assert {r.query_id: r.violation for r in citations.violations(answers, cited).collect()} == {2: "no citation", 3: "refusal without reason", 4: "reason without refusal"}


def greedy(predicted, truth):
    """Plain greedy matching of tables (ord, id, caption, page, headers, rows)."""
    cells = lambda t: {(-1, j, h) for j, h in enumerate(t[4])} | {(i, j, c) for i, r in enumerate(t[5]) for j, c in enumerate(r)}
    words = lambda c: set((c or "").lower().split())
    free, total = list(predicted), 0.0
    for t in truth:
        best, high = None, 0.0
        for p in free:
            ph, th = {h.lower() for h in p[4]}, {h.lower() for h in t[4]}
            score = 10.0 * (p[1].upper() == t[1].upper()) + 2.0 * (p[3] == t[3]) + bool(words(p[2]) & words(t[2])) + 3.0 * len(ph & th) / max(len(th), 1)
            if score > high:
                best, high = p, score
        if best:
            free.remove(best)
            a, b = cells(t), cells(best)
            total += 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    return round(total / len(truth), 6)


def test_table_f1_against_plain_greedy(spark):
    rng = random.Random(3)

    def draw(n):
        return [(i, rng.choice(["A-1", "a-1", "B-2", "C-3"]), rng.choice([None, "stress values", "joint values", ""]), rng.randint(1, 2),
                 rng.sample(["h", "k", "m"], rng.randint(0, 2)), [[rng.choice("xy") for _ in range(rng.randint(0, 2))] for _ in range(rng.randint(0, 2))]) for i in range(n)]

    docs = {d: (draw(rng.randint(0, 4)), draw(rng.randint(1, 4))) for d in range(40)}
    schema = "doc_id int, ord int, table_id string, caption string, page int, headers array<string>, rows array<array<string>>"
    side = lambda k: spark.createDataFrame([(d, *t) for d, both in docs.items() for t in both[k]], schema)
    got = {r.doc_id: r.f1 for r in metrics.table_f1(side(0), side(1)).collect()}
    assert got == pytest.approx({d: greedy(*both) for d, both in docs.items()})


def test_references_match_at_parentheses(spark):
    refs = ["A-2", "A-27", "a-27(c)", "A-27(c)(1)", "Table A-27", "A-27(d)", None, ""]
    left = spark.createDataFrame([(1, r) for r in refs], "q int, ref string")
    got = {(r.left_ref, r.right_ref) for r in metrics.matched(left, left, "q").collect()}
    flat = lambda r: (r or "").upper().replace("TABLE ", "")
    want = {(a, b) for a in refs for b in refs if flat(a) and flat(b) and (flat(a) == flat(b) or flat(a).startswith(flat(b) + "(") or flat(b).startswith(flat(a) + "("))}
    assert got == want


def test_grounding(spark):
    rows = [(1, "Use A-27(c) and SM-516 Gr 70 of Table Z-9.", "table z-9"), (2, "nothing named", None), (3, None, None)]
    df = spark.createDataFrame(rows, "query_id int, answer string, context string")
    assert {r.query_id: (r.grounded, r.total) for r in metrics.grounding(df).collect()}[1] == (2, 3)
    assert {r.query_id: r.value for r in metrics.grounding(df, strict=True).collect()}[2] == 1.0


def test_weak_components(spark):
    rng = random.Random(1)
    pairs = [(f"v{rng.randint(0, 120):03}", f"v{rng.randint(0, 120):03}") for _ in range(80)] + [(f"z{i:03}", f"z{i + 1:03}") for i in range(60)]
    nodes = {x for p in pairs for x in p} | {"alone"}
    label = {n: n for n in nodes}
    for _ in range(len(nodes)):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = graph.weak_components(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(pairs, "src string, dst string"))
    assert {r.id: r.component for r in got.collect()} == label
    empty = spark.createDataFrame([], "id string")
    assert graph.weak_components(empty, spark.createDataFrame([], "src string, dst string")).count() == 0


def test_topics(spark):
    rows = [("A-1 - <br>**LOUD** title", None, "A-1"), ("x", "The caption", None), (None, None, None), ("A-12 x", None, "A-1")]
    df = spark.createDataFrame(rows, "title string, caption string, paragraph_ref string")
    assert [r[0] for r in df.select(browse.topic()).collect()] == ["LOUD title", "The caption", "", "2 x"]


def test_responses_without_hits_or_questions(spark):
    queries = spark.createDataFrame([(1, "What is this?"), (2, None), (3, "What else?")], "query_id int, query string")
    hits = spark.createDataFrame([(1, "A-1", "\n", 1, 0.9), (3, None, "a line", 1, 0.9)], "query_id int, ref string, text string, rank int, score double")
    got = {r.query_id: (r.kind, r.confidence, r.refusal_reason, r.answer) for r in respond.respond(queries, hits).collect()}
    assert got == {1: ("refusal", "insufficient", "no context", None), 2: ("refusal", "insufficient", "relevance", None), 3: ("summary", "medium", None, "[] a line")}
    assert evidence.gate(spark.createDataFrame([], "query string, max_score double")).count() == 0
