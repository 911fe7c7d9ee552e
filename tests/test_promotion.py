"""Word-for-word items by brute force, and references by hand."""

import random

import pytest

from gneiss.operators import promotion


@pytest.mark.parametrize("size", [1 << 14, 3])
def test_holders(spark, size):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab é", k=rng.randint(0, 900))) for _ in range(60)] + [None, "", "x" * 700, "y" + "x" * 600, "(.*) [a-z]+ \\d"]
    items = [t[i : i + rng.choice([1, 5, 63, 64, 65, 511, 512, 513, 700])] for t in texts[:60] for i in [rng.randint(0, 200)]] + ["x" * 600, "x" * 650, "", None, "(.*) [a-z]+", "nowhere"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame(list(enumerate(items)), "query_id long, text string")
    got = sorted(map(tuple, promotion.holders(docs, queries, size).collect()))
    assert got == [(q, d) for q, i in enumerate(items) for d, t in enumerate(texts) if i and t and i in t]
    assert promotion.holders(docs, queries.limit(0)).count() == 0 and promotion.holders(docs.limit(0), queries).count() == 0


def test_references_of_a_query(spark):
    said = [(1, "Per Table UW-12 and UG-27(c), see table m-1."), (2, "2-6 or A-1.5-2(1), no table"), (3, None), (4, "TABLE\n3-1(a)b, X-, Y-9z")]
    got = sorted(map(tuple, promotion.named_references(spark.createDataFrame(said, "query_id long, text string")).collect()))
    # A closing bracket before a space is no word boundary, so the reference ends before its letter.
    assert got == [
        (1, "M-1", False), (1, "M-1", True), (1, "UG-27", False), (1, "UW-12", False), (1, "UW-12", True), (2, "2-6", False), (2, "A-1.5-2", False),
        (4, "3-1(A)", False), (4, "3-1(A)", True),
    ]


def test_tables_come_before_sections(spark):
    elements = spark.createDataFrame(
        [("s1", "section", None, "A-1", 1), ("t1", "table", "A-1", "A-1", 5), ("t2", "table", "a-1", "A-1", 3), ("p", "paragraph", None, "A-1", 2), ("s2", "section", None, "a-1", 0), ("n", "section", None, None, 6)],
        "element_id string, element_type string, table_id string, paragraph_ref string, ord long",
    )
    queries = spark.createDataFrame([(1, "Table A-1"), (2, "about a-1"), (3, "nothing")], "query_id long, text string")
    ranked = spark.createDataFrame([(1, "x", 2.5), (1, "t1", 0.2), (2, "p", 0.4), (3, "x", 0.1)], "query_id long, doc_id string, score double")
    out = promotion.promote(ranked, promotion.by_reference(queries, elements)).collect()
    got = {q: [(r.doc_id, r.score, r.origin) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2, 3)}
    exact = "exact_ref"
    assert got[1] == [("t2", 2.5, exact), ("t1", 2.5, exact), ("s2", 2.5, exact), ("s1", 2.5, exact), ("x", 2.5, "hybrid")]
    assert got[2] == [("s2", 1.0, exact), ("s1", 1.0, exact), ("p", 0.4, "hybrid")]
    assert got[3] == [("x", 0.1, "hybrid")]


def test_rows_of_a_query_meet_once(spark):
    elements = spark.createDataFrame([(c, f"s{i}", "section", None, f"A-{i}", i) for c in (1, 2) for i in range(3)], "corpus int, element_id string, element_type string, table_id string, paragraph_ref string, ord long")
    queries = spark.createDataFrame([(1, 1, "A-1"), (2, 2, "A-1 and A-2"), (3, 9, "A-1")], "query_id long, corpus int, text string")
    named = promotion.by_reference(queries, elements, "corpus")
    assert sorted(map(tuple, named.collect())) == [(1, 1, "s1", 1, 1), (2, 2, "s1", 1, 1), (2, 2, "s2", 1, 2)]
    ranked = spark.createDataFrame([(1, "s1", 0.5), (2, "x", 3.0), (3, "y", 0.1), (3, "y", 0.1)], "query_id long, doc_id string, score double")
    out = promotion.promote(ranked, named.drop("corpus"))
    assert sorted((r.query_id, r["rank"], r.doc_id, r.score, r.origin) for r in out.collect()) == [
        (1, 1, "s1", 1.0, "exact_ref"), (2, 1, "s1", 3.0, "exact_ref"), (2, 2, "s2", 3.0, "exact_ref"), (2, 3, "x", 3.0, "hybrid"), (3, 1, "y", 0.1, "hybrid"), (3, 2, "y", 0.1, "hybrid"),
    ]
    # A join of questions and elements, a grouping of what they name, and one shuffle by query.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("RepartitionByExpression") == 1


def test_what_names_nothing_is_not_parsed(spark, monkeypatch):
    from gneiss.jobs import standards
    from gneiss.operators import parsing

    asked, whole = [], parsing.elements
    monkeypatch.setattr(standards.P, "elements", lambda docs, only=None: asked.append(only) or whole(docs, only))
    standards.reference_promotion(spark, "/root/testdata/sf0.001")
    assert asked == [["paragraph_ref", "table_id"]]
    plan = whole(spark.createDataFrame([(1, "## A-1 x")], "doc_id long, text string"), ["paragraph_ref"])._jdf.queryExecution().optimizedPlan().toString()
    assert "two" not in plan


def test_few_ids_are_numbered_like_many(spark):
    from gneiss.operators import parsing

    for n in (0, 1, 5, 16, 17, 40):
        ids, seen, want = [f"i{k * k % 7}" for k in range(n)], {}, []
        for i in ids:
            seen[i] = seen.get(i, 0) + 1
            want.append(seen[i])
        assert spark.createDataFrame([(ids,)], "ids array<string>").selectExpr(f"{parsing.repeats('ids')} as n").first()[0] == want
