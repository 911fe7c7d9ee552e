"""What a query does not ask of elements is not parsed, and elements without a reference meet no pattern."""

from gneiss.operators import parsing

TEXTS = [
    "## A-1 x\nsee Table B-2 and A-1(c)\n| a | b |\n|---|---|\n| 1 | 2 |\n### Table B-2 y\n```\nt = S\n```\nThis formula applies when: x and y.\n## Plain\nno reference - none\n\n",
    "##  \n##### x\n## _A-1_ **z**\r\n\n\r\n## A-1\n| no table |\n| at all |\n\n\r", None, "",
]


def _docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_fewer_columns_are_those_of_all(spark):
    docs = _docs(spark)
    every = parsing.elements(docs)
    for only in (["paragraph_ref", "parent_id", "content", "table_id", "variables"], ["title", "page"], ["headers", "caption"], ["conditions"], []):
        some = parsing.elements(docs, only)
        assert some.columns[:4] == ["doc_id", "ord", "element_id", "element_type"] and set(some.columns[4:]) == set(only)
        key = lambda r: (r["doc_id"], r["ord"])
        assert sorted(some.collect(), key=key) == sorted(every.select(some.columns).collect(), key=key)


def test_what_is_not_asked_for_is_not_parsed(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    caption, conditions = "Cont(?:inued)", "applicable"
    assert caption in plan(parsing.elements(_docs(spark))) and conditions in plan(parsing.elements(_docs(spark)))
    some = plan(parsing.elements(_docs(spark), ["content", "table_id", "variables"]))
    assert caption not in some and conditions not in some


def test_references_are_looked_for_in_one_pass(spark):
    e = spark.createDataFrame(
        [(1, "a", 1, "A-1", "see Table B-2, then A-1(c) and table  b-2"), (1, "b", 2, "B-2", "from A-1"), (1, "c", 3, None, "no reference - none"), (2, "d", 1, "3-4", None)],
        "doc_id long, element_id string, ord int, paragraph_ref string, content string")
    e = e.withColumn("table_id", parsing.F.when(parsing.F.col("element_id") == "b", parsing.F.lit("B-2")))
    out = parsing.cross_references(e.select("doc_id", "element_id", "content"), parsing.reference_index(e))
    assert sorted(map(tuple, out.collect())) == [(1, "a", "b", "see Table B-2"), (1, "b", "a", "from A-1")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 3 and "-[0-9]" in plan
