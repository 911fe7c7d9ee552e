"""Metrics of examples bring each side together once, and match what the join of pairs matches."""

from gneiss.operators import metrics as M

RANKED = [(1, 1, "A-2"), (1, 2, "Table a-27(c)"), (1, 2, "A-27(c)"), (1, 3, None), (1, 9, "A-3"), (2, 1, "A-2(c)(1)"), (3, 1, ""), (5, 1, "(x)"), (None, 1, "A-1")]
EXPECTED = [(1, "A-27"), (1, "a-27"), (1, "A-2(d)"), (1, "A-3"), (1, None), (2, "A-2(c)"), (2, "A-27"), (3, ""), (4, "A-1"), (5, "(x)(1)"), (5, "y"), (None, "A-1")]


def _sides(spark):
    return spark.createDataFrame(RANKED, "query_id long, rank int, ref string"), spark.createDataFrame(EXPECTED, "query_id long, ref string")


def test_retrieval(spark):
    ranked, expected = _sides(spark)
    out = M.retrieval(ranked, expected, 4)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        (1, 0.75, True, 0.4, False), (2, 1.0, True, 0.5, False), (3, 0.0, False, 0.0, False), (4, 0.0, False, 0.0, False), (5, 1.0, True, 0.5, False),
        (None, 0.0, False, 1.0, True), (None, 0.0, False, 0.0, False)], key=str)
    assert str(out._jdf.queryExecution().optimizedPlan()).count("Join") == 1


def test_structural(spark):
    ranked, expected = _sides(spark)
    out = M.structural(expected, ranked.select("query_id", "ref"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([
        (1, 4, 5, 0.8, False), (2, 1, 2, 0.5, False), (3, 0, 1, 0.0, False), (4, 0, 1, 0.0, False), (5, 1, 2, 0.5, False), (None, 0, 1, 0.0, False)], key=str)
    assert str(out._jdf.queryExecution().optimizedPlan()).count("Join") == 1


def test_example_scores_works_out_retrieval_once(spark):
    from gneiss.jobs import scoring

    plan = scoring.example_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FullOuter") == 1
