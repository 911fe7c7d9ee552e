"""Citations meet their chunks in one shuffle."""

from gneiss.operators import citations


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_citations_meet_the_chunks_of_their_query_once(spark):
    cited = spark.createDataFrame([(1, 1, "e1", "A-1", "two words"), (1, 2, "a-2", "A-2(b)", "x"), (2, 1, "e1", "A-1", "x")], "query_id long, cite_no int, source_id string, ref string, quote string")
    chunks = spark.createDataFrame([(1, "e1", "A-1", "two words", 1), (1, "e1", "A-9", "other", 2), (1, "e2", "A-2", "x", 4), (1, "e3", "A-2", "y", 3), (1, "e4", None, "x", None)], "query_id long, element_id string, ref string, content string, rank int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = citations.validate(cited, chunks)
        assert _exchanges(out) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # By id the last chunk counts, by reference the first.
    assert sorted((r.query_id, r.cite_no, r.resolved_id, r.issue) for r in out.collect()) == [(1, 1, "e1", "reference"), (1, 2, "e3", "quote"), (2, 1, None, "no corpus")]
