"""A calculation is not made again for a condition on it."""

from gneiss.operators import calculation, provenance


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_steps_are_no_filter_above_a_calculation(spark):
    lines = spark.createDataFrame([(3, 1, 10, 1, 2, "A", 0.05)], "l_orderkey long, l_linenumber int, l_quantity int, l_partkey long, l_suppkey long, l_returnflag string, l_discount double")
    done = calculation.calculate(calculation.requests_from_lines(lines))
    for out in (calculation.trace(done, ["l_orderkey"]), provenance.steps(done, ["l_orderkey"])):
        # Those of the small tables stay; the condition that repeats the calculation is far longer.
        assert max(len(line) for line in _plan(out).splitlines() if "Filter" in line) < 200
        assert out.count() == 7
