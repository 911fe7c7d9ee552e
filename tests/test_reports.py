"""Reports by hand."""

from gneiss.operators import metrics, reports

ROWS = [
    ("r1", 1, "a", "m", 1.0, 0.5, True), ("r1", 1, "a", "k", 0.5, 0.5, True), ("r1", 2, None, "m", 0.25, 0.5, False), ("r1", 2, None, "m", 0.75, 0.5, True), ("r1", 3, "b", "m", 0.0, 0.5, False),
    ("r2", 1, "a", "m", 1.0, 0.5, True),
]


def test_reports(spark):
    scores = spark.createDataFrame(ROWS, "run_id string, example_id long, category string, metric string, value double, threshold double, passed boolean")
    manifest = spark.createDataFrame([("r1", "model", "x"), ("r1", "dirty", None), ("r3", "model", "y")], "run_id string, field string, value string")
    got = {r.run_id: r.report for r in reports.run_reports(scores, manifest, worst=1).collect()}
    assert got["r1"] == """# Run r1

Passed: 1 of 3 examples

## Configuration
| field | value |
|---|---|
| dirty |  |
| model | x |

## Metrics
| metric | mean | threshold | passed |
|---|---|---|---|
| k | 0.500000 | 0.500000 | 1/1 |
| m | 0.500000 | 0.500000 | 1/3 |

## Categories
| category | metric | mean | passed |
|---|---|---|---|
|  | m | 0.500000 | 0/1 |
| a | k | 0.500000 | 1/1 |
| a | m | 1.000000 | 1/1 |
| b | m | 0.000000 | 0/1 |

## Failing examples
### 3 (b)
| metric | value | threshold | passed |
|---|---|---|---|
| m | 0.000000 | 0.500000 | no |
"""
    assert got["r2"].endswith("## Failing examples\nNone\n") and "## Configuration\n\n## Metrics" in got["r2"] and got.keys() == {"r1", "r2"}
    assert reports.run_reports(scores.limit(0), manifest).count() == 0


def test_a_query_that_expects_nothing_has_all_of_it(spark):
    expected = spark.createDataFrame([(1, "A-1"), (1, "A-2")], "query_id long, ref string")
    present = spark.createDataFrame([(1, "A-1"), (2, "A-1")], "query_id long, ref string")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: (r.covered, r.total, r.value, r.passed) for r in metrics.structural(expected, present, queries).collect()}
    assert got == {1: (1, 2, 0.5, False), 2: (0, 0, 1.0, True), 3: (0, 0, 1.0, True)}
