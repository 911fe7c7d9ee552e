"""Examples are brought together once."""

from pyspark.sql import functions as F

from gneiss.operators import reports


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_report_reads_stored_examples(spark, monkeypatch):
    stored, write = [], reports.checkpointed if hasattr(reports, "checkpointed") else None
    monkeypatch.setattr(reports, "checkpointed", lambda df: stored.append(_exchanges(df)) or write(df))
    rows = [("r", i, "c" if i % 2 else None, m, 0.25 * i, 0.5, i > 1) for i in range(4) for m in ("m1", "m2")]
    scores = spark.createDataFrame(rows, "run_id string, example_id long, category string, metric string, value double, threshold double, passed boolean")
    out = reports.run_reports(scores, scores.select("run_id", F.lit("f").alias("field"), F.lit("v").alias("value")).limit(1)).first()["report"]
    assert stored == [1]
    assert "Passed: 2 of 4 examples" in out and "| m1 | 0.375000 | 0.500000 | 2/4 |" in out and "| c | m2 | 0.500000 | 1/2 |" in out and out.index("### 0 ()") < out.index("### 1 (c)")
