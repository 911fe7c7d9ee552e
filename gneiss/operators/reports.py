"""Reports of evaluation runs as Markdown, one text per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.session import checkpointed


def _table(head: str, key: list[str], line: Column) -> Column:
    """A Markdown table of a group's rows, in order of ``key``."""
    rows = F.array_sort(F.collect_list(F.struct(*key, line.alias("line"))))
    return F.concat(F.lit(f"{head}\n{'|---' * (head.count('|') - 1)}|\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n"))


def run_reports(scores: DataFrame, manifest: DataFrame, worst: int = 10) -> DataFrame:
    """``run_id, report`` of each run in ``scores``: pass rate, configuration, metrics over all examples and by category, and the worst failures.

    ``scores``: run_id, example_id, category, metric, value, threshold, passed; ``manifest``: run_id, field, value.  An example passes if all its metrics do;
    failures come with their metrics, those of the lowest mean first, ``worst`` of each run at most (the report's limit).  A metric that an
    example has more than once counts as its mean, and passes if it always does.  A run without a manifest has an empty configuration.
    """
    # One shuffle brings together what an example has; an example is then a row with its few metrics, written, as each part of a report reads it.
    each = scores.repartition("run_id", "example_id").groupBy("run_id", "example_id", "metric").agg(
        F.min("category").alias("category"), F.round(F.avg("value"), 6).alias("value"), F.max("threshold").alias("threshold"), F.bool_and("passed").alias("passed")
    )
    examples = checkpointed(each.groupBy("run_id", "example_id", "category").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.bool_and("passed").alias("ok"), F.collect_list(F.struct("metric", "value", "threshold", "passed")).alias("metrics")
    ))
    each = examples.select("run_id", "example_id", "category", F.inline("metrics"))
    sets = each.groupingSets([["run_id", "metric"], ["run_id", "category", "metric"]], "run_id", "category", "metric").agg(
        F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.round(F.avg("value"), 6).alias("mean"), F.max("threshold").alias("threshold"), F.grouping("category").alias("all_categories"),
    )
    passed = F.format_string("%d/%d", "n_passed", "n")
    metric = F.format_string("| %s | %.6f | %.6f | %s |", "metric", "mean", "threshold", passed)
    metrics = sets.filter("all_categories = 1").groupBy("run_id").agg(_table("| metric | mean | threshold | passed |", ["metric"], metric).alias("metrics"))
    line = F.format_string("| %s | %s | %.6f | %s |", F.coalesce("category", F.lit("")), "metric", "mean", passed)
    categories = sets.filter("all_categories = 0").groupBy("run_id").agg(_table("| category | metric | mean | passed |", ["category", "metric"], line).alias("categories"))
    rate = examples.groupBy("run_id").agg(F.count_if("ok").alias("k"), F.count("*").alias("n"))
    order = W.partitionBy("run_id").orderBy("mean", "example_id")
    failing = examples.filter("not ok").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= worst)
    row = F.format_string("| %s | %.6f | %.6f | %s |", "metric", "value", "threshold", F.when(F.col("passed"), "yes").otherwise("no"))
    listed = each.join(failing.select("run_id", "example_id", "place"), ["run_id", "example_id"]).groupBy("run_id", "place", "example_id").agg(
        F.min("category").alias("category"), _table("| metric | value | threshold | passed |", ["metric"], row).alias("t")
    )
    text = F.concat(F.lit("### "), F.col("example_id").cast("string"), F.lit(" ("), F.coalesce("category", F.lit("")), F.lit(")\n"), "t")
    failures = listed.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]), "").alias("failures"))
    field = F.format_string("| %s | %s |", "field", F.coalesce("value", F.lit("")))
    configuration = manifest.groupBy("run_id").agg(_table("| field | value |", ["field"], field).alias("configuration"))
    out = rate.join(configuration, "run_id", "left").join(metrics, "run_id").join(categories, "run_id").join(failures, "run_id", "left")
    head = F.format_string("# Run %s\n\nPassed: %d of %d examples\n\n", "run_id", "k", "n")
    return out.select("run_id", F.concat(
        head, F.lit("## Configuration\n"), F.coalesce("configuration", F.lit("")), F.lit("\n## Metrics\n"), "metrics", F.lit("\n## Categories\n"), "categories",
        F.lit("\n## Failing examples\n"), F.coalesce("failures", F.lit("None\n")),
    ).alias("report"))


def by_run(aggregate: DataFrame) -> DataFrame:
    """``metric, means``: for each metric (run_id, metric, mean) a map from run to mean, whatever runs there are."""
    return aggregate.groupBy("metric").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("run_id", "mean")))).alias("means"))
