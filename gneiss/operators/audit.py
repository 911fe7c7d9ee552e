"""Paths that must not be published, by a table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "rule int, prefix string, needles array<string>, names array<string>, reason string"
# The private folders, the names of raw files, and the words of private runs.
PRIVATE = ("data/private/", "data/private_runs/", "data/asme_private_outputs/", "data/parser_benchmark/private/", "data/parser_benchmark/asme_private/")
RAW = ["agent_transcripts.json", "raw_responses.jsonl", "prompts.jsonl", "request_log.jsonl"]


def default_rules(spark: SparkSession) -> DataFrame:
    """In order: private folders, private runs among public ones, raw files of private runs, output of a private parser."""
    rows = [(1, p, [], [], "private path") for p in PRIVATE]
    rows += [(2, "data/runs/", ["asme-private"], [], "private run"), (3, "", ["asme", "private"], RAW, "raw private file"), (4, "data/parser_benchmark/", ["asme"], ["output.json"], "private parser output")]
    return spark.createDataFrame(rows, RULES)


def audit_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """``paths`` (path) that break a rule, with ``normalised, rule, reason`` of the first one.

    A rule applies below its ``prefix`` (folders with a slash at their end, or nothing), to paths that hold one of its needles, if it has any, and to files of its
    names, if it has any; case is ignored.  Paths are normalised: slashes once, no dots or slashes at the start.  Each path meets the rules
    by an equi-join on its own prefixes, whatever their number; null paths break none.  Repeated paths are rows of their own.
    """
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "/+", "/"), r"(?<=/)(\./)+", ""), r"^[./]+", "")
    rows = paths.withColumn("normalised", plain).withColumn("at", F.monotonically_increasing_id())
    low = F.lower("normalised")
    parts = F.split(low, "/")
    # All folders above the file, and nothing, which every path begins with.
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    keyed = rows.filter("path is not null").withColumn("prefix", F.explode(F.transform(prefixes, lambda p: F.when(p == "", p).otherwise(F.concat(p, F.lit("/"))))))
    name = F.element_at(parts, -1)
    met = keyed.join(rules.withColumn("prefix", F.lower("prefix")), "prefix").filter(
        ((F.size("needles") == 0) | F.exists("needles", lambda n: F.contains(low, n))) & ((F.size("names") == 0) | F.array_contains(F.col("names"), name))
    )
    first = met.groupBy("at", *paths.columns, "normalised").agg(F.min(F.struct("rule", "reason")).alias("r"))
    return first.select(*paths.columns, "normalised", "r.rule", "r.reason")
