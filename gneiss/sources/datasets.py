"""Inputs and logs of evaluations as JSON: trusted tables, golden examples, parsed elements, and what runs were asked and answered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Categories of golden examples.
CATEGORIES = ("calculation", "lookup", "cross_reference", "out_of_domain", "edge_case")
GOLDEN = """id string, query string, category string, expected_refusal boolean, expected_paragraph_refs array<string>, expected_values map<string,double>,
    numeric_tolerance double, expected_materials array<string>, notes string"""
#: Kinds of logs of a run and their columns besides run_id and ts.
LOGS = {
    "prompts": "example_id string, system_prompt string, user_prompt string",
    "raw_responses": "example_id string, response string, retrieved array<string>",
    "request_log": "kind string, request string, response string, latency_ms double, error string",
}


def read_joints(spark: SparkSession, path: str) -> DataFrame:
    """``joint_type, description, rt_level, e`` from a JSON object whose ``joints`` have a map of efficiencies, a row for each entry."""
    raw = spark.read.schema("joints array<struct<type:int,description:string,efficiencies:map<string,decimal(3,2)>>>").json(path, multiLine=True)
    each = raw.select(F.explode("joints").alias("j"))
    return each.select(F.col("j.type").alias("joint_type"), "j.description", F.explode("j.efficiencies").alias("rt_level", "e"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden examples from a JSON array, absent fields with their defaults (no refusal, nothing expected, a tolerance of 0.02).

    An example without an id, a query or a known category, with a negative tolerance, or with another's id refuses the file.
    """
    raw = spark.read.schema(GOLDEN).json(path, multiLine=True)
    out = raw.select(
        "id", "query", "category", F.coalesce("expected_refusal", F.lit(False)).alias("expected_refusal"), F.coalesce("expected_paragraph_refs", F.array().cast("array<string>")).alias("expected_paragraph_refs"),
        F.coalesce("expected_values", F.create_map().cast("map<string,double>")).alias("expected_values"), F.coalesce("numeric_tolerance", F.lit(0.02)).alias("numeric_tolerance"),
        F.coalesce("expected_materials", F.array().cast("array<string>")).alias("expected_materials"), "notes",
    )
    wrong = F.col("id").isNull() | F.col("query").isNull() | ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)) | (F.col("numeric_tolerance") < 0)
    told = out.groupBy("id").agg(F.count("*").alias("n"), F.bool_or(wrong).alias("wrong")).filter("wrong or n > 1").select("id").limit(5).collect()
    if told:
        raise ValueError(f"examples {[r['id'] for r in told]} are incomplete or repeat")
    return out


def expected(golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What examples expect, as rows: references (query_id, ref) and values (query_id, name, value, tolerance)."""
    refs = golden.select(F.col("id").alias("query_id"), F.explode("expected_paragraph_refs").alias("ref"))
    return refs, golden.select(F.col("id").alias("query_id"), F.explode("expected_values").alias("name", "value"), F.col("numeric_tolerance").alias("tolerance"))


def preindexed(spark: SparkSession, path: str, source: DataFrame) -> DataFrame:
    """Parsed elements that ``io.write_elements`` wrote, of files whose content is what they were parsed from.

    ``source``: doc_id, text, the files now.  Elements have a ``source_digest`` (SHA-256 of their file); those of files that have changed or gone are left out,
    so that they are parsed again.
    """
    now = source.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("source_digest"))
    return spark.read.parquet(path).join(now, ["doc_id", "source_digest"], "left_semi")


def write_log(rows: DataFrame, path: str, log: str) -> None:
    """Append rows of a run's log as JSON lines, by run; ``rows``: run_id, ts and the columns of the log, of which some may be missing."""
    fields = [f.split() for f in LOGS[log].split(", ")]
    have = {c.lower() for c in rows.columns}
    columns = [F.col(n).cast(t).alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in fields]
    rows.select("run_id", F.col("ts").cast("timestamp").alias("ts"), *columns).write.mode("append").partitionBy("run_id").json(f"{path}/{log}")


def read_log(spark: SparkSession, path: str, log: str) -> DataFrame:
    return spark.read.schema(f"ts timestamp, {LOGS[log]}, run_id string").json(f"{path}/{log}")
