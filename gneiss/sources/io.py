"""Readers and writers: whole-text markdown, keyed upserts, resumable runs, content-addressed look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text``: one row per file; the id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def read_materials(spark: SparkSession, path: str) -> DataFrame:
    """``material, temp, stress, max_temp`` from a JSON array of records with a map of stresses by temperature, a row for each entry."""
    schema = "spec_no string, grade string, max_temp_c int, stress_values_mpa map<string,double>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    key = F.trim(F.concat_ws(" ", "spec_no", "grade"))
    return rows.select(key.alias("material"), F.col("max_temp_c").alias("max_temp"), F.explode("stress_values_mpa").alias("t", "stress")).select(
        "material", F.col("t").cast("int").alias("temp"), "stress", "max_temp"
    )


def write_elements(elements: DataFrame, path: str) -> None:
    """Typed elements as Parquet, by type; nested columns stay nested."""
    elements.write.mode("overwrite").partitionBy("element_type").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables under one path."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``stored`` with the same key; of rows of ``new`` with one key, one stays."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new.dropDuplicates([key]))


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do.  Results of keys that this work does not have belong to another run, which is refused."""
    if not done.join(work.select(key), key, "left_anti").isEmpty():
        raise ValueError("the results are of another set of examples")
    return work.join(done.select(key), key, "left_anti")


def write_run(rows: DataFrame, path: str) -> None:
    """Write results by run; a run written again replaces only itself."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def finish_run(scores: DataFrame, config: DataFrame, path: str) -> None:
    """A run's manifest beside its results: per run its examples and pass rate, its configuration (run_id, config), and ``complete``.

    ``scores``: run_id, example_id, metric, value, passed.  A run without a manifest was not finished.
    """
    example = scores.groupBy("run_id", "example_id").agg(F.bool_and("passed").alias("ok"))
    per = example.groupBy("run_id").agg(F.count("*").alias("n_examples"), F.count_if("ok").alias("n_passed"))
    per.join(config, "run_id", "left").withColumn("complete", F.lit(True)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(f"{path}_manifest")


def cached(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) whose parse is in the cache (digest, ...), joined with it, and those that have to be parsed."""
    keyed = files.withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    return keyed.join(cache, "digest"), keyed.join(cache.select("digest"), "digest", "left_anti")


def dataset_digest(rows: DataFrame, key: str) -> DataFrame:
    """``n, digest`` of a table's rows, whatever their order.

    Rows are digested as JSON with their columns in order of name.  A thousand groups, by a hash of the key, add up their rows'
    digests, and one digest is taken of the groups' sums.
    """
    columns = sorted(rows.columns)
    each = rows.select(F.pmod(F.xxhash64(key), F.lit(1000)).alias("part"), F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("d"))
    # Sums of 64-bit slices of the digests tell groups of rows apart and combine before they are shuffled.
    parts = [F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    groups = each.groupBy("part").agg(F.count("*").alias("n"), *parts)
    text = F.concat_ws(" ", "part", "n", *(f"s{i}" for i in range(4)))
    return groups.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("digest"))


def run_id(started: Column, name: Column, model: Column) -> Column:
    """The time to the second, then the name and the model in lower case with all but letters and digits as dashes."""
    part = lambda c: F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("_", F.date_format(started, "yyyyMMdd'T'HHmmss"), F.nullif(part(name), F.lit("")), F.nullif(part(model), F.lit("")))


def registered(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Join ``content`` with a registry of known digests (``digest, corpus_id``) by SHA-256."""
    return files.withColumn("digest", F.sha2(F.col("content").cast("binary"), 256)).join(registry, "digest", "left")
