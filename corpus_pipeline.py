"""The corpus pipeline: documents in, encoded documents out, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
``documents``.  ``run`` writes each stage's rows as Parquet to the shared folder and reads them back, so a lost
executor costs no earlier stage.  A stage deletes what the stage before it kept for its rows, so these must have been
written by then.

In every stage null and empty texts are rows like any other; texts are read whole; ids may be null or repeat, as rows
are told apart by their place; extra columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import bpe, exact_dedup, jaccard, mixing, scratch, toxicity
from gneiss.llm.scratch import free_name, only, placed, stored

#: Rows of a batch that Python workers get, in all stages.
BATCH_ROWS = 1000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.sweep(spark, "pipeline")
        # A batch of whole texts is held by a worker and by its executor at once.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        with scratch.owned(spark, "pipeline"):
            return work(spark, docs, sf_dir)

    return stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts as toxic go; all others stay, and without labels, or for null texts, none go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return toxicity.clean_rows(docs, model)


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to white space; null counts as empty) the one with the smallest id stays, of equal ids one; null ids come last."""
    with exact_dedup.DigestIndex(spark, buckets=exact_dedup.buckets_for(docs.count())) as index:
        return exact_dedup.kept_rows(docs, index)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the one with the smallest id stays; texts without words are in none."""
    rows, place = placed(docs)
    keep = jaccard.join(rows, k=5, num=80, den=100, place_col=place).filter("first").select(place)
    return only(rows, place, keep).select(docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three rows, or none; texts without words are never taken.  A null source is a source."""
    rows, place = placed(docs)
    copies = free_name("copies", docs.columns)
    taken = mixing.mix(rows, place_col=place).filter("copies > 0").select(place, F.col("copies").alias(copies))
    each = rows.join(taken, place).select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(copies))
    return each.select(docs.columns)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row's text, and digests of the ids and of what they decode to; a null text has no ids."""
    # Fewer words and states than by default, and none after a task: the stages share their executors' memory.
    out = bpe.code(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, limit=80_000, keep=False)
    return out.drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: A trained classifier, dependent rounding and byte-pair merges are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
