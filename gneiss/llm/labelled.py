"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids have remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(0).cast("long"))


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str, text_col: str, mod: int = 3, held_out: int = 1) -> DataFrame:
    """``text, label``: labelled rows outside the held-out fold, about ``limit`` at most, drawn by a hash of the id.

    The drawn ids and labels, whose number ``limit`` bounds, are broadcast; texts are not shuffled.
    Rows with a null id or a label other than 0 and 1 are not used; conflicting labels of an id both count.
    """
    usable = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label).cast("int").alias("label")).filter(
        F.col("__id").isNotNull() & F.col("label").isin(0, 1) & (remainder(F.col("__id"), mod) != held_out)
    )
    share = limit / max(limit, usable.count())
    drawn = usable.filter(F.pmod(F.xxhash64(F.lit(label), "__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    return docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(
        F.broadcast(drawn), "__id"
    ).select("text", "label")


def scored(docs: DataFrame, work, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """``doc_id, held_out, score, predicted``; ``work`` maps Arrow batches of (doc_id, text) to (doc_id, score)."""
    scores = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id long, score double")
    return scores.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
