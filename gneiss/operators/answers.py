"""Prompts, deterministic answers and evidence checks over ranked hits.

``hits``: query_id, doc_id, rank and what is known of the document; texts are joined only here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A prompt quotes so much of a source, a summary line so much of its first line.
QUOTE, LINE = 1200, 240


def prompts(hits: DataFrame, kinds: list[str]) -> DataFrame:
    """``query_id, prompt``: hits (with ``kind, text``) grouped by kind in the given order, then by rank; long texts are cut with an ellipsis."""
    order = F.coalesce(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), F.lit(0))
    cut = F.when(F.length("text") > QUOTE, F.concat(F.substring("text", 1, QUOTE), F.lit("…"))).otherwise(F.coalesce("text", F.lit("")))
    line = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), cut)
    parts = F.array_sort(F.collect_list(F.struct(F.when(order == 0, len(kinds) + 1).otherwise(order).alias("o"), "rank", line.alias("line"))))
    return hits.groupBy("query_id").agg(parts.alias("p")).select("query_id", F.array_join("p.line", "\n").alias("prompt"))


def summaries(hits: DataFrame, sources: int = 4) -> DataFrame:
    """``query_id, place, ref, line``: the first line that is not blank of each of the best ``sources`` different references."""
    own = hits.withColumn("n", F.row_number().over(W.partitionBy("query_id", "ref").orderBy("rank"))).filter("n = 1")
    placed = own.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("place") <= sources)
    first = F.trim(F.regexp_extract("text", r"(?:^|\n)[ \t]*([^ \t\n][^\n]*)", 1))
    return placed.select("query_id", "place", "ref", F.substring(first, 1, LINE).alias("line"))


def covered(hits: DataFrame, required: dict[str, str]) -> DataFrame:
    """``query_id`` and for each required name whether a hit meets its condition (SQL over the hits), with ``complete``: all are met."""
    out = hits.groupBy("query_id").agg(*(F.bool_or(F.expr(condition)).alias(name) for name, condition in required.items()))
    return out.withColumn("complete", F.expr(" and ".join(required)))


def resolve(cited: DataFrame, index: DataFrame) -> DataFrame:
    """``cited`` with ``resolved, depth``: the nearest known reference on the way up, dropping ``(x)`` suffixes one by one.

    ``index``: ref, one row each.  Distinct references climb, not every citation.
    """
    ladder = cited.select("ref").distinct().withColumn("steps", F.size(F.regexp_extract_all("ref", F.lit(r"\([^)]*\)"), F.lit(0))))
    rungs = ladder.select("ref", F.explode(F.sequence(F.lit(0), "steps")).alias("depth")).withColumn(
        "rung", F.expr(r"regexp_replace(ref, concat('(\\([^)]*\\)){', depth, '}$'), '')")
    )
    best = rungs.join(index.select(F.col("ref").alias("rung")), "rung").groupBy("ref").agg(F.min_by("rung", "depth").alias("resolved"), F.min("depth").alias("depth"))
    return cited.join(best, "ref", "left")
