"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.scratch import discard, stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point each vertex's larger (or smaller) neighbours at the smallest vertex among it and its neighbours."""
    near = _both(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("from"))
    if large:
        moved = moved.filter("u > from")
    out = moved.select("u", "v")
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Every vertex points at one other, which points at none: each component is a star around its smallest vertex."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select("v", F.lit(0), F.lit(1)))
    wrong = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or out = 1 and into = 1")
    return wrong.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` for each vertex that has edges and is not the smallest of its component ``v``.

    Alternates large and small stars until each component is one star: about log n rounds, each of
    which keeps at most as many edges as there were.  A round's table is written to the shared folder,
    so lineage stays short.  No vertex's neighbours are gathered: each round takes minima (which are
    combined before they are shuffled) and joins them back.
    """
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(now):
        before, now = now, stored(_star(_star(now, large=True), large=False))
        discard(before)
    return now
