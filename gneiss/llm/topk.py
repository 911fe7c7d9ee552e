"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are dealt to a few nodes (slices), each in partitions of its own; a score is the sum of
the slices' partial scores.  A slice's rows are cut into blocks of bounded size, as are the queries, and each
block of queries meets each block of rows once.

1. Each slice lists its k best partial scores per query.  The vectors listed are scored in full; the k-th best
   of these scores is a safe cutoff, as at least k vectors reach it.
2. The cutoff goes back to the slices.  A score that reaches it has a partial score that reaches the cutoff
   divided by the number of slices, so each slice hands over its entries of at least that, and no others.
3. Entries that all slices handed over are scored already and may raise the cutoff.  A partial score that
   was not handed over is below its share, which bounds what the other entries can come to; those that can still
   reach the cutoff fetch their missing slices by a join and are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm.scratch import stored

#: Beyond this, sums of products are not exact in doubles.
EXACT = 2.0**53


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of each component; null vectors and those with a null or non-finite component go."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (
        vectors.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .filter(F.coalesce(good, F.lit(False))).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, "int64") for v in column])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: through doubles where they hold all sums, else through integers."""
    peak = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if peak < EXACT:
        return a.astype("float64") @ b.astype("float64").T
    return a @ b.T


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k largest scores, in any order."""
    k = min(k, scores.shape[1])
    return np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:] if k else np.empty((len(scores), 0), int)


def _scan(queries: pd.DataFrame, rows: pd.DataFrame, k: int, step: int = 128) -> Iterator[pd.DataFrame]:
    """Entries of one slice: the k best of each query without a cutoff, else those of at least the cutoff's share."""
    ids, places, qids = rows["vec_id"].to_numpy(), rows["place"].to_numpy(), queries["query_id"].to_numpy()
    base, q = _matrix(rows["part"]), _matrix(queries["part"])
    for at in range(0, len(q), step):
        own = qids[at : at + step, None] == ids
        partial = _product(q[at : at + step], base)
        if "cutoff" not in queries:
            listed = np.zeros(own.shape, bool)
            np.put_along_axis(listed, _best(np.where(own, -np.inf, partial), k), True, axis=1)
        else:
            listed = partial >= queries["share"].to_numpy("int64")[at : at + step, None]
        i, j = np.nonzero(listed & ~own)
        yield pd.DataFrame({"query_id": qids[at + i], "vec_id": ids[j], "place": places[j], "slice": rows["slice"].iloc[0], "partial": partial[i, j].astype("int64")})


ENTRY = "query_id long, vec_id long, place long, slice int, partial long"


def _entries(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``ENTRY`` of each slice: its blocks of queries meet its blocks of rows."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) and len(right):
            return pd.concat(_scan(left, right, k), ignore_index=True)
        return pd.DataFrame({"query_id": [], "vec_id": [], "place": [], "slice": [], "partial": []}).astype("int64")

    sent = queries.withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))
    here = rows.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    unit = ["dim", "slice", "qb", "rb"]
    return sent.groupBy(unit).cogroup(here.groupBy(unit)).applyInPandas(meet, ENTRY)


def _sliced(vectors: DataFrame, nodes: int) -> DataFrame:
    """One row for each slice of each vector: ``slice, slices, part`` instead of ``v``."""
    cut = vectors.withColumn("slices", F.least(F.lit(nodes), F.col("dim"))).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    edge = lambda i: F.floor(i * F.col("dim") / F.col("slices")).cast("int")
    low, high = edge(F.col("slice")), edge(F.col("slice") + 1)
    return cut.withColumn("part", F.slice("v", low + 1, high - low)).drop("v")


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)


def top_k(
    vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, nodes: int = 2,
    rows_per_block: int = 8192, queries_per_block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest scores of each query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those with
    the query's own id.  Components become ``floor(scale * x)``; scores are exact integers and must fit a
    long.  Null ids, null and empty vectors and vectors with null or non-finite components take no part.
    A score is between vectors of one length: each length is searched by itself.  A repeated row counts each
    time as a candidate and once as a query.  Empty tables, and single rows, give no rows.  Only the two
    named columns are read.
    """
    base = quantised(vectors, id_col, vector_col, scale).withColumn("dim", F.size("v")).filter("dim > 0")
    base = stored(base.withColumn("place", F.monotonically_increasing_id()))
    asked = F.col("vec_id") % every == 0
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("int")
    # One row per length; Spark chooses the join by its size.
    plan = base.groupBy("dim").agg(
        blocks(F.count("*"), rows_per_block).alias("row_blocks"), blocks(F.count_distinct(F.when(asked, F.col("vec_id"))), queries_per_block).alias("query_blocks")
    )
    # Blocks follow from hashes, so they hold about as many as they should and never depend on order.
    rows = stored(_sliced(base, nodes).join(plan, "dim").withColumn("rb", F.pmod(F.xxhash64("place"), F.col("row_blocks")).cast("int")))
    once = base.filter(asked).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    queries = stored(
        _sliced(once, nodes).join(plan, "dim").select(
            F.col("vec_id").alias("query_id"), "dim", "slice", "slices", "part", "row_blocks", F.pmod(F.xxhash64("vec_id"), F.col("query_blocks")).cast("int").alias("qb")
        )
    )
    here = rows.select("dim", "slice", "rb", "query_blocks", "vec_id", "place", "part")

    def scored(wanted: DataFrame) -> DataFrame:
        """``query_id, vec_id, place, found`` of (query_id, vec_id, place, slice): the sum of the slices asked for."""
        mine = queries.select("query_id", "dim", "slice", F.col("part").alias("q"))
        parts = wanted.join(rows.select("dim", "place", "slice", "part"), ["place", "slice"]).join(mine, ["query_id", "dim", "slice"])
        return parts.groupBy("query_id", "vec_id", "place").agg(F.sum(_dot("part", "q")).alias("found"))

    # Phase 1.
    in_slice = W.partitionBy("query_id", "slice").orderBy(F.desc("partial"), "place")
    listed = _entries(queries, here, k).withColumn("n", F.row_number().over(in_slice)).filter(F.col("n") <= k)
    listed = listed.select("query_id", "vec_id", "place").distinct()
    # A query's id may stand for vectors of several lengths; each is a search of its own, and the best of all are kept.
    slices = rows.select("place", "slice")
    best = W.partitionBy("query_id").orderBy(F.desc("found"), "vec_id")
    full = scored(listed.join(slices, "place"))
    cutoff = full.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("query_id", F.col("found").alias("cutoff"))
    # Without k listed vectors there is no cutoff and every entry is sufficient.
    least = F.lit(-(1 << 62)).cast("long")
    cut = stored(queries.join(cutoff, "query_id", "left").withColumn("cutoff", F.coalesce("cutoff", least)).withColumn("share", _share()))

    # Phase 2.
    handed = _entries(cut, here, k).groupBy("query_id", "vec_id", "place").agg(F.sum("partial").alias("found"), F.collect_list("slice").alias("known"))
    bounds = cut.select("query_id", "dim", "slices", "cutoff", "share").distinct()
    handed = stored(handed.join(base.select("place", "dim"), "place").join(bounds, ["query_id", "dim"]))

    # Phase 3.
    whole = handed.filter("size(known) = slices").select("query_id", "vec_id", "place", "found")
    higher = whole.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("query_id", F.col("found").alias("higher"))
    most = F.when(F.col("cutoff") == least, F.lit(None)).otherwise(F.col("found") + (F.col("slices") - F.size("known")) * (F.col("share") - 1))
    open_ = handed.filter("size(known) < slices").join(higher, "query_id", "left").filter(most.isNull() | (most >= F.greatest("cutoff", F.coalesce("higher", "cutoff"))))
    missing = open_.select("query_id", "vec_id", "place", F.explode(F.array_except(F.sequence(F.lit(0), F.col("slices") - 1), "known")).alias("slice"))
    rest = scored(missing).withColumnRenamed("found", "more").join(open_.select("query_id", "place", "found"), ["query_id", "place"])
    totals = whole.unionByName(rest.select("query_id", "vec_id", "place", (F.col("found") + F.col("more")).alias("found")))
    return (
        totals.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("found").alias("score"))
    )


def _share() -> Column:
    """The cutoff divided by the number of slices, rounded up."""
    low = F.pmod(F.col("cutoff"), F.col("slices"))
    return F.expr("(cutoff - pmod(cutoff, slices)) div slices") + (low > 0).cast("long")
