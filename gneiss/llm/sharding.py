"""Shards of near-equal bytes by sampled splitters.

Records are keyed by a hash of their text.  A size-weighted sample of keys gives quantile
boundaries of many narrow ranges; the records are range-partitioned by them and every range is
measured in full.  A range that holds more than its share (a hot text, or an unlucky boundary) is
subdivided by id.  The measured pieces, a bounded number, are dealt to shards, largest first to
the emptiest shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm.scratch import stored


def splitters(keyed: DataFrame, ranges: int, sample: int, seed: int) -> np.ndarray:
    """At most ``ranges - 1`` sorted key boundaries, quantiles of a size-weighted sample of about ``sample`` rows."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total:
        return np.empty(0, "int64")
    chance = F.xxhash64(F.lit(seed), "key", "doc_id", "place").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    # A row larger than a sampling step is drawn for each step that it covers, so weights stay true.
    step = max(1.0, total / sample)
    hits = F.floor(F.col("size") / step + chance)
    drawn = keyed.select("key", hits.alias("hits")).filter("hits > 0").toPandas()
    keys = np.sort(np.repeat(drawn["key"].to_numpy("int64"), drawn["hits"].to_numpy("int64")))
    if not len(keys):
        return np.empty(0, "int64")
    at = (np.arange(1, ranges) * len(keys)) // ranges
    return np.unique(keys[at])


def deal(pieces: list[tuple[int, int, int]], shards: int) -> dict[tuple[int, int], int]:
    """(range, piece, bytes) to shards: the largest piece goes to the emptiest shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for r, p, size in sorted(pieces, key=lambda x: (-x[2], x[0], x[1])):
        full, s = heapq.heappop(heap)
        out[r, p] = s
        heapq.heappush(heap, (full + size, s))
    return out


def shard(
    docs: DataFrame, shards: int = 24, ranges_per_shard: int = 128, sample_per_range: int = 24,
    id_col: str = "doc_id", text_col: str = "text", seed: int = 7,
) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 8; null text has none and its CRC-32 is that of no
    bytes.  ``law`` is ``bytes``: shards hold near-equal sizes.  ``slot`` numbers a shard's rows
    from 0 by range, piece, id, key and place.  Equal texts share a range and so a shard, unless
    they overfill it.  Repeated rows are separate rows; a null id is an id like any other;
    an empty table gives no rows.  Only the two named columns are read.

    What reaches the driver is bounded by parameters: ``shards * ranges_per_shard *
    sample_per_range`` sampled keys in expectation, and the sizes of at most
    ``4 * shards * ranges_per_shard`` pieces.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("place"),
        )
    )
    ranges = shards * ranges_per_shard
    bounds = splitters(keyed, ranges, ranges * sample_per_range, seed)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(bounds, b.column("key").to_numpy(), side="right")
            yield b.append_column("range", pa.array(at.astype("int32")))

    placed = keyed.mapInArrow(ranged, "doc_id long, size long, text_crc32 long, key long, place long, range int")
    # At most `ranges` rows: one per range.
    measured = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    share = max(1.0, sum(r["bytes"] for r in measured) / ranges)
    rows_share = max(1.0, sum(r["n"] for r in measured) / ranges)
    # Overfull by bytes or by rows: many short texts are few bytes, but no task numbers more than about its share of rows.
    parts = {r["range"]: max(-int(-r["bytes"] // share) if r["bytes"] > 1.5 * share else 1, -int(-r["n"] // rows_share) if r["n"] > 1.5 * rows_share else 1) for r in measured}
    over = {r["range"]: min(r["n"], parts[r["range"]]) for r in measured if parts[r["range"]] > 1}
    spark = docs.sparkSession
    split = spark.createDataFrame([(k, v) for k, v in over.items()], "range int, parts int")
    cut = placed.join(F.broadcast(split), "range", "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("doc_id", "place"), F.col("parts")), F.lit(0)).cast("int")
    )
    sums = cut.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    to = deal([(r["range"], r["piece"], r["bytes"]) for r in sums], shards)
    start, rows = dict.fromkeys(range(shards), 0), []
    for r in sorted(sums, key=lambda x: (x["range"], x["piece"])):
        s = to[r["range"], r["piece"]]
        rows.append((r["range"], r["piece"], s, start[s]))
        start[s] += r["n"]
    table = spark.createDataFrame(rows, "range int, piece int, shard int, first long")
    # A piece is about 1 / ranges of the bytes or rows at most, so numbering its rows is a small sort in one task.
    number = F.row_number().over(W.partitionBy("range", "piece").orderBy("doc_id", "key", "place"))
    return cut.join(F.broadcast(table), ["range", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + number - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
