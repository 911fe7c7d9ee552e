"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each document of a source gets the same expected number of copies, target / source size.  The
whole part is taken at once; the fractions are rounded in pairs.  A pair moves words (fraction
times size) from one document to the other until one of the two is taken or left as a whole, so
the words of the pair, and with them those of the source, never change.  A block of documents
ends with one unresolved document, which joins those of other blocks at the next level of the
reduction tree; one document per source is left at the root and is rounded to the nearer side.
The words taken from a source so differ from its target by at most half of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
MAX_COPIES = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, size``.

    Sources in code-point order, null last, weigh 1, 2, 3, 1, ...  The targets share all words by
    weight; none is above three times its source's size, and what exceeds that goes to the rest
    by weight.  That is one water level: with sources ordered by ``cap / weight``, those below
    the level get their cap and the others level times weight.  One row per source is ordered
    in one task; documents are not.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = by_source.select(
        "source", "source_size",
        ((F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % 3 + 1).alias("weight"),
    ).withColumn("cap", MAX_COPIES * F.col("source_size"))
    ordered = W.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    everything = W.partitionBy()
    levels = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("weight").over(ordered.rowsBetween(0, W.unboundedFollowing)).alias("open_weight"),
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    # The first source in order whose cap is not below its level sets the level for it and all after it.
    holds = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min_by(F.when(holds, F.col("level")), F.when(holds, F.col("cap") / F.col("weight"))).over(everything)
    return levels.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target")
    )


def _chance(seed: int, level: int, *cols: str) -> Column:
    """A number in [0, 1) that depends on the row alone, so reruns agree."""
    return (F.xxhash64(F.lit(seed), F.lit(level), *cols).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52)))


def _pair(acc: Column, e: Column) -> Column:
    """One pairing: ``acc.open`` and ``e`` trade words until one of the two is resolved."""
    a = acc["open"]
    fa, fb, sa, sb = a["part"], e["part"], a["size"].cast("double"), e["size"].cast("double")
    # Words that can move to a (b gives until it is empty or a is full), and to b.
    up = F.least((1 - fa) * sa, fb * sb)
    down = F.least(fa * sa, (1 - fb) * sb)
    to_a = e["chance"] * (up + down) < down
    a_full, b_full = up == (1 - fa) * sa, down == (1 - fb) * sb
    # Which one is resolved, and with what.
    a_done = F.when(to_a, a_full).otherwise(~b_full)
    done_up = F.when(to_a, a_full).otherwise(b_full)
    moved = F.when(to_a, up).otherwise(-down)
    part_a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fa + moved / sa))
    part_b = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fb - moved / sb))
    done = F.when(a_done, a).otherwise(e)
    stays = F.when(a_done, e).otherwise(a)
    part = F.when(a_done, part_b).otherwise(part_a)
    return F.struct(
        F.when(a.isNull(), e).otherwise(stays.withField("part", part)).alias("open"),
        F.when(a.isNull(), acc["done"])
        .otherwise(F.concat(acc["done"], F.array(done.withField("part", F.when(done_up, 1.0).otherwise(0.0)))))
        .alias("done"),
    )


ITEM = "struct<doc_id:bigint,size:bigint,part:double,chance:double>"


def _reduce(rows: DataFrame) -> DataFrame:
    """Resolve all but one document of each (source, block): its ``done`` items and its ``open`` one."""
    items = F.array_sort(F.collect_list(F.struct("doc_id", "size", "part", "chance")))
    start = F.struct(F.lit(None).cast(ITEM).alias("open"), F.array().cast(f"array<{ITEM}>").alias("done"))
    return rows.groupBy("source", "block").agg(items.alias("items")).select(
        "source", "block", F.aggregate("items", start, _pair).alias("r")
    ).select("source", "block", "r.open", "r.done")


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``nth``, from 1 among rows of a (key, doc_id, size) group.

    Rows are counted in each of Spark's partitions (the upper bits of ``place``) first, so that a group is numbered by
    many tasks; a group has few counts, one for each partition.
    """
    group = ["key", "doc_id", "size"]
    part = F.shiftright("place", 33)
    rows = rows.withColumn("at", part)
    counts = rows.groupBy(*group, "at").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy(*group).orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).withColumnsRenamed({c: f"_{c}" for c in (*group, "at")})
    same = F.lit(True)
    for c in (*group, "at"):
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    nth = F.row_number().over(W.partitionBy(*group, "at").orderBy("place"))
    return rows.withColumn("nth", nth).join(counts, same).withColumn("nth", F.col("nth") + F.col("before")).drop("at", "c", "before", *(f"_{c}" for c in (*group, "at")))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    fan_in: int = 128, seed: int = 20240229, place_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    ``size`` is the number of words (null text: 0), ``taken`` is ``copies * size``, ``copies`` is at
    most 3.  Documents without words are never taken, nor is anything where no text has words.
    A null source is a source of its own.  A null id is an id like any other.  Rows that repeat
    are separate rows.  A very long text is an item like others, which may be rounded away from its source's target by half of
    its words.  An empty table gives no rows.  Only the named columns are read.
    With ``place_col``, a column of distinct numbers, that column comes too.

    Rows that repeat source, id and size are one item with a count: it takes as many as it can whole, and at most one of
    its rows is rounded.  Items are dealt to blocks of about ``fan_in`` by a hash of id and size within a source, so
    a source with a third of all rows is spread like the others.
    """
    # Read and counted once.  The place only tells repeated rows apart; draws and blocks depend on id and size.
    sized = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"), (F.col(place_col) if place_col else F.monotonically_increasing_id()).alias("place"),
        ).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    )
    shares = targets(sized)
    groups = stored(sized.groupBy("key", "doc_id", "size").agg(F.count("*").alias("m")))
    counts = groups.groupBy("key").agg(F.count("*").alias("n"))
    # A few values per source; the joins are Spark's to choose by size (AQE splits a hot source).
    plan = stored(shares.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).join(counts, "key").select("key", "source_size", "target", "n"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = (
        groups.join(plan, "key").withColumn("rate", F.least(rate, F.lit(float(MAX_COPIES))))
        .withColumn("whole", F.when(F.col("size") > 0, F.floor("rate")).otherwise(0))
        .withColumn("all", F.when(F.col("size") > 0, (F.col("rate") - F.floor("rate")) * F.col("m")).otherwise(0.0))
        .withColumn("more", F.floor("all")).withColumn("part", F.col("all") - F.floor("all"))
    )
    most = plan.agg(F.max("n")).first()[0] or 0
    level, rows = 0, base.filter("part > 0").select(
        F.col("key").alias("source"), "doc_id", "size", "part",
        F.pmod(F.xxhash64("doc_id", "size"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / fan_in))).alias("block"),
    )
    resolved: list[DataFrame] = []
    while True:
        drawn = rows.withColumn("chance", _chance(seed, level, "doc_id", "size"))
        reduced = stored(_reduce(drawn))
        resolved.append(reduced.select("source", F.explode("done").alias("d")).select("source", "d.doc_id", "d.size", "d.part"))
        last = reduced.select("source", "block", "open.*")
        if most <= fan_in:
            resolved.append(last.select("source", "doc_id", "size", F.when(F.col("part") >= 0.5, 1.0).otherwise(0.0).alias("part")))
            break
        most = -(-most // fan_in)
        level += 1
        rows = last.select("source", "doc_id", "size", "part", F.floor(F.col("block") / fan_in).alias("block"))
    taken = resolved[0]
    for more in resolved[1:]:
        taken = taken.unionByName(more)
    extra = taken.filter("part = 1").select(F.col("source").alias("x_key"), F.col("doc_id").alias("x_id"), F.col("size").alias("x_size"), F.lit(1).alias("extra"))
    same = (F.col("key") == F.col("x_key")) & F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("size") == F.col("x_size"))
    decided = stored(
        base.join(extra, same, "left").select(
            F.col("key").alias("g_key"), F.col("doc_id").alias("g_id"), F.col("size").alias("g_size"), "m", "source_size", "target", "whole",
            (F.col("more") + F.coalesce("extra", F.lit(0))).alias("more"),
        )
    )
    here = (F.col("key") == F.col("g_key")) & F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("size") == F.col("g_size"))
    met = sized.join(decided, here)
    # Only rows of groups in which some but not all get one more need numbers.
    some = (F.col("more") > 0) & (F.col("more") < F.col("m"))
    out = met.filter(~some).withColumn("nth", F.lit(1).cast("long")).unionByName(_numbered(met.filter(some)))
    copies = (F.col("whole") + (F.col("nth") <= F.col("more")).cast("int")).cast("long")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"),
        *([F.col("place").alias(place_col)] if place_col else []),
    )
