"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, a local session gets a temporary folder and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-gneiss-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/gneiss-{uuid.uuid4().hex}"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = folder(spark)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    owners, made = _books(spark)
    made.setdefault(owners[-1], []).append(out)
    return out


def _books(spark: SparkSession) -> tuple[list[str | None], dict[str | None, list[DataFrame]]]:
    """Of a session: whose the tables are that are stored now, and what each owner has stored and not discarded."""
    return spark.__dict__.setdefault("_gneiss_stored", ([None], {}))


@contextmanager
def owned(spark: SparkSession, owner: str) -> Iterator[None]:
    """Tables that the session stores inside are ``owner``'s, for ``sweep``."""
    owners, _ = _books(spark)
    owners.append(owner)
    try:
        yield
    finally:
        owners.pop()


def sweep(spark: SparkSession, owner: str) -> None:
    """Delete all tables of ``owner`` in the session, once nothing that read them is still to be computed."""
    for table in list(_books(spark)[1].get(owner, ())):
        discard(table)


def free_name(wanted: str, columns: Iterable[str]) -> str:
    """``wanted``, with as many underscores before it as none of ``columns`` has that name, whatever its case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number that names each row, and that column's name; written, so that it stays as it is whatever reads it again."""
    place = free_name("place", docs.columns)
    return stored(docs.withColumn(place, F.monotonically_increasing_id())), place


#: Bits of the table that tells which rows may go: at most 2**18 words of 64.
GONE_BITS = 1 << 24


def bit_table(rows: DataFrame, hashed: Column, word: str, bits: str) -> DataFrame:
    """``word, bits``: the bits, of ``GONE_BITS``, that ``hashed`` marks; at most 2**18 rows."""
    bit = F.pmod(hashed, F.lit(GONE_BITS))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    return rows.select(F.shiftright(bit, 6).alias(word), mask.alias("m")).groupBy(word).agg(F.bit_or("m").alias(bits))


def marked(rows: DataFrame, hashed: Column, table: DataFrame, word: str, bits: str) -> tuple[DataFrame, Column]:
    """``rows`` with the columns of ``bit_table`` (sent to all tasks: its size is fixed), and whether a row's bit is marked."""
    bit = F.pmod(hashed, F.lit(GONE_BITS))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    told = rows.withColumn(word, F.shiftright(bit, 6)).join(F.broadcast(table), word, "left")
    return told, F.coalesce(F.col(bits).bitwiseAND(mask), F.lit(0)) != 0


def without(rows: DataFrame, place: str, gone: DataFrame) -> DataFrame:
    """The rows whose ``place`` is not in ``gone``, a written table of that column.

    The places that go mark bits of a table of fixed size.  A row whose bit is not marked stays where it is; the others, those
    that go and as many as share a bit with one, are shuffled, and a join decides.  Where very many rows go, that is all of them.
    """
    word, bits = free_name("word", rows.columns), free_name("bits", rows.columns)
    told, may_go = marked(rows, F.xxhash64(place), bit_table(gone, F.xxhash64(place), word, bits), word, bits)
    decided = told.filter(may_go).select(rows.columns).join(gone.hint("merge"), place, "left_anti")
    return told.filter(~may_go).select(rows.columns).unionByName(decided)


def only(rows: DataFrame, place: str, keep: DataFrame) -> DataFrame:
    """The rows of a ``placed`` table whose place ``keep`` has too, as ``without``."""
    return without(rows, place, stored(rows.select(place).join(keep.select(place).hint("merge"), place, "left_anti")))


def frequent(counts: DataFrame, most: int, n: str = "n") -> tuple[DataFrame, bool]:
    """The rows with the largest counts, ``most`` at most, and whether these are all.

    Counts are grouped by size first, eight groups for each doubling (some 500 numbers for the driver), and as many whole groups are taken
    as fit; so no task or driver sorts the candidates of others.
    """
    size = F.floor(8 * F.log2(n)).cast("int")
    groups = sorted(((r["size"], r["m"]) for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("m")).collect()), reverse=True)
    least, taken = None, 0
    for group, m in groups:
        if taken + m > most:
            break
        least, taken = group, taken + m
    return counts.filter(size >= least if least is not None else F.lit(False)), taken == sum(m for _, m in groups)


def discard(table: DataFrame) -> None:
    """Delete a table that ``stored`` returned, once nothing will read it again."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for tables in _books(spark)[1].values():
        tables[:] = [t for t in tables if t.stored_at != table.stored_at]
