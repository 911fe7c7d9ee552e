"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch is reduced to one row per digest
(map-side partial aggregation, so a group with a third of all rows arrives as one row per task),
anti-joined by sort-merge with the index, and what is new is appended.  A table is fed in two batches, the
smaller ids first, so that the index always holds the smallest id of a digest.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.scratch import folder, only, placed, stored

WHITE = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text with each run of white space replaced by one space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ").cast("binary"), 256)


#: Digests of a bucket when an index is made: one task reads and merges a bucket.
BUCKET_ROWS = 1_000_000
#: Rows of a group of equal texts meet its one row in so many tasks.
SALTS = 16


def buckets_for(rows: int) -> int:
    """Buckets of an index that is to hold so many digests."""
    return max(8, -(-rows // BUCKET_ROWS))


class DigestIndex:
    """Digests seen so far: ``digest string, keep_id long``, one row per digest.

    ``name`` is a table of the session's catalog, whose files are in ``path``: by default a new folder among those that all
    executors share.  Buckets are fixed when it is made, and each append adds sorted files to them.  Appending is a single
    committed write, so a failed or retried job leaves either all of a batch or none of it.
    As a context manager it serves one run and goes with it, failed or not.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = 256, path: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.name):
            self.path = path or folder(spark)
            self.append(spark.createDataFrame([], "digest string, keep_id long"))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, new: DataFrame) -> None:
        """``new``: digest, keep_id; its digests must not be in the index yet."""
        writer = (
            new.select("digest", "keep_id").repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append")
        )
        # The catalog knows the place of a table that it has.
        (writer if self.spark.catalog.tableExists(self.name) else writer.option("path", self.path)).saveAsTable(self.name)

    def add(self, groups: DataFrame) -> None:
        """Append the digests of ``groups`` (digest, keep_id) that the index lacks."""
        self.append(groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti"))

    def drop(self) -> None:
        """Remove the index and its files, for those that serve one run only."""
        told = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").filter("col_name = 'Location'").first()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(told["data_type"])
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()


def _grouped(docs: DataFrame, index: DigestIndex, id_col: str, text_col: str, place: Column) -> DataFrame:
    """Rows that repeat id and text as one: doc_id, digest, copies, the smallest place, first_id, group_size."""
    # Repeated (id, text) rows become one row with a count: nothing after this meets ties.
    # Stored, as the texts would else be digested for the index and again for the result.
    rows = stored(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), place.cast("long").alias("place"))
        .groupBy("doc_id", "digest").agg(F.count("*").alias("copies"), F.min("place").alias("place"))
    )
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    low = F.coalesce(F.col("doc_id") <= middle, F.lit(False)) if middle is not None else F.lit(False)
    for batch in (low, ~low):
        index.add(rows.filter(batch).groupBy("digest").agg(F.min("doc_id").alias("keep_id")))
    sizes = rows.groupBy("digest").agg(F.sum("copies").alias("group_size"))
    kept = index.read().select("digest", F.col("keep_id").alias("first_id")).join(sizes.hint("merge"), "digest")
    # A group's one row goes to several tasks, and its rows to one of these each.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).cast("int"))
    kept = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(kept.hint("merge"), ["digest", "salt"]).drop("salt")


def deduplicate(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    New digests are appended to ``index``.  ``keep_id`` is the id that the index holds for the digest: the
    smallest of the table that brought it.  ``group_size`` counts this table.

    Null text counts as empty.  Among equal texts a null id is kept only if all ids are null.
    Where rows repeat both id and text, one of them is kept and the rest are dropped.
    Only the two named columns are read, so other columns may have any names.  An empty
    table gives no rows and leaves the index as it was, apart from creating it.
    """
    return _grouped(docs, index, id_col, text_col, F.lit(None)).select(
        "doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("n"),
        F.col("first_id").alias("keep_id"), "group_size", F.col("digest").alias("text_sha256"),
    ).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == 1)).alias("kept"), "text_sha256",
    )


def kept_rows(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of equal texts the one with the smallest id, unless an earlier batch had it.

    Adding a batch again keeps the same rows, so a retried run loses nothing.  Ids may be null or repeat, as in ``deduplicate``.
    """
    rows, place = placed(docs)
    keep = _grouped(rows, index, id_col, text_col, F.col(place)).filter(F.col("doc_id").eqNullSafe(F.col("first_id")))
    # ``only`` reads the places now, so the index may go before the rows are read.
    return only(rows, place, keep.select(F.col("place").alias(place))).select(docs.columns)
