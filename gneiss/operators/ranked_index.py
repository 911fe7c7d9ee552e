"""A stored ranked index: postings in blocks with what bounds their scores, and exact top-k that leaves most blocks unread.

Tables below one folder: ``blocks`` (``kind`` 0: a term's postings, 1: content terms that are no terms, 2: totals) and ``terms``.
The corpus is tokenised once, when the index is built; searches read the blocks of their own terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gneiss.operators.retrieval import CONTENT_TERM, STOPWORDS, content_terms, terms, top
from gneiss.session import checkpointed, shared_folder

#: Postings of a block, and postings that a task holds before it passes them on.
BLOCK, HELD = 512, 1 << 20
#: Postings of a query's rarest terms that give the first score to beat.
SEED = 8192
#: Bounds are compared with room for the rounding of sums.
ROOM = 1e-6

PARTS = "kind int, term string, salt long, postings binary, n_docs long, n_terms long"
BLOCKS = "kind int, term string, n long, most int, least int, doc_ids array<long>, tfs array<int>, lengths array<int>, n_docs long, n_terms long"
#: A posting between two tasks: document, frequency, length of the document.
POSTING = np.dtype([("doc_ids", "<i8"), ("tfs", "<i4"), ("lengths", "<i4")])

#: What a byte of a text is in a term, and 0 where it is in none.
LOWER = np.zeros(256, "uint8")
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789-":
    LOWER[_c] = LOWER[bytes([_c]).upper()[0]] = _c
#: The only characters beyond ASCII that become ASCII in lower case, in UTF-8.
ODD = ("\u0130".encode(), "\u212a".encode())


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins, the end last."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, "int64")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "int64")
    return np.frombuffer(data or b"", "uint8")[at[0] : at[-1]], at - at[0]


def _coded(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, bool]:
    """The terms of all texts in order, how many each text has, and whether they are those of the texts as they stand but for the case of ASCII letters.

    Terms are runs of bytes, found in all texts at once; texts with a character of ``ODD`` are lower-cased one by one before.
    """
    data, at = _bytes(texts)
    raw = data.tobytes()
    plain = not any(c in raw for c in ODD)
    if not plain:
        data, at = _bytes(pa.array([(t or "").lower() for t in texts.to_pylist()], pa.string()))
    low = LOWER[data]
    inside = low != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # A text that begins with a term does not go on with that of the text before.
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(low))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    first = np.flatnonzero(begins)
    offsets = np.concatenate((np.zeros(1, "int64"), np.cumsum(np.flatnonzero(ends) + 1 - first, dtype="int64")))
    found = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(low[inside]))
    return found.dictionary_encode(), np.diff(np.searchsorted(first, at)), plain


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings by term of what a task reads, its content terms, and how many documents and terms it met."""
    content, stop = re.compile(CONTENT_TERM).findall, frozenset(STOPWORDS)
    # The terms of each slice of a batch, and whether they are as they stand; codes of all slices follow each other until they are passed on.
    known: list[tuple[pa.Array, bool]] = []
    vocabulary: set[str] = set()
    held: list[np.ndarray] = []
    size = codes = n_docs = n_terms = 0

    def rows(kind: int, names: pa.Array, salts: np.ndarray, offsets: np.ndarray, values: np.ndarray, docs: np.ndarray, count: int = 0) -> pa.RecordBatch:
        n = len(names)
        packed = np.empty(values.shape[1], POSTING)
        for i, c in enumerate(POSTING.names):
            packed[c] = values[i]
        lists = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((offsets * POSTING.itemsize).astype("int32")), pa.py_buffer(packed)])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind), pa.int32()), names.cast(pa.string()), pa.array(salts, pa.int64()), lists, pa.array(docs, pa.int64()), pa.array(np.full(n, count), pa.int64())],
            ["kind", "term", "salt", "postings", "n_docs", "n_terms"],
        )

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            merged = pa.concat_arrays([names for names, _ in known]).dictionary_encode()
            to, as_is = merged.indices.to_numpy(), np.zeros(len(merged.dictionary), "int64")
            as_is[to[np.repeat([plain for _, plain in known], [len(names) for names, _ in known])]] = 1
            every = np.concatenate(held, axis=1)
            held.clear()
            every[0] = to[every[0]]
            by = np.lexsort((every[1], every[0]))
            code, values = every[0, by], every[1:, by]
            del every, by
            at = np.arange(len(code))
            new = np.concatenate(([True], code[1:] != code[:-1]))
            cut = new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % BLOCK == 0)
            first = np.flatnonzero(cut)
            offsets = np.append(first, len(code))
            # Rows that need no others to be a block go wherever their first document says, so a frequent term meets no single task.
            full = np.diff(offsets) >= BLOCK // 2
            yield rows(0, merged.dictionary.take(pa.array(code[first])), np.where(full, 1 + np.abs(values[0, first]), 0), offsets, values, as_is[code[first]])
        if vocabulary:
            words = sorted({w.lower() for w in vocabulary} - stop)
            yield rows(1, pa.array(words, pa.string()), np.zeros(len(words), int), np.zeros(len(words) + 1, int), np.zeros((3, 0), int), np.zeros(len(words), int))

    for whole in batches:
        for b in (whole.slice(at, 1024) for at in range(0, whole.num_rows, 1024)):
            coded, lengths, plain = _coded(b.column(1))
            if not plain:
                for t in b.column(1).to_pylist():
                    vocabulary.update(content(t or ""))
            n_docs, n_terms = n_docs + len(lengths), n_terms + int(lengths.sum())
            n = len(coded.dictionary)
            if n:
                pair, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * n + coded.indices.to_numpy(), return_counts=True)
                known.append((coded.dictionary, plain))
                doc = pair // n
                held.append(np.stack((codes + pair % n, b.column(0).to_numpy()[doc], tf, lengths[doc])))
                size, codes = size + len(pair), codes + n
            if size >= HELD:
                yield from out()
                known.clear()
                vocabulary.clear()
                size = codes = 0
    yield from out()
    yield rows(2, pa.array([""]), np.zeros(1, int), np.zeros(2, int), np.zeros((3, 0), int), np.full(1, n_docs), n_terms)


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a term, in sorted order, as blocks of about ``BLOCK`` postings."""
    for b in batches:
        if not b.num_rows:
            continue
        kind, names = b.column("kind").to_numpy(), np.array(b.column("term").to_pylist(), object)
        packed = b.column("postings").cast(pa.large_binary())
        at = np.frombuffer(packed.buffers()[1], "int64")[packed.offset : packed.offset + len(packed) + 1]
        offsets = (at - at[0]) // POSTING.itemsize
        every = np.frombuffer(packed.buffers()[2] or b"", "uint8")[at[0] : at[-1]].view(POSTING)
        values = [np.ascontiguousarray(every[c]) for c in POSTING.names]
        new = np.concatenate(([True], (kind[1:] != kind[:-1]) | (names[1:] != names[:-1])))
        start = np.maximum.accumulate(np.where(new, offsets[:-1], 0))
        block = (offsets[:-1] - start) // BLOCK
        # Words of the vocabulary come from many tasks; neighbours are one.
        first = np.flatnonzero(new | ((np.concatenate(([0], block[:-1])) != block) & (kind == 0)) | (kind == 2))
        cut = np.append(offsets[first], offsets[-1])
        some = np.diff(cut) > 0
        most, least = np.zeros(len(first), "int32"), np.zeros(len(first), "int32")
        if some.any():
            most[some], least[some] = np.maximum.reduceat(values[1], cut[:-1][some]), np.minimum.reduceat(values[2], cut[:-1][some])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(kind[first]), pa.array(names[first], pa.string()), pa.array(np.diff(cut), pa.int64()), pa.array(most), pa.array(least),
                *(_lists(cut, v, t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.int32()), strict=True)),
                pa.array(np.maximum.reduceat(b.column("n_docs").to_numpy(), first)), b.column("n_terms").take(pa.array(first)),
            ],
            [c.split()[0] for c in BLOCKS.split(", ")],
        )


class RankedIndex:
    """The index in a folder that all executors share; ``build`` makes one."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
        self.blocks = blocks.filter("kind = 0").select("term", "n", "most", "least", "doc_ids", "tfs", "lengths")
        self.terms = spark.read.schema("term string, df long, most int, least int, plain boolean").parquet(f"{path}/terms")
        # A content term is a term without the hyphens that it begins with, but where lower case has made letters of other characters.
        word = F.regexp_replace("term", "^-+", "")
        words = self.terms.filter("plain").select(word.alias("term")).filter((F.length("term") > 1) & ~F.col("term").isin(STOPWORDS))
        self.vocabulary = words.unionByName(blocks.filter("kind = 1").select("term")).distinct()
        told = blocks.filter("kind = 2").agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("m")).first()
        self.n_docs, self.mean = told["n"], told["m"] / told["n"] if told["n"] else 0.0

    @classmethod
    def build(cls, docs: DataFrame, path: str | None = None) -> RankedIndex:
        """``docs``: doc_id, text.  Ids are unique; rows without one are not indexed; null texts are documents without terms.

        A task inverts what it reads; rows of a term that are short of a block meet in one task, where they are at most ``BLOCK / 2``
        of every ``HELD`` postings of the corpus, and are joined up as they come, never held together.
        """
        path = path or shared_folder(docs.sparkSession)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
        parts = rows.mapInArrow(_invert, PARTS).repartition("kind", "term", "salt").sortWithinPartitions("term", "kind")
        # Not partitioned by kind, for which every block would be sorted again: hardly any is of another kind than 0.
        parts.mapInArrow(_join_up, BLOCKS).write.parquet(f"{path}/blocks", compression="zstd")
        blocks = docs.sparkSession.read.schema(BLOCKS).parquet(f"{path}/blocks").filter("kind = 0")
        blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"), F.min("least").alias("least"), F.max(F.col("n_docs") > 0).alias("plain")).write.parquet(f"{path}/terms")
        return cls(docs.sparkSession, path)

    def search(self, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """``query_id, doc_id, rank, score``: the k best documents by BM25, those with a positive score, ties to the smaller id.

        ``queries``: query_id, text; terms count with multiplicity.  No document that belongs to a result is left out:

        * the postings of a query's rarest terms give a score that its k-th document has at least;
        * terms whose bounds add up to less need not be tried, as a document with no other term cannot get there; blocks of the
          others are read where their own bound and those of all other terms can;
        * documents that can still get there meet the terms that were not tried, in one join on document and term.

        So a frequent word is looked up for the few documents that remain, and never listed for each query that has it.
        """
        if not self.n_docs or not self.mean:
            return queries.select("query_id", F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("rank"), F.lit(0.0).alias("score")).limit(0)

        def part(tf: Column, length: Column) -> Column:
            return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / self.mean))

        def postings(told: DataFrame) -> DataFrame:
            rows = told.select("query_id", "w", F.inline(F.arrays_zip("doc_ids", "tfs", "lengths")))
            return rows.groupBy("query_id", F.col("doc_ids").alias("doc_id")).agg(F.sum(F.col("w") * part(F.col("tfs"), F.col("lengths"))).alias("partial"))

        def to_beat(scored: DataFrame, name: str) -> DataFrame:
            # Filled lists only: with fewer documents every score counts.
            best = top(scored, k, "partial").groupBy("query_id").agg(F.count("*").alias("n"), F.min("partial").alias("p"))
            return best.select("query_id", F.when(F.col("n") == k, F.col("p")).otherwise(0.0).alias(name))

        asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        idf = F.log((self.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        known = asked.join(self.terms, "term").withColumn("w", F.col("times") * idf)
        known = checkpointed(known.withColumn("bound", F.col("w") * part(F.col("most"), F.col("least"))).select("query_id", "term", "df", "w", "bound"))
        earlier = F.sum("df").over(W.partitionBy("query_id").orderBy("df", "term"))
        seeds = known.withColumn("upto", earlier).filter((F.col("upto") <= SEED) | (F.col("upto") == F.col("df")))
        least = to_beat(postings(seeds.join(self.blocks, "term")), "beat")
        up = W.partitionBy("query_id").orderBy("bound", "term")
        told = known.join(least, "query_id", "left").fillna(0.0, ["beat"]).withColumn("upto", F.sum("bound").over(up)).withColumn("all", F.sum("bound").over(W.partitionBy("query_id")))
        told = checkpointed(told.withColumn("tried", F.col("upto") >= F.col("beat") - ROOM))
        tried = told.filter("tried").join(self.blocks, "term")
        tried = tried.filter(F.col("w") * part(F.col("most"), F.col("least")) + F.col("all") - F.col("bound") >= F.col("beat") - ROOM)
        found = checkpointed(postings(tried))
        rest = told.filter("not tried")
        open_ = rest.groupBy("query_id").agg(F.sum("bound").alias("open"))
        left = found.join(to_beat(found, "beat"), "query_id").join(open_, "query_id", "left").fillna(0.0, ["open"])
        left = checkpointed(left.filter(F.col("partial") + F.col("open") >= F.col("beat") - ROOM).select("query_id", "doc_id", "partial"))
        need = left.select("query_id", "doc_id").join(rest.select("query_id", "term", "w"), "query_id")
        listed = self.blocks.join(rest.select("term").distinct(), "term", "left_semi").select("term", F.inline(F.arrays_zip("doc_ids", "tfs", "lengths")))
        met = need.join(listed.withColumnRenamed("doc_ids", "doc_id"), ["term", "doc_id"])
        more = met.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * part(F.col("tfs"), F.col("lengths"))).alias("more"))
        score = F.round(F.col("partial") + F.coalesce("more", F.lit(0.0)), 9).alias("score")
        scored = left.join(more, ["query_id", "doc_id"], "left").select("query_id", "doc_id", score)
        return top(scored.filter("score > 0"), k).select("query_id", "doc_id", "rank", "score")

    def overlap(self, queries: DataFrame) -> DataFrame:
        """``query_id, n_terms, n_known, overlap``: the share of a query's content terms that the corpus has."""
        asked = queries.select("query_id", F.explode_outer(content_terms(F.col("text"))).alias("term"))
        known = asked.join(self.vocabulary.withColumn("known", F.lit(1)), "term", "left")
        return known.groupBy("query_id").agg(F.count("term").alias("n_terms"), F.count("known").alias("n_known")).withColumn(
            "overlap", F.when(F.col("n_terms") > 0, F.col("n_known") / F.col("n_terms")).otherwise(0.0)
        )

    def sharing(self, queries: DataFrame, share: float) -> DataFrame:
        """``query_id, doc_id``: documents that have at least ``share`` of a query's distinct content terms.

        Such a document has one of the query's rarest terms, of as many as it may lack and one more: these are listed, and the
        other terms are looked up for what they list.
        """
        stem = F.regexp_replace("term", "^-+", "")
        want = queries.select("query_id", content_terms(F.col("text")).alias("t")).select("query_id", F.size("t").alias("size"), F.explode("t").alias("stem"))
        df = self.terms.groupBy(stem.alias("stem")).agg(F.sum("df").alias("df"))
        rarity = F.row_number().over(W.partitionBy("query_id").orderBy("df", "stem"))
        lacking = F.floor(F.col("size") - F.ceil(share * F.col("size") - 1e-9))
        told = checkpointed(want.join(df, "stem", "left").fillna(0, ["df"]).withColumn("listed", rarity <= lacking + 1))
        listed = lambda part: self.blocks.withColumn("stem", stem).join(part.select("stem").distinct(), "stem", "left_semi").select("stem", F.explode("doc_ids").alias("doc_id"))
        first, rest = told.filter("listed"), told.filter("not listed")
        begun = checkpointed(first.join(listed(first), "stem").select("query_id", "doc_id", "size", "stem").distinct())
        need = begun.select("query_id", "doc_id", "size").distinct().join(rest.select("query_id", "stem"), "query_id")
        more = need.join(listed(rest), ["stem", "doc_id"]).select("query_id", "doc_id", "size", "stem").distinct()
        both = begun.unionByName(more).groupBy("query_id", "doc_id", "size").agg(F.count("*").alias("n"))
        return both.filter(F.col("n") >= share * F.col("size") - 1e-9).select("query_id", "doc_id")


def _fingerprint(docs: DataFrame) -> tuple | None:
    """Paths, lengths and times of the files that a table is read from; None where some cannot be told."""
    spark, told = docs.sparkSession, []
    for name in sorted(docs.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        told.append((name, status.getLen(), status.getModificationTime()))
    return tuple(told)


def shared_index(docs: DataFrame) -> RankedIndex:
    """The session's index of a table that is read from files: built when it is first asked for, and again once a file or the folder has changed."""
    spark = docs.sparkSession
    kept: dict[tuple, str] = spark.__dict__.setdefault("_gneiss_indexes", {})
    key = (tuple(docs.columns), _fingerprint(docs))
    if key in kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{kept[key]}/terms/_SUCCESS")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return RankedIndex(spark, kept[key])
    index = RankedIndex.build(docs)
    kept[key] = index.path
    return index
