"""Batched retrieval: lexical and vector rankings, fusion, relevance caps.

Rankings are tables ``query_id, doc_id, rank, score`` with a total order (score, then id).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.session import checkpointed

# Words that carry no content.
STOPWORDS = (
    "a an and are as at be but by do does for from have has in is it its of on or that the their this to was were will with "
    "what which who why how when where here there if then so not no just about any all some can could should would may might "
    "must shall done each every such than them they us we you your my me i he she his her our today tomorrow yesterday now also "
    "get give got much many more most less least very into over onto off upon among between without within"
).split()

TERM = "[A-Za-z0-9-]+"
CONTENT_TERM = "[A-Za-z0-9][A-Za-z0-9-]+"


def terms(text: Column) -> Column:
    """Lower-cased terms, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def content_terms(text: Column) -> Column:
    """Distinct terms of two characters or more that are not stop words."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CONTENT_TERM), F.lit(0)), F.lower))
    return F.array_except(found, F.array(*map(F.lit, STOPWORDS)))


def top(ranked: DataFrame, k: int, score: str = "score", doc: str = "doc_id") -> DataFrame:
    """The k best of each query; Spark limits each partition before it shuffles."""
    order = W.partitionBy("query_id").orderBy(F.desc(score), doc)
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(base: DataFrame, queries: DataFrame, k: int, same: str | None = None, rows_per_block: int = 8192, queries_per_block: int = 1024) -> DataFrame:
    """``query_id, doc_id, rank, score``: the k nearest vectors of each query by cosine, without the query's own id.

    ``base``: doc_id, v; ``queries``: query_id, v; with ``same``, a column of both in which they must agree.  Zero vectors take no part.
    Vectors and queries are cut into blocks of bounded size; each pair of blocks is one matrix product, which returns the
    best of its own (with what equals the last of them) for each query.
    """
    kinds = [same] if same else []
    # Sizes have a row for each kind, or one; they are read once, so that the joins below meet a table of its own.
    blocks = lambda d, size, name: d.groupBy(*(F.col(c).alias("_kind") for c in kinds)).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    row_blocks, query_blocks = blocks(base, rows_per_block, "rb_n"), blocks(queries, queries_per_block, "qb_n")
    sizes = checkpointed(row_blocks.join(query_blocks, "_kind") if kinds else row_blocks.crossJoin(query_blocks))
    sized = lambda d: d.join(sizes, F.col(same) == F.col("_kind")) if kinds else d.crossJoin(F.broadcast(sizes))
    rows = sized(base.select("doc_id", "v", *kinds)).select("doc_id", "v", *kinds, F.pmod(F.xxhash64("doc_id"), F.col("rb_n")).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("qb_n") - 1)).alias("qb"))
    asked = sized(queries.select("query_id", "v", *kinds)).select("query_id", "v", *kinds, F.pmod(F.xxhash64("query_id"), F.col("qb_n")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("rb_n") - 1)).alias("rb"))
    # One table may be both sides: its columns get names of their own.
    keys = [*kinds, "qb", "rb"]
    asked = asked.select("query_id", *(F.col(c).alias(f"q_{c}") for c in ("v", *keys)))

    def unit(column: pd.Series) -> np.ndarray:
        m = np.stack([np.asarray(v, "float64") for v in column])
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "doc_id": [], "score": []}).astype({"query_id": "int64", "doc_id": "int64", "score": "float64"})]
        if len(left) and len(right):
            q, m, ids, qids = unit(left["q_v"]), unit(right["v"]), right["doc_id"].to_numpy(), left["query_id"].to_numpy()
            for at in range(0, len(q), 128):
                score = np.round(q[at : at + 128] @ m.T, 9) + 0.0
                score[np.isnan(score) | (qids[at : at + 128, None] == ids)] = -np.inf
                least = np.partition(score, max(0, score.shape[1] - k), axis=1)[:, max(0, score.shape[1] - k), None]
                i, j = np.nonzero((score >= least) & (score > -np.inf))
                out.append(pd.DataFrame({"query_id": qids[at + i], "doc_id": ids[j], "score": score[i, j]}))
        return pd.concat(out, ignore_index=True)

    met = asked.groupBy([f"q_{c}" for c in keys]).cogroup(rows.groupBy(keys)).applyInPandas(best, "query_id long, doc_id long, score double")
    return top(met, k).select("query_id", "doc_id", "rank", "score")


def cosine_top(vectors: DataFrame, k: int, every: int = 100, same: str | None = None) -> DataFrame:
    """``nearest`` for each vector (vec_id, embedding) whose id is divisible by ``every``, among all others; ``same`` filters before ranking."""
    kinds = [same] if same else []
    base = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), *kinds)
    return nearest(base, base.filter(F.col("doc_id") % every == 0).withColumnRenamed("doc_id", "query_id"), k, same)


def fuse(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: ``query_id, doc_id, fused``."""
    lists = rankings[0].select("query_id", "doc_id", "rank")
    for more in rankings[1:]:
        lists = lists.unionByName(more.select("query_id", "doc_id", "rank"))
    return lists.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (k + F.col("rank"))), 12).alias("fused"))


def normalised(fused: DataFrame, caps: DataFrame, k: int) -> DataFrame:
    """Fused scores over the query's best, times the query's cap; the k best of each query."""
    best = F.max("fused").over(W.partitionBy("query_id"))
    scored = fused.withColumn("best", best).join(caps.select("query_id", "cap"), "query_id")
    scored = scored.select("query_id", "doc_id", F.round(F.col("fused") / F.col("best") * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("cap"))), 9).alias("score"))
    return top(scored, k)


def _digest_column(digest: str, dim: int) -> Callable[[str], int]:
    if digest == "blake2b":
        return lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little") % dim
    if digest == "md5":
        return lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
    raise ValueError(f"unknown digest {digest!r}")


def hash_embed(docs: DataFrame, dim: int = 384, digest: str = "blake2b") -> DataFrame:
    """``doc_id, embedding``: hashed, sublinearly weighted, normalised bags of words; texts without words are zero.

    A word's column is its four-byte BLAKE2b digest (little-endian) modulo ``dim``, or the first four bytes of its MD5 digest.
    Spark's expressions find the words; each different word of an Arrow batch is hashed once and the rest is array arithmetic.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}-]+"), F.lit(0))
    column, stop = _digest_column(digest, dim), frozenset(STOPWORDS)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                own = b.column(1)
                coded = own.flatten().dictionary_encode()
                to = np.array([column(w) if len(w) >= 2 and w not in stop else -1 for w in coded.dictionary.to_pylist()], "int64")
                where = to[coded.indices.to_numpy()] if len(coded) else np.empty(0, "int64")
                row = np.repeat(np.arange(b.num_rows), own.value_lengths().to_numpy())
                counts = np.bincount((row * dim + where)[where >= 0], minlength=b.num_rows * dim).reshape(-1, dim)
                weight = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0)
                norm = np.sqrt((weight * weight).sum(axis=1, keepdims=True))
                values = (weight / np.where(norm > 0, norm, 1)).astype("float32").ravel()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype="int32") * dim), pa.array(values))], ["doc_id", "embedding"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words")).mapInArrow(embed, "doc_id long, embedding array<float>")
