"""Token counts of documents: pieces are counted once for each distinct pre-token.

A tokenizer splits a text into pre-tokens and each of these into pieces by itself, so a text's count is the sum, over its distinct
pre-tokens, of frequency times pieces.  Three steps:

* distinct pre-tokens: every task adds up what it meets, one shuffle joins the tasks;
* pieces of each, by the tokenizer library, once in the whole corpus; only their number is kept;
* documents: frequencies of each document's pre-tokens, joined with the numbers and summed.

The most frequent pre-tokens, a table of at most ``top`` entries of at most 64 characters, are joined in the tasks that
count a document's frequencies, so a hot pre-token is never shuffled per document; all others go through a join.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.arrays import per_process
from gneiss.llm.pretokens import Tokens
from gneiss.llm.scratch import frequent, stored

#: Distinct pre-tokens that a task adds up before it passes them on.
HELD = 1 << 18
#: Pre-tokens whose pieces are asked for at once.
ASKED = 4096
#: Pre-tokens of up to this many characters are their own key, longer ones have a digest of more characters.
OWN_KEY = 32


def key_of(pre_token: str) -> str:
    return pre_token if len(pre_token) <= OWN_KEY else hashlib.sha256(pre_token.encode()).hexdigest()


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""


def pre_token_pieces(docs: DataFrame, tokenizer_file: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``key, n, pieces``: of each distinct pre-token of all texts how often it occurs and how many pieces it has; written."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = per_process(("tokens", tokenizer_file, pattern), lambda: Tokens(tokenizer_file, pattern))
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["pre_token", "n"])

        for b in batches:
            for text in _texts(b.column(0)):
                found.update(tokens.parts(text)[0])
                if len(found) >= HELD:
                    yield out()
                    found.clear()
        yield out()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = per_process(("tokens", tokenizer_file, pattern), lambda: Tokens(tokenizer_file, pattern))
        for b in (b.slice(at, ASKED) for b in batches for at in range(0, b.num_rows, ASKED)):
            own = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(key_of, own), pa.string()), b.column(1), pa.array(map(len, tokens.pieces(own)), pa.int64())], ["key", "n", "pieces"]
            )

    distinct = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(gather, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))
    return stored(distinct.mapInArrow(ask, "key string, n long, pieces long"))


def count(docs: DataFrame, tokenizer_file: str, pattern: str, limit: int = 512, top: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (of the text in UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Tokens are those of the library for ``tokenizer_file`` (see ``pretokens.Tokens``), without tokens that it adds at the ends; a special
    token's string inside a text is that token.  Null and empty texts have no bytes and no tokens.  Very long texts are read whole, and
    so are texts of one pre-token.  Rows are told apart by their place in the scan, so ids may be null or repeat, and repeated rows each have their result; an
    empty table gives no rows.  Only the two named columns are read.  ``tokenizer_file`` is installed on every machine.
    """
    pieces = pre_token_pieces(docs, tokenizer_file, pattern, text_col)
    known = {r["key"]: r["pieces"] for r in frequent(pieces, top)[0].select("key", "pieces").collect()}
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = per_process(("tokens", tokenizer_file, pattern), lambda: Tokens(tokenizer_file, pattern))
        known = sent.value
        for b in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            sizes, sums, keys, times = [], [], [], []
            for text in _texts(b.column("text")):
                parts, total = tokens.parts(text)
                own_keys, own_times = [], []
                for pre_token, f in Counter(parts).items():
                    key = pre_token if len(pre_token) <= OWN_KEY else key_of(pre_token)
                    n = known.get(key)
                    if n is None:
                        own_keys.append(key)
                        own_times.append(f)
                    else:
                        total += n * f
                sizes.append(len(text.encode()))
                sums.append(total)
                keys.append(own_keys)
                times.append(own_times)
            yield pa.RecordBatch.from_arrays(
                [b.column("place"), b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(keys, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                ["place", "doc_id", "n_bytes", "total", "keys", "times"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("place"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    told = stored(rows.mapInArrow(tally, "place long, doc_id long, n_bytes long, total long, keys array<string>, times array<long>"))
    rest = told.select("place", F.explode(F.arrays_zip("keys", "times")).alias("e")).select("place", "e.keys", "e.times")
    more = rest.join(pieces, rest["keys"] == pieces["key"]).groupBy("place").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    n = (F.col("total") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    return told.drop("keys", "times").join(more, "place", "left").select("doc_id", "n_bytes", n).withColumn("over_limit", F.col("n_tokens") > limit)
