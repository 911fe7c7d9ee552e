"""Runs of repeating words: maximal pairs of a bottom-up LCP-interval tree.

A maximal pair is two places of a text from which the same ``l`` words follow, while the words before them differ and so do
the words after them.  A pair at distance ``q`` with ``l`` at least ``(times - 1) * q`` is a run of period ``q`` and length
``l + q``, from its first place on: neither side needs to be extended.  Of pairs that span the same words the one with
the smallest distance tells the period; by Fine and Wilf the others are its multiples.

Every text is a few arrays.  Places are ordered by prefix doubling, which begins with the shortest common prefix that a run can have, so
words and phrases that merely recur are never sorted.  The tree is walked from its leaves up, along the common prefixes of neighbours in that order.
Each node keeps its places as class lists by the word on their left, merged in text order: within ``l / 2`` words of each
other, all places of a node but the first of a stretch are of one class (the stretch is periodic), so a place has to be compared
with one other on each side to know the class of all.  The smaller of two joined lists is looked up in the larger.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer text is worked on by itself.
CHUNK = 1 << 19

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _ranked(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each pair (high, low) how many pairs are smaller; equal pairs have equal ranks."""
    _, inverse, counts = np.unique(high * (int(low.max()) + 1) + low, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - counts)[inverse]


def _ranks(words: np.ndarray, k: int) -> np.ndarray:
    """The rank of the k words from each place on, in the order of their numbers; past the end is 0."""
    have, out = 1, words
    while have < k:
        step = min(have, k - have)
        out = _ranked(out, np.concatenate((out[step:], np.zeros(step, out.dtype)))[: len(out)])
        have += step
    return out


def _ordered(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that share ``depth`` words or more with another one, in suffix order, and the common words with the place before (0: fewer than ``depth``).

    The last word of each text occurs nowhere else.
    """
    rank = _ranks(words, depth)
    levels, h = [rank], depth
    sizes = np.bincount(rank, minlength=len(rank))
    shared = open_ = np.flatnonzero(sizes[rank] > 1)
    while len(open_):
        high, low = rank[open_], rank[open_ + h]
        by = np.lexsort((low, high))
        open_, high, low = open_[by], high[by], low[by]
        at = np.arange(len(by))
        new_high = np.concatenate(([True], high[1:] != high[:-1]))
        new = new_high | np.concatenate(([True], low[1:] != low[:-1]))
        first = np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[open_] = high + first - np.maximum.accumulate(np.where(new_high, at, 0))
        alone = new & np.append(new[1:], True)
        open_, h = open_[~alone], 2 * h
        levels.append(rank)
    shared = shared[np.argsort(rank[shared])]
    i, j, common = shared[:-1].copy(), shared[1:].copy(), np.zeros(max(len(shared) - 1, 0), "int64")
    for level, rank in zip(range(len(levels) - 1, -1, -1), reversed(levels), strict=True):
        step = np.where(rank[i] == rank[j], depth << level, 0)
        i, j, common = i + step, j + step, common + step
    for _ in range(depth - 1):
        # Places that differ stay, and so differ again.
        step = ((common > 0) & (words[i] == words[j])).astype("int64")
        i, j, common = i + step, j + step, common + step
    return shared, np.concatenate(([0], common)) if len(shared) else common


def maximal_pairs(words: np.ndarray, depth: int, times: int) -> list[tuple[int, int, int]]:
    """(first place, distance, common words) of the maximal pairs with at least ``depth`` common words and ``times - 1`` times their distance."""
    places, common = _ordered(words, depth)
    out: list[tuple[int, int, int]] = []
    if not len(places):
        return out
    # Subtrees in which no two places are near enough for the longest common prefix are left out whole.
    tree = np.cumsum(common == 0) - 1
    longest = np.maximum.reduceat(common, np.flatnonzero(common == 0))
    by = np.lexsort((places, tree))
    near = np.diff(places[by]) * (times - 1) <= longest[tree[by[1:]]]
    useful = np.zeros(len(longest), bool)
    useful[tree[by[1:]][near & (tree[by[1:]] == tree[by[:-1]])]] = True
    places, common = places[useful[tree]], common[useful[tree]]
    left = np.concatenate((words[-1:], words[:-1])).tolist()

    def joined(a: list[int], b: list[int], l: int) -> list[int]:
        """The places of both lists, after their pairs at a node with ``l`` common words were found."""
        if len(a) > len(b):
            a, b = b, a
        far = l // (times - 1)
        for i in a:
            lo = bisect_left(b, i - far)
            if lo < len(b) and b[lo] < i and left[b[lo]] != left[i]:
                out.append((b[lo], i - b[lo], l))
            hi = bisect_right(b, i)
            if hi < len(b) and b[hi] <= i + far and left[b[hi]] != left[i]:
                out.extend((i, j - i, l) for j in b[hi : bisect_right(b, i + far)])
        if len(a) == 1:
            insort(b, a[0])
            return b
        return sorted(a + b)

    stack: list[tuple[int, list[int]]] = []
    for place, l in zip(places.tolist(), [*common.tolist()[1:], 0], strict=False):
        # ``l``: common words with the place after this one.
        last = [place]
        while stack and stack[-1][0] > l:
            depth_here, members = stack.pop()
            last = joined(members, last, depth_here)
        if stack and stack[-1][0] == l:
            stack[-1] = (l, joined(stack[-1][1], last, l))
        elif l:
            stack.append((l, last))
    return out


def _found(texts: list[bytes], least: int, times: int) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Of each text its words and its runs (start, length, period), ordered by start, then period."""
    split = [t.split() for t in texts]
    numbers, begin, used = [], [0], 0
    for own in split:
        known = {w: n for n, w in enumerate(dict.fromkeys(own), used)}
        used += len(known) + 1
        numbers.append(np.fromiter(map(known.__getitem__, own), "int64", len(own)))
        numbers.append(np.array([used - 1]))
        begin.append(begin[-1] + len(own) + 1)
    # A shorter common prefix than this belongs to no run that is long enough.
    depth = -(-least * (times - 1) // times)
    runs: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    pairs = maximal_pairs(np.concatenate(numbers), max(depth, 1), times)
    owners = np.searchsorted(begin, [i for i, _, _ in pairs], side="right") - 1
    for d, (i, q, l) in zip(owners.tolist(), pairs, strict=True):
        if q + l >= least:
            key = (i - begin[d], q + l)
            runs[d][key] = min(q, runs[d].get(key, q))
    for own, found in zip(split, runs, strict=True):
        yield own, sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def runs(docs: DataFrame, least: int = 6, times: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs, collapsed.

    Words are stretches of other than white space (space, tab to carriage return), told apart by their bytes.  ``runs``: start,
    length and period of every stretch of words with smallest period ``period`` that no neighbouring word extends, of at
    least ``least`` words and ``times`` (3 or more) periods, by start, then period.  ``collapsed``: the words, joined by one space,
    without those that some run holds after its first period.

    Null and empty texts and those of white space have no words, no runs and collapse to the empty text.  Very long texts are
    read whole, each in one task.  Rows are independent, so repeated rows have equal results, nothing is shuffled,
    a lost executor costs its tasks, and an empty table gives no rows.  Ids, null or repeated, are passed
    through.  Only the two named columns are read.
    """
    if times < 3 or least < 2:
        raise ValueError("a run has at least three periods and two words")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())
            sizes = np.cumsum([len(t.as_buffer() or b"") if t.is_valid else 0 for t in texts]) if len(ids) else np.empty(0)
            row = 0
            while row < len(ids):
                done = sizes[row - 1] if row else 0
                end = max(row + 1, int(np.searchsorted(sizes, done + CHUNK, side="right")))
                out = []
                for i, (words, found) in zip(ids[row:end], _found([t or b"" for t in texts.slice(row, end - row).to_pylist()], least, times), strict=True):
                    kept = words
                    if found:
                        stays = np.ones(len(words), bool)
                        for start, length, period in found:
                            stays[start + period : start + length] = False
                        kept = [words[k] for k in np.flatnonzero(stays)]
                    out.append((i, len(words), [dict(start=s, length=n, period=q) for s, n, q in found], b" ".join(kept).decode()))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "runs", "collapsed"])
                row = end

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(work, SCHEMA)


def with_periodic_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text``: rows whose id's digest is divisible by ten get a tail that repeats some of their words; others, and null ids, stay as they are.

    With ``h`` the CRC-32 of the decimal id and ``g = h div 10``, each word i from ``a = g mod n`` on becomes word
    ``a + (i - a) mod p``, where ``p = 1 + (n - a) div (3 + g mod 8)``.  This plants runs of known periods for measurement.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    told = rows.withColumn("g", F.when(h % 10 == 0, F.floor(h / 10).cast("long")))
    told = told.withColumn("w", F.when(F.col("g").isNotNull(), words)).withColumn("n", F.size("w").cast("long"))
    told = told.withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.expr("concat_ws(' ', transform(sequence(0L, n - 1), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]))")
    return told.select("doc_id", F.when(F.col("a").isNotNull(), tail).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """``runs``' rows as numbers and digests: the longest run (of equal ones the first, then that of the smallest period) and SHA-256 of the runs and of the collapsed text."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    told = found.withColumn("best", best)
    period = -F.col("best.period")
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
