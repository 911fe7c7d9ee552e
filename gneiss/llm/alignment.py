"""Alignment of two tokenizers over the same bytes, by interval coalescing.

Both tokenizers' tokens cover a text's bytes, each with intervals that follow one another.  All intervals of a batch of texts are sorted by
start at once, and the largest end so far is carried along: where a start reaches it, tokens of both sides have ended there, and a
group breaks.  Within a group every token overlaps a stretch of tokens of the other side, whose first and last are looked up, and
the stretches expand into links.

How many documents hold a pair of ids linked is counted over the whole corpus.  The counts of the most frequent pairs are a table of at
most ``top`` entries and go to the tasks; all other pairs meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.arrays import per_process
from gneiss.llm.pretokens import Tokens, bytes_of
from gneiss.llm.scratch import frequent, stored

#: Bytes of text that are aligned at once; a longer text is aligned by itself.
CHUNK = 1 << 19
#: Pre-tokens whose ids a worker keeps.
KEPT = 1 << 18


class Ids:
    """Token bytes by id, as one array."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], "int64")
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), "uint8")

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after the other."""
        size = self.size[ids]
        shift = self.begin[ids] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(size.sum())]


class Sides:
    """Tokenizer A, a byte-level file of ``tokenizers``, and B, a ``sentencepiece`` model that puts a space before a text."""

    def __init__(self, file_a: str, pattern: str, file_b: str):
        import sentencepiece

        self.a = Tokens(file_a, pattern)
        entries = [""] * (1 + max(self.a.vocabulary.values()))
        for entry, i in self.a.vocabulary.items():
            entries[i] = entry
        self.of_a = Ids(bytes_of(entries))
        self.kept: dict[str, bytes] = {}
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        pieces = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            pieces.append(bytes((int(piece[3:5], 16),)) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.of_b = Ids(pieces)
        # Ids as text with what follows: a comma within a side, a bar after side A, a semicolon after a group.
        self.texts = [f"{i}{end}" for end in ",|" for i in range(len(entries))] + [f"{i}{end}" for end in ",;" for i in range(len(pieces))]

    def ids_a(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.a.split(t) for t in texts]
        new = list({t for own in split for t in own if t not in self.kept})
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = list({t for own in split for t in own})
        for t, ids in zip(new, self.a.pieces(new), strict=True):
            self.kept[t] = np.array(ids, "<i4").tobytes()
        return [np.frombuffer(b"".join(map(self.kept.__getitem__, own)), "<i4") for own in split]

    def ids_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, "<i4") for ids in self.b.encode(texts, num_threads=1)]


def vocabulary_sizes(file_a: str, pattern: str, file_b: str) -> tuple[int, int]:
    sides = Sides(file_a, pattern, file_b)
    return len(sides.of_a.size), len(sides.of_b.size)


def _per(owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n)


def align_texts(texts: list[str | None], sides: Sides) -> dict[str, list]:
    """Of each text the numbers, the groups and the linked id pairs with how often they occur."""
    n = len(texts)
    some = [i for i in range(n) if texts[i]]
    found_a = sides.ids_a([f" {texts[i]}" for i in some])
    found_b = sides.ids_b([texts[i] for i in some])
    good, ids_a, ids_b, size = [], [np.empty(0, "<i4")], [np.empty(0, "<i4")], []
    for i, a, b in zip(some, found_a, found_b, strict=True):
        raw = np.frombuffer(f" {texts[i]}".encode(), "uint8")
        if all(np.array_equal(of.joined(ids), raw) for of, ids in ((sides.of_a, a), (sides.of_b, b))):
            good.append(i)
            ids_a.append(a)
            ids_b.append(b)
            size.append(len(raw))
    own, edge = np.array(good, "int64"), np.concatenate(([0], np.cumsum(size))).astype("int64")
    a, b = np.concatenate(ids_a).astype("int64"), np.concatenate(ids_b).astype("int64")
    end_a, end_b = np.cumsum(sides.of_a.size[a]), np.cumsum(sides.of_b.size[b])
    start_a, start_b = end_a - sides.of_a.size[a], end_b - sides.of_b.size[b]
    # Coalesced intervals: a group breaks where a start reaches the largest end before it.
    start, end = np.concatenate((start_a, start_b)), np.concatenate((end_a, end_b))
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(end[order]) if len(order) else order
    new = np.concatenate((np.ones(min(len(order), 1), bool), start[order][1:] >= reached[:-1]))
    group = np.empty(len(order), "int64")
    group[order] = np.cumsum(new)
    text_of = own[np.searchsorted(edge, start, side="right") - 1] if len(order) else order
    # Links: the stretch of B tokens that each A token overlaps.
    lo, hi = np.searchsorted(end_b, start_a, side="right"), np.searchsorted(start_b, end_a, side="left")
    width = hi - lo
    link_a = np.repeat(np.arange(len(a)), width)
    link_b = np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(width.sum())
    n_a, n_b, n_links = _per(text_of[: len(a)], n), _per(text_of[len(a) :], n), _per(text_of[link_a], n)
    n_groups = _per(text_of[order[new]], n)
    # Id pairs of each text, each once.
    universe = len(sides.of_a.size) * len(sides.of_b.size)
    pair, times = np.unique(text_of[link_a] * universe + a[link_a] * len(sides.of_b.size) + b[link_b], return_counts=True)
    cut = np.searchsorted(pair // universe, np.arange(n + 1))
    pair %= universe
    # Groups as text: tokens by group, side and start, each with what follows.
    by = np.lexsort((start, side, group))
    sides_by, group_by = side[by], group[by]
    last = np.concatenate((group_by[1:] != group_by[:-1], np.ones(min(len(by), 1), bool)))
    turn = np.concatenate((sides_by[1:] != sides_by[:-1], np.ones(min(len(by), 1), bool)))
    n_ids = np.array([len(sides.of_a.size), len(sides.of_b.size)])
    shown = np.concatenate((a, b))[by] + sides_by * 2 * n_ids[0] + np.where(sides_by == 1, last, turn) * n_ids[sides_by]
    where = np.concatenate(([0], np.cumsum(_per(text_of, n))))
    shown = shown.tolist()
    groups = ["".join(map(sides.texts.__getitem__, shown[i:j]))[:-1] for i, j in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
    return {
        "n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": n_groups.tolist(), "n_links": n_links.tolist(), "groups": groups,
        "pairs": [pair[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)], "times": [times[i:j].astype("int32") for i, j in zip(cut[:-1], cut[1:], strict=True)],
    }


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of all lists and the row of each."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), size)


def align(
    docs: DataFrame, file_a: str, pattern: str, file_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, top: int = 1 << 18,
) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with ``with_groups`` also groups.

    A encodes a space and the text, B the text, before which it puts a space; special tokens' strings are text.  ``groups`` are the ids of the smallest
    stretches that both sides cut out, as ``a1,a2|b1;a3|b2,b3``; ``n_links`` pairs of tokens overlap.  A pair of ids has as its count the
    documents that hold it linked; ``count_sum`` adds these over a document's links, of which ``n_best`` have the largest count of their A id.

    Null and empty texts, and texts whose bytes a tokenizer changes, have no tokens: zeros and an empty ``groups_sha256``.  Very long texts are aligned
    whole, each in one task.  Rows are told apart by their place in the scan: ids may be null or repeat, and repeated rows are
    documents of their own.  An empty table gives no rows.  Only the two named columns are read.  The files are installed on every machine.
    """
    n_b = vocabulary_sizes(file_a, pattern, file_b)[1]
    key = ("sides", file_a, pattern, file_b)
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = per_process(key, lambda: Sides(file_a, pattern, file_b))
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False))
            row = 0
            while row < b.num_rows:
                stop = max(row + 1, int(np.searchsorted(sizes, (sizes[row - 1] if row else 0) + CHUNK, side="right")))
                part = b.slice(row, stop - row)
                told = align_texts(part.column("text").to_pylist(), sides)
                digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in told["groups"]]
                columns = [part.column("place"), part.column("doc_id"), *(pa.array(told[c], pa.int64()) for c in numbers), pa.array(digest, pa.string())]
                columns += [pa.array(told["pairs"], pa.list_(pa.int64())), pa.array(told["times"], pa.list_(pa.int32()))]
                columns += [pa.array(told["groups"], pa.string())] if with_groups else []
                yield pa.RecordBatch.from_arrays(columns, ["place", "doc_id", *numbers, "groups_sha256", "pairs", "times", *(["groups"] if with_groups else [])])
                row = stop

    schema = "place long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    rows = docs.select(F.monotonically_increasing_id().alias("place"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    told = stored(rows.mapInArrow(describe, schema + (", groups string" if with_groups else "")))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair, n = np.unique(_lists(b.column("pairs"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    counts = stored(told.select("pairs").mapInArrow(add_up, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    # One row for each id of A.
    highest = counts.groupBy(F.expr(f"pair div {n_b}").alias("a")).agg(F.max("n").alias("most"))
    ranked = stored(counts.withColumn("a", F.expr(f"pair div {n_b}")).join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    first = frequent(ranked, top)[0].toPandas().sort_values("pair")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(first[c].to_numpy(t) for c, t in (("pair", "int64"), ("n", "int64"), ("best", "int64"))))

    def known(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair is in the table that was sent, and whether it is there."""
        pairs = sent.value[0]
        at = np.searchsorted(pairs, pair)
        at[at == len(pairs)] = 0
        return at, (pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair, row = _lists(b.column("pairs"))
            times = _lists(b.column("times"))[0].astype("int64")
            at, here = known(pair)
            _, n, best = sent.value
            sums = np.zeros((2, b.num_rows), "int64")
            for out, weight in zip(sums, (best, n), strict=True):
                np.add.at(out, row[here], times[here] * weight[at[here]])
            names = [c for c in b.schema.names if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *map(pa.array, sums)], [*names, "best", "total"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair, row = _lists(b.column("pairs"))
            rest = ~known(pair)[1]
            place = b.column("place").to_numpy()[row[rest]]
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(pair[rest]), pa.array(_lists(b.column("times"))[0][rest])], ["place", "pair", "times"])

    weighed = told.mapInArrow(weigh, schema.split(", pairs")[0] + (", groups string" if with_groups else "") + ", best long, total long")
    rest = told.select("place", "pairs", "times").mapInArrow(others, "place long, pair long, times int").join(ranked, "pair")
    more = rest.groupBy("place").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    return weighed.join(more, "place", "left").select(
        "doc_id", *numbers, (F.col("best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        "groups_sha256", *(["groups"] if with_groups else []),
    )
