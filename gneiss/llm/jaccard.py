"""Exact similarity join of documents on word shingles: a size-aware heavy-light join.

Two sets of sizes a and b are linked if they share at least c(a, b) elements.

* Light: small sets enumerate their subsets of size c; two linked sets have such a subset in common.
* Heavy: large sets scan inverted lists.  The universe is dealt by hash into more parts than linked
  sets of a size class can differ in, so linked sets agree on some whole parts; a list holds the
  sets that agree on one.
* The boundary between the two is the size at which the number of keys, over the sizes that
  the table really has, is smallest.

A list that many sets share (a passage that many documents repeat) says little.  Linked sets agree on more
parts than are spare, so a set with no more crowded lists than there are to spare leaves these; see
``candidate_lists``.  Lists with the same members are scanned once.

Lists are scanned twice.  First with sketches: the parity of a set's elements in each of about as many bits as
it has elements.  Two sketches differ in no more bits than their sets differ in elements, so no link is lost,
and nearly all pairs that only share a passage go.  What is left falls into small groups, in which the
lists of all elements are scanned.

Equal sets are one vertex throughout.  Lists and groups are cut into blocks and each pair of blocks is
one unit of work that returns a few numbers per set, never a row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gneiss.llm import arrays
from gneiss.llm.graph import components
from gneiss.llm.scratch import bit_table, discard, marked, stored

#: A list of more sets than this is crowded.
CROWDED = 64
#: Sets of a list that are in one block of it, and elements of a group.
LIST_BLOCK, GROUP_BLOCK = 2048, 1 << 19
#: Rows that hold the same set are dealt to so many tasks.
SALTS = 16
#: A tag holds a scheme's number above these bits and how many of its keys are to spare in them.
SPARE = (1 << 28) - 1
#: Boundaries up to 40 are tried; sets beyond this size cost much the same under each.
SIZES = 64


class Plan:
    """Which keys a set of each size has, for similarity ``num / den`` and boundary ``light``."""

    def __init__(self, num: int, den: int, light: int):
        self.num, self.den, self.light = num, den, light
        # A pair whose larger set is above the boundary has a smaller set of at least this size.
        self.first = max(1, -(-num * (light + 1) // den))
        self.classes: list[tuple[int, int, int]] = []  # smallest and largest size, parts
        self.spare: list[int] = []
        self.subsets: dict[int, tuple[tuple[int, int, int], ...]] = {}

    def common(self, a: int, b: int) -> int:
        """Elements that linked sets of these sizes share at least."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def class_of(self, n: int) -> int:
        """The size class; linked sets are in the same class or in neighbouring ones."""
        while not self.classes or self.classes[-1][1] < n:
            low = self.classes[-1][1] + 1 if self.classes else self.first
            high = low * self.den // self.num
            total = high + high * self.den // self.num
            differ = total * (self.den - self.num) // (self.den + self.num)
            spare = 1 + differ // 16
            self.classes.append((low, high, differ + 1 + spare))
            self.spare.append(spare)
        lo, hi = 0, len(self.classes) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.classes[mid][1] >= n else (mid + 1, hi)
        return lo

    def subset_sizes(self, n: int) -> tuple[tuple[int, int, int], ...]:
        """(smaller size, larger size, subset size) of each pair of sizes for which a set of n elements enumerates subsets."""
        if n not in self.subsets:
            out = []
            for m in range(-(-self.num * n // self.den), min(n * self.den // self.num, self.light) + 1):
                a, b = min(m, n), max(m, n)
                c = self.common(a, b)
                if not (a == b == c):  # equal sets are one vertex already
                    out.append((a, b, c))
            self.subsets[n] = tuple(out)
        return self.subsets[n]

    def light_keys(self, n: int) -> int:
        return sum(comb(n, c) for _, _, c in self.subset_sizes(n)) if n <= self.light else 0

    def heavy_keys(self, n: int) -> int:
        if n < self.first:
            return 0
        j = self.class_of(n)
        return self.classes[j][2] + (self.classes[j - 1][2] if j else 0)


def cheapest_plan(num: int, den: int, sizes: dict[int, int], largest: int = 40) -> Plan:
    """The plan with the fewest keys for ``sizes``: how many sets there are of each size."""
    plans = [Plan(num, den, light) for light in range(largest + 1)]
    return min(plans, key=lambda p: (sum(k * (p.light_keys(n) + p.heavy_keys(n)) for n, k in sizes.items() if n), p.light))


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int, powers: arrays.Powers) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    starts, ends, first = arrays.words(data, offsets)
    s, begin = arrays.shingles(arrays.word_hashes(data, starts, ends, powers), first, k)
    return [np.unique(s[i:j]) for i, j in zip(begin[:-1], begin[1:], strict=True)]


def set_keys(s: np.ndarray, plan: Plan) -> list[tuple[np.ndarray, int]]:
    """The set's keys by scheme, each with how many are to spare: linked sets that differ have more than that in common in one scheme."""
    n, out = len(s), []
    if not n:
        return out
    m = arrays.mixed(s + np.uint64(0x5EED))
    total = m.sum(dtype="uint64")
    if n <= plan.light:
        keys = []
        for a, b, c in plan.subset_sizes(n):
            left_out = np.array(list(combinations(range(n), n - c)), int).reshape(comb(n, c), n - c)
            sums = total - m[left_out].sum(axis=1, dtype="uint64")
            keys.append(arrays.mixed(sums + np.uint64(((a << 24) + b) * 2 + 1)))
        if keys:
            out.append((np.unique(np.concatenate(keys)), 0))
    if n >= plan.first:
        j = plan.class_of(n)
        for scheme in {j, max(0, j - 1)}:
            parts = plan.classes[scheme][2]
            part = ((m >> np.uint64(16)) % np.uint64(parts)).astype(int)
            sums = np.zeros(parts, "uint64")
            np.add.at(sums, part, m)
            out.append((arrays.mixed(sums + arrays.mixed(np.uint64(scheme << 32) + np.arange(parts, dtype="uint64") + np.uint64(1))), plan.spare[scheme]))
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the set's elements in a power of two of bits, at least one for each element, as 64-bit words."""
    words = 1 << max(0, (len(s) - 1).bit_length() - 6)
    bit = arrays.mixed(s + np.uint64(0xB17))
    counts = np.bincount((bit & np.uint64(64 * words - 1)).astype(int), minlength=64 * words)
    return np.packbits((counts & 1).astype("uint8"), bitorder="little").view("<u8")


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches as if they had been made with fewer words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def alike(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which sketches, row by row, may be of linked sets: they differ in no more bits than linked sets of these sizes in elements."""
    differ = np.bitwise_count(left ^ right).sum(axis=-1, dtype="int64")
    both = n_left + n_right
    # Linked sets share at least num * both / (num + den) elements.
    return (differ <= both - 2 * -(-num * both // (num + den))) & (num * np.maximum(n_left, n_right) <= den * np.minimum(n_left, n_right))


def _sizes(texts: DataFrame, k: int) -> dict[int, int]:
    """How many texts there are of each small number of shingles, repeats included: near enough to the set sizes to weigh plans."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(SIZES + 1, "int64")
        for b in batches:
            for _, data, offsets in arrays.chunks(b.column(0)):
                words = np.diff(arrays.words(data, offsets)[2])
                n = np.where(words >= k, words - k + 1, words > 0)
                found += np.bincount(n[n <= SIZES], minlength=SIZES + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZES + 1)), pa.array(found)], ["size", "n"])

    found = texts.mapInArrow(count, "size long, n long").groupBy("size").agg(F.sum("n").alias("n"))
    return {r["size"]: r["n"] for r in found.collect()}  # SIZES rows


def candidate_lists(postings: DataFrame) -> DataFrame:
    """``key, d1``: the lists to be scanned, of two sets or more, no two with the same members.

    ``postings``: key, d1 (the set), tag (its scheme and how many keys of it are to spare); they may repeat.  A crowded list is
    crowded for all its sets.  A set with no more crowded lists in a scheme than are spare leaves them: each
    set that it is linked with also shares a list with it that is not crowded, and nobody leaves those.
    """
    # Lists are counted with a row for each task that knows them, and only postings of a key that is met again are shuffled; a long list is
    # split where it is joined with its count.  Postings that repeat make a list longer for all its sets alike.
    sizes = stored(postings.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    likely, may = marked(postings, F.xxhash64("key"), bit_table(sizes, F.xxhash64("key"), "word", "bits"), "word", "bits")
    met = likely.filter(may).select("key", "d1", "tag").join(sizes, "key").repartition("d1", "tag")
    shared = met.groupBy("key", "d1", "tag").agg(F.max("m").alias("m"))
    crowded = F.sum((F.col("m") > CROWDED).cast("int")).over(W.partitionBy("d1", "tag"))  # the keys of one set
    kept = stored(shared.withColumn("crowded", crowded).filter((F.col("m") <= CROWDED) | (F.col("crowded") > F.col("tag").bitwiseAND(SPARE))).select("key", "d1"))
    discard(sizes)
    # Lists with the same members have the same digests.
    members = kept.groupBy("key").agg(F.count("*").alias("m"), *(F.bit_xor(F.xxhash64(F.lit(i), "d1")).alias(f"h{i}") for i in (1, 2))).filter("m > 1")
    chosen = members.groupBy("m", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    out = stored(kept.join(chosen, "key"))
    discard(kept)
    return out


def _alike_in_lists(lists: DataFrame, vertices: DataFrame, num: int, den: int) -> DataFrame:
    """``u, v``: a forest over the sets of each list whose sketches may be of linked sets.

    ``lists``: key, d1; ``vertices``: vertex, n, d1, sketch.
    """
    # Lists are cut into blocks before the sketches come, which so are shuffled once for each list.
    sized = lists.groupBy("key").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks"))
    dealt = lists.join(sized, "key").withColumn("own", F.pmod(F.xxhash64("d1"), F.col("blocks")).cast("int"))
    known = vertices.join(lists.select("d1").distinct(), "d1", "left_semi")
    units = dealt.join(known, "d1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vertex", "n", "sketch"
    )
    parts = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "vertex")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            # The batch's last unit may go on in the next.
            unit = np.stack([b.column(c).to_numpy().astype("int64") for c in ("key", "i", "j")])
            last = np.flatnonzero((unit != unit[:, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if open_ and (cut or tuple(unit[:, 0]) != open_[0][0]):
                ended = [x for _, x in open_] + ([b.slice(0, cut)] if cut else [])
                yield from _forests(ended, num, den)
                open_ = []
            elif cut:
                yield from _forests([b.slice(0, cut)], num, den)
            open_.append((tuple(unit[:, -1]), b.slice(cut)))
        if open_:
            yield from _forests([x for _, x in open_], num, den)

    return parts.mapInArrow(scan, "u long, v long").distinct()


def _forests(batches: list[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Edges of the forest of each unit that the rows hold."""
    table = pa.Table.from_batches(batches).combine_chunks()
    unit = np.stack([table.column(c).to_numpy().astype("int64") for c in ("key", "i", "j")])
    first = np.flatnonzero(np.concatenate(([True], (unit[:, 1:] != unit[:, :-1]).any(axis=0))))
    size = np.diff(np.append(first, table.num_rows))
    own, vertex, n = (table.column(c).to_numpy() for c in ("own", "vertex", "n"))
    column = table.column("sketch").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    begin = np.frombuffer(column.buffers()[1], "int64")[column.offset : column.offset + len(column) + 1] // 8
    flat = np.frombuffer(column.buffers()[2] or b"", "<u8")
    words = np.diff(begin)
    u, v = [], []
    # Short lists, all of a length at once: their pairs are a few each and stay in this task.
    for m in np.unique(size[(size > 1) & (size <= 16)]):
        at = first[size == m]
        a, b = (np.concatenate([at + x for x in side]) for side in zip(*combinations(range(m), 2), strict=True))
        low = np.minimum(words[a], words[b])
        for w in np.unique(low):
            for wa, wb in {(w, w), (w, 2 * w), (2 * w, w)}:
                pick = np.flatnonzero((words[a] == wa) & (words[b] == wb))
                for p in np.array_split(pick, 1 + len(pick) * int(w) // (1 << 20)):
                    x, y = a[p], b[p]
                    good = alike(
                        folded(flat[begin[x, None] + np.arange(wa)], w), n[x], folded(flat[begin[y, None] + np.arange(wb)], w), n[y], num, den
                    )
                    u.append(vertex[y[good]])
                    v.append(vertex[x[good]])
    for f, m in zip(first[size > 16], size[size > 16], strict=True):
        i, j = unit[1, f], unit[2, f]
        label = np.arange(m)
        at = np.arange(f, f + m)
        by_words = {w: np.flatnonzero(words[at] == w) for w in np.unique(words[at])}
        rows = {w: flat[begin[at[p], None] + np.arange(w)] for w, p in by_words.items()}
        down = {(w, x): folded(rows[w], x) for w in rows for x in rows if x <= w <= 2 * x}
        for x in np.flatnonzero(own[at] == i):
            w = words[at[x]]
            for other, p in by_words.items():
                if not w <= 2 * other or not other <= 2 * w:
                    continue
                least = min(w, other)
                p_own = p if i != j else p[p > x]
                p_own = p_own[own[at[p_own]] == j]
                if not len(p_own):
                    continue
                mine = folded(rows[w][np.searchsorted(by_words[w], x)][None, :], least)
                good = alike(mine, n[at[x]], down[other, least][np.searchsorted(p, p_own)], n[at[p_own]], num, den)
                near = label[p_own[good]]
                near = near[near != label[x]]
                if len(near):
                    label[np.isin(label, near) | (label == label[x])] = min(near.min(), label[x])
        moved = np.flatnonzero(label != np.arange(m))
        u.append(vertex[at[moved]])
        v.append(vertex[at[label[moved]]])
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])


def _linked(sets: list[np.ndarray], weight: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Among the pairs (left, right): each set's smallest connected set, and the summed weight of its links.

    Every left set scans the inverted lists of its elements, which hold the right sets.
    """
    size = np.array([len(s) for s in sets])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    listed = right[owner]
    order = np.argsort(at[listed], kind="stable")
    members = owner[listed][order]
    edge = np.searchsorted(at[listed][order], np.arange(len(values) + 1))
    begin = np.concatenate(([0], np.cumsum(size)))
    root, links = np.arange(len(sets)), np.zeros(len(sets), "int64")

    for x in np.flatnonzero(left):
        lo, hi = edge[at[begin[x] : begin[x + 1]]], edge[at[begin[x] : begin[x + 1]] + 1]
        width = hi - lo
        where = np.repeat(lo - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
        shared = np.bincount(members[where], minlength=len(sets))
        good = (den * shared >= num * (size + size[x] - shared)) & right
        # Where both sides are the same block, each pair is seen from both of its sets.
        good &= ~left | (np.arange(len(sets)) > x)
        if good.any():
            links[x] += weight[good].sum()
            links[good] += weight[x]
            near = np.append(root[good], root[x])
            if (near != near[0]).any():
                root[np.isin(root, near)] = near.min()
    return root, links


def join(
    docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, block: int = GROUP_BLOCK, id_col: str = "doc_id", text_col: str = "text",
    place_col: str | None = None,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, n_links.

    With ``place_col``, a column of distinct numbers, also that column and ``first``: whether the row is the one
    of its component with the smallest id, of equal ids the one with the smallest number.

    Words are runs of other than white space, lower-cased (A-Z); a set holds a text's distinct ``k``-word
    shingles, a shorter text's whole sequence counting as one.  Texts are linked when ``den *
    intersection >= num * union``.  ``component_id`` is the smallest id reachable by links, itself
    included; ``n_links`` counts the rows linked with this one.

    Null texts and those without words have an empty set and no links, and are their own component.
    Repeated rows are rows with equal sets.  A null id is never the smallest unless all are null.  An
    empty table gives no rows.  Only the two named columns are read.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), *([F.col(place_col).alias("place")] if place_col else []))
    plan = cheapest_plan(num, den, _sizes(rows.select("text"), k))

    def digests(own: list[np.ndarray]) -> list[np.ndarray]:
        return [np.array([arrays.mixed(s ^ np.uint64(x)).sum(dtype="uint64") for s in own], "uint64").view("int64") for x in (1, 2)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = arrays.Powers()
        for b in batches:
            for row, data, offsets in arrays.chunks(b.column("text")):
                own = sets_of(data, offsets, k, powers)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).slice(row, len(own)) for c in ("doc_id", "text_hash", "place")), pa.array([len(s) for s in own], pa.int64()),
                        *map(pa.array, digests(own)), pa.array([sketch(s).tobytes() for s in own], pa.binary()),
                    ],
                    ["doc_id", "text_hash", "place", "n", "d1", "d2", "sketch"],
                )

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, met = arrays.Powers(), set()
        for b in batches:
            for _, data, offsets in arrays.chunks(b.column("text")):
                own = sets_of(data, offsets, k, powers)
                keys, sets, tags = [np.empty(0, "uint64")], [np.empty(0, "int64")], [np.empty(0, "int32")]
                for s, *d in zip(own, *digests(own), strict=True):
                    # Copies that one task meets are one entry of the lists.
                    if tuple(d) not in met:
                        met.add(tuple(d))
                        for i, (x, spare) in enumerate(set_keys(s, plan)):
                            keys.append(x)
                            sets.append(np.full(len(x), d[0]))
                            tags.append(np.full(len(x), i << 28 | spare, "int32"))
                if len(met) > 1 << 16:
                    met.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view("int64")), pa.array(np.concatenate(sets)), pa.array(np.concatenate(tags))], ["key", "d1", "tag"])

    # The place names a row; it is fixed once it is written.
    named = rows if place_col else rows.withColumn("place", F.monotonically_increasing_id())
    found = stored(named.mapInArrow(describe, "doc_id long, text_hash long, place long, n long, d1 long, d2 long, sketch binary"))
    vertices = found.select("doc_id", "text_hash", "place", "n", "d1", "d2")
    # The row of a set that comes first: by id, null ids last.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place")
    equal = vertices.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("place").alias("vertex"), F.count("*").alias("copies"), F.min(order).alias("least"))
    # The keys take more room than the texts, so they are made where they are shuffled and written nowhere else.
    postings = rows.select("text").mapInArrow(post, "key long, d1 long, tag int")
    lists = candidate_lists(postings)
    described = found.select(F.col("place").alias("vertex"), "n", "d1", "sketch").join(equal.select("vertex"), "vertex", "left_semi")
    # Groups: sets that the sketches leave together, joined up.
    grouped = components(_alike_in_lists(lists, described, num, den))
    group = grouped.select(F.col("u").alias("vertex"), F.col("v").alias("group"))
    # The smallest of a component is not listed, so it comes from its members.
    group = group.union(grouped.select(F.col("v").alias("vertex"), F.col("v").alias("group"))).distinct()
    chosen = group.join(equal.drop("least"), "vertex")
    crowd = chosen.groupBy("group").agg(F.sum("n").alias("m"))
    work = stored(
        chosen.join(crowd, "group").join(vertices.select(F.col("place").alias("vertex"), "doc_id", "text_hash"), "vertex")
        .select("vertex", "group", "copies", "doc_id", "text_hash", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
        .withColumn("own", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    )
    discard(lists)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = arrays.Powers()
        for b in batches:
            for row, data, offsets in arrays.chunks(b.column("text")):
                own = sets_of(data, offsets, k, powers)
                names = ["vertex", "group", "copies", "blocks", "own"]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(row, len(own)) for c in names), pa.array([s.tobytes() for s in own], pa.binary())], [*names, "elements"]
                )

    # Texts of sets that are in no group need not be shuffled: a bit table of fixed size, at most
    # 2**18 rows of 64 bits, tells most of them apart by their hash.  The join is what decides.
    bit = F.pmod("text_hash", F.lit(1 << 24))
    bits = work.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    likely = rows.withColumn("bit", bit).withColumn("word", F.shiftright("bit", 6)).join(F.broadcast(bits), "word")
    rows = likely.filter("shiftright(bits, cast(bit % 64 as int)) & 1L = 1L").select("doc_id", "text", "text_hash")
    # Rows that repeat id and text come twice; the work below takes each vertex once.
    wanted = work.join(rows, (work["text_hash"] == rows["text_hash"]) & work["doc_id"].eqNullSafe(rows["doc_id"])).select("vertex", "group", "copies", "blocks", "own", "text")
    held = wanted.mapInArrow(collect, "vertex long, group long, copies long, blocks int, own int, elements binary")
    units = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vertex", "copies", "elements"
    )
    parts = units.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "vertex")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: tuple | None = None
        held: dict[int, tuple[int, int, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            names = sorted(held)
            own = np.array([held[v][0] for v in names])
            weight = np.array([held[v][1] for v in names])
            root, links = _linked([held[v][2] for v in names], weight, own == unit[1], own == unit[2], num, den)
            v = np.array(names, "int64")
            return pa.RecordBatch.from_arrays([pa.array(v), pa.array(v[root]), pa.array(links)], ["u", "v", "links"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("group", "i", "j", "own", "vertex", "copies")]
            for g, i, j, own, vertex, copies, elements in zip(*columns, b.column("elements"), strict=True):
                if (g, i, j) != unit:
                    if len(held) > 1:
                        yield out()
                    unit, held = (g, i, j), {}
                held[vertex] = (own, copies, np.frombuffer(elements.as_py(), "uint64"))
        if len(held) > 1:
            yield out()

    linked = stored(parts.mapInArrow(scan, "u long, v long, links long"))
    discard(work)
    roots = components(linked.select("u", "v"))
    links = linked.groupBy(F.col("u").alias("vertex")).agg(F.sum("links").alias("links"))
    known = equal.join(roots.select(F.col("u").alias("vertex"), F.col("v").alias("root")), "vertex", "left").join(links, "vertex", "left")
    known = known.select("n", "d1", "d2", "least", F.coalesce("root", "vertex").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    # A component's first row is told from its sets, of which copies are one, and goes to the rows with what is known of their set.
    tops = known.groupBy("root").agg(F.min("least").alias("top"))
    told = known.join(tops, "root").select("n", "d1", "d2", "n_links", "top", F.lit(True).alias("linked"))
    # A set's one row goes to several tasks, and the rows that hold the set to one of these each.
    salted = vertices.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int"))
    rows = salted.join(told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["n", "d1", "d2", "salt"], "left").drop("salt")
    component = F.when(F.col("linked"), F.col("top.doc_id")).otherwise(F.col("doc_id"))
    more = [F.col("place").alias(place_col), (F.col("place") == F.coalesce("top.place", "place")).alias("first")] if place_col else []
    out = stored(rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *more))
    for table in (found, linked, roots, grouped):
        discard(table)
    return out
