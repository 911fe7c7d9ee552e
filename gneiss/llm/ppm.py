"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to three bytes long, with counts over all training texts.  The
code length of a byte starts at its longest context.  A byte seen there costs its share of n + d,
where n counts what followed and d how many different bytes did; otherwise an escape of d / (n + d)
leads to the next shorter context, where the bytes of the longer ones no longer take part (symbol
exclusion).  At the end stand all bytes not excluded yet, alike.  Every text ends with the byte FF, which
UTF-8 does not use, so the probabilities of all texts sum to one.

Counts are gathered by Spark.  What every task needs is bounded: contexts of up to two bytes have
2**24 cells at most, the ``max_contexts`` most frequent of longer ones are scored in place, as are
contexts never seen (2**24 bits tell which were), and of words the ``max_words`` most frequent are
looked up in place.  All other words and contexts are met by a join with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import arrays, labelled
from gneiss.llm.scratch import frequent, stored

ORDER = 3
END = 0xFF


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the three before it (zeros before a text) as one number, texts closed by END; the first of each text."""
    n = len(offsets) - 1
    size = np.diff(offsets) + ORDER + 1
    begin = np.concatenate(([0], np.cumsum(size)))
    padded = np.zeros(begin[-1], "uint32")
    text = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(data)) + (ORDER + 1) * text + ORDER] = data
    padded[begin[1:] - 1] = END
    code = padded.copy()
    for j in range(1, ORDER + 1):
        code[j:] |= padded[:-j] << np.uint32(8 * j)
    inside = np.ones(begin[-1], bool)
    for j in range(ORDER):
        inside[begin[:-1] + j] = False
    return code[inside], np.concatenate(([0], np.cumsum(np.diff(offsets) + 1)))


class Tally:
    """Counts of keys, merged now and then; ``full`` when it holds many different ones."""

    def __init__(self, limit: int = 1 << 19):
        self.limit, self.parts, self.held = limit, [], 0

    def add(self, keys: np.ndarray) -> None:
        u, n = np.unique(keys, return_counts=True)
        self.parts.append((u, n))
        self.held += len(u)
        if self.held > self.limit:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])

    @property
    def full(self) -> bool:
        return self.held > self.limit

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, "int64"), np.empty(0, "int64")
        u, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
        return u, np.bincount(at, np.concatenate([p[1] for p in self.parts]), len(u)).astype("int64")

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out, self.parts, self.held = self.merged(), [], 0
        return out


WORDS, GRAMS = 0, 1


def _counts(training: DataFrame) -> DataFrame:
    """``kind, key, n``: words (by hash) and byte grams of the training texts; added up per task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, tallies = arrays.Powers(), {WORDS: Tally(), GRAMS: Tally()}

        def out(kind: int) -> pa.RecordBatch:
            keys, n = tallies[kind].take()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, "int32")), pa.array(keys.astype("int64")), pa.array(n)], ["kind", "key", "n"])

        for b in batches:
            for _, data, offsets in arrays.chunks(b.column("text")):
                starts, ends, _ = arrays.words(data, offsets)
                tallies[WORDS].add(arrays.word_hashes(data, starts, ends, powers).view("int64"))
                tallies[GRAMS].add(grams(data, offsets)[0])
                yield from (out(k) for k, t in tallies.items() if t.full)
        yield from (out(k) for k in tallies)

    return training.select("text").mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Trie:
    """Contexts of each length with the bytes that follow; costs are log10 probabilities."""

    def __init__(self, keys: list[np.ndarray], counts: list[np.ndarray], seen: np.ndarray | None = None):
        """``keys[o]``: sorted context of o bytes, then the byte, as one number; ``counts[o]`` beside it.

        ``seen`` has a bit for each longest context of the training texts, where the trie does not hold them all.
        """
        self.keys, self.counts, self.seen, self.memo = keys, counts, seen, {}
        k, c = keys[ORDER], counts[ORDER]
        self.held = np.unique(k >> 8)
        if len(k):
            edge = np.flatnonzero(np.concatenate(([True], k[1:] >> 8 != k[:-1] >> 8)))
            total = np.add.reduceat(c, edge) + np.diff(np.append(edge, len(k)))
            self.known = np.log10(c / np.repeat(total, np.diff(np.append(edge, len(k)))))
        else:
            self.known = np.empty(0)

    def elsewhere(self, unique: np.ndarray) -> np.ndarray:
        """Which grams have a context that was seen, but is not in the trie."""
        if self.seen is None:
            return np.zeros(len(unique), bool)
        context = unique >> 8
        out = (self.seen[context >> 3] >> (context & 7)) & 1 == 1
        if len(self.held):
            out &= self.held[np.minimum(np.searchsorted(self.held, context), len(self.held) - 1)] != context
        return out

    def cost(self, gram: int, longest: tuple[np.ndarray, np.ndarray] | None = None) -> float:
        """By escapes from the longest context that the trie holds, or from ``longest``: bytes and counts of one that it does not hold."""
        byte, out, excluded = gram & 0xFF, 0.0, np.zeros(256, bool)
        for o in range(ORDER, -1, -1):
            context = (gram >> 8) & ((1 << 8 * o) - 1)
            lo, hi = np.searchsorted(self.keys[o], (context << 8, (context + 1) << 8))
            after, n = (self.keys[o][lo:hi] & 0xFF).astype(int), self.counts[o][lo:hi]
            if o == ORDER and longest is not None:
                after, n = longest
            free = ~excluded[after]
            after, n = after[free], n[free]
            if not len(after):
                continue
            total = n.sum() + len(n)
            here = np.flatnonzero(after == byte)
            if len(here):
                return out + float(np.log10(n[here[0]] / total))
            out += float(np.log10(len(n) / total))
            excluded[after] = True
        return out - float(np.log10(256 - excluded.sum()))

    def costs(self, unique: np.ndarray) -> np.ndarray:
        """Of sorted grams: a look-up for those in the trie, escapes for the rest."""
        at = np.searchsorted(self.keys[ORDER], unique)
        out = np.zeros(len(unique))
        found = np.zeros(len(unique), bool)
        if len(self.known):
            at = np.minimum(at, len(self.known) - 1)
            found = self.keys[ORDER][at] == unique
            out[found] = self.known[at[found]]
        for i in np.flatnonzero(~found):
            g = int(unique[i])
            if g not in self.memo:
                if len(self.memo) > 500_000:
                    self.memo.clear()
                self.memo[g] = self.cost(g)
            out[i] = self.memo[g]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
        """log10 probability of each text without the grams that are ``elsewhere``, and these: how often (upper 32 bits) and which."""
        code, begin = grams(data, offsets)
        unique, at = np.unique(code, return_inverse=True)
        unique = unique.astype("int64")
        away = self.elsewhere(unique)
        costs = np.zeros(len(unique))
        costs[~away] = self.costs(unique[~away])
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
        out = away[at]
        pairs, n = np.unique(text[out] << 32 | code[out].astype("int64"), return_counts=True)
        cut = np.searchsorted(pairs >> 32, np.arange(len(offsets))).astype("int32")
        return np.add.reduceat(costs[at], begin[:-1]), pa.ListArray.from_arrays(pa.array(cut), pa.array(n.astype("int64") << 32 | pairs & 0xFFFFFFFF))


def _trie(counted: DataFrame, max_contexts: int) -> Trie:
    found = counted.filter(F.col("kind") == GRAMS)
    keys, counts = [], []
    low = found.groupBy(F.col("key").bitwiseAND((1 << 24) - 1).alias("key")).agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    k, n = low["key"].to_numpy("int64"), low["n"].to_numpy("int64")
    for o in range(ORDER):
        u, at = np.unique(k & ((1 << 8 * (o + 1)) - 1), return_inverse=True)
        keys.append(u)
        counts.append(np.bincount(at, n, len(u)))
    found = found.withColumn("context", F.shiftright("key", 8))
    kept, whole = frequent(stored(found.groupBy("context").agg(F.sum("n").alias("n"))), max_contexts)
    rest = not whole
    high = (found.join(F.broadcast(kept.select("context")), "context", "left_semi") if rest else found).select("key", "n").toPandas().sort_values("key")
    keys.append(high["key"].to_numpy("int64"))
    counts.append(high["n"].to_numpy("float64"))
    return Trie(keys, counts, _seen(found) if rest else None)


def _seen(found: DataFrame) -> np.ndarray:
    """A bit for each context, gathered in Spark to 512 bitmaps of 32,768 bits; their functions count places from 1."""
    place = F.col("context") + 1
    bits = np.zeros((512, 4096), "uint8")
    for r in found.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect():
        bits[r["at"] - 1] = np.frombuffer(r["bits"], "uint8")
    return bits.ravel()


def _costs(wanted: DataFrame, counted: DataFrame, trie: Broadcast) -> DataFrame:
    """``key, cost`` of the grams ``wanted``, whose contexts the trie does not hold: from all that followed their contexts (at most 256 bytes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, after in zip(b.column("key").to_pylist(), b.column("after")):
                followed = after.values.to_numpy()
                out.append(trie.value.cost(key, (followed & 0xFF, followed >> 8)))
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.float64())], ["key", "cost"])

    context = F.shiftright("key", 8).alias("context")
    wanted = wanted.select("key").distinct().select("key", context)
    followed = counted.filter(F.col("kind") == GRAMS).select(context, (F.shiftleft("n", 8) + F.col("key").bitwiseAND(0xFF)).alias("after"))
    followed = followed.join(wanted.select("context").distinct(), "context", "left_semi").groupBy("context").agg(F.collect_list("after").alias("after"))
    return wanted.join(followed, "context").select("key", "after").mapInArrow(work, "key long, cost double")


def score(
    docs: DataFrame, mod: int = 7, held_out: int = 2, max_contexts: int = 1 << 15, max_words: int = 1 << 16,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows whose ``crc32(id as text) % mod`` is not ``held_out``; null ids train.  Tokens are
    words in lower case (A-Z) and an end per text, of texts of any length.  ``base_score`` sums log10((c + 1) / (N + V + 1)) over
    the tokens; ``score`` is the model's log10 probability of the text.  Null and empty texts are just an
    end.  Repeated rows count each time.  With no training rows nothing is known and bytes are alike.
    An empty table gives no rows.  Only the two named columns are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", labelled.remainder(F.col("doc_id"), mod) == held_out)
    training = rows.filter(~F.col("held_out"))
    counted = stored(_counts(training))
    ends = training.count()
    total = counted.filter(F.col("kind") == WORDS).agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    train_tokens = (total["n"] or 0) + ends
    distinct = total["v"] + (1 if ends else 0)
    model = _trie(counted, max_contexts)
    whole = model.seen is None
    trie = spark.sparkContext.broadcast(model)
    words = counted.filter(F.col("kind") == WORDS).select("key", "n")
    top = frequent(words, max_words)[0].toPandas().sort_values("key")
    common_words = spark.sparkContext.broadcast((top["key"].to_numpy("int64"), top["n"].to_numpy("int64")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, (common, n_common) = arrays.Powers(), common_words.value
        for b in batches:
            for row, data, offsets in arrays.chunks(b.column("text")):
                starts, ends, first = arrays.words(data, offsets)
                h = arrays.word_hashes(data, starts, ends, powers).view("int64")
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                at = np.minimum(np.searchsorted(common, h), max(0, len(common) - 1))
                hit = common[at] == h if len(common) else np.zeros(len(h), bool)
                n = len(offsets) - 1
                logs = np.bincount(text[hit], np.log10(n_common[at[hit]] + 1.0), n)
                known = np.bincount(text[hit], minlength=n)
                rest, rest_text = h[~hit], text[~hit]
                cut = np.searchsorted(rest_text, np.arange(n + 1)).astype("int32")
                score, away = trie.value.score(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(c).slice(row, n) for c in ("doc_id", "held_out", "place")), pa.array(np.diff(first) + 1), pa.array(known.astype("int64")),
                        pa.array(logs.astype("float64")), pa.array(score), pa.ListArray.from_arrays(pa.array(cut), pa.array(rest)), away,
                    ],
                    ["doc_id", "held_out", "place", "n_tokens", "known", "logs", "score", "rest", "away"],
                )

    schema = "doc_id long, held_out boolean, place long, n_tokens long, known long, logs double, score double, rest array<long>, away array<long>"
    # Stored: the texts are read once for this, and places stay as they are.
    found = stored(rows.withColumn("place", F.monotonically_increasing_id()).mapInArrow(work, schema))
    rare = found.select("place", F.explode("rest").alias("key")).groupBy("place", "key").agg(F.count("*").alias("tf"))
    part = rare.join(words, "key").select("place", "tf", (F.col("tf") * F.log10(F.col("n") + 1.0)).alias("more"), F.lit(0.0).alias("cost"))
    if not whole:
        away = found.select("place", F.explode("away").alias("away"))
        away = away.select("place", F.col("away").bitwiseAND(0xFFFFFFFF).alias("key"), F.shiftright("away", 32).alias("tf"))
        costs = _costs(away, counted, trie)
        part = part.unionByName(away.join(costs, "key").select("place", F.lit(0).cast("long").alias("tf"), F.lit(0.0).alias("more"), F.col("tf") * F.col("cost")).toDF(*part.columns))
    matched = part.groupBy("place").agg(F.sum("tf").alias("tf"), F.sum("more").alias("more"), F.sum("cost").alias("cost"))
    base = F.col("logs") + F.coalesce("more", F.lit(0.0)) + float(np.log10(ends + 1.0)) - F.col("n_tokens") * float(np.log10(train_tokens + distinct + 1.0))
    return found.drop("rest", "away").join(matched, "place", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("tf", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.coalesce("cost", F.lit(0.0))).alias("score"),
    )
