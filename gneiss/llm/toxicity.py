"""Counterfactual-regularised toxicity classifier.

A logistic model over the words of a text and their beginnings.  Besides the log loss, training
penalises what happens to the score of a labelled sentence when an identity term in it is swapped for
another, so that the mere mention of a group moves no score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm import arrays, labelled
from gneiss.llm.scratch import discard, stored

#: Identity terms that may stand for each other in a sentence, in the languages of the corpus; a parameter of ``train``.
IDENTITY_TERMS = (
    ("he", "she"), ("him", "her"), ("his", "hers"), ("women", "men"), ("woman", "man"), ("girl", "boy"), ("son", "daughter"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrant", "refugee", "citizen", "native"),
    ("immigrants", "refugees", "citizens", "natives"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("er", "sie"), ("mann", "frau"), ("männer", "frauen"), ("il", "elle"), ("homme", "femme"), ("hommes", "femmes"), ("él", "ella"), ("hombre", "mujer"), ("hombres", "mujeres"),
)
#: Bytes of a word's beginnings that are features, besides the word itself.
PREFIXES = (4, 5, 6)
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]?")


def features(data: np.ndarray, offsets: np.ndarray, powers: arrays.Powers) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of all words, then of their beginnings (0 where a word is shorter); the first word of each text."""
    starts, ends, first = arrays.words(data, offsets)
    up, down = powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, "uint64")
    np.cumsum((arrays.LOWER[data].astype("uint64") + np.uint64(1)) * up[:-1], out=sums[1:])
    out = [arrays.mixed((sums[ends] - sums[starts]) * down[starts])]
    for n in PREFIXES:
        stop = np.minimum(starts + n, ends)
        part = arrays.mixed((sums[stop] - sums[starts]) * down[starts] + np.uint64(n))
        out.append(np.where(ends - starts >= n, part, np.uint64(0)))
    return out, starts, first


class ToxicityModel:
    """Presence of the chosen features, weighted; ``keys`` are sorted hashes."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(keys >> np.uint64(44)).astype(int)] = True

    def present(self, data: np.ndarray, offsets: np.ndarray, powers: arrays.Powers) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) pairs, each once."""
        hashes, _, first = features(data, offsets, powers)
        found = []
        for h in hashes:
            at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            k = np.searchsorted(self.keys, h[at])
            hit = self.keys[np.minimum(k, len(self.keys) - 1)] == h[at] if len(self.keys) else np.zeros(len(at), bool)
            text = np.searchsorted(first, at[hit], side="right") - 1
            found.append(text.astype(np.int64) * max(1, len(self.keys)) + k[hit])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.keys)), pairs % max(1, len(self.keys))

    def score(self, data: np.ndarray, offsets: np.ndarray, powers: arrays.Powers) -> np.ndarray:
        text, k = self.present(data, offsets, powers)
        z = self.bias + np.bincount(text, self.weights[k] if len(self.keys) else None, minlength=len(offsets) - 1)[: len(offsets) - 1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def swapped(text: str, groups: Sequence[Sequence[str]]) -> Iterator[tuple[str, str]]:
    """Each sentence with an identity term, and the same with the term replaced by each other of its group."""
    others = {t: [o for o in g if o != t] for g in groups for t in g}
    for sentence in SENTENCE.findall(text):
        for word in dict.fromkeys(LETTERS.findall(sentence)):
            for other in others.get(word.lower(), ()):
                yield sentence, re.sub(rf"\b{word}\b", other, sentence)


def fit(bags: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], width: int, penalty: float, decay: float = 0.01, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Adam on the log loss of the documents plus ``penalty`` times the mean squared logit change of the pairs."""
    w, bias = np.zeros(width), 0.0
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    col = np.concatenate(bags) if bags else np.empty(0, int)
    # A pair's change is a signed bag: + what the swap brings, - what it takes.
    prow = np.concatenate([np.full(len(a) + len(b), i) for i, (a, b) in enumerate(pairs)]) if pairs else np.empty(0, int)
    pcol = np.concatenate([np.concatenate((a, b)) for a, b in pairs]) if pairs else np.empty(0, int)
    sign = np.concatenate([np.repeat([-1.0, 1.0], [len(a), len(b)]) for a, b in pairs]) if pairs else np.empty(0)
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / max(1, len(labels))
    m = v = mb = vb = 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(row, w[col], minlength=len(bags))
        err = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels)
        g = np.bincount(col, err[row], minlength=width) + decay * w / max(1, width)
        if len(pairs):
            change = np.bincount(prow, sign * w[pcol], minlength=len(pairs))
            g += 2 * penalty / len(pairs) * np.bincount(pcol, sign * change[prow], minlength=width)
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    return w, float(bias)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view("int64")


def train(
    docs: DataFrame, labels: DataFrame, limit: int = 12_000, min_share: float = 1e-3, min_z: float = 4.0,
    penalty: float = 1.0, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, id_col: str = "doc_id", text_col: str = "text",
) -> ToxicityModel:
    """A model from about ``limit`` labelled documents at most.

    Features are counted by Spark; those whose share differs between the labels by ``min_z`` standard
    errors are kept if they are in 3 documents and ``min_share`` of them, with those of the identity terms; so at most
    ``1 / min_share`` times the features of a document are.  Only the chosen features of the sample reach the driver.  The penalty takes every
    swap of each text (a word's other places in the sentence change with it).  Without labelled rows the score is 0.5 for all.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = arrays.Powers()
        for b in batches:
            for row, data, offsets in arrays.chunks(b.column("text")):
                hashes, _, first = features(data, offsets, powers)
                lists = []
                for i, j in zip(first[:-1], first[1:], strict=True):
                    own = np.unique(np.concatenate([h[i:j] for h in hashes]))
                    lists.append(_signed(own[own != 0]))
                n = len(lists)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists, pa.list_(pa.int64())), b.column("label").slice(row, n), b.column("text").slice(row, n)], ["keys", "label", "text"]
                )

    drawn = stored(labelled.sample(docs, labels, "toxic", limit, id_col, text_col).mapInArrow(extract, "keys array<long>, label int, text string"))
    total = drawn.agg(F.count("*").alias("n"), F.sum("label").alias("pos")).first()
    n, pos = total["n"], total["pos"] or 0
    if not n:
        discard(drawn)
        return ToxicityModel(np.empty(0, "uint64"), np.empty(0), 0.0)
    share = pos / n
    counts = drawn.select(F.explode("keys").alias("key"), "label").groupBy("key").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    z = F.abs(F.col("pos") - F.col("n") * share) / F.sqrt(F.col("n") * max(share * (1 - share), 1e-9))
    best = counts.filter(F.col("n") >= max(3, min_share * n)).withColumn("z", z).filter(F.col("z") >= min_z)
    powers = arrays.Powers()

    def keys_of(text: str) -> np.ndarray:
        _, data, offsets = next(arrays.chunks(pa.array([text], pa.string())))
        own = np.unique(np.concatenate(features(data, offsets, powers)[0]))
        return own[own != 0]

    chosen = np.array([r["key"] for r in best.select("key").collect()], "int64").view("uint64")
    keys = np.unique(np.concatenate([chosen, *(keys_of(t) for g in groups for t in g)]))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = arrays.Powers()

        def indexes(texts: list[str]) -> list[np.ndarray]:
            if not len(keys):
                return [np.empty(0, int)] * len(texts)
            out = []
            for _, data, offsets in arrays.chunks(pa.array(texts, pa.string())):
                hashes, _, first = features(data, offsets, own)
                every = np.concatenate(hashes)
                text = np.tile(np.repeat(np.arange(len(offsets) - 1), np.diff(first)), len(hashes))
                at = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
                hit = keys[at] == every
                pair = np.unique(text[hit] * len(keys) + at[hit])
                out += np.split(pair % len(keys), np.searchsorted(pair // len(keys), np.arange(1, len(offsets) - 1)))
            return out

        kind = pa.list_(pa.int64())
        for b in (x.slice(at, 64) for x in batches for at in range(0, x.num_rows, 64)):
            # The swaps of many texts become bags at once.
            swaps = [s for text in b.column("text").to_pylist() for s in swapped(text, groups)]
            before, after = (indexes(list(side)) for side in zip(*swaps, strict=True)) if swaps else ([], [])
            whole = [np.flatnonzero(np.isin(keys, k.values.to_numpy().view("uint64"))) for k in b.column("keys")]
            kinds = b.column("label").to_pylist() + [2] * len(swaps)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(whole + before, kind), pa.array([None] * len(whole) + after, kind)], ["kind", "a", "b"])

    got = drawn.mapInArrow(choose, "kind int, a array<long>, b array<long>").toPandas()
    discard(drawn)
    # Order of arrival must not matter.
    rows = sorted((int(k), tuple(a), tuple(b) if k == 2 else ()) for k, a, b in zip(got["kind"], got["a"], got["b"], strict=True))
    as_array = lambda x: np.array(x, int)
    bags = [as_array(a) for k, a, _ in rows if k < 2]
    pairs = [(as_array(a), as_array(b)) for k, a, b in rows if k == 2]
    weights, bias = fit(bags, np.array([k for k, _, _ in rows if k < 2], float), pairs, len(keys), penalty)
    return ToxicityModel(keys, weights, bias)


def clean_rows(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that ``score`` does not predict as toxic; each is judged by its own text."""
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = arrays.Powers()
        for b in batches:
            for row, data, offsets in arrays.chunks(b.column(at)):
                y = model.score(data, offsets, powers)
                yield b.slice(row, len(y)).filter(pa.array(~(y >= threshold)))

    return docs.mapInArrow(work, docs.schema)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    All words of every text count; null and empty texts get the model's prior.  Rows are independent and
    nothing is shuffled.  Null ids are not held out.  Only the two named columns are read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = arrays.Powers()
        for b in batches:
            for row, data, offsets in arrays.chunks(b.column("text")):
                y = model.score(data, offsets, powers)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, len(y)), pa.array(y)], ["doc_id", "score"])

    return labelled.scored(docs, work, id_col, text_col, threshold)
