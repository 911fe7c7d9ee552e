"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded, a gated attention network that learns from
document labels alone weighs the passages, and the weighted representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gneiss.llm import arrays, labelled

#: Byte classes whose share of a passage is a feature.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"?", b".,;:'\"()-", b"#$%&*", b"|<>{}[]\\/=_~^`+@", b"\n", bytes(range(0x80, 0x100)))
PASSAGE_WORDS = 64


def _class_table() -> np.ndarray:
    table = np.zeros((len(CLASSES), 256), "float32")
    for i, members in enumerate(CLASSES):
        table[i, list(members)] = 1
    return table


def passages(data: np.ndarray, offsets: np.ndarray, powers: arrays.Powers) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the place of each text's first passage.

    Passages are runs of 64 words, the last shorter; a text without words is one passage of zeros.
    """
    table = _class_table()
    starts, ends, first = arrays.words(data, offsets)
    count = np.diff(first)
    n = np.maximum(1, -(-count // PASSAGE_WORDS))
    begin = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros((begin[-1], len(CLASSES) + 6), "float32")
    if not len(starts):
        return out, begin
    text = np.repeat(np.arange(len(n)), n)
    at = first[text] + PASSAGE_WORDS * (np.arange(begin[-1]) - begin[text])
    full = count[text] > 0
    at = at[full]
    size = np.diff(np.append(at, len(starts))).astype("float32")
    hashes = arrays.word_hashes(data, starts, ends, powers)
    owner = np.repeat(np.arange(len(at)), size.astype(int))
    byte_at = starts[at]
    length = np.diff(np.append(byte_at, len(data))).astype("float32")
    for i in range(len(CLASSES)):
        out[full, i] = np.add.reduceat(table[i][data], byte_at) / length
    same = np.zeros(len(hashes), "float32")
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    key = np.sort((owner.astype("uint64") << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.ones(len(key), "float32")
    fresh[1:] = key[1:] != key[:-1]
    k = len(CLASSES)
    out[full, k] = np.add.reduceat(same, at) / size
    out[full, k + 1] = np.add.reduceat(fresh, at) / size
    out[full, k + 2] = np.add.reduceat((ends - starts).astype("float32"), at) / size / 10
    out[full, k + 3] = np.add.reduceat((ends - starts == 1).astype("float32"), at) / size
    out[full, k + 4] = np.add.reduceat(table[0][data[starts]], at) / size
    out[full, k + 5] = np.log1p(size) / 4
    return out, begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """h = tanh(x W + b); attention = softmax(u . (tanh(h V) * sigmoid(h G))); score = sigmoid(c . sum(attention h) + d)."""

    def __init__(self, width: int, hidden: int = 16, gate: int = 8, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": draw(width, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "G": draw(hidden, gate), "u": draw(gate), "c": draw(hidden), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def forward(self, x: np.ndarray, begin: np.ndarray) -> dict:
        p, s = self.p, {}
        s["x"] = (x - self.mean) / self.scale
        s["h"] = np.tanh(s["x"] @ p["W"] + p["b"])
        s["t"], s["g"] = np.tanh(s["h"] @ p["V"]), _sigmoid(s["h"] @ p["G"])
        e = np.clip((s["t"] * s["g"]) @ p["u"], -30, 30)
        w = np.exp(e)
        s["bag"] = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        s["a"] = w / np.add.reduceat(w, begin[:-1])[s["bag"]]
        s["z"] = np.add.reduceat(s["a"][:, None] * s["h"], begin[:-1])
        s["y"] = _sigmoid(s["z"] @ p["c"] + p["d"][0])
        return s

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self.forward(x, begin)["y"]

    def fit(self, x: np.ndarray, begin: np.ndarray, labels: np.ndarray, steps: int = 250, rate: float = 0.03, decay: float = 1e-4) -> AttentionModel:
        """Adam on the mean log loss, the rarer label weighted up to the other."""
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / len(labels)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            p, s = self.p, self.forward(x, begin)
            dy = weight * (s["y"] - labels)
            dz = dy[:, None] * p["c"]
            da = (dz[s["bag"]] * s["h"]).sum(1)
            mean_da = np.add.reduceat(s["a"] * da, begin[:-1])
            de = s["a"] * (da - mean_da[s["bag"]])
            dt = de[:, None] * p["u"] * s["g"] * (1 - s["t"] ** 2)
            dg = de[:, None] * p["u"] * s["t"] * s["g"] * (1 - s["g"])
            dh = s["a"][:, None] * dz[s["bag"]] + dt @ p["V"].T + dg @ p["G"].T
            dx = dh * (1 - s["h"] ** 2)
            grads = {"W": s["x"].T @ dx, "b": dx.sum(0), "V": s["h"].T @ dt, "G": s["h"].T @ dg, "u": (s["t"] * s["g"]).T @ de, "c": s["z"].T @ dy, "d": np.array([dy.sum()])}
            for k, g in grads.items():
                g = g + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, limit: int = 4000, most: int = 256, id_col: str = "doc_id", text_col: str = "text") -> AttentionModel:
    """A model from about ``limit`` labelled documents at most; their features (15 numbers a passage) meet on the driver.

    Of a longer text than ``most`` passages, as many are learned from, evenly spread over it.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = arrays.Powers()
        for b in batches:
            mark = b.column("label").to_numpy()
            for row, data, offsets in arrays.chunks(b.column("text")):
                x, begin = passages(data, offsets, powers)
                bags = [x[i:j][np.unique(np.linspace(0, j - i - 1, min(j - i, most)).astype(int))].tobytes() for i, j in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), pa.array(mark[row : row + len(bags)])], ["bag", "label"])

    got = labelled.sample(docs, labels, "quality", limit, id_col, text_col).mapInArrow(encode, "bag binary, label int").toPandas()
    width = len(CLASSES) + 6
    if not len(got):
        return AttentionModel(width)
    # Order of arrival must not matter.
    got = got.sort_values(["bag", "label"])
    bags = [np.frombuffer(b, "float32").reshape(-1, width) for b in got["bag"]]
    begin = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    return AttentionModel(width).fit(np.concatenate(bags).astype("float64"), begin, got["label"].to_numpy("float64"))


def score(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Every passage of every text is encoded; null and empty texts are one passage of zeros.  Rows are
    independent and nothing is shuffled.  Null ids are not held out.  Only the two named columns are read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = arrays.Powers()
        for b in batches:
            for row, data, offsets in arrays.chunks(b.column("text")):
                x, begin = passages(data, offsets, powers)
                y = model.score(x.astype("float64"), begin)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, len(y)), pa.array(y)], ["doc_id", "score"])

    return labelled.scored(docs, work, id_col, text_col, threshold)
