"""Personal data: fixed rules, and a character BiLSTM-CRF that adds spans.

The model reads overlapping windows of a text.  Each window gives every character of it emission
scores; where windows overlap, each character keeps those of the window in which it lies furthest
from an edge, and one CRF decoding over the joined stretch settles all spans together.

The model learns what the rules miss: spans written apart, with words for their signs, brackets,
spaces or other separators (``pii_forms``).  A span that it adds must be of its kind once these are
undone.  Each such span holds a digit, an at sign, a word for a dot, a bracketed sign, or an at before
a name with a dot; a window without any of these cannot yield one, and is not read.  Names, addresses
and numbers in words are no kind of span here and are not found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.pii_forms import TRIGGER, digits_of, holds, luhn, windows_to_learn

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits matches from its first digit or not at all, so possessive forms find the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, end, kind


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email rule, found from their at signs: the local part is the run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The rules' matches by start, then kind; a match that fails its test is dropped."""
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        # Parts of over three digits after leading zeros exceed 255.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        d = digits_of(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# --- The model -----------------------------------------------------------------------------------

#: Tags: outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 64, 32


def _char_ids(text: str) -> np.ndarray:
    """Printable ASCII by itself, white space, and all else by one id each."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.where((code >= 32) & (code < 127), code - 30, np.where(code < 32, 0, 1))


CHARS = 97


def _tags(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for a, b, k in spans:
        if not out[a:b].any():
            out[a], out[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
    return out


def _allowed() -> np.ndarray:
    """Score 0 for transitions that make sense, a large negative one for an inside without its begin."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        for before in range(TAGS):
            if before not in (inside - 1, inside):
                out[before, inside] = -1e4
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstmCrf:
    """One-hot characters, a forward and a backward LSTM, a linear layer, and CRF transitions."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["E" + d] = rng.normal(0, 0.3, (CHARS, 4 * hidden))
            self.p["R" + d] = rng.normal(0, 0.3, (hidden, 4 * hidden))
            self.p["E" + d][:, hidden : 2 * hidden] += 1.0  # open forget gates
        self.p["O"] = rng.normal(0, 0.3, (2 * hidden, TAGS))
        self.p["o"] = np.zeros(TAGS)
        self.p["T"] = np.zeros((TAGS, TAGS))
        self.mask = _allowed()

    def _lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of windows (n, time) of character ids, in the order of reading."""
        n, time = x.shape
        k = self.hidden
        kind = self.p["O"].dtype
        h, c, out = np.zeros((n, k), kind), np.zeros((n, k), kind), np.empty((n, time, k), kind)
        for t in range(time):
            z = self.p["E" + d][x[:, t]] + h @ self.p["R" + d]
            gates, g = _sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k :])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            old_c, old_h = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep is not None:
                keep.append((i, f, o, g, old_c, tc, old_h))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        h = np.concatenate((self._lstm(x, "f"), self._lstm(x[:, ::-1], "b")[:, ::-1]), axis=2)
        return h @ self.p["O"] + self.p["o"]

    def _lstm_back(self, x: np.ndarray, d: str, keep: list, dout: np.ndarray, grads: dict) -> None:
        n, time = x.shape
        k = self.hidden
        kind = self.p["O"].dtype
        dh, dc = np.zeros((n, k), kind), np.zeros((n, k), kind)
        # Products are kept small, so that no numeric library takes threads of its own for them.
        dz, gr = np.empty((time, n, 4 * k), kind), np.zeros_like(self.p["R" + d])
        back = np.ascontiguousarray(self.p["R" + d].T)
        for t in range(time - 1, -1, -1):
            i, f, o, g, old_c, tc, old_h = keep[t]
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            z = dz[t]
            z[:, :k] = dc * g * i * (1 - i)
            z[:, k : 2 * k] = dc * old_c * f * (1 - f)
            z[:, 2 * k : 3 * k] = dh * tc * o * (1 - o)
            z[:, 3 * k :] = dc * i * (1 - g * g)
            gr += old_h.T @ z
            dh, dc = z @ back, dc * f
        # Rows of one character are added up in runs.
        chars = x.T.reshape(-1)
        order = np.argsort(chars, kind="stable")
        met, first = np.unique(chars[order], return_index=True)
        ge = np.zeros_like(self.p["E" + d])
        ge[met] = np.add.reduceat(dz.reshape(-1, 4 * k)[order], first, axis=0)
        grads["E" + d], grads["R" + d] = ge, gr

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tag paths, and its gradients."""
        n, time = x.shape
        kf: list = []
        kb: list = []
        hf, hb = self._lstm(x, "f", kf), self._lstm(x[:, ::-1], "b", kb)[:, ::-1]
        h = np.concatenate((hf, hb), axis=2)
        e = h @ self.p["O"] + self.p["o"]
        # The forward and backward sums run on exponentials, scaled by each row's largest term.
        trans = self.p["T"].astype("float64") + self.mask
        moves, e = np.exp(trans), e.astype("float64")
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, time):
            top = alpha[:, t - 1].max(1, keepdims=True)
            alpha[:, t] = np.log(np.exp(alpha[:, t - 1] - top) @ moves + 1e-300) + top + e[:, t]
        for t in range(time - 2, -1, -1):
            ahead = e[:, t + 1] + beta[:, t + 1]
            top = ahead.max(1, keepdims=True)
            beta[:, t] = np.log(np.exp(ahead - top) @ moves.T + 1e-300) + top
        top = alpha[:, -1].max(1)
        z = np.log(np.exp(alpha[:, -1] - top[:, None]).sum(1)) + top
        rows = np.arange(n)[:, None]
        gold = e[rows, np.arange(time), y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(alpha + beta - z[:, None, None])
        de[rows, np.arange(time), y] -= 1
        before, after = alpha[:, :-1], (e + beta)[:, 1:]
        low, high = before.max(2, keepdims=True), after.max(2, keepdims=True)
        weight = np.exp(before - low + (low + high - z[:, None, None]))
        dt = moves * np.einsum("ntj,ntk->jk", weight, np.exp(after - high))
        np.add.at(dt, (y[:, :-1], y[:, 1:]), -1)
        de = de.astype(h.dtype)
        grads = {"O": np.einsum("nth,ntk->hk", h, de), "o": de.sum((0, 1)), "T": np.where(self.mask < 0, 0, dt)}
        dh = de @ self.p["O"].T
        k = self.hidden
        self._lstm_back(x, "f", kf, dh[:, :, :k], grads)
        self._lstm_back(x[:, ::-1], "b", kb, dh[:, ::-1, k:], grads)
        return float((z - gold).mean()), {name: g / n for name, g in grads.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 800, batch: int = 64, rate: float = 0.02, seed: int = 4) -> BiLstmCrf:
        """Adam over mini-batches of windows."""
        rng = np.random.default_rng(seed)
        self.p = {k: v.astype("float32") for k, v in self.p.items()}
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            _, grads = self.loss(x[pick], y[pick])
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g.astype("float32")
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                self.p[k] = self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def best_path(self, e: np.ndarray) -> np.ndarray:
        """The likeliest tags of one stretch of emissions (time, tags)."""
        return self.best_paths([e])[0]

    def best_paths(self, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest tags of each stretch; stretches of like lengths are decoded together."""
        trans = self.p["T"] + self.mask
        out: list = [None] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
        at = 0
        while at < len(order):
            group = [order[at]]
            at += 1
            # The longest sets the work of its group: it may exceed the shortest by half, and a group holds a bounded number of characters.
            while at < len(order) and len(stretches[order[at]]) * (len(group) + 1) <= 200_000 and 2 * len(stretches[order[at]]) <= 3 * len(stretches[group[0]]) + 64:
                group.append(order[at])
                at += 1
            lengths = np.array([len(stretches[i]) for i in group])
            e = np.zeros((len(group), lengths.max(), TAGS))
            for row, i in enumerate(group):
                e[row, : lengths[row]] = stretches[i]
            score = e[:, 0] + self.mask[0]
            back = np.empty((len(group), lengths.max(), TAGS), np.int8)
            for t in range(1, lengths.max()):
                step = score[:, :, None] + trans
                back[:, t] = step.argmax(1)
                # A stretch that has ended keeps its scores.
                score = np.where((t < lengths)[:, None], step.max(1) + e[:, t], score)
            rows = np.arange(len(group))
            path = np.zeros((len(group), lengths.max()), np.int64)
            tag = score.argmax(1)
            for t in range(lengths.max() - 1, -1, -1):
                path[:, t] = tag
                if t:
                    tag = np.where(t < lengths, back[rows, t, tag], tag)
            for row, i in enumerate(group):
                out[i] = path[row, : lengths[row]]
        return out


def windows(ids: np.ndarray, triggers: np.ndarray) -> np.ndarray:
    """Starts of the windows, one every ``STRIDE`` characters over the whole text, that hold a trigger."""
    last = max(0, -(-(len(ids) - WINDOW) // STRIDE))
    near = {min(max(0, int(t) // STRIDE - j), last) for t in triggers for j in range(WINDOW // STRIDE)}
    return np.array(sorted(s for s in near if ((triggers >= s * STRIDE) & (triggers < s * STRIDE + WINDOW)).any()), np.int64) * STRIDE


def _cut(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate((ids, np.zeros(WINDOW, np.int64)))
    return padded[starts[:, None] + np.arange(WINDOW)]


def _triggers(text: str) -> np.ndarray:
    """Places where something begins without which there is no span."""
    return np.array([m.start() for m in TRIGGER.finditer(text)], np.int64)


def model_spans(texts: list[str], model: BiLstmCrf, step: int = 2048) -> list[list[Span]]:
    """Spans of each text after its windows are decoded together; ``step`` windows are read at a time."""
    inner = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    out: list[list[Span]] = [[] for _ in texts]
    triggers: dict[int, np.ndarray] = {}
    pending: list[tuple[int, int, int, np.ndarray]] = []  # text, first and last place of a stretch, its windows
    held = 0

    def settle() -> None:
        cut = np.concatenate([c for *_, c in pending])
        e = np.concatenate([model.emissions(cut[i : i + step]) for i in range(0, len(cut), step)])
        joined, at = [], 0
        for _, begin, end, c in pending:
            size = (len(c) - 1) * STRIDE + WINDOW
            scores, depth = np.zeros((size, TAGS)), np.full(size, -1)
            for w in range(len(c)):
                lo = w * STRIDE
                better = inner > depth[lo : lo + WINDOW]
                scores[lo : lo + WINDOW][better] = e[at + w][better]
                depth[lo : lo + WINDOW][better] = inner[better]
            at += len(c)
            joined.append(scores[: end - begin])
        for (i, begin, *_), path in zip(pending, model.best_paths(joined), strict=True):
            out[i] += _spans_of(path, begin, triggers[i])

    for i, text in enumerate(texts):
        places = _triggers(text)
        if not len(places):
            continue
        ids, triggers[i] = _char_ids(text), places
        starts = windows(ids, places)
        # A stretch: windows each of which overlaps the next.
        for group in np.split(starts, np.flatnonzero(np.diff(starts) > STRIDE) + 1):
            pending.append((i, int(group[0]), min(int(group[-1]) + WINDOW, len(ids)), _cut(ids, group)))
            held += len(group)
            if held >= step:
                settle()
                pending, held = [], 0
    if pending:
        settle()
    return out


def _spans_of(path: np.ndarray, begin: int, triggers: np.ndarray) -> list[Span]:
    spans, i = [], 0
    while i < len(path):
        if path[i] % 2 == 1:
            kind, j = (int(path[i]) - 1) // 2, i + 1
            while j < len(path) and path[j] == 2 + 2 * kind:
                j += 1
            a, b = begin + i, begin + j
            if np.searchsorted(triggers, a) < np.searchsorted(triggers, b):
                spans.append((a, b, kind))
            i = j
        else:
            i += 1
    return spans


def train(docs: DataFrame, limit: int = 2000, text_col: str = "text", labelled: DataFrame | None = None) -> BiLstmCrf:
    """A model from at most about ``limit`` different texts with digits or at signs, drawn by a hash of the text.

    Labels are the rules' spans, or those of ``labelled`` (text, spans array<struct<start,end,kind>>).
    Of a drawn text come at most four windows as they stand and, of at most four spans, windows in which
    they are written apart (``pii_forms``), so the driver holds at most ``200 * limit`` windows of 64
    characters.  With nothing to learn from, the model finds nothing.
    """
    if labelled is None:
        some = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]")).withColumn("hash", F.xxhash64("text"))
        share = limit / max(limit, some.agg(F.approx_count_distinct("hash")).first()[0])
        # Copies of a text are drawn together, and count once.
        drawn = some.filter(F.pmod("hash", F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("hash").agg(F.first("text").alias("text"))
        rows = drawn.withColumn("spans", F.lit(None).cast("array<struct<start:int,end:int,kind:int>>"))
    else:
        rows = labelled.select("text", F.col("spans").cast("array<struct<start:int,end:int,kind:int>>").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = [], []
            for text, given in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                text = text or ""
                ids, spans = _char_ids(text), base_spans(text) if given is None else [(s["start"], s["end"], s["kind"]) for s in given]
                y = np.concatenate((_tags(len(ids), spans), np.zeros(WINDOW, np.int64)))
                t = _triggers(text)
                if not len(t):
                    continue
                # Windows whose first character is inside a span would teach a wrong begin.
                starts = [s for s in windows(ids, t) if y[s] % 2 == 1 or y[s] == 0]
                seed = int.from_bytes(hashlib.sha256(text.encode("utf-8", "replace")).digest()[:4], "little")
                rng = np.random.default_rng(seed)
                for s in rng.permutation(starts)[:4].astype(np.int64):
                    xs.append(_cut(ids, np.array([s]))[0].astype("int8").tobytes())
                    ys.append(y[s : s + WINDOW].astype("int8").tobytes())
                for piece, marked in windows_to_learn(text, spans, WINDOW, rng):
                    xs.append(_cut(_char_ids(piece), np.array([0]))[0].astype("int8").tobytes())
                    ys.append(_tags(WINDOW, marked).astype("int8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["x", "y"])

    got = rows.mapInArrow(cut, "x binary, y binary").toPandas().sort_values(["x", "y"])
    model = BiLstmCrf()
    if not len(got):
        model.p["o"][0] = 50.0
        return model
    stack = lambda c: np.stack([np.frombuffer(v, "int8") for v in got[c]]).astype(np.int64)
    return model.fit(stack("x"), stack("y"))


def find(docs: DataFrame, model: BiLstmCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted, n_spans.

    The rules' spans stay; the model's are added where they overlap none of these and look like their
    kind.  Counts and ``spans`` (``kind:start:end``, code points, end exclusive, by start, then kind)
    hold both, ``base_sha256`` digests the rules' spans alone.  ``redacted`` is the text with each
    span replaced by its kind in brackets.  Null and empty texts have no spans (null stays null in
    ``redacted``).  Ids, null or repeated, are passed through; rows are independent and nothing is
    shuffled.  Only the two named columns are read.
    """
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, redacted string, n_spans long"

    def written(spans: list[Span]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))

    def redact(text: str | None, spans: list[Span]) -> str | None:
        if not spans or text is None:
            return text
        out, at = [], 0
        for a, b, k in sorted(spans):
            if b > at:
                out += [text[at:a], f"[{KINDS[k]}]"] if a >= at else []
                at = b
        return "".join(out) + text[at:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("text").to_pylist()
            texts = [t or "" for t in raw]
            hot = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
            added = dict(zip(hot, model_spans([texts[i] for i in hot], model), strict=True))
            columns: list[list] = [[] for _ in range(len(KINDS) + 4)]
            for i, text in enumerate(texts):
                base = base_spans(text) if i in added else []
                # Rules' spans of different kinds may overlap each other; the model's may touch none.
                more = [s for s in added.get(i, ()) if holds(text, s) and not any(s[0] < e and a < s[1] for a, e, _ in base)]
                spans = base + more
                for k in range(len(KINDS)):
                    columns[k].append(sum(s[2] == k for s in spans))
                columns[-4].append(hashlib.sha256(written(base).encode()).hexdigest())
                columns[-3].append(written(spans))
                columns[-2].append(redact(raw[i], spans))
                columns[-1].append(len(spans))
            types = [pa.int64()] * len(KINDS) + [pa.string()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted", "n_spans"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, schema)
