"""Byte-level BPE as a lazily determinised transducer, and its streaming decoder.

Encoding reads a pre-token byte by byte.  After each byte the last token of the encoding of what
has been read so far is known: it is the one suffix token that may follow the encoding of the rest.
Tokens are emitted once every way in which the text can go on agrees on them, that is, once each
start from which a longer vocabulary entry may still grow lies behind them.  What is still
pending is never longer than the longest entry, so the lookahead is bounded.

A state is the last emitted token and the pending bytes.  States and transitions are made when
they are first met and kept, so the transducer holds what the texts need and no more.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gneiss.llm.arrays import per_process

NONE = -1
#: Rows whose results a worker holds at once.
STEP = 128


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes pre-tokens; ``limit`` bounds the kept words, and twice that the kept states, which are rebuilt when it is reached."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 350_000):
        self.ranks, self.limit = ranks, limit
        self.longest = max(map(len, ranks))
        self.growing = {t[:n] for t in ranks for n in range(1, len(t))}
        self.text_of = {r: t for t, r in ranks.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.spines: dict[int, tuple[list[bytes], list[bytes]]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[tuple[int, bytes], int] = {}
        # Last emitted token, pending bytes, last token after each of them, token ends on the way to each place.
        self.states: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...]]] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self._state(NONE, b"", (), (0,))

    def _state(self, before: int, pending: bytes, last: tuple[int, ...], ends: tuple[int, ...]) -> int:
        key = (before, pending)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append((before, pending, last, ends))
        return self.ids[key]

    def _spines(self, token: int) -> tuple[list[bytes], list[bytes]]:
        """The tokens that end, and that begin, the token while it is built, from itself down to one byte."""
        known = self.spines.get(token)
        if known is None:
            parts = [self.text_of[token][i : i + 1] for i in range(len(self.text_of[token]))]
            right, left = [parts[-1]], [parts[0]]
            while len(parts) > 1:
                _, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if i == len(parts) - 1:
                    right.append(parts[-1])
                if i == 0:
                    left.append(parts[0])
            known = self.spines[token] = right[::-1], left[::-1]
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens.

        It is unless some merge reaches over the border: one of a token that ends ``a`` for a while
        and one that begins ``b`` for a while, of lower rank than the merges that use these up.
        At equal rank the merge further left comes first.
        """
        if a == NONE:
            return True
        known = self.fits.get((a, b))
        if known is not None:
            return known
        rank, out, used_a = self.ranks.get, True, 1 << 60
        for x in self._spines(a)[0]:
            used_b = 1 << 60
            for y in self._spines(b)[1]:
                over = rank(x + y)
                if over is not None and over < used_a and over <= used_b:
                    out = False
                used_b = self.ranks[y]
            used_a = self.ranks[x]
        if len(self.fits) > 2 * self.limit:
            self.fits.clear()
        self.fits[a, b] = out
        return out

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, pending, last, ends = self.states[state]
        data = pending + bytes((byte,))
        n = len(data)
        for start in range(max(0, n - self.longest), n):
            token = self.ranks.get(data[start:])
            if token is not None and self._may_follow(last[start - 1] if start else before, token):
                break
        last = (*last, token)
        # Token ends on the way to each place, as bits; those on the way to every place where a
        # future token may start are settled.
        ends = (*ends, ends[start] | 1 << n)
        common = 0 if data in self.growing else ends[n]
        for start in range(1, n):
            if not common:
                break
            if data[start:] in self.growing:
                common &= ends[start]
        if not common:
            return self._state(before, data, last, ends), ()
        cut = common.bit_length() - 1
        # Tokens after the cut do not reach over it, so what is known of them stays true.
        behind = tuple(e >> cut & ~1 for e in ends[cut:])
        return self._state(last[cut - 1], data[cut:], last[cut:], behind), self._ends(last, cut)

    def _ends(self, last: tuple[int, ...], at: int) -> tuple[int, ...]:
        out = []
        while at:
            out.append(last[at - 1])
            at -= len(self.text_of[last[at - 1]])
        return tuple(reversed(out))

    def run(self, data: bytes) -> list[int]:
        """Token ids of one pre-token of any length."""
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in data:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = moves[state << 8 | byte] = self._move(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        last = self.states[state][2]
        out += self._ends(last, len(last))
        if len(self.states) > 2 * self.limit:
            self.moves = {}
            self._clear()
        return out

    def encode(self, pieces: Sequence[str]) -> np.ndarray:
        """Ids of a text's pre-tokens; those met before are looked up."""
        words = self.words
        if len(words) >= self.limit:
            words.clear()
        for piece in set(pieces).difference(words):
            words[piece] = tuple(self.run(piece.encode()))
        return np.fromiter(chain.from_iterable(map(words.__getitem__, pieces)), "<u4")


class Utf8Machine:
    """Incremental UTF-8: feed bytes in any pieces, get the characters that are complete.

    A state is the number of continuation bytes that are due, with the range allowed for the next.
    A byte that cannot follow ends the broken sequence with U+FFFD and is read afresh.
    """

    def __init__(self) -> None:
        self.due, self.low, self.high, self.held = 0, 0x80, 0xBF, bytearray()

    def feed(self, data: bytes) -> str:
        if not self.due and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.due:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                    if not self.due:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append(self.end())
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.due = 1 + (b >= 0xE0) + (b >= 0xF0)
                # Overlong forms, surrogates and what lies beyond U+10FFFF are cut off by the second byte.
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                self.held.append(b)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What a stream that ends here still owes: one U+FFFD for a broken sequence."""
        broken = "�" if self.due else ""
        self.due, self.low, self.high = 0, 0x80, 0xBF
        self.held.clear()
        return broken


class Decoder:
    """Ids to text through the UTF-8 machine; tokens of whole characters skip it where it is between characters."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self.whole: list[str | None] = []
        for t in self.bytes_of:
            try:
                self.whole.append(t.decode())
            except UnicodeDecodeError:
                self.whole.append(None)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        machine, whole = Utf8Machine(), self.whole
        for i in ids:
            text = whole[i]
            yield text if text is not None and not machine.due else machine.feed(self.bytes_of[i])
        yield machine.end()

    def text(self, ids: np.ndarray) -> str:
        parts = [self.whole[i] for i in ids.tolist()]
        if None not in parts:
            return "".join(parts)
        return "".join(self.stream(ids.tolist()))


def coders(rank_file: str, limit: int) -> tuple[Transducer, Decoder]:
    ranks = read_ranks(rank_file)
    return Transducer(ranks, limit), Decoder(ranks)


def code(
    docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = False, limit: int = 350_000, keep: bool = True,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ids, decoded.

    Each match of ``pattern`` is encoded by itself, without special tokens.  Null text is encoded as
    the empty one: no ids.  Ids, null or repeated, are passed through; rows are independent, so
    nothing is shuffled and a lost executor costs only its tasks.  Only the two named columns are
    read.  ``rank_file`` is read by each worker: a vocabulary that is installed on every machine.
    A worker process keeps its transducer from one task to the next, unless ``keep`` is false.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if with_ids else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda: coders(rank_file, limit)
        encoder, decoder = per_process(("bpe", rank_file, limit), make) if keep else make()
        split = regex.compile(pattern)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 6 if with_ids else 4]
        for batch in (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP)):
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(split.findall(text.as_py() or ""))
                decoded = decoder.text(ids)
                row = (i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*row, ids.astype("int32"), decoded) if with_ids else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(work, schema)
