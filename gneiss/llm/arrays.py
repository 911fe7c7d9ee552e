"""Words of whole batches of texts as numpy arrays: no Python object per word."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype="uint8")
LOWER[ord("A") : ord("Z") + 1] += 32

#: An odd multiplier and its inverse modulo 2**64, for hashes of byte ranges from prefix sums.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def per_process(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made once in a worker process.

    Functions may come with each task by value, along with their module, so the values live in a module of their own.
    """
    kept = sys.modules.setdefault("_gneiss_kept", types.ModuleType("_gneiss_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), "uint64")
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


class Powers:
    """Powers of the multiplier, kept for the longest chunk so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, "uint64")

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(BASE, size), _powers(INVERSE, size)
        return self.up[:n], self.down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``size`` bytes; a longer text is a run of its own. Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], "int64")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", "uint8")
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the place of each text's first word (one more entry than texts)."""
    inside = ~WHITE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside
    if len(data):
        stop = np.ones(len(data), bool)
        stop[:-1] = ~inside[1:]
        stop[edges - 1] = True
        last = inside & stop
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of the lower-cased (A-Z) words, from one prefix sum over the bytes."""
    up, down = powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, "uint64")
    np.cumsum((LOWER[data].astype("uint64") + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, repeats included, and the place of each text's first one.

    A text of fewer than k words has one shingle of all its words; one without words has none.
    """
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    begin = np.concatenate(([0], np.cumsum(n)))
    # The word at which each shingle starts, and how many words it has.
    text = np.repeat(np.arange(len(n)), n)
    at = first[text] + np.arange(begin[-1]) - begin[text]
    length = np.minimum(count, k)[text]
    out = np.zeros(len(at), "uint64")
    for j in range(k):
        here = j < length
        w = hashes[np.where(here, at + j, 0)] if len(hashes) else hashes
        out = np.where(here, mixed(out * np.uint64(BASE) + w + np.uint64(j + 1)), out)
    return out, begin
