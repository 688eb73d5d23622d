"""Words of many texts at once, as positions and 64-bit hashes in arrays.

A word is a run of bytes other than space and the control characters 9 to 13. Texts are
taken a slice of a few megabytes at a time, so memory follows the slice or the longest
single text, never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each text begins (null counts as empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``limit`` text bytes, or one longer row."""
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)


@dataclass
class Words:
    """Words of a run of texts; word ``i`` of text ``d`` has index ``first[d] + i``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        up, down = powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        own = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mix(own + np.uint64(seed) * _STEP + (self.ends - self.starts).astype(np.uint64))


def split_words(column: pa.Array, lower: bool = False, white: np.ndarray = WHITE) -> Words:
    data, bounds = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = ~white[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = bounds[:-1][bounds[:-1] < len(data)]
    opens[heads] = inside[heads]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tails = bounds[1:][bounds[1:] > 0] - 1
    closes[tails] = inside[tails]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, bounds))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; the last ``size - 1`` words have none."""
    n = max(0, len(hashes) - size + 1)
    total = hashes[:n].copy()
    for j in range(1, size):
        total = total * _STEP + hashes[j : j + n]
    return mix(total)


def spans(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of ``sizes`` words from each of ``starts`` on."""
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[starts + sizes] - total[starts]) * down[starts] + sizes.astype(np.uint64))


def as_long(values: np.ndarray) -> pa.Array:
    """Hashes as the signed 64-bit integers that Spark has."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
