"""Words of whole Arrow batches as numpy arrays, with rolling hashes of word runs.

A word is a run of bytes other than space and tab to carriage return. Hashes are
64 bit: equal runs have equal hashes; operators whose result must not rest on a
hash compare the texts as well, or use two hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_SPAN = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK = np.ones(256, bool)
_MARK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of slices of a sequence: sum of value * base^place, modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), _SPAN)
            for name, step in (("up", self.base), ("down", self.inverse)):
                powers = np.full(n, step, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))

    def slices(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._reach(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts])


_BYTES = Rolling(0x9E3779B97F4A7C1B)
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_RUNS = (Rolling(0xD6E8FEB86659FD93), Rolling(0xA0761D6478BD642B))


@dataclass
class Words:
    """Words of some documents in a row: byte ranges, document borders, hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """One hash a word, worked out over short spans of bytes."""
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):
            base = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, base + _SPAN, "right")))
            values = _BYTE_VALUES[self.data[base : self.ends[to - 1]]]
            out[at:to] = _BYTES.slices(values, self.starts[at:to] - base, self.ends[at:to] - base)
            at = to
        return out

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def room(self) -> np.ndarray:
        """Words from each one, itself included, to the end of its document."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self))

    def text(self, start: int, end: int) -> bytes:
        """Words start to end - 1 with what stands between them."""
        return self.data[self.starts[start] : self.ends[end - 1]].tobytes()


def runs(hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``length`` words, the document borders disregarded; shorter by length - 1."""
    n = max(0, len(hashes) - length + 1)
    starts = np.arange(n)
    return _RUNS[which].slices(hashes, starts, starts + length)


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False, bare: bool = False) -> Words:
    """Words of the documents that lie between consecutive offsets of ``data``; ``bare``: ASCII marks part words too."""
    low, high = int(offsets[0]), int(offsets[-1])
    data, offsets = data[low:high], offsets - low
    if lower:
        data = _LOWER[data]
    inside = ~(_MARK if bare else _SPACE)[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets


def pieces(batch: pa.RecordBatch, text: str | int = "text", lower: bool = False, bare: bool = False) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The batch in parts of about CHUNK bytes of text, each with its words; ``text`` names or numbers the column."""
    if not batch.num_rows:
        return
    data, offsets = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield batch.slice(at, to - at), split(data, offsets[at : to + 1], lower, bare)
        at = to


def minimisers(grams: np.ndarray, valid: np.ndarray, width: int) -> np.ndarray:
    """The least gram of each window of ``width`` grams; the greatest value where the window isn't valid."""
    least = grams
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    out = np.full(len(valid), np.iinfo(np.uint64).max, np.uint64)
    n = min(len(least), len(valid))
    out[:n] = least[:n]
    out[~valid] = np.iinfo(np.uint64).max
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
