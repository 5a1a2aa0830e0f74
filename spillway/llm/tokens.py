"""Vectorised word tokens and word-window hashes over Arrow batches.

A word is a maximal run of bytes other than space, tab, newline, carriage return and form
feed.  Everything here works on the UTF-8 bytes of a whole batch at once, so no Python loop
runs over words or characters.  Hashes are 64 bits and depend on the words alone, never on
the batch, the partition or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text bytes handled at once; temporary arrays take about 40 times as much.
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 13, 12]] = True
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about `most` text bytes; a longer text is alone."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(text))
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    at = np.cumsum(size)
    lo = 0
    while lo < n:
        base = at[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(at, base + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and each text's offsets in them; a null is empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


class Words:
    """Words of a batch: hash, byte span, and the range of words of each document."""

    def __init__(self, col: pa.Array):
        self.data, self.off = raw(col)
        data, off = self.data, self.off
        word = ~_SPACE[data]
        n = len(data)
        first = np.zeros(n + 1, bool)
        first[off] = True
        before = np.empty(n, bool)
        if n:
            before[0] = True
            np.logical_not(word[:-1], out=before[1:])
            before |= first[:n]
        self.start = np.flatnonzero(word & before)
        after = np.empty(n, bool)
        if n:
            after[-1] = True
            np.logical_not(word[1:], out=after[:-1])
            after |= first[1:]
        self.end = np.flatnonzero(word & after) + 1
        #: Words of document i are those from at[i] to at[i + 1].
        self.at = np.searchsorted(self.start, off)
        if len(self.start):
            size = self.end - self.start
            power = np.full(int(size.max()), U(_BASE))
            power[0] = 1
            power = np.multiply.accumulate(power)
            inside = np.flatnonzero(word)
            place = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size)
            value = (data[inside].astype(np.uint64) + U(1)) * power[place]
            self.hash = mix(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64) * U(0xD6E8FEB86659FD93))
        else:
            self.hash = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def windows(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; right only where they lie in one document."""
        h = self.hash
        out = np.zeros(len(h), np.uint64)
        m = len(h) - n + 1
        if m > 0:
            out[:m] = rolling(h, n)
        return out

    def doc(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts())


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes, by doubling: two halves give a whole, log n passes."""
    m = len(h) - n + 1
    out, have, piece, size, left = None, 0, h, 1, n
    while left:
        if left & 1:
            part = piece[have : have + m]
            out = mix(part + U(size)) if out is None else mix(out * U(_BASE) + part + U(size))
            have += size
        left >>= 1
        if left:
            piece = mix(piece[: len(piece) - size] * U(_BASE) + piece[size:])
            size *= 2
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
