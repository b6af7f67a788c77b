"""Vectorised byte-level words and hashes over Arrow batches.

Words are runs of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses these bytes inside a
character, so working on bytes gives exactly the words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
CHUNK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place."""
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def cumulative(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x) + 1, x.dtype)
    out[0] = 0
    np.cumsum(x, out=out[1:])
    return out


@dataclass
class Words:
    """Words of consecutive documents. at[d]:at[d + 1] are the words of document d."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes: its 8-byte blocks, each mixed with its place, summed, and mixed with the length.

        Hashes of different seeds are independent: they share no intermediate value.
        """
        key = mix(np.array([seed], U) + U(0x9E3779B97F4A7C15))[0]
        length = self.end - self.start
        per = np.maximum(1, (length + 7) >> 3)
        first = cumulative(per)[:-1]
        block = np.arange(int(per.sum())) - np.repeat(first, per)
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        v = np.ndarray((len(self.buf) + 1,), "<u8", padded, strides=(1,))[np.repeat(self.start, per) + 8 * block]
        v &= _TAIL[np.minimum(8, np.repeat(length, per) - 8 * block)]
        v ^= mix(block.astype(U) * U(0xD6E8FEB86659FD93) + key)
        v = mix(mix(v) + key)
        h = np.add.reduceat(v, first) if len(first) else v
        h ^= length.astype(U) * U(0x2545F4914F6CDD1D)
        return mix(h + key)


#: Masks of the first 0 to 8 bytes of a block.
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)


def grams(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of `size` consecutive values, by halves: each step mixes two shorter runs in order."""
    left, have, out, done = words, 1, None, 0
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    key = U((seed * 0x632BE59BD9B4E019 + 0xA0761D6478BD642F) % (1 << 64))
    while True:
        if size & have:
            part = left[done : done + n]
            out = part if out is None else mix((out ^ key) * U(0x9FB21C651E98DF25) + part)
            done += have
        if done == size:
            break
        left = mix((left[:-have] ^ key) * U(0xC2B2AE3D27D4EB4F) + left[have:])
        have *= 2
    return mix(out ^ U(size))


def split(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE) -> Words:
    """offsets: where the documents begin in buf, and its end; the first is 0. between: for each byte whether it stands between words."""
    if lower:
        buf = _LOWER[buf]
    n = len(buf)
    solid = ~between[buf]
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        first[edge] = solid[edge]
        last[edge - 1] = solid[edge - 1]
    start = np.flatnonzero(first)
    return Words(buf, offsets, start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of documents of about size bytes; a longer document stands alone."""
    buf, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        yield i, j, buf[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def segment_ids(at: np.ndarray) -> np.ndarray:
    """For each word the number of its document."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
