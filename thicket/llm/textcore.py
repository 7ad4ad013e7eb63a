"""Vectorised word and shingle hashing over batches of whole texts.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D in the UTF-8 form of a text, which is the
same as the code point class ``[^\\x20\\x09-\\x0D]+``.  Texts are handled in chunks of about ``CHUNK_BYTES`` so
that temporary arrays stay small; a longer text is one chunk by itself and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Powers of the base, and of its inverse, up to this many bytes; longer texts are hashed in blocks of it.
_BLOCK = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the finaliser of SplitMix64)."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables() -> list[np.ndarray]:
    if not _powers:
        for base in (_BASE, _INVERSE):
            steps = np.full(_BLOCK, base, U64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


class Words:
    """The words of some texts: byte spans in ``data``, their texts' numbers and 64-bit hashes.  gap tells the bytes between
    words, the line feed among them."""

    def __init__(self, texts: list[bytes], lower: bool = False, hashes: bool = True, gap: np.ndarray = _SPACE):
        joined = b"\n".join([b"", *texts, b""])
        data = np.frombuffer(joined, np.uint8)
        self.texts, self.raw = texts, data
        self.data = data = _LOWER[data] if lower else data
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        #: where each text begins in data
        self.begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) + 1 if len(texts) else np.zeros(0, np.int64)
        space = gap[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        #: first word of each text, and one past the last text's
        self.first = np.concatenate([np.searchsorted(self.starts, self.begins), [len(self.starts)]]).astype(np.int64)
        self.counts = np.diff(self.first)
        self.hashes = self._hash() if hashes else None

    def _hash(self) -> np.ndarray:
        """Sums over words of byte * base ** place, block by block; places count from the words' starts."""
        up, down = _power_tables()
        low, high = np.empty(len(self.starts), U64), np.empty(len(self.starts), U64)
        before = U64(0)
        with np.errstate(over="ignore"):
            for at in range(0, len(self.data), _BLOCK):
                block = self.data[at : at + _BLOCK]
                scale = U64(pow(_BASE, at, 1 << 64))
                sums = np.empty(len(block) + 1, U64)
                sums[0] = before
                np.cumsum(_BYTE[block] * up[: len(block)], out=sums[1:])
                sums[1:] *= scale
                sums[1:] += before
                for places, out in ((self.starts, low), (self.ends, high)):
                    a, b = np.searchsorted(places, (at, at + _BLOCK))
                    out[a:b] = sums[places[a:b] - at]
                before = sums[-1]
            # the data end with a separator, so that no word ends at their very end
            back = np.empty(len(self.starts), U64)
            for at in range(0, len(self.data), _BLOCK):
                a, b = np.searchsorted(self.starts, (at, at + _BLOCK))
                back[a:b] = down[self.starts[a:b] - at] * U64(pow(_INVERSE, at, 1 << 64))
            return mix((high - low) * back + (self.ends - self.starts).astype(U64))

    def space(self) -> np.ndarray:
        return _SPACE[self.data]

    def sums(self, of: np.ndarray) -> np.ndarray:
        """Of each text, how many of its bytes are marked; what parts texts must not be."""
        return np.add.reduceat(of, self.begins, dtype=np.int64) if len(self.texts) else np.zeros(0, np.int64)

    def of(self, values: np.ndarray, i: int) -> np.ndarray:
        return values[self.first[i] : self.first[i + 1]]

    def windows(self, width: int) -> np.ndarray:
        """Hashes of the width-word windows that begin at each word; those that cross into a next text are void."""
        h, n = self.hashes, len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, U64)
        out = np.zeros(n, U64)
        for k in range(width):
            out = out * U64(0xD6E8FEB86659FD93) + h[k : k + n]
        return mix(out)

    def shingles(self, i: int, windows: np.ndarray, width: int) -> np.ndarray:
        """Sorted distinct shingles of text i: its windows, or all its words as one if they are fewer, or none."""
        a, b = self.first[i], self.first[i + 1]
        if b - a >= width:
            return np.unique(windows[a : b - width + 1])
        if a == b:
            return np.zeros(0, U64)
        h = U64(b - a)
        with np.errstate(over="ignore"):
            for x in self.hashes[a:b]:
                h = h * U64(0xD6E8FEB86659FD93) + x
        return mix(np.array([h ^ U64(0x5851F42D4C957F2D)], U64))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, b"" for nulls."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    at = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield at, i
            at, size = i, 0
        size += len(x) + 1
    if at < len(texts):
        yield at, len(texts)


def word_chunks(batch: pa.RecordBatch, column: str, lower: bool = False, hashes: bool = True) -> Iterable[tuple[int, int, Words]]:
    texts = as_bytes(batch.column(column))
    for a, b in chunks(texts):
        yield a, b, Words(texts[a:b], lower, hashes)


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values
