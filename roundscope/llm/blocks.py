"""Texts of an Arrow column as one byte array, with words and hashes found for all at once.

Everything here is bounded by a block: rows whose texts together stay under ``BLOCK_BYTES``, or a
single longer text. Texts are whole; a word, line or window never crosses from one into the next.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

_SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of words that are runs of anything but blanks.
UNSPACED = np.ones(256, bool)
UNSPACED[list(_SPACES)] = False
#: Bytes of words that are runs of lower-case letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; one-to-one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * BLOCK_BYTES:
            _powers[name] = have
    return have[:n]


class Block:
    """``n`` texts: their bytes end to end, and where each begins (``n + 1`` offsets)."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_binary()), b"")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.n = len(column)
        self.bytes = whole[at[0] : at[-1]]
        self.offsets = at - at[0]

    def lower(self) -> None:
        """A-Z to a-z, other bytes as they are."""
        self.bytes = _LOWER[self.bytes]

    def prefix_hashes(self) -> np.ndarray:
        """Running sums from which :meth:`span_hash` takes the hash of any stretch."""
        out = np.zeros(len(self.bytes) + 1, np.uint64)
        terms = _BYTE[self.bytes]
        terms *= _power("up", _BASE, len(self.bytes))
        np.cumsum(terms, out=out[1:])
        return out

    @staticmethod
    def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = prefix[end] - prefix[start]
        raw *= _power("down", _INVERSE, len(prefix))[start]
        return mix(raw + (end - start).astype(np.uint64) * _STEP[63])

    def words(self, kind: np.ndarray) -> Words:
        inside = kind[self.bytes]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = self.offsets[:-1]
        edges = edges[edges < len(inside)]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = self.offsets[1:]
        ends = ends[ends > 0] - 1
        last[ends] = inside[ends]
        start = np.flatnonzero(first)
        end = np.flatnonzero(last) + 1
        text = (np.searchsorted(self.offsets, start, "right") - 1).astype(np.int64)
        return Words(self, start, end, text)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many bytes of each text are marked."""
        total = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


class Words:
    """Start, end and text number of each word, in order; ``first`` has each text's first word."""

    def __init__(self, block: Block, start: np.ndarray, end: np.ndarray, text: np.ndarray):
        self.block, self.start, self.end, self.text = block, start, end, text
        self.count = np.bincount(text, minlength=block.n).astype(np.int64)
        self.first = np.zeros(block.n + 1, np.int64)
        np.cumsum(self.count, out=self.first[1:])

    def hashes(self, prefix: np.ndarray | None = None) -> np.ndarray:
        prefix = self.block.prefix_hashes() if prefix is None else prefix
        return Block.span_hash(prefix, self.start, self.end)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first word, and hash, of every run of ``width`` words within a text."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[:n] == self.text[width - 1 :])
        return at, self.run_hash(hashes, at, width)

    @staticmethod
    def run_hash(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        total = hashes[at] * _STEP[0]
        for j in range(1, width):
            total += hashes[at + j] * _STEP[j]
        return mix(total + np.uint64(width))


def sort_by_text(text: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs in order of text, then value."""
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (values[1:] != values[:-1])
    return text[new], values[new]


def slices(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each piece stay under ``limit``, or it is one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def joined(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Like :func:`slices`, and small neighbouring batches are put together."""
    held: list[pa.RecordBatch] = []
    size = 0
    for piece in slices(batches, column, limit):
        now = piece.column(column).cast(pa.large_binary()).nbytes
        if held and size + now > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(piece)
        size += now
    if held:
        yield pa.concat_batches(held)
