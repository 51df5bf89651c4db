"""Words, lines and their hashes for whole Arrow batches of texts, computed with numpy on the UTF-8 bytes.

A text column is seen as one byte buffer with row offsets. Words never cross rows. Work goes through
blocks of bytes, so memory beyond the per-word arrays is bounded whatever the length of a text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
SLICE = 4 << 20

_BASE = 0x5851F42D4C957F2D
_MASK = (1 << 64) - 1
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def byte_table(separators: bytes) -> np.ndarray:
    """Marks the bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Everything but space and the five ASCII control characters that part words.
SPACED = byte_table(b" \t\n\v\f\r")
#: Digits, ASCII letters and every byte of a character beyond ASCII.
ALNUM = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()))
LINES = byte_table(b"\n")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PLAIN = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


@cache
def byte_values(fold: bytes, seed: int) -> np.ndarray:
    """A random 64-bit value for each byte; folded bytes share theirs."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return values[np.frombuffer(fold, np.uint8)]


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def settle() -> None:
    """Give memory that a worker has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch, column: str, nbytes: int = SLICE) -> Iterator:
    """Parts of a batch or table with at most ``nbytes`` of text, or one row."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + nbytes, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
    settle()


@dataclass
class Words:
    """Word ``i`` is ``data[start[i]:end[i]]``; row ``r`` has words ``first[r]`` to ``first[r + 1]``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_row)

    def limit(self) -> np.ndarray:
        """For each word the number of the first word of the next row."""
        return np.repeat(self.first[1:], self.per_row)


def _stop(data, offsets, is_word, pos: int, size: int) -> int:
    """The end of the block that begins at ``pos``: never inside a word."""
    stop = pos + size
    if stop >= len(data):
        return len(data)
    gaps = np.flatnonzero(~is_word[data[pos:stop]])
    last = pos + int(gaps[-1]) + 1 if len(gaps) else pos
    row = int(offsets[np.searchsorted(offsets, stop, "right") - 1])
    return max(last, row) if max(last, row) > pos else _stop(data, offsets, is_word, pos, 2 * size)


def scan(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray = PLAIN, seed: int = 0) -> Words:
    """All words of all rows with a 64-bit hash of their folded bytes."""
    values = byte_values(fold.tobytes(), seed)
    parts, pos = [], 0
    while pos < len(data):
        stop = _stop(data, offsets, is_word, pos, BLOCK)
        block = data[pos:stop]
        n = len(block)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = is_word[block]
        edge = np.zeros(n + 1, bool)
        lo, hi = np.searchsorted(offsets, (pos, stop + 1))
        edge[offsets[lo:hi] - pos] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[block] * up[:n], out=sums[1:])
        parts.append((start + pos, end + pos, mix((sums[end] - sums[start]) * down[start])))
        pos = stop
    if parts:
        start, end, hashed = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        start, end, hashed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return Words(start, end, hashed, np.searchsorted(start, offsets))


def sequence_hash(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` neighbours; entry ``i`` covers ``i`` to ``i + n - 1``, whatever row they are in."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    salted = hashes if not seed else mix(hashes ^ np.uint64(seed))
    total = salted[:m].copy()
    for j in range(1, n):
        total *= np.uint64(_BASE)
        total += salted[j : j + m]
    return mix(total + np.uint64((n * 0x9E3779B97F4A7C15) & _MASK))


def window_starts(words: Words, n: int) -> np.ndarray:
    """Marks the word positions at which a whole window of ``n`` words of one row begins."""
    m = max(0, len(words) - n + 1)
    return np.arange(m) + n <= words.limit()[:m]


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Marks the positions that a run of ``n`` beginning at one of ``starts`` covers."""
    starts = np.asarray(starts, np.int64)
    steps = np.bincount(starts, minlength=size + 1) - np.bincount(starts + n, minlength=size + 1)
    return np.cumsum(steps[:size]) > 0


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true in ``mask``; a run also ends at each of ``breaks``."""
    inside = np.zeros(len(mask) + 2, bool)
    inside[1:-1] = mask
    edge = np.zeros(len(mask) + 1, bool)
    edge[breaks] = True
    return np.flatnonzero(inside[1:] & (~inside[:-1] | edge)), np.flatnonzero(inside[:-1] & (~inside[1:] | edge))


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's part ``first[r]:first[r + 1]``."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64 if values.dtype != np.float64 else np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def contains(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in the ordered array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values
