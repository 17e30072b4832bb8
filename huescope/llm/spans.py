"""Words of Arrow text columns as numpy arrays: where they are, their hashes, and chunks of bounded size.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bits of a keyed
polynomial; every function works on whole texts.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_LETTERS = tuple(np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for seed in (11, 12))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64 bits whose output bits all depend on all input bits."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 .. n-1 modulo 2**64, and those of its inverse."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        base, size = _BASE[which], 1 << max(CHUNK.bit_length(), (n - 1).bit_length())
        rows = []
        for b in (base, pow(base, -1, 2**64)):
            with np.errstate(over="ignore"):
                row = np.full(size, U(b))
                row[0] = U(1)
                rows.append(np.cumprod(row, dtype=np.uint64))
        have = (rows[0], rows[1])
        if size <= 8 * CHUNK:
            _powers[which] = have
    return have


class Spans:
    """Hashes of spans of the same bytes; which: one of two independent hashes."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = powers(len(data) + 1, which)
        self.total = np.empty(len(data) + 1, np.uint64)
        self.total[0] = 0
        np.cumsum(_LETTERS[which][data] * up[: len(data)], out=self.total[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of the bytes of each span; which: one of two independent ones."""
    return Spans(data, which).hashes(starts, ends)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def give_back() -> None:
    """Return what the allocators of Arrow and numpy hold but don't use to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable) -> Callable:
    """run, a function over a task's Arrow batches, that gives unused memory back to the system after each batch and at its end.

    Python's workers outlive tasks and stages; what the allocators of Arrow and numpy keep for later would add up in an executor.
    """

    @functools.wraps(run)
    def lean_run(batches):
        def handed():
            for batch in batches:
                yield batch
                del batch
                give_back()

        try:
            yield from run(handed())
        finally:
            give_back()

    return lean_run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and n + 1 offsets into them; null texts are empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about so many bytes; a longer text stands alone."""
    data, offsets = text_bytes(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, in order, and the number of words of each row."""
    solid = ~SPACE[data]
    n = len(data)
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    last[offsets[1:]] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = solid[:-1]
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | first[:n]))
    ends = np.flatnonzero(solid & (~after | last[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, ... of all runs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
