"""Word and shingle hashes of Arrow string columns, computed over their byte buffers with numpy.

A word is a run of bytes that are not separators. Its hash is a polynomial over a table of random values,
taken as a difference of running sums, so the cost is a few array passes whatever the words are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts are worked on in blocks of about that many bytes, so temporaries stay small.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
SPACES = bytes([0x20, 9, 10, 11, 12, 13])


#: What Python workers keep from task to task: how to drop it, by the operator that keeps it. Workers serve all operators.
KEPT: dict[str, Callable[[], None]] = {}


def releasing(run, keeps: str = ""):
    """The same function of batches for a task that drops what other operators keep, and gives memory that it has freed back to the system."""

    @wraps(run)
    def task(batches):
        for name, drop in KEPT.items():
            if name != keeps:
                drop()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only glibc has it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (multiply and shift rounds)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return _scramble(np.arange(1, 257, dtype=U) * U(BASE))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n, U(BASE)), np.full(n, U(inverse))
    up[0] = down[0] = U(1)
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=4)
def _tables(letters_only: bool, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The byte (A-Z lower-cased if fold), and whether it separates words: ASCII white space, or all ASCII but letters and digits."""
    low = np.arange(256, dtype=np.uint8)
    if fold:
        low[65:91] += 32
    sep = np.zeros(256, dtype=bool)
    if letters_only:
        sep[:128] = [not chr(c).isalnum() for c in range(128)]
    else:
        sep[list(SPACES)] = True
    return low, sep


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows in them); a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(maxsize=1)
def _alphanumeric() -> np.ndarray:
    """Whether a byte is an ASCII letter or digit."""
    return np.array([k < 128 and chr(k).isalnum() for k in range(256)])


def _block_words(data: np.ndarray, cuts: np.ndarray, letters_only: bool, fold: bool, trailing: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words of a block; cuts: where rows begin in it."""
    low, sep = _tables(letters_only, fold)
    data = low[data]
    n = len(data)
    word = ~sep[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if trailing is not None:
        end = end - (trailing[data[end - 1]] & (end - start > 1) & _alphanumeric()[data[end - 2]])
    size = max(2 * BLOCK, 1 << int(n).bit_length())
    up, down = _powers(size)
    total = np.zeros(n + 1, dtype=U)
    np.cumsum(_values()[data] * up[:n], out=total[1:])
    return start, end, _scramble((total[end] - total[start]) * down[start] + (end - start).astype(U))


def word_hashes(data: np.ndarray, offsets: np.ndarray, letters_only: bool = False, fold: bool = True, trailing: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of all words and, for each row, where its words begin in these arrays.

    trailing: which bytes are left out where one of them ends a word after an ASCII letter or digit.
    """
    _, sep = _tables(letters_only)
    at, n, found = 0, len(data), []
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:  # end the block at a separator or a row's end
            back = np.flatnonzero(sep[data[at:to]])
            row = offsets[np.searchsorted(offsets, to, "right") - 1]
            to = max(at + int(back[-1]) + 1 if len(back) else at, int(row))
            if to <= at:  # one word longer than a block
                ahead = np.flatnonzero(sep[data[at:]])
                to = min(at + int(ahead[0]) + 1 if len(ahead) else n, int(offsets[np.searchsorted(offsets, at, "right")]))
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        start, end, value = _block_words(data[at:to], inner, letters_only, fold, trailing)
        found.append((value, start + at, end + at))
        at = to
    if not found:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    value, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    return value, start, end, np.searchsorted(start, offsets)


def ragged(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (n[0] of them), at[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def grams(value: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive values (rows are not told apart)."""
    if len(value) < n:
        return np.zeros(0, U)
    out = np.zeros(len(value) - n + 1, dtype=U)
    for k in range(n):
        out = out * U(BASE) + value[k : len(value) - n + 1 + k]
    return _scramble(out)


def whole(value: np.ndarray) -> np.ndarray:
    """One hash for a sequence shorter than a gram; its length keeps it apart from grams."""
    out = U(len(value))
    with np.errstate(over="ignore"):
        for v in value:
            out = out * U(BASE) + v
    return _scramble(np.array([out], dtype=U))


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles; with fewer words the whole sequence is one."""
    data, offsets = buffers(column)
    value, _, _, begins = word_hashes(data, offsets)
    every = grams(value, n)
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield whole(value[a:b])
        else:
            yield np.zeros(0, U)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about that many bytes of text."""
    texts = batch.column(column).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(batch.num_rows, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to
