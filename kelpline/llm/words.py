"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased: digits, a-z and every character above U+007F.  All of a
character's UTF-8 bytes above 0x7F are word bytes, so splitting bytes equals
splitting characters.  Work goes over slices of bounded size (or one text, if
that alone is larger), whole texts always.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20
_ROWS = 1024

_TABLE = np.zeros(256, np.uint8)
_TABLE[0x30:0x3A] = np.arange(0x30, 0x3A)
_TABLE[0x61:0x7B] = np.arange(0x61, 0x7B)
_TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)
_TABLE[0x80:] = np.arange(0x80, 0x100)

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_BASE**i`` and its inverse modulo 2**64, for i below n."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, _BASE_INVERSE):
        steps = np.full(n, base, U64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= 2 * SLICE_BYTES:  # those of a longer text aren't kept
        _powers[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, elementwise."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@dataclass
class Words:
    """Words of some texts: ``hash``, byte ``start`` and ``end`` in ``data`` of each word,
    and for text i the words ``first[i]:first[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets into the bytes), each of at most ``limit`` bytes or one row. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for begin in range(0, len(column), _ROWS):  # what is converted at once is a part of a batch
        part = pc.fill_null(column.slice(begin, _ROWS).cast(pa.large_string()), "")
        _, raw_offsets, raw = part.buffers()
        offsets = np.frombuffer(raw_offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        row = 0
        while row < len(part):
            upto = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
            upto = min(max(upto, row + 1), len(part))
            yield begin + row, begin + upto, data[offsets[row] : offsets[upto]], offsets[row : upto + 1] - offsets[row]
            row = upto


_residents: dict[str, dict] = {}


def resident(module: str, key: tuple, make: Callable):
    """What ``make`` gives, once a process for a key: it outlives a task, until a task of another module begins."""
    own = _residents.setdefault(module, {})
    if key not in own:
        own.clear()
        own[key] = make()
    return own[key]


def leave_others(module: str) -> None:
    """Drops what other modules keep in this process."""
    for other in [m for m in _residents if m != module]:
        del _residents[other]


def tidied(run: Callable) -> Callable:
    """A partition function that hands the memory it freed back to the system at its end, and what other modules keep at its
    beginning: worker processes live on and share an executor's memory with whatever runs next."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leave_others(run.__module__)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    letters = _TABLE[data]
    inside = letters != 0
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts_text = offsets[:-1][offsets[:-1] < n]
    before[starts_text] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends_text = offsets[1:][offsets[1:] > 0] - 1
    after[ends_text] = False
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(letters.astype(U64) * power[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64) * U64(0x2545F4914F6CDD1D))
    return Words(data, offsets, hashes, start, end, np.searchsorted(start, offsets).astype(np.int64))


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes :func:`split_words` gives to these words (lower-case, of word bytes only)."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    got = split_words(data, np.array([0, len(data)], np.int64)).hash
    if len(got) != len(words):
        raise ValueError("not single words")
    return got


def char_starts(data: np.ndarray) -> np.ndarray:
    """For each byte (and the end) how many code points begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def row_of(first: np.ndarray) -> np.ndarray:
    """For each word its text's number."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of ``size`` words; a text of fewer, but not none, is one shingle."""
    count = np.diff(words.first)
    row, h = row_of(words.first), words.hash
    m = max(len(h) - size + 1, 0)
    total = np.zeros(m, U64)
    for k in range(size):
        total = total * U64(_BASE) + h[k : k + m]
    full = row[:m] == row[size - 1 : size - 1 + m]
    short = np.flatnonzero((count > 0) & (count < size))
    extra = np.empty(len(short), U64)
    for i, t in enumerate(short):
        x = 0
        for y in h[words.first[t] : words.first[t + 1]]:
            x = (x * _BASE + int(y)) & 0xFFFFFFFFFFFFFFFF
        extra[i] = x
    rows = np.concatenate([row[:m][full], short])
    values = mix(np.concatenate([total[full], extra]))
    if len(short):
        order = np.argsort(rows, kind="stable")
        rows, values = rows[order], values[order]
    return rows, values
