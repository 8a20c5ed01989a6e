"""Vectorised text primitives shared by the corpus operators.

Texts arrive as Arrow string columns; everything here works on the UTF-8 buffer of a slice of
rows at once, so that no Python object is made per word.  Slices hold about ``SLICE_BYTES`` bytes
(one longer text makes a slice of its own), which bounds a worker's memory; ``trimmed`` gives freed
memory back at the end of a task, as workers are reused.

Hashes are 64 bits wide and the same on every worker.  Items are folded in one after the other, or
pairwise in a tree, by a multiplication and a shift between any two, so no identity of sums or
products (as polynomials have them modulo a power of two) makes two texts meet: a clash is as likely
as between random numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
#: a random odd 64-bit value for each byte value
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: the lowest bytes of a little-endian word, by their number
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: spans of more bytes are hashed one by one
LONG_SPAN = 512

#: words are runs of bytes other than space and \t \n \v \f \r
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: A-Z to a-z, other bytes unchanged
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two in their order."""
    x = a * U(0x9E3779B97F4A7C15)
    x ^= x >> U(32)
    x += b
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


#: rows of a batch that goes to Python: of texts, a thousand fill a slice or more
BATCH_ROWS = 1000
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(df: DataFrame) -> DataFrame:
    """Has the session send fewer rows at a time, unless its owner has chosen a number: a batch is held
    by the JVM and by the worker, and ten thousand texts are many times a slice."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return df


_libc = None


def trimmed(run):
    """``run`` over the batches of a task; in the end freed memory goes back to the system."""

    def wrapped(batches):
        global _libc
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                import ctypes

                _libc = _libc or ctypes.CDLL(None)
                _libc.malloc_trim(0)
            except (OSError, AttributeError):  # not this C library
                pass

    return wrapped


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as the empty text."""
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def sliced(arr: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each slice of a string column."""
    buf, off = utf8(arr)
    for i, j in slices(off, limit):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]


def runs(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags, broken at row borders."""
    n = len(flag)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flag[:-1]
    starts = np.flatnonzero(flag & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flag[1:]
    ends = np.flatnonzero(flag & (~after | first[1:])) + 1
    return starts, ends


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number (zeros follow the end)."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span; spans of up to eight bytes clash with none of their length."""
    length = ends - starts
    ahead = eights(buf)
    h = fold(mix(length.astype(np.uint64) + U(0x2545F4914F6CDD1D)), ahead[starts] & _MASK[np.minimum(length, 8)])
    live = np.flatnonzero((length > 8) & (length <= LONG_SPAN))
    at, left = starts[live] + 8, length[live] - 8
    while len(live):
        h[live] = fold(h[live], ahead[at] & _MASK[np.minimum(left, 8)])
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(length > LONG_SPAN).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return mix(h)


class Windows:
    """Hashes of all runs of m consecutive items, for several m (row borders are the caller's).

    Runs of 1, 2, 4 ... items are folded from two halves; a run of any other length from the first
    and the last such run in it, which overlap.
    """

    def __init__(self, items: np.ndarray):
        self.levels = [items]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            h, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(fold(h[: max(0, len(h) - half)], h[half:]))
        return self.levels[k]

    def of(self, m: int, salt: int = 0) -> np.ndarray:
        n = len(self.levels[0]) - m + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        k = m.bit_length() - 1
        h = self._level(k)
        if m > 1 << k:
            h = fold(h[:n], h[m - (1 << k) :])
        return mix(h + U(salt))


    def _level_at(self, k: int, p: np.ndarray) -> np.ndarray:
        if k < len(self.levels):
            return self.levels[k][p]
        return fold(self._level_at(k - 1, p), self._level_at(k - 1, p + (1 << (k - 1))))

    def at(self, m: int, positions: np.ndarray, salt: int = 0) -> np.ndarray:
        """``of`` at few positions only."""
        k = m.bit_length() - 1
        h = self._level_at(k, positions)
        if m > 1 << k:
            h = fold(h, self._level_at(k, positions + m - (1 << k)))
        return mix(h + U(salt))


def window_hashes(items: np.ndarray, m: int, salt: int = 0) -> np.ndarray:
    return Windows(items).of(m, salt)


def row_hashes(items: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of all items of each row, for rows of few items."""
    count = np.diff(off)
    h = mix(count.astype(np.uint64) + U(0x9E6C63D0876A9A47))
    live, k = np.flatnonzero(count > 0), 0
    while len(live):
        h[live] = fold(h[live], items[off[live] + k])
        k += 1
        live = live[count[live] > k]
    return mix(h)


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of data[start : start + length]."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - before, lengths) + np.arange(total)]


def equal_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which spans of a hold the same bytes as those of b."""
    same = gather(a, a_starts, lengths) == gather(b, b_starts, lengths)
    return sums(~same, np.concatenate([[0], np.cumsum(lengths)])) == 0


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the word offsets of the rows."""
    starts, ends = runs(IS_WORD[buf], off)
    return starts, ends, np.searchsorted(starts, off)


def rows_of(off: np.ndarray) -> np.ndarray:
    """The row of each item, from item offsets."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n items lie in any of the half-open intervals."""
    d = np.bincount(starts, minlength=n + 1).astype(np.int64)
    d -= np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(d[:n]) > 0


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of the items of each row."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]
