"""Byte strings and what is known of them, in flat arrays: found by hash, held to the bytes."""

from __future__ import annotations

import numpy as np

from . import arrays as A


class SpanTable:
    """Byte strings with a list of numbers each.  ``keys`` are the sorted hashes."""

    def __init__(self, keys, text, text_end, values, values_end):
        self.keys, self.text, self.text_end, self.values, self.values_end = keys, text, text_end, values, values_end

    @classmethod
    def of(cls, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, values: np.ndarray, count: np.ndarray) -> SpanTable:
        """``values``: the numbers of all spans one after the other, ``count`` of each."""
        order = np.argsort(h, kind="stable")
        length, begin = (ends - starts)[order], np.cumsum(count) - count
        ends_of = lambda n: np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return cls(h[order], A.gather(buf, starts[order], length), ends_of(length), A.gather(values, begin[order], count[order]), ends_of(count[order]))

    @classmethod
    def empty(cls, kind=np.uint32) -> SpanTable:
        z = np.zeros(1, np.int32)
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.uint8), z, np.zeros(0, kind), z)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.text, self.text_end, self.values, self.values_end))

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each byte span, or -1; of strings with one hash the table knows the first."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        length = ends - starts
        ok = np.flatnonzero((self.keys[k] == h) & (self.text_end[k + 1] - self.text_end[k] == length))
        ok = ok[A.equal_spans(buf, starts[ok], self.text, self.text_end[k[ok]].astype(np.int64), length[ok])]
        out = np.full(len(h), -1, np.int64)
        out[ok] = k[ok]
        return out

    def counts(self, k: np.ndarray) -> np.ndarray:
        return (self.values_end[k + 1] - self.values_end[k]).astype(np.int64)

    def values_of(self, k: np.ndarray) -> np.ndarray:
        return A.gather(self.values, self.values_end[k].astype(np.int64), self.counts(k))

    def with_table(self, other: SpanTable) -> SpanTable:
        """Both tables' entries."""
        shift = lambda x, y: np.concatenate([x[:-1], x[-1] + y])
        text_end, values_end = shift(self.text_end, other.text_end), shift(self.values_end, other.values_end)
        text, values = np.concatenate([self.text, other.text]), np.concatenate([self.values, other.values])
        starts, begin, count = text_end[:-1].astype(np.int64), values_end[:-1].astype(np.int64), np.diff(values_end).astype(np.int64)
        return SpanTable.of(text, starts, text_end[1:].astype(np.int64), np.concatenate([self.keys, other.keys]), A.gather(values, begin, count), count)


class Cache:
    """A worker's cache of a bounded number of bytes: a small young table that takes what is new, and
    an old one that takes in the young when that is full.  When the old one is full it goes."""

    def __init__(self, limit: int = 24 << 20):
        self.limit = limit
        self.young, self.old = SpanTable.empty(), SpanTable.empty()

    @property
    def nbytes(self) -> int:
        return self.young.nbytes + self.old.nbytes

    def tables(self) -> tuple[SpanTable, SpanTable]:
        return self.young, self.old

    def add(self, buf, starts, ends, h, values, count) -> None:
        new = SpanTable.of(buf, starts, ends, h, values, count)
        if new.nbytes > self.limit // 2:
            return  # one odd slice: not worth keeping
        self.young = self.young.with_table(new)
        if self.young.nbytes > self.limit // 8:
            if self.old.nbytes + self.young.nbytes > self.limit:
                self.old = SpanTable.empty()
            self.old, self.young = self.old.with_table(self.young), SpanTable.empty()
