"""A compressed full-text index in numpy: depth-bounded suffix sorting, BWT and wavelet matrix.

Texts of a shard are joined with the symbol 0 between and after them.  Suffixes are sorted by their
first ``depth`` symbols only; backward search of patterns of up to that length is unaffected, as the
order of suffixes that agree so far never matters to it.

The index is the transform as a wavelet matrix, a packed bit vector and one 32-bit count for 64 bits
on each level, and the first rank of each symbol.  The suffix array is made to build it and is not
part of it: positions are not needed, only what is known of the documents in a range of ranks.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` symbols at least (prefix doubling).

    A position is sorted along with its key in one number of 64 bits, for texts of up to 2**20 symbols.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    own = max(1, (n - 1).bit_length())  # bits of a position
    if 3 * own + 2 > 64:
        return _long_suffix_array(text, depth)
    dense = np.zeros(int(text.max()) + 1, np.uint64)
    dense[text] = 1
    dense = np.cumsum(dense, dtype=np.uint64)  # from 1: past the end comes before all
    bits = int(dense[-1]).bit_length()
    k = max(1, (64 - own) // bits)
    padded = np.zeros(n + k, np.uint64)
    padded[:n] = dense[text]
    key = np.zeros(n, np.uint64)
    for d in range(k):
        key = (key << np.uint64(bits)) | padded[d : d + n]
    position, shift = np.arange(n, dtype=np.uint64), np.uint64(own)
    while True:
        both = np.sort((key << shift) | position)
        order, s = (both & np.uint64((1 << own) - 1)).astype(np.int64), both >> shift
        new = np.ones(n, np.uint64)
        np.cumsum(s[1:] != s[:-1], out=new[1:])
        new[1:] += np.uint64(1)
        if k >= depth or int(new[-1]) == n:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = new
        key = rank << np.uint64(own + 1)
        if k < n:
            key[: n - k] |= rank[k:]
        k *= 2


def _long_suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    n = len(text)
    k = 1
    rank = text.astype(np.int64) + 1
    while True:
        after = np.zeros(n, np.int64)
        if k < n:
            after[: n - k] = rank[k:]
        order = np.lexsort((after, rank))
        s, t = rank[order], after[order]
        new = np.ones(n, np.int64)
        np.cumsum((s[1:] != s[:-1]) | (t[1:] != t[:-1]), out=new[1:])
        new[1:] += 1
        k *= 2
        if k >= depth or new[-1] == n:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new


#: the bits below each bit of a word
_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence, one packed bit vector for each bit of a symbol."""

    def __init__(self, seq: np.ndarray, top: int):
        self.n, self.bits = len(seq), max(1, int(top).bit_length())
        self.levels = []
        work = seq.astype(np.int32)
        for b in range(self.bits - 1, -1, -1):
            bit = ((work >> b) & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 2) * 64, bool)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.zeros(len(words), np.int32)
            np.cumsum(np.bitwise_count(words)[:-1], out=before[1:])
            zeros = self.n - int(bit.sum())
            self.levels.append((words, before, zeros))
            work = np.concatenate([work[~bit], work[bit]])
        # where the symbols stand after the last level
        self.first = np.full(int(top) + 2, -1, np.int32)
        if self.n:
            edge = np.flatnonzero(np.concatenate([[True], work[1:] != work[:-1]]))
            self.first[work[edge]] = edge

    @staticmethod
    def _ones(words, before, i):
        w = i >> 6
        return before[w] + np.bitwise_count(words[w] & _BELOW[i & 63])

    def ranks(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        i = i.copy()
        for b, (words, before, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            one = self._ones(words, before, i)
            i = np.where((symbol >> b) & 1, zeros + one, i - one)
        return i - self.first[symbol]

    def symbols(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All symbols in the ranges i to j with their ranks at both ends, range by range and unordered."""
        symbol = np.zeros(len(i), np.int32)
        for words, before, zeros in self.levels:
            a, b = self._ones(words, before, i), self._ones(words, before, j)
            i0, j0, i1, j1 = i - a, j - b, zeros + a, zeros + b
            left, right = j0 > i0, j1 > i1
            symbol = np.concatenate([symbol[left] << 1, (symbol[right] << 1) | 1])
            i, j = np.concatenate([i0[left], i1[right]]), np.concatenate([j0[left], j1[right]])
        base = self.first[symbol]
        return symbol, i - base, j - base


class FMIndex:
    """Backward search over the transform of a shard, whose suffixes come sorted in ``order``."""

    def __init__(self, text: np.ndarray, order: np.ndarray):
        self.n, top = len(text), int(text.max()) if len(text) else 0
        self.bwt = WaveletMatrix(text[order - 1], top)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int32)

    def step(self, symbol: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of symbol + pattern, from those of the patterns."""
        base = self.less[symbol]
        both = self.bwt.ranks(np.concatenate([symbol, symbol]), np.concatenate([i, j]))
        return base + both[: len(i)], base + both[len(i) :]

    def lengths_below(self, depth: int) -> np.ndarray:
        """Common prefix lengths of neighbours in suffix order, as far as they are under ``depth``.

        Breadth-first backward extension: the ranges of all strings of one length come from those
        one shorter; the right end of a range that is met for the first time parts two suffixes
        that agree in all but the last symbol.  Entry k belongs to the suffixes k - 1 and k; -1
        stands for ``depth`` or more.  Strings that hold the separator are left out, which leaves
        only entries after suffixes that hold it within ``depth`` symbols undecided.
        """
        out = np.full(self.n + 1, -1, np.int32)
        out[0] = 0
        i, j = np.array([0], np.int32), np.array([self.n], np.int32)
        for length in range(depth):
            if not len(i):
                break
            symbol, a, b = self.bwt.symbols(i, j)
            real = symbol > 0
            base = self.less[symbol[real]]
            i, j = base + a[real], base + b[real]
            new = out[j] < 0
            i, j = i[new], j[new]
            out[j] = length
        return out


class Minima:
    """Least values of ranges, and the next smaller values, from minima over powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            x, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(x[:-half], x[half:]))

    def least(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of values[i:j], none of them empty."""
        level = np.frexp((j - i).astype(np.float64))[1] - 1
        out = np.empty(len(i), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            x = self.levels[k]
            out[at] = np.minimum(x[i[at]], x[j[at] - (1 << k)])
        return out

    def below_left(self, p: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last position up to p whose value is under the bound; there is one."""
        p = p.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            at = p - (1 << k) + 1
            x = self.levels[k]
            far = (at >= 0) & (x[np.maximum(at, 0)] >= bound)
            p[far] -= 1 << k
        return p

    def below_right(self, p: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first position from p on whose value is under the bound; there is one."""
        p = p.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            x = self.levels[k]
            far = (p < len(x)) & (x[np.minimum(p, len(x) - 1)] >= bound)
            p[far] += 1 << k
        return p


class Matcher:
    """Matching statistics against the documents of smaller rank than a stream's limit.

    ``owner``: the rank of the document of each suffix, in suffix order.
    """

    def __init__(self, text: np.ndarray, owner_of: np.ndarray, depth: int):
        order = suffix_array(text, depth)
        self.depth, self.index = depth, FMIndex(text, order)
        n = len(text)
        lcp = self.index.lengths_below(depth)
        # undecided after a suffix that holds the separator: they agree as far as that
        ends = np.flatnonzero(text == 0)
        left = np.empty(n, np.int64)
        left[:] = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
        before = left[order]
        open_ = np.flatnonzero(lcp[1:n] < 0) + 1
        lcp[open_] = np.minimum(before[open_ - 1], depth)
        lcp = lcp.astype(np.int16)
        lcp[0] = lcp[n] = -1
        self.lcp = Minima(lcp)
        self.owner = Minima(owner_of[order].astype(np.int32))
        # where ranges of one symbol less than depth begin and end
        cut = lcp < depth - 1
        at = np.where(cut, np.arange(n + 1), 0)
        self.shorter_left = np.maximum.accumulate(at)
        self.shorter_right = np.minimum.accumulate(np.where(cut, np.arange(n + 1), n)[::-1])[::-1]

    def _extend(self, symbol, i, j, limit):
        """The ranges of the longer matches, and which of them hold a document under the limit."""
        a, b = self.index.step(symbol, i, j)
        ok = b > a
        some = np.flatnonzero(ok)
        ok[some] = self.owner.least(a[some], b[some]) < limit[some]
        return a, b, ok

    def matches(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams text[begin:end] from their ends, all in step: each position's longest match (up to
        ``depth`` symbols) in a document under the stream's limit comes from that of the position after
        it.  A match that can't be extended is shortened at its far end, to the longest that can.
        Returns the streams and positions whose match has ``depth`` symbols."""
        order = np.argsort(begin - end, kind="stable")  # longest first
        size, end, limit = (end - begin)[order], end[order], limit[order]
        i, j = np.zeros(len(order), np.int64), np.full(len(order), self.index.n, np.int64)
        length = np.zeros(len(order), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for t in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -t, "left"))  # streams of more than t symbols
            p = end[:m] - 1 - t
            symbol, lim = text[p], limit[:m]
            x, y, n = i[:m], j[:m], length[:m]
            whole = n == self.depth
            x, y, n = np.where(whole, self.shorter_left[x], x), np.where(whole, self.shorter_right[y], y), n - whole
            a, b, ok = self._extend(symbol, x, y, lim)
            new = np.where(ok, n + 1, 0)
            bad = np.flatnonzero(~ok)
            if len(bad):
                a[bad], b[bad] = 0, self.index.n
                low, high = np.full(len(bad), -1, np.int64), n[bad].copy()  # extends; does not
                while len(live := np.flatnonzero(high - low > 1)):
                    mid = (low[live] + high[live]) >> 1
                    k = bad[live]
                    u, v, works = self._extend(symbol[k], self.lcp.below_left(x[k], mid), self.lcp.below_right(y[k], mid), lim[k])
                    a[k[works]], b[k[works]] = u[works], v[works]
                    low[live[works]], high[live[~works]] = mid[works], mid[~works]
                new[bad] = low + 1
            i[:m], j[:m], length[:m] = a, b, new
            hit = np.flatnonzero(new == self.depth)
            found.append((order[hit], p[hit]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(f) for f in zip(*found))
