"""Vectorised pre-tokenisation of byte-level BPE texts.

``public_tokenizers.PATTERN`` splits at changes between letters, numbers, white space and other
characters, with two exceptions (a blank joins the run after it; an apostrophe takes s, t, re, ve,
m, ll or d with it).  ``starts`` finds all the split points of many texts with array operations.
Any other pattern goes through the ``regex`` module, one text at a time.
"""

from __future__ import annotations

import functools

import numpy as np
import public_tokenizers

from . import arrays as A

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: fixed value: the pattern that ``starts`` implements
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, text):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a == len(m[0]) - 1:
                out[a : b + 1] = kind
            else:  # a run over the gap of the surrogates
                out[[ord(c) for c in m[0]]] = kind
    return out


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte each begins at."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at]
    cp = lead.astype(np.uint32)
    for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0xF8, 3)):
        k = np.flatnonzero((lead >= low) & (lead < high))
        if len(k):
            v = (lead[k] & (0xFF >> (more + 2))).astype(np.uint32)
            for d in range(1, more + 1):
                v = (v << 6) | (buf[at[k] + d] & 0x3F)
            cp[k] = v
    return cp, at


def starts(buf: np.ndarray, off: np.ndarray, pattern: str = KNOWN) -> np.ndarray:
    """Byte positions at which the pre-tokens of the texts begin, in order."""
    if pattern != KNOWN:
        return _starts_by_regex(buf, off, pattern)
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64)
    cp, at = code_points(buf)
    m = len(cp)
    first = np.zeros(m, bool)  # of a text
    first[np.searchsorted(at, off[:-1][np.diff(off) > 0])] = True
    cls = classes()[cp]
    change = np.ones(m, bool)
    change[1:] = cls[1:] != cls[:-1]
    change |= first
    space = cls == SPACE
    blank = cp == 32
    # the next character belongs to the same text and is no white space
    goes_on = np.zeros(m, bool)
    goes_on[:-1] = ~first[1:] & ~space[1:]
    begin = change.copy()
    begin[1:] &= ~(blank[:-1] & ~space[1:] & ~first[1:])  # joined to the blank before
    begin |= space & goes_on  # the last white space before a run
    q = np.flatnonzero((cp == 0x27) & begin)
    if len(q):
        q = q[(q + 1 < m)]
        q = q[~first[q + 1]]
        c1 = cp[q + 1]
        two = np.isin(c1, [ord(c) for c in "stmd"])
        rest, c = q[~two], c1[~two]
        ok = rest + 2 < m
        rest, c = rest[ok], c[ok]
        ok = ~first[rest + 2]
        rest, c, c2 = rest[ok], c[ok], cp[rest[ok] + 2]
        three = rest[((c == ord("r")) & (c2 == ord("e"))) | ((c == ord("v")) & (c2 == ord("e"))) | ((c == ord("l")) & (c2 == ord("l")))]
        for p, k in ((q[two], 2), (three, 3)):
            begin[p + 1] = False
            p = p[p + k < m]
            # within the run of letters that the apostrophe took from, the rest begins anew; a blank
            # or another class begins by itself
            begin[p[cls[p + k] == LETTER] + k] = True
    return at[begin]


def _starts_by_regex(buf: np.ndarray, off: np.ndarray, pattern: str) -> np.ndarray:
    import regex

    split, out = regex.compile(pattern), []
    raw = buf.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        for m in split.finditer(raw[a:b].decode()):
            out.append(a)
            a += len(m[0].encode())
        if a != b:
            raise ValueError("the pattern leaves parts of a text unmatched")
    return np.array(out, np.int64)


def pretokens(buf: np.ndarray, off: np.ndarray, pattern: str = KNOWN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a slice: their starts, ends and hashes; each occurrence's class; occurrence offsets of the rows.

    Pre-tokens of one hash are held to their bytes; should two differ, both are listed."""
    s = starts(buf, off, pattern)
    e = np.append(s[1:], len(buf)) if len(s) else s
    h = A.span_hashes(buf, s, e)
    uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    length, rep = e - s, s[first][inverse]
    other = np.flatnonzero(length != length[first][inverse])
    if not len(other):
        other = np.flatnonzero(~A.equal_spans(buf, s, buf, rep, length))
    if len(other):  # equal hashes, other bytes: classes by the bytes themselves
        raw, seen = buf.tobytes(), {}
        inverse = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(s.tolist(), e.tolist())), np.int64, len(s))
        _, first = np.unique(inverse, return_index=True)
        uniq = h[first]
    return s[first], e[first], uniq, inverse, np.searchsorted(s, off)


def pieces(buf: np.ndarray, limit: int) -> np.ndarray:
    """Offsets that cut one long text into parts of about ``limit`` bytes that can be pre-tokenised by
    themselves: before a blank or line break that follows a printable ASCII character."""
    cuts = [0]
    while len(buf) - cuts[-1] > 2 * limit:
        at = cuts[-1] + limit
        while at < len(buf):
            part = buf[at : at + limit]
            ok = np.flatnonzero(((part[1:] == 32) | (part[1:] == 10)) & (part[:-1] > 32) & (part[:-1] < 127))
            if len(ok):
                break
            at += limit - 1
        if at >= len(buf):
            break
        cuts.append(at + int(ok[0]) + 1)
    return np.array([*cuts, len(buf)], np.int64)


def parts(arr, pattern: str = KNOWN):
    """``arrays.sliced`` with a long text in parts: (first row, end row, bytes, offsets of the parts,
    last); a text goes on in the next slice until ``last``."""
    for i, j, buf, off in A.sliced(arr):
        if j - i > 1 or len(buf) <= 4 * A.SLICE_BYTES or pattern != KNOWN:
            yield i, j, buf, off, True
            continue
        cuts = pieces(buf, A.SLICE_BYTES)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield i, j, buf[a:b], np.array([0, b - a], np.int64), b == len(buf)


def default_pattern() -> str:
    return public_tokenizers.PATTERN
