"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves every pre-token that is itself a
token.  Tier 2: the others go through a heap of mergeable pairs over a linked list of bytes; a
cache of bounded bytes per worker keeps their ids.  Hashes only find candidates: both tiers, and the
classes of equal pre-tokens in a slice, are held to the bytes.  Texts are independent: one Arrow
pass, no shuffle.

Null text counts as empty: no tokens, and the digests of the empty string.  A very long text is
encoded in parts that begin where a pre-token does, so memory is that of a part and of its ids.
Null ids come back null.  Repeated rows give repeated results, ties can't occur, an empty table gives
an empty result; columns besides the id and the text are ignored, whatever their names.  The rank
file is read on the driver and carried to the workers as a broadcast (a vocabulary: 50,256 entries,
about 1 MB).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import arrays as A
from . import pretoken
from .arrays import gather
from .spans import Cache


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token, blank, rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


class MinimalPerfectHash:
    """Hash and displace: n keys to 0..n-1 without gaps.

    A key's 64-bit hash picks a bucket; the bucket's displacement sends its keys to free slots.
    Buckets are placed largest first; the keys of one bucket differ in slot by trial.  ``find``
    compares length and bytes, so a string outside the vocabulary is never taken for one inside.
    """

    def __init__(self, tokens: list[bytes]):
        n = self.n = len(tokens)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        h = A.span_hashes(self.data, self.offsets[:-1], self.offsets[1:])
        self.buckets = max(1, n // 3)
        b = (h % A.U(self.buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        size = np.bincount(b, minlength=self.buckets)
        begin = np.concatenate([[0], np.cumsum(size)])
        self.shift = np.zeros(self.buckets, np.uint64)
        self.slot = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        for k in np.argsort(-size, kind="stable").tolist():
            if not size[k]:
                break
            keys = order[begin[k] : begin[k + 1]]
            d = 0
            while True:
                # 64 displacements at a time
                tries = self._at(h[keys][:, None], np.arange(d, d + 64, dtype=np.uint64)[None, :])
                free = ~taken[tries].any(axis=0)
                if len(keys) > 1:
                    t = np.sort(tries, axis=0)
                    free &= (t[1:] != t[:-1]).all(axis=0)
                if free.any():
                    j = int(np.argmax(free))
                    self.shift[k] = d + j
                    taken[tries[:, j]] = True
                    self.slot[tries[:, j]] = keys
                    break
                d += 64

    def _at(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (A.mix(h + d * A.U(0x9E3779B97F4A7C15)) % A.U(self.n)).astype(np.int64)

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The index of each byte span in the vocabulary, or -1."""
        k = self.slot[self._at(h, self.shift[(h % A.U(self.buckets)).astype(np.int64)])]
        length = ends - starts
        k = np.where(self.lengths[k] == length, k, -1)
        ok = np.flatnonzero(k >= 0)
        k[ok[~A.equal_spans(buf, starts[ok], self.data, self.offsets[k[ok]], length[ok])]] = -1
        return k


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always the lowest-ranked pair, leftmost first."""
    n = len(word)
    right = list(range(1, n + 1))  # the end of the part that begins here; linked list
    left = list(range(-1, n))  # the begin of the part before the one that begins here
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = right[i]
        if gone[i] or mid >= n or right[mid] != end:
            continue  # one of the two parts has grown since
        right[i] = end
        gone[mid] = 1
        if end < n:
            left[end] = i
            r = ranks.get(word[i : right[end]])
            if r is not None:
                heapq.heappush(heap, (r, i, right[end]))
        if i:
            p = left[i]
            r = ranks.get(word[p:end])
            if r is not None:
                heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : right[i]]])
        i = right[i]
    return out


class ByteBPE:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        tokens = sorted(ranks, key=ranks.get)
        self.rank_of = np.array([ranks[t] for t in tokens], np.uint32)
        self.mph = MinimalPerfectHash(tokens)
        top = int(self.rank_of.max()) + 1
        self.token_length = np.zeros(top, np.int64)
        self.token_offset = np.zeros(top, np.int64)
        self.token_length[self.rank_of] = self.mph.lengths
        self.token_offset[self.rank_of] = self.mph.offsets[:-1]
        self.cache = Cache()

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the offsets of each text's ids."""
        s, e, h, inverse, poff = pretoken.pretokens(buf, off, self.pattern)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        # tier 1
        k = self.mph.find(buf, s, e, h)
        whole = np.flatnonzero(k >= 0)
        flat = [self.rank_of[k[whole]]]
        begin, count = np.zeros(len(s), np.int64), np.ones(len(s), np.int64)
        begin[whole] = np.arange(len(whole))
        size = len(whole)
        # tier 2: spelled before by this worker, or now
        new = np.flatnonzero(k < 0)
        for table in self.cache.tables():
            c = table.find(buf, s[new], e[new], h[new])
            known, entry, new = new[c >= 0], c[c >= 0], new[c < 0]
            count[known] = table.counts(entry)
            begin[known] = size + np.cumsum(count[known]) - count[known]
            flat.append(table.values_of(entry))
            size += len(flat[-1])
        if len(new):
            raw, ranks = buf.tobytes(), self.ranks
            spelled = [merge(raw[a:b], ranks) for a, b in zip(s[new].tolist(), e[new].tolist())]
            count[new] = list(map(len, spelled))
            begin[new] = size + np.cumsum(count[new]) - count[new]
            flat.append(np.fromiter((i for x in spelled for i in x), np.uint32, int(count[new].sum())))
            self.cache.add(buf, s[new], e[new], h[new], flat[-1], count[new])
        each = count[inverse]
        ids = gather(np.concatenate(flat), begin[inverse], each)
        return ids, np.concatenate([[0], np.cumsum(each)])[poff]

    def decode(self, ids: np.ndarray, ioff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the id sequences, and their offsets."""
        length = self.token_length[ids]
        out = gather(self.mph.data, self.token_offset[ids], length)
        return out, np.concatenate([[0], np.cumsum(length)])[ioff]


_coders: dict[str, ByteBPE] = {}


def coder(spark: SparkSession, path: str, pattern: str) -> Callable[[], ByteBPE]:
    """A function that gives the worker's coder; the rank file needs to lie on the driver only."""
    with open(path, "rb") as f:
        data = f.read()
    sent = spark.sparkContext.broadcast(data)
    key = hashlib.sha256(data + pattern.encode()).hexdigest()

    def get() -> ByteBPE:
        if key not in _coders:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, sent.value.splitlines()))}
            _coders[key] = ByteBPE(ranks, pattern)
        return _coders[key]

    return get


SCHEMA = "doc_id bigint, n_tokens bigint, ids binary, decoded binary"


def byte_bpe(docs: DataFrame, path: str | None = None, pattern: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Each document's ids (little-endian unsigned 32-bit) and the bytes decoded from them, or the
    SHA-256 digests of both."""
    spark = docs.sparkSession
    get = coder(spark, path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or pretoken.default_pattern())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]

    def cut(x, at, width):
        raw = memoryview(x).cast("B") if len(x) else b""
        return [raw[p * width : q * width] for p, q in zip(at[:-1].tolist(), at[1:].tolist())]

    def column(parts):
        return pa.array([hashlib.sha256(x).hexdigest() for x in parts]) if digests else pa.array([bytes(x) for x in parts], pa.binary())

    def run(batches):
        bpe = get()
        for batch in batches:
            key, held = A.column(batch, "doc_id"), []
            for i, j, buf, off, last in pretoken.parts(A.column(batch, "text"), bpe.pattern):
                ids, ioff = bpe.encode(buf, off)
                out, ooff = bpe.decode(ids, ioff)
                ids = ids.astype("<u4", copy=False)
                if held or not last:  # parts of one text
                    held.append((ids, out))
                    if not last:
                        continue
                    ids, out = (np.concatenate(x) for x in zip(*held))
                    held, ioff, ooff = [], np.array([0, len(ids)]), np.array([0, len(out)])
                yield pa.RecordBatch.from_arrays([key.slice(i, j - i), pa.array(np.diff(ioff)), column(cut(ids, ioff, 4)), column(cut(out, ooff, 1))], names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else SCHEMA
    return A.small_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(A.trimmed(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


SQL = None  # merges by rank are an iteration that SQL can't express at this size; tests hold it against tiktoken
