"""Token counts by a map-side two-tier lookup.

Tier 1 is a broadcast table of frequent pre-tokens and their token counts, of at most
``table_size`` entries in flat arrays: sorted hashes, the bytes they are held to, counts.  Which
pre-tokens are in it matters for speed only; it is filled from a sample of about ``sample_docs``
documents, drawn by a hash of the text over the whole table.  Tier 2 encodes the misses once by the
tokenizer library and keeps their counts in a worker's cache of bounded bytes.  Pre-tokens are
never shuffled; every text is read whole.

Null text counts as empty (0 tokens).  A very long text is counted in parts that begin where a
pre-token does.  Null ids come back null, repeated rows give repeated results, ties can't occur, an
empty table gives an empty result; columns besides the id and the text are ignored, whatever their
names.  Texts that hold a special token's string go to the library as a whole, which counts it as
that token.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from . import pretoken
from .spans import Cache, SpanTable


class Counter:
    """Token counts of texts under one byte-level BPE tokenizer file."""

    def __init__(self, data: str):
        from tokenizers import Tokenizer

        spec = json.loads(data)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level tokenizer without normalizer or prefix space is expected")
        self.lib = Tokenizer.from_str(data)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.specials = [x["content"].encode() for x in spec["added_tokens"]]
        self.cache = Cache()

    def encode_counts(self, texts: list[str]) -> np.ndarray:
        return np.fromiter((len(e.ids) for e in self.lib.encode_batch(texts, add_special_tokens=False)), np.int32, len(texts))

    def lookup(self, buf, s, e, h, table: SpanTable) -> np.ndarray:
        """The token count of each distinct pre-token."""
        out = np.full(len(h), -1, np.int64)
        for known in (table, *self.cache.tables()):
            left = np.flatnonzero(out < 0)
            k = known.find(buf, s[left], e[left], h[left])
            hit = k >= 0
            out[left[hit]] = known.values[known.values_end[k[hit]]]
        new = np.flatnonzero(out < 0)
        if len(new):
            raw = buf.tobytes()
            found = self.encode_counts([raw[a:b].decode() for a, b in zip(s[new].tolist(), e[new].tolist())])
            out[new] = found
            self.cache.add(buf, s[new], e[new], h[new], found.astype(np.uint32), np.ones(len(new), np.int64))
        return out

    def count(self, buf: np.ndarray, off: np.ndarray, table: SpanTable) -> np.ndarray:
        """The token counts of texts without special strings."""
        s, e, h, inverse, poff = pretoken.pretokens(buf, off)
        return A.sums(self.lookup(buf, s, e, h, table)[inverse], poff) if len(s) else np.zeros(len(off) - 1, np.int64)

    def special_rows(self, raw: bytes, off: np.ndarray) -> list[int]:
        """The texts that hold a special token's string."""
        rows = set()
        for special in self.specials:
            at = raw.find(special)
            while at >= 0:
                row = int(np.searchsorted(off, at, "right")) - 1
                if at + len(special) <= off[row + 1]:
                    rows.add(row)
                    at = int(off[row + 1]) - 1
                at = raw.find(special, at + 1)
        return sorted(rows)

    def counts(self, texts: pa.Array, table: SpanTable) -> np.ndarray:
        """The token count of each text."""
        out = np.zeros(len(texts), np.int64)
        for i, j, buf, off, _ in pretoken.parts(texts):
            out[i:j] += self.count(buf, off, table)
        for i, j, buf, off in A.sliced(texts):
            raw = buf.tobytes()
            for row in self.special_rows(raw, off):
                out[i + row] = self.encode_counts([raw[off[row] : off[row + 1]].decode()])[0]
        return out


_counters: dict[str, Counter] = {}


def _counter(data: str) -> Counter:
    key = hashlib.sha256(data.encode()).hexdigest()
    if key not in _counters:
        _counters[key] = Counter(data)
    return _counters[key]


def frequent_table(docs: DataFrame, data: str, *, sample_docs: int = 1000, table_size: int = 1 << 16) -> SpanTable:
    """The most frequent pre-tokens of about ``sample_docs`` documents (``text``) with their token counts.

    The workers hash and count; the driver gets one row for each of at most ``table_size``
    pre-tokens of at most 64 bytes.
    """

    def hashes(batches):
        for batch in batches:
            for _, _, buf, off, _ in pretoken.parts(A.column(batch, "text")):
                s, e, h, inverse, _ = pretoken.pretokens(buf, off)
                n = np.bincount(inverse, minlength=len(h))
                some = np.flatnonzero((n > 1) & (e - s <= 64))
                raw = buf.tobytes()
                yield pa.RecordBatch.from_pydict({"token": pa.array([raw[a:b] for a, b in zip(s[some].tolist(), e[some].tolist())], pa.binary()), "n": n[some]})

    share = min(1.0, sample_docs / max(1, docs.count()))
    # many texts may be equal, so the row's place is hashed along: the sample is of the table, not of its distinct texts
    drawn = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    top = docs.where(drawn).mapInArrow(A.trimmed(hashes), "token binary, n bigint")
    top = top.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(table_size).collect()
    tokens = [bytes(r["token"]) for r in top]
    end = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
    buf = np.frombuffer(b"".join(tokens), np.uint8)
    counts = _counter(data).encode_counts([t.decode() for t in tokens]).astype(np.uint32)
    return SpanTable.of(buf, end[:-1], end[1:], A.span_hashes(buf, end[:-1], end[1:]), counts, np.ones(len(tokens), np.int64))


def token_counts(docs: DataFrame, path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, sample_docs: int = 1000, table_size: int = 1 << 16) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each document."""
    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        data = f.read()
    docs = A.small_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text")
    table = frequent_table(docs, data, sample_docs=sample_docs, table_size=table_size)
    sent = docs.sparkSession.sparkContext.broadcast((data, table))

    def run(batches):
        spec, known = sent.value
        counter = _counter(spec)
        for batch in batches:
            text = A.column(batch, "text")
            n = counter.counts(text, known)
            yield pa.RecordBatch.from_pydict({"doc_id": A.column(batch, "doc_id"), "n_bytes": np.diff(A.utf8(text)[1]), "n_tokens": n, "over_limit": n > limit})

    return docs.mapInArrow(A.trimmed(run), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None  # merges by rank are an iteration that SQL can't express at this size; tests hold it against the library
