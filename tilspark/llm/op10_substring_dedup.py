"""Substring dedup: words covered by a window of ``length`` words that a smaller document holds.

Candidates come from ``repeats``.  Each shard's fragments are indexed by a compressed FM-index
(wavelet matrix over the transform) and streamed through it from their ends: backward search over the
wavelet tree carries each position's longest match in a smaller document on to the position before
it (matching statistics), and positions whose match reaches ``length`` words are reported.

Null text has no words; null ids come back null and count as larger than any other, so they lose
windows to documents with ids and never to each other; rows of one id don't take windows from each
other.  Of equal texts that of the smallest id keeps its words.  Very long texts are cut into
overlapping pieces to find their fragments.  An empty table gives an empty result, other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import arrays as A
from . import repeats as R
from .fm_index import Matcher


def finder(length: int):
    def find(shard: R.Shard):
        first, later = np.zeros(len(shard.position), bool), np.zeros(len(shard.position), bool)
        if len(shard.position):
            _, rank = np.unique(shard.low, return_inverse=True)
            matcher = Matcher(shard.text, rank[shard.owner], length)
            # a fragment is a stream for its first document and, if there are others, one for those
            more = np.flatnonzero(shard.low < shard.high)
            frag = np.concatenate([np.arange(len(rank)), more])
            limit = np.concatenate([rank, rank[more] + 1])
            begin = shard.begin[frag]
            stream, at = matcher.matches(shard.text, begin, begin + shard.size[frag], limit)
            window = np.full(len(shard.text), -1, np.int64)
            window[shard.position] = np.arange(len(shard.position))
            second = stream >= len(rank)
            first[window[at[~second]]] = True
            later[window[at[second]]] = True
        return [(False, first), (True, later)]

    return find


def repeated_ranges(docs: DataFrame, length: int = 50, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, ranges`` (of words) of the documents that lose any."""
    return R.covered_ranges(docs, R.word_unit(length), finder(length), False, id_col=id_col, text_col=text_col)


def substring_dedup(docs: DataFrame, length: int = 50, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed`` and the words that are left, joined by a blank (or their SHA-256)."""
    ranges = repeated_ranges(docs, length, id_col=id_col, text_col=text_col)
    last = "kept_sha256" if digests else "kept"

    def run(batch):
        ids = A.column(batch, "id").to_numpy()
        for i, j, buf, off in A.sliced(A.column(batch, "text")):
            s, e, woff = A.words(buf, off)
            gone = R.cover(batch, i, j, woff)
            keep = np.flatnonzero(~gone)
            # the kept words with a blank after each
            length_ = e[keep] - s[keep] + 1
            end = np.concatenate([[0], np.cumsum(length_)])
            out = np.full(int(end[-1]), 32, np.uint8)
            take = np.arange(int(end[-1])) - np.repeat(end[:-1], length_)
            src = np.repeat(s[keep], length_) + take
            word = take < np.repeat(length_ - 1, length_)
            out[word] = buf[src[word]]
            koff = end[np.searchsorted(keep, woff)]
            raw = memoryview(out) if len(out) else b""
            parts = [raw[a : max(a, b - 1)] for a, b in zip(koff[:-1].tolist(), koff[1:].tolist())]
            kept = pa.array([hashlib.sha256(p).hexdigest() for p in parts]) if digests else pa.array([bytes(p).decode() for p in parts], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], mask=ids[i:j] == R.NO_ID), pa.array(np.diff(woff)), pa.array(A.sums(gone, woff)), kept], ["doc_id", "n_words", "n_removed", last])

    return R.with_ranges(docs, ranges, run, f"doc_id bigint, n_words bigint, n_removed bigint, {last} string", id_col=id_col, text_col=text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digests=True)


SQL = None  # a row for each window of the corpus is beyond SQL here; tests hold it against brute force
