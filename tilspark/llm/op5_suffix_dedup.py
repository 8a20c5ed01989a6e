"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts anywhere else too.

Candidates come from ``repeats``.  In each shard the breadth-first backward extension on a
Burrows-Wheeler transform derives the common prefixes of neighbouring suffixes by increasing value
and stops at ``length``; suffixes that it doesn't part by then share a string of that length.

Null text counts as empty: no bytes, no spans, the digest of the empty string.  Null ids come back
null.  Repeated rows are copies of each other.  Very long texts are cut into overlapping pieces to
find their fragments.  Ties can't occur, an empty table gives an empty result, other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import arrays as A
from . import repeats as R
from .fm_index import FMIndex, suffix_array


def finder(length: int):
    def find(shard: R.Shard):
        if not len(shard.position):
            return [(False, np.zeros(0, bool))]
        order = suffix_array(shard.text, length)
        group = np.cumsum(FMIndex(shard.text, order).lengths_below(length)[: len(order)] >= 0)
        of = np.empty(len(order), np.int64)
        of[order] = group
        g = of[shard.position]
        return [(False, np.bincount(g, weights=shard.n[shard.frag].astype(float), minlength=int(group[-1]) + 1)[g] >= 2)]

    return find


def _bytes_left(batch: pa.RecordBatch):
    for i, j, buf, off in A.sliced(A.column(batch, "text")):
        gone = R.cover(batch, i, j, off)
        kept = buf[~gone]
        koff = np.concatenate([[0], np.cumsum(~gone)])[off]
        starts, _ = A.runs(gone, off)
        spans = np.searchsorted(starts, off)
        yield i, j, off, kept, koff, np.diff(spans), A.sums(gone, off)


def repeated_ranges(docs: DataFrame, length: int = 200, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, th, ranges`` of the documents that hold repeated strings."""
    return R.covered_ranges(docs, R.byte_unit(length), finder(length), True, id_col=id_col, text_col=text_col)


def suffix_dedup(docs: DataFrame, length: int = 200, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans`` and the bytes that are left (or their SHA-256)."""
    ranges = repeated_ranges(docs, length, id_col=id_col, text_col=text_col)
    last = "kept_sha256" if digests else "kept"

    def run(batch):
        ids = A.column(batch, "id").to_numpy()
        for i, j, off, kept, koff, spans, gone in _bytes_left(batch):
            raw = memoryview(kept) if len(kept) else b""
            parts = [raw[a:b] for a, b in zip(koff[:-1].tolist(), koff[1:].tolist())]
            out = pa.array([hashlib.sha256(p).hexdigest() for p in parts]) if digests else pa.array([bytes(p) for p in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], mask=ids[i:j] == R.NO_ID), pa.array(np.diff(off)), pa.array(gone), pa.array(spans), out], ["doc_id", "n_bytes", "n_removed", "n_spans", last])

    schema = f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last} {'string' if digests else 'binary'}"
    return R.with_ranges(docs, ranges, run, schema, id_col=id_col, text_col=text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digests=True)


SQL = None  # one row for each byte of the corpus is beyond SQL here; tests hold it against brute force
