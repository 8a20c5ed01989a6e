"""Edit distances and alignments of token sequences, and the error rates from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

OPS = "array<struct<pos:int,op:string,ref:string,hyp:string>>"
#: code points for the distinct tokens of a pair: from here up to the surrogates, and all beyond them
_FIRST, _LAST, _BEYOND, _END = 0x3400, 0xD800, 0x10000, 0x110000


def edit_distance(ref: Column, hyp: Column) -> Column:
    """Unit-cost distance of two token arrays, inside the JVM: each distinct token of the pair becomes
    one character, and the built-in distance of strings does the rest.  A pair of more than a million
    distinct tokens has no spelling and is an error, never a null; null arrays give null."""
    low = _LAST - _FIRST
    code = lambda k: F.lpad(F.hex(F.when(k <= low, k + F.lit(_FIRST - 1)).otherwise(k + F.lit(_BEYOND - low - 1))), 8, "0")
    spell = lambda x, a: F.decode(F.unhex(F.array_join(F.transform(x[a], lambda t: code(F.array_position(x["tokens"], t))), "")), "UTF-32")
    # a lambda's parameter is bound once; an expression inside it would be computed for every token
    both = F.array(F.struct(F.array_distinct(F.concat(ref, hyp)).alias("tokens"), ref.alias("r"), hyp.alias("h")))
    distance = lambda x: F.when(
        F.coalesce(F.size(x["tokens"]), F.lit(0)) <= low + _END - _BEYOND, F.levenshtein(spell(x, "r"), spell(x, "h"))
    ).otherwise(F.raise_error(F.lit("a pair has too many distinct tokens")).cast("int"))
    return F.element_at(F.transform(both, distance), 1)


#: cells of the distance matrix that are kept; of a larger one only some rows are, and the rest come again
_CELLS = 1 << 22


def _rows(a: np.ndarray, b: np.ndarray, first: np.ndarray, i: int):
    """The rows of the distance matrix after row ``i``, which is ``first``."""
    step = np.arange(len(b) + 1)
    row = first
    for x in a[i:]:
        i += 1
        new = np.empty(len(b) + 1, np.int32)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = (np.minimum.accumulate(new - step) + step).astype(np.int32)
        yield row


#: operations of an edit script by their codes
_OPS = ("match", "sub", "del", "ins")
#: operations and rows that a batch of scripts holds at least, before it goes back to the JVM
_BATCH_OPS, _BATCH_ROWS = 1 << 16, 512


def _path(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Codes of the operations from ``a`` to ``b``, and the places in both of what they take (-1: none)."""
    n, m = len(a), len(b)
    # marks are rows from which a block of rows is made again on the way back
    block = n if n * (m + 1) <= _CELLS else max(1, int(n**0.5))
    marks = [np.arange(m + 1, dtype=np.int32)]
    if block < n:
        for i, row in enumerate(_rows(a, b, marks[0], 0), 1):
            if i % block == 0:
                marks.append(row)
    ops, left, right, i, j, begin, d = [], [], [], n, m, n + 1, []
    while i or j:
        if i <= begin and (i or not d):  # the block of rows that ends with row i
            begin = max(0, (i - 1) // block * block) if block else 0
            d = [marks[begin // block if block else 0]]
            d += _rows(a[:i], b, d[0], begin)
        row, above = d[i - begin], d[i - begin - 1] if i else None
        if i and j and a[i - 1] == b[j - 1]:
            op = 0
        elif i and j and row[j] == above[j - 1] + 1:
            op = 1
        elif i and row[j] == above[j] + 1:
            op = 2
        else:
            op = 3
        if op != 3:
            i -= 1
        if op != 2:
            j -= 1
        ops.append(op)
        left.append(i if op != 3 else -1)
        right.append(j if op != 2 else -1)
    return ops[::-1], left[::-1], right[::-1]


def _script(r: list, h: list) -> list[tuple]:
    """The edit script of two lists."""
    code: dict = {}
    a, b = (np.array([code.setdefault(t, len(code)) for t in x], np.int64) for x in (r, h))
    return [(_OPS[o], r[i] if i >= 0 else None, h[j] if j >= 0 else None) for o, i, j in zip(*_path(a, b))]


def _tokens(x: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all rows, and where each row's begin and end; null rows are empty."""
    size = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)
    return x.flatten(), np.concatenate([[0], np.cumsum(size)])


def _scripts(ref: pa.Array, hyp: pa.Array) -> Iterator[pa.Array]:
    """Edit scripts of all rows, some rows at a time.  Tokens are compared by number and taken from the
    input's buffers: no Python object is made of a token or an operation's fields."""
    r, r_at = _tokens(ref)
    h, h_at = _tokens(hyp)
    number = pc.fill_null(pa.concat_arrays([r, h]).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    a, b = number[: len(r)], number[len(r) :]
    names = pa.array(_OPS)

    def batch() -> pa.Array:
        place = lambda x: pa.array(x, pa.int64(), mask=x < 0)
        sizes = np.array([len(x) for x in ops])
        ends = np.cumsum(sizes)
        pos = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        flat = lambda x: np.concatenate([np.asarray(p, np.int64) for p in x])
        fields = [pa.array(pos, pa.int32()), names.take(pa.array(flat(ops))), r.take(place(flat(left))), h.take(place(flat(right)))]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays(fields, ["pos", "op", "ref", "hyp"]))

    ops, left, right, held = [], [], [], 0
    for i in range(len(ref)):
        o, x, y = _path(a[r_at[i] : r_at[i + 1]], b[h_at[i] : h_at[i + 1]])
        ops.append(np.array(o, np.int8))
        left.append(np.array([k + r_at[i] if k >= 0 else -1 for k in x], np.int64))
        right.append(np.array([k + h_at[i] if k >= 0 else -1 for k in y], np.int64))
        held += len(o)
        if held >= _BATCH_OPS or len(ops) >= _BATCH_ROWS:
            yield batch()
            ops, left, right, held = [], [], [], 0
    if ops:
        yield batch()


def align(ref: Column, hyp: Column) -> Column:
    """The edit script from ``ref`` to ``hyp``: match, sub, del, ins in forward order; where several
    are optimal, the backtrace takes match before sub before del before ins.

    An Arrow function: rows of the distance matrix are vectorised, the backtrace walks one path.  A
    matrix of more than ``_CELLS`` cells is never whole in memory, and scripts go back some rows at a
    time.  Null arrays count as empty.
    """

    @F.arrow_udf(OPS)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for r, h in batches:
            yield from _scripts(r, h)

    return run(ref, hyp)


def op_counts(ops: Column) -> list[Column]:
    """How many of each operation an edit script has."""
    count = lambda kind: F.size(F.filter(ops, lambda o: o["op"] == kind)).cast("bigint")
    return [count(kind).alias(f"n_{kind}") for kind in ("match", "sub", "del", "ins")]


def _rate(pairs: DataFrame, edits: Column, units: Column, name: str) -> DataFrame:
    sums = pairs.select(edits.alias("e"), units.alias("n")).agg(F.coalesce(F.sum("e"), F.lit(0)).cast("bigint").alias("edits"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_ref"))
    return sums.select("edits", "n_ref", F.when(F.col("n_ref") > 0, F.col("edits").cast("double") / F.col("n_ref")).otherwise(F.lit(0.0)).alias(name))


def word_error_rate(pairs: DataFrame, *, ref_col: str = "ref", hyp_col: str = "hyp") -> DataFrame:
    """``edits, n_ref, wer`` over the corpus (0 without reference words)."""
    r, h = T.words(F.col(ref_col)), T.words(F.col(hyp_col))
    return _rate(pairs.select(r.alias("r"), h.alias("h")), edit_distance(F.col("r"), F.col("h")), F.size("r"), "wer")


def character_error_rate(pairs: DataFrame, *, ref_col: str = "ref", hyp_col: str = "hyp") -> DataFrame:
    """``edits, n_ref, cer`` over the corpus, blanks left out."""
    plain = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit(" "))
    return _rate(pairs.select(plain(ref_col).alias("r"), plain(hyp_col).alias("h")), F.levenshtein("r", "h"), F.char_length("r"), "cer")
