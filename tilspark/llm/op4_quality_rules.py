"""Quality rules: repetition coverage by rolling hashes of several n-gram lengths.

Every text is one row in and one row out, in numpy over slices of an Arrow batch: no shuffle, and
memory bounded by the slice (a longer text is a slice of its own).  Null text counts as a text
without words, and fails for want of words; ties cannot occur; repeated rows give repeated results;
an empty table gives an empty result; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import arrays as A

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class QualityRules:
    """Limits in percent of a text's word characters (lines: of its lines with a word).

    top: share of the most frequent n-gram; repeated: share inside n-grams found twice or more,
    first ones included; lines: share of lines that equal an earlier one, and of their characters.
    """

    min_words: int = 10
    max_repeat_words: int = 20
    top: tuple[tuple[int, int], ...] = ((2, 20), (3, 18), (4, 16))
    repeated: tuple[tuple[int, int], ...] = ((5, 30), (6, 28), (7, 26), (8, 24), (9, 22), (10, 20))
    max_dup_lines: int = 30
    max_dup_line_chars: int = 20


#: words of the windows that the base rule counts
BASE_WINDOW = 5

SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, dup_line_chars bigint, max_repeated_pct double, max_top_pct double"


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key: its class, and of each class: its size and first position."""
    _, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return inverse, count, first


def _score(buf: np.ndarray, off: np.ndarray, rules: QualityRules) -> dict[str, np.ndarray]:
    n = len(off) - 1
    lead = (buf & 0xC0) != 0x80  # one for each code point
    starts, ends, woff = A.words(buf, off)
    n_words = np.diff(woff)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(lead, out=chars[1:])
    lengths = chars[ends] - chars[starts]
    word_chars = A.sums(lengths, woff)
    item = A.span_hashes(buf, starts, ends)
    row = A.rows_of(woff)
    salt = A.mix(np.arange(n, dtype=np.uint64) + A.U(1))
    end_of_row = woff[1:][row] if len(row) else row
    repeated_pct, top_pct = np.zeros(n), np.zeros(n)
    failed = np.zeros(n, bool)
    safe = np.maximum(word_chars, 1)
    grams = A.Windows(item)

    def repeats_of(m):
        at = np.arange(max(0, len(row) - m + 1))
        at = at[at + m <= end_of_row[at]]
        return at, *_repeats(grams.of(m)[at] ^ salt[row[at]])

    def coverage(m):
        at, cls, count, _ = repeats_of(m)
        hit = at[count[cls] > 1]
        return A.covered(len(row), hit, hit + m)

    base_windows = coverage(BASE_WINDOW)
    n_repeat = A.sums(base_windows, woff)
    for m, limit in rules.repeated:
        inside = base_windows if m == BASE_WINDOW else coverage(m)
        share = 100 * A.sums(lengths * inside, woff)
        np.maximum(repeated_pct, share / safe, out=repeated_pct)
        failed |= share > limit * word_chars
    wc = np.concatenate([[0], np.cumsum(lengths)])
    for m, limit in rules.top:
        at, _, count, first = repeats_of(m)
        begin = at[first]
        weight = np.where(count > 1, count * (wc[begin + m] - wc[begin]), 0)
        best = np.zeros(n, np.int64)
        np.maximum.at(best, row[begin], weight)
        share = 100 * best
        np.maximum(top_pct, share / safe, out=top_pct)
        failed |= share > limit * word_chars
    # lines
    breaks = np.flatnonzero(buf == 10)
    extra = np.searchsorted(breaks, off)
    line_row = np.repeat(np.arange(n), np.diff(extra) + 1)
    ls = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    le = np.sort(np.concatenate([breaks, off[1:]]), kind="stable")
    # a row's first start and a break before it may be equal; both orders agree as rows are contiguous
    has_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    key = A.span_hashes(buf, ls, le) ^ salt[line_row]
    cls, _, first = _repeats(key)
    again = has_word & (first[cls] != np.arange(len(key)))
    loff = np.concatenate([[0], np.cumsum(np.diff(extra) + 1)])
    n_dup_lines = A.sums(again, loff)
    in_line = wc[np.searchsorted(starts, le)] - wc[np.searchsorted(starts, ls)]
    dup_chars = A.sums(in_line * again, loff)
    failed |= (100 * n_dup_lines > rules.max_dup_lines * A.sums(has_word, loff))
    failed |= (100 * dup_chars > rules.max_dup_line_chars * word_chars)
    base = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_words * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": A.sums(SYMBOL[buf], off), "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat, "base_failed": base, "kept": ~base & ~failed, "dup_line_chars": dup_chars,
        "max_repeated_pct": repeated_pct, "max_top_pct": top_pct,
    }


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measurements and verdicts for each document."""

    def run(batches):
        for batch in batches:
            ids = A.column(batch, "doc_id")
            for i, j, buf, off in A.sliced(A.column(batch, "text")):
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(i, j - i), **_score(buf, off, rules)})

    return A.small_batches(docs).selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(A.trimmed(run), SCHEMA)


def filter_quality(docs: DataFrame, rules: QualityRules = QualityRules(), *, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, all columns unchanged: one pass, no join."""

    def run(batches):
        for batch in batches:
            text = batch.column(at)
            for i, j, buf, off in A.sliced(text):
                yield batch.slice(i, j - i).filter(pa.array(_score(buf, off, rules)["kept"]))

    at = docs.columns.index(text_col)
    return A.small_batches(docs).mapInArrow(A.trimmed(run), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("dup_line_chars", "max_repeated_pct", "max_top_pct")


def _sql(r: QualityRules) -> str:
    repeated = " UNION ALL ".join(f"SELECT {m} m, {p} p, true rep" for m, p in r.repeated)
    top = " UNION ALL ".join(f"SELECT {m} m, {p} p, false rep" for m, p in r.top)
    return rf"""
WITH ws AS (SELECT doc_id, coalesce(text, '') t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
b AS (SELECT doc_id, t, w, len(w) n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT wc FROM ws),
lim AS ({repeated} UNION ALL {top}),
win AS (SELECT doc_id, m, p, rep, i, array_to_string(w[i:i + m - 1], ' ') g FROM (SELECT doc_id, m, p, rep, w, unnest(range(1, n - m + 2)) i FROM b, lim)),
cnt AS (SELECT doc_id, m, p, rep, g, count(*) c, list(i) ps FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, m, p, unnest(range(i, i + m)) k FROM (SELECT doc_id, m, p, unnest(ps) i FROM cnt WHERE rep)),
cw AS (SELECT c.doc_id, m, p, count(*) nw, sum(length(w[k])) ch FROM cov c JOIN b USING (doc_id) GROUP BY ALL),
tp AS (SELECT doc_id, p, max(c * (length(g) - m + 1)) ch FROM cnt WHERE NOT rep GROUP BY doc_id, m, p),
bad AS (SELECT doc_id FROM cw JOIN b USING (doc_id) WHERE 100 * ch > p * wc UNION SELECT doc_id FROM tp JOIN b USING (doc_id) WHERE 100 * ch > p * wc),
ln AS (SELECT doc_id, l, count(*) c, coalesce(list_sum(list_transform(list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> ''), lambda x: length(x))), 0) ch
       FROM (SELECT doc_id, unnest(string_split(t, chr(10))) l FROM b) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l),
dl AS (SELECT doc_id, sum(c - 1) d, sum(c) nl, sum((c - 1) * ch) ch FROM ln GROUP BY doc_id)
SELECT b.doc_id, n AS n_words, wc AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d, 0)::BIGINT AS n_dup_lines,
  coalesce(nw, 0)::BIGINT AS n_repeat_words, (n < {r.min_words} OR 100 * coalesce(nw, 0) > {r.max_repeat_words} * n) AS base_failed,
  NOT (n < {r.min_words} OR 100 * coalesce(nw, 0) > {r.max_repeat_words} * n) AND NOT (bad.doc_id IS NOT NULL
  OR 100 * coalesce(d, 0) > {r.max_dup_lines} * coalesce(nl, 0) OR 100 * coalesce(dl.ch, 0) > {r.max_dup_line_chars} * wc) AS kept
FROM b LEFT JOIN (SELECT doc_id, nw FROM cw WHERE m = 5) USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN bad USING (doc_id)"""


SQL = _sql(QualityRules())
